"""Distinct successors of positions that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.moves import successors


def distinct_successors(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Successors of arriving positions, each once within the watermark: the state that is
    kept for dropping repeats is bounded by ``delay``, not by the length of the stream.

    ``stream`` has board, wtm, castling and an event time; rows without a king give nothing.
    """
    after = successors(stream, [time]).select(time, "board", "wtm", "castling")
    return after.withWatermark(time, delay).dropDuplicatesWithinWatermark(["board", "wtm", "castling"])
