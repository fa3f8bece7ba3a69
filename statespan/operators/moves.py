"""Successors of positions, a kernel over Arrow batches for all of a batch's moves at once.

The columns of a position are board, wtm and castling, and its clocks halfmove and
fullmove where a table has them. Rows never depend on one another, so a plan with
successors is a scan and a projection; only what merges positions shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boards
from ..functions.position import uci_squares

POSITION = ("board", "wtm", "castling")
CLOCKS = ("halfmove", "fullmove")
#: Rows of a batch whose moves are worked out at once.
_ROWS = 4096
_MOVE = [("uci", T.StringType()), ("move_ord", T.IntegerType()), ("piece", T.StringType()), ("captured", T.StringType()), ("promo", T.StringType()),
         ("board", T.StringType()), ("wtm", T.BooleanType()), ("castling", T.IntegerType())]
_NAMES = pa.array(list(boards.TYPES))
_PROMOTED = pa.array(["", *boards.TYPES[1:]])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, rows that are positions, codes, white, castling) of at most _ROWS rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            board, wtm, castling = (part.column(c) for c in POSITION)
            codes, good = boards.codes_of(board)
            good &= wtm.is_valid().to_numpy(zero_copy_only=False) & castling.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(good)
            yield part, at, codes[at], wtm.fill_null(False).to_numpy(zero_copy_only=False)[at], castling.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)[at]


def _successors(keep: list[str], out: list[str], legal: bool):
    def run(batches):
        table = boards.lines()
        uci, order = pa.array(table["uci"]), pa.array(table["order"])
        for part, at, codes, white, castling in _parts(batches):
            m = boards.moves(codes, white, castling, legal)
            row, line = pa.array(at[m["row"]]), pa.array(m["line"])
            turn = white[m["row"]]
            made = {"uci": uci.take(line), "move_ord": order.take(line), "piece": _NAMES.take(pa.array(table["piece"][m["line"]])), "captured": _NAMES.take(pa.array(m["captured"])),
                    "promo": _PROMOTED.take(pa.array(table["promo"][m["line"]])), "board": boards.boards_of(m["codes"]), "wtm": pa.array(~turn), "castling": pa.array(m["castling"], pa.int32())}
            if "halfmove" in out:
                pawn = np.isin(table["piece"][m["line"]], [boards.CODE["P"], boards.CODE["p"]])
                made["halfmove"] = pa.compute.if_else(pa.array(pawn | (m["captured"] > 0)), 0, pa.compute.add(part.column("halfmove").take(row), 1)).cast(pa.int32())
            if "fullmove" in out:
                made["fullmove"] = pa.compute.add(part.column("fullmove").take(row), pa.array((~turn).astype(np.int32))).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in keep), *(made[c] for c in out)], names=[*keep, *out])
    return run


def successors(df: DataFrame, keep: list[str] | None = None, legal: bool = True) -> DataFrame:
    """Legal moves (or all that the pieces can make): the ``keep`` columns of ``df`` (all others
    than the position's, if not given), uci, move_ord, piece, captured, promo (a kept column
    of such a name stays as it is instead) and the position after it, with its clocks if
    ``df`` has them. Rows that are no position have none."""
    clocks = [c for c in CLOCKS if c in df.columns]
    keep = [c for c in df.columns if c not in (*POSITION, *clocks)] if keep is None else list(keep)
    made = [(n, t) for n, t in [*_MOVE, *((c, T.IntegerType()) for c in clocks)] if n not in keep]
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), *(T.StructField(n, t) for n, t in made)])
    need = list(dict.fromkeys([*keep, *POSITION, *clocks]))
    return df.select(*need).mapInArrow(_successors(keep, [n for n, _ in made], legal), schema)


def pseudo_moves(df: DataFrame) -> DataFrame:
    """Moves that ignore the safety of the mover's king."""
    return successors(df, legal=False)


def _summary(rest: list[str]):
    def run(batches):
        table = boards.lines()
        for part, at, codes, white, castling in _parts(batches):
            m = boards.moves(codes, white, castling)
            n = part.num_rows
            count = lambda which: pa.array(np.bincount(at[m["row"][which]], minlength=n))
            check = np.zeros(n, bool)
            check[at] = boards.checked(codes, white)
            every = np.ones(len(m["row"]), bool)
            made = [pa.array(check), count(every), count(m["captured"] > 0), count(table["promo"][m["line"]] > 0)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], names=[*rest, "check", "n_moves", "n_captures", "n_promotions"])
    return run


def summaries(df: DataFrame) -> DataFrame:
    """The rows with check (the mover's king is attacked), n_moves, n_captures and
    n_promotions, and state: moving, mate or stalemate. Moves are counted where they are
    made, so none is shuffled."""
    names = ("check", "n_moves", "n_captures", "n_promotions")
    rest = [c for c in df.columns if c not in (*names, "state")]
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in rest), T.StructField("check", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in names[1:])])
    return df.select(*rest).mapInArrow(_summary(rest), schema).withColumn("state", F.when(F.col("n_moves") > 0, "moving").when(F.col("check"), "mate").otherwise("stalemate"))


def _child_keys(keep: list[str], quiet: bool, orbits: bool = False):
    def run(batches):
        table = boards.lines()
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                good, codes, white, castling = boards.positions_of(part.column("key").fill_null(-8).to_numpy(zero_copy_only=False))
                at = np.flatnonzero(good)
                m = boards.moves(codes[at], white[at], castling[at])
                if quiet:
                    stay = np.flatnonzero((m["captured"] == 0) & (table["promo"][m["line"]] == 0))
                    m = {k: v[stay] for k, v in m.items()}
                key, _ = (boards.least_keys if orbits else boards.keys_of)(m["codes"], ~white[at][m["row"]], m["castling"])
                row = pa.array(at[m["row"]][key >= 0])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in keep), pa.array(key[key >= 0])], names=[*keep, "key"])
    return run


def child_keys(df: DataFrame, keep: list[str] | None = None, quiet: bool = False, orbits: bool = False) -> DataFrame:
    """From keys to the keys of their successors, 8 bytes a row: the ``keep`` columns and key.
    ``quiet`` leaves out captures and promotions, ``orbits`` gives the smaller key of each successor and
    its mirror image; keys that are no position have none, and what
    takes a king (where the side that just moved is in check) leads to no position."""
    keep = list(keep or [])
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("key", T.LongType())])
    return df.select(*keep, "key").mapInArrow(_child_keys(keep, quiet, orbits), schema)


def _orbits(keep: list[str]):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                good, codes, white, castling = boards.positions_of(part.column("key").fill_null(-8).to_numpy(zero_copy_only=False))
                least, size = boards.least_keys(codes, white, castling)
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(least, pa.int64(), mask=~good), pa.array(size.astype(np.int32), mask=~good)], names=[*keep, "key", "orbit"])
    return run


def orbits(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns, key as the smaller of a key and its mirror image's, and orbit, how many
    positions stand behind it (1 or 2); null for keys that are no position."""
    keep = list(keep or [])
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("key", T.LongType()), T.StructField("orbit", T.IntegerType())])
    return df.select(*keep, "key").mapInArrow(_orbits(keep), schema)


def _key_counts(keep: list[str]):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                good, codes, white, castling = boards.positions_of(part.column("key").fill_null(-8).to_numpy(zero_copy_only=False))
                at = np.flatnonzero(good)
                row = at[boards.moves(codes[at], white[at], castling[at])["row"]]
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(np.bincount(row, minlength=part.num_rows))], names=[*keep, "n_moves"])
    return run


def key_move_counts(df: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the number of moves of each key's position."""
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("n_moves", T.LongType())])
    return df.select(*keep, "key").mapInArrow(_key_counts(keep), schema)


def parse_move(df: DataFrame, move: str | Column) -> DataFrame:
    """Each position with the move that a UCI text stands for: from_sq, to_sq, promo (as the
    piece of the mover), castle (1 or 2) and legal; all null for a text that is no move."""
    text = F.lower(F.lit(move) if isinstance(move, str) else move)
    known = text.rlike("^[a-d][1-5][a-d][1-5][qrbn]?$")
    start, to = uci_squares(text)
    piece = F.substring("board", start + 1, F.lit(1))
    promo = F.substring(text, 5, 1)
    castle = F.when((piece == "K") & (start == 0) & (to == 2), 1).when((piece == "k") & (start == 16) & (to == 18), 2).otherwise(0)
    rows = df.withColumns({"from_sq": F.when(known, start), "to_sq": F.when(known, to), "promo": F.when(known, F.when(F.col("wtm"), F.upper(promo)).otherwise(promo)), "castle": F.when(known, castle)})
    return rows.withColumn("legal", is_legal("board", "wtm", "castling", F.when(known, text)))


@F.arrow_udf(T.BooleanType())
def is_legal(board: pa.Array, wtm: pa.Array, castling: pa.Array, move: pa.Array) -> pa.Array:
    """Whether a UCI text is a legal move of a position; null where it is no text or no position."""
    codes, good = boards.codes_of(board)
    good &= wtm.is_valid().to_numpy(zero_copy_only=False) & castling.is_valid().to_numpy(zero_copy_only=False) & move.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(good)
    m = boards.moves(codes[at], wtm.fill_null(False).to_numpy(zero_copy_only=False)[at], castling.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)[at])
    said = np.array(move.fill_null("").to_pylist(), dtype="U8")[at]
    hit = np.zeros(len(good), bool)
    same = boards.lines()["uci"][m["line"]] == said[m["row"]]
    hit[at[m["row"][same]]] = True
    return pa.array(hit, mask=~good)


def play(df: DataFrame, moves: list[str]) -> DataFrame:
    """The positions after a sequence of moves, in one plan that one job checks; a move that is
    illegal in any of them raises."""
    clocks = [c for c in CLOCKS if c in df.columns]
    for move in moves:
        rows = parse_move(df.select(*POSITION, *clocks), move)
        error = F.raise_error(F.lit(f"illegal move {move}")).cast("boolean")
        legal = rows.where(F.when(F.coalesce("legal", F.lit(False)), True).otherwise(error)).select(*POSITION, *clocks)
        df = successors(legal, []).where(F.col("uci") == move.lower()).select(*POSITION, *clocks)
    try:
        df.count()
    except Exception as e:
        bad = next((m for m in moves if f"illegal move {m}" in str(e)), None)
        if bad is None:
            raise
        raise ValueError(f"illegal move {bad}") from e
    return df
