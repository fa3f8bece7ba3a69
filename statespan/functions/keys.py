"""Exact keys: (class base + rank of the placement) * 8 + castling * 2 + side to move.

The rank counts the placements of the same pieces that come before, square by square in
the order of types ``TYPES``; ranking, unranking and the search for the class of a key
run over Arrow batches (``boards``), as twenty dependent steps would leave generated code
if written as lambdas. What a class is called comes from an equi-join with the class table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boards
from .classes import class_table

MAX_KEY = 123_263_644_654_240


def _numbers(column: pa.Array, kind, missing) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(kind)


def _null_below(values: np.ndarray, kind) -> pa.Array:
    return pa.array(values, kind, mask=values < 0)


@F.arrow_udf(T.StructType().add("class_id", "integer").add("key", "long"))
def position_key(board: pa.Array, wtm: pa.Array, castling: pa.Array) -> pa.Array:
    """Class and key of a position; null for what is none."""
    codes, good = boards.codes_of(board)
    good &= wtm.is_valid().to_numpy(zero_copy_only=False) & castling.is_valid().to_numpy(zero_copy_only=False)
    key, class_id = boards.keys_of(codes, _numbers(wtm, bool, False), _numbers(castling, np.int64, 0))
    return pa.StructArray.from_arrays([_null_below(np.where(good, class_id, -1), pa.int32()), _null_below(np.where(good, key, -1), pa.int64())], names=["class_id", "key"])


@F.arrow_udf(T.IntegerType())
def key_class(key: pa.Array) -> pa.Array:
    """The class whose range of keys holds a key; null outside of all."""
    return _null_below(boards.classes_of_keys(_numbers(key, np.int64, -8)), pa.int32())


@F.arrow_udf(T.StructType().add("class_id", "integer").add("board", "string").add("wtm", "boolean").add("castling", "integer"))
def key_position(key: pa.Array) -> pa.Array:
    """Class and position of a key; no position for keys that are none (out of range, or of
    a class that is only another name)."""
    values = _numbers(key, np.int64, -8)
    good, codes, white, castling = boards.positions_of(values)
    return pa.StructArray.from_arrays([
        _null_below(boards.classes_of_keys(values), pa.int32()), boards.boards_of(codes, good), pa.array(white, mask=~good), pa.array(castling, pa.int32(), mask=~good)],
        names=["class_id", "board", "wtm", "castling"])


def encode(df: DataFrame) -> DataFrame:
    """Rows with board, wtm, castling, and their class_id and key (null where no class fits)."""
    rest = [c for c in df.columns if c not in ("class_id", "key")]
    return df.select(*rest, position_key("board", "wtm", "castling").alias("_position")).select(*rest, "_position.class_id", "_position.key")


def with_class(df: DataFrame) -> DataFrame:
    """Rows with a key, and the class whose range of keys holds it."""
    table = F.broadcast(class_table(df.sparkSession).select("class_id", "name", "white", "black", "canonical", "base", "placements"))
    return df.drop("class_id").withColumn("class_id", key_class("key")).join(table, "class_id", "left")


def decode(df: DataFrame) -> DataFrame:
    """Rows with a key, its class_id, and its board, wtm and castling; null for keys that are none."""
    rest = [c for c in df.columns if c not in ("class_id", "board", "wtm", "castling")]
    return df.select(*rest, key_position("key").alias("_position")).select(*rest, "_position.*")
