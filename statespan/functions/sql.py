"""The engine's functions for SQL text: ``register`` makes them known to a session.

Scalars are Arrow functions and SQL expressions. Moves are an Arrow function too, which works on whole
batches and gives an array for LATERAL VIEW; Spark takes no Arrow table function there:

    SELECT id, m.uci FROM places LATERAL VIEW inline(legal_moves(board, wtm, castling)) m
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boards, classes, keys, position


_MOVE = T.ArrayType(T.StructType([T.StructField("uci", T.StringType()), T.StructField("move_ord", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("captured", T.StringType()),
                                  T.StructField("board", T.StringType()), T.StructField("wtm", T.BooleanType()), T.StructField("castling", T.IntegerType())]))


@F.arrow_udf(_MOVE)
def legal_moves(board: pa.Array, wtm: pa.Array, castling: pa.Array) -> pa.Array:
    """The legal moves of a position and the positions after them; null for what is none."""
    codes, good = boards.codes_of(board)
    good &= wtm.is_valid().to_numpy(zero_copy_only=False) & castling.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(good)
    white = wtm.fill_null(False).to_numpy(zero_copy_only=False)[at]
    m = boards.moves(codes[at], white, castling.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)[at])
    order = np.argsort(m["row"], kind="stable")
    table, line, names = boards.lines(), m["line"][order], pa.array(list(boards.TYPES))
    columns = {"uci": pa.array(table["uci"][line], pa.string()), "move_ord": pa.array(table["order"][line], pa.int32()), "piece": names.take(pa.array(table["piece"][line])), "captured": names.take(pa.array(m["captured"][order])),
               "board": boards.boards_of(m["codes"][order]), "wtm": pa.array(~white[m["row"][order]]), "castling": pa.array(m["castling"][order], pa.int32())}
    ends = np.concatenate([[0], np.cumsum(np.bincount(at[m["row"]], minlength=len(good)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else c.combine_chunks() for c in columns.values()], names=list(columns)), mask=pa.array(~good))


def register(spark: SparkSession) -> None:
    """legal_moves (an array), position_key and key_position (structs), in_check, mirror_board,
    mirror_castling, class_name and class_number."""
    for name, f in (("legal_moves", legal_moves), ("position_key", keys.position_key), ("key_position", keys.key_position), ("in_check", position.in_check)):
        spark.udf.register(name, f)
    flipped = " || ".join(f"substr(board, {17 - 4 * k}, 4)" for k in range(5))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mirror_board(board STRING) RETURNS STRING RETURN translate({flipped}, 'PNBRQKpnbrqk', 'pnbrqkPNBRQK')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mirror_castling(castling INT) RETURNS INT RETURN (castling & 1) * 2 + castling div 2")
    classes.class_table(spark).select("class_id", "name").createOrReplaceTempView("statespan_classes")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION class_name(class_id INT) RETURNS STRING RETURN (SELECT first(c.name) FROM statespan_classes c WHERE c.class_id = class_name.class_id)")
