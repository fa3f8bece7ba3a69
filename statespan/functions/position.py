"""Positions as columns: board (20 characters, a1 to d5, "." for empty), wtm (white to
move) and castling (1 white's right, 2 black's); texts in FEN and UCI notation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boards
from .geometry import FILES, SQUARES

START_FEN = "kbnr/3p/4/3P/KBNR w Dd - 0 1"
PIECES = "PNBRQKpnbrqk"


def parse_fen(fen: Column) -> dict[str, Column]:
    """board, wtm, castling, halfmove, fullmove; all null where the FEN is not one of this game."""
    parts = F.split(F.trim(fen), r"\s+")
    placement, side = F.get(parts, 0), F.get(parts, 1)
    rights, passant = F.coalesce(F.get(parts, 2), F.lit("-")), F.coalesce(F.get(parts, 3), F.lit("-"))
    spread = placement
    for d in range(9, -1, -1):
        spread = F.replace(spread, F.lit(str(d)), F.lit("." * d))
    rows = F.split(spread, "/")
    board = F.array_join(F.reverse(rows), "")
    good = F.coalesce(
        (F.size(rows) == 5) & F.forall(rows, lambda r: F.length(r) == FILES) & (F.translate(board, PIECES + ".", "") == "")
        & side.isin("w", "b") & ((rights == "-") | (F.translate(rights, "DKdk", "") == "")) & (passant == "-"), F.lit(False))
    bits = F.when(rights.rlike("[DK]"), 1).otherwise(0) + F.when(rights.rlike("[dk]"), 2).otherwise(0)
    number = lambda i, d: F.coalesce(F.try_to_number(F.get(parts, i), F.lit("99999")).cast("int"), F.lit(d))
    columns = {"board": board, "wtm": side == "w", "castling": bits, "halfmove": number(4, 0), "fullmove": number(5, 1)}
    return {k: F.when(good, c).alias(k) for k, c in columns.items()}


def positions(fens: DataFrame, column: str = "fen") -> DataFrame:
    """The rows with their position's columns."""
    return fens.select("*", *parse_fen(F.col(column)).values())


def to_fen(board: Column, wtm: Column, castling: Column, halfmove: Column | int = 0, fullmove: Column | int = 1) -> Column:
    rows = F.concat_ws("/", *[F.substring(board, SQUARES - FILES * (k + 1) + 1, FILES) for k in range(SQUARES // FILES)])
    for n in range(FILES, 0, -1):
        rows = F.replace(rows, F.lit("." * n), F.lit(str(n)))
    rights = F.element_at(F.array(*map(F.lit, ("-", "D", "d", "Dd"))), castling + 1)
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.concat_ws(" ", rows, F.when(wtm, "w").otherwise("b"), rights, F.lit("-"), as_column(halfmove).cast("string"), as_column(fullmove).cast("string"))


def show(board: Column) -> Column:
    """The board as five lines, rank 5 first."""
    return F.concat_ws("\n", *[F.substring(board, SQUARES - FILES * (k + 1) + 1, FILES) for k in range(SQUARES // FILES)])


def square_name(sq: Column) -> Column:
    return F.concat(F.substring(F.lit("abcd"), F.pmod(sq, F.lit(FILES)) + 1, F.lit(1)), (F.floor(sq / FILES) + 1).cast("string"))


def square_of(name: Column) -> Column:
    return (F.instr(F.lit("abcd"), F.substring(name, 1, 1)) - 1 + FILES * (F.instr(F.lit("12345"), F.substring(name, 2, 1)) - 1)).cast("int")


def uci_squares(text: Column) -> tuple[Column, Column]:
    """The two squares of a move in UCI notation."""
    return square_of(F.substring(text, 1, 2)), square_of(F.substring(text, 3, 2))


def uci(from_sq: Column, to_sq: Column, promo: Column) -> Column:
    return F.concat(square_name(from_sq), square_name(to_sq), F.lower(promo))


def king_square(board: Column, white: Column) -> Column:
    """The square of a side's king; null without one."""
    at = F.when(white, F.instr(board, "K")).otherwise(F.instr(board, "k"))
    return F.when(at > 0, at - 1)


@F.arrow_udf(T.BooleanType())
def attacked(board: pa.Array, sq: pa.Array, by_white: pa.Array) -> pa.Array:
    """Whether a side attacks a square; null where one of them is null or no board."""
    codes, good = boards.codes_of(board)
    good &= sq.is_valid().to_numpy(zero_copy_only=False) & by_white.is_valid().to_numpy(zero_copy_only=False)
    at = np.where(good, sq.fill_null(0).to_numpy(zero_copy_only=False), 0)
    return pa.array(boards.attacked(codes, at, by_white.fill_null(False).to_numpy(zero_copy_only=False)), mask=~good)


@F.arrow_udf(T.BooleanType())
def in_check(board: pa.Array, wtm: pa.Array) -> pa.Array:
    """Whether the side to move is in check; false without a king or a board."""
    codes, good = boards.codes_of(board)
    return pa.array(boards.checked(codes, wtm.fill_null(False).to_numpy(zero_copy_only=False)) & good)


def mirrored(board: Column, wtm: Column, castling: Column) -> dict[str, Column]:
    """Colours swapped, ranks flipped, side and rights swapped: its own inverse."""
    flipped = F.concat(*[F.substring(board, SQUARES - FILES * (k + 1) + 1, FILES) for k in range(SQUARES // FILES)])
    swapped = F.translate(flipped, PIECES, PIECES.swapcase())
    return {"board": swapped.alias("board"), "wtm": (~wtm).alias("wtm"), "castling": (castling.bitwiseAND(1) * 2 + F.floor(castling / 2).cast("int")).alias("castling")}
