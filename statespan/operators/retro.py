"""Values of small endgames: all positions of some material, solved backwards, class by class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.geometry import SQUARES
from ..functions.position import attacked, in_check, king_square
from ..sources.store import discard, saved
from .graph import fixed_point
from .moves import child_keys, successors


def index_board(index: Column, pieces: str) -> Column:
    """The board of a dense index: side to move, then a base-20 digit for each piece's square;
    null if two pieces share a square."""
    squares, rest = [], F.floor(index / 2)
    for _ in pieces:
        squares.append(F.pmod(rest, F.lit(SQUARES)).cast("int"))
        rest = F.floor(rest / SQUARES)
    board = reduce(lambda b, x: F.overlay(b, F.lit(x[0]), x[1] + 1, F.lit(1)), zip(pieces, squares), F.lit("." * SQUARES))
    return F.when(F.size(F.array_distinct(F.array(*squares))) == len(pieces), board)


def board_index(board: Column, wtm: Column, pieces: str) -> Column:
    """The smallest dense index of a board: of equal pieces the first has the first square.
    Null where the board's pieces are not these."""
    digits, seen = [], {}
    for p in pieces:
        k = seen[p] = seen.get(p, 0) + 1
        at = F.length(F.substring_index(board, p, k)) if k > 1 else F.instr(board, p) - 1
        digits.append(at)
    total = sum((d.cast("bigint") * SQUARES ** i for i, d in enumerate(digits)), F.lit(0).cast("bigint"))
    fits = reduce(lambda a, b: a & b, [F.length(board) - F.length(F.translate(board, p, "")) == n for p, n in seen.items()])
    only = F.length(F.translate(board, "".join(seen), "")) == SQUARES - len(pieces)
    return F.when(fits & only & (F.translate(board, "." + "".join(seen), "") == ""), total * 2 + F.when(wtm, 0).otherwise(1))


def material(spark: SparkSession, pieces: str) -> DataFrame:
    """All placements of the pieces: index, board, wtm, castling (none), legal (the side that
    just moved is not in check)."""
    rows = spark.range(2 * SQUARES ** len(pieces)).select(F.col("id").alias("index"), index_board(F.col("id"), pieces).alias("board"), (F.col("id") % 2 == 0).alias("wtm"), F.lit(0).alias("castling"))
    rows = rows.where("board is not null")
    if len(set(pieces)) < len(pieces):
        rows = rows.where(F.col("index") == board_index(F.col("board"), F.col("wtm"), pieces))
    last_rank = F.concat(F.substring("board", 1, 4), F.substring("board", 17, 4))
    fits = ~last_rank.rlike("[Pp]") if "p" in pieces.lower() else F.lit(True)
    safe = ~attacked("board", king_square(F.col("board"), ~F.col("wtm")), "wtm")
    return rows.where(fits).withColumn("legal", F.coalesce(safe, F.lit(False)))


def solve_class(spark: SparkSession, pieces: str, solved: DataFrame | None = None) -> DataFrame:
    """Values of all positions of one material; children outside of it are looked up among
    those ``solved``, and one that is not there raises."""
    own = saved(keys.encode(material(spark, pieces).where("legal")).select(F.lit(pieces).alias("pieces"), F.col("key").alias("node"), "board", "wtm"), "positions")
    after = saved(child_keys(own.select("node", F.col("node").alias("key")), ["node"]).select(F.col("node").alias("parent"), F.col("key").alias("child")), "moves")
    ended = own.join(after.select(F.col("parent").alias("node")), "node", "left_anti")
    settled = ended.select("node", F.when(in_check("board", "wtm"), "LOSS").otherwise("DRAW").alias("value"))
    outside = after.select(F.col("child").alias("node")).distinct().join(own, "node", "left_anti")
    if solved is not None:
        settled = settled.unionByName(outside.join(solved, "node").select("node", "value"))
        outside = outside.join(solved, "node", "left_anti")
    missing = outside.first()
    if missing is not None:
        raise ValueError(f"a move of {pieces} leads to an unsolved position: {missing['node']}")
    values = fixed_point(after, settled)
    out = saved(own.join(values, "node").select("pieces", "node", "board", "wtm", "value", "round"), "class")
    discard(own, after, values)
    return out


def solve(spark: SparkSession, classes: list[str]) -> DataFrame:
    """Values of all positions of some materials, each given as its pieces ("KkQ"), solved from
    the smallest on, those with a pawn after those of as many pieces without. The list must be
    closed under captures and promotions.

    Returns pieces, node (the key), board, wtm, value (for the side to move), round."""
    done: DataFrame | None = None
    for pieces in sorted(classes, key=lambda p: (len(p), p.lower().count("p"))):
        new = solve_class(spark, pieces, done)
        done = new if done is None else done.unionByName(new)
    return done


def edges(positions: DataFrame) -> DataFrame:
    """(parent, child, move_ord) of solved positions."""
    rows = positions.select(F.col("node").alias("parent"), "board", "wtm", F.lit(0).alias("castling"))
    return keys.encode(successors(rows, ["parent"])).select("parent", F.col("key").alias("child"), "move_ord")


def histogram(values: DataFrame) -> DataFrame:
    """Positions by material and value."""
    return values.groupBy("pieces", "value").agg(F.count("*").alias("n"), F.max("round").alias("max_round"))
