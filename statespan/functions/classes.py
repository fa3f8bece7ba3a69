"""Material classes: side index = subset of B, N, R (1, 2, 4) * 6 + slot (none, P, Q, R, B, N);
class = white index * 48 + black index. A class name is K and letters, v, K and letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .geometry import once

SIDES = 48
# Bit of a piece in the subset, and slot number.
SUBSET = {"B": 1, "N": 2, "R": 4}
SLOTS = {"P": 1, "Q": 2, "R": 3, "B": 4, "N": 5}
COUNTED = "PNBRQ"


def side_pieces(side: int) -> tuple[int, ...]:
    """Pieces P, N, B, R, Q of a side index."""
    subset, slot = divmod(side, 6)
    return tuple(bool(p in SUBSET and subset & SUBSET[p]) + (slot == SLOTS[p]) for p in COUNTED)


@once
def canonical_sides() -> frozenset[int]:
    """The side indexes of which the slot's piece, if the subset could hold it, is in the subset
    too: every count of pieces has one of them at most."""
    return frozenset(i for i in range(SIDES) if all(i % 6 != SLOTS[p] or i // 6 & bit for p, bit in SUBSET.items()))


def side_counts(side: Column) -> dict[str, Column]:
    """Pieces P, N, B, R, Q of a side index."""
    return {p: F.get(F.lit([side_pieces(i)[k] for i in range(SIDES)]), side) for k, p in enumerate(COUNTED)}


def side_index(c: dict[str, Column]) -> Column:
    """The canonical side index of counts, found in the table of all canonical ones' counts;
    null where none has them."""
    of = {side_pieces(i): i for i in canonical_sides()}
    table = F.lit([of.get(tuple(v // 3 ** k % 3 for k in range(len(COUNTED))), -1) for v in range(3 ** len(COUNTED))])
    fits = reduce(lambda a, b: a & b, [c[p].between(0, 2) for p in COUNTED])
    at = sum((c[p] * 3 ** k for k, p in enumerate(COUNTED)), F.lit(0))
    return F.nullif(F.when(fits, F.get(table, at.cast("int"))), F.lit(-1))


def is_canonical(side: Column) -> Column:
    return side.isin(sorted(canonical_sides()))


def side_name(c: dict[str, Column]) -> Column:
    return F.concat(F.lit("K"), *[F.repeat(F.lit(p), c[p]) for p in "BNPQR"])


def parse_class(name: Column) -> Column:
    """The class of a name, letters in any order and case; null for what is no class."""
    sides = F.split(F.upper(name), "V")
    count = lambda s: {p: F.length(s) - F.length(F.translate(s, p, "")) for p in COUNTED}
    one = lambda s: F.when(s.rlike("^K[PNBRQ]*$"), side_index(count(s)))
    return F.when(F.size(sides) == 2, one(F.get(sides, 0)) * SIDES + one(F.get(sides, 1)))


def class_table(spark: SparkSession) -> DataFrame:
    """A row per class: class_id, name, white and black counts (P, N, B, R, Q), canonical,
    piece_count, nonpawn_count, placements and base, the running sum of the placements before."""
    ids = spark.range(SIDES * SIDES, numPartitions=1).select(F.col("id").cast("int").alias("class_id"))
    w, b = F.floor(F.col("class_id") / SIDES).cast("int"), F.pmod("class_id", F.lit(SIDES))
    rows = ids.select("class_id", w.alias("w"), b.alias("b"))
    wc, bc = side_counts(F.col("w")), side_counts(F.col("b"))
    rows = rows.select("class_id", F.concat(side_name(wc), F.lit("v"), side_name(bc)).alias("name"), F.array(*wc.values()).alias("white"), F.array(*bc.values()).alias("black"),
                       (is_canonical(F.col("w")) & is_canonical(F.col("b"))).alias("canonical"))
    total = F.expr("aggregate(concat(white, black), 0, (s, x) -> s + x)")
    rows = rows.withColumn("piece_count", total).withColumn("nonpawn_count", F.col("piece_count") - F.col("white")[0] - F.col("black")[0])
    doubles = F.expr("aggregate(concat(white, black), 1L, (s, x) -> s * CASE WHEN x = 2 THEN 2L ELSE 1L END)")
    rows = rows.withColumn("doubles", doubles).withColumn("placements", F.expr("factorial(20) div factorial(18 - piece_count) div doubles").cast("bigint")).drop("doubles")
    before = Window.orderBy("class_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("placements").over(before), F.lit(0)).cast("bigint"))


def class_edges(spark: SparkSession) -> DataFrame:
    """(class_id, successor): one capture or one promotion away."""
    steps = [{p: -1} for p in COUNTED] + [{"P": -1, p: 1} for p in COUNTED if p != "P"]
    change = F.explode(F.array(*[F.array(*[F.lit(step.get(p, 0) if k == mover else 0) for k in (0, 1) for p in COUNTED]) for mover in (0, 1) for step in steps]))
    rows = class_table(spark).select("class_id", F.concat("white", "black").alias("now"), change.alias("change"))
    rows = rows.select("class_id", F.zip_with("now", "change", lambda x, y: x + y).alias("c"))
    side = lambda k: side_index({p: F.get("c", F.lit(k * len(COUNTED) + i)) for i, p in enumerate(COUNTED)})
    out = rows.select("class_id", (side(0) * SIDES + side(1)).alias("successor"))
    return out.where("successor is not null and successor <> class_id").distinct()


def descends(pieces: Column, nonpawns: Column, after: Column, nonpawns_after: Column) -> Column:
    """Whether an edge leads down: fewer pieces, or as many and one pawn turned into a piece."""
    return (after < pieces) | ((after == pieces) & (nonpawns_after > nonpawns))
