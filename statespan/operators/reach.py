"""Path counts and reachability over positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.position import mirrored
from ..sources.store import bucketed, discard, merging, saved
from .graph import layers
from .moves import child_keys, key_move_counts, orbits, successors

STATE = ["board", "wtm", "castling"]


def keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and the keys of positions; a position that no key stands for raises."""
    rows = keys.encode(df.select(*columns, *STATE))
    return rows.select(*columns, F.coalesce("key", F.raise_error(F.lit("a position without a key")).cast("bigint")).alias("key"))


def perft(df: DataFrame, depth: int, by: list[str] | None = None) -> DataFrame:
    """Number of move paths of ``depth`` plies from each group of positions: the ``by``
    columns and ``nodes``. Positions go as exact keys; transpositions are merged at every ply,
    with the number of paths into them as weight, and the last ply is only counted."""
    by = by or []
    front = keyed(df, by).withColumn("paths", F.lit(1).cast("bigint"))
    for ply in range(depth - 1):
        front = child_keys(front, [*by, "paths"]).groupBy(*by, "key").agg(F.sum("paths").alias("paths"))
        if ply + 2 < depth:
            front = saved(front, "perft")
    if depth:
        front = key_move_counts(front, [*by, "paths"]).withColumn("paths", F.col("paths") * F.col("n_moves")).where("n_moves > 0")
    return front.groupBy(*by).agg(F.coalesce(F.sum("paths"), F.lit(0)).alias("nodes"))


def divide(df: DataFrame, depth: int) -> DataFrame:
    """Path counts by first move: uci, nodes (0 where every path ends before)."""
    first = saved(successors(df, []).select("uci", *STATE), "divide")
    counts = perft(first, depth - 1, ["uci"])
    return first.select("uci").distinct().join(counts, "uci", "left").select("uci", F.coalesce("nodes", F.lit(0).cast("bigint")).alias("nodes"))


def reachable(df: DataFrame, plies: int | None = None, path: str | None = None, quiet: bool = False) -> DataFrame:
    """Every position that can be reached: key, class_id, position and its first ply as
    ``step``; ``quiet`` leaves out captures and promotions. The walk goes on exact keys, 8 bytes
    a row; plies alternate the side to move, which halves the anti-join."""
    one_side = df.select("wtm").distinct().count() == 1
    found = layers(keyed(df, []), lambda front: child_keys(front, quiet=quiet), ["key"], plies, path, alternating=one_side)
    return keys.decode(found)


def layered(df: DataFrame, plies: int) -> DataFrame:
    """Distinct positions of each ply, without regard to earlier ones: step, positions."""
    front, rows = keyed(df, []).distinct(), []
    for step in range(plies + 1):
        if step:
            front = saved(child_keys(front).distinct(), "layer")
        rows.append(front.agg(F.lit(step).alias("step"), F.count("*").alias("positions")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def paths(df: DataFrame, plies: int) -> DataFrame:
    """Every path of some plies, transpositions not merged: the columns of ``df`` but the
    position's, path (UCI texts) and the position at its end."""
    front = df.withColumn("path", F.array().cast("array<string>"))
    for _ in range(plies):
        keep = [c for c in front.columns if c not in (*STATE, "halfmove", "fullmove")]
        after = successors(front, keep)
        front = after.select(*[c for c in keep if c != "path"], F.concat("path", F.array("uci")).alias("path"), *STATE, *[c for c in ("halfmove", "fullmove") if c in front.columns])
    return front


def quotient(df: DataFrame, plies: int | None = None, path: str | None = None) -> DataFrame:
    """The walk of ``reachable`` over pairs of mirror images: key (the smaller of the two), step and
    orbit (1 or 2, the positions behind a key), from the given positions and their images.

    Moves commute with the mirror, so a pair is reached when its first half is, and the sums of
    orbits are the counts of the plain walk. A pair's halves have different sides to move, so
    plies don't alternate."""
    start = orbits(keyed(df, []))
    return orbits(layers(start.select("key").where("key is not null"), lambda front: child_keys(front, orbits=True), ["key"], plies, path), ["step"])


def pair_ladder(walked: DataFrame) -> DataFrame:
    """step, pairs and positions (new ones), and their running sums."""
    from pyspark.sql import Window

    upto = lambda c: F.sum(c).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    new = walked.groupBy("step").agg(F.count("*").alias("pairs"), F.sum("orbit").alias("positions"))
    return new.select("step", "pairs", "positions", upto("pairs").alias("all_pairs"), upto("positions").alias("all_positions"))


#: Groups whose bits stand in one number.
_BITS = 63


def _subtree_walk(starts: DataFrame, group: str, plies: int) -> tuple[DataFrame, int]:
    """Which groups of positions reach which keys within some plies, and the number of words of 63
    bits, one a group in the order of the groups.

    A row is a key's word that is not empty: place (the key times the number of words, and the word), bits
    and new, those of them that came with the last ply. So a key that few groups reach takes a row or two,
    however many groups there are, and one that all reach no more than a row for each word."""
    from pyspark.sql import Window

    rows = saved(keyed(starts, [group]), "starts")
    labels = rows.select(group).distinct().withColumn("i", F.row_number().over(Window.orderBy(group)) - 1)
    labels = saved(labels, "labels")
    words = -(-labels.count() // _BITS) or 1
    if words > ((1 << 63) - 1) // keys.MAX_KEY:
        raise ValueError("too many groups for the words of a key to be numbered")
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = rows.join(labels, group).select(F.expr(f"key * {words} + i div {_BITS}").alias("place"), F.expr(f"shiftleft(1L, cast(i % {_BITS} as int))").alias("bits"))
    seen = bits.repartition(n, "place").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    seen = bucketed(seen.withColumn("new", F.col("bits")), "place", "subtrees", placed=True)
    discard(rows, labels)
    for _ in range(plies):
        after = _subtree_children(seen, words).groupBy("place").agg(F.bit_or("bits").alias("more"))
        have = seen.select(F.col("place").alias("p"), F.col("bits").alias("old")).hint("merge")
        old, more = F.coalesce("old", F.lit(0).cast("bigint")), F.coalesce("more", F.lit(0).cast("bigint"))
        with merging(spark):
            both = have.join(after, F.col("p") == F.col("place"), "full")
            both = both.select(F.coalesce("place", "p").alias("place"), old.bitwiseOR(more).alias("bits"), more.bitwiseAND(F.bitwise_not(old)).alias("new"))
            seen, before = bucketed(both, "place", "subtrees", placed=True), seen
        discard(before)
    return seen, words


def _subtree_children(seen: DataFrame, words: int) -> DataFrame:
    """place and bits of the successors of what is new."""
    front = seen.where("new <> 0").selectExpr(f"place div {words} AS key", f"place % {words} AS word", "new")
    return child_keys(front, ["word", "new"]).select(F.expr(f"key * {words} + word").alias("place"), F.col("new").alias("bits"))


def subtrees(starts: DataFrame, group: str, plies: int) -> DataFrame:
    """Which groups of positions reach which keys within some plies: key and one bit a group in
    columns s0, s1, ..., 63 groups in each; bit order is that of the groups.

    One walk for all groups: a key goes on with the bits that are new to it. The table of what each
    key has been reached by lies in buckets and is merged with the successors' bits at each ply."""
    seen, words = _subtree_walk(starts, group, plies)
    word = lambda w: F.coalesce(F.bit_or(F.when(F.expr(f"place % {words} = {w}"), F.col("bits"))), F.lit(0).cast("bigint"))
    return seen.groupBy(F.expr(f"place div {words}").alias("key")).agg(*[word(w).alias(f"s{w}") for w in range(words)])


def _add_bits(counts: np.ndarray, word: np.ndarray, bits: np.ndarray) -> None:
    """Count each bit of some words; they are taken off from the lowest on, so few bits are little work."""
    while len(bits):
        low = bits & -bits
        counts += np.bincount(word * _BITS + np.bitwise_count(low - 1), minlength=len(counts))
        bits = bits ^ low
        left = np.flatnonzero(bits)
        word, bits = word[left], bits[left]


def _bit_counts(words: int):
    def run(batches):
        counts = np.zeros(words * _BITS, np.int64)
        for batch in batches:
            for w in range(words):
                bits = batch.column(w).to_numpy(zero_copy_only=False)
                bits = bits[bits != 0]
                _add_bits(counts, np.full(len(bits), w), bits)
        group = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(counts[group])], names=["group", "n"])
    return run


def subtree_sizes(walked: DataFrame) -> DataFrame:
    """group (its place among the groups) and size, the keys that it reaches."""
    words = [c for c in walked.columns if c != "key"]
    return walked.select(*words).mapInArrow(_bit_counts(len(words)), "group int, n bigint").groupBy("group").agg(F.sum("n").alias("size"))


def _place_counts(words: int):
    """Of (place, bits) in the order of places: each group's keys, and under no group those of any. Between
    batches only the last place is held."""
    def run(batches):
        counts, n_keys, last = np.zeros(words * _BITS, np.int64), 0, -1
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add(place, bits):
            nonlocal n_keys, last
            if len(place):
                key = place // words
                n_keys += int(key[0] != last) + int((key[1:] != key[:-1]).sum())
                last = key[-1]
                _add_bits(counts, place - key * words, bits)

        for batch in batches:
            place, bits = (np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("place", "bits")))
            if len(place):
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                place, bits = place[first], np.bitwise_or.reduceat(bits, first)
                held = place[-1:], bits[-1:]
                add(place[:-1], bits[:-1])
        add(*held)
        group = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([None, *group.tolist()], pa.int32()), pa.array([n_keys, *counts[group].tolist()], pa.int64())], names=["group", "n"])
    return run


def subtree_overlap(starts: DataFrame, group: str, plies: int) -> DataFrame:
    """How much a split by groups repeats, from one walk: groups, total (sum of their sizes),
    distinct (keys that any reaches), factor, least, most and imbalance (most over least).

    The last ply, which holds most keys, is not stored: it meets the table of those before by key, is sorted
    and counted as it comes."""
    seen, words = _subtree_walk(starts, group, max(plies - 1, 0))
    rows = seen.select("place", "bits")
    if plies:
        rows = rows.unionByName(_subtree_children(seen, words))
    placed = rows.repartition(F.expr(f"place div {words}")).sortWithinPartitions("place")
    sizes = placed.mapInArrow(_place_counts(words), "group int, n bigint").groupBy("group").agg(F.sum("n").alias("n"))
    size, union = F.when(F.col("group").isNotNull(), F.col("n")), F.when(F.col("group").isNull(), F.col("n"))
    out = sizes.agg(F.count("group").alias("groups"), F.sum(size).alias("total"), F.coalesce(F.max(union), F.lit(0).cast("bigint")).alias("distinct"), F.min(size).alias("least"), F.max(size).alias("most"))
    return out.select("groups", "total", "distinct", (F.col("total") / F.col("distinct")).alias("factor"), "least", "most", (F.col("most") / F.col("least")).alias("imbalance"))


def first_step(reached: DataFrame, targets: DataFrame) -> DataFrame:
    """The first ply at which each target key is reached: key, step (null if never)."""
    return targets.select("key").distinct().join(reached.select("key", "step"), "key", "left")


def mirror_presence(reached: DataFrame) -> DataFrame:
    """Per step: n, how many of its positions have their mirror image reached too, the rate and
    what merging the two would save, 1 / (1 - rate / 2)."""
    flipped = keys.encode(reached.select("step", *[c for c in mirrored(F.col("board"), F.col("wtm"), F.col("castling")).values()]))
    hit = flipped.join(reached.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    rate = F.avg(F.coalesce("hit", F.lit(0)).cast("double"))
    return hit.groupBy("step").agg(F.count("*").alias("n"), F.count("hit").alias("n_mirrored"), rate.alias("rate"), (1 / (1 - rate / 2)).alias("saving"))


def ladder(reached: DataFrame) -> DataFrame:
    """step, new, cumulative and growth (new over the step before) of reached rows."""
    from pyspark.sql import Window

    order = Window.orderBy("step")
    new = reached.groupBy("step").agg(F.count("*").alias("new"))
    return new.select("step", "new", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"), (F.col("new") / F.lag("new").over(order)).alias("growth"))


def overlap(rows: DataFrame, group: str, item: list[str]) -> DataFrame:
    """How often groups share items: groups, total (sum of each group's distinct items),
    distinct (of all) and factor, their quotient; least and most of a group."""
    each = rows.select(group, *item).distinct().groupBy(group).agg(F.count("*").alias("n"))
    union = rows.select(*item).distinct().agg(F.count("*").alias("distinct"))
    sums = each.agg(F.count("*").alias("groups"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"))
    return sums.join(F.broadcast(union), F.lit(True)).withColumn("factor", F.col("total") / F.col("distinct"))
