"""Graph operators on any edge table: reachability by layers, and AND/OR fixed points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.store import Steps, bucketed, discard, merging, saved, scratch_path, setting


def layers(roots: DataFrame, expand: Callable[[DataFrame], DataFrame], key: list[str], max_steps: int | None = None, path: str | None = None, alternating: bool = False, most_parts: int = 4) -> DataFrame:
    """Breadth-first layers: every row that can be reached, with its first ``step``.

    ``expand`` gives the successors (columns ``key``) of a frontier. Each step is the distinct
    successors without those seen before: they are hashed and sorted once and merged with the
    sorted buckets of the seen rows, which stay where they lie. Steps are committed to ``path``; a
    later call with the same path goes on where the last one stopped. With ``alternating`` a row
    can only recur at steps of its own parity, and half of the seen rows are skipped. Seen rows
    stand in at most ``most_parts`` parts a parity, or in all, besides the last two steps.
    """
    spark = roots.sparkSession
    roots = roots.select(*key).distinct()
    steps = Steps(spark, path or scratch_path(spark, "layers"), roots.schema)
    steps.sweep()
    done = steps.committed()
    frontier = steps.read(done[-1:]) if done else steps.commit(0, roots)
    step = max(done, default=0)
    while not frontier.isEmpty() and (max_steps is None or step < max_steps):
        step += 1
        seen = [s for s in range(step) if not alternating or (s - step) % 2 == 0]
        steps.compact([s for s in seen if s < step - 1], most_parts)
        frontier = steps.commit(step, steps.unseen(expand(frontier).select(*key), seen), placed=True)
    return steps.read_steps([s for s in steps.committed() if max_steps is None or s <= max_steps])


def neighbours(edges: DataFrame, a: str, b: str) -> Callable[[DataFrame], DataFrame]:
    """An expand function over an edge table."""
    pairs = edges.select(F.col(a).alias("_from"), F.col(b).alias("node"))
    return lambda frontier: frontier.select(F.col("node").alias("_from")).join(pairs, "_from").select("node")


def fixed_point(edges: DataFrame, settled: DataFrame, rounds: int = 5) -> DataFrame:
    """Values of an AND/OR graph: edges (parent, child), settled (node, value, round 0).

    A parent is WIN if a child is LOSS, and LOSS if all children are WIN; what never settles
    is DRAW. Returns (node, value, round).

    The state is one table in buckets of the nodes touched so far: their value and round, or the
    number of children known to be WIN. A round sends what settled in the last one along the edges,
    which lie in buckets by child, sums it up by parent, and looks the parents up in the state; only
    these messages, and the parents touched since the state was written, are shuffled. Each edge
    carries one message in all. A job is ``rounds`` such rounds in one plan, and writes the state anew;
    as all its joins are of buckets, sizes met on the way would not change that plan.
    """
    edges = edges.select("parent", "child").distinct()
    kind = edges.schema["child"].dataType.simpleString()
    degrees = edges.groupBy("parent").agg(F.count("*").alias("degree"))
    lines = bucketed(edges.join(degrees, "parent").select("child", "parent", F.col("degree").alias("of")), "child", "edges")
    settled = settled.select(F.col("node").cast(kind).alias("node"), "value", F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("wins"))
    state, turn = bucketed(settled, "node", "state"), 0
    while True:
        with merging(lines.sparkSession), setting(lines.sparkSession, spark__sql__adaptive__enabled="false"):
            new, touched = Observation(), _rounds(lines, state, turn, rounds)
            turn += rounds
            before = state.withColumnsRenamed({"node": "n", "value": "v", "round": "r", "wins": "w"})
            both = before.hint("merge").join(touched, F.col("n") == F.col("node"), "full").selectExpr("coalesce(node, n) AS node", "coalesce(v, value) AS value", "coalesce(r, round) AS round", "coalesce(w, 0) + coalesce(wins, 0) AS wins")
            state, old = bucketed(both.observe(new, F.count_if(F.col("round") == turn).alias("fresh")), "node", "state", placed=True), state
        discard(old)
        if not new.get["fresh"]:
            break
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).union(settled.select("node")).distinct()
    known = state.where("value is not null").select("node", "value", "round")
    out = saved(nodes.join(known, "node", "left").select("node", F.coalesce("value", F.lit("DRAW")).alias("value"), "round"), "values")
    discard(lines, state)
    return out


def _rounds(lines: DataFrame, state: DataFrame, turn: int, rounds: int) -> DataFrame:
    """The nodes touched by some rounds after ``turn``: node, value and round (null if unsettled), wins
    since then, degree.

    In a round each row stays as it is, and goes up each edge to it if it settled in the one before.
    The rounds are one statement, so that they are analysed once."""
    parts = [f"t0 AS (SELECT node, value, round, wins, CAST(NULL AS BIGINT) AS degree FROM {state._saved_table} WHERE round = {turn})"]
    for i in range(1, rounds + 1):
        parts.append(f"""
m{i} AS (SELECT /*+ MERGE(e) */ explode(array(
    named_struct('node', node, 'value', value, 'round', round, 'wins', CASE WHEN parent IS NULL THEN wins ELSE 0L END, 'degree', degree, 'win', false),
    named_struct('node', parent, 'value', CAST(NULL AS STRING), 'round', CAST(NULL AS INT), 'wins', CASE WHEN value = 'WIN' THEN 1L ELSE 0L END, 'degree', of, 'win', value = 'LOSS'))) AS m
    FROM t{i - 1} LEFT JOIN {lines._saved_table} e ON node = child AND round = {turn + i - 1}),
g{i} AS (SELECT m.node, max(m.value) AS value, max(m.round) AS round, sum(m.wins) AS wins, max(m.degree) AS degree, max(m.win) AS win FROM m{i} WHERE m.node IS NOT NULL GROUP BY m.node),
n{i} AS (SELECT /*+ MERGE(s) */ g.node, g.value, g.round, g.wins, g.degree, CASE WHEN win THEN 'WIN' WHEN g.wins + coalesce(s.wins, 0) = degree THEN 'LOSS' END AS now FROM g{i} g LEFT JOIN {state._saved_table} s ON g.node = s.node WHERE s.value IS NULL),
t{i} AS (SELECT node, coalesce(value, now) AS value, coalesce(round, CASE WHEN now IS NOT NULL THEN {turn + i} END) AS round, wins, degree FROM n{i})""")
    return lines.sparkSession.sql(f"WITH {', '.join(parts)} SELECT * FROM t{rounds}")


def audit(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Violations: a WIN without a LOSS child, a LOSS with a child that isn't WIN (terminal
    nodes aside), a DRAW with a LOSS child or only WIN ones."""
    child = values.select(F.col("node").alias("child"), F.col("value").alias("v"))
    seen = edges.distinct().join(child, "child", "left").groupBy("parent").agg(F.max(F.expr("v = 'LOSS'")).alias("some_loss"), F.min(F.expr("v = 'WIN'")).alias("all_win"))
    wrong = F.when(F.col("value") == "WIN", ~F.col("some_loss")).when(F.col("value") == "LOSS", ~F.col("all_win")).otherwise(F.col("some_loss") | F.col("all_win"))
    return values.join(seen, values["node"] == seen["parent"]).where(wrong).select("node", "value")


def witness(roots: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """Nodes that prove the roots' values: at a WIN node its first LOSS child by ``move_ord``,
    at a LOSS node every child. Returns (node, step)."""
    first = (edges.join(values.where("value = 'WIN'").select(F.col("node").alias("parent")), "parent")
             .join(values.where("value = 'LOSS'").select(F.col("node").alias("child")), "child")
             .groupBy("parent").agg(F.min_by("child", "move_ord").alias("child")))
    every = edges.join(values.where("value = 'LOSS'").select(F.col("node").alias("parent")), "parent").select("parent", "child")
    proof = saved(first.unionByName(every).distinct(), "proof")
    return layers(roots.select("node"), neighbours(proof, "parent", "child"), ["node"])


def witness_sizes(roots: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """How many nodes prove each root's value: root, value, size (the root included).

    All roots walk at once: the frontier holds (root, node, ours). At nodes of the side that proves
    (``ours``, every other step from the root) the first child by ``move_ord`` suffices, a LOSS one
    under a WIN, a DRAW one under a DRAW; at the other side's nodes every child is needed. A node that
    two roots need is walked for each."""
    value = values.select(F.col("node").alias("parent"), "value")
    child = values.select(F.col("node").alias("child"), F.col("value").alias("v"))
    fit = edges.join(value.where("value in ('WIN', 'DRAW')"), "parent").join(child, "child").where("(value = 'WIN' and v = 'LOSS') or (value = 'DRAW' and v = 'DRAW')")
    first = fit.groupBy("parent").agg(F.min_by("child", F.struct("move_ord", "child")).alias("child"))
    need = saved(first.withColumn("ours", F.lit(True)).unionByName(edges.select("parent", "child").withColumn("ours", F.lit(False))).distinct(), "needed")
    step = lambda front: front.join(need, (front["node"] == need["parent"]) & (front["ours"] == need["ours"])).select("root", F.col("child").alias("node"), (~front["ours"]).alias("ours"))
    asked = roots.select("node").join(values.where("value in ('WIN', 'DRAW')"), "node").select(F.col("node").alias("root"), "node", F.lit(True).alias("ours"))
    walked = layers(asked, step, ["root", "node", "ours"])
    sizes = walked.groupBy("root").agg(F.countDistinct("node").alias("size"))
    return sizes.join(values.select(F.col("node").alias("root"), "value"), "root").select("root", "value", "size")


def spread(rows: DataFrame, group: str, x: str, cells: int = 4096) -> DataFrame:
    """By group: n, median (element n / 2 of the sorted numbers, counted from 0), mean, largest.

    The median comes from counts: of ``cells`` ranges of values first, then of the values in the one
    range that holds it, so no group's rows are sorted or gathered."""
    rows = rows.select(group, F.col(x).alias("x"))
    whole = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("largest"))
    whole = whole.withColumn("width", F.expr(f"(largest - least) div {cells} + 1"))
    placed = rows.join(whole.select(group, "least", "width", "n"), group).withColumn("cell", F.expr("(x - least) div width"))
    upto = lambda column: F.sum("c").over(Window.partitionBy(group).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    cell = placed.groupBy(group, "cell", "n").agg(F.count("*").alias("c")).withColumn("upto", upto("cell"))
    cell = cell.where("upto - c <= n div 2 and n div 2 < upto").select(group, "cell", F.expr("n div 2 - upto + c").alias("rank"))
    inside = placed.join(cell, [group, "cell"]).groupBy(group, "x", "rank").agg(F.count("*").alias("c")).withColumn("upto", upto("x"))
    middle = inside.where("upto - c <= rank and rank < upto").select(group, F.col("x").alias("median"))
    return whole.join(middle, group).select(group, "n", "median", "mean", "largest")


def principal_line(roots: DataFrame, edges: DataFrame, values: DataFrame, most: int = 200) -> DataFrame:
    """One line of best play from each root: (root, step, node). At a WIN node the LOSS child
    that settled first, at a LOSS node the WIN child that settled last, ties by ``move_ord``;
    it ends at a node that is settled from the start or a DRAW, after ``most`` steps at the latest."""
    child = values.select(F.col("node").alias("child"), F.col("value").alias("v"), F.col("round").alias("r"))
    both = edges.join(values.select(F.col("node").alias("parent"), "value", "round"), "parent").join(child, "child").where("round > 0 and ((value = 'WIN' and v = 'LOSS') or (value = 'LOSS' and v = 'WIN'))")
    order = F.struct(F.when(F.col("value") == "WIN", F.col("r")).otherwise(-F.col("r")), "move_ord", "child")
    best = saved(both.groupBy("parent").agg(F.min_by("child", order).alias("child")), "best")
    front = saved(roots.select(F.col("node").alias("root"), F.lit(0).alias("step"), "node"), "line")
    out = front
    while not front.isEmpty() and most > 0:
        most -= 1
        front = saved(front.join(best, front["node"] == best["parent"]).select("root", (F.col("step") + 1).alias("step"), F.col("child").alias("node")), "line")
        out = out.unionByName(front)
    return out


def cross_check(values: DataFrame, other: DataFrame) -> DataFrame:
    """How two tables of values agree: value, other_value (null where one lacks the node), n, same."""
    both = values.select("node", "value").join(other.select("node", F.col("value").alias("other_value")), "node", "full")
    return both.groupBy("value", "other_value").agg(F.count("*").alias("n")).withColumn("same", F.col("value").eqNullSafe(F.col("other_value")))
