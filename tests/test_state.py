"""Stores in buckets, walks that don't move what they have seen, fixed points on unsettled state, and
what is built on them, against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statespan.functions import keys, position, sql
from statespan.operators import graph, moves, reach
from statespan.operators.sample import exact_sample, labelled
from statespan.sources import store


@pytest.fixture(scope="module")
def start(spark):
    return position.positions(spark.createDataFrame([(position.START_FEN,)], "fen string")).select("board", "wtm", "castling")


def thirds(spark, n=300):
    return spark.range(n).withColumnRenamed("id", "key")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


# -- steps ------------------------------------------------------------------------

def test_seen_rows_are_neither_shuffled_nor_sorted(spark, tmp_path):
    rows = thirds(spark)
    steps = store.Steps(spark, f"file://{tmp_path}/s", rows.schema)
    for k in range(3):
        steps.commit(k, rows.where(F.col("key") % 10 == k))
    with store.merging(spark):
        new = steps.unseen(rows.unionByName(rows), [0, 1, 2])
        plan = plan_of(new)
    assert new.count() == 210
    assert plan.count("Bucketed: true") == 3 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and plan.count("SortMergeJoin") == 3
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"  # settings of the session are as before


def test_walk_goes_on_in_another_number_of_partitions(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(i, i // 2) for i in range(40)], "a bigint, b bigint")
    roots, path = spark.range(1).withColumnRenamed("id", "node"), f"file://{tmp_path}/walk"
    expand = graph.neighbours(edges, "a", "b")
    graph.layers(roots, expand, ["node"], 5, path)
    with store.setting(spark, spark__sql__shuffle__partitions="7"):
        found = graph.layers(roots, expand, ["node"], None, path, most_parts=2)
        assert {(r.node, r.step) for r in found.collect()} == {(i, i) for i in range(41)}


def test_compaction_bounds_parts_and_keeps_rows(spark, tmp_path):
    rows = thirds(spark)
    steps = store.Steps(spark, f"file://{tmp_path}/s", rows.schema)
    for k in range(9):
        steps.commit(k, rows.where(F.col("key") % 9 == k))
        steps.compact(list(range(k)), 3)
        assert len(steps.parts) <= 4
    files = [f for p in steps.parts for f in store.Folder(spark, f"{steps.path}/{p['folder']}").names() if f.startswith("part-")]
    assert len(files) <= 4 * steps.buckets
    assert sorted(r.key for r in steps.read(list(range(9))).collect()) == list(range(300))
    assert {(r.key, r.step) for r in steps.read_steps().collect()} == {(k, k % 9) for k in range(300)}
    assert steps.read([4]).count() == 33 and [r.new for r in steps.counts().collect()] == [34, 34, 34] + [33] * 6
    again = store.Steps(spark, steps.path, rows.schema)  # as another session finds it
    assert again.committed() == list(range(9)) and again.unseen(rows, [0, 4]).count() == 300 - 34 - 33


@pytest.mark.parametrize("torn", [False, True])
def test_crash_between_write_and_swap(spark, tmp_path, monkeypatch, torn):
    rows = thirds(spark)
    steps = store.Steps(spark, f"file://{tmp_path}/s", rows.schema)
    for k in range(5):
        steps.commit(k, rows.where(F.col("key") % 5 == k))

    def dies(self, parts):
        if torn:  # the manifest's own write broke off before its rename
            folder = store.Folder(self.spark, self.path)
            folder.put("manifest/00000009.json.part", "{")
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.Steps, "_swap", dies)
        with pytest.raises(OSError):
            steps.compact(list(range(5)), 2)
    again = store.Steps(spark, steps.path, rows.schema)
    assert again.read(list(range(5))).count() == 300 and again.committed() == [0, 1, 2, 3, 4]
    gone = again.sweep()
    assert len(gone) == 1 and gone[0].startswith("merged-") and again.read(list(range(5))).count() == 300
    assert again.compact(list(range(5)), 2) and again.read(list(range(5))).count() == 300 and len(again.parts) == 2


def test_counts_come_from_the_manifest(spark, tmp_path):
    rows = thirds(spark)
    steps = store.Steps(spark, f"file://{tmp_path}/s", rows.schema)
    steps.commit(0, rows)
    steps.commit(1, rows.limit(0))
    steps.commit(1, rows.limit(7))  # replaces the step
    for p in steps.parts:
        steps.folder.delete(p["folder"])  # no step is read
    assert [tuple(r) for r in store.Steps(spark, steps.path, rows.schema).counts().collect()] == [(0, 300, 300), (1, 7, 307)]
    steps.drop()
    assert store.Steps(spark, steps.path, rows.schema).committed() == []


# -- fixed points --------------------------------------------------------------------

def plain_values(edges, settled):
    children = {}
    for p, c in set(edges):
        children.setdefault(p, set()).add(c)
    value, turn = {n: (v, 0) for n, v in settled}, 0
    while True:
        turn += 1
        new = {}
        for p, cs in children.items():
            if p not in value:
                if any(value.get(c, ("", 0))[0] == "LOSS" for c in cs):
                    new[p] = ("WIN", turn)
                elif all(value.get(c, ("", 0))[0] == "WIN" for c in cs):
                    new[p] = ("LOSS", turn)
        if not new:
            nodes = {n for e in edges for n in e} | {n for n, _ in settled}
            return {n: value.get(n, ("DRAW", None)) for n in nodes}
        value |= new


@pytest.mark.parametrize("seed,rounds", [(1, 5), (2, 1), (3, 3)])
def test_fixed_point_is_brute_force(spark, seed, rounds):
    """Random graphs with cycles and repeated edges, and a chain of more rounds than a job has."""
    rng = random.Random(seed)
    edges = [(i, rng.randrange(60)) for i in range(60) for _ in range(rng.randint(0, 3))]
    edges += edges[:20] + [(1000 + i, 1001 + i) for i in range(12)]
    parents = {p for p, _ in edges}
    settled = [(n, rng.choice(["WIN", "LOSS", "DRAW"])) for n in range(60) if n not in parents] + [(1012, "LOSS"), (99, "WIN")]
    got = graph.fixed_point(spark.createDataFrame(edges, "parent bigint, child bigint"), spark.createDataFrame(settled, "node bigint, value string"), rounds)
    assert {r.node: (r.value, r.round) for r in got.collect()} == plain_values(edges, settled)


def test_fixed_point_moves_messages_only(spark):
    """In a round's plan edges and state are read from their buckets, and one shuffle stands."""
    lines = store.bucketed(spark.createDataFrame([(1, 2, 1)], "child bigint, parent bigint, of bigint"), "child", "edges")
    state = store.bucketed(spark.createDataFrame([(1, "LOSS", 0, 0)], "node bigint, value string, round int, wins bigint"), "node", "state")
    with store.merging(spark), store.setting(spark, spark__sql__adaptive__enabled="false"):
        after = graph._rounds(lines, state, 0, 1)
        plan = plan_of(after)
    assert {tuple(r)[:3] for r in after.collect()} == {(2, "WIN", 1)}
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 3
    store.discard(lines, state)


def plain_witness(root, edges, value):
    seen, todo = {(root, True)}, [(root, True)]
    while todo:
        n, ours = todo.pop()
        after = sorted(c for p, c in set(edges) if p == n)
        if ours:
            after = [c for c in after if (value[n], value[c]) in (("WIN", "LOSS"), ("DRAW", "DRAW"))][:1]
        for c in after:
            if (c, not ours) not in seen:
                seen.add((c, not ours))
                todo.append((c, not ours))
    return len({n for n, _ in seen})


def test_witness_sizes_are_brute_force(spark):
    rng = random.Random(8)
    edges = [(i, rng.randrange(40)) for i in range(40) for _ in range(rng.randint(0, 3))]
    parents = {p for p, _ in edges}
    settled = [(n, rng.choice(["WIN", "LOSS", "DRAW"])) for n in range(40) if n not in parents]
    plain = {n: v for n, (v, _) in plain_values(edges, settled).items()}
    table = spark.createDataFrame(edges, "parent bigint, child bigint").withColumn("move_ord", F.col("child"))
    values = spark.createDataFrame([(n, v, 0) for n, v in plain.items()], "node bigint, value string, round int")
    got = {r.root: (r.value, r["size"]) for r in graph.witness_sizes(values.select("node"), table, values).collect()}
    assert got == {n: (v, plain_witness(n, edges, plain)) for n, v in plain.items() if v != "LOSS"}


@pytest.mark.parametrize("cells", [4096, 3])
def test_spread_is_the_sorted_lists(spark, cells):
    rng = random.Random(4)
    groups = {"a": [7], "b": [rng.randrange(-50, 9000) for _ in range(400)], "c": [5] * 11 + [10**12], "d": [1, 2]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x bigint")
    got = {r.g: (r.n, r.median, r.largest, round(r["mean"], 6)) for r in graph.spread(rows, "g", "x", cells).collect()}
    assert got == {g: (len(xs), sorted(xs)[len(xs) // 2], max(xs), round(sum(xs) / len(xs), 6)) for g, xs in groups.items()}


# -- walks over positions ---------------------------------------------------------------

def test_quotient_gives_the_plain_counts(spark, start):
    """Pairs of images are fewer, and the positions behind them are those of the plain walk."""
    flipped = start.select(*position.mirrored(F.col("board"), F.col("wtm"), F.col("castling")).values())
    both = start.unionByName(flipped)
    plain = [r.new for r in reach.ladder(reach.reachable(both, 4)).orderBy("step").collect()]
    pairs = reach.pair_ladder(reach.quotient(start, 4)).orderBy("step").collect()
    assert [r.positions for r in pairs] == plain and all(r.pairs < r.positions for r in pairs)
    walked = reach.quotient(start, 3)
    keyed = reach.reachable(both, 3).select("key")
    assert walked.select("key").join(keyed, "key", "left_anti").isEmpty()  # none invented


def test_subtrees_are_walks_of_each_move(spark, start):
    first = moves.successors(start, []).select("uci", "board", "wtm", "castling")
    walked = reach.subtrees(first, "uci", 2)
    sizes = {r.group: r["size"] for r in reach.subtree_sizes(walked).collect()}
    names = sorted(r.uci for r in first.select("uci").distinct().collect())
    want = {i: reach.reachable(first.where(F.col("uci") == u), 2).count() for i, u in enumerate(names)}
    assert sizes == want
    found = reach.subtree_overlap(first, "uci", 2).first()
    union = reach.reachable(first, 2).count()
    assert (found.groups, found.total, found.distinct) == (9, sum(want.values()), union) and found.imbalance == max(want.values()) / min(want.values())


def test_subtrees_of_many_groups(spark, start):
    """Over 63 groups take another column of bits."""
    first = moves.successors(start, []).select("board", "wtm", "castling")
    many = first.crossJoin(spark.range(9)).withColumn("g", F.monotonically_increasing_id())
    walked = reach.subtrees(store.saved(many, "many"), "g", 1)
    sizes = {r.group: r["size"] for r in reach.subtree_sizes(walked).collect()}
    assert len(walked.columns) == 3 and len(sizes) == 81 and set(sizes) == set(range(81))
    assert sum(sizes.values()) == 9 * sum(1 + n for n in [r.n_moves for r in moves.summaries(first).collect()])


def test_subtree_overlap_stores_neither_the_last_ply_nor_empty_words(spark, start):
    """What is stored are the words of the keys before the last ply that a group reaches, in rows that don't widen
    with the groups; the sums are those of the walks."""
    first = moves.successors(start, []).select("board", "wtm", "castling")
    many = store.saved(first.crossJoin(spark.range(30)).withColumn("g", F.monotonically_increasing_id()), "many")
    before = set(store._made)
    found = reach.subtree_overlap(many, "g", 1).first()
    after = [spark.read.parquet(p) for p in store._made if p not in before]
    each = [1 + r.n_moves for r in moves.summaries(first).collect()]
    assert (found.groups, found.total, found.distinct) == (270, 30 * sum(each), reach.reachable(first, 1).count())
    assert (found.least, found.most) == (min(each), max(each))
    assert [len(t.columns) for t in after] == [3] and 9 * 1 <= after[0].count() <= 9 * 5 and not after[0].where("bits = 0").count()
    none = reach.subtree_overlap(many.limit(0), "g", 1).first()
    assert (none.groups, none.total, none.distinct, none.factor, none.least) == (0, None, 0, None, None)
    alone = reach.subtree_overlap(many, "g", 0).first()
    assert (alone.groups, alone.total, alone.distinct, alone.least, alone.most) == (270, 270, 9, 1, 1)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_place_counts_across_batches(size):
    """Equal places and a key's words meet wherever batches end, and all 63 bits count."""
    rng = np.random.default_rng(4)
    rows = sorted((int(p), int(b)) for p, b in zip(rng.integers(0, 60, 400), rng.integers(1, 1 << 63, 400)))
    rows += [(90, 1 << 62), (90, 1 << 62), (91, 1), (3 * 10**13, (1 << 63) - 1)]
    batches = [pa.RecordBatch.from_pydict({"place": pa.array([p for p, _ in rows[i: i + size]], pa.int64()), "bits": pa.array([b for _, b in rows[i: i + size]], pa.int64())}) for i in range(0, len(rows), size)]
    got = [r for b in reach._place_counts(3)([batches[0].slice(0, 0), *batches]) for r in b.to_pylist()]
    want = {(p // 3, p % 3 * 63 + i) for p, b in rows for i in range(63) if b >> i & 1}
    assert {r["group"]: r["n"] for r in got} == {None: len({k for k, _ in want})} | Counter(g for _, g in want)


# -- conversion, samples, SQL ---------------------------------------------------------------

def test_conversion_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rows = thirds(spark).withColumn("bucket", (F.col("key") % 8).cast("int"))
    path = f"file://{tmp_path}/c"
    assert {r.state for r in store.convert(rows, path, "bucket", dry_run=True).collect()} == {"pending"}
    puts, own = [], store.Folder.put

    def dies(self, name, text):
        if len(puts) == 2:
            raise OSError("killed")
        puts.append(name)
        own(self, name, text)

    with monkeypatch.context() as m:
        m.setattr(store.Folder, "put", dies)
        with pytest.raises(OSError):
            store.convert(rows, path, "bucket", at_once=2)
    states = {r.bucket: r.state for r in store.convert(rows, path, "bucket", dry_run=True).collect()}
    assert states == {b: "converted" if b < 4 else "pending" for b in range(8)}
    got = {r.bucket: (r.state, r.n_rows, r.n_wrong) for r in store.convert(rows, path, "bucket", at_once=2).collect()}
    assert got == {b: ("converted" if b < 4 else "new", 38 if b < 4 else 37, 0) for b in range(8)}
    assert {r.state for r in store.convert(rows, path, "bucket").collect()} == {"converted"}
    assert spark.read.parquet(path).count() == 300


def test_conversion_tells_what_differs(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    rows, own = thirds(spark).withColumn("bucket", F.lit(1)), DataFrameWriter.parquet

    def parquet(self, path, *more, **others):
        own(self, path, *more, **others)
        own(spark.createDataFrame([(5,)], "key bigint").write.mode("append"), f"{path}/bucket=1")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", parquet)
        with pytest.raises(ValueError, match="differ"):
            store.convert(rows, f"file://{tmp_path}/c", "bucket")
    assert {r.state for r in store.convert(rows, f"file://{tmp_path}/c", "bucket", dry_run=True).collect()} == {"pending"}


def test_exact_sample_is_the_same_for_any_partitioning(spark):
    rows = spark.range(2000).select(F.col("id").alias("key"), F.when(F.col("id") < 3, "few").when(F.col("id") % 3 == 0, "some").otherwise("most").alias("kind"))
    one = {(r.key, r.kind) for r in exact_sample(rows.coalesce(1), "kind", "key", 25).collect()}
    assert one == {(r.key, r.kind) for r in exact_sample(rows.repartition(13), "kind", "key", 25).collect()}
    assert sorted(x for _, x in one) == ["few"] * 3 + ["most"] * 25 + ["some"] * 25
    assert "WindowGroupLimit" in plan_of(exact_sample(rows, "kind", "key", 25))
    assert labelled(spark.createDataFrame([("k", "WIN")], "fen string, value string"), "fen", "value").first().line == "k = WIN"


def test_sql_functions(spark, start):
    sql.register(spark)
    start.createOrReplaceTempView("places")
    got = {r.uci for r in spark.sql("SELECT m.uci FROM places LATERAL VIEW inline(legal_moves(places.board, places.wtm, places.castling)) m").collect()}
    assert got == {r.uci for r in moves.successors(start, []).collect()}
    row = spark.sql("SELECT position_key(board, wtm, castling) AS p, class_name(position_key(board, wtm, castling).class_id) AS name, mirror_board(mirror_board(board)) = board AS same, mirror_castling(1) AS c, in_check(board, wtm) AS k FROM places").first()
    assert row.p.key == keys.encode(start).first().key and row.name == "KBNPRvKBNPR" and row.same and row.c == 2 and not row.k


def test_prefix_is_one_plan(spark, start):
    said, at = [], start
    for _ in range(3):
        step = moves.successors(at, []).orderBy("uci").first()
        said.append(step.uci)
        at = spark.createDataFrame([(step.board, step.wtm, step.castling)], "board string, wtm boolean, castling int")
    assert moves.play(start, said).collect() == at.collect()
    with pytest.raises(ValueError, match="a1a5"):
        moves.play(start, [said[0], "a1a5"])
