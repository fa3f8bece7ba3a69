"""The engine against published counts, plain-Python rules and small exhaustive domains."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from statespan.functions import classes, keys, position
from statespan.functions.geometry import BISHOP, FILES, KING, KNIGHT, RANKS, ROOK
from statespan.operators import graph, moves, reach, retro
from statespan.sources import store


@pytest.fixture(scope="module")
def start(spark):
    return position.positions(spark.createDataFrame([(position.START_FEN,)], "fen string")).select("board", "wtm", "castling")


# -- plain rules, square by square ------------------------------------------------

def on(r, f):
    return 0 <= r < RANKS and 0 <= f < FILES


def hits(board, sq, white):
    r, f = divmod(sq, FILES)
    own = (lambda c: c.isupper()) if white else (lambda c: c.islower())
    for df in (-1, 1):
        a, b = r + (-1 if white else 1), f + df
        if on(a, b) and board[a * FILES + b] == ("P" if white else "p"):
            return True
    for steps, kinds, far in ((KNIGHT, "N", 0), (KING, "K", 0), (BISHOP, "BQ", 1), (ROOK, "RQ", 1)):
        for dr, df in steps:
            a, b = r + dr, f + df
            while on(a, b):
                c = board[a * FILES + b]
                if c != ".":
                    if own(c) and c.upper() in kinds:
                        return True
                    break
                if not far:
                    break
                a, b = a + dr, b + df
    return False


def plain_moves(board, wtm, castling):
    out = []
    mine = str.isupper if wtm else str.islower
    for sq, p in enumerate(board):
        if not mine(p):
            continue
        r, f = divmod(sq, FILES)
        to = []
        if p in "Pp":
            d = 1 if wtm else -1
            if on(r + d, f) and board[(r + d) * FILES + f] == ".":
                to.append((r + d) * FILES + f)
            to += [(r + d) * FILES + f + x for x in (-1, 1) if on(r + d, f + x) and board[(r + d) * FILES + f + x] != "." and not mine(board[(r + d) * FILES + f + x])]
        else:
            for dr, df in {"N": KNIGHT, "K": KING, "B": BISHOP, "R": ROOK, "Q": BISHOP + ROOK}[p.upper()]:
                a, b = r + dr, f + df
                while on(a, b):
                    c = board[a * FILES + b]
                    if not mine(c):
                        to.append(a * FILES + b)
                    if c != "." or p in "NnKk":
                        break
                    a, b = a + dr, b + df
        for t in to:
            last = p in "Pp" and t // FILES in (0, RANKS - 1)
            for promo in (("QRBN" if wtm else "qrbn") if last else [""]):
                x = list(board)
                x[sq], x[t] = ".", promo or p
                out.append((sq, t, promo, "".join(x)))
    base, king, rook, bit = (0, "K", "R", 1) if wtm else (16, "k", "r", 2)
    if castling & bit and board[base: base + 4] == king + ".." + rook and not any(hits(board, base + k, not wtm) for k in range(3)):
        out.append((base, base + 2, "", board[:base] + "." + rook + king + "." + board[base + 4:]))
    legal = []
    for a, b, promo, x in out:
        k = x.find("K" if wtm else "k")
        if k < 0 or hits(x, k, not wtm):
            continue
        c = castling
        if board[a] == "K" or a in (0, 3) or b == 3:
            c &= ~1
        if board[a] == "k" or a in (16, 19) or b == 19:
            c &= ~2
        legal.append((a, b, promo, x, c))
    return legal


def random_boards(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        b = ["."] * 20
        for p in ["K", "k", *rng.choices("PNBRQpnbrq", k=rng.randint(0, 7))]:
            b[rng.choice([i for i in range(20) if b[i] == "."])] = p
        if rng.random() < 0.3:
            b = ["." if c in "Kk" else c for c in b]
            b[0], b[1], b[2], b[3], b[16 + rng.randint(0, 3)] = "K", ".", ".", "R", "k"
        out.append(("".join(b), rng.random() < 0.5, rng.randint(0, 3)))
    return out


def test_successors_are_plain_rules(spark):
    rows = random_boards(400, 3)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, board string, wtm boolean, castling int")
    got = {}
    for r in moves.successors(df).collect():
        got.setdefault(r.id, []).append((r.uci, r.board, r.castling))
    name = lambda s: "abcd"[s % 4] + str(s // 4 + 1)
    for i, r in enumerate(rows):
        want = [(name(a) + name(b) + p.lower(), x, c) for a, b, p, x, c in plain_moves(*r)]
        assert sorted(got.get(i, [])) == sorted(want)
    checks = df.select("id", position.in_check(F.col("board"), F.col("wtm")).alias("c")).collect()
    for r in checks:
        board, wtm, _ = rows[r.id]
        k = board.find("K" if wtm else "k")
        assert r.c == (k >= 0 and hits(board, k, not wtm))


def test_path_counts(spark, start):
    assert [reach.perft(start, d).first().nodes for d in (1, 2, 3, 4, 5)] == [9, 69, 525, 3957, 32944]
    got = {r.uci: r.nodes for r in reach.divide(start, 5).collect()}
    assert got == {"a1a2": 3519, "a1b2": 5085, "b1a2": 4354, "b1c2": 4952, "b1d3": 3303, "c1a2": 3487, "c1b3": 1859, "c1d3": 2995, "d2d3": 3390}


def test_reachable_ladders(spark, start, tmp_path):
    reached = reach.reachable(start, 3, f"file://{tmp_path}/walk")
    again = reach.reachable(start, 5, f"file://{tmp_path}/walk")  # goes on from step 3
    assert reached.count() == 448
    rows = reach.ladder(again).orderBy("step").collect()
    assert [r.cumulative for r in rows] == [1, 10, 79, 448, 2379, 11872]
    assert again.select("board", "wtm", "castling").distinct().count() == 11872
    quiet = reach.ladder(reach.reachable(start, 4, quiet=True)).orderBy("step").collect()
    assert [r.cumulative for r in quiet] == [1, 10, 72, 347, 1504]
    assert [r.positions for r in reach.layered(start, 2).orderBy("step").collect()] == [1, 9, 69]
    coded = keys.encode(again)
    assert coded.select("key").distinct().count() == 11872 and coded.where("key is null").isEmpty()


def test_key_round_trip_and_mirror(spark, start):
    coded = keys.encode(reach.reachable(start, 4))
    back = keys.decode(coded.select("key", F.col("board").alias("was"), F.col("wtm").alias("turn"), F.col("castling").alias("rights")))
    assert back.where("board = was and wtm = turn and castling = rights").count() == 2379
    other = coded.select("key", *position.mirrored(F.col("board"), F.col("wtm"), F.col("castling")).values()).withColumnRenamed("key", "first")
    twice = keys.encode(keys.encode(other).select("first", *position.mirrored(F.col("board"), F.col("wtm"), F.col("castling")).values()))
    assert twice.where("first = key").count() == 2379


def test_exhaustive_keys(spark):
    for pieces, want in (("KkN", 20 * 19 * 18), ("KkRR", 20 * 19 * 18 * 17 // 2)):
        rows = {"".join(dict(zip(sq, pieces)).get(i, ".") for i in range(20)) for sq in itertools.permutations(range(20), len(pieces))}
        coded = keys.encode(spark.createDataFrame([(b, True, 0) for b in rows], "board string, wtm boolean, castling int"))
        r = coded.agg(F.countDistinct("key").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
        assert r.n == want and r.hi - r.lo == 8 * (want - 1)


def test_rejected_keys(spark):
    bad = ["K...k...........QQ..", "K...k...........PQ..", "K...................", "K...k..........BBNN.", "x" * 20, "K..k", None]
    rows = keys.encode(spark.createDataFrame([(b, True, 0) for b in bad], "board string, wtm boolean, castling int"))
    assert rows.where("key is not null").isEmpty() and rows.count() == len(bad)
    odd = keys.decode(spark.createDataFrame([(-1,), (keys.MAX_KEY,), (None,)], "key bigint"))
    assert odd.where("board is not null").isEmpty() and odd.count() == 3


def test_classes(spark):
    t = classes.class_table(spark).cache()
    r = t.agg(F.count("*").alias("n"), F.count_if("canonical").alias("c"), F.max("placements").alias("m"), F.sum("placements").alias("s")).first()
    assert (r.n, r.c, r.m, 8 * r.s) == (2304, 1296, 670_442_572_800, keys.MAX_KEY)
    names = t.where("canonical").select("class_id", "name").withColumn("back", classes.parse_class(F.col("name")))
    assert names.where("back <> class_id or back is null").isEmpty()
    odd = spark.createDataFrame([("krnvk",), ("KvKvK",), ("KQQvK",), ("KxvK",), ("KPQvK",)], "name string").select(classes.parse_class(F.col("name")).alias("id")).collect()
    assert odd[0].id is not None and [r.id for r in odd[1:]] == [None] * 4
    e = classes.class_edges(spark).join(t.select("class_id", "piece_count", "nonpawn_count"), "class_id")
    down = e.join(t.select(F.col("class_id").alias("successor"), F.col("piece_count").alias("p"), F.col("nonpawn_count").alias("q")), "successor")
    assert down.where("not (p < piece_count or (p = piece_count and q > nonpawn_count))").isEmpty() and down.count() > 1000


def test_fen(spark):
    good = ["kbnr/3p/4/3P/KBNR w Dd - 0 1", "1kR1/4/3N/2BP/K3 b - - 0 1", "k3/3N/1K2/4/4 b d - 3 9"]
    bad = ["kbnr/3p/4/3P w - - 0 1", "kbnr/3p/4/3P/KBNRR w - -", "kbnr/3p/4/3P/KBNX w - -", "kbnr/3p/4/3P/KBNR x - -", "kbnr/3p/4/3P/KBNR w D e3", "kbnr/3p/4/3P/KBNR w z", "", None, "kbnr/3p/5/3P/KBNR w"]
    rows = position.positions(spark.createDataFrame([(f,) for f in good + bad], "fen string"))
    text = position.to_fen(F.col("board"), F.col("wtm"), F.col("castling"), F.col("halfmove"), F.col("fullmove"))
    assert [r.t for r in rows.select(text.alias("t")).where("t is not null and length(t) > 20").collect()] == good
    assert rows.where("board is null").count() == len(bad)
    mates = position.positions(spark.createDataFrame([(f,) for f in good[1:]], "fen string"))
    assert moves.successors(mates).isEmpty()
    assert [r.c for r in mates.select(position.in_check(F.col("board"), F.col("wtm")).alias("c")).collect()] == [True, False]
    assert moves.play(position.positions(spark.createDataFrame([(good[0],)], "fen string")), ["d2d3"]).first().board == "KBNR.......P...pkbnr"
    with pytest.raises(ValueError):
        moves.play(position.positions(spark.createDataFrame([(good[0],)], "fen string")), ["d2d4"])


def test_endgames(spark):
    values = retro.solve(spark, ["Kk", "KkR"]).cache()
    got = {r.pieces: (r.n, r.w, r.l, r.d) for r in values.groupBy("pieces").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "WIN").alias("w"), F.count_if(F.col("value") == "LOSS").alias("l"), F.count_if(F.col("value") == "DRAW").alias("d")).collect()}
    assert got == {"Kk": (540, 0, 0, 540), "KkR": (7950, 3090, 3672, 1188)}
    edges = retro.edges(values).cache()
    assert graph.audit(edges, values).isEmpty()
    root = values.where("value = 'WIN'").orderBy(F.desc("round"), "node").limit(1)
    proof = graph.witness(root, edges, values).join(values, "node")
    assert proof.where("value = 'DRAW'").isEmpty() and proof.count() > 5
    with pytest.raises(ValueError):
        retro.solve(spark, ["KkR"])


def test_fixed_point_on_a_small_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b"), ("d", "e"), ("e", "d"), ("f", "g"), ("f", "b")], "parent string, child string")
    settled = spark.createDataFrame([("c", "LOSS"), ("g", "WIN")], "node string, value string")
    got = {r.node: r.value for r in graph.fixed_point(edges, settled).collect()}
    assert got == {"c": "LOSS", "g": "WIN", "b": "WIN", "a": "LOSS", "f": "LOSS", "d": "DRAW", "e": "DRAW"}


def test_store(spark, tmp_path):
    rows = spark.range(0, 100_000, 7).withColumnRenamed("id", "key")
    path = f"file://{tmp_path}/set"
    assert store.write_verified(rows, path, "key") == rows.count()
    assert store.write_verified(rows.limit(10), path, "key") == 10
    assert store.read_or_empty(spark, f"{path}-none", rows.schema).count() == 0
    steps = store.Steps(spark, f"file://{tmp_path}/steps", rows.schema)
    steps.commit(0, rows.limit(3))
    rows.limit(5).write.parquet(f"file://{tmp_path}/steps/step=1")  # never committed
    assert steps.committed() == [0] and steps.counts().collect()[0].cumulative == 3


def test_streamed_successors(spark, tmp_path):
    from statespan.streaming.arrivals import distinct_successors

    board = position.positions(spark.createDataFrame([(position.START_FEN,)], "fen string")).select("board", "wtm", "castling")
    rows = board.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = distinct_successors(stream, "ts").writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("arrivals").count() == 9


# -- kernels and what goes with them ------------------------------------------------

def test_clocks(spark):
    fens = ["kbnr/3p/4/3P/KBNR w Dd - 7 12", "kbnr/3p/4/3P/KBNR b Dd - 7 12"]
    rows = position.positions(spark.createDataFrame([(f,) for f in fens], "fen string"))
    got = {(r.fen.split()[1], r.uci): (r.halfmove, r.fullmove) for r in moves.successors(rows).collect()}
    assert got["w", "d2d3"] == (0, 12) and got["w", "b1a2"] == (8, 12)
    assert {v for (side, _), v in got.items() if side == "b"} == {(8, 13), (0, 13)}


def test_parse_moves(spark):
    """UCI texts against the position: a castling move is known by the king's squares."""
    rows = position.positions(spark.createDataFrame([("k3/4/4/4/K2R w D - 0 1",)], "fen string"))
    texts = ["a1c1", "a1a2", "d1d5", "a1c3", "xx", "a9a1", "d1d4q"]
    given = rows.crossJoin(spark.createDataFrame([(t,) for t in texts], "said string"))
    got = {r.said: (r.castle, r.legal) for r in moves.parse_move(given, F.col("said")).collect()}
    assert got == {"a1c1": (1, True), "a1a2": (0, True), "d1d5": (0, True), "a1c3": (0, False), "xx": (None, None), "a9a1": (None, None), "d1d4q": (0, False)}


def test_child_keys_are_successors(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(random_boards(300, 8))], "id int, board string, wtm boolean, castling int")
    coded = keys.encode(rows).where("key is not null")
    fine = coded.where(~position.in_check("board", ~F.col("wtm")))
    a = keys.encode(moves.successors(fine.drop("key", "class_id"))).select("id", "key")
    b = moves.child_keys(fine, ["id"])
    assert a.count() > 500 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    n = {r.id: r.n_moves for r in moves.key_move_counts(fine, ["id"]).collect()}
    assert n == {r.id: r.n_moves for r in moves.summaries(fine).collect()}
    odd = spark.createDataFrame([(None, True, 0), ("x" * 20, True, 0), ("K..k", True, 0), ("." * 20, None, None)], "board string, wtm boolean, castling int")
    assert moves.successors(odd).isEmpty() and moves.summaries(odd).count() == 4
    with pytest.raises(Exception, match="without a key"):
        reach.perft(odd.limit(1), 1).collect()


def test_dense_index(spark):
    for pieces in ("Kk", "KkR", "KkRR"):
        rows = retro.material(spark, pieces)
        again = rows.withColumn("back", retro.board_index(F.col("board"), F.col("wtm"), pieces))
        assert again.where("back is null or back <> index").isEmpty()
        assert rows.select("board", "wtm").distinct().count() == rows.count()


def test_principal_line_and_cross_check(spark):
    values = retro.solve(spark, ["Kk", "KkR"])
    edges = retro.edges(values)
    root = values.where("value = 'LOSS'").orderBy(F.desc("round"), "node").limit(1)
    line = graph.principal_line(root, edges, values).join(values, "node").orderBy("step").collect()
    assert [r.value for r in line] == ["LOSS" if k % 2 == 0 else "WIN" for k in range(len(line))] and line[-1]["round"] == 0 and len(line) == line[0]["round"] + 1
    rows = {(r.value, r.other_value): r.same for r in graph.cross_check(values, values.where("value <> 'DRAW'")).collect()}
    assert rows == {("WIN", "WIN"): True, ("LOSS", "LOSS"): True, ("DRAW", None): False}


def test_mirror_commutes_with_moves(spark, start):
    """Flipping and moving give the same positions in either order; presence counts them."""
    flip = lambda df: df.select(*position.mirrored(F.col("board"), F.col("wtm"), F.col("castling")).values())
    rows = reach.reachable(start, 2)
    a = moves.successors(flip(rows), []).select("board", "wtm", "castling").distinct()
    b = flip(moves.successors(rows.select("board", "wtm", "castling"), [])).distinct()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    both = rows.unionByName(keys.encode(flip(rows)).withColumn("step", F.lit(9)), allowMissingColumns=True)
    seen = {r.step: (r.n, r.n_mirrored) for r in reach.mirror_presence(both).collect()}
    assert all(n == hit for n, hit in seen.values())


def test_ladder_text_and_values(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "ladder.txt").write_text("1 9\n2 69\nnot a line\n3 525\n")
    assert [tuple(r) for r in store.read_ladder(spark, f"{path}/ladder.txt").orderBy("step").collect()] == [(1, 9), (2, 69), (3, 525)]
    store.write_values(spark.createDataFrame([(1, "WIN"), (2, None)], "node bigint, value string"), f"{path}/values")
    assert {tuple(r) for r in spark.read.schema("node bigint, value string").json(f"{path}/values").collect()} == {(1, "WIN"), (2, None)}


def test_steps_resume_and_count(spark, tmp_path):
    rows = spark.range(0, 100).withColumnRenamed("id", "key")
    steps = store.Steps(spark, f"file://{tmp_path}/s", rows.schema)
    for k in range(3):
        steps.commit(k, rows.where(F.col("key") % 3 == k))
    steps.commit(3, rows.limit(0))
    assert [tuple(r) for r in steps.counts().orderBy("step").collect()] == [(0, 34, 34), (1, 33, 67), (2, 33, 100), (3, 0, 100)]


def test_missing_checkpoint_dir_raises(monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        store.shared_folder(Cluster())


def test_kernels_travel_by_value():
    """Executors have no copy of this package on their path."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    payload = cloudpickle.dumps((moves._successors(["id"], ["uci"], True), moves._summary(["id"]), moves._child_keys([], False), keys.position_key.func, keys.key_position.func, position.in_check.func))
    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); assert not any(m.startswith('statespan') and getattr(sys.modules[m], '__file__', None) for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], input=payload, check=True, cwd="/", timeout=60)


def test_command_line(spark):
    from statespan.__main__ import run

    assert run(spark, ["perft", "3"]) == ["525"]
    assert sum(int(x.split()[1]) for x in run(spark, ["perft", "3", "--divide"])) == 525 and len(run(spark, ["moves"])) == 9
    assert run(spark, ["show", "--after", "d2d3"]) == ["kbnr", "...p", "...P", "....", "KBNR"]
    assert run(spark, ["reach", "2"]) == ["0 1 1", "1 9 10", "2 69 79"]
    with pytest.raises(ValueError):
        run(spark, ["moves", "--fen", "nothing"])
