"""Registered queries of the engine: its operators on the given tables, or on positions whose
keys are derived from them, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes, keys, position, sql
from ..operators import graph, moves, reach, retro
from ..operators.sample import exact_sample, labelled
from ..sources.store import Folder, Steps, bucket, convert, discard, read_ladder, saved, scratch_path, write_ladder, write_values, write_verified
from . import rules_sql as rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEY = "((l_orderkey % 1000003007 * 1103515 + l_partkey * 40503 + l_linenumber * 97) % 1000003007) * 123263 + l_suppkey % 123263"


_ORDER_KEY = _KEY.replace("l_partkey", "o_custkey").replace("l_linenumber", "7").replace("l_suppkey", "o_custkey").replace("l_", "o_")


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of a position for each line item."""
    return _table(spark, sf_dir, "lineitem").select(F.expr(_KEY).alias("key"))


def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of the orders' keys that are positions in which the side that just moved is
    not in check, at most one per order."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORDER_KEY).alias("key"))
    found = keys.decode(rows).where("board is not null").select("o_orderkey", "board", "wtm", "castling")
    return found.where(~position.in_check("board", ~F.col("wtm")))


# -- positions ------------------------------------------------------------------

def key_round_trip(spark, sf_dir):
    rows = keys.decode(line_keys(spark, sf_dir)).where("class_id is not null").select(F.col("class_id").alias("was"), F.col("key").alias("first"), "board", "wtm", "castling")
    back = keys.encode(rows)
    return back.groupBy(F.col("was").alias("class_id")).agg(
        F.count("*").alias("n"), F.count("board").alias("n_valid"), F.count_if(F.col("key") == F.col("first")).alias("n_same"), F.coalesce(F.max(F.when(F.col("board").isNotNull(), F.col("first"))), F.lit(-1)).alias("max_key"))


def key_injectivity(spark, sf_dir):
    rows = keys.decode(line_keys(spark, sf_dir)).where("board is not null")
    return rows.agg(F.countDistinct("key").alias("n_keys"), F.countDistinct("board", "wtm", "castling").alias("n_positions"), F.max("key").alias("max_key"), F.sum(F.col("key").cast("decimal(38,0)")).cast("double").alias("key_sum"))


def class_histogram(spark, sf_dir):
    rows = keys.with_class(line_keys(spark, sf_dir)).where("canonical")
    return rows.groupBy("class_id", "name").agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def class_top(spark, sf_dir):
    return class_histogram(spark, sf_dir).select("class_id", "name", "n").orderBy(F.desc("n"), "class_id").limit(8)


def class_successors(spark, sf_dir):
    """How many sampled positions stand one capture or promotion above each class."""
    have = class_histogram(spark, sf_dir).select("class_id", "n")
    edges = F.broadcast(classes.class_edges(spark))
    return have.join(edges, "class_id").groupBy(F.col("successor").alias("class_id")).agg(F.count("*").alias("n_above"), F.sum("n").alias("n_positions"))


def piece_counts(spark, sf_dir):
    rows = keys.decode(line_keys(spark, sf_dir)).where("board is not null")
    n = {p: F.sum(F.length("board") - F.length(F.translate("board", p, ""))).alias(f"n_{'w' if p.isupper() else 'b'}{p.lower()}") for p in "KPNBRQkpnbrq"}
    return rows.groupBy("class_id").agg(F.count("*").alias("n"), *n.values())


def fen_round_trip(spark, sf_dir):
    rows = keys.decode(line_keys(spark, sf_dir)).where("board is not null")
    text = rows.select("castling", "board", "wtm", position.to_fen(F.col("board"), F.col("wtm"), F.col("castling")).alias("fen"))
    back = text.select(F.col("castling").alias("c"), F.col("board").alias("b"), F.col("wtm").alias("w"), *position.parse_fen(F.col("fen")).values())
    return back.groupBy(F.col("c").alias("castling"), F.col("w").alias("wtm")).agg(F.count("*").alias("n"), F.count_if((F.col("b") == F.col("board")) & (F.col("w") == F.col("wtm")) & (F.col("c") == F.col("castling"))).alias("n_same"))


def mirror_pairs(spark, sf_dir):
    rows = keys.decode(line_keys(spark, sf_dir)).where("board is not null").select(F.col("class_id").alias("was"), F.col("key").alias("first"), *position.mirrored(F.col("board"), F.col("wtm"), F.col("castling")).values())
    other = keys.encode(rows)
    return other.groupBy(F.col("was").alias("class_id")).agg(F.max("class_id").alias("mirror_class"), F.count("*").alias("n"), F.count_if(F.least("first", "key") == F.col("first")).alias("n_canonical"))


def move_counts(spark, sf_dir):
    """Positions of the orders by side and state: moving, mated, stalemated or without a king to move."""
    state = moves.summaries(order_positions(spark, sf_dir))
    return state.groupBy("wtm", "check", "state").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("n_moves", "n_captures", "n_promotions")])


def paths_two_plies(spark, sf_dir):
    """Move paths of two plies from each order's position."""
    return reach.perft(order_positions(spark, sf_dir), 2, ["o_orderkey"])


def reach_two_plies(spark, sf_dir):
    """New positions per ply within two plies of all orders' positions."""
    return reach.ladder(reach.reachable(order_positions(spark, sf_dir), 2)).withColumn("growth", F.round("growth", 6))


def endgame_values(spark, sf_dir):
    """Each order stands for a king and rook against king position by its key; orders by value."""
    solved = retro.solve(spark, ["Kk", "KkR"]).where("pieces = 'KkR'").select("node", "value", "round")
    rows = _table(spark, sf_dir, "orders").select("o_orderstatus", F.pmod(F.col("o_orderkey") * 2654435, F.lit(16000)).alias("i"))
    rows = rows.select("o_orderstatus", retro.index_board(F.col("i"), "KkR").alias("board"), (F.col("i") % 2 == 0).alias("wtm"), F.lit(0).alias("castling"))
    found = keys.encode(rows).join(solved, F.col("key") == F.col("node"), "left")
    return found.groupBy("o_orderstatus", F.coalesce("value", F.lit("ILLEGAL")).alias("value")).agg(F.count("*").alias("n"), F.coalesce(F.max("round"), F.lit(-1)).alias("max_round"))


def uci_histogram(spark, sf_dir):
    """The legal moves of the orders' positions by their UCI text."""
    after = moves.successors(order_positions(spark, sf_dir), [])
    return after.groupBy("uci").agg(F.count("*").alias("n"), F.count_if(F.col("captured") != ".").alias("n_captures"))


def parsed_moves(spark, sf_dir):
    """A text made of each order's numbers, read as a move in its position."""
    rows = order_positions(spark, sf_dir).join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    start, to = F.pmod("o_custkey", F.lit(20)).cast("int"), F.pmod(F.floor(F.col("o_orderkey") / 3), F.lit(20)).cast("int")
    found = moves.parse_move(rows, F.concat(position.square_name(start), position.square_name(to)))
    return found.groupBy("castle", "legal").agg(F.count("*").alias("n"), F.sum("from_sq").alias("from_sum"), F.sum("to_sq").alias("to_sum"))


def clock_successors(spark, sf_dir):
    """Positions read from FEN with clocks that the orders' keys give, and the clocks a move later."""
    rows = order_positions(spark, sf_dir)
    fen = position.to_fen(F.col("board"), F.col("wtm"), F.col("castling"), F.pmod("o_orderkey", F.lit(50)), F.pmod("o_orderkey", F.lit(90)) + 1)
    read = position.positions(rows.select("o_orderkey", fen.alias("fen"))).drop("fen")
    return moves.successors(read, []).groupBy("wtm").agg(F.count("*").alias("n"), F.sum("halfmove").alias("halfmoves"), F.sum("fullmove").alias("fullmoves"), F.count_if(F.col("halfmove") == 0).alias("n_reset"))


def fen_dump(spark, sf_dir):
    """The orders' positions as FEN with their number of legal moves, and as a drawing."""
    rows = moves.summaries(order_positions(spark, sf_dir))
    return rows.select("o_orderkey", position.to_fen(F.col("board"), F.col("wtm"), F.col("castling")).alias("fen"), position.show(F.col("board")).alias("shown"), "n_moves")


def mirror_presence(spark, sf_dir):
    """Of the positions within a ply of the orders' positions, how many have their mirror image there."""
    found = reach.mirror_presence(reach.reachable(order_positions(spark, sf_dir), 1))
    return found.select("step", "n", "n_mirrored", F.round("rate", 9).alias("rate"), F.round("saving", 9).alias("saving"))


def first_reach(spark, sf_dir):
    """The first ply, of two, at which the mirror images of the orders' positions are reached."""
    rows = order_positions(spark, sf_dir)
    flipped = keys.encode(rows.select(*position.mirrored(F.col("board"), F.col("wtm"), F.col("castling")).values()))
    return reach.first_step(reach.reachable(rows, 2), flipped).groupBy(F.coalesce("step", F.lit(-1)).alias("step")).agg(F.count("*").alias("n"))


def path_tree(spark, sf_dir):
    """All paths of two plies from the orders' positions, none merged, by their first move."""
    tree = reach.paths(order_positions(spark, sf_dir), 2)
    return tree.groupBy(F.get("path", F.lit(0)).alias("first_move")).agg(F.count("*").alias("n_paths"), F.countDistinct("board", "wtm", "castling").alias("n_ends"))


def forced_divide(spark, sf_dir):
    """Moves after the alphabetically first move of each order's position, by text."""
    first = moves.successors(order_positions(spark, sf_dir), ["o_orderkey"]).groupBy("o_orderkey").agg(F.min_by(F.struct("board", "wtm", "castling"), "uci").alias("x")).select("x.*")
    return moves.successors(first, []).groupBy("uci").agg(F.count("*").alias("nodes"))


def layered_counts(spark, sf_dir):
    """Distinct positions of each ply from the orders' positions, whether met before or not."""
    return reach.layered(order_positions(spark, sf_dir), 2)


def quiet_reach(spark, sf_dir):
    """New positions per ply that moves other than captures and promotions reach."""
    return reach.ladder(reach.reachable(order_positions(spark, sf_dir), 2, quiet=True)).select("step", "new", "cumulative")


def dense_index(spark, sf_dir):
    """The dense index of king, rook and king positions: line items as indexes, their boards, and back."""
    rows = _table(spark, sf_dir, "lineitem").select(F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31 + F.col("l_linenumber"), F.lit(16000)).alias("i"))
    made = rows.withColumn("board", retro.index_board(F.col("i"), "KkR")).withColumn("back", retro.board_index(F.col("board"), F.col("i") % 2 == 0, "KkR"))
    return made.groupBy(F.coalesce(F.instr("board", "R"), F.lit(0)).alias("rook_at")).agg(F.count("*").alias("n"), F.count_if(F.col("i") == F.col("back")).alias("n_same"), F.coalesce(F.sum("back"), F.lit(-1)).alias("index_sum"))


def class_order(spark, sf_dir):
    """The classes of the line items' keys in the order in which they can be solved, their names read back."""
    have = class_histogram(spark, sf_dir).select("class_id", "n")
    rows = F.broadcast(classes.class_table(spark).select("class_id", "name", "piece_count", "nonpawn_count"))
    order = Window.orderBy("piece_count", F.desc("nonpawn_count"), "class_id")
    return have.join(rows, "class_id").select("class_id", "name", "piece_count", "nonpawn_count", "n", F.row_number().over(order).alias("place"), classes.parse_class(F.col("name")).cast("int").alias("parsed"))


def class_descent(spark, sf_dir):
    """Edges between classes that the line items' keys are in, and those that break the order."""
    sizes = classes.class_table(spark).select("class_id", "piece_count", "nonpawn_count")
    have = class_histogram(spark, sf_dir).select("class_id").join(F.broadcast(sizes), "class_id")
    below = have.select(F.col("class_id").alias("successor"), F.col("piece_count").alias("p"), F.col("nonpawn_count").alias("q"))
    edges = have.join(F.broadcast(classes.class_edges(spark)), "class_id").join(below, "successor")
    return edges.groupBy("piece_count").agg(F.count("*").alias("n_edges"), F.count_if(~classes.descends(F.col("piece_count"), F.col("nonpawn_count"), F.col("p"), F.col("q"))).alias("n_wrong"))


def class_space(spark, sf_dir):
    """Placements of the classes that the line items' keys are in, by number of pieces."""
    have = class_histogram(spark, sf_dir).select("class_id", "n")
    rows = have.join(F.broadcast(classes.class_table(spark).select("class_id", "piece_count", "placements")), "class_id")
    return rows.groupBy("piece_count").agg(F.count("*").alias("n_classes"), F.sum("placements").alias("placements"), F.sum("n").alias("n_positions"), F.round(F.log2(F.sum("placements").cast("double")), 6).alias("bits"))


def divided_paths(spark, sf_dir):
    """Paths of two plies from all of the orders' positions by their first move."""
    return reach.divide(order_positions(spark, sf_dir), 2)


def resumed_walk(spark, sf_dir):
    """New positions per ply of a walk that stopped after one ply, was swept of what a broken run had
    left, and went on; counts from the manifest."""
    rows, path = order_positions(spark, sf_dir), scratch_path(spark, "walk")
    reach.reachable(rows, 1, path)
    keys_of = reach.keyed(rows, []).select("key").schema
    rows.select("wtm").limit(5).write.parquet(f"{path}/merged-broken")
    reach.reachable(rows, 2, path)
    steps = Steps(spark, path, keys_of)
    left = len([n for n in steps.folder.names() if n == "merged-broken"])
    return steps.counts().withColumn("left_over", F.lit(left))


def key_space_share(spark, sf_dir):
    """How many different positions the line items' keys stand for, and the share of the space of keys in millionths."""
    rows = keys.decode(line_keys(spark, sf_dir)).where("board is not null")
    space = classes.class_table(spark).agg((F.sum("placements") * 8).alias("key_space"))
    n = rows.agg(F.countDistinct("key").alias("n_positions"))
    return n.join(F.broadcast(space), F.lit(True)).select("n_positions", "key_space", F.round(1000000 * F.col("n_positions") / F.col("key_space"), 9).alias("share"))


def verified_store(spark, sf_dir):
    """The line items' keys rewritten as a sorted set, read back and compared row for row before it takes
    its place; what stands there then, by bucket."""
    path = scratch_path(spark, "verified")
    write_verified(line_keys(spark, sf_dir).distinct(), path, "key")
    return spark.read.parquet(path).groupBy(bucket(F.col("key"), 42).alias("bucket")).agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def subtree_overlap(spark, sf_dir):
    """What a split of the work by first move would repeat: the positions within a ply of each move
    of the orders' positions, of all moves of one text together, and of all in one."""
    first = moves.successors(order_positions(spark, sf_dir), [])
    out = reach.subtree_overlap(first.select("uci", "board", "wtm", "castling"), "uci", 1)
    return out.select("groups", "total", F.col("distinct").alias("n_distinct"), F.round("factor", 6).alias("factor"), "least", "most", F.round("imbalance", 6).alias("imbalance"))


def quotient_ladder(spark, sf_dir):
    """New pairs of mirror images per ply from the orders' positions, and the positions behind them."""
    return reach.pair_ladder(reach.quotient(order_positions(spark, sf_dir), 2))


def labelled_sample(spark, sf_dir):
    """Twenty of the orders' king and rook against king positions of each value, as FEN = VALUE."""
    solved = retro.solve(spark, ["Kk", "KkR"]).where("pieces = 'KkR'").select("node", "value")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") * 2654435, F.lit(16000)).alias("i"))
    rows = rows.select("o_orderkey", retro.index_board(F.col("i"), "KkR").alias("board"), (F.col("i") % 2 == 0).alias("wtm"), F.lit(0).alias("castling"))
    found = keys.encode(rows.withColumn("fen", position.to_fen(F.col("board"), F.col("wtm"), F.col("castling")))).join(solved, F.col("key") == F.col("node"))
    return labelled(exact_sample(found.select("o_orderkey", "fen", "value"), "value", "o_orderkey", 20), "fen", "value")


def sql_move_counts(spark, sf_dir):
    """The counts of ``move_counts`` in SQL text alone, moves under LATERAL VIEW."""
    sql.register(spark)
    return spark.sql(f"""
WITH keyed AS (SELECT o_orderkey, key_position({_ORDER_KEY}) AS p FROM parquet.`{sf_dir}/orders.parquet`),
placed AS (SELECT o_orderkey, p.board, p.wtm, p.castling FROM keyed WHERE p.board IS NOT NULL),
places AS (SELECT *, in_check(board, wtm) AS check FROM placed WHERE NOT in_check(board, NOT wtm)),
per AS (SELECT o_orderkey, wtm, check, count(m.uci) AS n, count_if(m.captured <> '.') AS captures, count_if(length(m.uci) = 5) AS promotions
        FROM (SELECT o_orderkey, wtm AS white, check AS checked, legal_moves(board, wtm, castling) AS all_moves, wtm, check FROM places) LATERAL VIEW OUTER inline(all_moves) m AS uci, move_ord, piece, captured, board_after, wtm_after, castling_after
        GROUP BY o_orderkey, wtm, check)
SELECT wtm, check, CASE WHEN n > 0 THEN 'moving' WHEN check THEN 'mate' ELSE 'stalemate' END AS state, count(*) AS n, sum(n) AS n_moves, sum(captures) AS n_captures, sum(promotions) AS n_promotions FROM per GROUP BY 1, 2, 3""".replace("m.uci", "uci").replace("m.captured", "captured").replace("wtm AS white, check AS checked, ", ""))


# -- tables -----------------------------------------------------------------------

def bfs_customer_part(spark, sf_dir):
    """Layers of the graph of customers (even nodes) and parts (odd ones) they ordered, from customer 1."""
    line, orders = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = line.join(orders, line.l_orderkey == orders.o_orderkey).select((F.col("o_custkey") * 2).alias("c"), (F.col("l_partkey") * 2 + 1).alias("p")).distinct()
    edges = saved(pairs.select(F.col("c").alias("a"), F.col("p").alias("b")).unionByName(pairs.select(F.col("p").alias("a"), F.col("c").alias("b"))), "edges")
    roots = spark.range(1).select(F.lit(2).cast("bigint").alias("node"))
    found = graph.layers(roots, graph.neighbours(edges, "a", "b"), ["node"], alternating=True)
    return found.groupBy("step").agg(F.count("*").alias("new"), F.sum("node").alias("node_sum"))


def _order_graph(spark, sf_dir, steps=(2, 3)):
    """Orders that lead to the orders of half and a third of their key: edges (parent, child) and
    the ends of chains, every fifth key and those that lead nowhere, with a value by their status."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), "o_orderstatus")
    edges = o.select("parent", F.explode(F.array(*[F.floor(F.col("parent") / k) for k in steps])).alias("child")).where("child <> parent and parent % 5 <> 0").distinct()
    edges = edges.join(o.select(F.col("parent").alias("child")), "child", "left_semi").select("parent", "child")
    ends = o.join(edges.select("parent"), "parent", "left_anti").select(F.col("parent").alias("node"), F.when(F.col("o_orderstatus") == "F", "LOSS").otherwise("DRAW").alias("value"))
    return edges, ends


def order_graph_values(spark, sf_dir):
    """WIN, LOSS or DRAW of orders that lead to the orders of half and a third of their key;
    the ends of chains have the value of their status."""
    values = graph.fixed_point(*_order_graph(spark, sf_dir))
    return values.groupBy("value", F.coalesce("round", F.lit(-1)).alias("round")).agg(F.count("*").alias("n"))


def graph_audit(spark, sf_dir):
    """Violations among the order graph's values once every 11th value is called a draw."""
    edges, ends = _order_graph(spark, sf_dir)
    values = graph.fixed_point(edges, ends)
    bent = values.withColumn("value", F.when(F.col("node") % 11 == 0, "DRAW").otherwise(F.col("value")))
    wrong = graph.audit(edges, values).select(F.lit("true").alias("kind"), "value", "node").unionByName(graph.audit(edges, bent).select(F.lit("bent").alias("kind"), "value", "node"))
    return wrong.groupBy("kind", "value").agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))


def graph_witness(spark, sf_dir):
    """Nodes that prove the values of the order graph's WIN nodes of the last round."""
    edges, ends = _order_graph(spark, sf_dir)
    values = graph.fixed_point(edges, ends)
    last = values.where("value = 'WIN'").agg(F.max("round").alias("round"))
    roots = values.where("value = 'WIN'").join(F.broadcast(last), "round").select("node")
    proof = graph.witness(roots, edges.withColumn("move_ord", F.col("child")), values)
    return proof.groupBy("step").agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))


def graph_lines(spark, sf_dir):
    """Lines of best play from the order graph's nodes: how many have each length, and their ends."""
    edges, ends = _order_graph(spark, sf_dir)
    values = graph.fixed_point(edges, ends)
    lines = graph.principal_line(values.where("round > 0").select("node"), edges.withColumn("move_ord", F.col("child")), values)
    return lines.groupBy("root").agg(F.max("step").alias("length"), F.max_by("node", "step").alias("last")).groupBy("length").agg(F.count("*").alias("n"), F.sum("last").alias("last_sum"))


def witness_sizes(spark, sf_dir):
    """How many nodes prove the value of every 101st order of the order graph, for those that need
    more than themselves: n, element n / 2 of the sorted sizes, mean, largest and that as a share of all nodes in per cent."""
    edges, ends = _order_graph(spark, sf_dir)
    values = graph.fixed_point(edges, ends)
    sizes = saved(graph.witness_sizes(values.where("node % 101 = 0").select("node"), edges.withColumn("move_ord", F.col("child")), values).where("size > 1"), "sizes")
    share = F.round(100 * F.col("largest") / F.lit(values.count()), 6)
    return graph.spread(sizes, "value", "size").select("value", "n", "median", F.round("mean", 4).alias("mean"), "largest", share.alias("share"))


def value_cross_check(spark, sf_dir):
    """The order graph's values against those of the graph of halves alone."""
    return graph.cross_check(graph.fixed_point(*_order_graph(spark, sf_dir)), graph.fixed_point(*_order_graph(spark, sf_dir, (2,))))


def values_json(spark, sf_dir):
    """The order graph's values written as JSON lines and read back."""
    path = scratch_path(spark, "values")
    write_values(graph.fixed_point(*_order_graph(spark, sf_dir)).select("node", "value"), path)
    return spark.read.schema("node bigint, value string").json(path).groupBy("value").agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))


def stored_steps(spark, sf_dir):
    """Order keys stored step by step, a step for each status, as sorted delta-encoded sets, and counted there."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    steps = Steps(spark, scratch_path(spark, "steps"), rows.select("key").schema)
    for k, status in enumerate("FOP"):
        steps.commit(k, rows.where(F.col("o_orderstatus") == status).select("key"))
    return steps.counts()


def converted_buckets(spark, sf_dir):
    """The line items' keys rewritten bucket by bucket, in a call that ends after five buckets and one that
    does the rest: state, rows and mismatches of each."""
    rows = saved(line_keys(spark, sf_dir).select("key", bucket(F.col("key"), 42).cast("int").alias("bucket")), "rows")
    path = scratch_path(spark, "converted")
    convert(rows, path, "bucket", at_once=3, most=5)
    out = convert(rows, path, "bucket")
    Folder(spark, path).delete("")
    discard(rows)
    return out


def ladder_text(spark, sf_dir):
    """Orders per number of line items as lines of text, and the ladder read back from them."""
    per = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().groupBy(F.col("count").cast("int").alias("step")).agg(F.count("*").alias("nodes"))
    path = scratch_path(spark, "ladder")
    write_ladder(per, path)
    return read_ladder(spark, path)


def delta_encode(spark, sf_dir):
    """Gaps of sorted order keys within range buckets, and their running sums, which decode them."""
    w = Window.partitionBy("bucket").orderBy("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey").distinct().withColumn("bucket", bucket(F.col("o_orderkey"), 10))
    gaps = rows.withColumn("gap", F.col("o_orderkey") - F.lag("o_orderkey", 1, 0).over(w))
    return gaps.select("bucket", "o_orderkey", "gap", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("decoded"))


def gap_histogram(spark, sf_dir):
    gaps = delta_encode(spark, sf_dir)
    size = F.lit(1)
    for k in range(1, 9):
        size = size + F.when(F.col("gap") >= 1 << (7 * k), 1).otherwise(0)
    return gaps.groupBy(size.cast("bigint").alias("varint_bytes")).agg(F.count("*").alias("n"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.sum("gap").alias("gap_sum"))


def key_density(spark, sf_dir):
    """Bytes a key that gaps in 7-bit groups would take, and the mean gap, by bucket."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + F.when(F.col("gap") >= 1 << (7 * k), 1).otherwise(0)
    per = delta_encode(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(size.cast("bigint")).alias("bytes"), F.sum("gap").alias("gap_sum"))
    return per.select("bucket", "n", "bytes", F.round(F.col("bytes") / F.col("n"), 6).alias("bytes_per_key"), F.round(F.col("gap_sum") / F.col("n"), 6).alias("mean_gap"))


def ascending_check(spark, sf_dir):
    gaps = delta_encode(spark, sf_dir)
    return gaps.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("gap") <= 0).alias("n_bad"), F.count_if(F.col("decoded") != F.col("o_orderkey")).alias("n_wrong"))


def range_buckets(spark, sf_dir):
    return line_keys(spark, sf_dir).groupBy(bucket(F.col("key")).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_distinct"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def visited_split(spark, sf_dir):
    """Customers with and without orders: semi-join, anti-join and probes that hit."""
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    out = c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("seen")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("fresh")))
    return out.groupBy("kind", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("key_sum"))


def merge_union(spark, sf_dir):
    """Distinct keys of several sorted streams, and in how many streams each stands."""
    o = _table(spark, sf_dir, "orders")
    streams = o.select(F.year("o_orderdate").alias("stream"), F.col("o_custkey").alias("key")).distinct()
    return streams.groupBy("key").agg(F.count("*").alias("n_streams")).groupBy("n_streams").agg(F.count("*").alias("n_keys"), F.sum("key").alias("key_sum"))


def set_equality(spark, sf_dir):
    """Keys lost and invented between the orders and their line items, both ways."""
    o, li = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    lost = o.exceptAll(li).agg(F.lit("lost").alias("kind"), F.count("*").alias("n"))
    return lost.unionByName(li.exceptAll(o).agg(F.lit("invented").alias("kind"), F.count("*").alias("n")))


def child_votes(spark, sf_dir):
    """Some and all over the children of a node: orders by whether some or all line items were returned."""
    per = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("some"), F.bool_and(F.col("l_returnflag") == "R").alias("every"))
    return per.groupBy("some", "every").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


def first_child(spark, sf_dir):
    """The first qualifying child of each node: the first line item with a discount over 5 %."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = _table(spark, sf_dir, "lineitem").where("l_discount > 0.05").withColumn("k", F.row_number().over(w)).where("k = 1")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


def ladder_by_month(spark, sf_dir):
    """New and cumulative orders and their growth, month by month."""
    new = _table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("new"))
    w = Window.orderBy("month")
    return new.select("month", "new", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"), F.round(F.col("new") / F.lag("new").over(w), 6).alias("growth"))


def repetition(spark, sf_dir):
    """How often an event of a user repeats its kind so far: the counter's histogram."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _table(spark, sf_dir, "events").withColumn("times", F.count("*").over(w))
    return rows.groupBy("event_type", "times").agg(F.count("*").alias("n"))


def overlap_factor(spark, sf_dir):
    """Parts bought in several regions: sum of the regions' distinct parts over all distinct parts."""
    n, c = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("n_regionkey", "l_partkey")
    out = reach.overlap(rows, "n_regionkey", ["l_partkey"])
    return out.select("groups", "total", "least", "most", F.col("distinct").alias("n_distinct"), F.round("factor", 6).alias("factor"))


def sample_distribution(spark, sf_dir):
    """Every 7th customer, 3,000 at most: number, element n / 2 of the sorted balances, mean and
    largest by segment. The limit is the sample's own and bounds what a segment's window sorts."""
    rows = _table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").orderBy("c_custkey").limit(3000)
    w = Window.partitionBy("c_mktsegment")
    ranked = rows.withColumns({"k": F.row_number().over(w.orderBy("c_acctbal", "c_custkey")) - 1, "n": F.count("*").over(w)})
    return ranked.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max(F.when(F.expr("k = n div 2"), F.col("c_acctbal"))).alias("median"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.max("c_acctbal").alias("largest"))


def hash_sample(spark, sf_dir):
    """A deterministic one-in-eight sample by hash, the share of hits in it and what it projects to."""
    o = _table(spark, sf_dir, "orders")
    hit = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    return o.where(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1).isin("0", "1")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 9).alias("rate"), F.round(1 / (1 - F.avg(hit) / 2), 9).alias("saving"))


def queries() -> dict:
    return {f.__name__: f for f in (
        key_round_trip, key_injectivity, class_histogram, class_top, class_successors, piece_counts, fen_round_trip, mirror_pairs, move_counts, paths_two_plies, reach_two_plies, endgame_values,
        uci_histogram, parsed_moves, clock_successors, fen_dump, mirror_presence, first_reach, path_tree, forced_divide, layered_counts, quiet_reach, dense_index, class_order, class_descent, class_space,
        subtree_overlap, quotient_ladder, labelled_sample, sql_move_counts, converted_buckets, divided_paths, resumed_walk, key_space_share, verified_store,
        bfs_customer_part, order_graph_values, graph_audit, graph_witness, graph_lines, witness_sizes, value_cross_check, values_json, stored_steps, ladder_text, delta_encode, gap_histogram, key_density, ascending_check, range_buckets, visited_split, merge_union, set_equality, child_votes, first_child, ladder_by_month,
        repetition, overlap_factor, sample_distribution, hash_sample)}


# -- SQL ----------------------------------------------------------------------------

_CLASSES = """
sides AS (SELECT CAST(i AS BIGINT) AS i, i // 6 AS s, i % 6 AS t FROM range(48) r(i)),
counts AS (SELECT i, CAST(t = 1 AS INT) AS p, (s >> 1) % 2 + CAST(t = 5 AS INT) AS n, s % 2 + CAST(t = 4 AS INT) AS b, (s >> 2) % 2 + CAST(t = 3 AS INT) AS r, CAST(t = 2 AS INT) AS q,
    NOT ((t = 3 AND (s >> 2) % 2 = 0) OR (t = 4 AND s % 2 = 0) OR (t = 5 AND (s >> 1) % 2 = 0)) AS ok FROM sides),
named AS (SELECT *, 'K' || repeat('B', b) || repeat('N', n) || repeat('P', p) || repeat('Q', q) || repeat('R', r) AS name, p + n + b + r + q AS size,
    (CASE WHEN n = 2 THEN 2 ELSE 1 END) * (CASE WHEN b = 2 THEN 2 ELSE 1 END) * (CASE WHEN r = 2 THEN 2 ELSE 1 END) AS twins FROM counts),
cls AS (SELECT CAST(w.i * 48 + b.i AS INT) AS class_id, w.name || 'v' || b.name AS name, w.ok AND b.ok AS canonical, w.i AS wi, b.i AS bi,
    CAST(factorial(20) // factorial(CAST(18 - w.size - b.size AS INT)) // (w.twins * b.twins) AS BIGINT) AS placements FROM named w, named b),
bounds AS (SELECT *, CAST(coalesce(sum(placements) OVER (ORDER BY class_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM cls),
keyed AS (SELECT """ + _KEY + """ AS key FROM lineitem),
k AS (SELECT key, b.* FROM keyed JOIN bounds b ON key // 8 >= base AND key // 8 < base + placements)
"""
_POSITIONS = f"""
order_keys AS (SELECT o_orderkey, key, class_id FROM (SELECT o_orderkey, {_ORDER_KEY} AS key FROM orders) JOIN bounds ON key // 8 >= base AND key // 8 < base + placements WHERE canonical),
{rules.unrank("order_boards", "order_keys")},
{rules.STEPS},
all_places AS (SELECT o_orderkey AS id, board, key % 2 = 0 AS wtm, CAST(key % 8 // 2 AS INT) AS castling FROM order_keys JOIN order_boards USING (key)),
passive_kings AS (SELECT id, board, instr(board, CASE WHEN wtm THEN 'k' ELSE 'K' END) - 1 AS sq, wtm AS by_white FROM all_places), {rules.checks("takeable", "passive_kings")},
places AS (SELECT * FROM all_places ANTI JOIN takeable USING (id))"""
#: The positions within two plies of the orders' ones: layer0, layer1 and layer2 (id, board, wtm, castling), distinct each; ply1 and ply2 are the moves.
_LAYERS = f"""
layer0 AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT board, wtm, castling FROM places)), {rules.moves("ply1", "layer0")},
layer1 AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT board, wtm, castling FROM ply1)), {rules.moves("ply2", "layer1")},
layer2 AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT board, wtm, castling FROM ply2)),
first_layer AS (SELECT board, wtm, castling, min(step) AS step FROM (SELECT board, wtm, castling, 0 AS step FROM layer0 UNION ALL SELECT board, wtm, castling, 1 FROM layer1 UNION ALL SELECT board, wtm, castling, 2 FROM layer2) GROUP BY ALL)"""
_FLIP = f"{rules.mirror('board')} AS board, NOT wtm AS wtm, CAST((castling & 1) * 2 + castling // 2 AS INT) AS castling"


def _order_graph_sql(name: str = "", steps: tuple = (2, 3)) -> str:
    children = " UNION ".join(f"SELECT o_orderkey AS parent, o_orderkey // {k} AS child FROM orders" for k in steps)
    return f"""
order_edges{name} AS (SELECT parent, child FROM ({children}) WHERE child <> parent AND parent % 5 <> 0 AND child IN (SELECT o_orderkey FROM orders)),
order_ends{name} AS (SELECT o_orderkey AS node, CASE WHEN o_orderstatus = 'F' THEN 'LOSS' ELSE 'DRAW' END AS value FROM orders WHERE o_orderkey NOT IN (SELECT parent FROM order_edges{name})),
{rules.fixed_point(f"order_edges{name}", f"order_ends{name}").replace("settled_values", f"settled_values{name}").replace("degrees", f"degrees{name}")},
order_values{name} AS (
    SELECT * FROM settled_values{name} UNION ALL
    SELECT node, 'DRAW', NULL FROM (SELECT parent AS node FROM order_edges{name} UNION SELECT node FROM order_ends{name}) n ANTI JOIN settled_values{name} s USING (node))"""


def _audit_sql(values: str) -> str:
    return f"""SELECT v.value, v.node FROM (SELECT parent, bool_or(c.value = 'LOSS') AS some_loss, bool_and(c.value = 'WIN') AS all_win FROM order_edges JOIN {values} c ON c.node = child GROUP BY parent) e
    JOIN {values} v ON v.node = e.parent WHERE CASE v.value WHEN 'WIN' THEN NOT some_loss WHEN 'LOSS' THEN NOT all_win ELSE some_loss OR all_win END"""


_ENDGAME = f"""{rules.STEPS},
slots AS (
    SELECT DISTINCT board, wtm FROM (
        SELECT list_reduce(list_transform(range(20), lambda s: CASE s WHEN a.i THEN 'K' WHEN b.i THEN 'k' WHEN c.i THEN 'R' ELSE '.' END), lambda x, y: x || y) AS board FROM range(20) a(i), range(20) b(i), range(-1, 20) c(i) WHERE a.i <> b.i AND c.i NOT IN (a.i, b.i)), (VALUES (true), (false)) w(wtm)),
passive AS (SELECT board || wtm AS id, board, instr(board, CASE WHEN wtm THEN 'k' ELSE 'K' END) - 1 AS sq, wtm AS by_white FROM slots),
{rules.checks("hanging", "passive")},
nodes AS (SELECT board || wtm AS id, board, wtm, 0 AS castling FROM slots WHERE board || wtm NOT IN (SELECT id FROM hanging)),
{rules.moves("step", "nodes")},
game_edges AS (SELECT DISTINCT id AS parent, board || wtm AS child FROM step),
active AS (SELECT id, board, instr(board, CASE WHEN wtm THEN 'K' ELSE 'k' END) - 1 AS sq, NOT wtm AS by_white FROM nodes),
{rules.checks("in_check", "active")},
game_ends AS (SELECT id AS node, CASE WHEN id IN (SELECT id FROM in_check) THEN 'LOSS' ELSE 'DRAW' END AS value FROM nodes WHERE id NOT IN (SELECT parent FROM game_edges)),
{rules.fixed_point("game_edges", "game_ends")},
digits AS (SELECT o_orderstatus, i % 2 = 0 AS wtm, i // 2 % 20 AS a, i // 40 % 20 AS b, i // 800 % 20 AS c FROM (SELECT o_orderstatus, o_orderkey * 2654435 % 16000 AS i FROM orders)),
asked AS (SELECT o_orderstatus, CASE WHEN a <> b AND a <> c AND b <> c THEN list_reduce(list_transform(range(20), lambda s: CASE s WHEN a THEN 'K' WHEN b THEN 'k' WHEN c THEN 'R' ELSE '.' END), lambda x, y: x || y) || wtm END AS id FROM digits)"""
_GAPS = """
rows AS (SELECT DISTINCT o_orderkey, o_orderkey >> 10 AS bucket FROM orders),
gaps AS (SELECT bucket, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY bucket ORDER BY o_orderkey) AS gap FROM rows),
sized AS (SELECT *, 1 + """ + " + ".join(f"CAST(gap >= {1 << (7 * k)} AS INT)" for k in range(1, 9)) + """ AS v FROM gaps),
deltas AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY bucket ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS decoded FROM gaps)
"""


def oracle_sql() -> dict[str, str]:
    count = "CAST(coalesce(sum(CASE WHEN canonical THEN 1 ELSE 0 END), 0) AS BIGINT)"
    pieces = ", ".join(f"CAST(sum({side}.{p}) AS BIGINT) AS n_{c}{p}" for side, c in (("w", "w"), ("b", "b")) for p in "pnbrq")
    game = f"WITH RECURSIVE {_CLASSES}, {_POSITIONS}"
    two = f"{game}, {_LAYERS}"
    order_graph = f"WITH RECURSIVE {_order_graph_sql()}"
    seen = f"WITH {_CLASSES}, hist AS (SELECT class_id, count(*) AS n FROM k WHERE canonical GROUP BY 1), sized AS (SELECT h.*, c.name, c.wi, c.bi, c.placements, CAST(w.size + b.size AS INT) AS piece_count, CAST(w.size + b.size - w.p - b.p AS INT) AS nonpawn_count FROM hist h JOIN cls c USING (class_id) JOIN named w ON w.i = wi JOIN named b ON b.i = bi)"
    side_steps = """, side_steps AS (
    SELECT c.i AS was, d.i AS now FROM counts c, (VALUES (-1, 0, 0, 0, 0), (0, -1, 0, 0, 0), (0, 0, -1, 0, 0), (0, 0, 0, -1, 0), (0, 0, 0, 0, -1), (-1, 1, 0, 0, 0), (-1, 0, 1, 0, 0), (-1, 0, 0, 1, 0), (-1, 0, 0, 0, 1)) s(dp, dn, db, dr, dq)
    JOIN counts d ON d.ok AND d.p = c.p + dp AND d.n = c.n + dn AND d.b = c.b + db AND d.r = c.r + dr AND d.q = c.q + dq),
class_steps AS (SELECT DISTINCT class_id, n, piece_count, nonpawn_count, CAST(successor AS INT) AS successor FROM (
    SELECT s.*, now * 48 + bi AS successor FROM sized s JOIN side_steps ON was = wi UNION ALL SELECT s.*, wi * 48 + now FROM sized s JOIN side_steps ON was = bi))"""
    squares = "substr('abcd', CAST({0} % 4 + 1 AS BIGINT), 1) || ({0} // 4 + 1)"
    move_counts = f"""{game}, {rules.moves("m", "places")}, kings AS (SELECT id, board, instr(board, CASE WHEN wtm THEN 'K' ELSE 'k' END) - 1 AS sq, NOT wtm AS by_white FROM places), {rules.checks("c", "kings")},
per AS (SELECT p.id, p.wtm, p.id IN (SELECT id FROM c) AS "check", count(m.id) AS n, count(*) FILTER (captured <> '.') AS captures, count(*) FILTER (promo <> '') AS promotions FROM places p LEFT JOIN m ON m.id = p.id GROUP BY ALL)
SELECT wtm, "check", CASE WHEN n > 0 THEN 'moving' WHEN "check" THEN 'mate' ELSE 'stalemate' END AS state, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_moves, CAST(sum(captures) AS BIGINT) AS n_captures, CAST(sum(promotions) AS BIGINT) AS n_promotions FROM per GROUP BY 1, 2, 3"""
    fen = "replace(replace(replace(replace(replace(shown, chr(10), '/'), '....', '4'), '...', '3'), '..', '2'), '.', '1')"
    shown = " || chr(10) || ".join(f"substr(board, {17 - 4 * k}, 4)" for k in range(5))
    flipped = f"{rules.mirror('board')} AS fb, NOT wtm AS fw, CAST((castling & 1) * 2 + castling // 2 AS INT) AS fc"
    return {
        "sql_move_counts": move_counts,
        "divided_paths": f"{game}, {rules.moves('m', 'places')}, next AS (SELECT row_number() OVER () AS id, uci, board, wtm, castling FROM m), {rules.moves('mm', 'next')} SELECT next.uci, count(mm.id) AS nodes FROM next LEFT JOIN mm USING (id) GROUP BY 1",
        "resumed_walk": f"{two}, new AS (SELECT step, count(*) AS new FROM first_layer GROUP BY 1) SELECT step, new, CAST(sum(new) OVER (ORDER BY step) AS BIGINT) AS cumulative, 0 AS left_over FROM new",
        "key_space_share": f"WITH {_CLASSES}, s AS (SELECT CAST(sum(placements) * 8 AS BIGINT) AS key_space FROM cls), n AS (SELECT count(DISTINCT key) AS n_positions FROM k WHERE canonical) SELECT n_positions, key_space, round(1000000 * n_positions / key_space, 9) AS share FROM n, s",
        "verified_store": f"SELECT key >> 42 AS bucket, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM (SELECT DISTINCT {_KEY} AS key FROM lineitem) GROUP BY 1",
        "subtree_overlap": f"""{two}, g0 AS (SELECT DISTINCT uci, board, wtm, castling FROM ply1),
pairs AS (SELECT * FROM g0 UNION SELECT g0.uci, p.board, p.wtm, p.castling FROM g0 JOIN layer1 l USING (board, wtm, castling) JOIN ply2 p ON p.id = l.id),
sizes AS (SELECT uci, count(*) AS n FROM pairs GROUP BY 1), every AS (SELECT count(*) AS d FROM (SELECT DISTINCT board, wtm, castling FROM pairs))
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, max(d) AS n_distinct, round(sum(n) / max(d), 6) AS factor, min(n) AS least, max(n) AS most, round(max(n) / min(n), 6) AS imbalance FROM sizes, every""",
        "quotient_ladder": f"""{game}, closed0 AS (SELECT row_number() OVER () AS id, * FROM (SELECT board, wtm, castling FROM places UNION SELECT {_FLIP} FROM places)), {rules.moves("cply1", "closed0")},
closed1 AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT board, wtm, castling FROM cply1)), {rules.moves("cply2", "closed1")},
first_met AS (SELECT board, wtm, castling, min(step) AS step FROM (SELECT board, wtm, castling, 0 AS step FROM closed0 UNION ALL SELECT board, wtm, castling, 1 FROM closed1 UNION ALL SELECT board, wtm, castling, 2 FROM cply2) GROUP BY ALL),
new AS (SELECT step, count(DISTINCT least(board || wtm || castling, fb || fw || fc)) AS pairs, count(*) AS positions FROM (SELECT *, {flipped} FROM first_met) GROUP BY 1)
SELECT step, pairs, positions, CAST(sum(pairs) OVER (ORDER BY step) AS BIGINT) AS all_pairs, CAST(sum(positions) OVER (ORDER BY step) AS BIGINT) AS all_positions FROM new""",
        "labelled_sample": f"""WITH RECURSIVE {_ENDGAME}, own AS (SELECT o_orderkey, i % 2 = 0 AS wtm, i // 2 % 20 AS a, i // 40 % 20 AS b, i // 800 % 20 AS c FROM (SELECT o_orderkey, o_orderkey * 2654435 % 16000 AS i FROM orders)),
sought AS (SELECT o_orderkey, wtm, list_reduce(list_transform(range(20), lambda s: CASE s WHEN a THEN 'K' WHEN b THEN 'k' WHEN c THEN 'R' ELSE '.' END), lambda x, y: x || y) AS board FROM own WHERE a <> b AND a <> c AND b <> c),
valued AS (SELECT o_orderkey, {shown.replace("board", "s.board")} AS shown, s.wtm, coalesce(v.value, 'DRAW') AS value FROM sought s JOIN nodes n ON n.id = s.board || s.wtm LEFT JOIN settled_values v ON v.node = n.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM valued)
SELECT {fen} || CASE WHEN wtm THEN ' w ' ELSE ' b ' END || '- - 0 1 = ' || value AS line FROM ranked WHERE k <= 20""",
        "witness_sizes": f"""{order_graph},
need AS (SELECT parent, min(child) AS child, true AS ours FROM order_edges JOIN order_values p ON p.node = parent JOIN order_values c ON c.node = child WHERE (p.value = 'WIN' AND c.value = 'LOSS') OR (p.value = 'DRAW' AND c.value = 'DRAW') GROUP BY parent
         UNION ALL SELECT parent, child, false FROM order_edges),
walk AS (SELECT node AS root, node, true AS ours FROM order_values WHERE node % 101 = 0 AND value IN ('WIN', 'DRAW') UNION SELECT root, child, NOT walk.ours FROM walk JOIN need ON parent = node AND need.ours = walk.ours),
sizes AS (SELECT root, count(DISTINCT node) AS size FROM walk GROUP BY 1),
r AS (SELECT value, size, row_number() OVER (PARTITION BY value ORDER BY size) - 1 AS k, count(*) OVER (PARTITION BY value) AS n FROM sizes JOIN order_values ON node = root WHERE size > 1)
SELECT value, max(n) AS n, max(CASE WHEN k = n // 2 THEN size END) AS median, round(avg(size), 4) AS mean, max(size) AS largest, round(100 * max(size) / (SELECT count(*) FROM order_values), 6) AS share FROM r GROUP BY 1""",
        "converted_buckets": f"WITH k AS (SELECT CAST(({_KEY}) >> 42 AS INT) AS bucket FROM lineitem), b AS (SELECT bucket, count(*) AS n_rows FROM k GROUP BY 1) SELECT bucket, CASE WHEN row_number() OVER (ORDER BY bucket) <= 5 THEN 'converted' ELSE 'new' END AS state, n_rows, CAST(0 AS BIGINT) AS n_wrong FROM b",
        "class_successors": f"{seen}{side_steps} SELECT successor AS class_id, count(*) AS n_above, CAST(sum(n) AS BIGINT) AS n_positions FROM class_steps GROUP BY 1",
        "class_order": f"{seen} SELECT class_id, name, piece_count, nonpawn_count, n, CAST(row_number() OVER (ORDER BY piece_count, nonpawn_count DESC, class_id) AS INT) AS place, class_id AS parsed FROM sized",
        "class_descent": f"{seen}{side_steps} SELECT s.piece_count, count(*) AS n_edges, count(*) FILTER (NOT (b.piece_count < s.piece_count OR (b.piece_count = s.piece_count AND b.nonpawn_count > s.nonpawn_count))) AS n_wrong FROM class_steps s JOIN sized b ON b.class_id = successor GROUP BY 1",
        "class_space": f"{seen} SELECT piece_count, count(*) AS n_classes, CAST(sum(placements) AS BIGINT) AS placements, CAST(sum(n) AS BIGINT) AS n_positions, round(log2(CAST(sum(placements) AS DOUBLE)), 6) AS bits FROM sized GROUP BY 1",
        "mirror_pairs": f"""WITH RECURSIVE {_CLASSES}, good AS (SELECT DISTINCT key, class_id, CAST(bi * 48 + wi AS INT) AS other FROM k WHERE canonical), {rules.unrank("line_boards", "good")},
flipped AS (SELECT key AS id, {rules.mirror("board")} AS board, other AS class_id FROM good JOIN line_boards USING (key)), {rules.rank("ranked", "flipped")},
pairs AS (SELECT g.key, other, (b.base + rank_) * 8 + (key % 8 // 2 % 2 * 2 + key % 8 // 4) * 2 + 1 - key % 2 AS mirrored FROM good g JOIN ranked r ON r.id = g.key JOIN bounds b ON b.class_id = other)
SELECT k.class_id, max(other) AS mirror_class, count(*) AS n, count(*) FILTER (key <= mirrored) AS n_canonical FROM k JOIN pairs USING (key) WHERE canonical GROUP BY 1""",
        "move_counts": move_counts,
        "uci_histogram": f"{game}, {rules.moves('m', 'places')} SELECT uci, count(*) AS n, count(*) FILTER (captured <> '.') AS n_captures FROM m GROUP BY 1",
        "parsed_moves": f"""{game}, {rules.moves("m", "places")},
said AS (SELECT id, board, a, b, {squares.format("a")} || {squares.format("b")} AS uci FROM (SELECT p.*, o_custkey % 20 AS a, o_orderkey // 3 % 20 AS b FROM places p JOIN orders ON o_orderkey = id)),
read AS (SELECT CASE WHEN substr(board, 1, 1) = 'K' AND a = 0 AND b = 2 THEN 1 WHEN substr(board, 17, 1) = 'k' AND a = 16 AND b = 18 THEN 2 ELSE 0 END AS castle, EXISTS (SELECT 1 FROM m WHERE m.id = said.id AND m.uci = said.uci) AS legal, a, b FROM said)
SELECT castle, legal, count(*) AS n, CAST(sum(a) AS BIGINT) AS from_sum, CAST(sum(b) AS BIGINT) AS to_sum FROM read GROUP BY 1, 2""",
        "clock_successors": f"""{game}, {rules.moves("m", "places")},
x AS (SELECT wtm, CASE WHEN upper(piece) = 'P' OR captured <> '.' THEN 0 ELSE id % 50 + 1 END AS h, id % 90 + 1 + CAST(wtm AS INT) AS f FROM m)
SELECT wtm, count(*) AS n, CAST(sum(h) AS BIGINT) AS halfmoves, CAST(sum(f) AS BIGINT) AS fullmoves, count(*) FILTER (h = 0) AS n_reset FROM x GROUP BY 1""",
        "fen_dump": f"""{game}, {rules.moves("m", "places")}, per AS (SELECT id, count(*) AS n FROM m GROUP BY 1),
drawn AS (SELECT *, {" || chr(10) || ".join(f"substr(board, {17 - 4 * k}, 4)" for k in range(5))} AS shown FROM places)
SELECT d.id AS o_orderkey, replace(replace(replace(replace(replace(shown, chr(10), '/'), '....', '4'), '...', '3'), '..', '2'), '.', '1') || CASE WHEN wtm THEN ' w ' ELSE ' b ' END || (['-', 'D', 'd', 'Dd'])[castling + 1] || ' - 0 1' AS fen, shown, coalesce(n, 0) AS n_moves FROM drawn d LEFT JOIN per USING (id)""",
        "paths_two_plies": f"{game}, {rules.moves('m', 'places')}, next AS (SELECT row_number() OVER () AS id, id AS root, board, wtm, castling FROM m), {rules.moves('mm', 'next')} SELECT root AS o_orderkey, count(*) AS nodes FROM mm JOIN next USING (id) GROUP BY 1",
        "path_tree": f"{game}, {rules.moves('m', 'places')}, next AS (SELECT row_number() OVER () AS id, uci AS first_move, board, wtm, castling FROM m), {rules.moves('mm', 'next')} SELECT first_move, count(*) AS n_paths, count(DISTINCT (mm.board, mm.wtm, mm.castling)) AS n_ends FROM mm JOIN next USING (id) GROUP BY 1",
        "forced_divide": f"{game}, {rules.moves('m', 'places')}, next AS (SELECT id, arg_min(board, uci) AS board, arg_min(wtm, uci) AS wtm, arg_min(castling, uci) AS castling FROM m GROUP BY 1), {rules.moves('mm', 'next')} SELECT uci, count(*) AS nodes FROM mm GROUP BY 1",
        "layered_counts": f"{two} SELECT 0 AS step, count(*) AS positions FROM layer0 UNION ALL SELECT 1, count(*) FROM layer1 UNION ALL SELECT 2, count(*) FROM layer2",
        "reach_two_plies": f"{two}, new AS (SELECT step, count(*) AS new FROM first_layer GROUP BY 1) SELECT step, new, CAST(sum(new) OVER (ORDER BY step) AS BIGINT) AS cumulative, round(new / lag(new) OVER (ORDER BY step), 6) AS growth FROM new",
        "quiet_reach": f"""{game}, layer0 AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT board, wtm, castling FROM places)), {rules.moves("ply1", "layer0")},
layer1 AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT board, wtm, castling FROM ply1 WHERE captured = '.' AND promo = '')), {rules.moves("ply2", "layer1")},
every AS (SELECT board, wtm, castling, 0 AS step FROM layer0 UNION ALL SELECT board, wtm, castling, 1 FROM layer1 UNION ALL SELECT board, wtm, castling, 2 FROM ply2 WHERE captured = '.' AND promo = ''),
new AS (SELECT step, count(*) AS new FROM (SELECT board, wtm, castling, min(step) AS step FROM every GROUP BY ALL) GROUP BY 1)
SELECT step, new, CAST(sum(new) OVER (ORDER BY step) AS BIGINT) AS cumulative FROM new""",
        "mirror_presence": f"""{two}, near AS (SELECT * FROM first_layer WHERE step < 2 AND NOT (step = 2)), flipped AS (SELECT step, {_FLIP} FROM near),
hits AS (SELECT f.step, n.step IS NOT NULL AS hit FROM flipped f LEFT JOIN near n USING (board, wtm, castling))
SELECT step, count(*) AS n, count(*) FILTER (hit) AS n_mirrored, round(avg(CAST(hit AS DOUBLE)), 9) AS rate, round(1 / (1 - avg(CAST(hit AS DOUBLE)) / 2), 9) AS saving FROM hits GROUP BY 1""",
        "first_reach": f"{two}, flipped AS (SELECT DISTINCT {_FLIP} FROM places) SELECT coalesce(l.step, -1) AS step, count(*) AS n FROM flipped LEFT JOIN first_layer l USING (board, wtm, castling) GROUP BY 1",
        "dense_index": """WITH r AS (SELECT (l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 16000 AS i FROM lineitem), d AS (SELECT i, i // 2 % 20 AS a, i // 40 % 20 AS b, i // 800 % 20 AS c FROM r),
x AS (SELECT CASE WHEN a <> b AND a <> c AND b <> c THEN i END AS i, CASE WHEN a <> b AND a <> c AND b <> c THEN CAST(c + 1 AS INT) END AS rook_at FROM d)
SELECT coalesce(rook_at, 0) AS rook_at, count(*) AS n, count(i) AS n_same, CAST(coalesce(sum(i), -1) AS BIGINT) AS index_sum FROM x GROUP BY 1""",
        "endgame_values": f"""WITH RECURSIVE {_ENDGAME}
SELECT o_orderstatus, CASE WHEN n.id IS NULL THEN 'ILLEGAL' ELSE coalesce(v.value, 'DRAW') END AS value, count(*) AS n, coalesce(max(round), -1) AS max_round FROM asked a LEFT JOIN nodes n ON n.id = a.id LEFT JOIN settled_values v ON v.node = a.id GROUP BY 1, 2""",
        "order_graph_values": f"{order_graph} SELECT value, coalesce(round, -1) AS round, count(*) AS n FROM order_values GROUP BY 1, 2",
        "graph_audit": f"""{order_graph}, bent AS (SELECT node, CASE WHEN node % 11 = 0 THEN 'DRAW' ELSE value END AS value FROM order_values),
wrong AS (SELECT 'true' AS kind, * FROM ({_audit_sql("order_values")}) UNION ALL SELECT 'bent', * FROM ({_audit_sql("bent")}))
SELECT kind, value, count(*) AS n, CAST(sum(node) AS BIGINT) AS node_sum FROM wrong GROUP BY 1, 2""",
        "graph_witness": f"""{order_graph},
proof AS (SELECT parent, min(child) AS child FROM order_edges JOIN order_values p ON p.node = parent JOIN order_values c ON c.node = child WHERE p.value = 'WIN' AND c.value = 'LOSS' GROUP BY parent
          UNION SELECT parent, child FROM order_edges JOIN order_values ON node = parent WHERE value = 'LOSS'),
walk AS (SELECT node, 0 AS step FROM order_values WHERE value = 'WIN' AND round = (SELECT max(round) FROM order_values WHERE value = 'WIN') UNION SELECT child, step + 1 FROM walk JOIN proof ON parent = node)
SELECT step, count(*) AS n, CAST(sum(node) AS BIGINT) AS node_sum FROM (SELECT node, min(step) AS step FROM walk GROUP BY node) GROUP BY 1""",
        "graph_lines": f"""{order_graph},
best AS (SELECT parent, arg_min(child, (CASE WHEN p.value = 'WIN' THEN c.round ELSE -c.round END, child)) AS child FROM order_edges JOIN order_values p ON p.node = parent JOIN order_values c ON c.node = child
         WHERE p.round > 0 AND ((p.value = 'WIN' AND c.value = 'LOSS') OR (p.value = 'LOSS' AND c.value = 'WIN')) GROUP BY parent),
walk AS (SELECT node AS root, 0 AS step, node FROM order_values WHERE round > 0 UNION ALL SELECT root, step + 1, child FROM walk JOIN best ON parent = node),
ends AS (SELECT root, max(step) AS length, arg_max(node, step) AS last FROM walk GROUP BY 1)
SELECT length, count(*) AS n, CAST(sum(last) AS BIGINT) AS last_sum FROM ends GROUP BY 1""",
        "value_cross_check": f"""{order_graph}, {_order_graph_sql("_2", (2,))}
SELECT a.value, b.value AS other_value, count(*) AS n, a.value IS NOT DISTINCT FROM b.value AS same FROM order_values a FULL JOIN order_values_2 b USING (node) GROUP BY a.value, b.value""",
        "values_json": f"{order_graph} SELECT value, count(*) AS n, CAST(sum(node) AS BIGINT) AS node_sum FROM order_values GROUP BY 1",
        "stored_steps": "WITH s AS (SELECT CAST(instr('FOP', o_orderstatus) - 1 AS INT) AS step, count(*) AS new FROM orders GROUP BY 1) SELECT step, new, CAST(sum(new) OVER (ORDER BY step) AS BIGINT) AS cumulative FROM s",
        "ladder_text": "WITH p AS (SELECT CAST(count(*) AS INT) AS step FROM lineitem GROUP BY l_orderkey) SELECT step, count(*) AS nodes FROM p GROUP BY 1",
        "key_density": f"WITH {_GAPS} SELECT bucket, count(*) AS n, CAST(sum(v) AS BIGINT) AS bytes, round(sum(v) / count(*), 6) AS bytes_per_key, round(sum(gap) / count(*), 6) AS mean_gap FROM sized GROUP BY 1",
        "hash_sample": "WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) IN ('0', '1')) SELECT count(*) AS n, round(avg(hit), 9) AS rate, round(1 / (1 - avg(hit) / 2), 9) AS saving FROM s",
        "key_round_trip": f"WITH {_CLASSES} SELECT class_id, count(*) AS n, {count} AS n_valid, {count} AS n_same, coalesce(max(CASE WHEN canonical THEN key END), -1) AS max_key FROM k GROUP BY class_id",
        "key_injectivity": f"WITH {_CLASSES} SELECT count(DISTINCT key) AS n_keys, count(DISTINCT key) AS n_positions, max(key) AS max_key, CAST(sum(key) AS DOUBLE) AS key_sum FROM k WHERE canonical",
        "class_histogram": f"WITH {_CLASSES} SELECT class_id, name, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM k WHERE canonical GROUP BY class_id, name",
        "class_top": f"WITH {_CLASSES} SELECT class_id, name, count(*) AS n FROM k WHERE canonical GROUP BY class_id, name ORDER BY n DESC, class_id LIMIT 8",
        "piece_counts": f"WITH {_CLASSES} SELECT class_id, count(*) AS n, count(*) AS n_wk, count(*) AS n_bk, {pieces} FROM k JOIN counts w ON w.i = wi JOIN counts b ON b.i = bi WHERE canonical GROUP BY class_id",
        "fen_round_trip": f"WITH {_CLASSES} SELECT CAST((key % 8) // 2 AS INT) AS castling, key % 2 = 0 AS wtm, count(*) AS n, count(*) AS n_same FROM k WHERE canonical GROUP BY 1, 2",
        "bfs_customer_part": """
WITH RECURSIVE pairs AS (SELECT DISTINCT o_custkey * 2 AS c, l_partkey * 2 + 1 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT c AS a, p AS b FROM pairs UNION ALL SELECT p, c FROM pairs),
r(node, step) USING KEY (node) AS (SELECT CAST(2 AS BIGINT), 0 UNION SELECT DISTINCT e.b, s.step + 1 FROM r s JOIN e ON s.node = e.a WHERE NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.node = e.b))
SELECT step, count(*) AS new, CAST(sum(node) AS BIGINT) AS node_sum FROM r GROUP BY step""",
        "delta_encode": f"WITH {_GAPS} SELECT bucket, o_orderkey, gap, decoded FROM deltas",
        "gap_histogram": f"""WITH {_GAPS}, h AS (SELECT gap, 1 + {' + '.join(f'CAST(gap >= {1 << (7 * k)} AS INT)' for k in range(1, 9))} AS v FROM gaps)
SELECT CAST(v AS BIGINT) AS varint_bytes, count(*) AS n, min(gap) AS min_gap, max(gap) AS max_gap, CAST(sum(gap) AS BIGINT) AS gap_sum FROM h GROUP BY v""",
        "ascending_check": f"WITH {_GAPS} SELECT bucket, count(*) AS n, count(*) FILTER (gap <= 0) AS n_bad, count(*) FILTER (decoded <> o_orderkey) AS n_wrong FROM deltas GROUP BY bucket",
        "range_buckets": f"WITH keyed AS (SELECT {_KEY} AS key FROM lineitem) SELECT key >> 39 AS bucket, count(*) AS n, count(DISTINCT key) AS n_distinct, min(key) AS min_key, max(key) AS max_key FROM keyed GROUP BY 1",
        "visited_split": "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'seen' ELSE 'fresh' END AS kind, c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer GROUP BY 1, 2",
        "merge_union": "WITH s AS (SELECT o_custkey AS key, count(DISTINCT year(o_orderdate)) AS n_streams FROM orders GROUP BY 1) SELECT n_streams, count(*) AS n_keys, CAST(sum(key) AS BIGINT) AS key_sum FROM s GROUP BY 1",
        "set_equality": "SELECT 'lost' AS kind, count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT 'invented', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)",
        "child_votes": "WITH p AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS some, bool_and(l_returnflag = 'R') AS every FROM lineitem GROUP BY 1) SELECT \"some\", \"every\", count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM p GROUP BY 1, 2".replace("AS some", 'AS "some"').replace("AS every", 'AS "every"'),
        "first_child": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_discount > 0.05) WHERE k = 1",
        "ladder_by_month": "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS new FROM orders GROUP BY 1) SELECT month, new, CAST(sum(new) OVER (ORDER BY month) AS BIGINT) AS cumulative, round(new / lag(new) OVER (ORDER BY month), 6) AS growth FROM m",
        "repetition": "SELECT event_type, times, count(*) AS n FROM (SELECT event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS times FROM events) GROUP BY 1, 2",
        "overlap_factor": """WITH x AS (SELECT n_regionkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT n_regionkey, count(DISTINCT l_partkey) AS n FROM x GROUP BY 1)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, min(n) AS least, max(n) AS most, (SELECT count(DISTINCT l_partkey) FROM x) AS n_distinct, round(sum(n) / (SELECT count(DISTINCT l_partkey) FROM x), 6) AS factor FROM g""",
        "sample_distribution": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM (SELECT * FROM customer WHERE c_custkey % 7 = 0 ORDER BY c_custkey LIMIT 3000))
SELECT c_mktsegment, count(*) AS n, max(CASE WHEN k = n // 2 THEN c_acctbal END) AS median, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS largest FROM r GROUP BY 1""",
    }
