"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Vectors are cut into blocks of rows. A block carries, for each component, the list of its rows
in the order of that component. Each block of queries meets each block of rows; there the lists
are read from their good ends (the largest values where the query's component is positive, the
smallest where it is negative), all to the same depth. What has been read gives each row a lower
and an upper bound of its score: an unread component is no better than where its list has been
read to, and no worse than the list's other end. Reading goes on, each time twice as deep, until
few rows can still reach the k-th best lower bound; a query without more is done, and the scores
of those rows are resolved. A task keeps the k-th best score of each query it has met, so later
blocks stop earlier. The best k of each block are merged by a window that keeps k rows a task.

Components are turned into ``floor(scale * x)``. Bounds and scores are integers: in doubles
where no partial sum can pass 2^53, in Python integers otherwise; a score beyond 64 bits raises.

Defined cases: a vector that is null, or holds null, a non-finite number or one that isn't
finite times ``scale``, takes no part, nor does one without an id; vectors of another length than
the query's are no candidates; an empty vector scores 0 with the others that are empty; rows of
the query's own id are no candidates for it; repeated rows count each as candidates, and once as
queries; several vectors under one id that asks are queries apart; ties go to the smaller id;
a query without candidates has no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import n_parts, saved, table

SCALE = 256
TOP = 5
#: Rows of a block of candidates, and of queries.
BLOCK_ROWS, QUERY_ROWS = 2048, 512
#: Values of all the blocks that a task is filling, at most.
_VALUES = 1 << 22
#: The lists are read to this share of their length first.
_FIRST_DEPTH = 8
#: So many rows may be left when a query's reading stops; their scores are resolved.
_LEFT = 64
_BLOCK = "block bigint, dims int, ids binary, numbers binary, lists binary"


def _good(ids: pa.Array, vectors: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids, components times ``scale``, floored)} of the rows that take part."""
    if not len(ids):
        return {}
    starts = vectors.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(vectors.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = (bad[starts[1:]] == bad[starts[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    sizes, number = np.diff(starts), ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == n))
        out[int(n)] = (number[at], x[starts[at][:, None] + np.arange(n)])
    return out


def _blocks(most: int, scale: float, with_lists: bool):
    """Blocks of at most ``most`` rows of one length, rows by id, with the sorted lists."""
    def run(batches):
        parts, filling, made = {}, 0, 0
        where = TaskContext.get().partitionId() << 32

        def block(n):
            nonlocal made, filling
            ids, x = (np.concatenate(p) for p in zip(*parts.pop(n)))
            filling -= x.size
            for i in range(0, len(ids), most):
                own = np.argsort(ids[i: i + most], kind="stable") + i
                v = x[own]
                lists = np.argsort(v, axis=0, kind="stable").T.astype(np.uint16) if with_lists else np.zeros(0, np.uint16)
                small = v if v.size and np.abs(v).max() >= 1 << 15 else v.astype(np.int16)
                made += 1
                yield pa.RecordBatch.from_pylist([{"block": where + made - 1, "dims": n, "ids": ids[own].astype(np.int64).tobytes(), "numbers": small.tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}],
                                                 schema=pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary()), ("lists", pa.binary())]))

        for batch in batches:
            for n, (ids, x) in _good(batch.column("vec_id"), batch.column("embedding"), scale).items():
                parts.setdefault(n, []).append((ids, x))
                filling += x.size
                if sum(len(p[0]) for p in parts[n]) >= most:
                    yield from block(n)
            while filling > _VALUES:
                yield from block(max(parts, key=lambda n: sum(p[1].size for p in parts[n])))
        for n in list(parts):
            yield from block(n)
    return run


def _read(ids: bytes, numbers: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.float64 if len(numbers) == 8 * len(own) * dims else np.int16
    return own, np.frombuffer(numbers, kind).astype(np.float64).reshape(len(own), dims)


def _exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if these hold all sums of products exactly, as Python integers if not."""
    if not q.size or not v.size or q.shape[1] * np.abs(q).max() * np.abs(v).max() < 1 << 53:
        return q, v
    whole = np.frompyfunc(int, 1, 1)
    return whole(q), whole(v)


def _bounds(q: np.ndarray, v: np.ndarray, lists: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every row's score for every query, from the first ``depth``
    entries at the good end of each list."""
    n, dims = v.shape
    column = np.arange(dims)[:, None]
    ends = v[lists[:, [0, -1]], column]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    low = high = 0
    for sign, read in ((plus, lists[:, n - depth:]), (minus, lists[:, :depth])):
        best, worst = (read[:, 0], ends[:, 0]) if sign is plus else (read[:, -1], ends[:, 1])
        seen = v[read, column]
        for fill, upper in ((v[best, column[:, 0]], True), (worst, False)):
            known = np.repeat(fill[None, :], n, axis=0)
            known[read, column] = seen
            if upper:
                high = high + sign @ known.T
            else:
                low = low + sign @ known.T
    return low, high


def best_of_block(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, need: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows in a block by score, then place (rows stand
    by id). ``need``: scores that a row must reach to matter, if known."""
    q, v = _exact(q, v)
    n, dims = v.shape
    need = np.full(len(q), -np.inf, dtype=q.dtype) if need is None else need.astype(q.dtype)
    open_, found = np.arange(len(q)), []
    depth = n if not dims else max(1, n // _FIRST_DEPTH)
    while len(open_):
        if depth >= n:
            low = high = q[open_] @ v.T
        else:
            low, high = _bounds(q[open_], v, lists, depth)
        other = own[open_][:, None] != ids[None, :]
        low, high = np.where(other, low, -np.inf), np.where(other, high, -np.inf)
        bar = need[open_]
        if n >= k:
            bar = np.maximum(bar, np.sort(low, axis=1)[:, n - k] if low.dtype == object else np.partition(low, n - k, axis=1)[:, n - k])
        need[open_] = bar
        able = other & (high >= bar[:, None])
        done = (able.sum(axis=1) <= _LEFT) | (depth >= n)
        at, row = np.nonzero(able[done])
        at = open_[done][at]
        found.append((at, row, (q[at] * v[row]).sum(axis=1) if dims else np.zeros(len(at))))
        open_, depth = open_[~done], min(n, 2 * depth)
    at, row, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(row, kind="stable")
    order = order[np.argsort(-score[order], kind="stable")]
    order = order[np.argsort(at[order], kind="stable")]
    at, row, score = at[order], row[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], row[keep], score[keep]


def _search(k: int):
    def run(batches):
        needs: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                ids, v = _read(r["ids"], r["numbers"], r["dims"])
                own, q = _read(r["query_ids"], r["query_numbers"], r["dims"])
                lists = np.frombuffer(r["lists"], np.uint16).reshape(r["dims"], len(ids))
                need = needs.pop(r["query_block"], np.full(len(own), -np.inf))
                at, row, score = best_of_block(q, own, v, ids, lists, k, need)
                full = np.flatnonzero(np.bincount(at, minlength=len(own)) == k)
                need[full] = np.maximum(need[full], score[np.searchsorted(at, full, side="right") - 1].astype(np.float64) if not score.dtype == object else -np.inf)
                needs[r["query_block"]] = need
                while len(needs) > 1024:
                    needs.pop(next(iter(needs)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["query_block"])), pa.array(at.astype(np.int32)), pa.array(own[at]), pa.array(ids[row]), pa.array([int(x) for x in score], pa.int64())],
                                                 names=["query_block", "query_row", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: float = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query's k best vectors: query_id, rank (from 1), vec_id, score. Both tables have
    vec_id and embedding.

    Blocks of vectors are written once; what is copied are the queries, once for each of at most
    four groups of blocks a shuffle partition.
    """
    def packed(df, most, with_lists):
        rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return saved((rows if with_lists else rows.distinct()).mapInArrow(_blocks(min(most, 1 << 16), scale, with_lists), _BLOCK), "vectors" if with_lists else "queries")

    blocks, asked = packed(vectors, block_rows, True), packed(queries, query_rows, False)
    n = max(1, min(4 * n_parts(vectors.sparkSession), blocks.count()))
    group = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND((1 << 32) - 1), F.lit(n)).alias("g")
    left = blocks.select(group, "dims", "ids", "numbers", "lists")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("g"), "dims", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("numbers").alias("query_numbers"))
    # merged: a broadcast would gather the copies in the driver, and Spark's guess of the size doesn't count them
    pairs = left.hint("merge").join(right, ["g", "dims"]).select("dims", "ids", "numbers", "lists", "query_block", "query_ids", "query_numbers")
    best = pairs.mapInArrow(_search(k), "query_block bigint, query_row int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_block", "query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"))
