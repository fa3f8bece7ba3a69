"""Helpers shared by the training-data operators.

Text kernels work on the UTF-8 bytes of a whole Arrow column: no per-word
Python objects, and a slice of rows at a time so that memory stays bounded by
``SLICE_BYTES`` (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import discard, saved

SLICE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session to BATCH_BYTES, as a kernel holds a whole batch;
    a session that has set a bound of its own keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", f"{64 << 20}", f"{64 << 20}b"):
        spark.conf.set(key, str(BATCH_BYTES))


def input_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` reads: no job runs. Sources of unknown size count nothing, and
    what joins are guessed to make does not matter."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def n_blocks_of(df: DataFrame, block_bytes: int) -> int:
    """Blocks to deal by: so many that each is due ``block_bytes`` of the input's files at most,
    however large it is, and four for each shuffle partition at least."""
    return max(4 * n_parts(df.sparkSession), -(-input_bytes(df) // block_bytes))


class Scratch:
    """Tables of one operator that go when it is done with them."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def saved(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(saved(df, label))
        return self.tables[-1]

    def holds(self, df: DataFrame) -> DataFrame:
        """Take over a table that is saved already."""
        self.tables.append(df)
        return df

    def clear(self, *stay: DataFrame) -> None:
        for t in self.tables:
            if all(t is not s for s in stay):
                discard(t)
        self.tables = list(stay)


def others(docs: DataFrame):
    """All columns but the text as one column ``row``, to go through a kernel beside it."""
    return F.struct(F.lit(0).alias(unused("_", docs)), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def restored(df: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` out of row and text, some of them changed."""
    changed = {"text": F.col("text"), **changed}
    return df.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def document_key(docs: DataFrame) -> tuple:
    """Columns d and h that tell documents apart: d is the id, a null one as LAST_ID; h is a hash
    of the text for null ids and, if any id stands with different texts, for all; 0 otherwise."""
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    by_id = docs.where("doc_id is not null").select(d.alias("d"), h.alias("h")).groupBy("d").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    if by_id.where("low <> high").limit(1).count():
        return d.alias("d"), h.alias("h")
    return d.alias("d"), F.when(d == LAST_ID, h).otherwise(F.lit(0).cast("bigint")).alias("h")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- text kernels -----------------------------------------------------------

def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def sub_batches(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``limit`` bytes of one column, or of one row."""
    if batch.num_rows:
        for first, end, _, _ in text_slices(batch.column(column), limit):
            yield batch.slice(first, end - first)


def byte_mask(inside) -> np.ndarray:
    """256 booleans: which byte values belong to words."""
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Words are runs of anything but space and \t..\r.
NOT_SPACE = byte_mask(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of digits, letters a-z (either case, as texts are lower-cased) and non-ASCII characters.
ALNUM = byte_mask(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the row it is in; words never cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = mask[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class SpanHash:
    """Polynomial hashes (modulo 2^64) of any byte span of a buffer in O(1)."""

    _cache: dict = {}

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        size = max(1 << 20, 1 << (n - 1).bit_length())
        if size not in self._cache:
            self._cache.clear()
            self._cache[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
        up, self.down = self._cache[size]
        self.sums = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * up[: n - 1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class WordHash(SpanHash):
    """A polynomial modulo a prime beside the one modulo 2^64, so that strings of a structure
    which cancels out in powers of two (as complementary Thue-Morse words do) differ."""

    _P, _AT, _BACK = np.uint64((1 << 31) - 1), 1_582_417_361, pow(1_582_417_361, -1, (1 << 31) - 1)
    _primes: dict = {}

    def __init__(self, data: np.ndarray):
        super().__init__(data)
        n = len(data) + 1
        size = max(1 << 20, 1 << (n - 1).bit_length())
        if size not in self._primes:
            self._primes.clear()
            self._primes[size] = (_powers_modulo(self._AT, size, int(self._P)), _powers_modulo(self._BACK, size, int(self._P)))
        up, self.back = self._primes[size]
        self.rests = np.zeros(n, np.uint64)
        np.cumsum((_BYTE[data] >> np.uint64(33)) * up[: n - 1] % self._P, out=self.rests[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        rest = (self.rests[ends] - self.rests[starts]) % self._P * self.back[starts] % self._P
        with np.errstate(over="ignore"):
            return mixed(super().__call__(starts, ends) + rest * np.uint64(0xA24BAED4963EE407))


def _powers_modulo(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:  # twice as many each time
        more = min(have, n - have)
        out[have: have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


def word_column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words of a buffer as an Arrow column."""
    size = ends - starts
    cuts = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def runs_hash(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * np.uint64(0xA24BAED4963EE407) + word_hashes[i: i + n])
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, as maximal disjoint ones (touching ones join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([first[1:], [True]])
    return starts[first], ends[last]


# -- graphs -------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, component_id) for every node of the links (a, b); component_id is the
    smallest node that can be reached.

    Alternates large-star and small-star steps, each a grouped minimum and an
    equi-join, until a round changes nothing, when the links form stars; each round is
    written to the shared folder, and so is the result.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    sign = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that the join deals both sides anew and a node with very many links can be split
        near = saved(both.groupBy("a").agg(F.min("b").alias("m")), "near")
        low = near.select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        old, edges = edges, saved(small.where("a <> b").distinct(), "stars")
        discard(old, near)
        seen, sign = sign, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == sign:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component_id", F.col("node"))
    out = saved(edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionByName(roots), "components")
    discard(edges)
    return out
