"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

The incidence matrix (documents by hashed word shingles) is multiplied with its
transpose in blocks of columns; a block's product gives, for each pair of
documents, how many of the block's shingles they share. Sizes bound what has to
be multiplied and what can be dropped:

* a set of n shingles needs only its first n - ceil(0.8 n) + 1 columns in a
  fixed global order (rarest first) to meet every set that it can link with;
* sets whose sizes differ too much can't link;
* the shared columns summed over all blocks must reach the overlap that the two
  sizes ask for, less what the columns left out can add.

Pairs that pass are verified on their texts: the words of both are numbered by value and the
shingles compared as tuples of these numbers, so no link rests on a hash of words. A pair inside a
known component needs no verification, so each document is first checked against one partner;
only pairs between different components are checked after that. Texts of one and the same sequence
of words are linked by a keyed digest of 128 bits of that sequence.

Columns of HOT_FROM documents or more (``hot``) come last in the order, by level of
frequency; what remains of them in a product is dealt as plain rows and linked through
one centre, and only pairs of different components, of sizes that fit, that can still
reach their bound are paired. Which columns are hot is told by bit maps of a fixed size
(PREFIX bits of the hash): a column that shares its prefix with a hot one counts as hot
too, which changes the order of work but no result.

Hot columns and copies meet in equi-joins of two stored tables, whose large partitions
adaptive execution splits; equal sequences go on as the one with the smallest doc_id.

Defined cases: words are runs of anything but white space, A-Z lower-cased;
fewer than five words are one shingle; a null, empty or blank text has no
shingles and links with nothing, not even its like; equal sets always link;
rows that share a doc_id are one node; a null doc_id is never linked and has a
null component; an empty table gives no rows; words that are as long and alike as can be are still
told apart; extra columns of any name are ignored, and kept by ``keep_one``; long
texts are hashed whole, a slice of rows at a time.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, NOT_SPACE, Scratch, WordHash, components, discard, n_blocks_of, runs_hash, saved, small_batches, table, text_slices, unused, word_column, words

WORDS = 5
PERCENT = 80
#: A column with at least so many documents is hot.
HOT_FROM = 16
#: Levels of hot columns: from HOT_FROM documents on, and from 16 and 256 times as many.
LEVELS = 3
#: Bits of a hash by which hot columns are known: 8 MB a level, whatever the number of columns.
PREFIX = 26
#: Input bytes that a block of columns is due.
BLOCK_BYTES = 4 << 20
_SEEN = 100_000
_KEY = b"words of a document"
_FLUSH = 1 << 20
_POSTING = np.dtype([("h", "<u8"), ("d", "<i8"), ("n", "<i4"), ("k", "<i4"), ("p", "<i4")])


def shingle_sets(column, k: int = WORDS):
    """Yield (row, sorted distinct shingle hashes, digest of its words) for a text column."""
    for first, end, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, row = words(data, offsets, NOT_SPACE)
        hashes = WordHash(data)(starts, ends)
        counts = np.bincount(row, minlength=end - first)
        begin = np.concatenate([[0], np.cumsum(counts)])
        grams = runs_hash(hashes, k)
        # words with a space after each
        size = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        plain = np.full(size[-1], 0x20, np.uint8)
        plain[np.arange(size[-1] - len(starts)) + np.repeat(np.arange(len(starts)), ends - starts)] = data[NOT_SPACE[data]]
        cuts, plain = size[begin], memoryview(plain)
        for r in range(end - first):
            a, c = begin[r], counts[r]
            own = grams[a: a + c - k + 1] if c >= k else runs_hash(hashes[a: a + c], int(c)) if c else hashes[:0]
            yield first + r, np.unique(own), blake2b(plain[cuts[r]: cuts[r + 1]], digest_size=16, key=_KEY).digest()


def _sets_summary(k: int):
    def run(batches):
        for batch in batches:
            n, digests = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for r, grams, digest in shingle_sets(batch.column("text"), k):
                n[r], digests[r] = len(grams), digest
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(digests, pa.binary())], names=["doc_id", "n", "digest"])
    return run


def _columns(k: int, n_blocks: int):
    """Every shingle of every document, its upper 40 bits, packed by block."""
    def flush(parts):
        all_ = np.sort(np.concatenate(parts)) >> np.uint64(24)
        block = (all_ * np.uint64(n_blocks)) >> np.uint64(40)
        cuts = np.flatnonzero(np.diff(block, prepend=np.uint64(n_blocks)))
        raw = np.ascontiguousarray(all_.view(np.uint8).reshape(-1, 8)[:, :5])
        pieces = [raw[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(all_)])]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts].astype(np.int32)), pa.array(pieces, pa.binary())], names=["block", "packed"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, grams, _ in shingle_sets(batch.column("text"), k):
                parts.append(grams)
                size += len(grams)
                if size >= _FLUSH:
                    yield flush(parts)
                    parts, size = [], 0
        if size:
            yield flush(parts)
    return run


def _frequent(least: int):
    def run(_, group):
        raw = np.frombuffer(b"".join(group.column("packed").to_pylist()), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        values = np.sort(wide.view("<u8").ravel())
        cuts = np.flatnonzero(np.diff(values, prepend=values[:1] + np.uint64(1)))
        df = np.diff(np.append(cuts, len(values)))
        keep = df >= least
        return pa.table({"h40": values[cuts][keep].astype(np.int64), "df": df[keep].astype(np.int64)})
    return run


def _bits(frequent: DataFrame) -> np.ndarray:
    """Bit maps of the hot columns' prefixes, one for each level."""
    word, bit = F.shiftright("h40", 20).cast("int"), F.shiftright("h40", 40 - PREFIX).bitwiseAND((1 << (PREFIX - 20)) - 1)
    maps = [F.bit_or(F.when(F.col("df") >= HOT_FROM << (4 * v), F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("bigint"))).alias(f"v{v}") for v in range(LEVELS)]
    rows = frequent.select(word.alias("word"), bit.cast("int").alias("bit"), "df").groupBy("word").agg(*maps).toPandas()
    out = np.zeros((LEVELS, 1 << 20), np.int64)
    out[:, rows["word"].to_numpy(np.int64)] = [rows[f"v{v}"].to_numpy(np.int64) for v in range(LEVELS)]
    return out.view(np.uint64)


def _level(maps: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """0 for cold columns, else the level of hotness."""
    word, bit = (grams >> np.uint64(44)).astype(np.int64), (grams >> np.uint64(64 - PREFIX)) & np.uint64((1 << (PREFIX - 20)) - 1)
    return sum(((maps[v][word] >> bit) & np.uint64(1)).astype(np.int8) for v in range(LEVELS))


def _postings(k: int, percent: int, n_blocks: int, shared):
    """The leading columns of every set: cold ones packed by block, hot ones as rows.

    Of equal texts that a task remembers only the first is needed: they are linked by
    their digests.
    """
    def pack(parts):
        rows = np.concatenate(parts)
        block = (rows["h"] % np.uint64(n_blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        rows, block = rows[order], block[order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        pieces = [rows[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(rows)])]
        n = len(pieces)
        return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(pieces, pa.binary())], names=["block", "packed"]) if n else None

    def run(batches):
        maps = shared.value
        parts, size, seen = [], 0, set()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for r, grams, digest in shingle_sets(batch.column("text"), k):
                n = len(grams)
                if not n or ids[r] is None:
                    continue
                if digest in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(digest)
                level = _level(maps, grams)
                need = n - -(-percent * n // 100) + 1
                cold = grams[level == 0][:need]
                late = grams[np.argsort(level, kind="stable")][n - int((level > 0).sum()):][: need - len(cold)]
                rows = np.empty(len(cold) + len(late), _POSTING)
                rows["h"][: len(cold)], rows["h"][len(cold):] = cold, late
                rows["d"], rows["n"], rows["k"], rows["p"] = ids[r], n, len(late), 0
                rows["p"][len(cold):] = np.arange(len(late))
                if len(late):
                    hot_rows = rows[len(cold):]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(1, -1, np.int32)), pa.array([hot_rows.tobytes()], pa.binary())], names=["block", "packed"])
                if len(cold):
                    parts.append(rows[: len(cold)])
                    size += len(cold)
                if size >= _FLUSH // 4:
                    yield pack(parts)
                    parts, size = [], 0
        if size:
            yield pack(parts)
    return run


def _unpack(batches):
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column("packed").to_pylist()), _POSTING)
        yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(np.int64)) for c in "hdnkp"], names=list("hdnkp"))


def _product(percent: int):
    """Overlap counts of one block of cold columns: each has under HOT_FROM documents, so
    pairs stay few."""
    def run(_, group):
        rows = np.frombuffer(b"".join(group.column("packed").to_pylist()), _POSTING)
        rows = rows[np.lexsort((rows["d"], rows["h"]))]
        h, n = rows["h"], rows["n"].astype(np.int64)
        pairs = []
        step = 1
        while step < len(rows):
            left = np.flatnonzero(h[:-step] == h[step:])
            if not len(left):
                break
            x, y = left, left + step
            fits = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (rows["d"][x] != rows["d"][y])
            pairs.append(np.stack([x[fits], y[fits]]))
            step += 1
        empty = np.zeros((2, 0), np.int64)
        x, y = np.concatenate(pairs, axis=1) if pairs else empty
        out = np.stack([rows["d"][x], rows["d"][y], n[x], n[y], np.minimum(rows["k"][x], rows["k"][y])]) if len(x) else np.zeros((5, 0), np.int64)
        order = np.lexsort((out[1], out[0]))
        out = out[:, order]
        new = np.ones(out.shape[1], bool)
        new[1:] = (out[0, 1:] != out[0, :-1]) | (out[1, 1:] != out[1, :-1])
        cuts = np.flatnonzero(new)
        counts = np.diff(np.append(cuts, out.shape[1]))
        return pa.table({**{c: out[i, cuts] for i, c in enumerate(("a", "b", "na", "nb", "k"))}, "shared": counts.astype(np.int64)})
    return run


def _pair_slices(batch, limit: int = 1 << 20):
    """A batch of pairs of texts in parts of about ``limit`` bytes, or of one pair."""
    size = np.cumsum(sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ta", "tb")))
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(size, limit + (size[first - 1] if first else 0), side="right")))
        yield batch.slice(first, end - first)
        first = end


def overlaps(left: pa.Array, right: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts how many shingles the first has, the second, and both; by the words
    themselves."""
    n = len(left)
    both = pa.concat_arrays([left, right])
    out = np.zeros((3, n), np.int64)
    for _, _, data, offsets in text_slices(both, 1 << 62):
        data = LOWER[data]
        starts, ends, row = words(data, offsets, NOT_SPACE)
        if not len(starts):
            break
        word = word_column(data, starts, ends).dictionary_encode()
        many, number = len(word.dictionary) + 1, np.concatenate([word.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.zeros(k, np.int64)])
        counts = np.bincount(row, minlength=2 * n)
        place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        at = np.flatnonzero((place == 0) | (place + k <= counts[row]))
        # of fewer than k words, 0 stands where there is none
        columns = [np.where(place[at] + i < counts[row[at]], number[at + i], 0) for i in range(k)]
        if many < 1 << 21:
            columns = [sum(c * many ** i for i, c in enumerate(columns[j: j + 3])) for j in range(0, k, 3)]
        pair, side = row[at] % n, row[at] // n
        order = np.lexsort((side, *columns, pair))
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in (pair, *columns):
            new[1:] |= c[order][1:] != c[order][:-1]
        group, side = np.cumsum(new) - 1, side[order]
        pair = pair[order][new]
        have = [np.bincount(group[side == s], minlength=len(pair)) > 0 for s in (0, 1)]
        for i, which in enumerate((*have, have[0] & have[1])):
            out[i] += np.bincount(pair[which], minlength=n)
    return tuple(out)


def _links(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for part in _pair_slices(batch):
                x, y, common = overlaps(part.column("ta"), part.column("tb"), k)
                yield part.select(["a", "b"]).filter(pa.array((common > 0) & (100 * common >= percent * (x + y - common))))
    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = saved(texts.join(ids, "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "sets")
    both = pairs.select("a", "b").join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    links = saved(both.mapInArrow(_links(k, percent), "a bigint, b bigint").distinct(), "verified")
    discard(own)
    return links


def classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark, scratch = docs.sparkSession, Scratch()
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n_blocks = n_blocks_of(texts, BLOCK_BYTES)
    summary = saved(texts.mapInArrow(_sets_summary(k), "doc_id bigint, n bigint, digest binary"), "summary")

    seen = texts.mapInArrow(_columns(k, n_blocks), "block int, packed binary")
    frequent = scratch.saved(seen.groupBy("block").applyInArrow(_frequent(HOT_FROM), "h40 bigint, df bigint"), "frequent")
    shared = spark.sparkContext.broadcast(_bits(frequent))

    packed = scratch.saved(texts.mapInArrow(_postings(k, percent, n_blocks, shared), "block int, packed binary"), "postings")
    overlap = packed.where("block >= 0").groupBy("block").applyInArrow(_product(percent), "a bigint, b bigint, na bigint, nb bigint, k bigint, shared bigint")
    need = f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"
    rest = f"({percent} * greatest(na, nb) + 99) div 100 - 1"
    cold = overlap.groupBy("a", "b", "na", "nb", "k").agg(F.sum("shared").alias("shared")).where(f"shared + k >= {need} - ({rest})")
    cold = scratch.saved(cold.select("a", "b", "shared"), "cold")

    equal = summary.where("n > 0 and doc_id is not null")
    first = scratch.saved(equal.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").drop("z"), "first")
    copies = scratch.saved(equal.join(first, "digest").where("doc_id > a").select("a", F.col("doc_id").alias("b")), "copies")
    warm = packed.where("block < 0").mapInArrow(_unpack, "h bigint, d bigint, n bigint, k bigint, p bigint")
    warm = warm.join(copies.select(F.col("b").alias("d"), "a"), "d", "left").withColumn("d", F.coalesce("a", "d")).drop("a").distinct()
    warm = scratch.saved(warm, "warm")

    # first one partner for each document: the one that shares most cold columns, and of a hot
    # column the document with most hot ones, which differs least from what its like have in common
    centre = scratch.saved(warm.groupBy("h").agg(F.max_by("d", F.struct("k", "d")).alias("a"), F.max("k").alias("ka")), "centre")
    stars = warm.join(centre, "h").where("d <> a").groupBy("d").agg(F.max_by("a", F.struct("ka", "a")).alias("a")).select("a", F.col("d").alias("b"))
    partner = cold.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    tries = scratch.saved(partner.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tries")
    links = copies.unionByName(scratch.holds(_verified(tries, texts, k, percent)))
    found = scratch.holds(components(links))

    own = lambda df, c: df.join(found.select(F.col("node").alias(c), F.col("component_id").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    again = lambda more: scratch.holds(components(found.where("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b")).unionByName(scratch.holds(_verified(more, texts, k, percent)))))
    # then another centre for each hot column that still holds several components, out of its largest
    labelled = scratch.saved(own(warm, "d"), "labelled")
    parts = labelled.groupBy("h", "cd").agg(F.count("*").alias("m"), F.max_by("d", F.struct(F.col("k") + F.pmod(F.xxhash64("d", "h"), F.lit(8)), "d")).alias("e"))
    columns = scratch.saved(parts.groupBy("h").agg(F.max_by(F.struct(F.col("cd").alias("ce"), "e"), F.struct("m", "cd")).alias("top"), F.count("*").alias("n_parts")).where("n_parts > 1").select("h", "top.*"), "columns")
    tries = scratch.saved(labelled.join(columns, "h").where("cd <> ce").select(F.least("d", "e").alias("a"), F.greatest("d", "e").alias("b")).distinct(), "tries")
    if not tries.isEmpty():
        found = again(tries)
        labelled = scratch.saved(own(warm, "d"), "labelled")

    # at last every pair between different components that shares a leading column and can reach
    # its bound: if this is the first column that they share, what both have from there on must
    # do; sizes that fit stand in the same or the next band; pairs that share a cold column are in ``cold``
    apart = own(own(cold.select("a", "b"), "a"), "b").where("ca <> cb").select("a", "b")
    mixed = scratch.saved(labelled.groupBy("h").agg(F.min("cd").alias("lo"), F.max("cd").alias("hi")).where("lo < hi").select("h"), "mixed")
    band = F.floor(F.log("n") / math.log(101 / percent))
    left = labelled.join(mixed, "h", "left_semi").withColumns({"k": F.col("k") - F.col("p"), "band": band}).drop("p")
    left = scratch.saved(left, "left")
    right = left.select("h", F.col("d").alias("e"), F.col("n").alias("ne"), F.col("k").alias("ke"), F.col("cd").alias("ce"), F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"))
    fits = f"least(k, ke) >= ({percent} * (n + ne) + {99 + percent}) div {100 + percent} - (({percent} * greatest(n, ne) + 99) div 100 - 1)"
    across = left.join(right, ["h", "band"]).where(f"cd < ce and 100 * least(n, ne) >= {percent} * greatest(n, ne) and {fits}").select(F.least("d", "e").alias("a"), F.greatest("d", "e").alias("b"))
    more = scratch.saved(apart.unionByName(across).distinct(), "more")
    if not more.isEmpty():
        found = again(more)
    scratch.clear(found)
    shared.unpersist()
    out = summary.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a linked document of smaller id."""
    name = unused("other", docs)
    other = classes(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(other, F.col("doc_id").cast("bigint") == F.col(name), "left_anti")


def op3(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
