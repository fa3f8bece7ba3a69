"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Every document is scanned once; each window of words whose hash is in the set
is compared word by word with the benchmark's window before it counts.

A benchmark of up to ``MAX_BYTES`` of text is broadcast as a set of windows with their
items. A larger one stays a table: what is broadcast then is a bit map of its hashes, of
a fixed size (PREFIX bits), windows that pass it meet the table's in an equi-join on hash
and text, and the hits go back to their documents. Both give the same rows.

Defined cases: a null or empty text has no words and no hits; benchmark items
without words or without an id never occur; items that share an id count once; rows that
share an id are told apart by their text, and equal rows get equal results; long texts
are scanned whole, a slice of rows at a time; empty tables give no rows or no hits; extra
columns of any name are ignored by ``find_overlaps`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, LOWER, SpanHash, document_key, merged, others, restored, runs_hash, saved, small_batches, table, text_slices, words

#: Bound of the broadcast benchmark's text; the set of its windows takes some fifty times as much.
MAX_BYTES = 1 << 20
#: Bits of a hash that the bit map of a larger benchmark knows: 8 MB.
PREFIX = 26
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<start:bigint,end:bigint>>"
_FILTER_BITS = 20


def _normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts, ends))


def _index(rows: list, window: int) -> dict:
    """{words in a window: (sorted hashes, filter, {hash: {window text: ids}})}."""
    found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
    for item, text in rows:
        data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
        starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
        k = min(window, len(starts))
        if not k:
            continue
        for i, h in enumerate(runs_hash(SpanHash(data)(starts, ends), k).tolist()):
            key = _normalised(data, starts[i: i + k], ends[i: i + k])
            found.setdefault(k, {}).setdefault(h, {}).setdefault(key, set()).add(str(item))
    out = {}
    for k, by_hash in found.items():
        hashes = np.array(sorted(by_hash), dtype=np.uint64)
        near = np.zeros(1 << _FILTER_BITS, dtype=bool)
        near[hashes & np.uint64((1 << _FILTER_BITS) - 1)] = True
        out[k] = (near, by_hash)
    return out


def _scan(blocks):
    def run(batches):
        index = blocks.value
        low = np.uint64((1 << _FILTER_BITS) - 1)
        for batch in batches:
            n = batch.num_rows
            text = batch.column("text")
            n_words = np.zeros(n, np.int64)
            runs, spans, items = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
            for first, end, data, offsets in text_slices(text):
                data = LOWER[data]
                starts, ends, row = words(data, offsets, ALNUM)
                counts = np.bincount(row, minlength=end - first)
                n_words[first:end] = counts
                begin = np.concatenate([[0], np.cumsum(counts)])
                hashes = SpanHash(data)(starts, ends)
                hit_at: list[np.ndarray] = []
                hit_len: list[np.ndarray] = []
                hit_items: dict[int, set] = {}
                for k, (near, by_hash) in index.items():
                    h = runs_hash(hashes, k)
                    at = np.flatnonzero(near[h & low])
                    at = at[row[at] == row[at + k - 1]]
                    good = []
                    for i, x in zip(at.tolist(), h[at].tolist()):
                        known = by_hash.get(x)
                        ids = known and known.get(_normalised(data, starts[i: i + k], ends[i: i + k]))
                        if ids:
                            good.append(i)
                            hit_items.setdefault(int(row[i]), set()).update(ids)
                    hit_at.append(np.array(good, np.int64))
                    hit_len.append(np.full(len(good), k, np.int64))
                at = np.concatenate(hit_at) if hit_at else np.zeros(0, np.int64)
                size = np.concatenate(hit_len) if hit_len else at
                order = np.argsort(at, kind="stable")
                at, size = at[order], size[order]
                for r, found in hit_items.items():
                    a, b = np.searchsorted(at, [begin[r], begin[r + 1]])
                    runs[first + r], spans[first + r] = _spans(at[a:b] - begin[r], size[a:b], starts[begin[r]: begin[r + 1]] - offsets[r], ends[begin[r]: begin[r + 1]] - offsets[r])
                    items[first + r] = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), text, pa.array(n_words), pa.array(runs, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))],
                names=["row", "text", "n_words", "runs", "spans", "items"])
    return run


def _spans(at: np.ndarray, size: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list, list]:
    """Windows of a document as disjoint runs of words, and as spans of bytes."""
    x, y = merged(at, at + size)
    return [{"start": int(p), "end": int(q)} for p, q in zip(x, y)], [{"start": int(starts[p]), "end": int(ends[q - 1])} for p, q in zip(x, y)]


# -- a benchmark of any size ------------------------------------------------------

def _windows(window: int):
    """(k, h, win, item) of each window of each item."""
    def run(batches):
        for batch in batches:
            ks, hs, wins, ids = [], [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                for k, (_, by_hash) in _index([(item, text)], window).items():
                    for h, keys in by_hash.items():
                        for key in keys:
                            ks.append(k)
                            hs.append(h)
                            wins.append(key)
                            ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(wins, pa.binary()), pa.array(ids, pa.string())], names=["k", "h", "win", "item"])
    return run


def _candidates(shared):
    """(d, m, at, k, h, win) of the windows of documents whose hash passes the bit map."""
    def run(batches):
        maps, sizes = shared.value
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "m"))
            for first, end, data, offsets in text_slices(batch.column("text")):
                data = LOWER[data]
                starts, ends, row = words(data, offsets, ALNUM)
                begin = np.searchsorted(row, np.arange(end - first))
                hashes = SpanHash(data)(starts, ends)
                for k in sizes:
                    h = runs_hash(hashes, k)
                    top = (h >> np.uint64(64 - PREFIX)).astype(np.int64)
                    at = np.flatnonzero((maps[top >> 6] >> (top & 63).astype(np.uint64)) & np.uint64(1))
                    at = at[row[at] == row[at + k - 1]]
                    r = row[at]
                    wins = [_normalised(data, starts[i: i + k], ends[i: i + k]) for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[first + r]), pa.array(marks[first + r]), pa.array((at - begin[r]).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(h[at].view(np.int64)), pa.array(wins, pa.binary())],
                        names=["d", "m", "at", "k", "h", "win"])
    return run


def _finish(batches):
    for batch in batches:
        n_words, runs, spans = [], [], []
        places, text = batch.column("hits").to_pylist(), batch.column("text")
        for first, end, data, offsets in text_slices(text):
            starts, ends, row = words(LOWER[data], offsets, ALNUM)
            begin = np.searchsorted(row, np.arange(end - first + 1))
            for r in range(end - first):
                a, b = begin[r], begin[r + 1]
                hit = sorted((x["at"], x["k"]) for x in places[first + r] or ())
                at, size = np.array(hit, np.int64).reshape(-1, 2).T
                x, y = _spans(at, size, starts[a:b] - offsets[r], ends[a:b] - offsets[r])
                n_words.append(int(b - a))
                runs.append(x)
                spans.append(y)
        yield pa.RecordBatch.from_arrays([batch.column("row"), text, pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN)), batch.column("items")], names=["row", "text", "n_words", "runs", "spans", "items"])


def _joined_overlaps(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``rows`` has d, m, row and text."""
    spark = rows.sparkSession
    known = saved(items.mapInArrow(_windows(window), "k int, h bigint, win binary, item string").distinct(), "windows")
    top = F.shiftrightunsigned("h", 64 - PREFIX)
    words_ = known.select(F.shiftright(top, 6).cast("int").alias("word"), top.bitwiseAND(63).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    maps = np.zeros(1 << (PREFIX - 6), np.int64)
    maps[words_["word"].to_numpy(np.int64)] = words_["bits"].to_numpy(np.int64)
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())  # at most ``window`` of them
    shared = spark.sparkContext.broadcast((maps.view(np.uint64), sizes))
    found = rows.select("d", "m", "text").mapInArrow(_candidates(shared), "d bigint, m bigint, at int, k int, h bigint, win binary")
    hits = found.join(known, ["k", "h", "win"])
    hits = hits.groupBy("d", "m").agg(F.collect_set(F.struct("at", "k")).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    empty = F.array().cast("array<string>")
    both = rows.join(hits, ["d", "m"], "left").select("row", "text", "hits", F.coalesce("items", empty).alias("items"))
    schema = both.select("row", "text", F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(_SPANS).alias("runs"), F.lit(None).cast(_SPANS).alias("spans"), "items").schema
    return both.mapInArrow(_finish, schema)


def _overlaps(docs: DataFrame, row, benchmark: DataFrame, window: int, max_bytes: int) -> DataFrame:
    """row (a column of docs), text, n_words, runs, spans and items of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        d, m = document_key(docs)
        return _joined_overlaps(docs.select(d, m.alias("m"), row.alias("row"), "text"), items, window)
    out = docs.select(row.alias("row"), "text", F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(_SPANS).alias("runs"), F.lit(None).cast(_SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    shared = spark.sparkContext.broadcast(_index(items.collect(), window))
    return out.select("row", "text").mapInArrow(_scan(shared), out.schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, runs (word positions) and spans (byte positions)
    of the words inside benchmark windows, items (ids that occur, sorted as strings)."""
    return _overlaps(docs, F.col("doc_id").cast("bigint"), benchmark, window, max_bytes).select(F.col("row").alias("doc_id"), "n_words", "runs", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs, columns as they came."""
    return restored(_overlaps(docs, others(docs), benchmark, window, max_bytes).where(F.size("items") == 0), docs)


def op5(spark, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words",
        F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"))
