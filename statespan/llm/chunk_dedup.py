"""Substring deduplication by content-defined chunking.

A gear rolling hash (the last 32 bytes decide) cuts each text into chunks of
MIN_CHUNK to MAX_CHUNK bytes, about MEAN_CHUNK on average, so an insertion moves
only the cuts around it. Chunks are deduplicated by digest: a chunk that also
stands earlier (smaller doc_id, or earlier in the same document) is removed,
however short; a caller may ask to keep runs of such chunks under ``min_run`` bytes.

Texts are chunked once, into a table of digests and places. Copies are collapsed
inside each task before the shuffle and by a grouped minimum after it; what joins
back are only chunks with a digest seen twice.

Defined cases: a null text is empty and has no chunks; a text under MIN_CHUNK
bytes is one chunk; a null id comes after all others; equal rows are one
document; rows that share an id but not the text are different documents, in
order of a hash of the text; an empty table gives no rows; very long texts are
chunked whole, in memory of some times their size; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import document_key, merged, saved, small_batches, table, text_slices

MIN_CHUNK = 16
MEAN_CHUNK = 40
MAX_CHUNK = 256
MIN_RUN = 1
#: Chunks are known by 128 bits of BLAKE2b under this key.
_KEY = b"statespan chunks"
_GEAR = np.random.default_rng(987654321).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + gear[byte] in 32 bits, so that it
    depends on the last 32 bytes; computed by doubling the window five times."""
    h = _GEAR[data]
    for p in (1, 2, 4, 8, 16):
        if len(h) > p:
            h[p:] = h[p:] + (h[:-p] << np.uint32(p))
    return h


def cuts(h: np.ndarray, offsets: np.ndarray, least: int = MIN_CHUNK, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> list[np.ndarray]:
    """Chunk ends of each row. A cut follows a byte whose hash is small, at least
    ``least`` bytes into the chunk and 32 into the row (so that the hash saw no other
    row); a chunk ends at ``most`` bytes at the latest."""
    small = np.flatnonzero(h < np.uint32(min((1 << 32) - 1, (1 << 32) // max(1, mean - least)))) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, at = [], a
        lo, hi = np.searchsorted(small, [a + 32, b])
        for c in small[lo:hi].tolist():
            while c - at > most:
                at += most
                ends.append(at)
            if c - at >= least:
                ends.append(c)
                at = c
        while b - at > most:
            at += most
            ends.append(at)
        if b > at:
            ends.append(b)
        out.append(np.array(ends, np.int64))
    return out


def _chunks(batches):
    """Distinct chunks of each slice, with the earliest place, and the others as repeats."""
    for batch in batches:
        ids, marks = batch.column("d").to_numpy(zero_copy_only=False), batch.column("h").to_numpy(zero_copy_only=False)
        for first, end, data, offsets in text_slices(batch.column("text")):
            if not len(data):
                continue
            ends = cuts(gear_hash(data), offsets)
            sizes = np.array([len(e) for e in ends])
            row = np.repeat(np.arange(end - first), sizes)
            stop = np.concatenate(ends)
            start = np.empty_like(stop)
            start[1:] = stop[:-1]
            begin = np.cumsum(sizes) - sizes
            start[begin[sizes > 0]] = offsets[:-1][sizes > 0]
            raw, digest = data.tobytes(), hashlib.blake2b
            digests = b"".join([digest(raw[a:b], digest_size=16, key=_KEY).digest() for a, b in zip(start.tolist(), stop.tolist())])
            one, two = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            lo, size = (start - offsets[row]).astype(np.int32), (stop - start).astype(np.int32)
            d, h = ids[first + row], marks[first + row]
            order = np.lexsort((lo, h, d, two, one))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
            lead = order[new][np.cumsum(new) - 1]
            again = (d[order] != d[lead]) | (h[order] != h[lead]) | (lo[order] != lo[lead])
            keep = order[new | again]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one[keep], two[keep], d[keep], h[keep], lo[keep], size[keep], again[new | again])], names=["c1", "c2", "d", "h", "lo", "size", "again"])


def _with_runs(docs: DataFrame, row) -> DataFrame:
    small_batches(docs.sparkSession)
    key = document_key(docs)
    # stored, so that texts are chunked once; each read takes the columns it needs
    places = saved(docs.select(*key, "text").mapInArrow(_chunks, "c1 bigint, c2 bigint, d bigint, h bigint, lo int, size int, again boolean"), "places")
    known = places.where("again").select("d", "h", "lo", "size")
    firsts = places.where("not again")
    # stored, so that the join deals both sides anew and a chunk that very many tasks found can be split
    twice = saved(firsts.groupBy("c1", "c2").agg(F.min(F.struct("d", "h", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    late = firsts.join(twice, ["c1", "c2"]).where("d <> first.d or h <> first.h or lo <> first.lo").select("d", "h", "lo", "size")
    runs = known.unionByName(late).groupBy("d", "h").agg(F.collect_list(F.struct("lo", "size")).alias("runs"))
    return docs.select(*key, row.alias("row"), "text").join(runs, ["d", "h"], "left").select("row", "text", "runs")


def _removed(size: int, runs, least: int) -> tuple[np.ndarray, np.ndarray]:
    lo = np.array([r["lo"] for r in runs or ()], np.int64)
    start, end = merged(np.minimum(lo, size), np.minimum(lo + np.array([r["size"] for r in runs or ()], np.int64), size))
    return start[end - start >= least], end[end - start >= least]


def _spans(least: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                raw = (text.as_py() or "").encode()
                start, end = _removed(len(raw), runs.as_py(), least)
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
                digest = hashlib.sha256(b"".join(raw[edges[i]: edges[i + 1]] for i in range(0, len(edges), 2))).hexdigest()
                out.append((len(raw), int((end - start).sum()), [{"start": int(a), "end": int(b)} for a, b in zip(start, end)], digest))
            n, removed, spans, digests = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])
    return run


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, spans (bytes to remove), kept_sha256."""
    rows = _with_runs(docs, F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(_spans(min_run), "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def op10(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")

