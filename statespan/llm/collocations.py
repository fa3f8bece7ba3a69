"""Phrase collocations: top-order marginalisation of word windows.

Texts are cut into pieces at punctuation and line ends, and pieces into words. Each word leads one
window, its own column and those of the four words that follow it in the piece, padded with nulls
past the end; only these longest windows are counted. ROLLUP over (lang, w1 ... w5) then sums them
up to every shorter prefix: the windows that begin with a phrase are its occurrences, so no other
order of n-grams is ever produced, and the level of the language alone is its number of words.

A phrase of ``min_count`` occurrences holds no shorter one of fewer, so a window may end where such
begins. A first pass counts words and pairs by language in cells of a hash table of fixed size, which
can only count too many; a bit a cell, ``min_count`` reached or not, is what tasks get. A second pass
counts in a new table what is left of words and pairs and, where all their pairs are left, phrases of
three to five words. Windows end at phrases whose bit is off, so hardly any but phrases that count are
given on. Nothing that counts is lost whatever the hashes do; past some billions of words the tables
fill, and windows are then counted without shortening.

A task gives on the table and each of its windows once, so partitions of the input are read together,
up to ``TASK_BYTES`` of files, while each core has two tasks.

Equal windows of many texts are counted together before they leave the task. Words
travel as text: no count rests on a hash.

Defined cases: a null text is empty; a null lang is ``und``; null or repeated ids do not matter,
equal rows count each; very long texts are cut whole, in memory of some times their size; ties in
score and count go to the phrase that comes first by UTF-8 bytes; no candidates give no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, Scratch, SpanHash, byte_mask, input_bytes, mixed, n_parts, small_batches, table, text_slices, word_column, words

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
SLICE = 2 << 20
#: Of the input's files, that a task reads.
TASK_BYTES = 64 << 20
_CUT = byte_mask(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
_WORD = byte_mask(lambda b: b not in (0x20, 0x09)) & ~_CUT
#: Cells of the table, whatever the input: a task counts in a byte a cell (four from a least count of
#: 256 on), and is told a bit a cell.
CELLS = 1 << 26
#: Different windows that a task holds before it gives them on.
_HELD = 400_000
_BLOCK = 1 << 16
COLUMNS = [f"w{k}" for k in range(1, LONGEST + 1)]


def _tokens(batch, limit: int = SLICE):
    """For slices of a batch: lower-cased bytes, start and end of each word, whether the next word
    goes on in its piece, its language's code, and the languages."""
    lang = batch.column("lang").fill_null("und").dictionary_encode()
    names, of_row = lang.dictionary, lang.indices.to_numpy(zero_copy_only=False)
    for first, end, data, offsets in text_slices(batch.column("text"), limit):
        data = LOWER[data]
        start, stop, row = words(data, offsets, _WORD)
        if len(start):
            cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
            on = np.zeros(len(start), bool)
            on[:-1] = (row[1:] == row[:-1]) & (cuts[start[1:]] == cuts[stop[:-1]])
            yield data, start, stop, on, of_row[first:end][row], names


def _cells(data, start, stop, lang, names, n_cells: int, longest: int) -> list[np.ndarray]:
    """Cells of each word and of the phrases of two to ``longest`` words that it begins."""
    salt = np.array([hash_of(x) for x in names.to_pylist()], np.uint64)[lang]
    h = SpanHash(data)(start, stop)
    out = []
    with np.errstate(over="ignore"):
        for k in range(longest):
            phrase = mixed(phrase * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -k)) if k else mixed(h * np.uint64(0xC2B2AE3D27D4EB4F) ^ salt)
            out.append((phrase & np.uint64(n_cells - 1)).astype(np.int64))
    return out


def _left(cells: list[np.ndarray], on: np.ndarray, bits, tested: int) -> list[np.ndarray]:
    """Whether each word, and the phrase of two and more words that it begins, is whole and frequent
    by its bits, those of up to ``tested`` words; longer ones by the phrases they hold."""
    out = [np.ones(len(on), bool)]
    for k, cell in enumerate(cells):
        if k:
            out.append(out[-1].copy())
            out[-1][:-1] &= out[-2][1:]
            out[-1][-1] = False
        if k == 1:
            out[1] &= on
        if k < tested:
            at = np.flatnonzero(out[-1])
            c = cell[at]
            out[-1][at] = (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return out


def hash_of(text: str) -> int:
    import zlib

    raw = text.encode()
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def _count(n_cells: int, least: int, shared=None):
    """Counts of words and pairs; given their bits, of what is left of them and of longer phrases."""
    def run(batches):
        kind = np.uint8 if least < 256 else np.uint32
        counts = np.zeros(n_cells, kind)
        bits, tested, longest = (None, 0, 2) if shared is None else (shared.value, 2, LONGEST)
        for batch in batches:
            for data, start, stop, on, lang, names in _tokens(batch):
                cells = _cells(data, start, stop, lang, names, n_cells, longest)
                for cell, left in zip(cells, _left(cells, on, bits, tested)):
                    at, n = np.unique(cell[left], return_counts=True)
                    counts[at] = np.minimum(counts[at] + n, least)
        for k in range(0, n_cells, _BLOCK):
            if counts[k: k + _BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK], pa.int32()), pa.array([counts[k: k + _BLOCK].tobytes()], pa.binary())], names=["block", "counts"])
    return run


def _frequent(least: int):
    """Sums of a partition's blocks, as bits."""
    def run(batches):
        kind, sums = np.uint8 if least < 256 else np.uint32, {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts")):
                more = np.frombuffer(raw.as_buffer(), kind).astype(np.uint32)
                sums[k] = np.minimum(sums[k] + more, least) if k in sums else more
        for k, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(n >= least).tobytes()], pa.binary())], names=["block", "bits"])
    return run


def frequent_cells(rows: DataFrame, n_cells: int, least: int, shared=None) -> np.ndarray:
    """Bits of the cells of at least ``least``: n_cells / 8 bytes whatever the input."""
    counted = rows.mapInArrow(_count(n_cells, least, shared), "block int, counts binary")
    out = np.zeros(n_cells // 8, np.uint8)
    for r in counted.repartition(n_parts(rows.sparkSession), "block").mapInArrow(_frequent(least), "block int, bits binary").collect():
        out[r["block"] * _BLOCK // 8: (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place of a first row and number of rows of each distinct one."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.concatenate([at, [len(order)]]))


def _summed(batches: list) -> pa.Table:
    """Equal windows counted together."""
    out = pa.Table.from_batches(batches).group_by(["lang", *COLUMNS], use_threads=False).aggregate([("n", "sum")])
    return out.rename_columns([c.replace("n_sum", "n") for c in out.column_names]).select(["lang", *COLUMNS, "n"])


def _windows(shared, n_cells: int):
    """Windows of a task, counted together as far as _HELD rows go."""
    def run(batches):
        held, size = [], 0
        for made in slices(batches):
            held.append(made)
            size += made.num_rows
            if size >= 2 * _HELD:
                held = _summed(held).combine_chunks().to_batches(_BLOCK)
                size = sum(b.num_rows for b in held)
                if size >= _HELD:
                    yield from held
                    held, size = [], 0
        if held:
            yield from _summed(held).combine_chunks().to_batches(_BLOCK)

    def slices(batches):
        bits = shared.value
        for batch in batches:
            for data, start, stop, on, lang, names in _tokens(batch):
                left = _left(_cells(data, start, stop, lang, names, n_cells, LONGEST), on, bits, LONGEST)
                single, size = left[0], sum(x.astype(np.int64) for x in left)  # words of each window
                at = np.flatnonzero(single)
                texts = word_column(data, start[at], stop[at]).dictionary_encode()
                code = np.zeros(len(start) + LONGEST, np.int64)
                code[at] = texts.indices.to_numpy(zero_copy_only=False) + 1
                lead = [np.where(size[at] > k, code[at + k], 0) for k in range(LONGEST)]
                long = size[at] > 1
                first, times = _distinct([lang[at][~long], lead[0][~long]])
                more, many = _distinct([lang[at][long], *(c[long] for c in lead)])
                rest = np.bincount(lang[~single], minlength=len(names))
                few = np.flatnonzero(rest)
                own = np.concatenate([np.flatnonzero(~long)[first], np.flatnonzero(long)[more]])
                word = lambda c: texts.dictionary.take(pa.array(np.concatenate([c[own] - 1, np.zeros(len(few), np.int64)]), mask=np.concatenate([c[own] == 0, np.ones(len(few), bool)]))).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate([lang[at][own], few]))), *(word(c) for c in lead), pa.array(np.concatenate([times, many, rest[few]]).astype(np.int64))], names=["lang", *COLUMNS, "n"])
    return run


def read_together(rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows in tasks of ``task_bytes`` of the files read, two a core at least; no task is split,
    and sources of unknown size stay as they are."""
    size = input_bytes(rows)
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))) if size else rows


def windows(docs: DataFrame, min_count: int = MIN_COUNT, n_cells: int = CELLS) -> DataFrame:
    """lang, w1 to w5 and n: windows by their leading word, padded with nulls; words that no phrase
    of ``min_count`` has are counted by language alone."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = read_together(docs.select(F.col("lang").cast("string").alias("lang"), "text"))
    shared = None
    for _ in range(2):
        shared = spark.sparkContext.broadcast(frequent_cells(rows, n_cells, min_count, shared))
    counted = rows.mapInArrow(_windows(shared, n_cells), ", ".join(["lang string", *(f"{c} string" for c in COLUMNS), "n bigint"]))
    return counted.groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, n_cells: int = CELLS) -> DataFrame:
    """lang, phrase (words joined by spaces), size, f of phrases of one to five words with f >=
    ``min_count``; size 0 is the language's number of words."""
    rolled = windows(docs, min_count, n_cells).rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    size = LONGEST - F.bit_count(F.col("gid")).cast("int")
    last = F.coalesce(*[F.when(size == k, F.col(f"w{k}")) for k in range(1, LONGEST + 1)])
    whole = rolled.withColumn("size", size).where("size >= 0").where((F.col("size") == 0) | (last.isNotNull() & (F.col("f") >= min_count)))
    return whole.select("lang", F.concat_ws(" ", *COLUMNS).alias("phrase"), "size", "f")


def _whole(column: str):
    return F.col(column).cast("decimal(19,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, n_cells: int = CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to 5 words."""
    scratch = Scratch()
    counts = scratch.saved(phrase_counts(docs, min_count, n_cells), "phrases")
    total = scratch.saved(counts.where("size = 0").select("lang", F.col("f").alias("n")), "totals")
    parts = counts.where("size > 0").select("lang", "phrase", "f")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    held = F.split("phrase", " ")
    # whatever holds a phrase in longer ones holds it in one of one word more with as many occurrences
    longer = found.where("size > 2").select("lang", F.col("a").alias("b"), F.explode(F.array(F.array_join(F.slice(held, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(held, F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    stay = found.join(longer, ["lang", "phrase"], "left").where("b is null or b < a").drop("b")
    cut = stay.withColumn("cut", F.explode(F.expr("sequence(1, size - 1)")))
    cut = cut.select("*", F.array_join(F.slice(held, F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice(held, F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("tail"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(total, "lang")
    product = 1000 * (_whole("a") * _whole("n"))
    scored = cut.withColumns({"up": product.cast("decimal(38,0)"), "down": (_whole("l") * _whole("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("up div down"))
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = least.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = scratch.saved(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.clear(out)
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
