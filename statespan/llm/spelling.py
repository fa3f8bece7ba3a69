"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles.

Words are counted over all documents by DataFrame functions, counts combined before the
shuffle. Of two words one edit apart, the longer of m code points, the common prefix and the
common suffix together cover m - 1 of them, so one of the two covers half of that: such words share
their first or their last ceil((m - 1) / 2) code points, and only words that do are compared. Within
such a group the words, in order, are cut into blocks, padded matrices of code points; each pair
of blocks is a tile, in which the lengths of common prefixes and suffixes of all pairs of words
come out of one comparison of the matrices. A pair is near if they differ and prefix plus suffix
reach m - 1. A hot group becomes many tiles, which are dealt out apart; only near pairs leave one.

Each word's form is its near word of largest count, if that has at least ``ratio`` times its own
count; roots come from doubling these pointers, each round an equi-join of the words.

Defined cases: a null text has no words; a null id counts as an empty one where words are
deleted from; rows that are equal count each; runs of any length are compared whole, a block
has as many words as its bytes allow; a word without near words has neither form nor form_n and
is its own root; ties go to the word that comes first by code points; no words at all give no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, table

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: One run in so many, by its hash, loses a code point.
DELETE_EVERY = 97
#: Of a block: its words, and the bytes of its matrix.
BLOCK_WORDS, _BLOCK_BYTES = 256, 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dented(run: Column, doc_id: Column, every: int = DELETE_EVERY) -> Column:
    """The run without one of its code points, if the CRC of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.overlay(run, F.lit(""), at + 1, F.lit(1))).otherwise(run)


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int | None = DELETE_EVERY) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z in lower case; ``every``: see ``dented``."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    long = runs.where(F.length("run") >= min_chars)
    word = F.col("run") if every is None else dented(F.col("run"), F.col("doc_id"), every)
    return long.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & (F.length("word") >= min_chars))


# -- tiles ----------------------------------------------------------------------

def _codes(words: list[str], width: int, pad: int, right: bool) -> np.ndarray:
    """Code points, padded after the word or before it."""
    out = np.full((len(words), width), pad, np.uint32)
    for i, w in enumerate(words):
        own = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        out[i, slice(width - len(own), width) if right else slice(len(own))] = own
    return out


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading columns agree, for each row of x with each of y."""
    alike = np.ones((len(x), len(y)), bool)
    n = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        alike &= x[:, k][:, None] == y[:, k][None, :]
        if not alike.any():
            break
        n += alike
    return n


def near_in_tile(a: list[str], b: list[str], longer: int, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of words one edit apart, the longer one of ``longer`` code points. With
    ``by_suffix`` only those whose common prefix is too short for them to meet by it."""
    la, lb = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    prefix = _common(_codes(a, longer, 0x110000, False), _codes(b, longer, 0x110001, False))
    suffix = _common(_codes(a, longer, 0x110000, True)[:, ::-1], _codes(b, longer, 0x110001, True)[:, ::-1])
    near = (prefix + suffix >= longer - 1) & (np.maximum(la[:, None], lb[None, :]) == longer) & ~((prefix == longer) & (la[:, None] == lb[None, :]))
    if by_suffix:
        near &= prefix < shared_length(longer)
    return np.nonzero(near)


def shared_length(longer: int) -> int:
    """What words one edit apart share at one end at least."""
    return longer // 2


def _tile(batches):
    for batch in batches:
        for r in batch.to_pylist():
            same = r["i"] == r["j"]
            x, y = near_in_tile(r["a"], r["b"], r["longer"], r["by_suffix"])
            if same:
                x, y = x[x < y], y[x < y]
            yield pa.RecordBatch.from_arrays([pa.array([r["a"][i] for i in x], pa.string()), pa.array([r["b"][i] for i in y], pa.string())], names=["a", "b"])


def near_pairs(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(a, b): each pair of different words one edit apart, once. ``words`` has word, each once."""
    scratch, size = Scratch(), F.length("word")
    half = F.expr("longer div 2")
    ends = words.select("word", size.alias("size"), F.explode(F.array(size, size + 1)).alias("longer"))
    ends = ends.select("word", "longer", F.explode(F.array(F.struct(F.lit(False).alias("by_suffix"), F.substring("word", F.lit(1), half).alias("end")), F.struct(F.lit(True).alias("by_suffix"), F.right("word", half).alias("end")))).alias("e")).select("word", "longer", "e.*")
    key = ["longer", "by_suffix", "end"]
    # how many blocks a group has, from its count; a word's block is a function of the word, so no group is sorted or gathered
    least = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(_BLOCK_BYTES / (4 * F.col("longer"))))).cast("bigint")
    sizes = ends.groupBy(*key).agg(F.count("*").alias("n_words")).where("n_words > 1").select(*key, F.ceil(F.col("n_words") / least).cast("int").alias("n_blocks"))
    sizes = scratch.saved(sizes, "ends")
    placed = ends.join(sizes, key).select(*key, "n_blocks", F.pmod(F.xxhash64("word"), F.col("n_blocks")).cast("int").alias("i"), "word")
    blocks = scratch.saved(placed.groupBy(*key, "n_blocks", "i").agg(F.collect_list("word").alias("words")), "blocks")
    # each tile (i, j), i <= j, is a key at which its two blocks meet
    left = blocks.select(*key, F.explode(F.expr("sequence(i, n_blocks - 1)")).alias("j"), "i", F.col("words").alias("a"))
    right = blocks.select(*key, F.explode(F.expr("sequence(0, i)")).alias("i"), F.col("i").alias("j"), F.col("words").alias("b"))
    pairs = left.join(right, [*key, "i", "j"]).select("longer", "by_suffix", "i", "j", "a", "b")
    return pairs.mapInArrow(_tile, "a string, b string"), scratch


def variants(words: DataFrame, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n)."""
    scratch = Scratch()
    words = scratch.saved(words.select("word", "n"), "words")
    pairs, tiles = near_pairs(words, block_words)
    near = scratch.saved(pairs, "near")
    tiles.clear()
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # the largest count first, of those the first word: a minimum over (-n, word)
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False)))
    formed = scratch.saved(formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("has"), F.col("best.b")).alias("form"), F.when(F.col("has"), -F.col("best.m")).alias("form_n")), "formed")
    up = scratch.saved(formed.where("form is not null").select("word", F.col("form").alias("root")), "up")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("then"))
        new = scratch.saved(up.join(further, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "up")
        moved = not new.where("moved").isEmpty()
        up = new.select("word", "root")
        if not moved:
            break
    out = scratch.saved(formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    scratch.clear(out)
    return out


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))
