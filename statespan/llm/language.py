"""Language identification by compression.

One zstandard raw-content dictionary per language; a text, lower-cased and
without anything but letters, is compressed with each of them, piece by piece
so that the dictionary matters along the whole text, and the language of the
smallest total wins. When the margin to the second language is narrow the
document is rejected.

The dictionaries are the only thing learned, from ``SAMPLE_DOCS`` labelled rows per
language at most (different texts, those of the smallest hashes), each row whole. That
number of rows is the only bound. Prediction reads whole texts and nothing but texts.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
is rejected; equal sizes go to the language with more different labelled texts, then to the
alphabetically first; without any labelled text every document is ``und``; equal
labelled rows count once; long texts are compressed whole, piece by piece; rows are
never merged or dropped by ``identify``; an empty table gives no rows; extra columns of
any name are ignored, and kept by ``keep_identified``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, others, restored, saved, small_batches, table

SAMPLE_DOCS = 128
PIECE_BYTES = 2048
LEVEL = 3
#: So many per cent more bytes make a language half as likely, for the score.
HALF_LIFE = 5.0
#: Rejected if the second language needs less than this many per cent more bytes.
MIN_MARGIN = 0.5
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    """Lower case, with one space for each run of anything but letters."""
    return _NOT_LETTERS.sub(" ", text.lower())


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """{language: dictionary} from the rows with text and lang.

    A first pass takes the ``sample_docs`` smallest hashes of different texts of each language, by
    a window that keeps no more a task; the second fetches their texts. No share is guessed, so
    copies cost a language nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    different = saved(rows.select("lang", "h").distinct(), "labelled")
    counts = {r["lang"]: r["count"] for r in different.groupBy("lang").count().collect()}
    sample = different.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample_docs)
    # at most sample_docs rows of a hash a language, as are the texts below
    ranked = rows.join(F.broadcast(sample), ["lang", "h"]).groupBy("lang", "k").agg(F.min("text").alias("text"))
    parts: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "k").collect():
        parts.setdefault(r["lang"], []).append(r["text"])
    discard(different)
    order = sorted(parts, key=lambda lang: (-counts[lang], lang))
    return {lang: " ".join(dict.fromkeys(map(normalised, parts[lang]))).encode() for lang in order}


class _Sizes:
    """Compressed size of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, piece: int):
        self.piece = piece
        self.tools = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, raw: bytes) -> list[int]:
        pieces = [raw[i: i + self.piece] for i in range(0, len(raw), self.piece)]
        return [sum(len(t.compress(p)) for p in pieces) for t in self.tools]


def _predict(shared, level: int, piece: int, with_text: bool):
    def run(batches):
        dictionaries = shared.value
        names, sizes = list(dictionaries), _Sizes(dictionaries, level, piece)
        for batch in batches:
            langs, scores, margins = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                if not names or not text or not _LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    margins.append(0.0)
                    continue
                got = np.array(sizes(normalised(text).encode()), dtype=float)
                best = int(got.argmin())
                rest = np.delete(got, best)
                langs.append(names[best])
                scores.append(float(1 / np.exp2((got[best] - got) / got[best] * 100 / HALF_LIFE).sum()))
                margins.append(float(100 * (rest.min() - got[best]) / got[best]) if len(rest) else 100.0)
            kept = [c for c in ("row", "text") if c == "row" or with_text]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=[*kept, "lang_pred", "score", "margin"])
    return run


def _identified(rows: DataFrame, dictionaries: dict[str, bytes], level: int, piece: int, min_margin: float, with_text: bool = False) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(dictionaries)
    schema = rows.select("row", *["text"] * with_text, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin")).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(_predict(shared, level, piece, with_text), schema).withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < min_margin))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, piece_bytes: int = PIECE_BYTES, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score (share of the winner, HALF_LIFE per cent more bytes being
    worth a factor of two), margin (per cent more bytes that the second language needs), rejected."""
    rows = docs.select(F.col("doc_id").alias("row"), "text")
    return _identified(rows, dictionaries, level, piece_bytes, min_margin).withColumnRenamed("row", "doc_id")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents that are not rejected, columns as they came."""
    rows = docs.select(others(docs), "text")
    return restored(_identified(rows, dictionaries, LEVEL, PIECE_BYTES, min_margin, with_text=True).where("not rejected"), docs)


def training_rows(docs: DataFrame) -> DataFrame:
    """All but the held-out quarter, which is known by the CRC of the id."""
    return docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(training_rows(docs)))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
