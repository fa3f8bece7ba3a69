"""The corpus pipeline: five operators, each on what the one before kept.

1. language_id: documents that the identification rejects go.
2. ngram_jaccard_join: of each group of linked documents that with the smallest id stays.
3. suffix_array_dedup: strings of 100 bytes that stand earlier are cut out of the texts.
4. decontamination: documents in which a benchmark window occurs go.
5. sentencepiece: the texts as token ids with the scores of their n best segmentations.

Stages 1 to 4 return the columns of ``documents``; a document that becomes empty in
stage 3 stays, with an empty text.

Defined cases: a null or empty text goes in stage 1, as no language is found in it; equal
rows are one node in stage 2 and stay both; rows with a null doc_id are never linked, and
come last in stage 3; very long texts go through every stage whole; an empty table gives no
rows; extra columns of any name are kept
through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statespan.llm import decontamination, jaccard_join, language, segmentation, suffix_dedup
from statespan.llm._common import discard, saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.learn(language.training_rows(docs)))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentation.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", sentencepiece),
]
#: Compression, components and best-first search have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
