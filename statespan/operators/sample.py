"""Samples of an exact size, the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_sample(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """``size`` rows of each group (all, if it has fewer): those whose keys have the smallest MD5,
    ties by key. Each task keeps so many of a group before anything is shuffled, as a window
    limited by its rank does; no group is sorted whole, and nothing comes to the driver."""
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    order = Window.partitionBy(group).orderBy(digest, key)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= size).drop("_rank")


def labelled(rows: DataFrame, fen: str, value: str) -> DataFrame:
    """Rows as lines of text, ``FEN = VALUE``."""
    return rows.select(F.concat_ws(" = ", fen, value).alias("line"))
