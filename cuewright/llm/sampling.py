"""Bounded samples that are the same at every run, whatever the order and number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text a model is fitted on; of longer ones it sees a piece of so many, from wherever their hash says.
FIT_CHARS = 10_000


def least_hashes(df: DataFrame, column: str, size: int) -> list[str]:
    """The different values of `column` with the least hashes, `size` at most; one that is repeated counts once.

    Only values whose hash lies in a share of all hashes are made distinct and sorted, else every task would send `size` values to the driver: one that would hold some four times as
    many if no value were repeated, and eight times that again until it holds enough or everything.
    """
    d = df.select(F.col(f"`{column}`").alias("t")).where(F.col("t").isNotNull()).withColumn("h", F.xxhash64("t"))
    share = 4 * size / max(1, df.count())
    while True:
        some = d if share >= 1 else d.where(F.col("h") < int(-(2**63) + 2**64 * share))
        found = [r.t for r in some.distinct().orderBy("h", "t").limit(size).collect()]
        if len(found) == size or share >= 1:
            return found
        share *= 8


def fit_texts(df: DataFrame, column: str, size: int) -> list[str]:
    """Texts to fit a model on, long ones in pieces."""
    t = F.col(f"`{column}`")
    begin = F.pmod(F.xxhash64(t), F.length(t) - FIT_CHARS + 1).cast("int") + 1
    return least_hashes(df.select(F.when(F.length(t) <= FIT_CHARS, t).otherwise(F.substring(t, begin, F.lit(FIT_CHARS))).alias(column)), column, size)
