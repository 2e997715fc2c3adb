"""Ordered scans (running sums, last value, neighbour) that never put a whole key into one task.

A plain window over (key) sorts all rows of a hot key in one task. Here rows are windowed by (key, bucket),
one summary row per bucket is scanned in the order of the buckets, and its carry is joined back. Buckets must follow
the order: rows of a lower bucket come first.

Keys travel as structs: a struct is never null, and equal if its fields are, nulls among them, so the rows stay where the window put them
for the join. Null keys are a key of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which nulls equal nulls; the right's keys are dropped."""
    r = right.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__rk"), *[c for c in right.columns if c not in keys])
    lk = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return left.withColumn("__lk", lk).join(r, F.col("__lk") == F.col("__rk"), "left").drop("__lk", "__rk")


class _Buckets:
    """A table with its keys and bucket as one struct, and the windows of a scan."""

    def __init__(self, df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str]):
        self.df = df.withColumn("__kb", F.struct(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"), F.col(bucket).alias("b")))
        self.here = Window.partitionBy("__kb").orderBy(*order)
        self.past = Window.partitionBy("__kb.k").orderBy("__kb.b").rowsBetween(Window.unboundedPreceding, -1)

    def joined(self, rows: DataFrame, tops: DataFrame) -> DataFrame:
        return rows.join(tops.withColumnRenamed("__kb", "__tb"), F.col("__kb") == F.col("__tb"), "left").drop("__kb", "__tb")


def running_sum(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, out: str, before: bool = False) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the key up to this one (before: without this one). Nulls count 0."""
    s = _Buckets(df.withColumn("__v", F.coalesce(value.cast("long"), F.lit(0))), keys, bucket, order)
    tops = s.df.groupBy("__kb").agg(F.sum("__v").alias("__s"))
    tops = tops.select("__kb", F.coalesce(F.sum("__s").over(s.past), F.lit(0)).alias("__c"))
    rows = s.df.withColumn("__w", F.sum("__v").over(s.here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = s.joined(rows, tops)
    return d.withColumn(out, F.col("__w") + F.col("__c") - (F.col("__v") if before else F.lit(0))).drop("__v", "__w", "__c")


def last_value(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, out: str, before: bool = False) -> DataFrame:
    """Adds `out`: the last non-null `value` up to this row (before: strictly before it); null where there is none."""
    s = _Buckets(df.withColumn("__v", value), keys, bucket, order)
    at = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col("__v").alias("v"))
    tops = s.df.groupBy("__kb").agg(F.max(F.when(F.col("__v").isNotNull(), at))["v"].alias("__t"))
    tops = tops.select("__kb", F.last("__t", ignorenulls=True).over(s.past).alias("__c"))
    rows = s.df.withColumn("__w", F.last("__v", ignorenulls=True).over(s.here.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)))
    d = s.joined(rows, tops)
    return d.withColumn(out, F.coalesce("__w", "__c")).drop("__v", "__w", "__c")
