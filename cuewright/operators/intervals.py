"""Intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, bucket: int = 600_000) -> DataFrame:
    """Rows (what, *keys, start, end): the longest continuous periods of each key, and the gaps between one and the next.

    Sort by start, running maximum of the ends before, an island where a start lies beyond it. No task holds a whole key:
    rows are first reduced to one per (key, start), then windowed by (key, bucket of start) with the maximum of the
    buckets before carried in, so a bucket has at most `bucket` distinct starts however hot its key.

    Rows with a null bound, or whose end is not after the start, are left out; intervals that touch are one period; repeated
    rows count once; a null key is a key of its own; an empty table gives no rows; all other columns are ignored.
    """
    s, e = F.col("__s"), F.col("__e")
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])  # a struct is never null, and equal if its fields are, nulls among them
    rows = df.select(key.alias("k"), F.col(f"`{start}`").cast("long").alias("__s"), F.col(f"`{end}`").cast("long").alias("__e")).where(e > s)
    rows = rows.select(F.struct("k", F.floor(s / F.lit(bucket)).alias("b")).alias("__kb"), "__s", "__e").groupBy("__kb", "__s").agg(F.max("__e").alias("__e"))

    of_key = Window.partitionBy("__kb.k")
    tops = rows.groupBy("__kb").agg(F.max("__e").alias("__m"))
    carry = F.max("__m").over(of_key.orderBy("__kb.b").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col("__kb").alias("__tb"), carry.alias("__carry"), F.max("__m").over(of_key).alias("__last"))

    here = Window.partitionBy("__kb").orderBy("__s")
    rows = rows.withColumn("__p", F.max("__e").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(tops, F.col("__kb") == F.col("__tb")).withColumn("__prev", F.greatest("__p", "__carry"))
    starts = rows.where(F.col("__prev").isNull() | (s > F.col("__prev"))).select("__kb", "__s", "__prev", "__last")

    # An island ends at the maximum before the next island's start; the last one of a key at the key's maximum.
    heads = starts.groupBy("__kb").agg(F.min_by("__prev", "__s").alias("__first"))
    heads = heads.select(F.col("__kb").alias("__hb"), F.lead("__first").over(of_key.orderBy("__kb.b")).alias("__next"))
    starts = starts.withColumn("__lead", F.lead("__prev").over(here)).join(heads, F.col("__kb") == F.col("__hb"))
    stop = F.coalesce("__lead", "__next", "__last")
    period = F.struct(F.lit("period").alias("what"), s.alias("a"), stop.alias("z"))
    gap = F.struct(F.lit("gap").alias("what"), F.col("__prev").alias("a"), s.alias("z"))
    out = starts.select("__kb.k", F.explode(F.when(F.col("__prev").isNull(), F.array(period)).otherwise(F.array(period, gap))).alias("x"))
    return out.select(F.col("x.what").alias("what"), *[F.col(f"k.k{i}").alias(k) for i, k in enumerate(keys)], F.col("x.a").alias(start), F.col("x.z").alias(end))
