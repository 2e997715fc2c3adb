"""Sources mixed to target weights (problem 9): capped water-filling over tokens."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.operators.scan import running_sum
from cuewright.session import cut

#: Slices of the seeded order of a source; no task orders more than one slice.
SLICES = 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "tokens", tokenizer: str | None = None) -> DataFrame:
    """Adds `out`: the tokens of the text; 0 where it is null."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf(T.LongType())
    def count(x: pd.Series) -> pd.Series:
        return pd.Series([len(t) for t in _encoder(path).encode_ordinary_batch([t or "" for t in x], num_threads=1)], dtype="int64")

    return df.withColumn(out, count(F.col(f"`{text}`")))


def water_fill(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Rows (source, target_share, max_repeat, size, wanted, whole, rest), one a target: its share of `total` (all there is), clamped at max_repeat times its size; what that leaves over goes to the others by their shares, until none is over.

    sizes: (source, size). Sources are clamped in the order of (what they can give / share): one is if it can give no more than its share of what those before it leave. If all are
    clamped the total cannot be reached, and all give what they can. whole and rest: the times a source is used in full, and what is then missing. One row a source is sorted in one task, which may
    spill; the driver holds nothing. Null sources are left out; a source listed twice has its shares added and the smaller cap.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeat").alias("max_repeat"))
    p = t.join(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("size")), "source", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    share, most = F.coalesce("target_share", F.lit(0.0)), F.col("size") * F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).cast("double")
    p = p.withColumn("most", most).withColumn("open", (share > 0) & (most > 0))
    p = p.withColumn("ratio", F.when(F.col("open"), F.try_divide(F.col("most"), share))).withColumn("gives", F.when(F.col("open"), F.col("most")).otherwise(0.0)).withColumn("asks", F.when(F.col("open"), share).otherwise(0.0))
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("ratio").asc_nulls_last(), "source")
    whole = Window.partitionBy(F.lit(0))
    all_ = F.sum(F.col("size").cast("double")).over(whole) if total is None else F.lit(float(total))
    left = F.greatest(all_ - F.coalesce(F.sum("gives").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0))
    p = p.withColumn("level", F.try_divide(left, F.sum("asks").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    level = F.max(F.when(F.col("open") & (F.col("ratio") > F.col("level")), F.col("level"))).over(whole)
    wanted = F.when(~F.col("open"), 0.0).otherwise(F.least("most", F.coalesce(level, F.lit(float("inf"))) * share))
    p = p.withColumn("target_share", share).withColumn("wanted", wanted)
    times = F.least(F.floor(F.col("wanted") / F.greatest("size", F.lit(1)) + 1e-9), F.coalesce("max_repeat", F.lit(0))).cast("int")
    return p.withColumn("whole", times).select("source", "target_share", "max_repeat", "size", "wanted", "whole", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole") * F.col("size")).alias("rest"))


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, total: float | None = None, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): rows (doc_id, source, tokens, copies) of the documents used, and rows (source, target_share, max_repeat, size, wanted, tokens, epochs, share), one a target.

    Each document is used floor(epochs) times; the fraction left is filled by documents in a seeded order until its tokens are reached, so a
    source misses its tokens by less than one document. Tokens are counted where the texts lie: only (id, source, tokens, fingerprint) is shuffled. Null ids and sources, sources without target and documents without a token are not used; a repeated document
    id counts once, with its least source and, of these, the least fingerprint of a text; a source listed twice has its shares added and the smaller cap; nothing is sampled but that fraction, which is the feature.
    """
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("t")).where("doc_id is not null and source is not null")
    d = with_tokens(d, "t", "tokens", tokenizer).select("doc_id", F.struct("source", F.xxhash64("t").alias("h"), "tokens").alias("x"))
    d = d.groupBy("doc_id").agg(F.min("x").alias("x")).select("doc_id", "x.source", "x.tokens").where("tokens > 0")
    listed = targets.select(F.col("source")).where("source is not null").distinct()
    d = cut(d.join(listed, "source", "left_semi"))  # read twice; tokens are counted once
    p = cut(water_fill(d.groupBy("source").agg(F.sum("tokens").alias("size")), targets.select("source", "target_share", "max_repeat"), total))
    u = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    o = d.withColumn("u", u).withColumn("b", F.shiftrightunsigned("u", 52))
    o = o.withColumn("u", F.shiftrightunsigned("u", 1))
    o = running_sum(o, ["source"], "b", ["u", "doc_id"], F.col("tokens"), "upto")
    o = o.join(p.select("source", "whole", "rest"), "source")
    # The document across the edge is taken if more than half of it lies within.
    o = o.withColumn("copies", F.col("whole") + F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    o = o.where("copies > 0").select("doc_id", "source", "tokens", F.col("copies").cast("int").alias("copies"))
    got = o.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    share = F.coalesce("tokens", F.lit(0)) / F.greatest(F.sum("tokens").over(Window.partitionBy(F.lit(0))), F.lit(1))  # one row a source
    s = p.join(got, "source", "left").select(
        "source", "target_share", "max_repeat", "size", "wanted", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.greatest("size", F.lit(1))).alias("epochs"), share.alias("share"),
    )
    return o, s
