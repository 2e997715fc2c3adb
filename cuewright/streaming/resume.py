"""Runs that can be stopped and taken up again: what is done is skipped, failures are not counted as done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(wanted: DataFrame, done: DataFrame, key: str = "video_id") -> DataFrame:
    """The rows of `wanted` whose key is not done; failed results (failed not null) do not count as done."""
    ok = done.where("failed is null") if "failed" in done.columns else done
    return wanted.join(ok.select(key).distinct(), key, "left_anti")


def tally(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def process_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "video_id") -> None:
    """Run `work` over the files that came to `source` (JSON lines) since the last call, and append results to `sink` (Parquet).

    A batch that was interrupted is run again from the checkpoint; rows whose key the sink already holds without failure are skipped, so a batch written twice counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        have = s._jvm.org.apache.hadoop.fs.Path(sink)
        exists = have.getFileSystem(s._jsc.hadoopConfiguration()).exists(have)
        todo = pending(batch.dropDuplicates([key]), s.read.parquet(sink), key) if exists else batch.dropDuplicates([key])
        work(todo).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).json(source)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def silence_sessions(cues: DataFrame, gap_ms: int = 2000, late: str = "1 hour") -> DataFrame:
    """(video_id, start_ms, end_ms, cues): runs of cues with less than `gap_ms` between one's end and the next one's start, as session windows; works on streams and tables. Cues later than `late` behind the newest are dropped by a stream's watermark."""
    t = cues.withColumn("at", F.timestamp_millis("start_ms")).withColumn("long", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    gap = F.concat((F.col("long") + gap_ms).cast("string"), F.lit(" milliseconds"))
    if cues.isStreaming:
        t = t.withWatermark("at", late)
    g = t.groupBy("video_id", F.session_window("at", gap).alias("w")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("cues"))
    return g.select("video_id", "start_ms", "end_ms", "cues")
