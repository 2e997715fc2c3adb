"""Queries over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators.intervals import periods_and_gaps
from cuewright.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    spans = None
    for name in ("segments", "sponsors_removed"):
        t = table(spark, d, name).select(F.lit(name).alias("origin"), "video_id", "start_ms", "end_ms")
        spans = t if spans is None else spans.unionByName(t)
    return periods_and_gaps(spans, ["origin", "video_id"], "start_ms", "end_ms")


QUERIES = {"p5_found": p5_found}
SQL = {
    "p5_found": """
WITH u AS (SELECT DISTINCT 'segments' AS origin, video_id, start_ms, end_ms FROM segments WHERE end_ms > start_ms
           UNION ALL SELECT DISTINCT 'sponsors_removed', video_id, start_ms, end_ms FROM sponsors_removed WHERE end_ms > start_ms),
m AS (SELECT *, max(end_ms) OVER (PARTITION BY origin, video_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM u),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR start_ms > p THEN 1 ELSE 0 END) OVER (PARTITION BY origin, video_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM m),
q AS (SELECT origin, video_id, g, min(start_ms) AS s, max(end_ms) AS e FROM i GROUP BY origin, video_id, g),
x AS (SELECT *, lag(e) OVER (PARTITION BY origin, video_id ORDER BY g) AS before FROM q)
SELECT 'period' AS what, origin, video_id, s AS start_ms, e AS end_ms FROM q
UNION ALL SELECT 'gap', origin, video_id, before, s FROM x WHERE before IS NOT NULL""",
}
