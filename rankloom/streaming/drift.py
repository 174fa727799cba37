"""A rolling hit rate over a stream of query scores, beyond the batch engine: windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_hit_rate(scores: DataFrame, ts: str = "ts", late: str = "1 hour", window: str = "1 day", slide: str = "1 hour") -> DataFrame:
    """(window, strategy, hit_rate, mrr, n) of scores (ts, strategy, hit, mrr), batch or streaming."""
    rows = scores.withWatermark(ts, late) if scores.isStreaming else scores
    return rows.groupBy(F.window(ts, window, slide), "strategy").agg(
        F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("mrr").alias("mrr"), F.count(F.lit(1)).alias("n")
    )
