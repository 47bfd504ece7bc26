"""Bars as they arrive: the last one of each symbol and day, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(raw: DataFrame, key: str, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """symbol, date, close of a stream of bars; a day is final, and given out in append mode, once the watermark has passed it.

    State is one row per symbol and open day. Of bars at one instant, the larger value counts.
    """
    raw = raw.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need a zone
    day = F.window(ts, "1 day").alias("day")
    last = raw.withWatermark(ts, late).groupBy(F.col(key).alias("symbol"), day).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(value).cast("double").alias("close"))).alias("last"))
    return last.select("symbol", F.to_date("day.start").alias("date"), F.col("last.close").alias("close"))
