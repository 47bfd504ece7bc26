"""Drawdowns: series, depth, episodes, time under water."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .series import ordered, past


def drawdown_series(series: DataFrame) -> DataFrame:
    """dd: the fall from the highest value so far; null while that is 0."""
    return series.withColumn("dd", ratio("value", F.max("value").over(past())) - 1)


def max_drawdown(series: DataFrame) -> DataFrame:
    """series_id, max_dd, its first date, ulcer, pain."""
    d = drawdown_series(series)
    return d.groupBy("series_id").agg(
        F.min("dd").alias("max_dd"), F.min(F.struct("dd", "date")).getField("date").alias("max_dd_date"),
        F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"), (-F.avg("dd")).alias("pain"),
    )


def drawdown_episodes(series: DataFrame, top: int | None = 8, ties: str = "first") -> DataFrame:
    """One row per episode, deepest first: peak, trough, recovery (null: ongoing), depth and durations in days.

    The peak is the first (or last) date of the running maximum from which the episode falls.
    """
    before = F.max("value").over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    rises = F.col("value") > before if ties == "first" else F.col("value") >= before
    d = drawdown_series(series).withColumns({
        "peak": F.last(F.when(before.isNull() | rises, F.col("date")), ignorenulls=True).over(past()),
        "starts": ((F.col("dd") < 0) & (F.coalesce(F.lag("dd").over(ordered()), F.lit(0.0)) >= 0)).cast("int"),
        "next": F.lead("date").over(ordered()),
        "end": F.max("date").over(Window.partitionBy("series_id")),
    })
    d = d.withColumn("episode", F.sum("starts").over(past())).where("dd < 0")
    e = d.groupBy("series_id", "episode").agg(
        F.min("peak").alias("peak"), F.min(F.struct("dd", "date")).alias("low"), F.max_by("next", "date").alias("recovery"),
        F.min("date").alias("start"), F.max("end").alias("end"),
    )
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("depth", "start"))
    e = e.select("series_id", "start", "peak", F.col("low.date").alias("trough"), "recovery", F.col("low.dd").alias("depth"), "end").withColumn("rank", rank)
    e = e if top is None else e.where(F.col("rank") <= top)
    return e.select(
        "series_id", "rank", "peak", "trough", "recovery", "depth", F.datediff("trough", "peak").alias("days_down"),
        F.datediff("recovery", "trough").alias("days_to_recover"), F.datediff(F.coalesce("recovery", "end"), "peak").alias("days_total"),
        F.col("recovery").isNull().alias("ongoing"),
    )


def underwater_time(series: DataFrame) -> DataFrame:
    d = drawdown_series(series).groupBy("series_id").agg(F.avg((F.col("dd") < -1e-12).cast("double")).alias("share_under"), F.coalesce(F.avg(F.when(F.col("dd") < 0, F.col("dd"))), F.lit(0.0)).alias("mean_dd"))
    e = drawdown_episodes(series, top=None).groupBy("series_id").agg(F.avg("days_total").alias("mean_days"), F.max("days_total").alias("max_days"), F.count("*").alias("episodes"))
    out = d.join(e, "series_id", "left")
    return out.select("series_id", "share_under", "mean_dd", F.coalesce("mean_days", F.lit(0.0)).alias("mean_days"), F.coalesce("max_days", F.lit(0)).alias("max_days"), F.coalesce("episodes", F.lit(0).cast("long")).alias("episodes"))
