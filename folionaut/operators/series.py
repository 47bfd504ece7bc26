"""Returns, calendar periods and windows of series: frames of series_id, date, value. Any number of series in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio

#: Presets of analysis windows and how many months they reach back (null: all; 0: since new year).
PRESETS = (("max", None), ("3y", 36), ("2y", 24), ("1y", 12), ("ytd", 0), ("6m", 6), ("3m", 3))
MIN_STEPS = 25


def ordered(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("date")


def past(*keys: str) -> Window:
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, *keys: str) -> Window:
    return ordered(*keys).rowsBetween(-(n - 1), 0)


def daily_returns(series: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """keys, date, r: change from the row before; rows without one, or with nulls, go. There is no change from a value of 0."""
    r = ratio("value", F.lag("value").over(ordered(*keys))) - 1
    return series.withColumn("r", r).where("r is not null").select(*keys, "date", "r")


def period_end(freq: str, date: str = "date", week: str = "fri") -> Column:
    """Last day of the week (ending Friday, or Sunday for ISO weeks), month, quarter or year."""
    d = F.col(date)
    if freq == "week":
        return F.next_day(F.date_sub(d, 1), "FRI" if week == "fri" else "SUN")
    if freq == "month":
        return F.last_day(d)
    if freq == "quarter":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return F.make_date(F.year(d), F.lit(12), F.lit(31))


def _period_before(freq: str, end: str) -> Column:
    if freq == "week":
        return F.date_sub(F.col(end), 7)
    return F.last_day(F.add_months(F.col(end), {"month": -1, "quarter": -3, "year": -12}[freq]))


def period_last(series: DataFrame, freq: str, keys: tuple[str, ...] = ("series_id",), week: str = "fri", value: str = "value") -> DataFrame:
    """keys, period (its last day), value: the last one of each period."""
    known = series.where(F.col(value).isNotNull())
    return known.groupBy(*keys, period_end(freq, week=week).alias("period")).agg(F.max_by(value, "date").alias(value))


def period_returns(series: DataFrame, freq: str, keys: tuple[str, ...] = ("series_id",), week: str = "fri") -> DataFrame:
    """keys, period, r; a period whose predecessor has no rows gets none."""
    last = period_last(series, freq, keys, week)
    order = Window.partitionBy(*keys).orderBy("period")
    out = last.withColumns({"before": F.lag("value").over(order), "end": F.lag("period").over(order)})
    out = out.where(F.col("end") == _period_before(freq, "period"))
    return out.select(*keys, "period", (ratio("value", "before") - 1).alias("r")).where("r is not null")


def stepped_returns(series: DataFrame, freqs: tuple[str, ...] = ("week", "month", "quarter")) -> DataFrame:
    """series_id, freq, r: the daily returns (freq day) and those of each period, from one pass over the series."""
    ends = F.array(*(F.struct(F.lit(f).alias("freq"), period_end(f).alias("period")) for f in freqs))
    rows = series.where("value is not null").select("series_id", "date", "value", F.explode(ends).alias("p")).select("series_id", "date", "value", "p.*")
    last = rows.groupBy("series_id", "freq", "period").agg(F.max_by("value", "date").alias("value"))
    order = Window.partitionBy("series_id", "freq").orderBy("period")
    out = last.withColumns({"before": F.lag("value").over(order), "end": F.lag("period").over(order)})
    due = None
    for f in freqs:
        test = (F.col("freq") == f) & (F.col("end") == _period_before(f, "period"))
        due = test if due is None else due | test
    return daily_returns(series).select("series_id", F.lit("day").alias("freq"), "r").unionByName(out.where(due).select("series_id", "freq", (ratio("value", "before") - 1).alias("r")).where("r is not null"))


def weekly_index(benchmarks: DataFrame) -> DataFrame:
    """portfolio, benchmark, period, value: the benchmark's last value of each week."""
    return period_last(benchmarks, "week", ("portfolio", "benchmark"))


def weekly_series(navs: DataFrame, capital: DataFrame) -> DataFrame:
    """portfolio, period, nav, index_pct (of the capital), drawdown: the last of each week that has rows."""
    dd = ratio("nav", F.max("nav").over(past("portfolio"))) - 1
    last = navs.withColumn("dd", dd).groupBy("portfolio", period_end("week").alias("period")).agg(F.max_by("nav", "date").alias("nav"), F.max_by("dd", "date").alias("drawdown"))
    return last.join(capital.select("portfolio", "capital"), "portfolio").select("portfolio", "period", "nav", (ratio("nav", "capital") * 100).alias("index_pct"), "drawdown")


def monthly_matrix(series: DataFrame, rounded: bool = False) -> DataFrame:
    """series_id, year, m01..m12 (percent) and total, the months compounded (after rounding to 2 places, if asked)."""
    r = period_returns(series, "month").withColumns({"year": F.year("period"), "month": F.month("period")})
    r = r.withColumn("pct", F.round(F.col("r") * 100, 2) if rounded else F.col("r") * 100)
    months = [F.max(F.when(F.col("month") == m, F.col("pct"))).alias(f"m{m:02d}") for m in range(1, 13)]
    return r.groupBy("series_id", "year").agg(*months, ((F.product(1 + F.col("pct") / 100) - 1) * 100).alias("total"))


def annual_returns(series: DataFrame) -> DataFrame:
    """series_id, year, r, partial, from_date, to_date; the first year starts from the first value."""
    last = period_last(series, "year")
    ends = series.groupBy("series_id").agg(F.min("date").alias("d0"), F.max("date").alias("d1"), F.min_by("value", "date").alias("v0"))
    order = Window.partitionBy("series_id").orderBy("period")
    out = last.join(ends, "series_id").withColumns({"before": F.lag("value").over(order), "end": F.lag("period").over(order)})
    first, final = F.col("end").isNull(), F.year("period") == F.year("d1")
    usable = out.where(first | (F.col("end") == _period_before("year", "period")))
    year = F.year("period")
    return usable.select(
        "series_id", year.alias("year"),
        (ratio("value", F.when(first, F.col("v0")).otherwise(F.col("before"))) - 1).alias("r"),
        ((first & (F.month("d0") > 1)) | final).alias("partial"),
        F.when(first, F.col("d0")).otherwise(F.make_date(year, F.lit(1), F.lit(1))).alias("from_date"),
        F.when(final, F.col("d1")).otherwise(F.col("period")).alias("to_date"),
    )


def quarterly_returns(series: DataFrame) -> DataFrame:
    label = F.concat_ws(" Q", F.year("period").cast("string"), F.quarter("period").cast("string"))
    return period_returns(series, "quarter").select("series_id", label.alias("quarter"), "r")


def seasonality(series: DataFrame) -> DataFrame:
    """Twelve rows per series: n, mean, median, share of positive months of each calendar month."""
    r = period_returns(series, "month").withColumn("month", F.month("period"))
    own = r.groupBy("series_id", "month").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.percentile("r", 0.5).alias("median"), F.avg((F.col("r") > 0).cast("double")).alias("positive"))
    spine = series.select("series_id").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return spine.join(own, ["series_id", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def rolling_compound(series: DataFrame, months: int) -> DataFrame:
    """series_id, period, r over the last `months` monthly returns; only full windows."""
    order = Window.partitionBy("series_id").orderBy("period").rowsBetween(-(months - 1), 0)
    out = period_returns(series, "month").withColumns({"n": F.count("r").over(order), "r": F.product(1 + F.col("r")).over(order) - 1})
    return out.where(F.col("n") == months).select("series_id", "period", "r")


def rolling_summary(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("series_id").agg(F.percentile("r", 0.5).alias("median"), F.min("r").alias("min"), F.max("r").alias("max"), F.avg((F.col("r") > 0).cast("double")).alias("positive"), F.count("r").alias("n"))


# --- windows of analysis -------------------------------------------------------------------------------------
def window_places(series: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """series_id, window, i, j: the places (0: first) of the first and last row of each window of analysis_windows.

    A bound's place is the number of the series' rows before it, counted in one pass over rows and bounds: no row meets a window.
    """
    ends = series.groupBy("series_id").agg(F.min("date").alias("d0"), F.max("date").alias("d1"), (F.count("*") - 1).alias("last"))
    if explicit is None:
        names = F.array(*(F.struct(F.lit(name).alias("window"), F.lit(m).cast("int").alias("months")) for name, m in PRESETS))
        bounds = ends.select("*", F.explode(names).alias("w")).select("*", "w.window", "w.months")
        a = F.when(F.col("months").isNull(), F.col("d0")).when(F.col("months") == 0, F.trunc("d1", "year")).otherwise(F.expr("add_months(d1, -months)"))
        bounds = bounds.withColumns({"a": a, "b": F.col("d1")})
    else:
        bounds = ends.join(explicit, "series_id")
    bounds = bounds.select("series_id", "window", "last", F.coalesce("a", "d0").alias("a"), F.coalesce("b", "d1").alias("b"))
    asked = bounds.select("series_id", "window", "last", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("a").alias("date")), F.struct(F.lit(1).alias("end"), F.col("b").alias("date")))).alias("e")).select("series_id", "window", "last", "e.*")
    rows = series.select("series_id", "date", F.lit(1).alias("row")).unionByName(asked.withColumn("row", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("series_id").orderBy("date", "row").rowsBetween(Window.unboundedPreceding, 0)  # on one date the bound comes first
    at = rows.withColumn("k", F.sum("row").over(upto)).where("row = 0").withColumn("k", F.when(F.col("k") <= F.col("last"), F.col("k")))
    at = at.groupBy("series_id", "window", "last").agg(F.max(F.when(F.col("end") == 0, F.col("k"))).alias("i"), F.max(F.when(F.col("end") == 1, F.col("k"))).alias("j"))
    at = at.withColumn("i", F.coalesce("i", F.lit(0))).withColumn("j", F.least(F.col("last"), F.greatest(F.col("i") + 1, F.coalesce("j", "last"))))
    short = F.col("j") - F.col("i") < MIN_STEPS
    at = at.withColumn("j2", F.when(short, F.least(F.col("last"), F.col("i") + MIN_STEPS)).otherwise(F.col("j")))
    at = at.withColumn("i2", F.when(F.col("j2") - F.col("i") < MIN_STEPS, F.greatest(F.lit(0), F.col("j2") - MIN_STEPS)).otherwise(F.col("i")))
    return at.select("series_id", "window", F.col("i2").cast("long").alias("i"), F.col("j2").cast("long").alias("j"))


def analysis_windows(series: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """series_id, window, lo, hi: every preset of every series, or explicit bounds (series_id, window, a, b).

    Each bound moves to the first date at or after it; a window of fewer than 25 steps is lengthened forwards, then backwards.
    """
    numbered = series.select("series_id", "date", (F.row_number().over(ordered()) - 1).cast("long").alias("k"))
    date_at = lambda k, name: numbered.select("series_id", F.col("k").alias(k), F.col("date").alias(name))
    return window_places(series, explicit).join(date_at("i", "lo"), ["series_id", "i"]).join(date_at("j", "hi"), ["series_id", "j"]).select("series_id", "window", "lo", "hi")


def windowed(series: DataFrame, windows: DataFrame) -> DataFrame:
    """series_id (with the window's name), parent, window, date, value: an equi-join on the series, then the range of dates."""
    out = series.join(windows, "series_id").where(F.col("date").between(F.col("lo"), F.col("hi")))
    return out.select(F.concat_ws("|", "series_id", "window").alias("series_id"), F.col("series_id").alias("parent"), "window", "date", "value")


def rebase_100(series: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return series.withColumn("value", ratio("value", F.first("value").over(past(*keys))) * 100)


def thin_series(series: DataFrame, most: int = 170) -> DataFrame:
    """Every p-th row, p = ceil(n / most), and the last one."""
    counted = series.withColumns({"k": F.row_number().over(ordered()) - 1, "n": F.count("*").over(Window.partitionBy("series_id"))})
    return counted.where((F.col("k") % F.ceil(F.col("n") / most) == 0) | (F.col("k") == F.col("n") - 1)).drop("k", "n")


def round_publish(df: DataFrame, percent: tuple[str, ...] = (), two: tuple[str, ...] = (), four: tuple[str, ...] = ()) -> DataFrame:
    """Rounded for output: percent x 100 to 2 places, others to 2 or 4; null where not finite."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return df.withColumns({c: F.round(finite(c) * 100, 2) for c in percent} | {c: F.round(finite(c), 2) for c in two} | {c: F.round(finite(c), 4) for c in four})


def attribution_window(components: DataFrame, navs: DataFrame, windows: DataFrame) -> DataFrame:
    """Per portfolio, window and symbol: weights at both ends, drift, return, contribution (p.p. of the portfolio's start), volatility, drawdown.

    components: with a column window, only the rows of each window already (nav.held_components), else all.
    """
    w = windows.withColumnRenamed("series_id", "portfolio")
    inside = lambda df: df.join(w, "portfolio").where(F.col("date").between(F.col("lo"), F.col("hi")))
    ends = lambda df, v, *keys: df.groupBy("portfolio", "window", *keys)
    total = ends(inside(navs), "nav").agg(F.min_by("nav", "date").alias("n0"), F.max_by("nav", "date").alias("n1"))
    keys = [*(["chunk"] if "chunk" in components.columns else []), "symbol"]
    order = Window.partitionBy("portfolio", "window", *keys).orderBy("date")
    known = components.where("value is not null")
    parts = (known if "window" in components.columns else inside(known)).withColumns({"r": ratio("value", F.lag("value").over(order)) - 1, "dd": ratio("value", F.max("value").over(order.rowsBetween(Window.unboundedPreceding, 0))) - 1})
    own = ends(parts, "value", *keys).agg(F.min_by("value", "date").alias("c0"), F.max_by("value", "date").alias("c1"), F.stddev_samp("r").alias("sd"), F.min("dd").alias("max_dd"))
    out = own.join(total, ["portfolio", "window"])
    return out.select(
        "portfolio", "window", "symbol", ratio("c0", "n0").alias("weight_start"), ratio("c1", "n1").alias("weight_end"),
        (ratio("c1", "n1") - ratio("c0", "n0")).alias("drift"), (ratio("c1", "c0") - 1).alias("r"),
        (ratio(F.col("c1") - F.col("c0"), "n0") * 100).alias("contribution_pp"), (F.col("sd") * F.sqrt(F.lit(252.0))).alias("vol"), "max_dd",
    )
