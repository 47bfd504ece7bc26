"""Performance and risk metrics: one row per series. A metric whose sample is too small is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EULER, TRADING_DAYS, Z, Z95_SUMMARY, column, norm_cdf, norm_ppf, ratio
from .drawdown import drawdown_episodes, max_drawdown
from .quantiles import narrowed_quantiles
from .series import daily_returns, ordered, past, period_returns, rolling_compound, rolling_summary, stepped_returns

TD = float(TRADING_DAYS)


def ret() -> Column:
    return F.col("r")


def share(test: Column) -> Column:
    return F.avg(test.cast("double"))


def sample_info(series: DataFrame, rf: float = 0.0) -> DataFrame:
    ends = series.groupBy("series_id").agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"))
    out = ends.withColumn("years", F.greatest(F.datediff("to_date", "from_date") / 365.25, F.lit(1e-9)))
    counts = {"n_daily": "day", "n_weekly": "week", "n_monthly": "month", "n_quarterly": "quarter"}
    n = stepped_returns(series).groupBy("series_id").agg(*(F.count(F.when(F.col("freq") == f, ret())).alias(name) for name, f in counts.items()))
    out = out.join(n, "series_id", "left").withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name in counts})
    return out.withColumn("rf", F.lit(rf))


def growth(series: DataFrame) -> DataFrame:
    """series_id, total, cagr, years."""
    e = series.groupBy("series_id").agg(F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    years = F.greatest(F.col("days") / 365.25, F.lit(1e-9))
    return e.select("series_id", (ratio("v1", "v0") - 1).alias("total"), (F.pow(ratio("v1", "v0"), 1 / years) - 1).alias("cagr"), years.alias("years"))


def return_stats(series: DataFrame) -> DataFrame:
    columns = []
    for f in ("day", "week", "month", "quarter"):
        own = F.when(F.col("freq") == f, ret())
        columns += [F.max(own).alias(f"best_{f}"), F.min(own).alias(f"worst_{f}"), share(own > 0).alias(f"positive_{f}")]
    mean = (F.avg(F.when(F.col("freq") == "day", ret())) * TD).alias("mean_annual")
    return growth(series).drop("years").join(stepped_returns(series).groupBy("series_id").agg(*columns, mean), "series_id", "left")


def win_loss(series: DataFrame) -> DataFrame:
    d = daily_returns(series).groupBy("series_id").agg(
        F.avg(F.when(ret() > 0, ret())).alias("mean_gain"), F.avg(F.when(ret() < 0, ret())).alias("mean_loss"),
        F.coalesce(F.sum(F.when(ret() > 0, ret())), F.lit(0.0)).alias("gains"), F.sum(F.when(ret() < 0, ret())).alias("losses"), F.avg("r").alias("expectancy"),
    )
    m = period_returns(series, "month").groupBy("series_id").agg(ratio(F.sum("r"), F.abs(F.sum(F.when(ret() < 0, ret())))).alias("gain_to_pain"))
    out = d.join(m, "series_id", "left")
    return out.select("series_id", "mean_gain", "mean_loss", ratio("mean_gain", F.abs("mean_loss")).alias("win_loss"), ratio("gains", F.abs("losses")).alias("profit_factor"), "gain_to_pain", "expectancy")


def streaks(series: DataFrame) -> DataFrame:
    """Longest runs of positive and of negative days."""
    r = daily_returns(series).withColumns({"up": F.sum((ret() <= 0).cast("int")).over(past()), "down": F.sum((ret() >= 0).cast("int")).over(past())})
    longest = lambda group, test, name: r.groupBy("series_id", group).agg(F.sum(test.cast("int")).alias("n")).groupBy("series_id").agg(F.max("n").alias(name))
    return longest("up", ret() > 0, "longest_up").join(longest("down", ret() < 0, "longest_down"), "series_id")


def numbered_returns(series: DataFrame) -> DataFrame:
    """Returns with position k (0: first) and number n in their series."""
    return daily_returns(series).withColumns({"k": F.row_number().over(ordered()) - 1, "n": F.count("*").over(Window.partitionBy("series_id"))})


def ewma_last(lam: float = 0.94) -> Column:
    """Last EWMA volatility from k, n and r: the recursion written out. v starts at the first return's square."""
    weights = F.sum((1 - lam) * F.pow(F.lit(lam), F.col("n") - 1 - F.col("k")) * ret() * ret())
    start = F.max(F.when(F.col("k") == 0, F.pow(F.lit(lam), F.col("n")) * ret() * ret()))
    return F.sqrt((weights + start) * TD)


def volatility(series: DataFrame) -> DataFrame:
    r = numbered_returns(series)
    tail = lambda days: F.stddev_samp(F.when(F.col("n") - F.col("k") <= days, ret())) * TD**0.5
    out = r.groupBy("series_id").agg((F.stddev_samp("r") * TD**0.5).alias("vol_daily"), tail(30).alias("vol_30"), tail(90).alias("vol_90"), ewma_last().alias("vol_ewma"))
    longer = lambda f, k: (F.stddev_samp(F.when(F.col("freq") == f, ret())) * F.sqrt(F.lit(k))).alias(f"vol_{f}ly")
    return out.join(stepped_returns(series, ("week", "month")).groupBy("series_id").agg(longer("week", 52.0), longer("month", 12.0)), "series_id", "left")


def downside(threshold: float = 0.0) -> Column:
    """Downside deviation of r over the days below the threshold only; 0 if there are none."""
    low = F.when(ret() < threshold, (ret() - threshold) * (ret() - threshold))
    return F.coalesce(F.sqrt(F.avg(low)), F.lit(0.0))


def downside_risk(series: DataFrame) -> DataFrame:
    d = daily_returns(series).groupBy("series_id").agg(downside().alias("dsd"))
    return d.select("series_id", (F.col("dsd") * TD**0.5).alias("downside_deviation"), (F.col("dsd") * F.col("dsd") * TD).alias("semivariance"))


def quantiles(returns: DataFrame, *levels: float, long: bool = False) -> DataFrame:
    """series_id and one exact, interpolated quantile per level: in one pass, or (long) in several with a bounded buffer."""
    if long:
        return narrowed_quantiles(returns, ("series_id",), "r", levels).drop("n")
    q = returns.groupBy("series_id").agg(F.percentile("r", F.array(*(F.lit(x) for x in levels))).alias("q"))
    return q.select("series_id", *(F.col("q")[i].alias(f"q{i}") for i in range(len(levels))))


def var_cvar(series: DataFrame, long: bool = False) -> DataFrame:
    """Historical, Gaussian, Cornish-Fisher VaR and CVaR at 95 and 99 percent, daily; historical on months if there are 12."""
    r = daily_returns(series)
    q = quantiles(r, 0.05, 0.01, long=long)
    tails = r.join(q, "series_id").groupBy("series_id").agg(
        F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("s"), F.kurtosis("r").alias("k"),
        F.max("q0").alias("q95"), F.max("q1").alias("q99"), F.avg(F.when(ret() <= F.col("q0"), ret())).alias("t95"), F.avg(F.when(ret() <= F.col("q1"), ret())).alias("t99"),
    )
    s, k = F.col("s"), F.col("k")
    columns = []
    for level, z in Z.items():
        zcf = z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
        columns += [(-F.col(f"q{level}")).alias(f"hist_{level}"), (z * F.col("sd") - F.col("mu")).alias(f"gauss_{level}"), (zcf * F.col("sd") - F.col("mu")).alias(f"cornish_fisher_{level}"), (-F.col(f"t{level}")).alias(f"cvar_{level}")]
    return tails.select("series_id", *columns).join(month_tails(series), "series_id", "left")


def month_tails(series: DataFrame) -> DataFrame:
    m = period_returns(series, "month")
    own = m.join(quantiles(m, 0.05), "series_id").groupBy("series_id").agg(F.count("r").alias("n"), F.max("q0").alias("q"), F.avg(F.when(ret() <= F.col("q0"), ret())).alias("t"))
    return own.where("n >= 12").select("series_id", (-F.col("q")).alias("month_hist_95"), (-F.col("t")).alias("month_cvar_95"))


def scaled_var(series: DataFrame) -> DataFrame:
    d = daily_returns(series).groupBy("series_id").agg((F.stddev_samp("r") * TD**0.5).alias("vol"))
    v = F.col("vol")
    return d.select(
        "series_id", (Z[95] * v * (5 / TD) ** 0.5).alias("var95_week"), (Z[95] * v * (21 / TD) ** 0.5).alias("var95_month"), (Z[95] * v).alias("var95_year"),
        (Z[99] * v * (21 / TD) ** 0.5).alias("var99_month"), (Z95_SUMMARY * v * (5 / TD) ** 0.5).alias("var95_week_summary"),
    )


def tail_ratios(series: DataFrame, long: bool = False) -> DataFrame:
    r = daily_returns(series)
    pf = r.groupBy("series_id").agg(ratio(F.coalesce(F.sum(F.when(ret() > 0, ret())), F.lit(0.0)), F.abs(F.sum(F.when(ret() < 0, ret())))).alias("pf"))
    out = quantiles(r, 0.95, 0.05, long=long).join(pf, "series_id").withColumn("tail_ratio", ratio("q0", F.abs("q1")))
    return out.select("series_id", "tail_ratio", (F.col("tail_ratio") * F.col("pf")).alias("common_sense_ratio"))


def _base(series: DataFrame, rf: float) -> DataFrame:
    """series_id, n, mu, sd, s, k, dsd, sr."""
    d = daily_returns(series).groupBy("series_id").agg(F.count("r").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("s"), F.kurtosis("r").alias("k"), downside().alias("dsd"))
    vol = F.col("sd") * TD**0.5
    return d.withColumn("sr", F.when(F.col("sd") > 0, (F.col("mu") * TD - rf) / vol).otherwise(F.lit(0.0)))


def sharpe_block(series: DataFrame, rf: float = 0.0) -> DataFrame:
    d = _base(series, rf)
    daily = F.col("sr") / TD**0.5
    d = d.withColumn("se", F.sqrt((1 + 0.5 * daily * daily) / F.col("n")) * TD**0.5)
    return d.select(
        "series_id", F.col("sr").alias("sharpe"), F.col("se").alias("sharpe_error"), (F.col("sr") - 1.96 * F.col("se")).alias("sharpe_low"), (F.col("sr") + 1.96 * F.col("se")).alias("sharpe_high"),
        F.when(F.col("dsd") > 0, F.col("mu") * TD / (F.col("dsd") * TD**0.5)).alias("sortino"),
    )


def psr_dsr(series: DataFrame, rf: float = 0.0, n_trials: int = 6) -> DataFrame:
    """Probabilistic Sharpe ratio against 0, and deflated: against the expected best of n_trials. Null below 30 returns."""
    d = _base(series, rf).withColumn("d", F.col("sr") / TD**0.5)
    d = d.withColumn("den", F.sqrt(1 - F.col("s") * F.col("d") + (F.col("k") + 2) / 4 * F.col("d") * F.col("d")))
    best = f"((1.0e0 - {EULER}e0) * {norm_ppf(f'(1.0e0 - 1.0e0 / {n_trials}.0e0)')} + {EULER}e0 * {norm_ppf(f'(1.0e0 - 1.0e0 / ({n_trials}.0e0 * exp(1.0e0)))')})"
    d = d.withColumns({"x": F.col("d") * F.sqrt(F.col("n") - 1) / F.col("den"), "y": (F.col("d") - column(best) / F.sqrt(F.col("n") - 1)) * F.sqrt(F.col("n") - 1) / F.col("den")})
    enough = (F.col("n") >= 30) & (F.col("den") > 0)
    return d.select("series_id", F.when(enough, column(norm_cdf("x"))).alias("psr"), F.when(enough & F.lit(n_trials >= 2), column(norm_cdf("y"))).alias("dsr"))


def drawdown_ratios(series: DataFrame, rounded: bool = False) -> DataFrame:
    """Calmar, Sterling (5 deepest), Burke (8 deepest), Martin, pain ratio, recovery factor; depths unrounded unless asked."""
    depth = F.round(F.col("depth") * 100, 2) / 100 if rounded else F.col("depth")
    e = drawdown_episodes(series).withColumn("p", depth).where("p <> 0").withColumn("k", F.row_number().over(Window.partitionBy("series_id").orderBy("rank")))
    e = e.groupBy("series_id").agg(F.avg(F.when(F.col("k") <= 5, F.col("p"))).alias("five"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("root"))
    d = growth(series).join(max_drawdown(series), "series_id").join(e, "series_id", "left")
    fell = F.col("max_dd") < 0
    return d.select(
        "series_id", F.when(fell, F.col("cagr") / F.abs("max_dd")).alias("calmar"), ratio("cagr", F.abs("five")).alias("sterling"), ratio("cagr", "root").alias("burke"),
        F.when(F.col("ulcer") > 0, F.col("cagr") / F.col("ulcer")).alias("martin"), F.when(F.col("pain") > 0, F.col("cagr") / F.col("pain")).alias("pain_ratio"), F.when(fell, F.col("total") / F.abs("max_dd")).alias("recovery_factor"),
    )


def omega_kappa(series: DataFrame) -> DataFrame:
    d = daily_returns(series).groupBy("series_id").agg(F.coalesce(F.sum(F.when(ret() > 0, ret())), F.lit(0.0)).alias("up"), F.sum(F.when(ret() <= 0, -ret())).alias("down"), F.avg(F.when(ret() < 0, -ret() * ret() * ret())).alias("lpm"), F.avg("r").alias("mu"))
    kappa = F.col("mu") * TD / (F.pow("lpm", F.lit(1 / 3)) * TD ** (1 / 3))
    return d.select("series_id", F.when(F.col("down") > 0, F.col("up") / F.col("down")).alias("omega"), F.when(F.col("lpm") > 0, kappa).alias("kappa3"))


def summary_stats(series: DataFrame) -> DataFrame:
    """The compact block: ratios fall back to 0, monthly moments are bias-corrected and need 12 months."""
    d = daily_returns(series)
    base = d.groupBy("series_id").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), downside().alias("dsd"), F.max("r").alias("best_day"), F.min("r").alias("worst_day"), share(ret() > 0).alias("days_positive"))
    m = period_returns(series, "month")
    months = m.groupBy("series_id").agg(F.count("r").alias("months_n"), share(ret() > 0).alias("months_positive"), F.max("r").alias("best_month"), F.min("r").alias("worst_month"), F.skewness("r").alias("s"), F.kurtosis("r").alias("k"))
    rolled = rolling_summary(rolling_compound(series, 12)).select("series_id", *(F.col(c).alias(f"rolling12_{c}") for c in ("median", "min", "max", "positive", "n")))
    out = growth(series).join(base, "series_id").join(quantiles(d, 0.05), "series_id").join(max_drawdown(series), "series_id").join(months, "series_id", "left").join(month_tails(series), "series_id", "left").join(rolled, "series_id", "left")
    n = F.col("months_n")
    skew = F.when(n >= 12, F.col("s") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 12, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))
    return out.select(
        "series_id", "total", "cagr", (F.col("sd") * TD**0.5).alias("vol"), F.when(F.col("sd") > 0, F.col("mu") / F.col("sd") * TD**0.5).otherwise(F.lit(0.0)).alias("sharpe"),
        F.when(F.col("dsd") > 0, F.col("mu") / F.col("dsd") * TD**0.5).otherwise(F.lit(0.0)).alias("sortino"), F.when(F.col("max_dd") < 0, F.col("cagr") / F.abs("max_dd")).otherwise(F.lit(0.0)).alias("calmar"),
        "max_dd", (-F.col("q0")).alias("var95_day"), (Z95_SUMMARY * F.col("sd") * TD**0.5 * (5 / TD) ** 0.5).alias("var95_week"), "best_day", "worst_day", "days_positive",
        F.coalesce("months_n", F.lit(0).cast("long")).alias("months_n"), "months_positive", "best_month", "worst_month", "month_hist_95", "month_cvar_95", skew.alias("month_skew"), kurt.alias("month_kurtosis"),
        "rolling12_median", "rolling12_min", "rolling12_max", "rolling12_positive", F.coalesce("rolling12_n", F.lit(0).cast("long")).alias("rolling12_n"),
    )
