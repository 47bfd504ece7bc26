"""Rolling statistics, cones, regimes, and the distribution of returns.

Trailing windows of w rows are two-sided block scans: rows are cut into blocks of w, with a scan from each block's start and one from its end. A window
is a part of one block's end and a part of the next one's start, so its moments are those of the two merged. Nothing is subtracted: a row costs the same for any
window, and what lies outside a window, an outlier say, has no influence on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import TRADING_DAYS, chi2_tail, column, norm_pdf, norm_ppf, ratio
from .metrics import numbered_returns, ret, share
from .quantiles import narrowed_quantiles
from .series import daily_returns, ordered, past, period_last

TD = float(TRADING_DAYS)


def _whole(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("series_id",)))


def window_scans(df: DataFrame, windows: tuple[int, ...], columns: tuple[str, ...] = (), products: tuple[tuple[str, str], ...] = (), sums: tuple[str, ...] = (), keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """df's rows that have `days` rows behind them (themselves included), for each of windows: its columns, days, and over those rows
    {c}_mean and {c}_ss (sum of squared deviations) of columns, {a}_{b}_sp (of products of deviations) of products, {c}_sum of sums.
    """
    named = sorted({*columns, *(c for pair in products for c in pair)})
    rows = df.withColumn("k", F.row_number().over(ordered(*keys)) - 1).withColumn("days", F.explode(F.array(*map(F.lit, windows))))
    rows = rows.withColumns({"block": F.floor(F.col("k") / F.col("days")), "i": F.col("k") % F.col("days")})
    block = Window.partitionBy(*keys, "days", "block")
    upto = lambda order: block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start, end = upto(F.asc("k")), upto(F.desc("k"))
    scans = {f"{c}_mean": F.avg(c) for c in named} | {f"{c}_var": F.var_pop(c) for c in columns} | {f"{a}_{b}_cov": F.covar_pop(a, b) for a, b in products} | {f"{c}_sum": F.sum(c) for c in sums}
    side = lambda frame: F.struct(*(scan.over(frame).alias(name) for name, scan in scans.items()))
    rows = rows.withColumns({"a": side(start), "b": side(end)})
    # The end of the block before: w - 1 rows back.
    back = None
    for w in windows:
        own = F.lag("b", w - 1).over(Window.partitionBy(*keys, "days").orderBy("k"))
        back = F.when(F.col("days") == w, own) if back is None else back.when(F.col("days") == w, own)
    rows = rows.withColumn("b", back).where(F.col("k") >= F.col("days") - 1)
    n = F.col("i") + 1
    m = F.col("days") - n
    whole, of = m == 0, lambda side, name: F.col(f"{side}.{name}")
    gap = lambda c: of("b", f"{c}_mean") - of("a", f"{c}_mean")
    shift = n * m / F.col("days")
    out = {f"{c}_mean": F.when(whole, of("a", f"{c}_mean")).otherwise(of("a", f"{c}_mean") + gap(c) * m / F.col("days")) for c in named}
    merged = lambda name, x, y: F.when(whole, of("a", name) * n).otherwise(of("a", name) * n + of("b", name) * m + gap(x) * gap(y) * shift)
    out |= {f"{c}_ss": merged(f"{c}_var", c, c) for c in columns} | {f"{x}_{y}_sp": merged(f"{x}_{y}_cov", x, y) for x, y in products}
    out |= {f"{c}_sum": F.when(whole, of("a", f"{c}_sum")).otherwise(of("a", f"{c}_sum") + of("b", f"{c}_sum")) for c in sums}
    return rows.select(*df.columns, "days", *(value.alias(name) for name, value in out.items()))


def moments_of_windows(series: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """series_id, date, days, r, mean, sd over the last `days` returns, for every window in one pass."""
    out = window_scans(daily_returns(series), windows, ("r",))
    return out.select("series_id", "date", "days", "r", F.col("r_mean").alias("mean"), F.sqrt(F.col("r_ss") / (F.col("days") - 1)).alias("sd"))


def rolling_moments(series: DataFrame, w: int) -> DataFrame:
    return moments_of_windows(series, (w,)).drop("days")


def _weekly(df: DataFrame, name: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return period_last(df.withColumnRenamed(name, "value"), "week", keys).withColumnRenamed("value", name)


def rolling_vol(series: DataFrame, *windows: int) -> DataFrame:
    """series_id, days, period, vol: the last of each week, for each window."""
    m = moments_of_windows(series, windows)
    return _weekly(m.select("series_id", "days", "date", (F.col("sd") * TD**0.5).alias("vol")), "vol", ("series_id", "days"))


def rolling_sharpe(series: DataFrame, *windows: int, rf: float = 0.0) -> DataFrame:
    m = moments_of_windows(series, windows).where("sd > 0")
    return _weekly(m.select("series_id", "days", "date", ((F.col("mean") * TD - rf) / (F.col("sd") * TD**0.5)).alias("sharpe")), "sharpe", ("series_id", "days"))


def rolling_sortino(series: DataFrame, w: int = 252, rf: float = 0.0) -> DataFrame:
    low = ret() < 0
    r = daily_returns(series).withColumns({"d": F.when(low, ret() * ret()).otherwise(F.lit(0.0)), "m": low.cast("double")})
    out = window_scans(r, (w,), sums=("r", "d", "m")).where("m_sum > 0 and d_sum > 0")
    value = (F.col("r_sum") / w * TD - rf) / (F.sqrt(F.col("d_sum") / F.col("m_sum")) * TD**0.5)
    return _weekly(out.select("series_id", "date", value.alias("sortino")), "sortino")


def rolling_beta_corr(pairs: DataFrame, w: int = 126, least: int = 150) -> DataFrame:
    """portfolio, benchmark, period, beta, corr over the last w common returns, sampled weekly; needs `least` of them."""
    keys = ("portfolio", "benchmark")
    p = pairs.withColumn("n", F.count("*").over(_whole(*keys))).where(F.col("n") >= least)
    out = window_scans(p, (w,), ("p", "b"), (("p", "b"),), keys=keys)
    vp, vb, cov = F.col("p_ss"), F.col("b_ss"), F.col("p_b_sp")
    out = out.withColumns({"beta": F.when(vb > 0, cov / vb), "corr": F.when((vb > 0) & (vp > 0), cov / (F.sqrt(vp) * F.sqrt(vb)))})
    return out.groupBy(*keys, F.next_day(F.date_sub("date", 1), "FRI").alias("period")).agg(F.max_by("beta", "date").alias("beta"), F.max_by("corr", "date").alias("corr"))


def excess_cumulative(pairs: DataFrame) -> DataFrame:
    run = past("portfolio", "benchmark")
    return pairs.select("portfolio", "benchmark", "date", (ratio(F.product(1 + F.col("p")).over(run), F.product(1 + F.col("b")).over(run)) - 1).alias("excess"))


def ewma_vol(series: DataFrame, lam: float = 0.94, block: int = 256) -> DataFrame:
    """series_id, date, vol: RiskMetrics' recursion v = lam v + (1 - lam) r^2, the present return included; v starts at the first return's square.

    Within a block of rows the recursion is a running sum of r^2 / lam^i, scaled back: powers stay small. Each block then needs
    the v that the one before ended with; these are folded over the few blocks of a series.
    """
    r = daily_returns(series).withColumn("k", F.row_number().over(ordered()) - 1)
    r = r.withColumns({"block": F.floor(F.col("k") / block), "i": F.col("k") % block})
    inside = Window.partitionBy("series_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("s", F.sum((1 - lam) * ret() * ret() * F.pow(F.lit(lam), -F.col("i"))).over(inside) * F.pow(F.lit(lam), F.col("i")))
    ends = r.groupBy("series_id", "block").agg(F.max("i").alias("last"), F.max_by("s", "i").alias("s"), F.min_by("r", "i").alias("first"))
    blocks = ends.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("block", "last", "s", "first"))).alias("b"))
    blocks = blocks.withColumn("b", F.transform("b", lambda x, i: F.struct(x["block"].alias("block"), F.aggregate(
        F.slice("b", 1, i), F.col("b")[0]["first"] * F.col("b")[0]["first"], lambda v, y: v * F.pow(F.lit(lam), y["last"] + 1) + y["s"]).alias("v"))))
    before = blocks.select("series_id", F.explode("b").alias("b")).select("series_id", "b.*")
    v = F.col("v") * F.pow(F.lit(lam), F.col("i") + 1) + F.col("s")
    return r.join(before, ["series_id", "block"]).select("series_id", "date", F.sqrt(v * TD).alias("vol"))


def vol_cone(series: DataFrame, windows: tuple[int, ...] = (21, 63, 126, 252), long: bool = False) -> DataFrame:
    """Quartiles of the volatility over windows of each length; long: by narrowed ranges, for series beyond one buffer."""
    v = moments_of_windows(series, windows).withColumn("vol", F.col("sd") * TD**0.5)
    keys, levels = ("series_id", "days"), (0.0, 0.25, 0.5, 0.75, 1.0)
    if long:
        q = narrowed_quantiles(v, keys, "vol", levels).select(*keys, F.array(*(f"q{i}" for i in range(len(levels)))).alias("q"))
        own = v.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("vol", "date").alias("current")).join(q, [*keys])
    else:
        own = v.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("vol", F.array(*map(F.lit, levels))).alias("q"), F.max_by("vol", "date").alias("current"))
    return own.where(F.col("n") >= 21).select("series_id", "days", *(F.col("q")[i].alias(c) for i, c in enumerate(("min", "p25", "median", "p75", "max"))), "current")


def worst_windows(series: DataFrame, steps: tuple[int, ...] = (5, 21, 63, 126, 252)) -> DataFrame:
    """Per number of steps: worst, best, median change, share of negative ones, and the first end of the worst."""
    changes = series.withColumn("w", F.array(*(F.struct(F.lit(g).alias("steps"), (ratio("value", F.lag("value", g).over(ordered())) - 1).alias("r")) for g in steps)))
    rows = changes.select("series_id", "date", F.explode("w").alias("w")).select("series_id", "date", "w.*").where("r is not null")
    return rows.groupBy("series_id", "steps").agg(F.min("r").alias("worst"), F.max("r").alias("best"), F.percentile("r", 0.5).alias("median"), share(ret() < 0).alias("negative"), F.min(F.struct("r", "date")).getField("date").alias("worst_end"))


def vol_regimes(series: DataFrame, w: int = 21, long: bool = False) -> DataFrame:
    """Quarters of the realised volatility, cut by value: days, mean volatility, annual return, positive days, worst day."""
    v = rolling_moments(series, w).withColumn("vol", F.col("sd") * TD**0.5)
    levels = (0.25, 0.5, 0.75)
    if long:
        q = narrowed_quantiles(v, ("series_id",), "vol", levels).select("series_id", F.array("q0", "q1", "q2").alias("q"))
    else:
        q = v.groupBy("series_id").agg(F.percentile("vol", F.array(*map(F.lit, levels))).alias("q"))
    vol = F.col("vol")
    band = F.when(vol <= F.col("q")[0], 1).when(vol <= F.col("q")[1], 2).when(vol <= F.col("q")[2], 3).otherwise(4)
    return v.join(q, "series_id").groupBy("series_id", band.alias("regime")).agg(F.count("*").alias("days"), F.avg("vol").alias("mean_vol"), (F.avg("r") * TD).alias("annual_return"), share(ret() > 0).alias("positive"), F.min("r").alias("worst_day"))


def market_phases(pairs: DataFrame) -> DataFrame:
    b = F.col("b")
    rows = pairs.where("b <> 0").withColumn("phase", F.when(b > 0, "up").otherwise("down"))
    return rows.groupBy("portfolio", "benchmark", "phase").agg(F.count("*").alias("days"), (F.avg("p") * TD).alias("portfolio_annual"), (F.avg("b") * TD).alias("benchmark_annual"), ratio(F.avg("p"), F.avg("b")).alias("capture"))


# --- distribution --------------------------------------------------------------------------------------------
def moments(series: DataFrame) -> DataFrame:
    from .series import period_returns

    d = daily_returns(series).groupBy("series_id").agg(F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurtosis"))
    m = period_returns(series, "month").groupBy("series_id").agg(F.count("r").alias("n"), F.skewness("r").alias("month_skew"), F.kurtosis("r").alias("month_kurtosis")).where("n >= 12").drop("n")
    return d.join(m, "series_id", "left")


def jarque_bera(series: DataFrame) -> DataFrame:
    d = daily_returns(series).groupBy("series_id").agg(F.count("r").alias("n"), F.skewness("r").alias("s"), F.kurtosis("r").alias("k"))
    d = d.withColumn("jb", F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4))
    return d.select("series_id", "jb", F.exp(-F.col("jb") / 2).alias("p"), (F.exp(-F.col("jb") / 2) < 0.05).alias("rejected"))


def ljung_box(series: DataFrame, lags: int = 10) -> DataFrame:
    r = daily_returns(series).withColumn("x", ret() - F.avg("r").over(_whole()))
    r = r.withColumns({f"l{k}": F.lag("x", k).over(ordered()) for k in range(1, lags + 1)})
    d = r.groupBy("series_id").agg(F.count("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), *(F.sum(F.col("x") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)))
    acf = {k: ratio(f"c{k}", "xx") for k in range(1, lags + 1)}
    total = sum((a * a / (F.col("n") - k) for k, a in acf.items()), F.lit(0.0))
    d = d.withColumn("q", F.col("n") * (F.col("n") + 2) * total)
    return d.select("series_id", "q", column(chi2_tail("q", lags)).alias("p"), *(acf[k].alias(f"acf{k}") for k in acf))


def _ranges(sizes: tuple[int, ...]):
    """Of arrays of returns: for each block size the sum and number of rescaled ranges of the array's full blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("series_id", "w", "total", "blocks")}
            for s, n, r in zip(batch.column("series_id").to_pylist(), batch.column("n").to_pylist(), batch.column("r")):
                r = r.values.to_numpy(zero_copy_only=False)
                for w in sizes:
                    x = r[: len(r) // w * w].reshape(-1, w)
                    if 2 * w > n or not len(x):
                        continue
                    run_ = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
                    sd = x.std(axis=1, ddof=1)
                    some = sd > 0
                    for c, v in zip(out, (s, w, float(((run_.max(axis=1) - run_.min(axis=1))[some] / sd[some]).sum()), int(some.sum()))):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["series_id"], batch.schema.field("series_id").type), pa.array(out["w"], pa.int32()), pa.array(out["total"], pa.float64()), pa.array(out["blocks"], pa.int64())], list(out))

    return run


def hurst(series: DataFrame, sizes: tuple[int, ...] = (10, 20, 40, 80, 160, 320)) -> DataFrame:
    """R/S exponent: slope of log mean R/S on log block size, over full blocks; null below 120 returns or 3 sizes.

    Block sizes divide the largest one: each return is read once, in an array of at most that many, which gives the ranges of all sizes.
    """
    r = numbered_returns(series).where("n >= 120").withColumn("block", F.expr(f"k div {max(sizes)}"))
    arrays = r.groupBy("series_id", "n", "block").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("r")).select("series_id", "n", F.transform("r", lambda x: x["r"]).alias("r"))
    kind = series.schema["series_id"].dataType.simpleString()
    rs = arrays.mapInArrow(_ranges(sizes), f"series_id {kind}, w int, total double, blocks long").groupBy("series_id", "w").agg(F.sum("total").alias("total"), F.sum("blocks").alias("blocks")).where("blocks > 0")
    slope = rs.groupBy("series_id").agg(F.count("*").alias("m"), F.regr_slope(F.log(F.col("total") / F.col("blocks")), F.log("w")).alias("hurst")).where("m >= 3").drop("m")
    return series.select("series_id").distinct().join(slope, "series_id", "left")


def histogram(series: DataFrame, bins: int = 41) -> DataFrame:
    """Equal bins between the least and the largest return: centre, count and what a normal distribution would have."""
    r = daily_returns(series)
    ends = r.groupBy("series_id").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n"))
    ends = ends.where("hi > lo").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    at = F.least(F.floor((ret() - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = r.join(ends, "series_id").groupBy("series_id", at.alias("bin")).agg(F.count("*").alias("count"))
    spine = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * F.col("width"))
    out = spine.join(counts, ["series_id", "bin"], "left")
    return out.select("series_id", "bin", "centre", F.coalesce("count", F.lit(0).cast("long")).alias("count"), (column(norm_pdf("centre", "mu", "sd")) * F.col("n") * F.col("width")).alias("normal"))


def qq_points(series: DataFrame, most: int = 200) -> DataFrame:
    """Ordered returns against normal quantiles at (i + 0.5) / n, every max(1, n // most)-th."""
    r = daily_returns(series)
    r = r.withColumns({"i": F.row_number().over(Window.partitionBy("series_id").orderBy("r", "date")) - 1, "n": F.count("*").over(_whole()), "mu": F.avg("r").over(_whole()), "sd": F.stddev_samp("r").over(_whole())})
    r = r.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0).withColumn("p", (F.col("i") + 0.5) / F.col("n"))
    return r.select("series_id", "i", (F.col("mu") + F.col("sd") * column(norm_ppf("p"))).alias("normal"), F.col("r").alias("observed"))
