"""Benchmark-relative metrics, correlations, risk decomposition and block bootstrap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import TRADING_DAYS, ratio
from .drawdown import max_drawdown
from .heldrisk import decomposed
from .metrics import growth
from .series import daily_returns, ordered

TD = float(TRADING_DAYS)
BLOCK = 21
SEED = 4_091


def benchmark_metrics(pairs: DataFrame, navs: DataFrame, benchmarks: DataFrame, rf: float = 0.0) -> DataFrame:
    """One row per portfolio and benchmark with at least 60 common returns. navs: series; benchmarks: portfolio, benchmark, date, value."""
    p, b = F.col("p"), F.col("b")
    up, down = b > 0, b < 0
    prod = lambda test, x: F.product(F.when(test, 1 + x).otherwise(F.lit(1.0)))
    d = pairs.groupBy("portfolio", "benchmark").agg(
        F.count("*").alias("n"), F.regr_slope("p", "b").alias("beta"), F.regr_intercept("p", "b").alias("alpha"), F.corr("p", "b").alias("corr"),
        F.stddev_samp(p - b).alias("te"), F.avg("p").alias("mp"), F.avg("b").alias("mb"), F.stddev_samp("p").alias("sp"), F.stddev_samp("b").alias("sb"),
        F.sum(up.cast("int")).alias("n_up"), F.sum(down.cast("int")).alias("n_down"), prod(up, p).alias("pu"), prod(up, b).alias("bu"), prod(down, p).alias("pd"), prod(down, b).alias("bd"),
        F.regr_slope(F.when(up, p), F.when(up, b)).alias("beta_up"), F.regr_slope(F.when(down, p), F.when(down, b)).alias("beta_down"), F.avg((p > b).cast("double")).alias("batting"),
    ).where("n >= 60")
    key = F.concat_ws("|", "portfolio", "benchmark").alias("series_id")
    as_series = benchmarks.select(key, "date", "value")
    own = growth(as_series).select("series_id", F.col("total").alias("b_total"), F.col("cagr").alias("b_cagr")).join(max_drawdown(as_series).select("series_id", F.col("max_dd").alias("b_max_dd")), "series_id")
    total = growth(navs).select(F.col("series_id").alias("portfolio"), F.col("total").alias("p_total"))
    d = d.withColumn("series_id", key).join(own, "series_id").join(total, "portfolio")
    te, vol_p, vol_b = F.col("te") * TD**0.5, F.col("sp") * TD**0.5, F.col("sb") * TD**0.5
    annual = lambda x, n: F.pow(F.col(x), TD / F.greatest(F.col(n), F.lit(1))) - 1
    sharpe = F.when(F.col("sp") > 0, (F.col("mp") * TD - rf) / vol_p).otherwise(F.lit(0.0))
    return d.select(
        "portfolio", "benchmark", "beta", (F.col("alpha") * TD).alias("alpha"), "corr", (F.col("corr") * F.col("corr")).alias("r2"), te.alias("tracking_error"),
        F.when(F.col("te") > 0, (F.col("mp") - F.col("mb")) * TD / te).alias("information_ratio"),
        F.when(F.col("n_up") > 5, ratio(annual("pu", "n_up"), annual("bu", "n_up"))).alias("up_capture"), F.when(F.col("n_down") > 5, ratio(annual("pd", "n_down"), annual("bd", "n_down"))).alias("down_capture"),
        F.when(F.col("n_up") > 20, F.col("beta_up")).alias("beta_up"), F.when(F.col("n_down") > 20, F.col("beta_down")).alias("beta_down"), "batting", (rf + sharpe * vol_b).alias("m2"),
        F.col("b_total").alias("bench_total"), F.col("b_cagr").alias("bench_cagr"), vol_b.alias("bench_vol"), F.col("b_max_dd").alias("bench_max_dd"), (F.col("p_total") - F.col("b_total")).alias("excess_return"), "n",
    )


def component_returns(components: DataFrame) -> DataFrame:
    """portfolio, symbol, date, r on the dates on which all of the portfolio's components have one; rows and size of the portfolio."""
    order = Window.partitionBy("portfolio", "symbol").orderBy("date")
    r = components.select("portfolio", "symbol", "date", (ratio("value", F.lag("value").over(order)) - 1).alias("r"))
    size = components.groupBy("portfolio").agg(F.countDistinct("symbol").alias("size"))
    days = r.groupBy("portfolio", "date").agg(F.count("r").alias("have")).join(size, "portfolio").where("have = size")
    days = days.select("portfolio", "date", F.count("*").over(Window.partitionBy("portfolio")).alias("rows"), "size")
    return r.join(days, ["portfolio", "date"]).select("portfolio", "symbol", "date", "r", "rows", "size")


TILE = 128  # symbols on a side of a tile
SPAN = 512  # calendar days of a partial product
_SUMS = "portfolio string, ti int, tj int, n long, names_i array<string>, names_j array<string>, mean_i array<double>, mean_j array<double>, ss_i array<double>, ss_j array<double>, c array<double>"


def _products(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one span and pair of tiles: the number of dates, means and squares of both tiles' symbols, and the matrix of products of deviations."""
    at, side, r = (rows.column(c).to_numpy() for c in ("at", "side", "r"))
    _, day = np.unique(rows.column("day").to_numpy(), return_inverse=True)
    names = np.array(rows.column("symbol").to_pylist(), dtype=object)

    def tile(s: int) -> tuple[list[str], np.ndarray]:
        own = side == s
        out = np.zeros((day.max() + 1, at[own].max() + 1))
        out[day[own], at[own]] = r[own]
        named = np.empty(out.shape[1], dtype=object)
        named[at[own]] = names[own]
        return list(named), out

    (names_i, x), (names_j, y) = tile(0), tile(1 if (side == 1).any() else 0)
    mx, my = x.mean(axis=0), y.mean(axis=0)
    dx, dy = x - mx, y - my
    arrays = [names_i, names_j, mx, my, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx.T @ dy).ravel()]
    names_ = ("names_i", "names_j", "mean_i", "mean_j", "ss_i", "ss_j", "c")
    one = {"portfolio": [key[0].as_py()], "ti": pa.array([key[2].as_py()], pa.int32()), "tj": pa.array([key[3].as_py()], pa.int32()), "n": [len(x)]}
    return pa.table(one | {name: [list(x)] for name, x in zip(names_, arrays)})


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    """The spans of a pair of tiles merged: a row for each two symbols i <= j."""
    done = None
    for row in rows.to_pylist():
        own = [row["n"], *(np.array(row[c]) for c in ("mean_i", "mean_j", "ss_i", "ss_j")), np.array(row["c"]).reshape(len(row["mean_i"]), -1)]
        if done is None:
            done = own
            continue
        n, m = done[0], own[0]
        gi, gj = own[1] - done[1], own[2] - done[2]
        w = n * m / (n + m)
        done = [n + m, done[1] + gi * m / (n + m), done[2] + gj * m / (n + m), done[3] + own[3] + gi * gi * w, done[4] + own[4] + gj * gj * w, done[5] + own[5] + np.outer(gi, gj) * w]
    n, _, _, ss_i, ss_j, c = done
    names_i, names_j = (rows.column(x)[0].as_py() for x in ("names_i", "names_j"))
    i, j = np.nonzero(np.triu(np.ones(c.shape, dtype=bool)) if key[1] == key[2] else np.ones(c.shape, dtype=bool))
    norm = np.sqrt(ss_i[i]) * np.sqrt(ss_j[j])
    with np.errstate(all="ignore"):
        corr, cov = np.where(norm > 0, c[i, j] / norm, np.nan), c[i, j] / (n - 1)
    named = lambda names, k: pa.array(np.array(names, dtype=object)[k], pa.string())
    same = pa.array([key[0].as_py()] * len(i), pa.string())
    return pa.table({"portfolio": same, "i": named(names_i, i), "j": named(names_j, j), "n": pa.array(np.full(len(i), n)), "cov": pa.array(cov, from_pandas=True), "corr": pa.array(corr, from_pandas=True)})


def gram(returns: DataFrame, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """portfolio, i, j (i <= j by name), n, cov, corr of the components' returns (complete dates only).

    A blocked Gram matrix: symbols are numbered and cut into tiles, dates into spans. Two tiles of one span meet as dense matrices of at most span x tile; their product and
    means are one row, and spans are merged. A return is sent once for each tile of its portfolio, never once for each other symbol.
    """
    rank = F.row_number().over(Window.partitionBy("portfolio").orderBy("symbol")) - 1
    placed = returns.select("portfolio", "symbol").distinct().withColumn("rank", rank).withColumn("tiles", F.max("rank").over(Window.partitionBy("portfolio")))
    placed = placed.select("portfolio", "symbol", F.expr(f"rank div {tile}").cast("int").alias("tile"), F.expr(f"rank % {tile}").cast("int").alias("at"), F.expr(f"tiles div {tile}").cast("int").alias("last"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("last")), lambda u: F.struct(F.least("tile", u).alias("ti"), F.greatest("tile", u).alias("tj"), (F.col("tile") > u).cast("int").alias("side")))
    rows = returns.join(placed.withColumn("p", F.explode(pairs)), ["portfolio", "symbol"])
    rows = rows.select("portfolio", F.expr(f"unix_date(date) div {span}").alias("span"), "p.ti", "p.tj", "p.side", "at", F.unix_date("date").alias("day"), "symbol", "r")
    partial = rows.groupBy("portfolio", "span", "ti", "tj").applyInArrow(_products, _SUMS)
    return partial.groupBy("portfolio", "ti", "tj").applyInArrow(_merged, "portfolio string, i string, j string, n long, cov double, corr double")


def corr_matrix(returns: DataFrame, least: int = 40) -> DataFrame:
    """A portfolio of one component has its own row, as in SQL."""
    return gram(returns.where(F.col("rows") >= least)).select("portfolio", "i", "j", "corr")


def cov_matrix(returns: DataFrame, least: int = 60) -> DataFrame:
    return gram(returns.where(F.col("rows") >= least)).select("portfolio", "i", "j", (F.col("cov") * TD).alias("cov"))


def corr_benchmark(returns: DataFrame, benchmark_returns: DataFrame) -> DataFrame:
    b = benchmark_returns.select("portfolio", "benchmark", "date", F.col("r").alias("b"))
    return returns.join(b, ["portfolio", "date"]).groupBy("portfolio", "symbol", "benchmark").agg(F.corr("r", "b").alias("corr"))


def risk_decomposition(components: DataFrame, navs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per component: weight, volatility, contribution, share, component VaR, beta; per portfolio: totals and concentration)."""
    cov = cov_matrix(component_returns(components))
    both = cov.unionByName(cov.where("i <> j").select("portfolio", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    last = components.groupBy("portfolio", "symbol").agg(F.max_by("value", "date").alias("v"))
    w = last.join(navs.groupBy("portfolio").agg(F.max_by("nav", "date").alias("nav")), "portfolio").select("portfolio", "symbol", ratio("v", "nav").alias("w"))
    wi, wj = w.select("portfolio", F.col("symbol").alias("i"), F.col("w").alias("wi")), w.select("portfolio", F.col("symbol").alias("j"), F.col("w").alias("wj"))
    rows = both.join(wi, ["portfolio", "i"]).join(wj, ["portfolio", "j"])
    per = rows.groupBy("portfolio", "i", "wi").agg(F.sum(F.col("cov") * F.col("wj")).alias("cw"), F.sqrt(F.sum(F.when(F.col("i") == F.col("j"), F.col("cov")))).alias("vol"))
    return decomposed(per)


SWEEPS = 30
CELLS = 1 << 22  # matrix cells of a batch of portfolios


def jacobi(m: np.ndarray) -> np.ndarray:
    """Eigenvalues (batch, n) of symmetric matrices (batch, n, n) by Jacobi rotations, all matrices at once.

    A sweep is n - 1 rounds as of a tournament (n even, else one index sits out): the pairs of a round share no index, so their rotations are one step.
    """
    a = m.astype(np.float64).copy()
    n = a.shape[1]
    players = list(range(n + n % 2))
    scale = np.abs(a).max(axis=(1, 2), initial=0)
    for _ in range(SWEEPS if n > 1 else 0):
        off = np.abs(a - np.einsum("bii,ij->bij", a, np.eye(n))).max(axis=(1, 2))
        if (off <= 1e-17 * scale).all():
            break
        for _ in range(len(players) - 1):
            pairs = [sorted(x) for x in zip(players[: len(players) // 2], players[::-1]) if max(x) < n]
            p, q = (np.array([x[side] for x in pairs]) for side in (0, 1))
            apq = a[:, p, q]
            with np.errstate(all="ignore"):
                tau = (a[:, q, q] - a[:, p, p]) / (2 * apq)
                t = np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau))
            t = np.where((apq == 0) | ~np.isfinite(t), 0.0, t)
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            x, y = a[:, :, p], a[:, :, q]
            a[:, :, p], a[:, :, q] = c[:, None, :] * x - s[:, None, :] * y, s[:, None, :] * x + c[:, None, :] * y
            x, y = a[:, p, :], a[:, q, :]
            a[:, p, :], a[:, q, :] = c[:, :, None] * x - s[:, :, None] * y, s[:, :, None] * x + c[:, :, None] * y
            players = [players[0], players[-1], *players[1:-1]]
    return np.einsum("bii->bi", a)


def _bets(key: tuple, rows: pa.Table) -> pa.Table:
    n = key[0].as_py()
    upper = rows.column("upper").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    m = np.zeros((rows.num_rows, n, n))
    i, j = np.triu_indices(n)
    m[:, i, j] = m[:, j, i] = upper
    e = jacobi(m)
    e = np.where(e > 1e-14, e, 0.0)
    with np.errstate(all="ignore"):
        p = e / e.sum(axis=1, keepdims=True)
        bets = np.exp(-np.where(p > 0, p * np.log(p), 0).sum(axis=1))
    return pa.table({"portfolio": rows.column("portfolio"), "effective_bets": pa.array(np.where(e.sum(axis=1) > 0, bets, np.nan), from_pandas=True)})


def effective_bets(components: DataFrame) -> DataFrame:
    """exp of the entropy of the covariance's eigenvalues, of portfolios of two components and more; null if there is no variance. Portfolios of one size are solved in batches."""
    return bets(cov_matrix(component_returns(components).where("size >= 2")))


def bets(cov: DataFrame) -> DataFrame:
    """effective_bets of covariances (portfolio, i, j, cov; i <= j)."""
    upper = cov.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))).alias("m"))
    upper = upper.select("portfolio", F.sqrt(F.size("m") * 2).cast("int").alias("size"), F.transform("m", lambda x: x["cov"]).alias("upper"))  # n (n + 1) / 2 cells
    batches = upper.groupBy("size").agg(F.ceil(F.count("*") * F.col("size") * F.col("size") / CELLS).cast("int").alias("batches"))
    rows = upper.join(batches, "size").withColumn("batch", F.pmod(F.xxhash64("portfolio"), F.col("batches")))
    return rows.groupBy("size", "batch").applyInArrow(_bets, "portfolio string, effective_bets double")


# --- bootstrap -----------------------------------------------------------------------------------------------
def block_summaries(series: DataFrame, block: int = BLOCK, rests: tuple[int, ...] = ()) -> DataFrame:
    """One row per series: n, and for each length in rests and the whole block an array over the starts of (growth, highest and lowest prefix, deepest fall)."""
    g = F.collect_list(1 + F.col("r")).over(ordered().rowsBetween(0, block - 1))
    r = daily_returns(series).withColumns({"start": F.row_number().over(ordered()) - 1, "n": F.count("*").over(Window.partitionBy("series_id")), "g": g})
    r = r.where((F.col("n") >= 120) & (F.col("start") < F.col("n") - block))
    first = F.struct(F.lit(1.0).alias("p"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"), F.lit(0.0).alias("dd"))

    def step(s, x):
        p = s["p"] * x
        hi = F.greatest(s["hi"], p)
        return F.struct(p.alias("p"), hi.alias("hi"), F.least(s["lo"], p).alias("lo"), F.least(s["dd"], p / hi - 1).alias("dd"))

    lengths = {length: F.aggregate(F.slice("g", 1, length), first, step) for length in (*rests, block)}
    r = r.select("series_id", "n", F.struct("start", *(s.alias(f"b{length}") for length, s in lengths.items())).alias("s"))
    return r.groupBy("series_id", "n").agg(F.array_sort(F.collect_list("s")).alias("s")).select("series_id", "n", *(F.col(f"s.b{length}").alias(f"b{length}") for length in lengths))


def _paths(block: int):
    """A function from one row (a series' blocks, a horizon, the first path and the number of paths) to the paths' final values and deepest drawdowns."""

    def paths(chunk: pa.Table) -> pa.Table:
        at = lambda name: chunk.column(name)[0]
        length, first, count, told = at("length").as_py(), at("low").as_py(), at("paths").as_py(), at("told").as_py()
        steps, rest = -(-length // block), length % block
        digests = (hashlib.md5(f"{told}:{p}:{q}".encode()).digest() for p in range(first, first + count) for q in range((steps - 1) // 4 + 1))
        starts = np.frombuffer(b"".join(digests), dtype=">u4").reshape(count, -1)[:, :steps].astype(np.int64) % (at("n").as_py() - block)
        whole, cut = ([x.to_numpy(zero_copy_only=False) for x in at(f"b{size}").values.flatten()] for size in (block, rest or block))
        value, peak, deepest = np.ones(count), None, np.zeros(count)
        for k in range(steps):
            p, hi, lo, dd = (x[starts[:, k]] for x in (cut if k == steps - 1 else whole))
            # Inside a block, and from the peak before it.
            fall = dd if peak is None else np.minimum(value * lo / peak - 1, dd)
            peak = value * hi if peak is None else np.maximum(peak, value * hi)
            value, deepest = value * p, np.minimum(deepest, fall)
        same = lambda name: pa.array([at(name).as_py()] * count, chunk.schema.field(name).type)
        return pa.table({"series_id": same("series_id"), "years": same("years"), "final": value, "dd": deepest})

    return paths


def block_bootstrap(series: DataFrame, years: tuple[int, ...] = (1, 3, 5), paths: int = 10_000, seed: int = SEED, block: int = BLOCK, days: tuple[int, ...] = (), chunk: int = 2_500) -> DataFrame:
    """series_id, years and the distribution of final value and deepest drawdown over paths of blocks drawn at random.

    A path is a product of blocks, so it needs one step per block, not per day; of a horizon that isn't whole blocks (days: other
    horizons, by their number of days in the place of years) the last block is cut. Draws are hashes of seed, series, horizon, path and block, four from
    each digest. A series' blocks are arrays; a task folds `chunk` paths of one series and horizon side by side, so no draw is a row, and one series' paths
    are spread over tasks.
    """
    horizons = [(y, y * TRADING_DAYS) for y in years] + [(d, d) for d in days]
    rests = tuple(sorted({d % block for _, d in horizons} - {0}))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("years"), F.lit(length).alias("length")) for name, length in horizons)))
    rows = block_summaries(series, block, rests).withColumn("h", each).withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(chunk))))
    told = F.concat_ws(":", F.lit(str(seed)), F.col("series_id").cast("string"), F.col("h.years").cast("string"))
    rows = rows.select("series_id", "n", "h.*", "low", F.least(F.lit(chunk), paths - F.col("low")).alias("paths"), told.alias("told"), *(f"b{size}" for size in (*rests, block)))
    kind = series.schema["series_id"].dataType.simpleString()
    # A number of partitions of its own: by bytes alone these rows would be put together, but their work is in the draws.
    rows = rows.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id", "years", "low")
    ends = rows.groupBy("series_id", "years", "low").applyInArrow(_paths(block), f"series_id {kind}, years int, final double, dd double")
    levels = F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))
    share = lambda t: F.avg(t.cast("double"))
    f = F.col("final")
    # The mean below the 5 % quantile from the sorted finals of one pass.
    out = ends.groupBy("series_id", "years").agg(
        F.percentile("final", levels).alias("q"), F.percentile("dd", F.array(F.lit(0.5), F.lit(0.05))).alias("d"),
        share(f < 1).alias("p_loss"), share(f < 0.9).alias("p_below_90"), share(f > 1.2).alias("p_above_120"), F.array_sort(F.collect_list("final")).alias("finals"))
    low = F.filter("finals", lambda x: x <= F.col("q")[0])
    cvar = F.aggregate(low, F.lit(0.0), lambda s, x: s + x) / F.size(low)
    return out.select("series_id", "years", *(F.col("q")[i].alias(c) for i, c in enumerate(("p05", "p25", "p50", "p75", "p95"))), "p_loss", "p_below_90", "p_above_120", cvar.alias("cvar_final"), F.col("d")[0].alias("dd_median"), F.col("d")[1].alias("dd_p05"))
