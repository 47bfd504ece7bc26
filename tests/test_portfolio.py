"""Hand-made series, identities, and queries against SQL on the smallest tables."""

import datetime as dt
import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folionaut.functions.expr import chi2_tail, column, norm_cdf, norm_pdf, norm_ppf
from folionaut.operators import drawdown, market, metrics, nav, risk, rolling, series, summaries
from folionaut.plans.fixtures import BASE, Book
from folionaut.plans.portfolio_queries import ORACLE_SQL, QUERIES
from folionaut.sources import files

SF = "/root/testdata/sf0.001"
DAY = dt.date(2020, 1, 1)


def make(spark, values, name="X", step=1):
    return spark.createDataFrame([(name, DAY + dt.timedelta(days=i * step), float(v)) for i, v in enumerate(values)], "series_id string, date date, value double")


def one(df):
    return df.first().asDict()


def test_tied_peak_is_the_first(spark):
    e = drawdown.drawdown_episodes(make(spark, [100, 110, 100, 110, 90])).orderBy("rank").collect()
    assert [x.peak for x in e] == [DAY + dt.timedelta(days=1)] * 2 and e[0].ongoing and e[0].recovery is None and not e[1].ongoing
    last = drawdown.drawdown_episodes(make(spark, [100, 110, 100, 110, 90]), ties="last").orderBy("rank").first()
    assert last.peak == DAY + dt.timedelta(days=3)


def test_monotone_rise_has_no_episode(spark):
    s = make(spark, [100, 101, 102, 103])
    assert drawdown.drawdown_episodes(s).count() == 0
    assert one(drawdown.max_drawdown(s))["max_dd"] == 0
    assert one(metrics.drawdown_ratios(s))["calmar"] is None
    assert one(drawdown.underwater_time(s))["episodes"] == 0


def test_constant_series(spark):
    s = make(spark, [100.0] * 300)
    assert one(metrics.sharpe_block(s))["sharpe"] == 0
    assert rolling.rolling_sharpe(s, 126).count() == 0


def test_all_negative_returns(spark):
    s = make(spark, [100, 90, 80, 70])
    assert one(metrics.omega_kappa(s))["omega"] == 0 and one(metrics.win_loss(s))["profit_factor"] == 0


def test_gap_month_loses_two_returns(spark):
    rows = [("X", dt.date(2020, m, 15), float(m)) for m in (1, 2, 4, 5)]
    s = spark.createDataFrame(rows, "series_id string, date date, value double")
    assert [r.period.month for r in series.period_returns(s, "month").orderBy("period").collect()] == [2, 5]


def test_later_bar_of_a_day_wins(spark):
    rows = [(1, "2020-01-01 10:00:00", 5.0, 1), (1, "2020-01-01 11:00:00", 7.0, 2), (1, "2020-01-01 11:00:00", 8.0, 3)]
    raw = spark.createDataFrame(rows, "k long, t string, v double, e long").withColumn("t", F.to_timestamp("t"))
    assert [r.close for r in market.normalize_bars(raw, "k", "t", "v", "e").collect()] == [8.0]


def test_fx_fills_both_ways_and_ignores_other_days(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(4)]
    rates = spark.createDataFrame([("USD", days[1], 2.0), ("USD", DAY + dt.timedelta(days=99), 9.0)], "ccy string, date date, rate double")
    points = spark.createDataFrame([("P", c, d) for c in ("USD", "CHF") for d in days], "portfolio string, ccy string, date date")
    got = {(r.ccy, r.date): r.rate for r in market.align_fx(points, rates, "CHF", ["portfolio"]).collect()}
    assert all(got["USD", d] == 2.0 and got["CHF", d] == 1.0 for d in days)


def test_inverse_pair(spark):
    q = spark.createDataFrame([("CHF", "USD", DAY, 4.0), ("EUR", "CHF", DAY, 2.0), ("CHF", "EUR", DAY, 9.0)], "ccy string, base string, date date, rate double")
    assert {r.ccy: r.rate for r in market.fx_rates(q, "CHF").collect()} == {"USD": 0.25, "EUR": 2.0}


def test_missing_price_counts_zero_and_capital_comes_first(spark):
    hold = spark.createDataFrame([("P", "A", "CHF", 2, 10.0, "CHF", 20.0, "CHF"), ("P", "B", "CHF", 1, 5.0, "CHF", 5.0, "CHF")], "portfolio string, symbol string, ccy string, shares long, cost_px double, cost_ccy string, cost_amount double, quote_ccy string")
    ports = spark.createDataFrame([("P", DAY)], "portfolio string, inception date")
    closes = spark.createDataFrame([("A", DAY, 11.0), ("A", DAY + dt.timedelta(days=1), 12.0), ("B", DAY + dt.timedelta(days=1), 7.0)], "symbol string, date date, close double")
    paid = spark.createDataFrame([("A", DAY, 0.5)], "symbol string, date date, amount double")
    rates = spark.createDataFrame([], "ccy string, date date, rate double")
    comp = nav.component_values(nav.filled_spine(hold, ports, closes, paid), hold, rates, "CHF")
    got = {r.date: (r.nav, r.cash) for r in nav.nav(comp, hold, rates, "CHF").collect()}
    assert got == {DAY - dt.timedelta(days=1): (25.0, 0.0), DAY: (23.0, 1.0), DAY + dt.timedelta(days=1): (32.0, 1.0)}


@pytest.mark.parametrize("n, there", [(11, False), (12, True)])
def test_monthly_gates(spark, n, there):
    rows = [("X", (dt.date(2020, 1, 1) + dt.timedelta(days=31 * i)).replace(day=1), 100.0 + (i * 7) % 5) for i in range(n + 1)]
    s = one(metrics.summary_stats(spark.createDataFrame(rows, "series_id string, date date, value double")))
    assert s["months_n"] == n and (s["month_skew"] is not None) == (s["month_hist_95"] is not None) == there and (s["rolling12_n"] == 1) == there


def test_short_window_is_lengthened(spark):
    s = make(spark, range(100, 160), step=2)
    w = spark.createDataFrame([("X", "w", DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=3))], "series_id string, window string, a date, b date")
    r = one(series.analysis_windows(s, w))
    assert r["lo"] == DAY + dt.timedelta(days=2) and (r["hi"] - r["lo"]).days == 50


def test_ewma_recursion_equals_the_sum(spark):
    s = make(spark, [100 + (i * 37) % 11 for i in range(60)])
    last = rolling.ewma_vol(s).orderBy(F.desc("date")).first().vol
    assert math.isclose(last, one(metrics.volatility(s))["vol_ewma"], rel_tol=1e-9)


def test_hurst_and_bootstrap_need_120(spark):
    assert one(rolling.hurst(make(spark, [100 + (i * 37) % 11 for i in range(120)])))["hurst"] is None
    assert risk.block_bootstrap(make(spark, [100 + (i * 37) % 11 for i in range(120)]), (1,), 5).count() == 0
    assert risk.block_bootstrap(make(spark, [100 + (i * 37) % 11 for i in range(121)]), (1,), 5).count() == 1


def test_ewma_over_several_blocks(spark):
    values = [100 + (i * 37) % 11 + i / 50 for i in range(900)]
    want, v = [], None
    for r in (b / a - 1 for a, b in zip(values, values[1:])):
        v = 0.94 * (r * r if v is None else v) + 0.06 * r * r
        want.append(math.sqrt(v * 252))
    got = [r.vol for r in rolling.ewma_vol(make(spark, values), block=64).orderBy("date").collect()]
    assert np.allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("days", [63, 50, 10])
def test_bootstrap_day_by_day(spark, days):
    """Paths again from the same draws, one day after the other; horizons that aren't whole blocks cut the last one."""
    values = [100 + (i * 37) % 11 + i / 9 for i in range(200)]
    r = np.diff(values) / values[:-1]
    finals, falls = [], []
    for p in range(40):
        digest = "".join(hashlib.md5(f"{risk.SEED}:X:{days}:{p}:{q}".encode()).hexdigest() for q in range(-(-days // 21 + 3) // 4 + 2))
        starts = [int(digest[k * 8 : k * 8 + 8], 16) % (len(r) - 21) for k in range(-(-days // 21))]
        path = np.cumprod(np.concatenate([1 + r[s : s + 21] for s in starts])[:days])
        finals.append(path[-1])
        falls.append((path / np.maximum.accumulate(path) - 1).min())
    got = one(risk.block_bootstrap(make(spark, values), (), 40, days=(days,), chunk=7))
    assert got["years"] == days and np.allclose([got["p05"], got["p50"], got["p95"]], np.quantile(finals, [0.05, 0.5, 0.95]), rtol=1e-12)
    assert np.allclose([got["dd_median"], got["dd_p05"]], np.quantile(falls, [0.5, 0.05]), atol=1e-12)
    assert math.isclose(got["cvar_final"], np.mean([f for f in finals if f <= np.quantile(finals, 0.05)]), rel_tol=1e-12)


def test_normal_functions(spark):
    """Against the error function, tabulated quantiles and a table of the chi-square tail, not against their own SQL."""
    xs = [-6.0, -2.5, -1.0, -0.3, 0.0, 0.1, 1.0, 1.96, 3.3, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", column(norm_cdf("x")).alias("c"), column(norm_pdf("x")).alias("d")).collect():
        assert abs(r.c - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 2e-7 and math.isclose(r.d, math.exp(-r.x**2 / 2) / math.sqrt(2 * math.pi), rel_tol=1e-12)
    #: Quantiles of the normal distribution.
    table = {0.5: 0.0, 0.75: 0.6744897502, 0.9: 1.2815515655, 0.95: 1.6448536270, 0.975: 1.9599639845, 0.99: 2.3263478740, 0.999: 3.0902323062, 0.01: -2.3263478740, 0.0001: -3.7190164855}
    for r in spark.createDataFrame([(p,) for p in table], "p double").select("p", column(norm_ppf("p")).alias("q")).collect():
        assert abs(r.q - table[r.p]) < 1e-8
    #: Where the chi-square distribution with 10 degrees of freedom has these tails.
    tails = {18.307038: 0.05, 23.209251: 0.01, 9.341818: 0.5, 3.940299: 0.95}
    for r in spark.createDataFrame([(q,) for q in tails], "q double").select("q", column(chi2_tail("q")).alias("p")).collect():
        assert abs(r.p - tails[r.q]) < 1e-6


def test_effective_bets_by_singular_values(spark):
    """The eigenvalues again as squared singular values of the centred returns of every portfolio."""
    b = Book(spark, SF)
    got = {r.portfolio: r.effective_bets for r in risk.effective_bets(b.components).collect()}
    returns = risk.component_returns(b.components).toPandas()
    assert got and set(got) == set(returns.portfolio)
    for p, own in returns.groupby("portfolio"):
        x = own.pivot(index="date", columns="symbol", values="r").to_numpy()
        e = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
        share = e / e.sum()
        assert math.isclose(got[p], math.exp(-(share * np.log(share)).sum()), rel_tol=1e-9)


def test_plans_have_no_nested_loops_and_push_the_bound(spark):
    b = Book(spark, SF)
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (market.fx_rates(b.quotes, BASE), b.benchmarks, QUERIES["asof_value"](spark, SF)):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() and "Join Cross" not in text(df)
    plan = QUERIES["read_market"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_effective_bets(spark):
    base = [100 + (i * 37) % 11 for i in range(80)]
    rows = [("P", n, DAY + dt.timedelta(days=i), float(v) * k) for n, k in (("A", 1), ("B", 3)) for i, v in enumerate(base)]
    same = risk.effective_bets(spark.createDataFrame(rows, "portfolio string, symbol string, date date, value double"))
    assert math.isclose(one(same)["effective_bets"], 1.0, abs_tol=1e-6)


def test_identities(spark):
    b = Book(spark, "/root/testdata/sf0.01")
    parts, whole = risk.risk_decomposition(b.components, b.nav)
    total = {r.portfolio: r for r in whole.collect()}
    for r in parts.groupBy("portfolio").agg(F.sum("risk_share").alias("s"), F.sum("contribution").alias("c")).collect():
        assert math.isclose(r.s, 1, rel_tol=1e-9) and math.isclose(r.c, total[r.portfolio].vol, rel_tol=1e-9)
    p = nav.positions(b.components, b.holdings, b.rates, BASE, b.nav)
    capital = {r.portfolio: r.capital for r in b.capital.collect()}
    for r in p.groupBy("portfolio").agg(F.sum("contrib_pp").alias("c"), F.sum("value").alias("v")).collect():
        assert math.isclose(r.c, (r.v / capital[r.portfolio] - 1) * 100, rel_tol=1e-9)


@pytest.mark.parametrize("name", ["nav", "max_drawdown", "drawdown_episodes", "benchmark_pairs", "period_returns", "normalize_bars", "seasonality", "positions", "benchmark_nav", "risk_totals", "windowed_risk_totals", "windowed_benchmarks", "write_outputs", "ewma_vol", "read_market"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "supplier", "nation"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*names).collect()
    plain = lambda rows: sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)
    a, b = plain(map(tuple, got)), plain(want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6) for p, q in zip(x, y)), (x, y)


def test_all_queries_have_names_and_sql():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) == set(ORACLE_SQL)


# --- outliers, zeros, windows --------------------------------------------------------------------------------
def returns_of(values):
    return [b / a - 1 for a, b in zip(values, values[1:])]


@pytest.mark.parametrize("kind", ["outlier", "tiny", "flat"])
def test_rolling_windows_against_plain_sums(spark, kind):
    """A return of 1e6, a volatility of 1e-10, and none: every window's deviation from its own rows alone."""
    rng = np.random.default_rng(2)
    r = {"outlier": np.where(np.arange(400) == 90, 1e6, rng.normal(size=400) * 0.01), "tiny": rng.normal(size=400) * 1e-10, "flat": np.zeros(400)}[kind]
    values = [100.0]
    for x in r:
        values.append(values[-1] * (1 + x))
    r = returns_of(values)
    got = {(m.days, m.date): (m.mean, m.sd) for m in rolling.moments_of_windows(make(spark, values), (21, 60)).collect()}
    assert len(got) == 400 - 20 + 400 - 59
    for w in (21, 60):
        for i in range(w - 1, 400):
            own = r[i - w + 1 : i + 1]
            mean = math.fsum(own) / w
            sd = math.sqrt(math.fsum((x - mean) ** 2 for x in own) / (w - 1))
            g = got[w, DAY + dt.timedelta(days=i + 1)]
            assert math.isclose(g[1], sd, rel_tol=1e-9) and math.isclose(g[0], mean, rel_tol=1e-9, abs_tol=1e-18)
    s = make(spark, values)
    assert (rolling.rolling_sharpe(s, 30).count() == 0) == (kind == "flat")


def test_rolling_beta_and_sortino_after_an_outlier(spark):
    rng = np.random.default_rng(5)
    p, b = rng.normal(size=300) * 0.01, rng.normal(size=300) * 0.01
    p[40] = b[40] = 1e5
    rows = [("P", "B", DAY + dt.timedelta(days=i), float(x), float(y)) for i, (x, y) in enumerate(zip(p, b))]
    got = rolling.rolling_beta_corr(spark.createDataFrame(rows, "portfolio string, benchmark string, date date, p double, b double"), 60).orderBy("period").collect()
    last = np.cov(p[-60:], b[-60:])
    assert math.isclose(got[-1].beta, last[0, 1] / last[1, 1], rel_tol=1e-9) and math.isclose(got[-1].corr, np.corrcoef(p[-60:], b[-60:])[0, 1], rel_tol=1e-9)
    values = [100.0]
    for x in np.where(np.arange(300) == 40, 1e5, p):
        values.append(values[-1] * (1 + x))
    own = np.array(returns_of(values))[-60:]
    want = own.mean() * 252 / (math.sqrt((own[own < 0] ** 2).mean()) * math.sqrt(252))
    assert math.isclose(rolling.rolling_sortino(make(spark, values), 60).orderBy(F.desc("period")).first().sortino, want, rel_tol=1e-9)


def test_zero_values_end_no_job(spark):
    """There is no change from 0 and no depth below a highest value of 0; a fall to 0 is -1."""
    s = make(spark, [0, 0, 100, 110, 0, 50, 60])
    assert [round(r.r, 9) for r in series.daily_returns(s).orderBy("date").collect()] == [0.1, -1.0, 0.2]
    assert [r.dd for r in drawdown.drawdown_series(s).orderBy("date").collect()][:3] == [None, None, 0.0]
    for f in (series.annual_returns, series.rebase_100, metrics.summary_stats, metrics.return_stats, metrics.win_loss, metrics.tail_ratios, metrics.var_cvar, metrics.drawdown_ratios, drawdown.drawdown_episodes, drawdown.underwater_time, rolling.worst_windows, summaries.window_statistics):
        assert f(s).count() >= 0 and f(s).collect() is not None
    zero = make(spark, [0] * 130)
    assert rolling.rolling_sharpe(zero, 30).count() == 0 and one(metrics.growth(zero))["total"] is None


def test_iso_weeks_and_rounded_months(spark):
    s = make(spark, [100 + (i * 37) % 11 for i in range(120)])
    assert {p.period.isoweekday() for p in series.period_last(s, "week", week="iso").collect()} == {7} and {p.period.isoweekday() for p in series.period_last(s, "week").collect()} == {5}
    plain, rounded = (one(series.monthly_matrix(s, rounded=x)) for x in (False, True))
    assert all(rounded[f"m{m:02d}"] == (None if plain[f"m{m:02d}"] is None else round(plain[f"m{m:02d}"], 2)) for m in range(1, 13))


# --- summaries -----------------------------------------------------------------------------------------------
def test_thousand_explicit_windows(spark):
    """Windows over the tree equal the metrics of their rows; the nodes of a window are at most 2 log2(n)."""
    rng = np.random.default_rng(8)
    values = list(100 * np.cumprod(1 + rng.normal(size=2100) * 0.01))
    s = make(spark, values)
    bounds = [sorted(rng.integers(0, 2100, 2).tolist()) for _ in range(1000)]
    explicit = spark.createDataFrame([("X", f"w{i}", DAY + dt.timedelta(days=a), DAY + dt.timedelta(days=b)) for i, (a, b) in enumerate(bounds)], "series_id string, window string, a date, b date")
    got = {r.window: r for r in summaries.window_statistics(s, explicit).collect()}
    assert len(got) == 1000
    v = np.array(values)
    for r in got.values():
        i, j = (r.from_date - DAY).days, (r.to_date - DAY).days
        own, x = v[i : j + 1], v[i + 1 : j + 1] / v[i:j] - 1
        dd = own / np.maximum.accumulate(own) - 1
        want = (len(x), own[-1] / own[0] - 1, x.std(ddof=1) * 252**0.5, x.max(), x.min(), (x > 0).mean(), dd.min(), ((x - x.mean()) ** 3).mean() / x.std() ** 3, ((x - x.mean()) ** 4).mean() / x.std() ** 4 - 3)
        have = (r.n, r.total, r.vol, r.best_day, r.worst_day, r.positive_day, r.max_dd, r.skew, r.kurtosis)
        assert np.allclose(have, want, rtol=1e-9, atol=1e-12) and (r.max_dd_date - DAY).days == i + int(dd.argmin()) and j - i >= 25
    for i, j in bounds:
        nodes = summaries.pieces(i, j)
        assert len(nodes) <= 2 * math.log2(2100) and [k for level, at in nodes for k in range(at << level, (at + 1) << level)] == list(range(i, j + 1))


def test_presets_over_the_tree_equal_windowed_series(spark):
    s = make(spark, [100 + (i * 37) % 11 + i / 50 for i in range(900)])
    direct = {r.series_id: r.sharpe for r in metrics.sharpe_block(series.windowed(s, series.analysis_windows(s)).select("series_id", "date", "value")).collect()}
    got = {f"{r.series_id}|{r.window}": r.sharpe for r in summaries.window_statistics(s).collect()}
    assert set(got) == set(direct) and all(math.isclose(got[k], direct[k], rel_tol=1e-9) for k in got)


# --- calendars, matrices -------------------------------------------------------------------------------------
def test_intervals_equal_fills(spark):
    """Random bars with gaps, bars ahead of inception only, dividends on days without a bar: as aligned and filled row by row."""
    rng = np.random.default_rng(4)
    day = lambda i: DAY + dt.timedelta(days=int(i))
    closes = [(f"S{k}", day(i), None if rng.random() < 0.1 else float(rng.integers(1, 99))) for k in range(6) for i in np.unique(rng.integers(0, 400, (3, 40, 90, 5, 300, 20)[k]))]
    paid = [(f"S{k}", day(i), float(k + 1)) for k in range(6) for i in np.unique(rng.integers(0, 400, 15))]
    ports = spark.createDataFrame([(f"P{k}", day(i)) for k, i in enumerate((0, 30, 200, 390))], "portfolio string, inception date")
    hold = spark.createDataFrame([(f"P{k}", f"S{m}") for k in range(4) for m in range(6) if (k + m) % 3], "portfolio string, symbol string")
    closes, paid = spark.createDataFrame(closes, "symbol string, date date, close double"), spark.createDataFrame(paid, "symbol string, date date, amount double")
    want = market.ffill(market.align_calendar(hold, closes, paid, ports), ["portfolio", "symbol"], "close")
    got = market.filled_calendar(hold, closes, paid, ports)
    plain = lambda df: sorted(map(tuple, df.select("portfolio", "symbol", "date", "close", "amount").collect()), key=str)
    assert plain(got) == plain(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(portfolio" not in plan and "NestedLoop" not in plan


def test_gram_of_tiles_and_spans(spark):
    rng = np.random.default_rng(6)
    r = rng.normal(size=(90, 11)) * 0.01 + rng.normal(size=(90, 1)) * 0.01
    rows = [("P", f"S{k:02d}", DAY + dt.timedelta(days=i), float(r[i, k])) for i in range(90) for k in range(11)] + [("Q", "A", DAY + dt.timedelta(days=i), 0.01) for i in range(9)]
    df = spark.createDataFrame(rows, "portfolio string, symbol string, date date, r double").repartition(5)
    for tile, span in ((4, 20), (128, 512), (1, 7)):
        got = {(x.portfolio, x.i, x.j): x for x in risk.gram(df, tile, span).collect()}
        assert len(got) == 67 and got["Q", "A", "A"].corr is None and got["P", "S00", "S01"].n == 90
        cov, corr = np.cov(r.T), np.corrcoef(r.T)
        assert all(math.isclose(got["P", f"S{a:02d}", f"S{b:02d}"].cov, cov[a, b], rel_tol=1e-10) and math.isclose(got["P", f"S{a:02d}", f"S{b:02d}"].corr, corr[a, b], rel_tol=1e-10) for a in range(11) for b in range(a, 11))


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_jacobi_eigenvalues(n):
    x = np.random.default_rng(n).normal(size=(7, n, n))
    m = x @ x.transpose(0, 2, 1) * np.array([1, 1e-12, 1e9, 1, 1, 1, 0])[:, None, None]
    assert np.allclose(np.sort(risk.jacobi(m), axis=1), np.linalg.eigvalsh(m), rtol=1e-9, atol=1e-12 * np.abs(m).max())


# --- files ---------------------------------------------------------------------------------------------------
SPEC_TEXT = """{
 "portfolio": "p1", "label": "One",
 "google_portfolio_id": "g-1",
 "base_currency": "CHF", "inception": "2024-05-01", "sync_date": "2026-08-18", "methodology": "held",
 "holdings": [
  {"symbol": "A", "ccy": "EUR", "quote_ccy_google": "USD", "shares": 3, "cost_px": 2.5, "cost_ccy": "USD", "cost_amount": 7.5},
  {"symbol": "B", "ccy": "CHF", "quote_ccy": "CHF", "shares": 4, "cost_px": 1, "cost_ccy": "CHF", "cost_amount": 4}
 ]
}
"""


def test_specs_of_any_layout(spark, tmp_path):
    (tmp_path / "pretty.json").write_text(SPEC_TEXT)
    (tmp_path / "array.json").write_text("[" + SPEC_TEXT.replace("p1", "p2") + "," + SPEC_TEXT.replace("p1", "p3") + "]")
    lines = "\n".join(" ".join(SPEC_TEXT.replace("p1", p).split()) for p in ("p4", "p5"))
    (tmp_path / "lines.json").write_text(lines + "\n")
    (tmp_path / "empty.json").write_text("\n")
    ports, hold = files.read_specs(spark, str(tmp_path))
    assert sorted((r.portfolio, r.google_portfolio_id, str(r.inception)) for r in ports.collect()) == [(f"p{k}", "g-1", "2024-05-01") for k in range(1, 6)]
    assert sorted((r.portfolio, r.symbol, r.quote_ccy, r.shares) for r in hold.collect()) == sorted((f"p{k}", s, q, n) for k in range(1, 6) for s, q, n in (("A", "USD", 3), ("B", "CHF", 4)))


@pytest.mark.parametrize("text", [SPEC_TEXT[:-20], '{"label": "no portfolio"}', SPEC_TEXT.replace('"2024-05-01"', '"soon"'), "[1, 2]", "not json"])
def test_broken_specs_fail(spark, tmp_path, text):
    (tmp_path / "good.json").write_text(SPEC_TEXT)
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="bad.json"):
        files.read_specs(spark, str(tmp_path))[1].collect()


def test_publication_is_atomic_and_incremental(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    docs = lambda **of: spark.createDataFrame(list(of.items()), "portfolio string, document string")
    registry = spark.createDataFrame([("p", 1.0)], "portfolio string, nav double")
    seen = lambda: {k: sorted(map(tuple, files.published(spark, path)[k].collect())) for k in ("series", "payload")}
    first = files.write_outputs(spark, path, registry, docs(p="[1]", q="[2]"), docs(p='{"a":1}', q="{}"), "none")
    assert seen() == {"series": [("p", "[1]"), ("q", "[2]")], "payload": [("p", '{"a":1}'), ("q", "{}")]}
    second = files.write_outputs(spark, path, registry, docs(p="[1]", q="[3]", r="[4]"), docs(p='{"a":1}', q="{}", r="{}"), "none")
    assert {(m.portfolio, m.version) for m in files.published(spark, path)["manifest"].collect()} == {("p", first), ("q", second), ("r", second)}
    assert seen()["series"] == [("p", "[1]"), ("q", "[3]"), ("r", "[4]")]
    # A run that ends between its writes, here at the registry, leaves what readers see as it was.
    broken = registry.withColumn("nav", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        files.write_outputs(spark, path, broken, docs(p="[9]"), docs(p="{}"), "none")
    assert files.versions(spark, path) == [first, second] and seen()["series"] == [("p", "[1]"), ("q", "[3]"), ("r", "[4]")]
    third = files.write_outputs(spark, path, registry, docs(r="[4]"), docs(r="{}"), "none")
    assert seen() == {"series": [("r", "[4]")], "payload": [("r", "{}")]} and files.versions(spark, path)[-1] == third
