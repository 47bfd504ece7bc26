"""The portfolio operators as queries on the given tables, with SQL for each.

Results are rounded, in Spark and in SQL alike: sums of floats differ in the last bits with the order of summing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import EULER, Z, Z95_SUMMARY, chi2_tail, norm_cdf, norm_pdf, norm_ppf
from ..operators import drawdown, heldrisk, market, metrics, nav, quantiles, risk, rolling, series, summaries
from ..sources import files
from . import fixtures
from .fixtures import BASE, Book
from .oracle import PAST, PERIOD, WIDE, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PARTS: dict[str, tuple[str, list[str], dict[str, str]]] = {}  # of each query with SQL: the SQL itself, rounded columns, own tables
TD = 252
ROOT = "sqrt(252.0e0)"


def query(name: str, make: Callable[[Book], DataFrame], sql: str | None, doubles: str = "", digits: int = 6, wide: bool = False, **tables: str) -> None:
    """Registers a query and its SQL; both round the columns in doubles. wide: on the portfolios of nearly all symbols."""
    own = doubles.split()
    tables = tables | ({"lots": WIDE} if wide else {})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(Book(spark, sf_dir, wide)).withColumns({c: F.round(c, digits) + F.lit(0.0) for c in own})

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        PARTS[name] = (sql, own, tables)
        rounded = ", ".join(f"round({c}, {digits}) + 0.0e0 as {c}" for c in own)
        ORACLE_SQL[name] = with_tables(f"select * {f'replace ({rounded})' if own else ''} from ({sql}) result", **tables)


# --- sources, cleaning, calendars ----------------------------------------------------------------------------
def _specs(b: Book) -> DataFrame:
    """Specs made of suppliers by nation, written as JSON and read back."""
    supplier, nation = (b.spark.read.parquet(f"{b.sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    s = F.col
    cost = F.round(s("s_acctbal"), 2)
    holding = F.struct(
        F.concat(F.lit("S"), s("s_suppkey")).alias("symbol"), s("s_name").alias("name"), F.lit("equity").alias("kind"), F.lit("CHF").alias("ccy"),
        (s("s_suppkey") % 100 + 1).cast("long").alias("shares"), cost.alias("cost_px"), F.lit("CHF").alias("cost_ccy"),
    )
    specs = supplier.join(nation, s("s_nationkey") == s("n_nationkey")).groupBy(s("n_name").alias("portfolio")).agg(F.collect_list(holding).alias("holdings"))
    path = files.scratch(b.spark)
    specs.withColumns({"inception": F.lit("1995-02-01"), "base_currency": F.lit("CHF")}).write.json(path)
    return files.read_specs(b.spark, path)[1].select("portfolio", "inception", "symbol", "name", "kind", "ccy", "shares", "cost_px", "cost_ccy")


query("read_specs", _specs, """select n_name as portfolio, date '1995-02-01' as inception, 'S' || s_suppkey as symbol, s_name as name, 'equity' as kind, 'CHF' as ccy,
    (s_suppkey % 100 + 1)::bigint as shares, s_acctbal as cost_px, 'CHF' as cost_ccy from supplier join nation on s_nationkey = n_nationkey""", "cost_px", 2)  # fmt: skip


def _market(b: Book) -> DataFrame:
    """Closes, dividends and rates in use, one under the other."""
    used = market.currency_universe(b.holdings, b.legs, BASE)
    closes, paid, quotes = market.read_market(fixtures.prices(b.spark, b.sf_dir), b.dividends, b.quotes, b.holdings, b.portfolios, used)
    kind = lambda df, name, key, value: df.select(F.lit(name).alias("kind"), F.col(key).alias("key"), "date", F.col(value).alias("value"))
    return kind(closes, "close", "symbol", "close").unionByName(kind(paid, "dividend", "symbol", "amount")).unionByName(kind(quotes, "rate", "ccy", "rate"))


query("read_market", _market, """select 'close' as kind, symbol as key, date, close as value from px join need using (symbol) where date >= since
    union all select 'dividend', symbol, date, amount from dividends join need using (symbol) where date >= since
    union all select 'rate', ccy, date, rate from quotes where date >= (select min(inception) from ports) - 12 and ccy in (
      select ccy from hold union select cost_ccy from hold union select case when ccy in ('GBp', 'GBX') then 'GBP' else ccy end from legs)""",
      need="select symbol, min(inception) - 12 as since from hold join ports using (portfolio) group by 1")


def _payload(b: Book) -> DataFrame:
    """Everything that is published of a portfolio: its numbers, and all blocks of the analysis."""
    of = lambda df: df.withColumnRenamed("series_id", "portfolio")
    s = b.nav_series
    parts, totals = heldrisk.risk_decomposition(b.held, b.nav)
    low = of(drawdown.max_drawdown(s)).select("portfolio", "max_dd_date")
    heads = {
        "": files.registry(b.nav, b.capital, metrics.summary_stats(s), b.portfolios).join(low, "portfolio"), "sample": of(metrics.sample_info(s)), "returns": of(metrics.return_stats(s)), "win_loss": of(metrics.win_loss(s)),
        "streaks": of(metrics.streaks(s)), "volatility": of(metrics.volatility(s)), "downside": of(metrics.downside_risk(s)), "var": of(metrics.var_cvar(s)), "scaled_var": of(metrics.scaled_var(s)),
        "tails": of(metrics.tail_ratios(s)), "sharpe": of(metrics.sharpe_block(s)), "probabilistic_sharpe": of(metrics.psr_dsr(s)), "drawdown_ratios": of(metrics.drawdown_ratios(s)), "omega_kappa": of(metrics.omega_kappa(s)),
        "moments": of(rolling.moments(s)), "jarque_bera": of(rolling.jarque_bera(s)), "ljung_box": of(rolling.ljung_box(s)), "hurst": of(rolling.hurst(s)), "drawdown": of(drawdown.max_drawdown(s)), "underwater": of(drawdown.underwater_time(s)),
        "risk": totals, "effective_bets": risk.bets(heldrisk.cov_matrix(b.held, size=2)),
    }
    children = {
        "weekly": series.weekly_series(b.nav, b.capital), "bench_index_weekly": series.weekly_index(b.benchmarks), "monthly_pct": of(series.period_returns(s, "month")), "monthly_matrix": of(series.monthly_matrix(s)),
        "annual": of(series.annual_returns(s)), "quarterly": of(series.quarterly_returns(s)), "seasonality": of(series.seasonality(s)), "rolling12": of(series.rolling_compound(s, 12)),
        "rolling_vol": of(rolling.rolling_vol(s, 30, 60, 90, 252)), "rolling_sharpe": of(rolling.rolling_sharpe(s, 126, 252)), "rolling_sortino": of(rolling.rolling_sortino(s)), "rolling_beta": rolling.rolling_beta_corr(b.pairs),
        "excess": series.period_last(rolling.excess_cumulative(b.pairs).withColumnRenamed("excess", "value"), "week", ("portfolio", "benchmark")), "episodes": of(drawdown.drawdown_episodes(s)),
        "cone": of(rolling.vol_cone(s)), "worst_windows": of(rolling.worst_windows(s)), "regimes": of(rolling.vol_regimes(s)), "phases": rolling.market_phases(b.pairs), "histogram": of(rolling.histogram(s)), "qq": of(rolling.qq_points(s)),
        "bootstrap": of(risk.block_bootstrap(s)), "risk_parts": parts, "correlations": heldrisk.corr_matrix(b.held), "correlations_bench": heldrisk.corr_benchmark(b.held, b.benchmark_returns),
        "holdings": nav.positions(b.components, b.holdings, b.rates, BASE, b.nav, b.calendar), "benchmarks": risk.benchmark_metrics(b.pairs, s, b.benchmarks),
    }
    return files.payload_documents(heads, children)


def _published(b: Book) -> DataFrame:
    """Series, payload and registry are published, read back and summed up."""
    path = files.scratch(b.spark)
    files.write_outputs(b.spark, path, _registry(b), files.series_documents(b.nav, b.components), _payload(b), fixtures.DISCLAIMER)
    found = files.published(b.spark, path)
    lines = found["series"].select("portfolio", F.from_json("document", "date array<date>, nav array<double>").alias("d"))
    lines = lines.select("portfolio", F.size("d.date").alias("n"), F.element_at("d.date", 1).alias("first_date"), F.element_at("d.nav", -1).alias("last_nav"))
    sizes = {"weeks": "weekly", "bench_weeks": "bench_index_weekly", "months": "monthly_pct", "years": "annual", "rolled": "rolling12", "falls": "episodes", "pairs": "correlations", "bench_pairs": "correlations_bench", "held": "holdings"}
    texts = {c: F.get_json_object("document", f"$.{c}") for c in sizes.values()}
    number = lambda c: F.get_json_object("document", f"$.{c}").cast("double")
    own = found["payload"].select("portfolio", F.get_json_object("document", "$.asof").cast("date").alias("asof"), number("metrics.total").alias("total"),
                                  F.expr("element_at(from_json(get_json_object(document, '$.weekly'), 'array<struct<index_pct:double>>'), -1).index_pct").alias("last_index"),
                                  *(F.json_array_length(texts[c]).alias(n) for n, c in sizes.items()))
    listed = found["registry"].where("generated is not null and disclaimer is not null").select("portfolio", "label", F.col("metrics.sharpe").alias("sharpe"))
    return lines.join(own, "portfolio").join(listed, "portfolio")


query("write_outputs", _published, f"""select n.portfolio, n.days as n, n.first_date, n.last_nav, n.d1 as asof, g.total, n.last_nav / c.capital * 100 as last_index, weeks, bench_weeks, months, y.years, rolled, least(falls, 8)::int as falls, pairs, bench_pairs, held, p.label,
      case when v.sd > 0 then v.mu / v.sd * {ROOT} else 0 end as sharpe
    from (select portfolio, count(*)::int as days, min(date) as first_date, max(date) as d1, arg_max(nav, date) as last_nav from nav group by 1) n join g on g.series_id = n.portfolio join cap c using (portfolio) join ports p using (portfolio)
    join (select series_id as portfolio, count(*)::int as weeks from last_week group by 1) using (portfolio)
    join (select portfolio, count(*)::int as bench_weeks from (select distinct portfolio, benchmark, {PERIOD['week']} as period from bench) group by 1) using (portfolio)
    join (select series_id as portfolio, count(*)::int as months, greatest(count(*) - 11, 0)::int as rolled from r_month group by 1) using (portfolio)
    join (select series_id as portfolio, count(*)::int as years from last_year group by 1) y using (portfolio) join (select series_id as portfolio, count(*) as falls from episodes group by 1) using (portfolio)
    join (select portfolio, count(*)::int as held, (count(*) * (count(*) + 1) / 2)::int as pairs, (count(*) * (select count(*) from members m join (select distinct benchmark from legs) using (benchmark) where m.portfolio = h.portfolio))::int as bench_pairs from hold h group by 1) using (portfolio)
    join (select series_id as portfolio, avg(r) as mu, stddev_samp(r) as sd from r group by 1) v using (portfolio)""", "last_nav total last_index sharpe", 4)  # fmt: skip


def _registry(b: Book) -> DataFrame:
    return files.registry(b.nav, b.capital, metrics.summary_stats(b.nav_series), b.portfolios)


query("registry", lambda b: _registry(b).select("portfolio", "label", "base_ccy", "inception", "asof", "capital", *(f"metrics.{c}" for c in ("nav_last", "total", "cagr", "vol", "sharpe", "calmar", "max_dd", "months_n", "rolling12_n"))),
      f"""select p.portfolio, p.label, p.base_ccy, p.inception, g.d1 as asof, g.v1 as nav_last, c.capital, g.total, g.cagr, v.sd * {ROOT} as vol,
    case when v.sd > 0 then v.mu / v.sd * {ROOT} else 0 end as sharpe, case when m.max_dd < 0 then g.cagr / abs(m.max_dd) else 0 end as calmar, m.max_dd,
    (select count(*) from r_month x where x.series_id = p.portfolio) as months_n, (select greatest(count(*) - 11, 0) from r_month x where x.series_id = p.portfolio) as rolling12_n
    from ports p join g on g.series_id = p.portfolio join cap c using (portfolio) join mdd m on m.series_id = p.portfolio
    join (select series_id, avg(r) as mu, stddev_samp(r) as sd from r group by 1) v on v.series_id = p.portfolio""", "nav_last capital total cagr vol sharpe calmar max_dd", 4)  # fmt: skip
query("normalize_bars", lambda b: market.normalize_bars(b.spark.read.parquet(f"{b.sf_dir}/events.parquet"), "user_id", "ts", "value", "event_id"),
      "select user_id as symbol, ts::date as date, arg_max(value, (ts, event_id)) as close from events group by 1, 2")
query("align_calendar", lambda b: market.align_calendar(b.holdings, b.prices, b.dividends, b.portfolios), "select portfolio, symbol, date, close, amount from aligned")
query("ffill_prices", lambda b: market.filled_calendar(b.holdings, b.prices, b.dividends, b.portfolios).select("portfolio", "symbol", "date", "close"),
      "select portfolio, symbol, date, close from filled")
_INVERTED = "select * from quotes where ccy <> 'GBP' union all select base as ccy, 'GBP' as base, date, 1 / rate as rate from quotes where ccy = 'GBP'"


def _half_inverted(b: Book) -> DataFrame:
    """Quotes of which those for GBP exist as the inverse pair only."""
    q, gbp = b.quotes, F.col("ccy") == "GBP"
    return q.where(~gbp).unionByName(q.where(gbp).select(F.col("base").alias("ccy"), F.col("ccy").alias("base"), "date", (1 / F.col("rate")).alias("rate")))


query("fx_rates", lambda b: market.fx_rates(_half_inverted(b), BASE), "select ccy, date, rate from rates", "rate", 9)
query("align_fx", lambda b: market.align_fx(b.calendar.join(b.holdings.select("portfolio", "ccy").distinct(), "portfolio"), b.rates, BASE, ["portfolio"]),
      "select distinct portfolio, ccy, date, f.rate from fx f where (portfolio, ccy) in (select portfolio, ccy from hold)", "rate", 9)


def _asof(b: Book) -> DataFrame:
    """Closes as of the first of every month, for every symbol."""
    months = b.prices.select("symbol", F.trunc("date", "month").alias("at")).distinct()
    return market.asof_value(b.prices, months, ["symbol"], "close")


query("asof_value", _asof, """select m.symbol, m.at, p.close from (select distinct symbol, date_trunc('month', date)::date as at from px) m
    asof left join px p on p.symbol = m.symbol and p.date <= m.at""")  # fmt: skip
query("pence_to_pounds", lambda b: market.pence_to_pounds(b.prices.join(b.legs.select("symbol", "ccy").distinct(), "symbol")),
      "select symbol, date, case when ccy in ('GBp', 'GBX') then close / 100 else close end as close, case when ccy in ('GBp', 'GBX') then 'GBP' else ccy end as ccy from px join (select distinct symbol, ccy from legs) using (symbol)")



query("currency_universe", lambda b: market.currency_universe(b.holdings, b.legs, BASE).join(b.quotes.groupBy("ccy").agg(F.count("*").alias("days")), "ccy", "left"),
      f"""select u.ccy, days from (select ccy from hold union select cost_ccy from hold union select case when ccy in ('GBp', 'GBX') then 'GBP' else ccy end from legs) u
      left join (select ccy, count(*) as days from quotes group by 1) q using (ccy) where u.ccy <> '{BASE}'""")  # fmt: skip
query("live_filter", lambda b: nav.filled_spine(b.holdings, b.portfolios, b.prices, b.dividends), "select portfolio, symbol, date, close, amount from live")
query("analysis_window", lambda b: b.windows, 'select series_id, "window", lo, hi from windows')
query("rebase_100", lambda b: series.rebase_100(b.series), f"select series_id, date, value / first_value(value) over (partition by series_id order by date {PAST}) * 100 as value from s", "value")
query("thin_series", lambda b: series.thin_series(b.prices.select(F.col("symbol").alias("series_id"), "date", F.col("close").alias("value"))),
      """select series_id, date, value from (select symbol as series_id, date, close as value, row_number() over (partition by symbol order by date) - 1 as k, count(*) over (partition by symbol) as n from px)
    where k % ceil(n / 170.0)::bigint = 0 or k = n - 1""")  # fmt: skip
query("round_publish", lambda b: series.round_publish(drawdown.max_drawdown(b.series).join(metrics.sharpe_block(b.series), "series_id"), ("max_dd", "ulcer", "pain"), ("sharpe",), ("sortino",)).select("series_id", "max_dd", "ulcer", "pain", "sharpe", "sortino"),
      f"""select m.series_id, round(max_dd * 100, 2) as max_dd, round(ulcer * 100, 2) as ulcer, round(pain * 100, 2) as pain, round(mu * 252 / (sd * {ROOT}), 2) as sharpe, round(mu * 252 / (dsd * {ROOT}), 4) as sortino
      from mdd m join (select series_id, avg(r) as mu, stddev_samp(r) as sd, sqrt(avg(r * r) filter (r < 0)) as dsd from r group by 1) x using (series_id)""", "max_dd ulcer pain sharpe sortino", 4)  # fmt: skip

# --- portfolios ----------------------------------------------------------------------------------------------
query("component_values", lambda b: b.components.select("portfolio", "symbol", "date", "value"), "select portfolio, symbol, date, value from comp")
query("dividend_cash", lambda b: nav.dividend_cash(b.components), "select portfolio, date, cash from cash", "cash", 4)
query("nav", lambda b: b.nav, "select portfolio, date, nav, cash from nav", "nav cash", 4)
query("invested_capital", lambda b: b.capital, "select portfolio, first_day, capital from cap", "capital", 4)
query("positions", lambda b: nav.positions(b.components, b.holdings, b.rates, BASE, b.nav, b.calendar), f"""select h.portfolio, h.symbol, h.shares, x.px * q as last_px, (x.px * q / h.cost_px - 1) * 100 as pl_pct, (x.value / cb - 1) * 100 as pl_base_pct,
      x.value, cb as cost_base, (x.value - cb) / c.capital * 100 as contrib_pp, x.value / n.nav * 100 as weight_now_pct, cb / c.capital * 100 as weight_cost_pct, x.vol * 100 as vol_pct, x.max_dd * 100 as max_dd_pct
    from hold h join (select portfolio, symbol, arg_max(close, date) as px, arg_max(value, date) as value, stddev_samp(r) * {ROOT} as vol, min(dd) as max_dd from (
        select *, close * rate / lag(close * rate) over (partition by portfolio, symbol order by date) - 1 as r, value / max(value) over (partition by portfolio, symbol order by date {PAST}) - 1 as dd from comp) group by 1, 2) x using (portfolio, symbol)
    join days d using (portfolio) join cap c using (portfolio) join (select portfolio, arg_max(nav, date) as nav from nav group by 1) n using (portfolio)
    join (select h.portfolio, h.symbol, case when h.ccy = h.quote_ccy then 1.0e0 else a.rate / b.rate end as q, h.cost_amount * e.rate as cb from hold h join days d using (portfolio)
      join fxl a on a.portfolio = h.portfolio and a.ccy = h.ccy join fxl b on b.portfolio = h.portfolio and b.ccy = h.quote_ccy
      join fxf e on e.portfolio = h.portfolio and e.ccy = h.cost_ccy) y using (portfolio, symbol)""",
      "last_px pl_pct pl_base_pct value cost_base contrib_pp weight_now_pct weight_cost_pct vol_pct max_dd_pct", 6,
      fxl="select f.portfolio, f.ccy, f.rate from fx f join days d on d.portfolio = f.portfolio and d.last_day = f.date", fxf="select f.portfolio, f.ccy, f.rate from fx f join days d on d.portfolio = f.portfolio and d.first_day = f.date")
query("attribution_window", lambda b: series.attribution_window(nav.held_components(b.held, _windows(b)), b.nav, b.windows), f"""select c.portfolio, c."window", c.symbol, c0 / n0 as weight_start, c1 / n1 as weight_end, c1 / n1 - c0 / n0 as drift, c1 / c0 - 1 as r,
      (c1 - c0) / n0 * 100 as contribution_pp, sd * {ROOT} as vol, max_dd from (
      select portfolio, "window", symbol, arg_min(value, date) as c0, arg_max(value, date) as c1, stddev_samp(r) as sd, min(dd) as max_dd from (
        select c.portfolio, w."window", c.symbol, c.date, c.value, c.value / lag(c.value) over v - 1 as r, c.value / max(c.value) over (partition by c.portfolio, w."window", c.symbol order by c.date {PAST}) - 1 as dd
        from comp c join windows w on w.series_id = c.portfolio and c.date between w.lo and w.hi where c.value is not null window v as (partition by c.portfolio, w."window", c.symbol order by c.date)) group by 1, 2, 3) c
      join (select n.portfolio, w."window", arg_min(nav, date) as n0, arg_max(nav, date) as n1 from nav n join windows w on w.series_id = n.portfolio and n.date between w.lo and w.hi group by 1, 2) n
        on n.portfolio = c.portfolio and n."window" = c."window" """, "weight_start weight_end drift r contribution_pp vol max_dd")  # fmt: skip
query("benchmark_nav", lambda b: b.benchmarks, "select benchmark, portfolio, date, value from bench", "value")
query("benchmark_pairs", lambda b: b.pairs, "select portfolio, benchmark, date, p, b from pairs", "p b", 8)

# --- periods -------------------------------------------------------------------------------------------------
query("daily_returns", lambda b: series.daily_returns(b.series), "select series_id, date, r from r", "r", 8)


def _periods(b: Book) -> DataFrame:
    frames = [series.period_returns(b.series, f).withColumn("freq", F.lit(f)) for f in ("week", "month", "quarter", "year")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


query("period_returns", _periods, " union all ".join(f"select series_id, period, r, '{f}' as freq from r_{f}" for f in ("week", "month", "quarter", "year")), "r", 8)
query("weekly_series", lambda b: series.weekly_series(b.nav, b.capital), """select w.portfolio, w.period, w.nav, w.nav / c.capital * 100 as index_pct, d.drawdown from (select series_id as portfolio, period, value as nav from last_week where series_id in (select portfolio from ports)) w join cap c using (portfolio)
    join (select series_id as portfolio, (date + cast((12 - isodow(date)) % 7 as int))::date as period, arg_max(dd, date) as drawdown from dd group by 1, 2) d using (portfolio, period)""", "nav index_pct drawdown", 4)  # fmt: skip
query("weekly_benchmark_index", lambda b: series.weekly_index(b.benchmarks), f"select portfolio, benchmark, {PERIOD['week']} as period, arg_max(value, date) as value from bench group by 1, 2, 3", "value", 5)
_MONTHS = ", ".join(f"max(case when month(period) = {m} then r * 100 end) as m{m:02d}" for m in range(1, 13))
query("monthly_matrix", lambda b: series.monthly_matrix(b.series), f"select series_id, year(period)::int as year, {_MONTHS}, (product(1 + r * 100 / 100) - 1) * 100 as total from r_month group by 1, 2", " ".join(f"m{m:02d}" for m in range(1, 13)) + " total", 5)
query("annual_returns", lambda b: series.annual_returns(b.series), """select y.series_id, year(period)::int as year, y.value / case when y.prev is null then g.v0 else y.before end - 1 as r,
    (y.prev is null and month(g.d0) > 1) or year(period) = year(g.d1) as partial, case when y.prev is null then g.d0 else make_date(year(period), 1, 1) end as from_date,
    case when year(period) = year(g.d1) then g.d1 else period end as to_date from step_year y join g using (series_id) where y.prev is null or y.prev = make_date(year(period) - 1, 12, 31)""", "r", 8)  # fmt: skip
query("quarterly_returns", lambda b: series.quarterly_returns(b.series), "select series_id, year(period) || ' Q' || quarter(period) as quarter, r from r_quarter", "r", 8)
query("seasonality", lambda b: series.seasonality(b.series), """select x.series_id, m.month::int as month, count(r) as n, avg(r) as mean, quantile_cont(r, 0.5) as median, avg(case when r > 0 then 1.0e0 when r <= 0 then 0.0e0 end) as positive
    from (select distinct series_id from s) x cross join generate_series(1, 12) m(month) left join r_month p on p.series_id = x.series_id and month(p.period) = m.month group by 1, 2""", "mean median positive", 8)  # fmt: skip


def _rolled(b: Book) -> DataFrame:
    return series.rolling_compound(b.series, 12).withColumn("months", F.lit(12)).unionByName(series.rolling_compound(b.series, 6).withColumn("months", F.lit(6)))


_ROLLED = lambda n: f"select series_id, period, r from (select series_id, period, product(1 + r) over w - 1 as r, count(*) over w as c from r_month window w as (partition by series_id order by period rows between {n - 1} preceding and current row)) where c = {n}"
query("rolling_compound", _rolled, f"select series_id, period, r, 12 as months from ({_ROLLED(12)}) union all select series_id, period, r, 6 from ({_ROLLED(6)})", "r")

# --- metrics -------------------------------------------------------------------------------------------------
_count = lambda t: f"(select count(*) from {t} x where x.series_id = g.series_id)"
query("sample_info", lambda b: metrics.sample_info(b.series).drop("v0", "v1"), f"select series_id, d0 as from_date, d1 as to_date, years, {_count('r')} as n_daily, {_count('r_week')} as n_weekly, {_count('r_month')} as n_monthly, {_count('r_quarter')} as n_quarterly, 0.0e0 as rf from g", "years")
_best = lambda n: f"max(r) as best_{n}, min(r) as worst_{n}, avg((r > 0)::int) as positive_{n}"
query("return_stats", lambda b: metrics.return_stats(b.series), f"""select * from (select series_id, total, cagr from g) join (select series_id, {_best('day')}, avg(r) * 252 as mean_annual from r group by 1) using (series_id)
    left join (select series_id, {_best('week')} from r_week group by 1) using (series_id) left join (select series_id, {_best('month')} from r_month group by 1) using (series_id) left join (select series_id, {_best('quarter')} from r_quarter group by 1) using (series_id)""",
      "total cagr mean_annual " + " ".join(f"{a}_{n}" for n in ("day", "week", "month", "quarter") for a in ("best", "worst", "positive")))
query("win_loss", lambda b: metrics.win_loss(b.series), """select series_id, up / nu as mean_gain, dn / nd as mean_loss, (up / nu) / abs(dn / nd) as win_loss, coalesce(up, 0) / abs(dn) as profit_factor, gain_to_pain, expectancy
    from (select series_id, sum(r) filter (r > 0) as up, count(*) filter (r > 0) as nu, sum(r) filter (r < 0) as dn, count(*) filter (r < 0) as nd, avg(r) as expectancy from r group by 1)
    left join (select series_id, sum(r) / abs(sum(r) filter (r < 0)) as gain_to_pain from r_month group by 1) using (series_id)""", "mean_gain mean_loss win_loss profit_factor gain_to_pain expectancy")  # fmt: skip
_run = lambda stop, on, name: f"select series_id, max(n)::bigint as {name} from (select series_id, grp, sum(({on})::int) as n from (select *, sum(({stop})::int) over (partition by series_id order by date {PAST}) as grp from r) group by 1, 2) group by 1"
query("streaks", lambda b: metrics.streaks(b.series), f"select * from ({_run('r <= 0', 'r > 0', 'longest_up')}) join ({_run('r >= 0', 'r < 0', 'longest_down')}) using (series_id)")
query("volatility", lambda b: metrics.volatility(b.series), f"""select * from (select series_id, stddev_samp(r) * {ROOT} as vol_daily, stddev_samp(r) filter (n - k <= 30) * {ROOT} as vol_30, stddev_samp(r) filter (n - k <= 90) * {ROOT} as vol_90,
    sqrt((sum(0.06e0 * pow(0.94e0, n - 1 - k) * r * r) + max(case when k = 0 then pow(0.94e0, n) * r * r end)) * 252) as vol_ewma from rn group by 1)
    left join (select series_id, stddev_samp(r) * sqrt(52.0e0) as vol_weekly from r_week group by 1) using (series_id) left join (select series_id, stddev_samp(r) * sqrt(12.0e0) as vol_monthly from r_month group by 1) using (series_id)""", "vol_daily vol_30 vol_90 vol_ewma vol_weekly vol_monthly")  # fmt: skip
query("downside_risk", lambda b: metrics.downside_risk(b.series), f"select series_id, coalesce(sqrt(avg(r * r) filter (r < 0)), 0) * {ROOT} as downside_deviation, coalesce(avg(r * r) filter (r < 0), 0) * 252 as semivariance from r group by 1", "downside_deviation semivariance")
#: Population moments written out: what SQL engines call skewness differs.
_MOM = """select series_id, count(*) as n, any_value(mu) as mu, stddev_samp(r) as sd, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5e0) as s, avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3 as k,
    coalesce(sqrt(avg(r * r) filter (r < 0)), 0) as dsd from (select *, avg(r) over (partition by series_id) as mu from r) group by 1"""
_MOM_M = _MOM.replace("from r)", "from r_month)")
_cf = lambda z: f"({z}e0 + ({z}e0 * {z}e0 - 1) * s / 6 + (pow({z}e0, 3) - 3 * {z}e0) * k / 24 - (2 * pow({z}e0, 3) - 5 * {z}e0) * s * s / 36)"
_TAIL_M = "select series_id, -max(q) as month_hist_95, -avg(r) filter (r <= q) as month_cvar_95 from (select series_id, r, q from r_month join (select series_id, quantile_cont(r, 0.05) as q from r_month group by 1) using (series_id)) group by 1 having count(*) >= 12"
query("var_cvar", lambda b: metrics.var_cvar(b.series), "select series_id, " + ", ".join(f"-q{lv} as hist_{lv}, {z}e0 * sd - mu as gauss_{lv}, {_cf(z)} * sd - mu as cornish_fisher_{lv}, -t{lv} as cvar_{lv}" for lv, z in Z.items())
      + """, month_hist_95, month_cvar_95 from mom join (select series_id, max(q95) as q95, max(q99) as q99, avg(r) filter (r <= q95) as t95, avg(r) filter (r <= q99) as t99
      from r join (select series_id, quantile_cont(r, 0.05) as q95, quantile_cont(r, 0.01) as q99 from r group by 1) using (series_id) group by 1) using (series_id) left join tm using (series_id)""",
      " ".join(f"hist_{lv} gauss_{lv} cornish_fisher_{lv} cvar_{lv}" for lv in Z) + " month_hist_95 month_cvar_95", mom=_MOM, tm=_TAIL_M)
query("scaled_var", lambda b: metrics.scaled_var(b.series), f"""select series_id, {Z[95]}e0 * v * sqrt(5 / 252.0e0) as var95_week, {Z[95]}e0 * v * sqrt(21 / 252.0e0) as var95_month, {Z[95]}e0 * v as var95_year, {Z[99]}e0 * v * sqrt(21 / 252.0e0) as var99_month,
    {Z95_SUMMARY}e0 * v * sqrt(5 / 252.0e0) as var95_week_summary from (select series_id, stddev_samp(r) * {ROOT} as v from r group by 1)""", "var95_week var95_month var95_year var99_month var95_week_summary")  # fmt: skip
query("tail_ratios", lambda b: metrics.tail_ratios(b.series), """select series_id, quantile_cont(r, 0.95) / abs(quantile_cont(r, 0.05)) as tail_ratio,
    quantile_cont(r, 0.95) / abs(quantile_cont(r, 0.05)) * coalesce(sum(r) filter (r > 0), 0) / abs(sum(r) filter (r < 0)) as common_sense_ratio from r group by 1""", "tail_ratio common_sense_ratio")  # fmt: skip
_SE = f"(sqrt((1 + 0.5e0 * sr * sr / 252) / n) * {ROOT})"
_SR = f"select *, case when sd > 0 then mu * 252 / (sd * {ROOT}) else 0 end as sr from mom"
query("sharpe_block", lambda b: metrics.sharpe_block(b.series), f"select series_id, sr as sharpe, {_SE} as sharpe_error, sr - 1.96e0 * {_SE} as sharpe_low, sr + 1.96e0 * {_SE} as sharpe_high, case when dsd > 0 then mu * 252 / (dsd * {ROOT}) end as sortino from srs",
      "sharpe sharpe_error sharpe_low sharpe_high sortino", mom=_MOM, srs=_SR)
_BEST = f"((1.0e0 - {EULER}e0) * {norm_ppf('(1.0e0 - 1.0e0 / 6.0e0)')} + {EULER}e0 * {norm_ppf('(1.0e0 - 1.0e0 / (6.0e0 * exp(1.0e0)))')})"
query("psr_dsr", lambda b: metrics.psr_dsr(b.series), f"""select series_id, {norm_cdf('x')} as psr, {norm_cdf('y')} as dsr from (select series_id, d * sqrt(n - 1) / den as x, (d - {_BEST} / sqrt(n - 1)) * sqrt(n - 1) / den as y
    from (select *, sr / {ROOT} as d, sqrt(1 - s * sr / {ROOT} + (k + 2) / 4 * sr * sr / 252) as den from srs))""", "psr dsr", 5, mom=_MOM, srs=_SR)  # fmt: skip
query("drawdown_ratios", lambda b: metrics.drawdown_ratios(b.series), """select g.series_id, cagr / abs(nullif(max_dd, 0)) as calmar, cagr / abs(five) as sterling, cagr / root as burke, cagr / nullif(ulcer, 0) as martin, cagr / nullif(pain, 0) as pain_ratio, total / abs(nullif(max_dd, 0)) as recovery_factor
    from g join mdd using (series_id) left join (select series_id, avg(depth) filter (rank <= 5) as five, sqrt(sum(depth * depth) filter (rank <= 8)) as root from episodes group by 1) using (series_id)""", "calmar sterling burke martin pain_ratio recovery_factor", 5)  # fmt: skip
query("omega_kappa", lambda b: metrics.omega_kappa(b.series), """select series_id, coalesce(sum(r) filter (r > 0), 0) / -sum(r) filter (r <= 0) as omega,
    avg(r) * 252 / (pow(-avg(r * r * r) filter (r < 0), 1 / 3.0e0) * pow(252, 1 / 3.0e0)) as kappa3 from r group by 1""", "omega kappa3")  # fmt: skip
query("summary_stats", lambda b: metrics.summary_stats(b.series), f"""select g.series_id, total, cagr, sd * {ROOT} as vol, mu / sd * {ROOT} as sharpe, mu / dsd * {ROOT} as sortino, cagr / abs(max_dd) as calmar, max_dd, -q as var95_day, {Z95_SUMMARY}e0 * sd * {ROOT} * sqrt(5 / 252.0e0) as var95_week,
      best_day, worst_day, days_positive, months_n, months_positive, best_month, worst_month, month_hist_95, month_cvar_95, case when months_n >= 12 then ms * sqrt(months_n * (months_n - 1.0e0)) / (months_n - 2) end as month_skew,
      case when months_n >= 12 then (months_n - 1.0e0) / ((months_n - 2.0e0) * (months_n - 3)) * ((months_n + 1) * mk + 6) end as month_kurtosis, rolling12_median, rolling12_min, rolling12_max, rolling12_positive, coalesce(rolling12_n, 0) as rolling12_n
    from g join mom using (series_id) join (select series_id, quantile_cont(r, 0.05) as q, max(r) as best_day, min(r) as worst_day, avg((r > 0)::int) as days_positive from r group by 1) using (series_id) join mdd using (series_id)
    left join (select series_id, n as months_n, s as ms, k as mk from momm) using (series_id) left join (select series_id, avg((r > 0)::int) as months_positive, max(r) as best_month, min(r) as worst_month from r_month group by 1) using (series_id) left join tm using (series_id)
    left join (select series_id, quantile_cont(r, 0.5) as rolling12_median, min(r) as rolling12_min, max(r) as rolling12_max, avg((r > 0)::int) as rolling12_positive, count(*) as rolling12_n from ({_ROLLED(12)}) group by 1) using (series_id)""",
      "total cagr vol sharpe sortino calmar max_dd var95_day var95_week best_day worst_day days_positive months_positive best_month worst_month month_hist_95 month_cvar_95 month_skew month_kurtosis rolling12_median rolling12_min rolling12_max rolling12_positive", 5,
      mom=_MOM, momm=_MOM_M, tm=_TAIL_M)

# --- drawdowns -----------------------------------------------------------------------------------------------
query("drawdown_series", lambda b: drawdown.drawdown_series(b.series).drop("value"), "select series_id, date, dd from dd", "dd")
query("max_drawdown", lambda b: drawdown.max_drawdown(b.series), "select series_id, max_dd, max_dd_date, ulcer, pain from mdd", "max_dd ulcer pain")
query("drawdown_episodes", lambda b: drawdown.drawdown_episodes(b.series), "select series_id, rank::int as rank, peak, trough, recovery, depth, days_down::int as days_down, days_to_recover::int as days_to_recover, days_total::int as days_total, ongoing from episodes where rank <= 8", "depth")
query("underwater_time", lambda b: drawdown.underwater_time(b.series), """select d.series_id, share_under, mean_dd, coalesce(mean_days, 0) as mean_days, coalesce(max_days, 0)::int as max_days, coalesce(episodes, 0) as episodes
    from (select series_id, avg((dd < -1e-12)::int) as share_under, coalesce(avg(dd) filter (dd < 0), 0) as mean_dd from dd group by 1) d left join (select series_id, avg(days_total) as mean_days, max(days_total) as max_days, count(*) as episodes from episodes group by 1) e using (series_id)""", "share_under mean_dd mean_days")  # fmt: skip

# --- rolling -------------------------------------------------------------------------------------------------
_frame = lambda w, by="series_id": f"(partition by {by} order by date rows between {w - 1} preceding and current row)"
_WEEKLY = "(date + cast((12 - isodow(date)) % 7 as int))::date"
_sd = lambda w: f"select series_id, date, r, n, k, avg(r) over {_frame(w)} as m, stddev_samp(r) over {_frame(w)} as sd from rn qualify k >= {w - 1}"

query("rolling_vol", lambda b: rolling.rolling_vol(b.series, 30, 60, 90, 252),
      " union all ".join(f"select series_id, {_WEEKLY} as period, arg_max(sd * {ROOT}, date) as vol, {w} as days from ({_sd(w)}) group by 1, 2" for w in (30, 60, 90, 252)), "vol", 5)
query("rolling_sharpe", lambda b: rolling.rolling_sharpe(b.series, 126, 252),
      " union all ".join(f"select series_id, {_WEEKLY} as period, arg_max(m * 252 / (sd * {ROOT}), date) as sharpe, {w} as days from ({_sd(w)}) where sd > 0 group by 1, 2" for w in (126, 252)), "sharpe", 5)
query("rolling_sortino", lambda b: rolling.rolling_sortino(b.series), f"""select series_id, {_WEEKLY} as period, arg_max(m * 252 / (sqrt(d) * {ROOT}), date) as sortino from (select series_id, date, k, avg(r) over {_frame(252)} as m, avg(case when r < 0 then r * r end) over {_frame(252)} as d from rn qualify k >= 251) where d > 0 group by 1, 2""", "sortino", 5)
query("rolling_beta_corr", lambda b: rolling.rolling_beta_corr(b.pairs), f"""select portfolio, benchmark, {_WEEKLY} as period, arg_max(beta, date) as beta, arg_max(corr, date) as corr from (select portfolio, benchmark, date, row_number() over (partition by portfolio, benchmark order by date) as k, count(*) over (partition by portfolio, benchmark) as n,
    covar_samp(p, b) over {_frame(126, 'portfolio, benchmark')} / var_samp(b) over {_frame(126, 'portfolio, benchmark')} as beta, corr(p, b) over {_frame(126, 'portfolio, benchmark')} as corr from pairs) where k >= 126 and n >= 150 group by 1, 2, 3""", "beta corr", 5)  # fmt: skip
query("excess_cumulative", lambda b: rolling.excess_cumulative(b.pairs), f"select portfolio, benchmark, date, product(1 + p) over w / product(1 + b) over w - 1 as excess from pairs window w as (partition by portfolio, benchmark order by date {PAST})", "excess", 5)
query("ewma_vol", lambda b: rolling.ewma_vol(b.series), """select a.series_id, a.date, sqrt(252 * (sum(0.06e0 * pow(0.94e0, a.k - c.k) * c.r * c.r) + max(case when c.k = 0 then pow(0.94e0, a.k + 1) * c.r * c.r end))) as vol
    from rn a join rn c on c.series_id = a.series_id and c.k <= a.k group by 1, 2""", "vol")  # fmt: skip
query("vol_cone", lambda b: rolling.vol_cone(b.series), " union all ".join(f"""select series_id, {w} as days, min(sd) * {ROOT} as min, quantile_cont(sd, 0.25) * {ROOT} as p25, quantile_cont(sd, 0.5) * {ROOT} as median, quantile_cont(sd, 0.75) * {ROOT} as p75, max(sd) * {ROOT} as max,
    arg_max(sd, date) * {ROOT} as current from ({_sd(w)}) group by 1 having max(n) >= {w + 20}""" for w in (21, 63, 126, 252)), "min p25 median p75 max current", 5)  # fmt: skip
query("worst_windows", lambda b: rolling.worst_windows(b.series), " union all ".join(f"""select series_id, {w} as steps, min(r) as worst, max(r) as best, quantile_cont(r, 0.5) as median, avg((r < 0)::int) as negative, arg_min(date, (r, date)) as worst_end
    from (select series_id, date, value / lag(value, {w}) over (partition by series_id order by date) - 1 as r from s) where r is not null group by 1""" for w in (5, 21, 63, 126, 252)), "worst best median negative")  # fmt: skip
query("vol_regimes", lambda b: rolling.vol_regimes(b.series), f"""select series_id, (case when sd <= a then 1 when sd <= b then 2 when sd <= c then 3 else 4 end)::int as regime, count(*) as days, avg(sd) * {ROOT} as mean_vol, avg(r) * 252 as annual_return, avg((r > 0)::int) as positive, min(r) as worst_day
    from v join (select series_id, quantile_cont(sd, 0.25) as a, quantile_cont(sd, 0.5) as b, quantile_cont(sd, 0.75) as c from v group by 1) using (series_id) group by 1, 2""", "mean_vol annual_return positive worst_day", 5, v=_sd(21))  # fmt: skip
query("market_phases", lambda b: rolling.market_phases(b.pairs), "select portfolio, benchmark, case when b > 0 then 'up' else 'down' end as phase, count(*) as days, avg(p) * 252 as portfolio_annual, avg(b) * 252 as benchmark_annual, avg(p) / avg(b) as capture from pairs where b <> 0 group by 1, 2, 3", "portfolio_annual benchmark_annual capture")
query("moments", lambda b: rolling.moments(b.series), "select series_id, m.s as skew, m.k as kurtosis, x.s as month_skew, x.k as month_kurtosis from mom m left join (select * from momm where n >= 12) x using (series_id)", "skew kurtosis month_skew month_kurtosis", 5, mom=_MOM, momm=_MOM_M)
_JB = "n / 6.0e0 * (s * s + k * k / 4)"
query("jarque_bera", lambda b: rolling.jarque_bera(b.series), f"select series_id, {_JB} as jb, exp(-({_JB}) / 2) as p, exp(-({_JB}) / 2) < 0.05 as rejected from mom", "jb p", 4, mom=_MOM)
_lags = range(1, 11)
query("ljung_box", lambda b: rolling.ljung_box(b.series), f"select series_id, q, {chi2_tail('q')} as p, {', '.join(f'acf{k}' for k in _lags)} from (select *, n * (n + 2) * ({' + '.join(f'acf{k} * acf{k} / (n - {k})' for k in _lags)}) as q from (select series_id, count(*)::double as n, {', '.join(f'sum(x * l{k}) / sum(x * x) as acf{k}' for k in _lags)} from (select series_id, x, {', '.join(f'lag(x, {k}) over (partition by series_id order by date) as l{k}' for k in _lags)} from (select *, r - avg(r) over (partition by series_id) as x from r)) group by 1))",
      "q p " + " ".join(f"acf{k}" for k in _lags), 5)
query("hurst", lambda b: rolling.hurst(b.series), f"""select x.series_id, hurst from (select distinct series_id from s) x left join (select series_id, regr_slope(ln(rs), ln(w)) as hurst from (
    select series_id, w, avg(rg / sd) as rs from (select series_id, w, block, max(run) - min(run) as rg, stddev_samp(r) as sd from (select *, sum(c) over (partition by series_id, w, block order by date {PAST}) as run from (
      select *, r - avg(r) over (partition by series_id, w, block) as c from (select rn.*, w, k // w as block from rn cross join (values (10), (20), (40), (80), (160), (320)) z(w) where n >= 120 and w * 2 <= n and (k // w + 1) * w <= n))) group by 1, 2, 3) where sd > 0 group by 1, 2) group by 1 having count(*) >= 3) using (series_id)""", "hurst", 5)  # fmt: skip
query("histogram", lambda b: rolling.histogram(b.series), f"""select e.series_id, i.bin::int as bin, lo + (i.bin + 0.5e0) * width as centre, (select count(*) from r x where x.series_id = e.series_id and least(floor((x.r - lo) / width), 40) = i.bin) as count, {norm_pdf('(lo + (i.bin + 0.5e0) * width)', 'mu', 'sd')} * n * width as normal
    from (select series_id, min(r) as lo, max(r) as hi, avg(r) as mu, stddev_samp(r) as sd, count(*) as n, (max(r) - min(r)) / 41 as width from r group by 1) e cross join generate_series(0, 40) i(bin) where hi > lo""", "centre normal", 5)  # fmt: skip
query("qq_points", lambda b: rolling.qq_points(b.series), f"""select series_id, i::int as i, mu + sd * {norm_ppf('((i + 0.5e0) / n)')} as normal, r as observed from (select series_id, r, row_number() over (partition by series_id order by r, date) - 1 as i, count(*) over (partition by series_id) as n, avg(r) over (partition by series_id) as mu, stddev_samp(r) over (partition by series_id) as sd from r)
    where i % greatest(1, n // 200) = 0""", "normal observed")  # fmt: skip
# For series beyond one buffer: the same results by narrowed ranges; and the returns of all portfolios of a year as one group.
for _name, _long in (("var_cvar", metrics.var_cvar), ("tail_ratios", metrics.tail_ratios), ("vol_cone", rolling.vol_cone), ("vol_regimes", rolling.vol_regimes)):
    _sql, _own, _tables = PARTS[_name]
    query(f"long_{_name}", lambda b, f=_long: f(b.series, long=True), _sql, " ".join(_own), 6 if _name in ("var_cvar", "tail_ratios") else 5, **_tables)
POOLED = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def pooled_quantiles(b: Book) -> DataFrame:
    returns = series.daily_returns(b.series).withColumn("year", F.year("date"))
    q = quantiles.narrowed_quantiles(returns, ("year",), "r", tuple(POOLED.values()))
    return q.select("year", "n", *(F.col(f"q{i}").alias(c) for i, c in enumerate(POOLED)))


query("pooled_quantiles", pooled_quantiles, f"select year(date)::int as year, count(*) as n, {', '.join(f'quantile_cont(r, {p}) as {c}' for c, p in POOLED.items())} from r group by 1", " ".join(POOLED))

# --- risk ----------------------------------------------------------------------------------------------------
_ann = lambda x, n: f"(pow({x}, 252.0e0 / greatest({n}, 1)) - 1)"
query("benchmark_metrics", lambda b: risk.benchmark_metrics(b.pairs, b.nav_series, b.benchmarks), f"""select a.portfolio, a.benchmark, beta, alpha * 252 as alpha, corr, corr * corr as r2, te * {ROOT} as tracking_error, (mp - mb) * 252 / (te * {ROOT}) as information_ratio,
      case when nu > 5 then {_ann('pu', 'nu')} / {_ann('bu', 'nu')} end as up_capture, case when nd > 5 then {_ann('pd', 'nd')} / {_ann('bd', 'nd')} end as down_capture, case when nu > 20 then beta_up end as beta_up, case when nd > 20 then beta_down end as beta_down, batting,
      mp * 252 / (sp * {ROOT}) * sb * {ROOT} as m2, b_total as bench_total, b_cagr as bench_cagr, sb * {ROOT} as bench_vol, b_dd as bench_max_dd, g.total - b_total as excess_return, n
    from (select portfolio, benchmark, count(*) as n, regr_slope(p, b) as beta, regr_intercept(p, b) as alpha, corr(p, b) as corr, stddev_samp(p - b) as te, avg(p) as mp, avg(b) as mb, stddev_samp(p) as sp, stddev_samp(b) as sb, count(*) filter (b > 0) as nu, count(*) filter (b < 0) as nd,
      product(1 + p) filter (b > 0) as pu, product(1 + b) filter (b > 0) as bu, product(1 + p) filter (b < 0) as pd, product(1 + b) filter (b < 0) as bd, regr_slope(p, b) filter (b > 0) as beta_up, regr_slope(p, b) filter (b < 0) as beta_down, avg((p > b)::int) as batting from pairs group by 1, 2 having count(*) >= 60) a
    join (select portfolio, benchmark, arg_max(value, date) / arg_min(value, date) - 1 as b_total, pow(arg_max(value, date) / arg_min(value, date), 1 / ((max(date) - min(date)) / 365.25e0)) - 1 as b_cagr from bench group by 1, 2) c using (portfolio, benchmark)
    join (select portfolio, benchmark, min(d) as b_dd from (select *, value / max(value) over (partition by portfolio, benchmark order by date {PAST}) - 1 as d from bench) group by 1, 2) e using (portfolio, benchmark) join g on g.series_id = a.portfolio""",
      "beta alpha corr r2 tracking_error information_ratio up_capture down_capture beta_up beta_down batting m2 bench_total bench_cagr bench_vol bench_max_dd excess_return", 5)
query("corr_matrix", lambda b: heldrisk.corr_matrix(b.held), "select a.portfolio, a.symbol as i, b.symbol as j, corr(a.r, b.r) as corr from cr a join cr b using (portfolio, date) where a.symbol <= b.symbol and a.rows >= 40 group by 1, 2, 3", "corr")
query("cov_matrix", lambda b: heldrisk.cov_matrix(b.held), "select portfolio, i, j, cov from cov where i <= j", "cov")
query("corr_benchmark", lambda b: heldrisk.corr_benchmark(b.held, b.benchmark_returns), "select portfolio, symbol, benchmark, corr(cr.r, br.b) as corr from cr join br using (portfolio, date) group by 1, 2, 3", "corr")
_PER = """select portfolio, i, wi, sum(cov * wj) as cw, sqrt(sum(cov) filter (i = j)) as vol from cov join (select portfolio, symbol as i, w as wi from w0) using (portfolio, i) join (select portfolio, symbol as j, w as wj from w0) using (portfolio, j) group by 1, 2, 3"""
_W0 = "select portfolio, symbol, v / nav as w from (select portfolio, symbol, arg_max(value, date) as v from comp group by 1, 2) join (select portfolio, arg_max(nav, date) as nav from nav group by 1) using (portfolio)"
_TOT = "select portfolio, sqrt(sum(wi * cw)) as vp, sum(wi * vol) as sum_vol, sum(wi * wi) as hhi, count(*) as positions from per group by 1"
query("risk_decomposition", lambda b: heldrisk.risk_decomposition(b.held, b.nav)[0], f"select portfolio, i as symbol, wi as weight, vol, cw / vp as mrc, wi * cw / vp as contribution, wi * cw / (vp * vp) as risk_share, wi * cw / (vp * vp) * {Z[95]}e0 * vp / {ROOT} as component_var95, cw / (vp * vp) as beta from per join tot using (portfolio)",
      "weight vol mrc contribution risk_share component_var95 beta", w0=_W0, per=_PER, tot=_TOT)
query("risk_totals", lambda b: heldrisk.risk_decomposition(b.held, b.nav)[1], "select portfolio, vp as vol, sum_vol, sum_vol - vp as benefit, sum_vol / vp as ratio, hhi, 1 / hhi as effective_positions, positions from tot",
      "vol sum_vol benefit ratio hhi effective_positions", w0=_W0, per=_PER, tot=_TOT)
query("wide_corr_matrix", lambda b: heldrisk.corr_matrix(b.held), PARTS["corr_matrix"][0], "corr", wide=True)
query("wide_risk_decomposition", lambda b: heldrisk.risk_decomposition(b.held, b.nav)[0], PARTS["risk_decomposition"][0], " ".join(PARTS["risk_decomposition"][1]), wide=True, **PARTS["risk_decomposition"][2])
#: Jacobi rotations one after the other, eight sweeps over all pairs of components.
_TURNED = """select portfolio, m, step + 1 as step, list_transform(range(m * m), lambda k: case k // m when p then c * b[k + 1] - s * b[q * m + k % m + 1] when q then s * b[p * m + k % m + 1] + c * b[k + 1] else b[k + 1] end) as a
    from (select *, list_transform(range(m * m), lambda k: case k % m when p then c * a[k + 1] - s * a[k - p + q + 1] when q then s * a[k - q + p + 1] + c * a[k + 1] else a[k + 1] end) as b
    from (select *, 1 / sqrt(1 + t * t) as c, t / sqrt(1 + t * t) as s from (select *, case when apq = 0 then 0 else (case when tau < 0 then -1 else 1 end) / (abs(tau) + sqrt(1 + tau * tau)) end as t
    from (select *, (a[q * m + q + 1] - a[p * m + p + 1]) / (2 * apq) as tau from (select *, a[p * m + q + 1] as apq from (
      select r.*, pairs[step % len(pairs) + 1].p as p, pairs[step % len(pairs) + 1].q as q from turned r join pairs using (m) where step < 8 * len(pairs)))))))"""
_BETS = f"""with recursive mat as (select portfolio, sqrt(count(*))::bigint as m, list(cov order by i, j) as a from cov group by 1 having count(*) > 1),
    pairs as materialized (select m, list({{'p': p, 'q': q}} order by p, q) as pairs from (select distinct m from mat) cross join range(400) x(p) cross join range(400) y(q) where p < q and q < m group by 1),
    turned as (select portfolio, m, 0 as step, a from mat union all {_TURNED})
    select portfolio, exp(-sum(e / total * ln(e / total))) as effective_bets from (select *, sum(e) over (partition by portfolio) as total from (
      select portfolio, a[k * m + k + 1] as e from (select portfolio, m, a, unnest(range(m)) as k from (select portfolio, m, arg_max(a, step) as a from turned group by 1, 2))) where e > 1e-14) group by 1"""
query("effective_bets", lambda b: risk.bets(heldrisk.cov_matrix(b.held, size=2)), _BETS, "effective_bets", 5)

# --- resampling and windows ----------------------------------------------------------------------------------
_DRAW = f"('0x' || substr(md5('{risk.SEED}:' || series_id || ':' || years || ':' || path || ':' || (step // 4)), 1 + 8 * (step % 4), 8))::bigint"
query("block_bootstrap", lambda b: risk.block_bootstrap(b.nav_series), f"""select series_id, years::int as years, quantile_cont(final, 0.05) as p05, quantile_cont(final, 0.25) as p25, quantile_cont(final, 0.5) as p50, quantile_cont(final, 0.75) as p75, quantile_cont(final, 0.95) as p95,
      avg((final < 1)::int) as p_loss, avg((final < 0.9)::int) as p_below_90, avg((final > 1.2)::int) as p_above_120, avg(final) filter (final <= q05) as cvar_final,
      quantile_cont(dd, 0.5) as dd_median, quantile_cont(dd, 0.05) as dd_p05 from ends join (select series_id, years, quantile_cont(final, 0.05) as q05 from ends group by 1, 2) q using (series_id, years) group by 1, 2""", "p05 p25 p50 p75 p95 p_loss p_below_90 p_above_120 cvar_final dd_median dd_p05", 5,
      fn="select * from rn where series_id in (select portfolio from ports)",
      bp="""select a.series_id, a.k as start, b.k - a.k as i, a.n, product(1 + b.r) over (partition by a.series_id, a.k order by b.k rows between unbounded preceding and current row) as p from fn a join fn b on b.series_id = a.series_id and b.k between a.k and a.k + 20 where a.n >= 120 and a.k < a.n - 21""",
      bm="select *, max(p) over (partition by series_id, start order by i rows between unbounded preceding and current row) as m from bp",
      blocks="select series_id, start, any_value(n) as n, arg_max(p, i) as growth, max(p) as hi, min(p) as lo, min(p / m - 1) as dd from bm group by 1, 2",
      drawn=f"select series_id, years, path, step, {_DRAW} % (n - 21) as start from (select distinct series_id, n from blocks) cross join (values (1), (3), (5)) y(years) cross join generate_series(0, 9999) p(path) cross join generate_series(0, 59) t(step) where step < years * 12",
      p1="select d.*, growth, hi, lo, dd, coalesce(product(growth) over (partition by d.series_id, years, path order by step rows between unbounded preceding and 1 preceding), 1.0e0) as before from drawn d join blocks b on b.series_id = d.series_id and b.start = d.start",
      p2="select *, max(before * hi) over (partition by series_id, years, path order by step rows between unbounded preceding and 1 preceding) as peak from p1",
      ends="select series_id, years, path, product(growth) as final, min(least(coalesce(before * lo / peak - 1, dd), dd)) as dd from p2 group by 1, 2, 3")


_WS = 'select n.series_id || \'|\' || w."window" as series_id, n.date, n.value from ns n join windows w on w.series_id = n.series_id and n.date between w.lo and w.hi'


def _joined(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, "series_id")
    return out


def windowed_query(name: str, blocks: dict[str, Callable[[DataFrame], DataFrame]], digits: int = 5) -> None:
    """The named metric blocks of every window of every portfolio, side by side; their SQL runs on the windows' rows in the place of the series."""
    parts = [PARTS[n] for n in blocks]
    sql = "select * from " + " join ".join(f"({p[0]}) x{i}" + (" using (series_id)" if i else "") for i, p in enumerate(parts))
    tables = {t: text for p in parts for t, text in p[2].items()}
    query(name, lambda b: _joined([f(b.windowed) for f in blocks.values()]), sql, " ".join(c for p in parts for c in p[1]), digits, s=_WS, **tables)


query("windowed_metrics", lambda b: _joined([metrics.growth(b.windowed), metrics.sharpe_block(b.windowed), drawdown.max_drawdown(b.windowed), metrics.scaled_var(b.windowed)]),
      f"select * from (select series_id, total, cagr, years from g) join ({PARTS['sharpe_block'][0]}) using (series_id) join ({PARTS['max_drawdown'][0]}) using (series_id) join ({PARTS['scaled_var'][0]}) using (series_id)",
      " ".join(["total cagr years", *(c for n in ("sharpe_block", "max_drawdown", "scaled_var") for c in PARTS[n][1])]), 5, s=_WS, **PARTS["sharpe_block"][2])
windowed_query("windowed_performance", {"return_stats": metrics.return_stats, "win_loss": metrics.win_loss, "streaks": metrics.streaks, "omega_kappa": metrics.omega_kappa})
windowed_query("windowed_risk", {"volatility": metrics.volatility, "downside_risk": metrics.downside_risk, "var_cvar": metrics.var_cvar, "tail_ratios": metrics.tail_ratios, "psr_dsr": metrics.psr_dsr, "moments": rolling.moments})
windowed_query("windowed_drawdowns", {"drawdown_ratios": metrics.drawdown_ratios, "underwater_time": drawdown.underwater_time})
windowed_query("windowed_episodes", {"drawdown_episodes": drawdown.drawdown_episodes})


windowed_query("windowed_rolling_vol", {"rolling_vol": lambda s: rolling.rolling_vol(s, 30, 60, 90, 252)})
windowed_query("windowed_rolling_sharpe", {"rolling_sharpe": lambda s: rolling.rolling_sharpe(s, 126, 252)})
windowed_query("windowed_cone", {"vol_cone": rolling.vol_cone})
windowed_query("windowed_regimes", {"vol_regimes": rolling.vol_regimes})
windowed_query("windowed_worst", {"worst_windows": rolling.worst_windows})
windowed_query("windowed_distribution", {"ljung_box": rolling.ljung_box, "hurst": rolling.hurst}, 4)
windowed_query("windowed_jarque_bera", {"jarque_bera": rolling.jarque_bera}, 3)
windowed_query("windowed_histogram", {"histogram": rolling.histogram})
windowed_query("windowed_qq", {"qq_points": rolling.qq_points})
windowed_query("windowed_monthly", {"monthly_matrix": series.monthly_matrix})
windowed_query("windowed_annual", {"annual_returns": series.annual_returns})
windowed_query("windowed_quarterly", {"quarterly_returns": series.quarterly_returns})
windowed_query("windowed_seasonality", {"seasonality": series.seasonality})


def _explicit(b: Book) -> DataFrame:
    """From the first of every month of a portfolio's history on, 3, 6, 12, 24 and 36 months."""
    starts = b.nav_series.select("series_id", F.trunc("date", "month").alias("a")).distinct().withColumn("m", F.explode(F.array(*map(F.lit, (3, 6, 12, 24, 36)))))
    return starts.select("series_id", F.concat(F.col("a").cast("string"), F.lit("+"), F.col("m").cast("string")).alias("window"), "a", F.expr("add_months(a, m)").alias("b"))


_EWS = "select n.series_id || '|' || w.win as series_id, n.date, n.value from ew2 w join win0 a on a.series_id = w.series_id and a.k = w.i2 join win0 b on b.series_id = w.series_id and b.k = w.j2 join ns n on n.series_id = w.series_id and n.date between a.date and b.date"
_EXPLICIT = {
    "ew0": "select e.series_id, a::varchar || '+' || m as win, a, (a + to_months(m))::date as b, last from (select distinct series_id, date_trunc('month', date)::date as a from ns) e cross join (values (3), (6), (12), (24), (36)) l(m) join win1 using (series_id)",
    "ew1": "select *, least(last, greatest(i + 1, coalesce(j0, last))) as j from (select w.series_id, win, last, coalesce(min(k) filter (date >= a), 0) as i, min(k) filter (date >= b) as j0 from ew0 w join win0 n using (series_id) group by 1, 2, 3)",
    "ew2": "select *, case when j2 - i < 25 then greatest(0, j2 - 25) else i end as i2 from (select *, case when j - i < 25 then least(last, i + 25) else j end as j2 from ew1)",
}
query("explicit_windows", lambda b: summaries.window_statistics(b.nav_series, _explicit(b), tree=b.summary_tree).withColumn("series_id", F.concat_ws("|", "series_id", "window")).drop("window"),
      f"""select series_id, g.d0 as from_date, g.d1 as to_date, n, total, cagr, mu * 252 as mean_annual, sd * {ROOT} as vol, sr as sharpe, case when dsd > 0 then mu * 252 / (dsd * {ROOT}) end as sortino, dsd * {ROOT} as downside_deviation, s as skew, k as kurtosis,
      best_day, worst_day, positive_day, omega, profit_factor, {", ".join(f"{z}e0 * sd - mu as gauss_{lv}, {_cf(z)} * sd - mu as cornish_fisher_{lv}" for lv, z in Z.items())}, max_dd, max_dd_date, case when max_dd < 0 then cagr / abs(max_dd) end as calmar
    from g join srs using (series_id) join mdd using (series_id) join (select series_id, max(r) as best_day, min(r) as worst_day, avg((r > 0)::int) as positive_day, coalesce(sum(r) filter (r > 0), 0) / -sum(r) filter (r <= 0) as omega, coalesce(sum(r) filter (r > 0), 0) / -sum(r) filter (r < 0) as profit_factor from r group by 1) using (series_id)""",
      "total cagr mean_annual vol sharpe sortino downside_deviation skew kurtosis best_day worst_day positive_day omega profit_factor gauss_95 cornish_fisher_95 gauss_99 cornish_fisher_99 max_dd calmar", 5, **_EXPLICIT, s=_EWS, mom=_MOM, srs=_SR)


def _windows(b: Book) -> DataFrame:
    return b.windows.withColumnRenamed("series_id", "portfolio")


def _inside(b: Book, df: DataFrame, after: bool = False) -> DataFrame:
    """df's rows of each window, whose portfolio is named after the window too; after: without the window's first date, as returns have none there."""
    w = b.windows.select(F.col("series_id").alias("portfolio"), "window", "lo", "hi")
    rows = df.join(w, "portfolio").where((F.col("date") > F.col("lo") if after else F.col("date") >= F.col("lo")) & (F.col("date") <= F.col("hi")))
    return rows.withColumn("portfolio", F.concat_ws("|", "portfolio", "window")).drop("window", "lo", "hi")


_IN = lambda table, columns: f'select x.portfolio || \'|\' || w."window" as portfolio, {columns} from {table} x join windows w on w.series_id = x.portfolio and x.date between w.lo and w.hi'
query("windowed_benchmarks", lambda b: risk.benchmark_metrics(_inside(b, b.pairs, after=True), b.windowed, _inside(b, b.benchmarks)), PARTS["benchmark_metrics"][0], " ".join(PARTS["benchmark_metrics"][1]), 4,
      s=_WS, bench=_IN("bench0", "x.benchmark, x.date, x.value"))
query("windowed_correlation", lambda b: heldrisk.corr_matrix(b.held, _windows(b)), PARTS["corr_matrix"][0], "corr", 5, comp=_IN("comp0", "x.symbol, x.date, x.value"))
query("windowed_risk_totals", lambda b: heldrisk.risk_decomposition(b.held, _inside(b, b.nav), _windows(b))[1], PARTS["risk_totals"][0], " ".join(PARTS["risk_totals"][1]), 5,
      comp=_IN("comp0", "x.symbol, x.date, x.value"), navw=_IN("nav", "x.date, x.nav"), w0=_W0.replace("from nav ", "from navw "), per=_PER, tot=_TOT)


_READ = {
    "sharpe": "sharpe sharpe_low", "probabilistic_sharpe": "psr dsr", "var": "hist_95 cornish_fisher_99 month_cvar_95", "hurst": "hurst", "underwater": "share_under mean_days", "drawdown_ratios": "sterling burke", "omega_kappa": "omega kappa3",
    "volatility": "vol_ewma", "risk": "hhi",
}
_BLOCK = {"sharpe": "sharpe_block", "underwater": "underwater_time", "probabilistic_sharpe": "psr_dsr", "var": "var_cvar", "risk": "risk_totals"}
_COUNTED = ("cone", "worst_windows", "regimes", "phases", "histogram", "qq", "quarterly", "seasonality", "rolling_beta", "rolling_sortino", "excess", "risk_parts", "bootstrap")


def _analytics(b: Book) -> DataFrame:
    """The blocks of the analysis as published: some numbers of those that stand once, the sizes of the others."""
    path = files.scratch(b.spark)
    files.write_outputs(b.spark, path, _registry(b), files.series_documents(b.nav, b.components), _payload(b), fixtures.DISCLAIMER)
    read = lambda block, c: F.get_json_object("document", f"$.{block}.{c}").cast("double").alias(c)
    sizes = (F.coalesce(F.json_array_length(F.get_json_object("document", f"$.{c}")), F.lit(0)).alias(f"n_{c}") for c in _COUNTED)
    return files.published(b.spark, path)["payload"].select("portfolio", *(read(block, c) for block, cs in _READ.items() for c in cs.split()), *sizes)


_SIZES = {c: f"select series_id as portfolio, count(*) as n from ({PARTS[q][0]}) group by 1" for c, q in {"cone": "vol_cone", "worst_windows": "worst_windows", "regimes": "vol_regimes", "histogram": "histogram", "qq": "qq_points", "quarterly": "quarterly_returns", "seasonality": "seasonality", "rolling_sortino": "rolling_sortino"}.items()}
_SIZES |= {c: f"select portfolio, count(*) as n from ({PARTS[q][0]}) group by 1" for c, q in {"phases": "market_phases", "rolling_beta": "rolling_beta_corr", "risk_parts": "risk_decomposition"}.items()}
_SIZES |= {"excess": f"select portfolio, count(*) as n from (select distinct portfolio, benchmark, {PERIOD['week']} from pairs) group by 1", "bootstrap": "select series_id as portfolio, 3 as n from rn where n >= 120 group by 1"}
query("payload_analytics", _analytics, "select p.portfolio, " + ", ".join(c for cs in _READ.values() for c in cs.split()) + ", " + ", ".join(f"coalesce(z{i}.n, 0)::int as n_{c}" for i, c in enumerate(_COUNTED)) + " from (select distinct portfolio from nav) p "
      + " ".join(f"left join ({PARTS[_BLOCK.get(block, block)][0]}) x{i} on x{i}.{'portfolio' if block == 'risk' else 'series_id'} = p.portfolio" for i, block in enumerate(_READ)) + " " + " ".join(f"left join ({_SIZES[c]}) z{i} on z{i}.portfolio = p.portfolio" for i, c in enumerate(_COUNTED)),
      " ".join(_READ.values()), 4, **{n: text for q in (*(_BLOCK.get(x, x) for x in _READ), "vol_cone", "vol_regimes", "rolling_beta_corr", "rolling_sortino", "risk_decomposition") for n, text in PARTS[q][2].items()})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns, volatility and drawdown of every portfolio, from raw bars."""
    b = Book(spark, sf_dir)
    s = b.nav_series
    return metrics.return_stats(s).join(metrics.volatility(s), "series_id").join(drawdown.max_drawdown(s), "series_id")
