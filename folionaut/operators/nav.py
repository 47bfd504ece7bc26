"""Net asset values, positions and benchmarks of buy-and-hold portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..sources.files import shuffles
from .market import PRE_DAYS, align_fx, asof_value, both_fills, calendars, ffill, filled_calendar, first_needed, grid, live_filter, looked_up, masked_days, month_masks, pence_to_pounds, valid_on, validity, with_rate

CHUNK = 128  # symbols of a portfolio that stand together
_HELD = ["portfolio", "chunk"]


def filled_spine(holdings: DataFrame, portfolios: DataFrame, closes: DataFrame, dividends: DataFrame) -> DataFrame:
    """Live rows of the calendar; closes from bars ahead of inception count."""
    return live_filter(filled_calendar(holdings, closes, dividends, portfolios), portfolios)


def component_values(spine: DataFrame, holdings: DataFrame, rates: DataFrame, base: str) -> DataFrame:
    """portfolio, symbol, date, ccy, shares, close, amount, rate, value = close x rate x shares."""
    own = spine.join(holdings.select("portfolio", "symbol", "ccy", "shares"), ["portfolio", "symbol"])
    # Every symbol of a portfolio is on its whole calendar, so rates are filled along the symbols' own rows.
    priced = with_rate(own, rates, base, ["portfolio", "symbol"])
    return priced.withColumn("value", F.col("close") * F.col("rate") * F.col("shares"))


def live_calendar(holdings: DataFrame, closes: DataFrame, portfolios: DataFrame) -> DataFrame:
    return live_filter(calendars(holdings, closes, portfolios), portfolios)


def components(holdings: DataFrame, portfolios: DataFrame, closes: DataFrame, dividends: DataFrame, rates: DataFrame, base: str, calendar: DataFrame | None = None) -> DataFrame:
    """What component_values makes of filled_spine, in one pass: rates are filled once per portfolio and currency, closes once per symbol.

    calendar: the portfolios' live dates (portfolio, date), if they are at hand.
    """
    days = live_calendar(holdings, closes, portfolios) if calendar is None else calendar
    fx = align_fx(days.join(holdings.select("portfolio", "ccy").distinct(), "portfolio"), rates, base, ["portfolio"])
    since = portfolios.select("portfolio", F.date_sub("inception", PRE_DAYS).alias("since"))
    rows = fx.join(holdings.select("portfolio", "symbol", "ccy", "shares").join(since, "portfolio"), ["portfolio", "ccy"])
    out = valid_on(rows, validity(closes, dividends))
    return out.select("portfolio", "symbol", "date", "ccy", "shares", "close", "amount", "rate", (F.col("close") * F.col("rate") * F.col("shares")).alias("value"))


# --- holdings with the histories of their symbols ---------------------------------------------------------------
def of_symbol(df: DataFrame, *more: str) -> list[str]:
    """The keys of a component: with its chunk where df has one, so that what is partitioned by chunks stays where it is."""
    return ["portfolio", *(c for c in ("chunk", *more) if c in df.columns), "symbol"]


def chunks(holdings: DataFrame, size: int = CHUNK) -> DataFrame:
    """portfolio, symbol, ccy, shares, chunk and chunks: a portfolio's symbols in order, `size` of them together, and how many chunks it has."""
    rank = F.row_number().over(Window.partitionBy("portfolio").orderBy("symbol")) - 1
    return holdings.select("portfolio", "symbol", "ccy", "shares").withColumn("chunk", F.floor(rank / size).cast("int")).withColumn("chunks", F.max("chunk").over(Window.partitionBy("portfolio")) + 1)


def histories(placed: DataFrame, portfolios: DataFrame, closes: DataFrame, dividends: DataFrame) -> DataFrame:
    """A row per holding (placed: as from chunks): its symbol's bars and dividends since shortly before the first inception, as arrays of days, closes and the closes' own days; and what is paid on which day."""
    spark, least = closes.sparkSession, first_needed(portfolios)
    none = F.lit(None).cast("double")
    day = F.unix_date("date").alias("day")
    events = closes.where(F.col("date") >= least).select("symbol", day, "close", none.alias("paid")).unionByName(dividends.where(F.col("date") >= least).select("symbol", day, none.alias("close"), F.col("amount").alias("paid")))
    events = events.repartition(shuffles(spark), "symbol").groupBy("symbol", "day").agg(F.max("close").alias("close"), F.max("paid").alias("paid"))
    past = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({"seen": F.last(F.when(F.col("close").isNotNull(), F.col("day")), ignorenulls=True).over(past), "close": F.last("close", ignorenulls=True).over(past)})
    of = events.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", "close", "seen"))).alias("e"), F.collect_list(F.when(F.col("paid").isNotNull(), F.struct("day", "paid"))).alias("p"))
    of = of.select("symbol", F.col("e.day").alias("days"), F.col("e.close").alias("closes"), F.col("e.seen").alias("seen"), F.map_from_entries("p").alias("paid"))
    since = portfolios.select("portfolio", F.unix_date(F.date_sub("inception", PRE_DAYS)).alias("since"))
    return placed.join(since, "portfolio").join(of, "symbol", "left")


def dated_rates(placed: DataFrame, portfolios: DataFrame, closes: DataFrame, rates: DataFrame, base: str) -> DataFrame:
    """portfolio, chunk, first, live and rates: the first live day, whether each day from it on is a live date, and for each currency the aligned rate of each day (null where it isn't live)."""
    n = shuffles(closes.sparkSession)
    own = placed.groupBy(*_HELD).agg(F.collect_set("ccy").alias("ccys")).join(portfolios.select("portfolio", "inception"), "portfolio")
    # Every chunk knows its portfolio's whole calendar.
    masks = month_masks(placed, closes).join(own, "portfolio").repartition(n, *_HELD)
    days = masks.select(*_HELD, "inception", "ccys", F.explode(masked_days()).alias("date")).where("date >= inception")
    rows = with_rate(days.select(*_HELD, "date", F.explode("ccys").alias("ccy")), rates, base, [*_HELD, "ccy"])
    after = F.lead("date").over(Window.partitionBy(*_HELD, "ccy").orderBy("date"))
    rows = rows.withColumn("gap", F.coalesce(F.datediff(after, "date"), F.lit(1)) - 1)
    lists = rows.groupBy(*_HELD, "ccy").agg(F.array_sort(F.collect_list(F.struct("date", "rate", "gap"))).alias("d"))
    spread = lambda value, rest: F.flatten(F.transform("d", lambda x: F.concat(F.array(value(x)), F.array_repeat(rest, x["gap"]))))
    dense = lists.select(*_HELD, "ccy", F.unix_date(F.col("d")[0]["date"]).alias("first"), spread(lambda x: x["rate"], F.lit(None).cast("double")).alias("dense"), spread(lambda x: F.lit(True), F.lit(False)).alias("live"))
    return dense.groupBy(*_HELD).agg(F.first("first").alias("first"), F.first("live").alias("live"), F.map_from_entries(F.collect_list(F.struct("ccy", "dense"))).alias("rates"))


def held(histories: DataFrame, dated: DataFrame) -> DataFrame:
    """Holdings with their histories and the rates of their currency."""
    return histories.join(dated, _HELD).withColumn("rates", F.element_at("rates", F.col("ccy")))


def held_components(held: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """What components gives, and chunk: days are made of the histories where they stand, so that partitions by portfolio and chunk stay as they are.

    windows (portfolio, window, lo, hi): the rows of each window, with its name in `window`.
    """
    last = F.col("first") + F.size("live") - 1
    none = lambda kind: F.array(F.lit(None).cast(kind))
    known = lambda c: F.coalesce(c, F.array().cast(f"array<{'double' if c == 'closes' else 'int'}>"))
    # The days ahead of the first bar are an interval without a close.
    spans = F.arrays_zip(F.concat(F.array("first"), known("days")).alias("start"), F.concat(known("days"), F.array(last + 1)).alias("stop"), F.concat(none("double"), known("closes")).alias("close"), F.concat(none("int"), known("seen")).alias("seen"))
    keys = ["portfolio", "chunk", "symbol"]
    rows = held.withColumns({"a": F.col("first"), "b": last})
    if windows is not None:
        keys.append("window")
        of = held.select(*_HELD).distinct().join(windows, "portfolio").groupBy(*_HELD).agg(F.collect_list(F.struct("window", F.unix_date("lo").alias("a"), F.unix_date("hi").alias("b"))).alias("w"))
        rows = held.join(of, _HELD).withColumn("w", F.explode("w")).select("*", "w.*").drop("w")
    rows = rows.select(*keys, "ccy", "shares", "since", "first", "live", "rates", "paid", "a", "b", F.explode(spans).alias("s")).select("*", "s.*")
    rows = rows.withColumns({"from": F.greatest("start", "a"), "upto": F.least(F.col("stop") - 1, F.col("b")), "close": F.when(F.col("seen") >= F.col("since"), F.col("close")), "pays": F.element_at("paid", F.col("start"))})
    rows = rows.where(F.col("from") <= F.col("upto")).select(*keys, "ccy", "shares", "first", "live", "rates", "close", "start", "pays", F.explode(F.sequence("from", "upto")).alias("day"))
    at = lambda c: F.get(c, F.col("day") - F.col("first"))
    rows = rows.where(at("live")).withColumns({"rate": at("rates"), "amount": F.when(F.col("day") == F.col("start"), F.coalesce("pays", F.lit(0.0))).otherwise(F.lit(0.0))})
    return rows.select(*keys, F.date_from_unix_date("day").alias("date"), "ccy", "shares", "close", "amount", "rate", (F.col("close") * F.col("rate") * F.col("shares")).alias("value"))


def dividend_cash(components: DataFrame) -> DataFrame:
    """portfolio, date, cash: dividends paid so far, at the rate of their day."""
    return _daily(components).select("portfolio", "date", "cash")


def _daily(components: DataFrame) -> DataFrame:
    """portfolio, date, held (a component without a price counts 0), cash."""
    sums = components.groupBy(*of_symbol(components)[:-1], "date").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("held"), F.sum(F.col("amount") * F.col("rate") * F.col("shares")).alias("paid"))
    if "chunk" in components.columns:
        sums = sums.repartition("portfolio").groupBy("portfolio", "date").agg(F.sum("held").alias("held"), F.sum("paid").alias("paid"))
    past = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("portfolio", "date", "held", F.coalesce(F.sum("paid").over(past), F.lit(0.0)).alias("cash"))


def first_days(spine: DataFrame) -> DataFrame:
    return spine.groupBy("portfolio").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def rates_at(calendar: DataFrame, rates: DataFrame, base: str, days: DataFrame, currencies: DataFrame, at: str) -> DataFrame:
    """portfolio, ccy, rate as of a day of the portfolio (column `at` of days), for any currencies (portfolio, ccy); calendar: portfolio, date, repeats allowed."""
    dates = calendar.select("portfolio", "date").distinct()
    fx = align_fx(dates.join(currencies.distinct(), "portfolio"), rates, base, ["portfolio"])
    points = currencies.distinct().join(days.select("portfolio", at), "portfolio")
    return asof_value(fx, points, ["portfolio", "ccy"], "rate", at).drop(at)


def invested_capital(calendar: DataFrame, holdings: DataFrame, rates: DataFrame, base: str) -> DataFrame:
    """portfolio, first_day, capital: costs at the rate of the first day. calendar: the portfolios' live dates, or their components."""
    days = first_days(calendar)
    cost = holdings.select("portfolio", F.col("cost_ccy").alias("ccy"), "cost_amount")
    at = rates_at(calendar, rates, base, days, cost.select("portfolio", "ccy"), "first_day")
    total = cost.join(at, ["portfolio", "ccy"]).groupBy("portfolio").agg(F.sum(F.col("cost_amount") * F.col("rate")).alias("capital"))
    return days.select("portfolio", "first_day").join(total, "portfolio")


def nav(components: DataFrame, holdings: DataFrame, rates: DataFrame, base: str, capital: DataFrame | None = None) -> DataFrame:
    """portfolio, date, nav, cash; a component without a price counts 0, and the capital stands one day before the first."""
    daily = _daily(components)
    capital = invested_capital(components, holdings, rates, base) if capital is None else capital
    start = capital.select("portfolio", F.date_sub("first_day", 1).alias("date"), F.col("capital").alias("nav"), F.lit(0.0).alias("cash"))
    return daily.select("portfolio", "date", (F.col("held") + F.col("cash")).alias("nav"), "cash").unionByName(start)


def positions(components: DataFrame, holdings: DataFrame, rates: DataFrame, base: str, navs: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """One row per holding: last price in its quote currency, profit, value, cost, contribution and weights, volatility, drawdown. calendar: the portfolios' live dates, if at hand."""
    calendar = components if calendar is None else calendar
    days = first_days(calendar)
    own, keys = ["portfolio", "symbol"], of_symbol(components)
    order = Window.partitionBy(*keys).orderBy("date")
    stepped = components.withColumns({
        "px": F.col("close") * F.col("rate"),
        "peak": F.max("value").over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    stepped = stepped.withColumn("r", ratio("px", F.lag("px").over(order)) - 1)
    last = stepped.groupBy(*keys).agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_close"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date"))).alias("value"),
        (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"),
        F.min(ratio("value", "peak") - 1).alias("max_dd"),
    ).drop("chunk")
    ccys = lambda c: holdings.select("portfolio", F.col(c).alias("ccy"))
    now = rates_at(calendar, rates, base, days, ccys("ccy").union(ccys("quote_ccy")), "last_day")
    then = rates_at(calendar, rates, base, days, ccys("cost_ccy"), "first_day")
    rate = lambda df, c, name: df.select("portfolio", F.col("ccy").alias(c), F.col("rate").alias(name))
    end = navs.groupBy("portfolio").agg(F.max_by("nav", "date").alias("nav_last"))
    capital = invested_capital(calendar, holdings, rates, base).select("portfolio", "capital")
    out = holdings.join(last, own).join(rate(now, "ccy", "r_own"), ["portfolio", "ccy"]).join(rate(now, "quote_ccy", "r_quote"), ["portfolio", "quote_ccy"])
    out = out.join(rate(then, "cost_ccy", "r_cost"), ["portfolio", "cost_ccy"]).join(end, "portfolio").join(capital, "portfolio")
    quoted = F.col("last_close") * F.when(F.col("quote_ccy") == F.col("ccy"), F.lit(1.0)).otherwise(ratio("r_own", "r_quote"))
    out = out.withColumns({"last_px": quoted, "cost_base": F.col("cost_amount") * F.col("r_cost")})
    return out.select(
        *own, "shares", "last_px",
        ((ratio("last_px", "cost_px") - 1) * 100).alias("pl_pct"),
        ((ratio("value", "cost_base") - 1) * 100).alias("pl_base_pct"),
        "value", "cost_base",
        (ratio(F.col("value") - F.col("cost_base"), "capital") * 100).alias("contrib_pp"),
        (ratio("value", "nav_last") * 100).alias("weight_now_pct"),
        (ratio("cost_base", "capital") * 100).alias("weight_cost_pct"),
        (F.col("vol") * 100).alias("vol_pct"), (F.col("max_dd") * 100).alias("max_dd_pct"),
    )


def benchmark_nav(legs: DataFrame, members: DataFrame, closes: DataFrame, rates: DataFrame, base: str, navs: DataFrame) -> DataFrame:
    """benchmark, portfolio, date, value of the benchmarks that each portfolio names (members: portfolio, benchmark).

    Legs stand at their initial weights, from 100 on the first NAV date. Rates are aligned on the benchmarks' own calendar, legs on the
    portfolio's, filled forwards, then backwards.
    """
    used = legs.select("symbol", "ccy").distinct()
    dates = closes.join(used.select("symbol").distinct(), "symbol", "left_semi").select("date")
    bars = grid(dates, used).join(closes.select("symbol", "date", "close"), ["symbol", "date"], "left")
    bars = pence_to_pounds(ffill(bars, ["symbol", "ccy"], "close").withColumn("quoted", F.col("ccy")))
    priced = with_rate(bars, rates, base, ["symbol", "quoted"])
    value = priced.select("symbol", "quoted", "date", (F.col("close") * F.col("rate")).alias("leg"))
    own = members.join(legs.select("benchmark", "symbol", "weight", F.col("ccy").alias("quoted")), "benchmark")
    spine = navs.select("portfolio", "date").join(own, "portfolio")
    keys = Window.partitionBy("portfolio", "benchmark", "symbol").orderBy("date")
    past = keys.rowsBetween(Window.unboundedPreceding, 0)
    legs_on = looked_up(spine, value, ["symbol", "quoted"], "leg", "leg").withColumn("v", both_fills("leg", ["portfolio", "benchmark", "symbol"]))
    share = legs_on.withColumn("part", ratio(F.col("weight") * F.col("v"), F.first("v").over(past)))
    total = share.groupBy("benchmark", "portfolio", "date").agg(F.sum("part").alias("mix"))
    whole = Window.partitionBy("benchmark", "portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return total.select("benchmark", "portfolio", "date", (ratio("mix", F.first("mix").over(whole)) * 100).alias("value"))


def benchmark_pairs(portfolio_returns: DataFrame, benchmark_returns: DataFrame) -> DataFrame:
    """portfolio, benchmark, date, p, b: returns of the dates that both have."""
    a = portfolio_returns.select(F.col("series_id").alias("portfolio"), "date", F.col("r").alias("p"))
    b = benchmark_returns.select("portfolio", "benchmark", "date", F.col("r").alias("b"))
    return a.join(b, ["portfolio", "date"]).where("p is not null and b is not null")
