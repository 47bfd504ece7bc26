"""Cleaning bars and rates, and aligning them on calendars. All frames are long: one row per key and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio

PRE_DAYS = 12  # margin before inception, for fills
PENCE = ("GBp", "GBX")


def normalize_bars(raw: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """The last bar of each key and day; of bars at one instant, that with the larger `tie`."""
    last = Window.partitionBy(key, F.to_date(ts)).orderBy(F.desc(ts), F.desc(tie))
    days = raw.select(F.col(key).alias("symbol"), F.to_date(ts).alias("date"), F.col(value).cast("double").alias("close"), F.row_number().over(last).alias("k"))
    return days.where("k = 1").drop("k")


def grid(dates: DataFrame, keys: DataFrame, buckets: int = 16) -> DataFrame:
    """Every key on every date, for calendars: each key stands once in each bucket of dates, so the two meet on the bucket.

    What comes out is the calendar itself; no side is broadcast or gathered for it.
    """
    spread = keys.distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return dates.distinct().withColumn("bucket", F.pmod(F.hash("date"), F.lit(buckets))).join(spread, "bucket").drop("bucket")


def first_needed(portfolios: DataFrame, pre_days: int = PRE_DAYS) -> Column:
    """`pre_days` before the first inception of all, as a literal: a filter on it reaches the scan."""
    least = portfolios.agg(F.date_sub(F.min("inception"), pre_days)).first()[0]
    return F.lit(least).cast("date")


def read_market(closes: DataFrame, dividends: DataFrame, quotes: DataFrame, holdings: DataFrame, portfolios: DataFrame, currencies: DataFrame, pre_days: int = PRE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(closes, dividends, quotes) of the symbols and currencies in use, from `pre_days` before the first inception that needs them."""
    bound = first_needed(portfolios, pre_days)
    need = holdings.join(portfolios, "portfolio").groupBy("symbol").agg(F.date_sub(F.min("inception"), pre_days).alias("since"))
    own = lambda df: df.where(F.col("date") >= bound).join(need, "symbol").where("date >= since").drop("since")
    pairs = quotes.where(F.col("date") >= bound)
    used = currencies.select(F.col("ccy").alias("used")).distinct()
    either = pairs.join(used, (F.col("used") == F.col("ccy")), "left_semi").unionByName(pairs.join(used, F.col("used") == F.col("base"), "left_semi"))
    return own(closes), own(dividends), either.distinct()


def align_calendar(holdings: DataFrame, closes: DataFrame, dividends: DataFrame, portfolios: DataFrame, pre_days: int = PRE_DAYS) -> DataFrame:
    """portfolio, symbol, date, close (null: no bar), amount (0: no dividend) on the dates of any of the portfolio's symbols.

    A portfolio's calendar begins `pre_days` before its inception, for fills. Bars meet the spine on (symbol, date), so a symbol that
    most portfolios hold is spread over its dates.
    """
    own = holdings.select("portfolio", "symbol").distinct()
    since = portfolios.select("portfolio", F.date_sub("inception", pre_days).alias("since"))
    dates = own.join(since, "portfolio").join(closes.select("symbol", "date"), "symbol").where("date >= since").select("portfolio", "date").distinct()
    spine = dates.join(own, "portfolio")
    bars = spine.join(closes.select("symbol", "date", "close"), ["symbol", "date"], "left")
    paid = bars.join(dividends.select("symbol", "date", "amount"), ["symbol", "date"], "left")
    return paid.select("portfolio", "symbol", "date", "close", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def month_masks(holdings: DataFrame, closes: DataFrame) -> DataFrame:
    """portfolio, month, days: the days (bits) on which any of the portfolio's symbols has a bar."""
    masks = closes.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.bit_or(F.expr("shiftleft(1, dayofmonth(date) - 1)")).alias("days"))
    return holdings.select("portfolio", "symbol").distinct().join(masks, "symbol").groupBy("portfolio", "month").agg(F.bit_or("days").alias("days"))


def masked_days() -> Column:
    """The dates of a row of month_masks."""
    return F.expr("transform(filter(sequence(0, 30), d -> shiftright(days, d) & 1 = 1), d -> date_add(month, d))")


def calendars(holdings: DataFrame, closes: DataFrame, portfolios: DataFrame, pre_days: int = PRE_DAYS) -> DataFrame:
    """portfolio, date: the dates of any of the portfolio's symbols, from `pre_days` before its inception on.

    Dates travel as one mask of days for each symbol and month: a portfolio's month is the OR of its symbols' masks, so no row per symbol and date is made.
    """
    days = month_masks(holdings, closes).select("portfolio", F.explode(masked_days()).alias("date"))
    since = portfolios.select("portfolio", F.date_sub("inception", pre_days).alias("since"))
    return days.join(since, "portfolio").where("date >= since").drop("since")


def validity(closes: DataFrame, dividends: DataFrame) -> DataFrame:
    """symbol, lo, hi, close, seen, paid: each bar or dividend of a symbol as the interval [lo, hi) up to the next one.

    close is the last known one and seen its date; paid is what is paid on lo. The last interval ends after the last bar of all symbols.
    """
    upto = closes.agg(F.max("date")).first()[0]
    rows = closes.select("symbol", "date", "close").join(dividends.select("symbol", "date", F.col("amount").alias("paid")), ["symbol", "date"], "full")
    rows = ffill(rows.withColumn("seen", F.when(F.col("close").isNotNull(), F.col("date"))), ["symbol"], "close", "seen")
    after = F.lead("date").over(Window.partitionBy("symbol").orderBy("date"))
    return rows.select("symbol", F.col("date").alias("lo"), F.coalesce(after, F.date_add(F.lit(upto).cast("date"), 1)).alias("hi"), "close", "seen", "paid").where("lo < hi")


def valid_on(rows: DataFrame, intervals: DataFrame, bucket: int = 8) -> DataFrame:
    """rows (symbol, date, since) with close (null: none since then) and amount (0: no dividend) of the interval that holds the date.

    Intervals stand in each bucket of `bucket` days that they touch, so rows meet only those of their symbol and bucket.
    """
    at = lambda c: F.expr(f"unix_date({c}) div {bucket}")
    spread = intervals.withColumn("bucket", F.explode(F.sequence(at("lo"), at("date_sub(hi, 1)"))))
    met = rows.withColumn("bucket", at("date")).alias("a").join(spread.alias("b"), F.expr("a.symbol = b.symbol and a.bucket = b.bucket and a.date >= b.lo and a.date < b.hi"), "left")
    own = [F.col(f"a.{c}") for c in rows.columns if c != "since"]
    return met.select(*own, F.when(F.col("seen") >= F.col("since"), F.col("b.close")).alias("close"), F.coalesce(F.when(F.col("lo") == F.col("a.date"), F.col("paid")), F.lit(0.0)).alias("amount"))


def filled_calendar(holdings: DataFrame, closes: DataFrame, dividends: DataFrame, portfolios: DataFrame, pre_days: int = PRE_DAYS) -> DataFrame:
    """portfolio, symbol, date, close (filled from bars since `pre_days` before inception), amount: what align_calendar and ffill give, without a fill per portfolio."""
    own = holdings.select("portfolio", "symbol").distinct().join(portfolios.select("portfolio", F.date_sub("inception", pre_days).alias("since")), "portfolio")
    rows = calendars(holdings, closes, portfolios, pre_days).join(own, "portfolio")
    return valid_on(rows, validity(closes, dividends)).select("portfolio", "symbol", "date", "close", "amount")


def ffill(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The last known value of each column; leading nulls stay."""
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def fx_rates(quotes: DataFrame, base: str) -> DataFrame:
    """ccy, date, rate into base: direct pairs, or one over the inverse where there is no direct one; filled on the dates of any pair."""
    direct = quotes.where((F.col("base") == base) & (F.col("ccy") != base)).select("ccy", "date", "rate")
    inverse = quotes.where((F.col("ccy") == base) & (F.col("base") != base)).select(F.col("base").alias("ccy"), "date", ratio(F.lit(1.0), "rate").alias("rate"))
    pairs = direct.unionByName(inverse.join(direct.select("ccy").distinct(), "ccy", "left_anti"))
    days = grid(pairs.select("date"), pairs.select("ccy"))
    return ffill(days.join(pairs, ["ccy", "date"], "left"), ["ccy"], "rate").where("rate is not null")


def align_fx(points: DataFrame, rates: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """points (keys, ccy, date) with the rate of that very date, filled forwards, then backwards, within keys and ccy; 1 for the base."""
    return with_rate(points.select(*keys, "ccy", "date").distinct(), rates, base, [*keys, "ccy"]).select(*keys, "ccy", "date", "rate")


def both_fills(column: str, keys: list[str]) -> Column:
    """The last known value, or the first of all ahead of it; frames that run to the end would cost a pass for each row."""
    whole = Window.partitionBy(*keys).orderBy("date")
    past = F.last(column, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(past, F.first(column, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def by_day(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, days_from, by_day: one row per key, with a value (null: none) for each day from days_from on."""
    days = df.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    rows = days.join(df.select(*keys, "date", F.col(value).alias("value")), [*keys, "date"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("d"))
    return rows.select(*keys, F.col("d")[0]["date"].alias("days_from"), F.col("d.value").alias("by_day"))


def looked_up(df: DataFrame, values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df (keys, date) with the value of the very date (null: none) in `name`.

    values are sent to all tasks, one row per key: only for those whose number grows with currencies or benchmarks, never with portfolios. df stays where it is.
    """
    found = df.join(F.broadcast(by_day(values, keys, value)), keys, "left")
    return found.withColumn(name, F.get("by_day", F.datediff("date", "days_from"))).drop("by_day", "days_from")


def with_rate(df: DataFrame, rates: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """df (ccy, date) with the aligned rate; keys: of its runs over the calendar, each in one currency."""
    found = looked_up(df, rates, ["ccy"], "rate", "quoted_rate")
    return found.withColumn("rate", F.when(F.col("ccy") == base, F.lit(1.0)).otherwise(both_fills("quoted_rate", keys))).drop("quoted_rate")


def carried(df: DataFrame, keys: list[str], order: list[str], scans: dict[str, tuple[str, str]], bucket: str = "bucket") -> DataFrame:
    """df with running values along order within keys, as segmented scans: {name: (column, kind)}, kind last (known), max or sum.

    A scan runs inside each bucket (a column that doesn't fall along order), so the history of one key is as many tasks as it has buckets; what buckets end
    with is scanned once more, a row for each, and carried into the next one.
    """
    whole = {"last": lambda c, w: F.last(c, ignorenulls=True).over(w), "max": lambda c, w: F.max(c).over(w), "sum": lambda c, w: F.sum(c).over(w)}
    join = {"last": lambda inside, before: F.coalesce(inside, before), "max": lambda inside, before: F.greatest(inside, before), "sum": lambda inside, before: F.coalesce(inside + before, inside, before)}
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({name: whole[kind](c, inside) for name, (c, kind) in scans.items()})
    at = F.struct(*order)
    end = {"last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)), "max": F.max, "sum": F.sum}
    ends = df.groupBy(*keys, bucket).agg(*(end[kind](c).alias(name) for name, (c, kind) in scans.items()))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, bucket, *(whole[kind](name, before).alias(f"carry_{name}") for name, (_, kind) in scans.items()))
    out = rows.join(ends, [*keys, bucket])
    return out.withColumns({name: join[kind](F.col(name), F.col(f"carry_{name}")) for name, (_, kind) in scans.items()}).drop(*(f"carry_{name}" for name in scans))


def asof_value(values: DataFrame, points: DataFrame, keys: list[str], value: str, at: str = "at") -> DataFrame:
    """keys, at and the last known value at or before that date, for each of points; null if there is none. A key's history is cut into years."""
    known = values.where(F.col(value).isNotNull()).select(*keys, F.col("date").alias("when"), F.lit(0).alias("asks"), F.col(value).alias("known"))
    asked = points.select(*keys, F.col(at).alias("when"), F.lit(1).alias("asks"), F.lit(None).cast(known.schema["known"].dataType).alias("known"))
    # One pass over both in the order of time; on one date the value comes first.
    both = known.unionByName(asked).withColumn("bucket", F.year("when"))
    return carried(both, keys, ["when", "asks"], {value: ("known", "last")}).where("asks = 1").select(*keys, F.col("when").alias(at), value)


def pence_to_pounds(df: DataFrame, ccy: str = "ccy", value: str = "close") -> DataFrame:
    pence = F.col(ccy).isin(*PENCE)
    return df.withColumns({value: F.when(pence, F.col(value) / 100).otherwise(F.col(value)), ccy: pounds(F.col(ccy))})


def pounds(ccy: Column) -> Column:
    return F.when(ccy.isin(*PENCE), F.lit("GBP")).otherwise(ccy)


def currency_universe(holdings: DataFrame, legs: DataFrame, base: str) -> DataFrame:
    """The currencies that must be converted: of holdings, costs and benchmark legs, less the base."""
    used = holdings.select("ccy").union(holdings.select("cost_ccy")).union(legs.select("ccy"))
    return used.select(pounds(F.col("ccy")).alias("ccy")).distinct().where(F.col("ccy") != base)


def live_filter(df: DataFrame, portfolios: DataFrame) -> DataFrame:
    return df.join(portfolios.select("portfolio", "inception"), "portfolio").where("date >= inception").drop("inception")
