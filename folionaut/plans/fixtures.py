"""Market data, portfolios and benchmarks derived from the given tables, for the queries.

Every two suppliers are a symbol, every hundred customers a portfolio, every region a benchmark: the number of series and holdings
grows with the tables. Prices, rates and dividends are sums of whole cents by day, so no order of summing can show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import market, nav, summaries
from ..operators.series import analysis_windows, daily_returns, windowed
from ..sources.files import bucketed, shuffles, stored

BASE = "CHF"
INCEPTION = "1995-02-01"  # of the first portfolio; others begin up to 89 days later
COST_PX = 100.0
#: The lines of orders that are purchases of a holding, and days on which it pays dividends.
LOTS = "l_returnflag = 'R' and l_linenumber = 7 and l_discount >= 0.095e0"
DISCLAIMER = "Derived from synthetic orders; no advice."


def _cents(column: str):
    return F.sum(F.round(F.col(column) * 100).cast("bigint")).cast("double")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol(column: str = "l_suppkey"):
    return F.concat(F.lit("S"), F.expr(f"{column} div 2").cast("string"))


def _ccy(number):
    return F.when(number % 3 == 0, "CHF").when(number % 3 == 1, "USD").otherwise("EUR")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by symbol alone, as the table of prices is: no second shuffle.
    lines = _read(spark, sf_dir, "lineitem").select(_symbol().alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_extendedprice")
    sums = lines.repartition(shuffles(spark), "symbol").groupBy("symbol", "date").agg((_cents("l_extendedprice") / F.count("*")).alias("x"))
    return sums.select("symbol", "date", (50 + F.col("x") / 100000.0).alias("close"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ccy, base, date, rate."""
    status = F.col("o_orderstatus")
    ccy = F.when(status == "F", "USD").when(status == "O", "EUR").otherwise("GBP").alias("ccy")
    sums = _read(spark, sf_dir, "orders").groupBy(ccy, F.to_date("o_orderdate").alias("date")).agg((_cents("o_totalprice") / F.count("*")).alias("x"))
    return sums.select("ccy", F.lit(BASE).alias("base"), "date", (0.8 + F.col("x") / 250000000.0).alias("rate"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").where(LOTS)
    return lines.groupBy(_symbol().alias("symbol"), F.to_date("l_shipdate").alias("date")).agg((_cents("l_tax") / 100.0).alias("amount"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio, symbol, ccy, shares, cost_px, cost_ccy, cost_amount, quote_ccy: what each hundred customers bought."""
    lines = _read(spark, sf_dir, "lineitem").where(LOTS).select("l_orderkey", F.expr("l_suppkey div 2").alias("number"), "l_quantity")
    bought = lines.join(_read(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey div 100").alias("desk")), F.col("l_orderkey") == F.col("o_orderkey"))
    return _lots(bought)


def _lots(bought: DataFrame) -> DataFrame:
    lots = bought.groupBy("desk", "number").agg(F.sum(F.col("l_quantity").cast("long")).alias("shares"))
    ccy = _ccy(F.col("number"))
    return lots.select(
        F.concat(F.lit("P"), F.col("desk").cast("string")).alias("portfolio"), F.concat(F.lit("S"), F.col("number").cast("string")).alias("symbol"),
        ccy.alias("ccy"), "shares", F.lit(COST_PX).alias("cost_px"), ccy.alias("cost_ccy"), (F.col("shares") * COST_PX).alias("cost_amount"),
        F.when(F.col("number") % 7 == 2, "USD").otherwise(ccy).alias("quote_ccy"),
    )


def wide_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings of portfolios that hold nearly every symbol: all that the customers of a region bought."""
    orders, customer, nation = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    region = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("bigint").alias("desk"))
    of = orders.join(region, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "desk")
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("l_suppkey div 2").alias("number"), "l_quantity")
    return _lots(lines.join(of, F.col("l_orderkey") == F.col("o_orderkey")))


def portfolios(held: DataFrame) -> DataFrame:
    """portfolio, label, base_ccy, inception."""
    desk = F.substring("portfolio", 2, 20).cast("int")
    start = F.date_add(F.lit(INCEPTION).cast("date"), desk % 90)
    return held.select("portfolio").distinct().select("portfolio", F.concat(F.lit("Desk "), desk.cast("string")).alias("label"), F.lit(BASE).alias("base_ccy"), start.alias("inception"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark, symbol, weight, ccy: of each region the two first symbols; one region is quoted in pence, one in dollars."""
    of = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    of = of.select("n_regionkey", F.expr("s_suppkey div 2").alias("number")).distinct()
    of = of.withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("number"))).where("k <= 2")
    ccy = F.when(F.col("n_regionkey") == 3, "GBp").when(F.col("n_regionkey") == 1, "USD").otherwise(_ccy(F.col("number")))
    return of.select(F.concat(F.lit("B"), F.col("n_regionkey").cast("string")).alias("benchmark"), F.concat(F.lit("S"), F.col("number").cast("string")).alias("symbol"), F.when(F.col("k") == 1, 0.6).otherwise(0.4).alias("weight"), ccy.alias("ccy"))


def members(ports: DataFrame) -> DataFrame:
    """portfolio, benchmark: each portfolio names two."""
    desk = F.substring("portfolio", 2, 20).cast("int")
    return ports.select("portfolio", F.explode(F.array(desk % 5, (desk + 2) % 5)).alias("region")).select("portfolio", F.concat(F.lit("B"), F.col("region").cast("string")).alias("benchmark"))


#: Frames that several branches of a plan read, and the keys by which they are bucketed; none: plain files, as they are small or read by several keys.
STORED = {
    "prices": ("symbol",), "holdings": (), "rates": (), "calendar": ("portfolio",), "histories": ("portfolio", "chunk"), "dated": ("portfolio", "chunk"), "nav": ("portfolio",), "series": ("series_id",), "benchmarks": ("portfolio", "benchmark"),
    "pairs": ("portfolio", "benchmark"), "windows": (), "windowed": ("series_id",), "capital": (), "summary_tree": ("series_id",),
}

#: Those that come out dealt by their keys.
DEALT = ("prices", "dated")


class Book:
    """The frames of one run, each built once, when it is first asked for; those in STORED are written tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, wide: bool = False):
        """wide: the regions' portfolios of nearly all symbols, in the place of those of each hundred customers."""
        self.spark, self.sf_dir, self.wide, self._made = spark, sf_dir, wide, {}

    def _get(self, name: str, make) -> DataFrame:
        if name not in self._made:
            keys = STORED.get(name)
            self._made[name] = make() if keys is None else bucketed(make(), *keys, dealt=name in DEALT) if keys else stored(make())
        return self._made[name]

    @property
    def prices(self) -> DataFrame:
        return self._get("prices", lambda: prices(self.spark, self.sf_dir))

    @property
    def quotes(self) -> DataFrame:
        return self._get("quotes", lambda: quotes(self.spark, self.sf_dir))

    @property
    def dividends(self) -> DataFrame:
        return self._get("dividends", lambda: dividends(self.spark, self.sf_dir))

    @property
    def holdings(self) -> DataFrame:
        return self._get("holdings", lambda: (wide_holdings if self.wide else holdings)(self.spark, self.sf_dir))

    @property
    def portfolios(self) -> DataFrame:
        return self._get("portfolios", lambda: portfolios(self.holdings))

    @property
    def legs(self) -> DataFrame:
        return self._get("legs", lambda: legs(self.spark, self.sf_dir))

    @property
    def rates(self) -> DataFrame:
        return self._get("rates", lambda: market.fx_rates(self.quotes, BASE))

    @property
    def held(self) -> DataFrame:
        """Holdings with the histories of their symbols: what components, returns and windows are made of where it stands, and never written out."""
        placed = nav.chunks(self.holdings)
        own = self._get("histories", lambda: nav.histories(placed, self.portfolios, self.prices, self.dividends))
        return nav.held(own, self._get("dated", lambda: nav.dated_rates(placed, self.portfolios, self.prices, self.rates, BASE)))

    @property
    def components(self) -> DataFrame:
        return nav.held_components(self.held)

    @property
    def calendar(self) -> DataFrame:
        return self._get("calendar", lambda: nav.live_calendar(self.holdings, self.prices, self.portfolios))

    @property
    def nav(self) -> DataFrame:
        return self._get("nav", lambda: nav.nav(self.components, self.holdings, self.rates, BASE, self.capital))

    @property
    def capital(self) -> DataFrame:
        return self._get("capital", lambda: nav.invested_capital(self.calendar, self.holdings, self.rates, BASE))

    @property
    def nav_series(self) -> DataFrame:
        return self.nav.select(F.col("portfolio").alias("series_id"), "date", F.col("nav").alias("value"))

    @property
    def series(self) -> DataFrame:
        """NAVs of the portfolios and, as series of their own, the prices of all symbols from inception on."""
        symbols = self.prices.where(F.col("date") >= F.lit(INCEPTION).cast("date")).select(F.col("symbol").alias("series_id"), "date", F.col("close").alias("value"))
        return self._get("series", lambda: self.nav_series.unionByName(symbols))

    @property
    def benchmarks(self) -> DataFrame:
        return self._get("benchmarks", lambda: nav.benchmark_nav(self.legs, members(self.portfolios), self.prices, self.rates, BASE, self.nav))

    @property
    def benchmark_returns(self) -> DataFrame:
        return daily_returns(self.benchmarks, ("portfolio", "benchmark"))

    @property
    def pairs(self) -> DataFrame:
        return self._get("pairs", lambda: nav.benchmark_pairs(daily_returns(self.nav_series), self.benchmark_returns))

    @property
    def windows(self) -> DataFrame:
        return self._get("windows", lambda: analysis_windows(self.nav_series))

    @property
    def summary_tree(self) -> DataFrame:
        return self._get("summary_tree", lambda: summaries.summary_tree(self.nav_series))

    @property
    def windowed(self) -> DataFrame:
        """The NAVs of every window of every portfolio, each a series of its own."""
        return self._get("windowed", lambda: windowed(self.nav_series, self.windows).select("series_id", "date", "value"))
