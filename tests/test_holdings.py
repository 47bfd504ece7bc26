"""Portfolios of few and of many holdings: their results by plain means."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folionaut.operators import heldrisk, nav, risk
from folionaut.plans.fixtures import Book

DAY = dt.date(2020, 1, 1)
VALUES = "portfolio string, symbol string, date date, value double"


def lone(spark, n=80):
    """A portfolio of one component, and one of two."""
    values = [100 + (i * 37) % 11 for i in range(n)]
    rows = [(p, s, DAY + dt.timedelta(days=i), float(v) * k) for p, s, k in (("L", "A", 1), ("P", "A", 1), ("P", "B", 3)) for i, v in enumerate(values)]
    x = np.array(values, dtype=float)
    return spark.createDataFrame(rows, VALUES), x[1:] / x[:-1] - 1


def test_a_lone_component_has_a_correlation(spark):
    df, _ = lone(spark)
    got = {(r.portfolio, r.i, r.j): r.corr for r in risk.corr_matrix(risk.component_returns(df)).collect()}
    assert set(got) == {("L", "A", "A"), ("P", "A", "A"), ("P", "A", "B"), ("P", "B", "B")} and all(math.isclose(x, 1, rel_tol=1e-12) for x in got.values())


def test_a_lone_component_has_a_covariance_but_no_bets(spark):
    df, r = lone(spark)
    got = {(x.portfolio, x.i, x.j): x.cov for x in risk.cov_matrix(risk.component_returns(df)).collect()}
    assert len(got) == 4 and math.isclose(got["L", "A", "A"], r.var(ddof=1) * 252, rel_tol=1e-12)
    assert [x.portfolio for x in risk.effective_bets(df).collect()] == ["P"]


# --- holdings with histories ---------------------------------------------------------------------------------
def small_book(spark, seed=8, symbols=7, portfolios=4, days=400):
    """Random bars with gaps and null closes, dividends, rates with gaps; a symbol without bars, one that begins late, holdings of any inception."""
    rng = np.random.default_rng(seed)
    day = lambda i: DAY + dt.timedelta(days=int(i))
    closes = [(f"S{k}", day(i), None if rng.random() < 0.05 else float(rng.integers(50, 99))) for k in range(symbols - 1) for i in np.unique(rng.integers(200 if k == 1 else 0, days, 300))]
    paid = [(f"S{k}", day(i), float(k + 1)) for k in range(symbols) for i in np.unique(rng.integers(0, days, 15))]
    rates = [(c, day(i), float(rng.integers(80, 120)) / 100) for c in ("USD", "EUR") for i in np.unique(rng.integers(20, days, 250))]
    ports = [(f"P{k}", day(40 * k)) for k in range(portfolios)]
    hold = [(f"P{k}", f"S{m}", ("CHF", "USD", "EUR", "JPY")[m % 3 if m < 6 else 3], m + 1) for k in range(portfolios) for m in range(symbols) if (k + m) % 3 and not (k == 0 and m > 4)]
    make = spark.createDataFrame
    return (make(hold, "portfolio string, symbol string, ccy string, shares long"), make(ports, "portfolio string, inception date"), make(closes, "symbol string, date date, close double"),
            make(paid, "symbol string, date date, amount double"), make(rates, "ccy string, date date, rate double"))


def held_of(book, chunk):
    hold, ports, closes, paid, rates = book
    placed = nav.chunks(hold, chunk)
    return nav.held(nav.histories(placed, ports, closes, paid), nav.dated_rates(placed, ports, closes, rates, "CHF"))


def same(got, want, keys):
    plain = lambda df: {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
    a, b = plain(got), plain(want)
    assert a and set(a) == set(b)
    for k, x in b.items():
        for c, v in x.items():
            assert a[k][c] == v or isinstance(v, float) and math.isclose(a[k][c], v, rel_tol=1e-9, abs_tol=1e-12), (k, c, a[k][c], v)


@pytest.mark.parametrize("chunk", [2, 128])
def test_days_made_of_histories_are_the_components(spark, chunk):
    book = small_book(spark)
    hold, ports, closes, paid, rates = book
    want = nav.component_values(nav.filled_spine(hold, ports, closes, paid), hold, rates, "CHF")
    got = nav.held_components(held_of(book, chunk))
    same(got, want, ("portfolio", "symbol", "date"))


def test_components_stay_where_their_portfolios_are(spark):
    """A portfolio's days come out of its stored histories without a shuffle; before, each of them was dealt twice and written."""
    b = Book(spark, "/root/testdata/sf0.001")
    plan = b.components.groupBy("portfolio", "chunk", "date").count()._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("chunk", [2, 128])
def test_risk_of_held_by_components(spark, chunk):
    book = small_book(spark)
    hold = book[0].where("symbol not in ('S1', 'S6')")
    book = (hold, *book[1:])
    held = held_of(book, chunk)
    comp = nav.held_components(held).select("portfolio", "symbol", "date", "value").localCheckpoint()
    returns = risk.component_returns(comp)
    same(heldrisk.corr_matrix(held), risk.corr_matrix(returns), ("portfolio", "i", "j"))
    same(heldrisk.cov_matrix(held), risk.cov_matrix(returns), ("portfolio", "i", "j"))
    navs = comp.groupBy("portfolio", "date").agg(F.sum("value").alias("nav"))
    for got, want in zip(heldrisk.risk_decomposition(held, navs), risk.risk_decomposition(comp, navs)):
        same(got, want, ("portfolio", "symbol") if "symbol" in want.columns else ("portfolio",))
    bench = comp.where("symbol = 'S2'").select("portfolio", F.lit("B").alias("benchmark"), "date", F.sin(F.unix_date("date")).alias("r"))
    same(heldrisk.corr_benchmark(held, bench), risk.corr_benchmark(returns, bench), ("portfolio", "symbol", "benchmark"))
    windows = book[1].select("portfolio", F.explode(F.array(*map(F.lit, (0, 70)))).alias("k")).select("portfolio", F.concat(F.lit("w"), "k").alias("window"), F.date_add(F.lit(DAY), F.col("k")).alias("lo"), F.lit(DAY + dt.timedelta(days=390)).alias("hi"))
    inside = comp.join(windows, "portfolio").where(F.col("date").between(F.col("lo"), F.col("hi"))).select(F.concat_ws("|", "portfolio", "window").alias("portfolio"), "symbol", "date", "value")
    same(heldrisk.corr_matrix(held, windows), risk.corr_matrix(risk.component_returns(inside)), ("portfolio", "i", "j"))
    rows = nav.held_components(held, windows).select(F.concat_ws("|", "portfolio", "window").alias("portfolio"), "symbol", "date", "value")
    same(rows, inside, ("portfolio", "symbol", "date"))


def test_squares_of_tiles(spark):
    """More symbols than a square holds."""
    book = small_book(spark, 9, 14, 2)
    held = held_of((book[0].where("symbol not in ('S1', 'S13')"), *book[1:]), 2)
    returns = risk.component_returns(nav.held_components(held))
    same(heldrisk.corr_matrix(held), risk.corr_matrix(returns), ("portfolio", "i", "j"))
