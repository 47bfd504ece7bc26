"""Exact quantiles by narrowed ranges, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folionaut.operators import metrics, rolling
from folionaut.operators.quantiles import narrowed_quantiles

LEVELS = (0.0, 0.01, 0.05, 0.5, 0.99, 1.0)


def compare(df, groups, accuracy):
    got = {r["g"]: r for r in narrowed_quantiles(df, ("g",), "v", LEVELS, accuracy=accuracy).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        assert [got[g][f"q{i}"] for i in range(len(LEVELS))] == pytest.approx(list(np.quantile(values, LEVELS)), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_hot_small_tied_and_extreme_groups(spark, accuracy):
    rng = np.random.default_rng(5)
    groups = {
        "hot": rng.standard_normal(8000), "outlier": np.append(rng.standard_normal(500) * 1e-10, [1e6, -1e300]), "tied": np.repeat([1.0, 2.0, 3.0], [1, 900, 2]),
        "one": np.array([4.0]), "two": np.array([-1.0, 2.0]), None: rng.random(37),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("hot", float("nan")), ("gone", None)]
    compare(spark.createDataFrame(rows, "g string, v double").repartition(7), groups, accuracy)


def test_empty(spark):
    df = narrowed_quantiles(spark.createDataFrame([], "g string, v double"), ("g",), "v", (0.5,))
    assert df.columns == ["g", "n", "q0"] and df.count() == 0


def test_between_the_fences_only(spark):
    """Of a long group, few values are ranked."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    r = narrowed_quantiles(df, ("g",), "v", (0.05,), accuracy=1000).first()
    assert r["q0"] == pytest.approx(df.agg(F.percentile("v", 0.05)).first()[0], rel=1e-12)


def test_long_series_give_the_same(spark):
    import datetime as dt

    rng = np.random.default_rng(8)
    rows = [(s, dt.date(2015, 1, 1) + dt.timedelta(days=i), float(x)) for s in "AB" for i, x in enumerate(100 * np.cumprod(1 + rng.standard_normal(700) / 100))]
    s = spark.createDataFrame(rows, "series_id string, date date, value double")
    for f in (metrics.var_cvar, metrics.tail_ratios, rolling.vol_cone, rolling.vol_regimes):
        keys = [c for c in ("series_id", "days", "regime") if c in f(s).columns][: 2]
        plain, long_ = (sorted(map(tuple, df.collect())) for df in (f(s), f(s, long=True)))
        assert len(plain) == len(long_) and keys
        for x, y in zip(plain, long_):
            assert x[0] == y[0] and list(x[1:]) == pytest.approx(list(y[1:]), rel=1e-9)
