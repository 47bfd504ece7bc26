"""Exact quantiles of groups too long for one buffer, by ranges narrowed with mergeable summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def narrowed_quantiles(rows: DataFrame, keys: tuple[str, ...], value: str, levels: tuple[float, ...], accuracy: int = 10_000, salts: int = 16) -> DataFrame:
    """keys, n and q0, q1, ...: one exact, linearly interpolated quantile per level, as F.percentile gives it. Nulls and NaN take no part.

    A mergeable summary of `accuracy` gives two fences around each level, whose ranks are off by n / accuracy at most. Counts tell how many values
    lie below the fences; only values between them, some 8 n / accuracy of them, are counted by value and ranked in one task. Fences that
    don't hold the rank (groups of fewer than `accuracy` values) are replaced by the least and the largest value. Rows meet their group's fences in
    `salts` parts, so a group with most of the rows isn't one task's.
    """
    v = F.col("_v")
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    width = 3.0 / accuracy
    fences = [max(0.0, p - width) for p in levels] + [min(1.0, p + width) for p in levels]
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.percentile_approx("_v", fences, accuracy).alias("f"))
    parts = F.transform(F.array(*map(F.lit, levels)), lambda p, i: F.struct(
        i.alias("i"), (p * (F.col("n") - 1)).alias("at"),
        F.when(p <= width, F.col("least")).otherwise(F.element_at("f", i + 1)).alias("lo"),
        F.when(p >= 1 - width, F.col("most")).otherwise(F.element_at("f", i + 1 + len(levels))).alias("hi")))
    own = own.select(*keys, "n", "least", "most", parts.alias("f"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int"))

    def met(fenced: DataFrame) -> DataFrame:
        spread = fenced.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = [*same, F.col("l._salt") == F.col("r._salt")]
        return salted.alias("l").join(spread.alias("r"), on).select(*(F.col(f"l.{c}").alias(c) for c in keys), "_v", "f")

    below = [F.sum((v < F.col("f")[i]["lo"]).cast("long")) for i in range(len(levels))]
    upto = [F.sum((v <= F.col("f")[i]["hi"]).cast("long")) for i in range(len(levels))]
    counts = met(own).groupBy(*keys).agg(F.array(*below).alias("below"), F.array(*upto).alias("upto"))
    own = own.alias("l").join(counts.alias("r"), same).select("l.*", "below", "upto")

    def kept(x, i):
        good = (F.element_at("below", i + 1) <= F.floor(x["at"])) & (F.element_at("upto", i + 1) > F.ceil(x["at"]))
        return F.struct(
            x["i"].alias("i"), x["at"].alias("at"), F.when(good, x["lo"]).otherwise(F.col("least")).alias("lo"),
            F.when(good, x["hi"]).otherwise(F.col("most")).alias("hi"), F.when(good, F.element_at("below", i + 1)).otherwise(F.lit(0)).alias("below"))

    fenced = own.select(*keys, F.transform("f", kept).alias("f"))
    inside = met(fenced).withColumn("x", F.explode(F.filter("f", lambda x: (v >= x["lo"]) & (v <= x["hi"])))).groupBy(*keys, "x.i", "x.at", "x.below", "_v").count()
    run = Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("last", F.col("below") + F.sum("count").over(run) - 1)
    first = lambda k: F.min(F.when(F.col("last") >= k, v))
    found = ranked.groupBy(*keys, "i").agg(first(F.floor("at")).alias("a"), first(F.ceil("at")).alias("b"), F.max("at").alias("at"))
    q = F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, q)).alias(f"q{i}") for i in range(len(levels))))
    sizes = own.select(*keys, "n")
    return sizes.alias("l").join(wide.alias("r"), same).select("l.*", *(f"q{i}" for i in range(len(levels))))
