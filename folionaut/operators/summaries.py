"""Windows of any number over a tree of mergeable summaries.

A summary holds what can be merged of a run of a series' rows: ends, extrema, the deepest fall, and of its returns their number, moments to the fourth, extrema and one-sided
sums. Two runs that follow each other merge into one. A series carries a dyadic tree of them: node (level, idx) covers the rows [idx 2^level, (idx + 1) 2^level). A window is its first row (whose
return lies outside) and at most 2 log2(n) nodes, so what is read of a series doesn't grow with the lengths of its windows.

The tree is built in spans of SPAN rows, then of SPAN spans, and so on, so a long series is many tasks; the windows of a series are answered in groups of about GROUP.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import TRADING_DAYS, Z, ratio
from .series import ordered, window_places

TD = float(TRADING_DAYS)
LOG_SPAN = 10
SPAN = 1 << LOG_SPAN
GROUP = 256
#: Of the rows: first and last day and value, highest and lowest value and the first day of the lowest, deepest fall and its first day. Of the returns: number, mean,
#: sums of the 2nd to 4th powers of deviations, least and largest, how many are positive and negative, sums of the positive, of those not positive, of the negative, and of the negative's 2nd and 3rd powers.
ROWS = ("d0", "d1", "v0", "v1", "top", "low", "low_day", "dd", "dd_day")
RETURNS = ("n", "mean", "m2", "m3", "m4", "least", "most", "n_up", "n_down", "gain", "loss", "fall", "down2", "down3")
FIELDS = (*ROWS, *RETURNS)
_SCHEMA = ", ".join(f"{c} double" for c in FIELDS)
Summary = dict[str, np.ndarray]


def leaves(day: np.ndarray, value: np.ndarray, r: np.ndarray) -> Summary:
    """Summaries of single rows; a return that is NaN doesn't exist."""
    has, zero = ~np.isnan(r), np.zeros(len(r))
    x = np.where(has, r, 0.0)
    up, down = x > 0, x < 0
    return {
        "d0": day, "d1": day, "v0": value, "v1": value, "top": value, "low": value, "low_day": day, "dd": np.where(value != 0, 0.0, np.nan), "dd_day": np.where(value != 0, day, np.nan),
        "n": has.astype(float), "mean": x, "m2": zero, "m3": zero, "m4": zero, "least": np.where(has, r, np.inf), "most": np.where(has, r, -np.inf), "n_up": up.astype(float), "n_down": down.astype(float),
        "gain": np.where(up, x, 0), "loss": np.where(up, 0, x), "fall": np.where(down, x, 0), "down2": np.where(down, x * x, 0), "down3": np.where(down, x**3, 0),
    }


def merged(a: Summary, b: Summary) -> Summary:
    """Summaries of runs a followed by runs b."""
    na, nb = a["n"], b["n"]
    n = np.maximum(na + nb, 1)
    # A side without returns has no mean of its own.
    gap = np.where((na > 0) & (nb > 0), b["mean"] - a["mean"], 0.0)
    out = {"d0": a["d0"], "d1": b["d1"], "v0": a["v0"], "v1": b["v1"], "top": np.maximum(a["top"], b["top"]), "low": np.minimum(a["low"], b["low"])}
    out["low_day"] = np.where(a["low"] <= b["low"], a["low_day"], b["low_day"])
    with np.errstate(all="ignore"):
        across = np.where(a["top"] != 0, b["low"] / a["top"] - 1, np.nan)
    out["dd"] = np.fmin(np.fmin(a["dd"], b["dd"]), across)
    day = np.where(a["dd"] == out["dd"], a["dd_day"], np.inf)
    day = np.fmin(day, np.where(across == out["dd"], b["low_day"], np.inf))
    day = np.fmin(day, np.where(b["dd"] == out["dd"], b["dd_day"], np.inf))
    out["dd_day"] = np.where(np.isnan(out["dd"]), np.nan, day)
    out["n"] = na + nb
    out["mean"] = np.where(na == 0, b["mean"], np.where(nb == 0, a["mean"], a["mean"] + gap * nb / n))
    out["m2"] = a["m2"] + b["m2"] + gap**2 * na * nb / n
    out["m3"] = a["m3"] + b["m3"] + gap**3 * na * nb * (na - nb) / n**2 + 3 * gap * (na * b["m2"] - nb * a["m2"]) / n
    out["m4"] = a["m4"] + b["m4"] + gap**4 * na * nb * (na**2 - na * nb + nb**2) / n**3 + 6 * gap**2 * (na**2 * b["m2"] + nb**2 * a["m2"]) / n**2 + 4 * gap * (na * b["m3"] - nb * a["m3"]) / n
    out |= {"least": np.minimum(a["least"], b["least"]), "most": np.maximum(a["most"], b["most"])}
    return out | {c: a[c] + b[c] for c in ("n_up", "n_down", "gain", "loss", "fall", "down2", "down3")}


def _take(s: Summary, at) -> Summary:
    return {c: x[at] for c, x in s.items()}


def _columns(table: pa.Table) -> Summary:
    return {c: table.column(c).to_numpy() for c in FIELDS}


def _dyadic(base: int):
    """Of the nodes of one level, at most SPAN that follow each other: all their ancestors within the span (level base + 1 and up). Only full nodes are made."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        idx, s = rows.column("idx").to_numpy(), _columns(rows)
        parts = []
        for level in range(base + 1, base + LOG_SPAN + 1):
            skip = int(idx[0] & 1) if len(idx) else 0
            pairs = (len(idx) - skip) // 2
            if not pairs:
                break
            left = skip + 2 * np.arange(pairs)
            s, idx = merged(_take(s, left), _take(s, left + 1)), idx[left] >> 1
            parts.append(pa.table({"series_id": pa.array([key[0].as_py()] * pairs, pa.string()), "level": pa.array(np.full(pairs, level, dtype=np.int32)), "idx": idx, **s}))
        return pa.concat_tables(parts) if parts else pa.table({"series_id": pa.array([], pa.string()), "level": pa.array([], pa.int32()), "idx": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in FIELDS}})

    return run


def summary_tree(series: DataFrame) -> DataFrame:
    """series_id, level, idx and the fields of each node; level 0: the rows. Null values are left out first."""
    known = series.where(F.col("value").isNotNull()).select(F.col("series_id").cast("string").alias("series_id"), "date", "value")
    before = F.lag("value").over(ordered())
    rows = known.select("series_id", (F.row_number().over(ordered()) - 1).cast("long").alias("idx"), F.unix_date("date").cast("double").alias("day"), "value", (ratio("value", before) - 1).alias("r"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = leaves(*(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("day", "value", "r")))
            yield pa.RecordBatch.from_pydict({"series_id": batch.column("series_id"), "level": pa.array(np.zeros(batch.num_rows, dtype=np.int32)), "idx": batch.column("idx"), **s})

    schema = f"series_id string, level int, idx long, {_SCHEMA}"
    nodes = [rows.mapInArrow(first, schema)]
    longest = known.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    base = 0
    while longest > 1:
        at = nodes[-1].where(F.col("level") == base).withColumn("span", F.expr(f"idx div {SPAN}"))
        nodes.append(at.groupBy("series_id", "span").applyInArrow(_dyadic(base), schema))
        base, longest = base + LOG_SPAN, longest >> LOG_SPAN
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def pieces(i: int, j: int) -> list[tuple[int, int]]:
    """(level, idx) of the fewest dyadic nodes that cover the rows i..j, in order."""
    left, right, level = [], [], 0
    j += 1
    while i < j:
        if i & 1:
            left.append((level, i))
            i += 1
        if j & 1:
            j -= 1
            right.append((level, j))
        i, j, level = i >> 1, j >> 1, level + 1
    return left + right[::-1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("series_id", "window", "place", "level", "idx")}
        for s, w, i, j in zip(*(batch.column(c).to_pylist() for c in ("series_id", "window", "i", "j"))):
            nodes = [(0, i), *pieces(i + 1, j)]
            for c, x in zip(out, ([s] * len(nodes), [w] * len(nodes), range(len(nodes)), (n[0] for n in nodes), (n[1] for n in nodes))):
                out[c] += x
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds)], list(out))


def _answers(key: tuple, rows: pa.Table) -> pa.Table:
    """Each window's pieces merged, neighbours first."""
    rows = rows.sort_by([("window", "ascending"), ("place", "ascending")])
    names = rows.column("window").combine_chunks().dictionary_encode()
    window, place = names.indices.to_numpy() if isinstance(names, pa.DictionaryArray) else names.combine_chunks().indices.to_numpy(), rows.column("place").to_numpy()
    s = {c: x.copy() for c, x in _columns(rows).items()}
    outside = {"n": 0, "mean": 0, "least": np.inf, "most": -np.inf} | dict.fromkeys(("n_up", "n_down", "gain", "loss", "fall", "down2", "down3"), 0)
    for c, x in outside.items():
        s[c][place == 0] = x
    while len(window) > len(np.unique(window)):
        fresh = np.concatenate([[True], window[1:] != window[:-1]])
        at = np.arange(len(window)) - np.maximum.accumulate(np.where(fresh, np.arange(len(window)), 0))
        left = np.nonzero(at % 2 == 0)[0]
        paired = np.minimum(left + 1, len(window) - 1)
        both = (left + 1 < len(window)) & (window[paired] == window[left])
        two = merged(_take(s, left[both]), _take(s, paired[both]))
        s = _take(s, left)
        for c in s:
            s[c] = s[c].copy()
            s[c][both] = two[c]
        window = window[left]
    named = rows.column("window").combine_chunks().dictionary_encode().dictionary.take(pa.array(window))
    return pa.table({"series_id": pa.array([key[0].as_py()] * len(window), pa.string()), "window": named, **s})


def window_summaries(series: DataFrame, explicit: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """series_id, window and the fields of each window of analysis_windows: every preset, or explicit bounds (series_id, window, a, b). tree: summary_tree(series), if it is at hand."""
    known = series.where(F.col("value").isNotNull())
    places = window_places(known, explicit).select(F.col("series_id").cast("string").alias("series_id"), "window", "i", "j")
    asked = places.mapInArrow(_pieces, "series_id string, window string, place int, level int, idx long")
    nodes = summary_tree(known) if tree is None else tree
    many = places.groupBy("series_id").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    met = asked.join(nodes, ["series_id", "level", "idx"]).join(many, "series_id").withColumn("group", F.pmod(F.xxhash64("window"), F.col("groups")))
    return met.groupBy("series_id", "group").applyInArrow(_answers, f"series_id string, window string, {_SCHEMA}")


def window_statistics(series: DataFrame, explicit: DataFrame | None = None, rf: float = 0.0, tree: DataFrame | None = None) -> DataFrame:
    """series_id, window, from_date, to_date and the metrics that summaries give, by the rules of the blocks for whole series."""
    c, when = F.col, F.when
    s = window_summaries(series, explicit, tree)
    sd = F.sqrt(when(c("n") > 1, c("m2") / (c("n") - 1)))
    days = c("d1") - c("d0")
    s = s.withColumns({"sd": sd, "sk": ratio(c("m3") / c("n"), F.pow(c("m2") / c("n"), F.lit(1.5))), "ku": ratio(c("m4") / c("n"), F.pow(c("m2") / c("n"), F.lit(2.0))) - 3,
                       "dsd": when(c("n_down") > 0, F.sqrt(ratio("down2", "n_down"))).otherwise(0.0), "years": F.greatest(days / 365.25, F.lit(1e-9)), "growth": ratio("v1", "v0")})
    s = s.where("n > 0").withColumn("cagr", F.pow("growth", 1 / c("years")) - 1)
    sharpe = when(c("sd") > 0, (c("mean") * TD - rf) / (c("sd") * TD**0.5)).otherwise(F.lit(0.0))
    cf = {lv: z + (z**2 - 1) * c("sk") / 6 + (z**3 - 3 * z) * c("ku") / 24 - (2 * z**3 - 5 * z) * c("sk") * c("sk") / 36 for lv, z in Z.items()}
    date = lambda x: F.date_from_unix_date(c(x).cast("int"))
    return s.select(
        "series_id", "window", date("d0").alias("from_date"), date("d1").alias("to_date"), c("n").cast("long").alias("n"), (c("growth") - 1).alias("total"), "cagr", (c("mean") * TD).alias("mean_annual"),
        (c("sd") * TD**0.5).alias("vol"), sharpe.alias("sharpe"), when(c("dsd") > 0, (c("mean") * TD) / (c("dsd") * TD**0.5)).alias("sortino"), (c("dsd") * TD**0.5).alias("downside_deviation"),
        c("sk").alias("skew"), c("ku").alias("kurtosis"), c("most").alias("best_day"), c("least").alias("worst_day"), (c("n_up") / c("n")).alias("positive_day"),
        when(c("loss") < 0, c("gain") / -c("loss")).alias("omega"), when(c("fall") < 0, c("gain") / -c("fall")).alias("profit_factor"),
        *((z * c("sd") - c("mean")).alias(f"gauss_{lv}") for lv, z in Z.items()), *((cf[lv] * c("sd") - c("mean")).alias(f"cornish_fisher_{lv}") for lv in Z),
        c("dd").alias("max_dd"), date("dd_day").alias("max_dd_date"), when(c("dd") < 0, c("cagr") / F.abs("dd")).alias("calmar"),
    )
