"""URL filter: rules first, then gradient-boosted trees on lexical features.

Host, path and the longest fitting rule are column expressions. URLs that a rule fits are the labelled ones: a bounded
sample of distinct ones (the `sample` smallest by hash, so it doesn't depend on how the table is dealt or how often a URL is in it) trains boosted regression
trees on the logistic loss, with histogram splits, and the trees judge the URLs that no rule fits. Features: lengths of
URL, host and path, depth, labels of the host, digit ratio, entropy of the characters, number of parameters, hyphens,
an extension, a scheme of https, a fragment, and suffix statistics (smoothed log-odds of the block
label for the host's last label, for its last two, and for the path's first part). These come from
the sample and so have at most `sample` entries each; a training row's own are counted over the other folds of the sample, so
that no row sees its own label. Tasks turn URLs into features of a fixed size; the driver gets these, never URLs.

Null URLs and those without `://` have an empty host and path, fit no rule and are judged by the trees like any
other. With no labelled URLs or labels of one kind only, the trees are empty and the verdict is `default`. Repeated rows are judged one
by one; null page_ids stay null; ties in a split go to the first feature and cut. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, slices, table

#: Verdict, and the rule's host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE = 20_000
FOLDS = 5
_SPLITS = 32
_LEXICAL, _SUFFIX = 12, 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    name = verdict = None
    for kind, of, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        name = F.when(fits, of + start) if name is None else name.when(fits, of + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


# --- features ------------------------------------------------------------------------------------------------
def _suffixes(host: str, path: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), "/" + path[1:].partition("/")[0]


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.unique(np.frombuffer(text.encode(), dtype=np.uint8), return_counts=True)[1]
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def lexical(urls: list, hosts: list, paths: list) -> np.ndarray:
    out = []
    for url, host, path in zip(urls, hosts, paths):
        url = url or ""
        query = url.partition("#")[0].partition("?")[2]
        name = path.rpartition("/")[2]
        out.append([
            len(url), len(host), len(path), path.count("/"), host.count(".") + bool(host),
            sum(c.isdigit() for c in url) / max(1, len(url)), _entropy(url), len([x for x in query.split("&") if x]),
            url.count("-") + url.count("_"), "." in name, url.startswith("https:"), "#" in url,
        ])
    return np.array(out, dtype=np.float64).reshape(len(out), _LEXICAL)


def suffix_keys(hosts: list, paths: list) -> np.ndarray:
    """Hashes of each row's three suffixes; they stand for the strings, so that a row has a fixed size."""
    out = [[int.from_bytes(hashlib.blake2b(x.encode(), digest_size=7).digest()) for x in _suffixes(h, p)] for h, p in zip(hosts, paths)]
    return np.array(out, dtype=np.int64).reshape(len(out), _SUFFIX)


class SuffixOdds:
    """Smoothed log-odds of the label for each suffix; 0 for one that wasn't seen."""

    def __init__(self, keys: np.ndarray, y: np.ndarray):
        self.of = []
        for j in range(_SUFFIX):
            own, at = np.unique(keys[:, j], return_inverse=True)
            blocked = np.bincount(at, y, len(own))
            self.of.append((own, np.log((blocked + 1) / (np.bincount(at, minlength=len(own)) - blocked + 1))))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(keys.shape)
        for j, (own, odds) in enumerate(self.of):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys[:, j]), len(own) - 1)
                out[:, j] = np.where(own[at] == keys[:, j], odds[at], 0.0)
        return out


def out_of_fold(keys: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's suffix statistics from the rows of other folds."""
    out = np.zeros(keys.shape)
    for f in range(FOLDS):
        out[fold == f] = SuffixOdds(keys[fold != f], y[fold != f])(keys[fold == f])
    return out


# --- boosted trees -------------------------------------------------------------------------------------------
class BoostedTrees:
    """Trees for the logistic loss: Newton steps in the leaves, splits at quantiles, L2 of 1."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 8):
        self.n, self.depth, self.rate, self.least, self.trees, self.start = trees, depth, rate, least, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if len(y) == 0 or y.min() == y.max():
            self.start = np.nan
            return self
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, _SPLITS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, cuts, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self.rate * self._one(tree, x)
        return self

    def _grow(self, bins, cuts, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-9, None, None)
        for j in range(bins.shape[1] if depth else 0):
            if not len(cuts[j]):
                continue
            b = bins[rows, j]
            k = len(cuts[j]) + 1
            gs, hs, ns = (np.bincount(b, w, k).cumsum()[:-1] for w in (grad[rows], hess[rows], None))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain = np.where((ns >= self.least) & (len(rows) - ns >= self.least), gain, 0)
            c = int(gain.argmax())
            if gain[c] > best[0] + 1e-9:
                best = (float(gain[c]), j, c)
        if best[1] is None:
            return -g / (h + 1)
        _, j, c = best
        left = bins[rows, j] <= c
        return j, float(cuts[j][c]), self._grow(bins, cuts, grad, hess, rows[left], depth - 1), self._grow(bins, cuts, grad, hess, rows[~left], depth - 1)

    def _one(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, below, above = tree
        return np.where(x[:, j] <= cut, self._one(below, x), self._one(above, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds; NaN without training."""
        return self.start + self.rate * sum((self._one(t, x) for t in self.trees), np.zeros(len(x)))


class Model:
    """Suffix statistics and trees from rows of features, suffix keys, labels and folds."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, y: np.ndarray, fold: np.ndarray, **trees):
        self.odds = SuffixOdds(keys, y)
        self.trees = BoostedTrees(**trees).fit(np.hstack([x, out_of_fold(keys, y, fold)]), y)

    def __call__(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Probability of block; NaN without training."""
        return 1 / (1 + np.exp(-np.clip(self.trees.score(np.hstack([x, self.odds(keys)])), -30, 30)))


def labelled(judged: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, suffix keys, labels, folds) of at most `sample` distinct labelled URLs, from rows of url, host, path and verdict."""
    known = judged.where("verdict is not null").select("url", "host", "path", (F.col("verdict") == "block").alias("blocked"))
    # Twice the share that is needed passes the first test, so that no task sorts more than a few samples.
    n = known.agg(F.approx_count_distinct("url")).first()[0]
    part = min(1.0, 2 * sample / max(1, n))
    draw = F.xxhash64("url")
    near = known.where(F.pmod(draw, F.lit(1 << 20)) < int(part * (1 << 20)) + 1).withColumn("draw", draw)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "url", rows=10_000)):
            urls, hosts, paths = (batch.column(c).to_pylist() for c in ("url", "host", "path"))
            x, keys = lexical(urls, hosts, paths), suffix_keys(hosts, paths)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v.shape[1]).cast(pa.list_(pa.array(v.reshape(-1)).type)) for v in (x, keys)]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), *columns, batch.column("blocked")], ["draw", "x", "keys", "blocked"])

    shaped = near.mapInArrow(measure, "draw long, x array<double>, keys array<long>, blocked boolean")
    rows = shaped.distinct().orderBy("draw", "x", "keys").limit(sample).collect()  # at most `sample` rows of 15 numbers
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), _LEXICAL)
    keys = np.array([r["keys"] for r in rows], dtype=np.int64).reshape(len(rows), _SUFFIX)
    return x, keys, np.array([r.blocked for r in rows], dtype=np.float64), np.array([(r.draw >> 20) % FOLDS for r in rows], dtype=np.int64)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict (null: no rule fits)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("*", name.alias("rule"), verdict.alias("verdict"))


def held_out_accuracy(pages: DataFrame, rules=RULES, sample: int = SAMPLE, fold: int = 0) -> tuple[float, int]:
    """(share of right verdicts, rows) on the labelled URLs of one fold, by a model that saw only the other folds."""
    x, keys, y, folds = labelled(with_rules(pages, rules), sample)
    learn, test = folds != fold, folds == fold
    p = Model(x[learn], keys[learn], y[learn], folds[learn])(x[test], keys[test])
    return float(((p >= 0.5) == (y[test] > 0.5)).mean()), int(test.sum())


def url_filter(pages: DataFrame, rules=RULES, sample: int = SAMPLE, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (probability of block by the trees; null where a rule decides)."""
    judged = with_rules(pages, rules)
    model = Model(*labelled(judged, sample))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "url", rows=10_000)):
            verdict = batch.column("verdict").to_pylist()
            free = np.array([v is None for v in verdict], dtype=bool)
            own = batch.filter(pa.array(free))
            hosts, paths = own.column("host").to_pylist(), own.column("path").to_pylist()
            score = np.full(len(free), np.nan)
            score[free] = model(lexical(own.column("url").to_pylist(), hosts, paths), suffix_keys(hosts, paths))
            guess = np.where(np.isnan(score), default, np.where(score >= 0.5, "block", "allow")).tolist()
            final = pa.array([g if v is None else v for v, g in zip(verdict, guess)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), final, pa.array(score, mask=np.isnan(score))], ["page_id", "host", "path", "rule", "verdict", "score"])

    return judged.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, score double")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
