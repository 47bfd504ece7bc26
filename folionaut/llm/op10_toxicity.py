"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Folding: lower case, compatibility forms, lookalikes of other alphabets, digits and signs that stand for
letters, zero-width characters; l, 1 and i become one letter. The folded words, one space between, run through one
automaton that holds lexicon terms (whole words, or starts of words for families of inflected forms) and exception
phrases; a term inside an exception phrase doesn't count. The sum of the weights over the number of words,
and the number of hits, give the score by a logistic curve.

Weights are cautious log-odds of a term in toxic against other texts, counted by Spark over a sample of at most `sample`
labelled rows (the smallest hashes of doc_id), which are written once; fixed seed terms have a weight from the start. A term needs
SUPPORT toxic texts of the sample, whatever their number; the sample alone bounds the lexicon. The curve
is fitted on the same rows. Without labels of both kinds the seeds and a fixed curve serve.

Null and empty texts have no words and get the curve's score for none. Repeated rows are scored one by one; a doc_id
labelled more than once counts as toxic if any of its labels says so, and null labels don't count. Of rows that repeat a
labelled doc_id, the one with the smallest text is learnt from. A null doc_id has no label, isn't held out and is scored like any other. Texts are
scored whole. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, written

#: Lookalikes (Cyrillic, Greek, signs, digits) and the letters that they stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i",
}
#: Terms that have a weight before any label is seen.
SEEDS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
    "imbecile", "abschaum", "arschloch", "dummkopf", "connard", "salaud", "abruti", "imbécil", "estúpido", "cabrón",
)
#: Phrases in which a term is harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "take out the trash", "pond scum", "soap scum", "clown fish", "circus clown",
    "idiot proof", "sore loser rule", "stupid question is", "scum village",
)
SEED_WEIGHT = 4.0
SAMPLE = 12_000
SUPPORT = 5
THRESHOLD = 0.7
#: The curve's constant, its factor for the weighted density and for the hits, without labels.
CURVE = (-6.0, 1.2, 1.5)
_HIDDEN = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"\S*[0-9@$!|€]\S*")


@cache
def _letters() -> dict[int, str]:
    return {ord(k): v for k, v in LOOKALIKES.items() if not k.isascii() and k.isalpha()} | {ord("l"): "i"}


@cache
def _signs() -> dict[int, str]:
    return {ord(k): v for k, v in LOOKALIKES.items() if not k.isalpha()}


def _unmask(m: re.Match) -> str:
    """Digits and signs within a word become letters; those at its ends stay punctuation, and numbers stay numbers."""
    word = m[0]
    core = word.strip("!|.,;:?\"'()[]*&%#-")
    if not core or not any(c.isalpha() for c in core) and not core.isalnum():
        return word
    return word.replace(core, core.translate(_signs())) if any(c.isalpha() for c in core) else word


def fold(text: str) -> str:
    """Folded words with one space before, between and behind them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_HIDDEN)
    text = text.lower()
    text = _MIXED.sub(_unmask, text).translate(_letters())
    words = _WORD.findall(text)
    return f" {' '.join(words)} " if words else " "


def automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    """Keys of lexicon: folded, with a space in front, and one behind if the term is a whole word."""
    machine = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        machine.add_word(term, (len(term), weight))
    for phrase in EXCEPTIONS:
        key = fold(phrase)
        machine.add_word(key, (len(key), None))
    machine.make_automaton()
    return machine


def matches(machine: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Sum of the weights and number of words hit; of terms at one word the heaviest counts."""
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, -np.inf))
    if spared:
        hits = {at: w for at, w in hits.items() if not any(a <= at < b for a, b in spared)}
    return sum(hits.values()), len(hits)


def features(machine: ahocorasick.Automaton, texts) -> np.ndarray:
    out = []
    for text in texts:
        folded = fold(text or "")
        weight, hits = matches(machine, folded)
        words = folded.count(" ") - 1
        out.append((np.log1p(1000.0 * max(0.0, weight) / (words + 20.0)), np.log1p(hits)))
    return np.array(out, dtype=np.float64).reshape(len(out), 2)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; L2 of 0.01 for each row keeps it finite where the classes don't overlap."""
    if len(y) == 0 or y.min() == y.max():
        return CURVE
    scale = x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), x / scale])
    # Either class counts half, so that the boundary lies between them however rare one is.
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (share * (p - y)) + np.array([0, 1e-3, 1e-3]) * w
        hess = (a * (share * p * (1 - p))[:, None]).T @ a + np.diag([1e-9, 1e-3, 1e-3])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale[0]), float(w[2] / scale[1])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each candidate term: whole words of two letters or more, and starts of 4 to 6 letters."""
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        columns = [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(fold(text).split())
            own = {f" {w} " for w in words if len(w) > 1} | {f" {w[:k]}" for w in words for k in (4, 5, 6) if len(w) > k}
            (toxic if y else clean).update(own)
        if len(toxic) + len(clean) > 500_000:
            yield out()
            toxic.clear()
            clean.clear()
    if toxic or clean:
        yield out()


def learn(rows: DataFrame, support: int = SUPPORT, seeds: tuple[str, ...] = SEEDS) -> dict[str, float]:
    """Lexicon from rows of text and toxic: seeds, and terms that are at least ten times as frequent in toxic texts."""
    lexicon = {fold(w): SEED_WEIGHT for w in seeds}
    n = {bool(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic or not clean:
        return lexicon
    sums = rows.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t"), F.col("c")
    odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((c + 0.5) / (clean - c + 0.5))
    error = F.sqrt(1 / (t + 0.5) + 1 / (toxic - t + 0.5) + 1 / (c + 0.5) + 1 / (clean - c + 0.5))
    # The weight is the lower end of the log-odds' 90% interval: terms seen by chance in a few toxic texts weigh little.
    found = sums.where((t >= support) & (t * clean >= c * 10 * toxic)).select("term", "t", F.round(odds - 1.64 * error, 6).alias("w")).where("w >= 1.5")
    best = {r.term: r for r in found.collect()}  # terms of several of the sample's toxic texts
    longer: dict[str, list[str]] = {}
    for term in best:
        for k in (5, 6, 7):  # starts, with the space in front
            if len(term) > k and term[:k] in best:
                longer.setdefault(term[:k], []).append(term)
    # Of a start and its longer forms, the longer stays if it has nearly all of the start's texts, else the start.
    for start in sorted(longer, key=lambda x: (len(x), x)):
        if start not in best:
            continue
        own = [k for k in longer[start] if k in best]
        if any(best[k].t >= 0.9 * best[start].t for k in own):
            best.pop(start)
        else:
            for k in own:
                best.pop(k)
    return lexicon | {term: float(r.w) for term, r in sorted(best.items())}


def held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seeds: tuple[str, ...] = SEEDS) -> tuple[dict[str, float], tuple[float, float, float]]:
    """(lexicon, curve) from labelled rows that aren't held out, at most `sample` of them."""
    spark = docs.sparkSession
    usable = held_out(labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic")).where("not held_out")
    marked = usable.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    draw = F.xxhash64("doc_id")
    part = min(1.0, 2 * sample / max(1, marked.count()))
    chosen = marked.where(F.pmod(draw, F.lit(1 << 20)) < int(part * (1 << 20)) + 1).orderBy(draw).limit(sample)
    # At most `sample` rows of 9 bytes: broadcast, so that no other text is shuffled.
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    with small_batches(spark):
        rows = written(spark, drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-sample")
        lexicon = learn(rows, seeds=seeds)
        machine = automaton(lexicon)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = features(machine, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("toxic")], ["a", "b", "toxic"])

        seen = rows.mapInArrow(measure, "a double, b double, toxic boolean").collect()  # at most `sample` rows
    seen = np.array(sorted((r.a, r.b, float(r.toxic)) for r in seen), dtype=np.float64).reshape(len(seen), 3)  # sums don't depend on the order of the tasks
    return lexicon, fit_curve(seen[:, :2], seen[:, 2])


def _scorer(docs: DataFrame, labels: DataFrame, sample: int, seeds: tuple[str, ...]):
    """A function from an automaton and texts to (scores, features), and one that makes the automaton."""
    lexicon, (constant, by_density, by_hits) = train(docs, labels, sample, seeds)

    def score(machine: ahocorasick.Automaton, texts: list) -> tuple[np.ndarray, np.ndarray]:
        x = features(machine, texts)
        return 1 / (1 + np.exp(-np.clip(constant + by_density * x[:, 0] + by_hits * x[:, 1], -30, 30))), x

    return score, lambda: automaton(lexicon)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, and hits (words of the lexicon)."""
    score, make = _scorer(docs, labels, sample, seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = make()
        for batch in (part for whole in batches for part in slices(whole)):
            p, x = score(machine, batch.column("text").to_pylist())
            hits = pa.array(np.rint(np.expm1(x[:, 1])).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), hits], ["doc_id", "held_out", "score", "predicted", "hits"])

    rows = held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hits long")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    score, make = _scorer(docs, labels, sample, seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = make()
        for batch in (part for whole in batches for part in slices(whole)):
            yield batch.filter(pa.array(score(machine, batch.column("text").to_pylist())[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
