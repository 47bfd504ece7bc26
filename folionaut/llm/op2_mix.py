"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern (the sorted set of
their sources); words flow from patterns to the sources they belong to and on to the sources' quotas. A pattern
offers its words once per repetition, each repetition dearer than the one before (0, 1, 4, ...), so the
cheapest flow repeats as little as it can. Every pattern gets its passes from such a flow, those of a single source too.

Sources that share a pattern, directly or through others, form a component; components are found by Spark and solved
apart, each in a task, so their number has no bound. One component is one task's work (see README for times). The driver holds a name and two numbers of each source, which are the
units that targets are set for, and no patterns.

A pattern's flow is so many whole passes over its documents plus a rest, which is filled with documents in an
order drawn from the seed: their words are summed by ranges of the draw, only the range in which the rest runs
out is divided further, and its documents are summed one by one. The document at which the rest
runs out gives just the words that are missing.

Null or empty texts have size 0 and take 0. A null source is a source of its own, last in order. Documents
with equal draws are ordered by doc_id, then size, then text; the draw of a null doc_id comes from the text. Rows that repeat all of
these can't be told apart: where the rest runs out among them they share it evenly, rounded down. Empty tables
give empty results. Extra columns are passed on, but those whose name starts with mix_ are replaced by the result's.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_counted, seeded_unit, table, word_count, written
from .components import components

#: Fixed value: the seed of the production mix.
SEED = 20240501
_SHIFTS = (22, 12)  # the draw's 32 bits: ranges of 2^22 draws, then of 2^12
#: In patterns the null source is NULL, and any other has NAMED ahead of its name: the null source sorts last and no name can be it.
NAMED, NULL = "0", "1"


def targets(sizes: dict, total: float, weights: dict, cap: float) -> dict:
    """Shares of total by weight, none above cap times the source's size; what is over is reshared by weight.

    The fill level is that at which the sources that aren't full take what the full ones leave.
    """
    order = sorted(sizes, key=lambda s: (cap * sizes[s] / weights[s], s))
    left, weight = float(total), float(sum(weights[s] for s in order))
    level = 0.0
    out = {}
    for i, s in enumerate(order):
        level = left / weight
        if cap * sizes[s] > level * weights[s]:
            out |= {t: level * weights[t] for t in order[i:]}
            break
        out[s] = float(cap * sizes[s])
        left, weight = left - cap * sizes[s], weight - weights[s]
    return out


class Flow:
    """Min-cost flow from patterns over sources to quotas, in whole words.

    Only the arcs of the repetitions have a cost, and every path holds exactly one of them, so the shortest path's length is the
    cost of the cheapest repetition that still leads somewhere. Successive shortest paths thus take the
    repetitions in order of cost: the arcs of one repetition are opened, then words are sent along shortest paths in
    levels (breadth first, then blocking flows) until none gets through, rerouting what was sent before where that helps.
    """

    def __init__(self, patterns: dict[tuple, int], quotas: dict):
        self.to: list[int] = []
        self.free: list[int] = []  # the reverse of arc e is e ^ 1
        self.patterns = list(patterns)
        self.words = [patterns[p] for p in self.patterns]
        names = sorted({s for p in self.patterns for s in p})
        at = {s: 2 + len(self.patterns) + i for i, s in enumerate(names)}
        self.out: list[list[int]] = [[] for _ in range(2 + len(self.patterns) + len(names))]
        self.augmentations = 0
        total = sum(quotas[s] for s in names)
        self.routes = {(i, s): self._arc(2 + i, at[s], total) for i, p in enumerate(self.patterns) for s in p}
        for s in names:
            self._arc(at[s], 1, quotas[s])

    def _arc(self, a: int, b: int, words: int) -> int:
        self.to += [b, a]
        self.free += [words, 0]
        self.out[a].append(len(self.to) - 2)
        self.out[b].append(len(self.to) - 1)
        return len(self.to) - 2

    def solve(self, repeats: int, cost=lambda k: k * k) -> dict[tuple, dict]:
        """pattern -> {source: words}."""
        for _ in sorted(range(repeats), key=cost):
            for i, words in enumerate(self.words):
                self._arc(0, 2 + i, words)
            while level := self._levels():
                self._send(level)
        flows: dict[tuple, dict] = {p: {} for p in self.patterns}
        for (i, s), e in self.routes.items():
            if self.free[e ^ 1]:
                flows[self.patterns[i]][s] = self.free[e ^ 1]
        return flows

    def _levels(self) -> list[int] | None:
        level = [-1] * len(self.out)
        level[0], queue = 0, deque([0])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.free[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level if level[1] >= 0 else None

    def _send(self, level: list[int]) -> None:
        """Sends words along paths that go up one level a step, until every such path is blocked."""
        following = [0] * len(self.out)
        path: list[int] = []
        while True:
            a = self.to[path[-1]] if path else 0
            if a == 1:
                words = min(self.free[e] for e in path)
                self.augmentations += 1
                for e in path:
                    self.free[e] -= words
                    self.free[e ^ 1] += words
                path = path[: next(i for i, e in enumerate(path) if not self.free[e])]
                continue
            arcs = self.out[a]
            while following[a] < len(arcs) and not (self.free[arcs[following[a]]] and level[self.to[arcs[following[a]]]] == level[a] + 1):
                following[a] += 1
            if following[a] < len(arcs):
                path.append(arcs[following[a]])
            elif path:
                following[self.to[path[-1] ^ 1]] += 1
                path.pop()
            else:
                return


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, dict]:
    """Words from each pattern to each source: pattern -> {source: words}; as many as can be, and the cheapest."""
    return Flow(patterns, quotas).solve(repeats)


def _solved(quotas: dict, repeats: int):
    """Solves the components of a task; rows come sorted by component."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        patterns = {tuple(p): int(words) for p, words in rows}
        flows = min_cost_flow(patterns, quotas, repeats)
        return pd.DataFrame({"mix_pattern": [list(p) for p in patterns], "mix_flow": [sum(flows[p].values()) for p in patterns]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        last = None
        for pdf in batches:
            for component, pattern, words in zip(pdf.component, pdf.mix_pattern, pdf.mix_words):
                if held and component != last:
                    yield solve(held)
                    held = []
                last = component
                held.append((pattern, words))
        if held:
            yield solve(held)

    return run


def _components(patterns: DataFrame, names: list) -> DataFrame:
    """patterns with the component (number of its first source) they belong to."""
    spark = patterns.sparkSession
    numbers = spark.createDataFrame(list(zip(names, range(len(names)))), "source string, number long")
    first = patterns.withColumn("source", F.element_at("mix_pattern", 1)).join(numbers, "source").drop("source")
    several = patterns.where(F.size("mix_pattern") > 1)
    if not several.limit(1).count():
        return first.withColumnRenamed("number", "component")
    ends = several.select(F.element_at("mix_pattern", 1).alias("a"), F.explode("mix_pattern").alias("b"))
    links = ends.join(numbers.select(F.col("source").alias("a"), F.col("number").alias("na")), "a").join(numbers.select(F.col("source").alias("b"), F.col("number").alias("nb")), "b")
    found = components(links.select("na", "nb"), "na", "nb").withColumnRenamed("node", "number")
    return first.join(found, "number", "left").withColumn("component", F.coalesce("component", "number")).drop("number")


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column | None = None,
    weights=lambda i, source: 1 + i % 3,
    share: float = 1.0,
    cap: float = 3.0,
    repeats: int = 3,
    seed: int = SEED,
) -> DataFrame:
    """docs' columns, then mix_size, mix_source_size and mix_target (sums over the document's sources), mix_taken.

    sources: an array of source names (null or empty: the null source). size: the words of a document, counted in its text
    if not given; what is read several times should hold it. weights: of the i-th source by code
    point, null last. Targets share `share` of all words; no document is taken more than `repeats` times.
    """
    spark = docs.sparkSession
    own = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.when(s.isNull(), F.lit(NULL)).otherwise(F.concat(F.lit(NAMED), s)))))
    own = F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, F.array(F.lit(NULL))).otherwise(own)
    sized = docs.withColumns({"mix_size": (word_count(F.col("text")) if size is None else size).cast("long"), "mix_pattern": own})
    grouped = sized.groupBy("mix_pattern").agg(F.sum("mix_size").cast("long").alias("mix_words"), F.count("*").alias("mix_rows"))
    patterns = written(spark, grouped, "mix-patterns")
    sizes = {r[0]: int(r[1]) for r in patterns.select(F.explode("mix_pattern").alias("s"), "mix_words").groupBy("s").agg(F.sum("mix_words")).collect()}  # one row per source
    total, rows = patterns.agg(F.coalesce(F.sum("mix_words"), F.lit(0)), F.coalesce(F.sum("mix_rows"), F.lit(0))).first()
    names = sorted(sizes)
    goal = targets(sizes, share * total, {s: float(weights(i, s[1:] if s != NULL else None)) for i, s in enumerate(names)}, cap)
    quotas = {s: int(math.floor(goal[s] + 0.5)) for s in names}
    parted = _components(patterns, names).repartition("component").sortWithinPartitions("component", "mix_pattern")
    flows = parted.select("component", "mix_pattern", "mix_words").mapInPandas(_solved(quotas, repeats), "mix_pattern array<string>, mix_flow long")
    # Of each pattern: passes, rest, and the sums of its sources' sizes and targets.
    numbers = spark.createDataFrame([(s, sizes[s], goal[s]) for s in names], "s string, mix_source_size long, mix_target double")
    sums = patterns.select("mix_pattern", F.explode("mix_pattern").alias("s")).join(numbers, "s").groupBy("mix_pattern").agg(F.sum("mix_source_size").alias("mix_source_size"), F.sum("mix_target").alias("mix_target"))
    passes = F.when(F.col("mix_words") > 0, F.expr("mix_flow div mix_words")).otherwise(F.lit(0).cast("long"))
    planned = patterns.join(flows, "mix_pattern").join(sums, "mix_pattern").withColumn("mix_passes", passes)
    planned = written(spark, planned.withColumn("mix_rest", F.col("mix_flow") - F.col("mix_passes") * F.col("mix_words")), "mix-plan")

    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    told = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    drawn = sized.withColumn("mix_draw", seeded_unit(seed, told))

    def with_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
        """df's rows with their pattern's row of plan; every pattern has one in `planned`."""
        return join_counted(df, plan, "mix_pattern", "mix_rows", rows)

    # The range of draws in which each pattern's rest runs out, in two steps; at most 2^10 sums for a pattern.
    edge = planned.select("mix_pattern", "mix_rows", "mix_rest", F.lit(0).cast("long").alias("mix_low"))
    for shift in _SHIFTS:
        within = with_plan(drawn.select("mix_pattern", "mix_draw", "mix_size"), edge).where("mix_rest > 0")
        if shift != _SHIFTS[0]:
            within = within.where(F.shiftright("mix_draw", _SHIFTS[0]) == F.shiftright("mix_low", _SHIFTS[0]))
        low = F.shiftleft(F.shiftright("mix_draw", shift), shift)
        sums = within.groupBy("mix_pattern", "mix_rows", "mix_rest", low.alias("mix_low")).agg(F.sum("mix_size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("mix_pattern").orderBy("mix_low")) - F.col("words")
        sums = sums.withColumn("before", run).where(F.col("before") < F.col("mix_rest"))
        last = F.row_number().over(Window.partitionBy("mix_pattern").orderBy(F.desc("mix_low")))
        edge = sums.withColumn("k", last).where("k = 1").select("mix_pattern", "mix_rows", (F.col("mix_rest") - F.col("before")).alias("mix_rest"), "mix_low")
        edge = written(spark, edge, "mix-edge")  # one row per pattern
    planned = planned.join(edge.select("mix_pattern", F.col("mix_rest").alias("mix_left"), "mix_low"), "mix_pattern", "left")
    # Documents of the last range: rows that can't be told apart are one row here, with their number.
    key = ["mix_pattern", "mix_draw", "mix_id", "mix_size", "mix_text"]
    named = drawn.withColumns({"mix_id": F.col("doc_id"), "mix_text": F.when(F.col("doc_id").isNull(), F.md5(text)).otherwise(F.lit(None).cast("string"))})
    bottom = F.shiftright("mix_draw", _SHIFTS[-1])
    cut = with_plan(named.select(*key), planned.select("mix_pattern", "mix_rows", "mix_rest", "mix_left", "mix_low"))
    cut = cut.where((F.col("mix_rest") > 0) & (bottom == F.shiftright("mix_low", _SHIFTS[-1]))).groupBy(*key, "mix_left").agg(F.count("*").alias("n"))
    ties = Window.partitionBy("mix_pattern").orderBy("mix_draw", "mix_id", "mix_size", "mix_text").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("mix_size") * F.col("n")
    part = F.least(words, F.col("mix_left") - (F.sum(words).over(ties) - words))
    cut = cut.withColumn("part", F.greatest(F.lit(0).cast("long"), part)).select(*key, F.expr("part div n").alias("mix_part"))
    # At most 2^12 draws of each pattern, of which one rest runs out: where it runs out, and what that row gives, is all that is needed.
    last = F.max(F.when(F.col("mix_part") > 0, F.struct("mix_draw", F.struct(F.col("mix_id").isNotNull(), F.col("mix_id")).alias("i"), "mix_size", F.struct(F.col("mix_text").isNotNull(), F.col("mix_text")).alias("t"), "mix_part")))
    ends = cut.groupBy("mix_pattern").agg(last.alias("mix_end"))
    planned = written(spark, planned.join(ends, "mix_pattern", "left"), "mix-plan")

    known = with_plan(named, planned)
    place = F.struct("mix_draw", F.struct(F.col("mix_id").isNotNull(), F.col("mix_id")).alias("i"), "mix_size", F.struct(F.col("mix_text").isNotNull(), F.col("mix_text")).alias("t"))
    end = F.struct(F.col("mix_end.mix_draw"), F.col("mix_end.i"), F.col("mix_end.mix_size"), F.col("mix_end.t"))
    below = bottom < F.shiftright("mix_low", _SHIFTS[-1])
    more = F.when(F.col("mix_rest") == 0, F.lit(0).cast("long")).when(below, F.col("mix_size")).when(F.col("mix_end").isNull(), F.lit(0).cast("long")).when(place < end, F.col("mix_size")).when(place == end, F.col("mix_end.mix_part")).otherwise(F.lit(0).cast("long"))
    kept = [c for c in docs.columns if not c.startswith("mix_")]
    return known.select(*kept, "mix_size", "mix_source_size", "mix_target", (F.col("mix_passes") * F.col("mix_size") + more).cast("long").alias("mix_taken"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("sources"), word_count(F.col("text")).alias("words"))
    # What follows reads sizes and draws several times: keep them, not the texts, but for a digest where the doc_id is null.
    digest = F.when(F.col("doc_id").isNull(), F.md5("text"))
    kept = written(spark, docs.withColumn("text", digest), "mix-sizes")
    out = mix(kept, F.col("sources"), size=F.col("words"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


ORACLE = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  ('0x' || substr(md5('{SEED}:' || doc_id::varchar), 1, 8))::bigint as draw from documents),
s as (select source, sum(size)::bigint as source_size,
             1.0e0 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
o as (select *, row_number() over (order by 3.0e0 * source_size / w, source nulls last) as i from s),
l as (select *, ((select sum(source_size) from s)::double - 3.0e0 * coalesce(sum(source_size) over (order by i rows between unbounded preceding and 1 preceding), 0)::double)
                / sum(w) over (order by i rows between current row and unbounded following) as level from o),
f as (select min(i) as first_free, arg_min(level, i) as level from l where 3.0e0 * source_size > level * w),
t as (select source, source_size, case when i >= coalesce(first_free, 1e18) then f.level * w else 3.0e0 * source_size end as target from l, f),
q as (select *, floor(target + 0.5e0)::bigint as quota from t),
p as (select *, case when source_size > 0 then quota // source_size else 0 end as passes from q),
r as (select *, quota - passes * source_size as rest from p)
select doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, rest - (sum(size) over (partition by d.source order by draw, doc_id, size
          rows between unbounded preceding and current row) - size))))::bigint as taken
from d join r on d.source is not distinct from r.source
"""
