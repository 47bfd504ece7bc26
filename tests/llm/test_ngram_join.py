"""The n-gram join's number of tasks, the filter inside its blocks, and components that end at stars."""

import random

import numpy as np
import pyarrow as pa

from folionaut.llm import components as parts
from folionaut.llm import op12_ngram_join as join

PARTITIONS, TASKS = 16, 1450


def test_few_tasks_where_partitions_are_many(spark):
    """Each step costs as many tasks as there are shuffle partitions, however few its rows: two families of near copies whose leaders don't find all links."""
    rng = random.Random(5)
    rows = []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(200)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for i in range(40)]
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "test")
        got = {r.doc_id: r.component_id for r in join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.sparkContext.setJobGroup("tests", "test")
        for k, v in before.items():
            spark.conf.set(k, v)
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i, _ in rows}
    for a in shingles:
        for b in shingles:
            if a < b and label[a] != label[b] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    assert got == label
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert 0 < tasks < TASKS, tasks


def block(sets, percent):
    """What one block of sets, each a component, names."""
    n = len(sets)
    numbers = {x: [0] * n for x in ("h", "i", "j", "pos", "cls")} | {"c": [-1] * n, "side": [2] * n, "node": list(range(n)), "component": list(range(n)), "n": [len(s) for s in sets]}
    columns = {k: pa.array(v, pa.int64()) for k, v in numbers.items()} | {"minor": pa.array([True] * n), "bits": pa.array([join.parity_bits(s).tobytes() for s in sets])}
    return {(a, b) for out in join._candidates(percent, 1000)(iter([pa.RecordBatch.from_pydict(columns)])) for a, b in zip(*(c.to_pylist() for c in out.columns)) if a >= 0}


def test_short_bitmaps_in_a_block_leave_long_ones_whole():
    """A block names just what the bitmaps of each pair leave over, whoever else is in it, and no pair that is similar goes."""
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    sets = [draw(30), draw(40)]
    for n in (60, 100, 900, 1000, 1030):
        base = draw(n)
        sets += [base, np.unique(np.concatenate([base[n // 50 :], draw(n // 50)])), np.unique(np.concatenate([base[n // 2 :], draw(n // 2)])), draw(n)]
    named, expected = block(sets, 80), set()
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[a + 1 :], a + 1):
            p, q = join.parity_bits(x), join.parity_bits(y)
            words = min(len(p), len(q))
            far = np.bitwise_count(join.folded(p, words) ^ join.folded(q, words)).sum()
            if not join.out_of_reach(len(x), 0, len(y), 0, 80) and not join.too_far(far, len(x), len(y), 80):
                expected.add((a, b))
            both = len(np.intersect1d(x, y))
            assert (a, b) in named or 100 * both < 80 * (len(x) + len(y) - both)
    assert named == expected


def test_components_that_end_at_stars(spark, monkeypatch):
    """Paths, rings, stars around their largest node and random links, given with repeats and in both directions; pairs that are stars already take one round."""
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100 + (i + 1) % 17) for i in range(17)] + [(999, i) for i in range(200, 260)] + [(1500, 1500)]
    links += [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(150)]
    links += links[:20] + [(b, a) for a, b in links[20:40]]
    root = {i: i for pair in links for i in pair}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {i: low if c == high else c for i, c in root.items()}
    frame = lambda rows: parts.written(spark, spark.createDataFrame(rows, "a long, b long"), "test-links")
    got = {r.node: r.component for r in parts.components(frame(links), tidy=True).collect()}
    assert got == {i: c for i, c in root.items() if i != 1500}
    stars = frame([(i, 5) for i in range(6, 30)])
    rounds, keep = [], parts.written
    monkeypatch.setattr(parts, "written", lambda *a: rounds.append(a[2]) or keep(*a))
    assert {r.node: r.component for r in parts.components(stars, tidy=True).collect()} == {i: 5 for i in range(5, 30)}
    assert len(rounds) == 1 and stars.count() == 24
    assert parts.components(frame([]), tidy=True).count() == 0
