"""The pipeline stage by stage against brute force on the smallest table."""

import hashlib
import random

from pyspark.sql import functions as F
from test_operators import docs as table_of
from test_operators import exact_brute, near_brute, words

import corpus_pipeline
from folionaut.llm.op2_mix import SEED
from folionaut.llm.op10_toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert len(stages) == 5 and len(set(names)) == 5
    rows = {r.doc_id: r.text for r in docs.collect()}

    def apply(k, df):
        out = stages[k](spark, df, SF)
        out = spark.createDataFrame(out.collect(), out.schema)
        assert k == 4 or out.columns == docs.columns
        return out

    toxic = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    left = apply(0, docs)
    ids = sorted(rows.keys() - toxic)
    assert sorted(r.doc_id for r in left.collect()) == ids
    kept = exact_brute([rows[i] for i in ids])
    ids = [i for k, i in enumerate(ids) if kept[k][0] == k]
    left = apply(1, left)
    assert sorted(r.doc_id for r in left.collect()) == ids
    near = near_brute([rows[i] for i in ids], 5, 80)
    ids = [i for k, i in enumerate(ids) if near[k][1] == k]
    left = apply(2, left)
    assert sorted(r.doc_id for r in left.collect()) == ids
    left = apply(3, left)
    mixed = {r.doc_id: r.text for r in left.collect()}
    size = lambda x: sum(len((t or "").split()) for t in x.values())
    before = {i: rows[i] for i in ids}
    assert set(mixed) <= set(ids) and 0.7 * size(before) < size(mixed) < size(before)
    last = apply(4, left).collect()
    assert {r.doc_id for r in last} == set(mixed) and all(r.round_trip for r in last)


def mix_brute(rows):
    """Ids that stay of (doc_id, text, source), with the targets' level found by bisection."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total = {s: sum(size[i] for i, _, own in rows if own == s) for s in names}
    low, high = 0.0, float(sum(total.values()))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 3 * total[s]) for s in names) < sum(total.values()) else (low, level)
    kept = set()
    for s in names:
        left = int(min(high * weight[s], 3 * total[s]) + 0.5)
        for i in sorted((i for i, _, own in rows if own == s), key=lambda i: (hashlib.md5(f"{SEED}:{i}".encode()).hexdigest()[:8], i)):
            if left > 0 or size[i] == 0:
                kept.add(i)
            left -= size[i]
    return kept


def test_mix_stage_drops_only_what_is_over_target(spark):
    rng = random.Random(12)

    def kept(texts, sources):
        df = table_of(spark, texts, sources)
        return sorted(r.doc_id for r in corpus_pipeline.mix_stage(spark, df, SF).collect())

    ids = list(range(60))
    assert kept([words(rng, 10) for _ in ids], ["one"] * 60) == ids
    assert kept([words(rng, 10) for _ in ids], ["a"] * 10 + ["b"] * 20 + ["c"] * 30) == ids
    for names in (["a", "b", "c", None], ["a", "a", "a", "a", "b", "c", "d"], ["a"] + ["b"] * 30):
        texts = [None, "", *(words(rng, rng.choice([1, 3, 50, 400])) for _ in range(300))]
        sources = [rng.choice(names) for _ in texts]
        want = mix_brute(list(zip(range(len(texts)), texts, sources)))
        assert kept(texts, sources) == sorted(want) and len(want) < len(texts)


def test_repeated_ids(spark):
    """Of a repeated row one stays; of one doc_id's two texts only the copy goes."""
    rng = random.Random(13)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    near = a + " " + words(rng, 1)
    texts, ids = [a, b, b, b, a, c, d, d, e, e, near, None, None], [1, 2, 2, 2, 3, 3, 4, 5, None, None, 6, 7, 7]
    df = table_of(spark, texts, [f"s{i}" for i in range(len(ids))], ids).repartition(5)
    exact = corpus_pipeline.exact_stage(spark, df, SF)
    rows = exact.collect()
    key = lambda r: (str(r[0]), str(r[1]))
    want = [(1, a), (2, b), (3, c), (4, d), (None, e), (6, near), (7, None)]
    assert sorted([(r.doc_id, r.text) for r in rows], key=key) == sorted(want, key=key)
    assert exact.columns == df.columns and {r.source for r in rows if r.doc_id == 2} == {"s1"}
    for given in (df, spark.createDataFrame(rows, exact.schema)):
        got = corpus_pipeline.near_stage(spark, given, SF).collect()
        # Texts of no words are copies of nothing; a longer copy with a later id goes.
        assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted([w for w in want if w[0] != 6], key=key)


def test_columns_of_any_kind_where_ids_repeat(spark):
    """A map can't be compared, and the other names are those that stages use inside: all are passed on."""
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = {"col1": F.lit("z"), "tags": F.create_map(F.lit("a"), F.col("doc_id").cast("string")), "row_key": F.lit(1), "row": F.lit(2), "row_digest": F.lit(3), "kept": F.lit(True)}
    d = d.withColumns(extra)
    d = d.unionByName(d.where("doc_id % 3 = 0")).unionByName(d.where("doc_id % 5 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        out = stage(spark, d, SF)
        rows = out.collect()
        assert out.columns == d.columns and all(r.tags is not None and r.col1 == "z" and r.row == 2 for r in rows)
        assert {r.doc_id for r in rows if r.doc_id is not None} <= {r.doc_id for r in d.collect()} and len(rows) < d.count()
