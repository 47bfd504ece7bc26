"""A corpus from raw documents to token ids, in stages that each keep or drop whole documents.

Every stage takes all rows that the one before kept, as a written table. The stages before the last return the
columns of `documents`; the last returns the token ids of the documents that are left.

Rows are judged, not doc_ids: a row's key is a digest of its doc_id and text. Where doc_ids repeat or are null, the two dedup stages
keep one row of each doc_id and text, and of one doc_id's several texts only the copies go. A null text counts as empty; texts of no
words are copies of each other in the exact stage, are linked with nothing in the next and cost the mix nothing. A null source is a
source of its own. Empty tables give empty results. Extra columns are passed on up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folionaut.llm.common import table, word_count, written
from folionaut.llm.op2_mix import mix
from folionaut.llm.op4_sentencepiece import encode
from folionaut.llm.op6_exact import exact_dedup
from folionaut.llm.op9_neardup import near_duplicates
from folionaut.llm.op10_toxicity import without_toxic


def _without(spark: SparkSession, docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without those that judge (doc_id, kept) drops. Where doc_ids repeat or are null, one row of each doc_id and text is judged."""
    ids = docs.groupBy("doc_id").count()
    if not ids.where("doc_id is null or count > 1").limit(1).count():
        dropped = judge(docs).where("not kept").select("doc_id").distinct()
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    # Keys of their own stand for the doc_ids, in the order of doc_id; written, as they depend on the partitions.
    # Of rows that differ in other columns only, one stays: the first by their JSON, as columns of any kind have one.
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text")
    once = rows.groupBy(F.col("row.doc_id").alias("row_id"), F.sha2(text, 256).alias("row_digest")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    sorted_ = once.orderBy(F.asc_nulls_last("row_id"), "row_digest").withColumn("row_key", F.monotonically_increasing_id())
    keyed = written(spark, sorted_, "row-keys")
    dropped = judge(keyed.select(F.col("row_key").alias("doc_id"), text.alias("text"))).where("not kept").select(F.col("doc_id").alias("row_key"))
    return keyed.join(dropped.distinct(), "row_key", "left_anti").select("row.*")


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(spark, docs, exact_dedup)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(spark, docs, lambda rows: near_duplicates(rows, k=5, threshold=0.8))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Sizes and row keys are taken from the texts once; the mix reads only them.
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    sizes = written(spark, docs.select("doc_id", "source", key.alias("text"), word_count(F.col("text")).alias("size")), "sizes")
    # Each document at most once: sources at or below their target stay whole. A document of no words costs nothing and stays.
    mixed = mix(sizes, F.array("source"), size=F.col("size"), share=1.0, cap=3.0, repeats=1)
    dropped = mixed.where("mix_taken = 0 and mix_size > 0").select(F.col("text").alias("row_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), key.alias("row_key"))
    return rows.join(written(spark, dropped, "dropped"), "row_key", "left_anti").select("row.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("exact dedup", exact_stage),
    ("near-duplicates", near_stage),
    ("source mix", mix_stage),
    ("sentencepiece", encode_stage),
]
#: SQL can't express the learned lexicon or the piece ids; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
