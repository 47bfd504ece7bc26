"""What the corpus operators share: the shared folder, written tables, batches for Python and text conventions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HOT = 10_000  # a key with more than one row in so many is met by broadcast: there are at most HOT of them

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_root[0]


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and survives lost executors. Deleted when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(table_: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in table_.inputFiles()}:
        files, place = _place(table_.sparkSession, path)
        files.delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While it lasts, jobs send few rows at once to Python, as texts may be long; then the caller's setting is back."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a job's shuffle files go as soon as it ends: steps that hand on written tables don't read them again. Then the caller's setting is back."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 2_000_000, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and about `size` bytes in the column; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        room = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        upto = max(at + 1, min(at + rows, room))
        yield batch.slice(at, upto - at)
        at = upto


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows left join keyed, which has one row per key and, in `count`, how many of the `total` rows have the key.

    Keys that more than one row in HOT has, at most HOT of them, are broadcast, so that none of them fills a task; the others
    meet by a shuffle.
    """
    least = max(1000, total // HOT)
    few, many = keyed.where(F.col(count) > least), keyed.where(F.col(count) <= least)
    hot = F.broadcast(few.select(key))
    with_few = rows.join(F.broadcast(few), key)
    return with_few.unionByName(rows.join(hot, key, "left_anti").join(many, key, "left"))


def without_white(text: Column) -> Column:
    """The text with every white-space character deleted; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null: 0."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE)))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " +"))).cast("long")


def seeded_unit(seed: int, key: Column) -> Column:
    """A whole number below 2^32 that depends on seed and key alone, the same in any engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
