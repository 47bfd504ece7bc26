"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is a 64-bit hash of it without white space. A directory over the low bits of the key
names the bucket of every key; it starts with one bucket, and while a bucket holds more distinct keys than its
capacity the bucket splits by one more bit, doubling the directory when the bucket's local depth has reached
the global one. The driver only sees key counts of at most 2^max_depth cells, so the directory (at most
2^max_depth small integers) has a proven size. Beyond 2^max_depth x capacity keys buckets hold more than their capacity; an owner
still holds one key at a time.

Each task first folds equal texts of its own input, so a text that fills a third of the table reaches its
owner as one entry per task. Texts travel only where their key may occur more than once (by a bitmap of 2^20 cells of keys,
a bound on what is broadcast; a cell that is full for another reason only means a text that travels in vain). Owner tasks each take the keys of some buckets, sort them, chain entries
whose keys collide and compare whole texts byte by byte; a chain position is a class of equal texts. The
index (key, chain position, keeper, group size, digest of the class) is written to shared files. A document finds its class by its key; where a key has
a chain of several classes, the document's text is compared with theirs. No digest decides anything.

Null counts as empty. Of equal texts the row with the most code points in the original, then the smallest
doc_id, stays; a null doc_id counts as larger than any, and is itself what stays (keep_id null) where nothing else does. kept says whether doc_id is
keep_id, so rows that repeat a doc_id in one group are kept or dropped together. They count as rows of the group. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, partitions, small_batches, table, without_white, written

ENTRY = "bucket int, key long, n_cp long, doc_id long, n long, body binary"
SLOT = "bucket int, key long, chain int, chains int, keep_id long, group_size long, body binary"
CELLS = 1 << 20
_ENTRY = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("n_cp", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_SLOT = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("chains", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("body", pa.binary())])


def grow_directory(cells: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket number of every directory entry, from counts of keys by their low bits (a power of two of cells).

    The directory has as many entries as its global depth asks for; entry i serves keys whose low bits are i.
    """
    top = int(np.log2(len(cells)))
    depth, directory = 0, [0]
    local, prefix = [0], [0]  # of each bucket: depth, low bits
    todo = [0]
    while todo:
        b = todo.pop()
        held = int(cells[prefix[b] :: 1 << local[b]].sum())
        if held <= capacity or local[b] == top:
            continue
        if local[b] == depth:
            directory, depth = directory + directory, depth + 1
        new = len(local)
        local[b] += 1
        local.append(local[b])
        prefix.append(prefix[b] | 1 << (local[b] - 1))
        for i in range(prefix[new], len(directory), 1 << local[new]):
            directory[i] = new
        todo += [b, new]
    return np.array(directory, dtype=np.int32)


def _rank(n_cp: int, doc: int | None) -> tuple:
    """Of equal texts, the row with the least rank stays."""
    return -n_cp, doc is None, doc or 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _fold(directory: np.ndarray):
    mask = len(directory) - 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}  # of each key and text (None: the key occurs once): rank, n_cp, doc_id, rows
        held = 0

        def out() -> pa.RecordBatch:
            return _batch([(int(directory[k & mask]), k, v[1], v[2], v[3], body) for (k, body), v in seen.items()], _ENTRY)

        for batch in batches:
            for doc, n_cp, key, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_cp", "key", "body"))):
                rank = _rank(n_cp, doc)
                if (v := seen.get((key, body))) is None:
                    seen[key, body] = [rank, n_cp, doc, 1]
                    held += 200 + len(body or b"")
                else:
                    v[3] += 1
                    if rank < v[0]:
                        v[:3] = rank, n_cp, doc
            if held > 64_000_000:  # a task's memory stays bounded; what is folded twice meets at the owner
                yield out()
                seen.clear()
                held = 0
        if seen:
            yield out()

    return fold


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the entries of each key; they arrive sorted by key, so one key's chain is held at a time."""
    last: int | None = None
    chain: list[list] = []  # bucket, text, rank, doc_id, rows

    def out() -> list[tuple]:
        several = len(chain) > 1
        return [(b, last, i, len(chain), doc, n, body if several else None) for i, (b, body, _, doc, n) in enumerate(chain)]

    for batch in batches:
        rows: list[tuple] = []
        for b, key, n_cp, doc, n, body in zip(*(batch.column(c).to_pylist() for c in _ENTRY.names)):
            if key != last:
                rows += out()
                last, chain = key, []
            rank = _rank(n_cp, doc)
            for slot in chain:
                if slot[1] == body:
                    slot[4] += n
                    if rank < slot[2]:
                        slot[2:4] = rank, doc
                    break
            else:
                chain.append([b, body, rank, doc, n])
        if rows:
            yield _batch(rows, _SLOT)
    if chain:
        yield _batch(out(), _SLOT)


def build_index(docs: DataFrame, capacity: int = 512, max_depth: int = 20, key_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with key, digest and text, the same written without text, index); docs needs doc_id and text. key_bits below 64 forces collisions, for tests."""
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"),
        F.encode(without_white(F.col("text")), "UTF-8").alias("body"),
    )
    key = F.xxhash64("body") if key_bits == 64 else F.xxhash64("body").bitwiseAND(F.lit((1 << key_bits) - 1))
    rows = base.select("doc_id", "n_cp", key.alias("key"), "body")
    keyed = written(spark, rows.select("doc_id", "n_cp", "key", F.sha2("body", 256).alias("sha")), "exact-keys")

    counted = written(spark, keyed.groupBy("key").count(), "exact-counts")
    n_keys = counted.count()
    depth = min(max_depth, max(4, int(np.ceil(np.log2(max(1, n_keys) / capacity + 1))) + 4))
    cells = np.zeros(1 << depth, dtype=np.int64)
    low = F.col("key").bitwiseAND(F.lit((1 << depth) - 1))
    for i, n in counted.groupBy(low.alias("cell")).count().collect():  # at most 2^max_depth counts
        cells[i] = n
    directory = grow_directory(cells, capacity)

    cell = F.pmod(F.hash("key"), F.lit(CELLS)).alias("cell")
    repeated = counted.where("count > 1").select(cell).distinct().withColumn("travels", F.lit(True))
    sent = rows.withColumn("cell", cell).join(F.broadcast(repeated), "cell", "left")  # at most CELLS rows
    sent = sent.select("doc_id", "n_cp", "key", F.when(F.col("travels"), F.col("body")).alias("body"))
    owned = sent.mapInArrow(_fold(directory), ENTRY).repartition(max(partitions(spark), 1), "bucket").sortWithinPartitions("bucket", "key")
    with small_batches(spark):
        return rows, keyed, written(spark, owned.mapInArrow(_own, SLOT), "exact-index")


def exact_dedup(docs: DataFrame, capacity: int = 512, max_depth: int = 20, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, key, chain."""
    rows, keyed, index = build_index(docs, capacity, max_depth, key_bits)
    plain = index.where("chains = 1").select("key", "chain", "keep_id", "group_size")
    found = join_counted(keyed, plain, "key", "group_size", keyed.count())
    columns = ["doc_id", "keep_id", "group_size", "text_sha256", "key", "chain"]
    out = found.where("chain is not null").withColumnRenamed("sha", "text_sha256").select(*columns)
    collided = index.where("chains > 1").select("key", "body", "chain", "keep_id", "group_size")
    if collided.limit(1).count():  # of a key with several texts, each document compares its own with them
        met = rows.join(collided, ["key", "body"]).withColumn("text_sha256", F.sha2("body", 256))
        out = out.unionByName(met.select(*columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "key", "chain")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("key", "chain")


ORACLE = r"""
with d as (select doc_id, length(coalesce(text, '')) as n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents)
select doc_id,
       first_value(doc_id) over (partition by body order by n desc, doc_id) as keep_id,
       count(*) over (partition by body) as group_size,
       doc_id = first_value(doc_id) over (partition by body order by n desc, doc_id) as kept,
       sha256(body) as text_sha256
from d
"""
