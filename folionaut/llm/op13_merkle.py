"""A Merkle manifest of a table of documents: a tree of digests per source, one over the sources, and a proof for every document.

A document's leaf is the digest of its fields. The leaves of a source ascend by doc_id; every 16 consecutive nodes have one parent, up to a single
node, the source's subroot. The subroots, in the order of their sources, carry a tree of the same kind, up to the root.

Places are counted in ranges of the sorted leaves, so one source may hold any share of the rows; levels are grouped sums of at most 16 digests.
Proofs are octopus multiproofs: the leaves are cut into leaf partitions (4,096 consecutive leaves of one source), each of which computes the least
set of node coordinates (level, index) that its leaves' proofs need and that can't be derived from the leaves themselves, fetches those once, derives all nodes in
between, and expands each document's proof on its own. A proof holds the other nodes of each run, level by level, left to right.

Tampering, to test the proofs: documents whose crc32(doc_id) is divisible by 5 show their text with A-Z lower-cased. Each shown document is folded up to a
root with the siblings of its proof; it is verified if that is the root of the manifest.

Nulls count as `-` in a leaf. A null source is a source of its own, ahead of the others; null doc_ids come first in their source and are never tampered with.
Rows that repeat a doc_id are leaves of their own, ordered by digest. Empty and long texts are hashed whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, partitions, table, written
from .components import union_all

RUN = 16  # nodes that share a parent
DEPTH = 3  # levels inside a leaf partition
PART = RUN**DEPTH
PATH = "array<struct<at int, others array<string>>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256))


def lowered(text: Column) -> Column:
    """A-Z lower-cased; for texts of bytes below 128 that is all that lower() does."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the task's number and their place among the task's rows of one key."""
    pid, last, upto = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").dictionary_encode(null_encoding="encode")
        codes = keys.indices.to_numpy()
        starts = np.concatenate([[0], np.nonzero(np.diff(codes))[0] + 1])
        lengths = np.diff(np.concatenate([starts, [len(codes)]]))
        before = np.zeros(len(starts), dtype=np.int64)
        first = keys.dictionary[codes[0]].as_py()
        if last == (first,):
            before[0] = upto
        place = np.arange(len(codes)) - np.repeat(starts - before, lengths)
        last, upto = (keys.dictionary[codes[-1]].as_py(),), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), pid, dtype=np.int32)), pa.array(place)], [*batch.schema.names, "pid", "place"])


def counted(items: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(items with pid and place, per key and pid: how many rows of the key stand in earlier tasks, and its rows in all), by sorted ranges of key and order."""
    spark = items.sparkSession
    by = [F.asc_nulls_first(c) for c in ("key", *order)]
    schema = T.StructType([*items.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("place", T.LongType())])
    rows = written(spark, items.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(_count_off, schema), "places")
    parts = rows.groupBy("key", "pid").agg(F.count("*").alias("rows"))
    key = Window.partitionBy("key")
    before = F.sum("rows").over(key.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    return rows, parts.select("key", "pid", before.alias("before"), F.sum("rows").over(key).alias("width"))


def levels(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: tree, level, idx, digest above the leaves; roots: tree, digest) of leaves tree, idx, width, digest."""
    spark = leaves.sparkSession
    tallest = leaves.agg(F.max("width")).first()[0] or 0
    level, now, nodes, roots = 0, leaves.select("tree", "idx", "width", "digest"), [], []
    while True:
        roots.append(now.where("width = 1").select("tree", "digest"))
        if tallest <= 1:
            break
        tallest, level = -(-tallest // RUN), level + 1
        own = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        joined = F.array_join(F.transform(own, lambda x: F.lower(F.hex(x["digest"]))), "")
        up = now.where("width > 1").groupBy("tree", F.expr(f"idx div {RUN}").alias("idx"), F.ceil(F.col("width") / RUN).alias("width"))
        now = written(spark, up.agg(F.unhex(F.sha2(joined, 256)).alias("digest")), "nodes")
        nodes.append(now.select("tree", F.lit(level).alias("level"), "idx", "digest"))
    none = spark.createDataFrame([], "tree long, level int, idx long, digest binary")
    return union_all([none, *nodes]), union_all(roots)


def octopus(have: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(level, indexes) of the fewest nodes that, with the leaves at the sorted places `have`, give all their proofs in a tree of `width` leaves."""
    out, level = [], 0
    while width > 1:
        parents = np.unique(have // RUN)
        needed = (parents[:, None] * RUN + np.arange(RUN)).ravel()
        out.append((level, np.setdiff1d(needed[needed < width], have, assume_unique=True)))
        have, width, level = parents, -(-width // RUN), level + 1
    return out


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tree, part, width in zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "width"))):
            missing = octopus(np.arange(part * PART, min(width, (part + 1) * PART)), width)
            level, idx = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in ([np.full(len(i), n) for n, i in missing], [i for _, i in missing]))
            same = lambda x: pa.array(np.full(len(idx), x, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([same(tree), same(part), pa.array(level.astype(np.int32)), pa.array(idx.astype(np.int64))], ["tree", "part", "level", "idx"])


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Proofs:
    """The proofs of one leaf partition: its leaves (places from `first` on, digests as hex), the width of the tree and what was fetched."""

    def __init__(self, first: int, leaves: list[str], width: int, fetched: dict[tuple[int, int], str]):
        self.runs: list[dict[int, list[str]]] = []  # per level: the digests of each run that holds own nodes
        own = dict(enumerate(leaves, first))
        level = 0
        while width > 1:
            runs = {}
            for run in sorted({i // RUN for i in own}):
                runs[run] = [own[i] if i in own else fetched[level, i] for i in range(run * RUN, min(width, (run + 1) * RUN))]
            self.runs.append(runs)
            own = {run: _hash("".join(digests)) for run, digests in runs.items()}
            width, level = -(-width // RUN), level + 1
        self.top = own.get(0)

    def path(self, place: int) -> list[tuple[int, list[str]]]:
        """Per level: the node's place in its run, and the run's digests."""
        out = []
        for runs in self.runs:
            out.append((place % RUN, runs[place // RUN]))
            place //= RUN
        return out


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    for at, digests in path:
        digest = _hash("".join((*digests[:at], digest, *digests[at + 1 :])))
    return digest


def _fetched(row: dict) -> dict[tuple[int, int], str]:
    return {(x["level"], x["idx"]): x["digest"].hex() for x in row["fetched"] or []}


def _paths(key: tuple, leaves: pa.Table, extra: pa.Table) -> pa.Table:
    """The path of every leaf, as rows: for the tree of the sources."""
    leaves = leaves.sort_by("idx")
    row = extra.to_pylist()[0]
    idx = leaves.column("idx").to_pylist()
    proofs = Proofs(idx[0], [d.hex() for d in leaves.column("digest").to_pylist()], row["width"], _fetched(row))
    paths = [[{"at": at, "others": [*digests[:at], *digests[at + 1 :]]} for at, digests in proofs.path(i)] for i in idx]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
    return pa.table({"idx": pa.array(idx, pa.int64()), "path": pa.array(paths, kind), "root": pa.array([proofs.top] * len(idx), pa.string())})


def _verify(key: tuple, leaves: pa.Table, extra: pa.Table) -> pa.Table:
    """Every document of a leaf partition with its proof's digest and what its shown form folds to."""
    leaves = leaves.sort_by("idx")
    row = extra.to_pylist()[0]
    idx, digests, shown = (leaves.column(c).to_pylist() for c in ("idx", "digest", "shown"))
    hexed = [d.hex() for d in digests]
    proofs = Proofs(idx[0], hexed, row["width"], _fetched(row))
    above = [(x["at"], [*x["others"][: x["at"]], "", *x["others"][x["at"] :]]) for x in row["path"]]
    siblings = lambda at, run: "".join((*run[:at], *run[at + 1 :]))
    proved, folded = [], []
    upper = "".join(siblings(at, run) for at, run in above)
    shared: dict[int, str] = {}  # what the leaves of one run have in common
    for i, own, other in zip(idx, hexed, shown):
        path = proofs.path(i)
        if i // RUN not in shared:
            shared[i // RUN] = "".join(siblings(at, run) for at, run in path[1:]) + upper
        proved.append(_hash((siblings(*path[0]) if path else "") + shared[i // RUN]))
        folded.append(fold(own if other is None else other.hex(), path + above))
    same = lambda x: pa.array([x] * len(idx), pa.string())
    out = {"doc_id": leaves.column("doc_id"), "leaf": pa.array(hexed, pa.string()), "subroot": same(proofs.top), "root": same(row["root"]), "proof_sha256": pa.array(proved, pa.string()), "folded_root": pa.array(folded, pa.string())}
    return pa.table(out | {"verified": pa.array([f == row["root"] for f in folded], pa.bool_())})


def expanded(leaves: DataFrame, nodes: DataFrame, expand, schema: str, **more: DataFrame) -> DataFrame:
    """expand on every leaf partition of leaves (tree, idx, width, digest, ...) with the nodes it asks for and, by tree, the columns of more."""
    placed = leaves.withColumn("part", F.expr(f"idx div {PART}"))
    asking = placed.groupBy("tree", "part").agg(F.max("width").alias("width"))
    requests = asking.mapInArrow(_requests, "tree long, part long, level int, idx long")
    found = requests.join(nodes, ["tree", "level", "idx"]).groupBy("tree", "part").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched"))
    extra = asking.join(found, ["tree", "part"], "left")
    for df in more.values():
        extra = extra.join(df, "tree")
    extra = written(leaves.sparkSession, extra, "fetched")
    return placed.groupBy("tree", "part").cogroup(extra.groupBy("tree", "part")).applyInArrow(expand, schema)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("key"), leaf_digest(F.col("text")).alias("digest"), F.when(tampered, leaf_digest(lowered(F.col("text")))).alias("shown"))
    rows, parts = counted(written(spark, leaves, "leaves"), "doc_id", "digest")
    parts = written(spark, parts, "parts")
    # The sources' own places; a source is a tree, named by its place.
    sources, across = counted(parts.groupBy("key").agg(F.max("width").alias("own_width")).select(F.lit(0).alias("key"), F.col("key").alias("source"), "own_width"), "source")
    sources = sources.join(across, ["key", "pid"]).select("source", (F.col("before") + F.col("place")).alias("tree"), F.col("width").alias("sources"))
    sources = written(spark, sources, "sources")
    named = parts.join(sources, F.col("key").eqNullSafe(F.col("source"))).select(F.col("key").alias("of"), F.col("pid").alias("of_pid"), "before", "width", "tree")
    placed = rows.join(named, F.col("key").eqNullSafe(F.col("of")) & (F.col("pid") == F.col("of_pid")))
    placed = written(spark, placed.select("tree", (F.col("before") + F.col("place")).alias("idx"), "width", "doc_id", "digest", "shown"), "placed")
    nodes, subroots = levels(placed)
    top = subroots.join(sources, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("sources").alias("width"), "digest")
    top = written(spark, top, "subroots")
    paths = expanded(top, levels(top)[0], _paths, f"idx long, path {PATH}, root string")
    paths = written(spark, paths.withColumnRenamed("idx", "tree"), "paths")
    return expanded(placed, nodes, _verify, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", paths=paths)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive crc_table as (select list_transform(range(256), lambda n: list_reduce([n::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as tab),
src as (select *, lower_az(text) as low from (select doc_id, source, lang, n_chars, text from documents)),
d as materialized (select doc_id, source, row_number() over (partition by source order by doc_id nulls first) - 1 as idx, count(*) over (partition by source) as width, dense_rank() over (order by source nulls first) - 1 as tree,
  xor(list_reduce([4294967295::ubigint] || list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::ubigint), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint) % 5 = 0 as tampered,
  FIELD(doc_id) || FIELD(source) || FIELD(lang) || FIELD(n_chars) as head, text, low from src, crc_table),
leaf as materialized (select tree, idx, width, doc_id, sha256(head || FIELD(text)) as leaf, sha256(head || case when tampered then FIELD(low) else FIELD(text) end) as shown from d),
n as (select tree, 0 as level, idx, width, leaf as h from leaf
  union all select tree, level + 1, idx // 16, (width + 15) // 16, sha256(string_agg(h, '' order by idx)) from n where width > 1 group by tree, level, idx // 16, width),
top as (select tree as idx, count(*) over () as width, h from n where width = 1),
u as (select 0 as level, idx, width, h from top union all select level + 1, idx // 16, (width + 15) // 16, sha256(string_agg(h, '' order by idx)) from u where width > 1 group by level, idx // 16, width),
nodes as materialized (select tree, level, idx, width, h from n), tops as materialized (select level, idx, width, h from u),
runs as materialized (select a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx < a.idx), '') as pre, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx > a.idx), '') as post
  from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.idx // 16 = b.idx // 16 where a.width > 1 group by 1, 2, 3),
truns as materialized (select a.level, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx < a.idx), '') as pre, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx > a.idx), '') as post
  from tops a join tops b on a.level = b.level and a.idx // 16 = b.idx // 16 where a.width > 1 group by 1, 2),
step0 as (select l.tree, l.idx, r.level as seq, pre, post from leaf l join runs r on r.tree = l.tree and r.idx = l.idx // (16 ** r.level)::bigint
  union all select l.tree, l.idx, 100 + r.level, pre, post from leaf l join truns r on r.idx = l.tree // (16 ** r.level)::bigint),
step as materialized (select *, row_number() over (partition by tree, idx order by seq) as k, count(*) over (partition by tree, idx) as steps from step0),
fold as (select tree, idx, 0 as k, shown as h from leaf union all select s.tree, s.idx, s.k, sha256(s.pre || f.h || s.post) from fold f join step s on s.tree = f.tree and s.idx = f.idx and s.k = f.k + 1),
proof as (select tree, idx, sha256(string_agg(pre || post, '' order by k)) as proof_sha256 from step group by 1, 2),
out as (select l.doc_id, l.leaf, s.h as subroot, t.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root from leaf l join nodes s on s.tree = l.tree and s.width = 1 join tops t on t.width = 1
  left join proof p on p.tree = l.tree and p.idx = l.idx join (select tree, idx, arg_max(h, k) as h from fold group by 1, 2) f on f.tree = l.tree and f.idx = l.idx)
select *, folded_root = root as verified from out
"""
ORACLE = re.sub(r"FIELD\((\w+)\)", r"(case when \1 is null then '-' else strlen(\1::varchar) || ':' || \1::varchar end)", ORACLE).replace("lower_az(text)", f"translate(text, '{UPPER}', '{UPPER.lower()}')")
