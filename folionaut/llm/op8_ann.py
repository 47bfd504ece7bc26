"""Nearest neighbours by a block matrix join on int8 tiles.

Equal vectors are one candidate first, with their k + 1 smallest vec_ids (no other of them can be among the k nearest). Vectors are
scaled by a power of two and to int8, and packed into tiles, one row per tile: int8 values, scales and the norms of what rounding kept and
took away; no float vector is in a tile. Query tiles meet groups of candidate tiles by
an equi-join on the group's number, so neither side is broadcast or gathered whole. For each pair of tiles one product
of the int8 parts (exact in float32 up to 1,024 dimensions; larger ones use float64) gives approximate inner products, and the norms
bound their error by Cauchy-Schwarz. A task keeps, over the tiles that it meets, each query's k-th best lower bound (of the 64 query tiles met last, so what it
holds doesn't grow with the queries); a pair whose upper bound doesn't reach it goes. What survives in all tasks is cut once more at each query's k-th best lower bound of all,
and only then are float vectors fetched: each block of queries gets every vector that it needs once. Scores are recomputed in float64 on the original vectors, component after
component, and heaps keep the k best of every query, merged by query.

The result is exact: bounds only drop pairs that can't be among the k nearest. A pair whose product may leave the range of
doubles has no bound and is always recomputed, so a table full of such vectors costs as much as comparing all floats. Scores follow
the rules of floats (infinities tie; NaN counts as largest, as in SQL). Vectors that are null, zero,
empty or hold a null or non-finite component take no part, nor do rows whose vec_id is null; vectors of different lengths are never compared. Ties go
to the smaller vec_id; rows that repeat a vec_id are candidates each by itself (up to k equal ones), but never for that vec_id's own
query, and a repeated query row is answered once. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, table, written

TILE = "dim int, tile long, n int, rows binary, own binary, q binary, measures binary"
FOUND = "query long, row long, low double, high double"
_TILE = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("n", pa.int32()), ("rows", pa.binary()), ("own", pa.binary()), ("q", pa.binary()), ("measures", pa.binary())])
_FOUND = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
_BEST = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_RANKED = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
NONE = np.iinfo(np.int64).min  # in `own`: the row stands for several vec_ids
_KEPT = 2_000_000  # pairs that a task holds before it cuts them at its floors
_FLOATS = 1 << 22  # doubles of candidates that a group of the recomputation may hold, all its pairs counted
_ASKED = 64  # query tiles that a task holds
_COLUMNS = 1024  # candidates that are compared with a query tile at once
_ROWS = 4  # pairs of tiles sent to Python at once
_SAFE = 900  # exponents within which products neither overflow nor lose their bounds


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 values, and per row: exponent, scale of the values, norm of what they keep, of what they miss, and of the scaled row."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    half = exponent // 2  # in two steps: one power of two alone may be out of range
    y = np.ldexp(np.ldexp(x, -half[:, None]), -(exponent - half)[:, None])
    scale = np.abs(y).max(axis=1) / 127.0
    q = np.rint(y / scale[:, None])
    kept = q * scale[:, None]
    norm = lambda v: np.sqrt((v**2).sum(axis=1))
    return q.astype(np.int8), np.stack([exponent.astype(np.float64), scale, norm(kept), norm(y - kept), norm(y)])


def _floats(values: pa.ListArray, rows: int) -> list[np.ndarray]:
    flat, ends = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(values.offsets.to_numpy())
    return np.split(flat, np.cumsum(ends)[:-1]) if rows else []


def _pack(size: int):
    """Tiles of at most `size` vectors of one length each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids, own = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
            q, measures = quantise(np.stack([r[2] for r in rows]))
            values = [dim, int(ids.min()), len(rows), ids.tobytes(), own.tobytes(), q.tobytes(), measures.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, _TILE)], schema=_TILE)

        for batch in batches:
            for row, own, vector in zip(batch.column("row").to_pylist(), batch.column("own").to_pylist(), _floats(batch.column("vector"), batch.num_rows)):
                held.setdefault(len(vector), []).append((row, own, vector))
                if len(held[len(vector)]) >= size:
                    yield out(len(vector))
        for dim in list(held):
            yield out(dim)

    return pack


class Tile:
    def __init__(self, dim: int, n: int, rows: bytes, own: bytes, q: bytes, measures: bytes):
        self.rows, self.own = np.frombuffer(rows, dtype=np.int64), np.frombuffer(own, dtype=np.int64)
        self.q = np.frombuffer(q, dtype=np.int8).reshape(n, dim).astype(np.float32 if dim <= 1024 else np.float64)
        self.exponent, self.scale, self.kept, self.lost, self.norm = np.frombuffer(measures).reshape(5, n)

    def part(self, start: int, stop: int) -> Tile:
        """Rows start to stop, as views."""
        out = Tile.__new__(Tile)
        for name, values in vars(self).items():
            setattr(out, name, values[start:stop])
        return out


def bounds(x: Tile, y: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product of each pair, in units of the query's own power of two; infinite where it can't be bounded."""
    near = (x.q @ y.q.T).astype(np.float64) * x.scale[:, None] * y.scale[None, :]
    # x.y = kept_x.kept_y + kept_x.lost_y + lost_x.y; the last term is for float64 rounding.
    rounding = (x.q.shape[1] + 16) * 2.0**-52
    error = (x.kept[:, None] * y.lost[None, :] + x.lost[:, None] * y.norm[None, :]) * (1 + 1e-9) + rounding * x.norm[:, None] * y.norm[None, :]
    unit = np.exp2(np.clip(y.exponent, -_SAFE, _SAFE))[None, :]
    both = x.exponent[:, None] + y.exponent[None, :]
    safe = (np.abs(both) < _SAFE) & (np.abs(y.exponent) < _SAFE)[None, :]
    return np.where(safe, (near - error) * unit, -np.inf), np.where(safe, (near + error) * unit, np.inf)


class Survivors:
    """Of one query tile: the k best lower bounds of each query so far, and the pairs that reach the least of them."""

    def __init__(self, tile: Tile, k: int):
        self.tile, self.k, self.lows, self.parts, self.held = tile, k, np.full((len(tile.rows), k), -np.inf), [], 0

    def add(self, other: Tile) -> None:
        for at in range(0, len(other.rows), _COLUMNS):
            self._add(other.part(at, at + _COLUMNS))

    def _add(self, other: Tile) -> None:
        low, high = bounds(self.tile, other)
        own = self.tile.own[:, None] == other.own[None, :]
        low[own] = -np.inf
        best = np.concatenate([self.lows, low], axis=1)
        self.lows = np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k :]
        q, c = np.nonzero((high >= self.lows.min(axis=1)[:, None]) & ~own)
        self.parts.append((q, other.rows[c], low[q, c], high[q, c]))
        self.held += len(q)

    def cut(self) -> tuple:
        q, row, low, high = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        good = high >= self.lows.min(axis=1)[q]
        self.parts = [(q[good], row[good], low[good], high[good])]
        self.held = int(good.sum())
        return self.parts[0]

    def batch(self) -> pa.RecordBatch:
        q, row, low, high = self.cut()
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (self.tile.rows[q], row, low, high)], schema=_FOUND)


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Survivors] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda *names: [batch.column(c)[i].as_py() for c in names]  # noqa: B023, E731
                (number,) = at("q_tile")
                if (mine := asked.pop(number, None)) is None:
                    if len(asked) >= _ASKED:  # the one that was met longest ago goes; its floors start anew, should it come again
                        gone = asked.pop(next(iter(asked)))
                        if gone.parts:
                            yield gone.batch()
                    mine = Survivors(Tile(*at("dim", "q_n", "q_rows", "q_own", "q_q", "q_measures")), k)
                asked[number] = mine
                mine.add(Tile(*at("dim", "n", "rows", "own", "q", "measures")))
                if sum(s.held for s in asked.values()) > _KEPT:
                    for s in asked.values():
                        if s.parts:
                            s.cut()
                    if sum(s.held for s in asked.values()) > _KEPT // 2:  # the floors go on, the pairs are passed on
                        yield from (s.batch() for s in asked.values() if s.held)
        yield from (s.batch() for s in asked.values() if s.parts)

    return search


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components, so that equal rows give equal bits wherever they stand."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


class Heaps:
    """The k best candidates of each query: larger score first (NaN above all), then smaller vec_id."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def push(self, query: tuple, score: float, vec_id: int) -> None:
        heap, entry = self.of.setdefault(query, []), (math.isnan(score), 0.0 if math.isnan(score) else score, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif heap[0] < entry:
            heapq.heapreplace(heap, entry)

    def rows(self) -> Iterator[tuple]:
        """(query, rank, vec_id, score)."""
        for query, heap in self.of.items():
            for rank, (odd, score, vec_id) in enumerate(sorted(heap, reverse=True), 1):
                yield query, rank, -vec_id, math.nan if odd else score


def _exact(k: int):
    """The k best of each query among a block's pairs; vectors of queries and candidates come in rows of their own."""

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {r: i for i, r in enumerate(right.column("row").to_pylist())}
        vectors, ids = _floats(right.column("vector").combine_chunks(), right.num_rows), right.column("ids").to_pylist()
        mine = {r: i for i, r in enumerate(left.column("query").to_pylist())} if left.num_rows else {}
        first, query_ids = _floats(left.column("q_vector").combine_chunks(), left.num_rows), left.column("query_id").to_pylist()
        heaps = Heaps(k)
        for query, rows in zip(left.column("query").to_pylist(), left.column("rows").to_pylist()):
            i = mine[query]
            own, found = query_ids[i], [at[r] for r in rows]
            x = np.stack([vectors[c] for c in found])
            for c, score in zip(found, inner(np.broadcast_to(first[i], x.shape), x).tolist()):
                for vec_id, copies in ids[c]:
                    for _ in range(copies if vec_id != own else 0):
                        heaps.push((own, query), score, vec_id)
        out = list(heaps.rows())
        return pa.Table.from_arrays([pa.array([v[0][0] for v in out], pa.int64()), pa.array([v[0][1] for v in out], pa.int64()), pa.array([v[2] for v in out], pa.int64()), pa.array([v[3] for v in out], pa.float64())], schema=_BEST)

    return exact


def _merge(k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for batch in batches:
            for query_id, query, vec_id, score in zip(*(batch.column(c).to_pylist() for c in _BEST.names)):
                heaps.push((query_id, query), score, vec_id)
        rows = [(query[0], rank, vec_id, score) for query, rank, vec_id, score in heaps.rows()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_RANKED)], schema=_RANKED)

    return merge


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = 512, block: int = 4096) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) to each row for which is_query holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    n = partitions(spark)
    v = F.col("vector")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable)

    # Equal vectors: copies of one vec_id are counted, then the smallest vec_ids stay; both are cut before they are shuffled.
    pairs = good.groupBy("vector", "vec_id").agg(F.count("*").alias("copies"), F.max("asks").alias("asks"))
    pairs = written(spark, pairs, "vectors")
    small = pairs.select("vector", "vec_id", F.least("copies", F.lit(k)).cast("int").alias("copies"))
    small = small.withColumn("k", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("k") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "copies"))).alias("ids")
    classes = small.groupBy("vector").agg(ids).withColumn("row", F.monotonically_increasing_id())
    classes = written(spark, classes, "candidates")  # written: the numbers stay
    asking = pairs.where("asks").select("vec_id", "vector").withColumn("row", F.monotonically_increasing_id())
    asking = written(spark, asking, "queries")
    have, ask = classes.count(), asking.count()
    # A grid of tasks: query tiles go to `across` groups of candidates, candidate tiles to `down` groups of queries;
    # with many more candidates than queries, queries travel more.
    across = min(n, max(1, round((n * max(1.0, have / max(1, ask))) ** 0.5)))
    down = max(1, n // across)

    def tiles(rows: DataFrame, own: Column, count: int, size: int) -> DataFrame:
        spread = rows.select("row", own.alias("own"), F.col("vector").cast("array<double>").alias("vector")).repartition(min(8 * n, max(1, -(-count // size))))
        return written(spark, spread.mapInArrow(_pack(size), TILE), "tiles")

    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    only = F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"]).otherwise(F.lit(int(NONE)))
    right = tiles(classes, only, have, min(block, max(256, -(-have // across))))
    right = right.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(across))).withColumn("side", each(down))
    left = tiles(asking, F.col("vec_id"), ask, query_block)
    left = left.select(F.col("dim").alias("q_dim"), *(F.col(c).alias(f"q_{c}") for c in ("tile", "n", "rows", "own", "q", "measures")), F.pmod(F.xxhash64("tile"), F.lit(down)).alias("q_side"))
    left = left.withColumn("q_part", each(across))
    met = left.join(right, (F.col("q_part") == F.col("part")) & (F.col("q_side") == F.col("side")) & (F.col("q_dim") == F.col("dim")))
    found = met.drop("q_dim", "q_part", "q_side", "part", "side", "tile").mapInArrow(_search(k), FOUND)
    with small_batches(spark, _ROWS):  # a row holds two tiles
        found = written(spark, found, "survivors")

    # Each query's floor over all tasks; then its surviving rows are one list, in groups of queries.
    floor = F.nth_value("low", k).over(Window.partitionBy("query").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = found.withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("query", "row")
    kept = written(spark, kept, "kept")
    groups = max(1, -(-ask // query_block))
    longest = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    kept = kept.withColumn("g", F.pmod(F.xxhash64("query"), F.lit(groups)))
    # A group with more pairs than its floats allow is cut by candidates.
    sizes = kept.groupBy("g").agg(F.ceil(F.count("*") * longest / _FLOATS).alias("parts"))
    kept = kept.join(sizes, "g").withColumn("p", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    wanted = kept.select(F.col("g").alias("of_g"), F.col("p").alias("of_p"), "row").distinct().join(classes.select("row", "ids", "vector"), "row")
    lists = kept.groupBy("g", "p", "query").agg(F.collect_list("row").alias("rows"))
    lists = lists.join(asking.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector")), "query")
    wanted = wanted.withColumn("ids", F.transform("ids", lambda x: F.array(x["vec_id"], x["copies"].cast("long"))))
    best = lists.groupBy("g", "p").cogroup(wanted.groupBy("of_g", "of_p")).applyInArrow(_exact(k), "query_id long, query long, vec_id long, score double")
    return best.repartition(n, "query_id", "query").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
with v as (select vec_id, embedding::double[] as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from p qualify rank <= 20
"""
