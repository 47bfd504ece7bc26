"""Vector codes by product quantisation, with Drake's and Hamerly's adaptive distance bounds.

Vectors become integers floor(1024 x) and are cut into 4 equal consecutive parts. Each part position has a codebook of 256 entries, which starts as that part of
the 256 smallest vec_ids' vectors. In each of 4 rounds every part goes to its codebook's nearest entry (squared distance; ties to the lower index), then each entry moves to
the floor of its parts' mean; a last assignment gives the codes. All of it is whole-number arithmetic, so the result doesn't depend on partitions.

Each part keeps its b closest entries in ascending order, a lower bound for the distance of each of them but the first, and one outer bound for all other entries. When entries move,
bounds shrink by the moves; a part whose distance to its own entry stays below all bounds keeps it. Otherwise only the entries whose bounds don't exceed that distance are measured again, and all
256 only if the outer bound fails. b adapts after each round to what `ENOUGH` of the parts needed. Distances are doubles with an error bound; where two entries
lie closer than that, integers decide. The state of all parts is a written table for each round, the one before is deleted.

The driver holds the codebooks alone: 256 entries. Sums of the entries' parts leave a task as at most 1,024 rows.

Rows whose vector is null or holds null or non-finite components are dropped. Null vec_ids come last in the order of vec_ids; equal vec_ids are ordered by their vectors. All vectors
should have the length of the first one in that order: others are cut to it, or filled with zeros at the end, as is a length that four doesn't divide. Fewer than 256 rows give so many entries.
Integers beyond +-2^27 (components beyond 131,072; less above 64 dimensions) are cut to that, so that errors stay whole numbers of 64 bits; a label's error beyond that is null. NaN labels are one
label, null labels another. Empty tables, and tables whose rows are all dropped, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_counted, table, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CLOSEST = 32  # entries that a part keeps at first
LEAST = 4  # and at least
ENOUGH = 0.95
_CELLS = 1 << 21  # distances that are held at once


def _limit(width: int) -> int:
    """Integers up to this have distances whose sums over all components fit 62 bits."""
    return 1 << min(27, (62 - max(1, PARTS * width - 1).bit_length()) // 2 - 1)


def whole_numbers(column: pa.Array, length: int, width: int) -> np.ndarray:
    """floor(1024 x) of a list column's vectors as an int64 matrix of 4 x width columns, cut to the limit."""
    out = np.zeros((len(column), PARTS * width), dtype=np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
    lengths = np.diff(np.concatenate([[0], ends]))
    limit = _limit(width)
    flat = np.clip(np.floor(np.clip(flat, -limit, limit) * SCALE), -limit, limit).astype(np.int64)
    if len(column) and (lengths == length).all():
        out[:, :length] = flat.reshape(len(column), length)
    else:
        for i, (end, n) in enumerate(zip(ends, lengths)):
            own = flat[end - n : end][:length]
            out[i, : len(own)] = own
    return out


def exact_nearest(x: np.ndarray, entries: np.ndarray, ids: np.ndarray, about: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Per row of x the nearest of the entries ids (a row of indexes each), given distances that are off by `error` at most."""
    best = about.min(axis=1)
    maybe = about <= (best + 2 * error)[:, None]
    out = ids[np.arange(len(ids)), about.argmin(axis=1)]
    open_ = np.nonzero(maybe.sum(axis=1) > 1)[0]
    if len(open_):
        at, column = np.nonzero(maybe[open_])
        rows, entry = open_[at], ids[open_[at], column]
        gap = x[rows] - entries[entry]
        order = np.lexsort((entry, (gap * gap).sum(axis=1), rows))
        rows, entry = rows[order], entry[order]
        first = np.concatenate([[True], rows[1:] != rows[:-1]])
        out[rows[first]] = entry[first]
    return out


def _down(x: np.ndarray) -> np.ndarray:
    """Floats of 32 bits that don't exceed x."""
    return np.nextafter(np.maximum(x, 0).astype(np.float32), np.float32(-1)).clip(0)


def measured(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the b closest entries with the nearest first, lower bounds of their distances, outer bound) by distances to all entries."""
    n, k = len(x), len(entries)
    ids, low, outer = np.zeros((n, b), dtype=np.int16), np.zeros((n, b), dtype=np.float32), np.zeros(n, dtype=np.float32)
    c = entries.astype(np.float64)
    norms, every = (c * c).sum(axis=1), np.arange(k)
    for at in range(0, n, max(1, _CELLS // k)):
        own = x[at : at + max(1, _CELLS // k)]
        f = own.astype(np.float64)
        own_norms = (f * f).sum(axis=1)
        about = own_norms[:, None] - 2 * (f @ c.T) + norms
        error = (own_norms + norms.max(initial=0)) * (2.0**-50 * (x.shape[1] + 4))
        nearest = exact_nearest(own, entries, np.broadcast_to(every, about.shape), about, error)
        about[np.arange(len(own)), nearest] = -np.inf  # the nearest stands first, whatever the rounding
        order = np.argsort(about, axis=1, kind="stable")[:, : b + 1] if k <= 2 * b else None
        if order is None:
            order = np.argpartition(about, b, axis=1)[:, : b + 1]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(about, order, axis=1), axis=1, kind="stable"), axis=1)
        bounds = _down(np.sqrt(np.maximum(np.take_along_axis(about, order, axis=1) - error[:, None], 0)))
        m = min(b, order.shape[1])
        ids[at : at + len(own), :m], low[at : at + len(own), :m] = order[:, :m], bounds[:, :m]
        if m < b:  # fewer entries than places: nothing else exists
            low[at : at + len(own), m:] = np.inf
        outer[at : at + len(own)] = bounds[:, b] if order.shape[1] > b else np.inf
    return ids, low, outer


def moved(x: np.ndarray, entries: np.ndarray, moves: np.ndarray, ids: np.ndarray, low: np.ndarray, outer: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The state after entries moved by `moves`: (ids, low, outer, how many of its bounds each part needed; all of them and one more: all entries were measured)."""
    held = ids.shape[1]
    low = np.maximum(low - moves[ids] * (1 + 1e-6), 0)
    outer = np.maximum(outer - moves.max(initial=0) * (1 + 1e-6), 0)
    # Ordered: a bound is also one of all entries behind it.
    low = np.minimum.accumulate(np.concatenate([low, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    gap = x - entries[ids[:, 0]]
    now = np.sqrt((gap.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    need = (low[:, 1:] <= now[:, None]).sum(axis=1)  # bounds that don't exceed the distance: the first `need` ones
    ids, low, outer = ids.copy(), _down(low[:, :held]), _down(low[:, held])
    width = 1
    while width < held:  # some of the bounds fail: those entries are measured, in classes of doubling size
        least, width = width, min(2 * width, held)
        rows = np.nonzero((need >= least) & (need < width))[0]
        for part in np.array_split(rows, max(1, -(-len(rows) * width * x.shape[1] // _CELLS))):
            if not len(part):
                continue
            some = ids[part, :width].astype(np.int64)
            diff = (x[part][:, None, :] - entries[some]).astype(np.float64)
            about = (diff * diff).sum(axis=2)
            error = about.max(axis=1) * (2.0**-52 * (x.shape[1] + 4))
            nearest = exact_nearest(x[part], entries, some, about, error)
            bounds = np.sqrt(np.maximum(about - error[:, None], 0))
            about[some == nearest[:, None]] = -np.inf
            order = np.argsort(about, axis=1, kind="stable")
            ids[part, :width] = np.take_along_axis(some, order, axis=1)
            low[part, :width] = _down(np.take_along_axis(bounds, order, axis=1))
    rest = np.nonzero(need >= held)[0]
    ids, low, outer = _resized(ids, low, outer, b)
    if len(rest):
        ids[rest], low[rest], outer[rest] = measured(x[rest], entries, b)
    return ids, low, outer, np.minimum(need, held)


def _resized(ids: np.ndarray, low: np.ndarray, outer: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """With b places: entries that go are covered by the outer bound."""
    if ids.shape[1] > b:
        outer = np.minimum(outer, low[:, b:].min(axis=1))
    return ids[:, :b], low[:, :b], outer


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(np.ascontiguousarray(x).ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_STATE = "vec_id {id}, label_key string, numbers array<bigint>, ids array<smallint>, low array<float>, outer array<float>, need array<smallint>"
_NAMES = ["vec_id", "label_key", "numbers", "ids", "low", "outer", "need"]


def _state(batch: pa.RecordBatch, numbers: np.ndarray, parts: list[tuple]) -> pa.RecordBatch:
    ids, low, outer, need = (np.concatenate([p[i] if p[i].ndim == 2 else p[i][:, None] for p in parts], axis=1) for i in range(4))
    arrays = [numbers, ids.astype(np.int16), low.astype(np.float32), outer.astype(np.float32), need.astype(np.int16)]
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), *map(_rows, arrays)], _NAMES)


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _CELLS // (8 * PARTS * max(1, width)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _first(length: int, codebooks: np.ndarray, b: int):
    width = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, width):
                x = whole_numbers(batch.column("embedding"), length, width)
                parts = [(*measured(x[:, p * width : (p + 1) * width], codebooks[p], b), np.full(len(x), b)) for p in range(PARTS)]
                yield _state(batch, x, parts)

    return run


def _next(codebooks: np.ndarray, moves: np.ndarray, b: int):
    width = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, width):
                x, ids, low, outer = (_matrix(batch.column(c)) for c in ("numbers", "ids", "low", "outer"))
                x = x if width else np.zeros((batch.num_rows, 0), dtype=np.int64)
                held = ids.shape[1] // PARTS
                own = lambda m, p, n: m[:, p * n : (p + 1) * n]
                parts = [moved(own(x, p, width), codebooks[p], moves[p], own(ids, p, held), own(low, p, held), outer[:, p], b) for p in range(PARTS)]
                yield _state(batch, x, parts)

    return run


def _sums(width: int, k: int):
    """Per task: sums and counts of the parts at each entry, and how many parts needed how many bounds (entry: minus that number, less one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, needs = np.zeros((PARTS, k, width), dtype=np.int64), np.zeros((PARTS, k), dtype=np.int64), np.zeros(k + 2, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, need = (_matrix(batch.column(c)) for c in ("numbers", "ids", "need"))
            held = ids.shape[1] // PARTS
            needs += np.bincount(need.ravel(), minlength=k + 2)[: k + 2]
            for p in range(PARTS):
                entry = ids[:, p * held].astype(np.int64)
                counts[p] += np.bincount(entry, minlength=k)
                if width:
                    np.add.at(sums[p], entry, x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(counts)
        used = np.nonzero(needs)[0]
        rows = np.concatenate([sums[part, entry], np.zeros((len(used), width), dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([part, np.zeros(len(used), dtype=np.int64)]).astype(np.int32)), pa.array(np.concatenate([entry, -1 - used]).astype(np.int32)),
            pa.array(np.concatenate([counts[part, entry], needs[used]])), _rows(rows)], ["part", "entry", "rows", "sums"])

    return run


def _moved_entries(state: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codebooks after their parts' means, counts of bounds needed). The driver gets at most 1,024 rows and one for each number of bounds."""
    k, width = codebooks.shape[1:]
    partial = state.select("numbers", "ids", "need").mapInArrow(_sums(width, k), "part int, entry int, rows bigint, sums array<bigint>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    out, needs = codebooks.copy(), np.zeros(k + 2, dtype=np.int64)
    for r in partial.groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *totals).collect():
        if r.entry < 0:
            needs[-1 - r.entry] = r.rows
        else:
            out[r.part, r.entry] = [r[f"s{i}"] // r.rows for i in range(width)]
    return out, needs


def _coded(width: int, codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column("numbers")), _matrix(batch.column("ids"))
            held = ids.shape[1] // PARTS
            codes = ids[:, ::held].astype(np.int64)
            error = np.zeros(len(ids), dtype=np.int64)
            for p in range(PARTS if width else 0):
                gap = x[:, p * width : (p + 1) * width] - codebooks[p][codes[:, p]]
                error += (gap * gap).sum(axis=1)
            text = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), text, pa.array(error)], ["vec_id", "label_key", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, closest: int = CLOSEST) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    kept = vectors.where(F.col("embedding").isNotNull() & ~bad).select("vec_id", "embedding", label.alias("label_key"))
    least = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    if not least:
        return spark.createDataFrame([], f"vec_id {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    length = len(least[0].embedding)
    width = -(-length // PARTS)
    first = whole_numbers(pa.array([r.embedding for r in least], pa.list_(pa.float64())), length, width)
    codebooks = np.ascontiguousarray(first.reshape(len(least), PARTS, width).transpose(1, 0, 2))
    b = max(1, min(closest, len(least)))
    schema = _STATE.format(id=kind)
    state = written(spark, kept.mapInArrow(_first(length, codebooks, b), schema), "codes")
    for done in range(ROUNDS):
        after, needs = _moved_entries(state, codebooks)
        moves = np.sqrt(((after - codebooks).astype(np.float64) ** 2).sum(axis=2))
        codebooks, before = after, state
        # b: what sufficed for most parts of the round before; the first round has measured all entries and says nothing.
        if done and needs[: b + 1].sum():
            b = max(min(LEAST, b), min(b, 1 + int(np.searchsorted(np.cumsum(needs[: b + 1]), ENOUGH * needs[: b + 1].sum()))))
        state = written(spark, before.mapInArrow(_next(codebooks, moves, b), schema), "codes")
        discard(before)
    coded = written(spark, state.mapInArrow(_coded(width, codebooks), f"vec_id {kind}, label_key string, code string, error bigint"), "coded")
    sums = written(spark, coded.groupBy("label_key").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("rows")), "labels")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    out = join_counted(coded, sums, "label_key", "rows", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    assign = "select v.vec_id, v.p, arg_min(c.e, (v.nn + c.nn - 2 * list_dot_product(v.v, c.v), c.e)) as e from v join c{r} c using (p) group by 1, 2"
    means = """select p, e, coalesce(m.v, c.v) as v, list_dot_product(coalesce(m.v, c.v), coalesce(m.v, c.v)) as nn from c{r} c left join (
      select p, e, list(((s - ((s % n) + n) % n) // n)::double order by i) as v from (select p, e, i, sum(x)::bigint as s, count(*) as n from (
        select a.p, a.e, unnest(range(1, len(v.v) + 1)) as i, unnest(v.v)::bigint as x from a{r} a join v using (vec_id, p)) group by 1, 2, 3) group by 1, 2) m using (p, e)"""
    tables = [
        "k as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true))",
        "v as materialized (select vec_id, p, v, list_dot_product(v, v) as nn from (select vec_id, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] as v from k cross join range(4) z(p)))",
        f"c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, v, nn from v where vec_id in (select vec_id from k order by vec_id limit {ENTRIES}))",
    ]
    for r in range(ROUNDS):
        tables += [f"a{r} as materialized ({assign.format(r=r)})", f"c{r + 1} as materialized ({means.format(r=r)})"]
    tables += [
        f"a{ROUNDS} as materialized ({assign.format(r=ROUNDS)})",
        f"done as materialized (select vec_id, lower(string_agg(printf('%02x', e), '' order by p)) as code, sum(v.nn + c.nn - 2 * list_dot_product(v.v, c.v))::bigint as error from a{ROUNDS} join v using (vec_id, p) join c{ROUNDS} c using (p, e) group by 1)",
        f"digest as (select sha256(string_agg(array_to_string(list_transform(v, lambda x: x::bigint::varchar), ','), ',' order by p, e)) as codebooks_sha256 from c{ROUNDS})",
    ]
    return "with " + ",\n".join(tables) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from done join k using (vec_id) cross join digest"


ORACLE = _oracle()
