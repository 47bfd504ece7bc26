"""Near-duplicates by SetSketch registers.

A document is the set of its distinct word shingles. Register i of its sketch is floor(1 - log_b x_i), cut to
0..q+1, where x_i is the least of exponential values (rate a) that hash i gives the shingles: registers of a union are
the maxima of the parts', and two sets agree in a register with a probability of about their similarity. Equal sets are folded into one
first. Bands of registers bring similar sets into a bucket.

A bucket is walked in the order of its members, and each is paired with the first one only; the members of a bucket that a sample
shows to be large are walked in parts, and the parts' first members are paired. The joint likelihood of
the registers, with the known sizes, estimates the similarity of a pair; pairs that can't reach the threshold go, and the rest are
confirmed on full sets. After components are formed, members of a bucket that lie in different ones are compared with each other,
by registers first, then on full sets, in blocks that give back only links which join components. So no group is expanded into rows of
all its pairs.

What may be lost: every link given is confirmed on full sets, but a pair is only looked at if its registers bring it up. Rows and bands are chosen
so that a pair right at the threshold shares no bucket with a probability below 1e-5; more similar pairs are missed more rarely. A pair that shares one goes
if its likelihood over 128 registers is more than six deviations below the threshold, or if fewer registers agree than that less 0.15: less
than one in a million pairs at the threshold. See README for the recall measured.

Null and empty texts have no shingles and are linked with nothing. A row whose doc_id is null can't be named, so it is linked with nothing either:
its component_id is null and it is kept. Rows that repeat a doc_id count as one document
when components are formed: all their texts link it. Texts are taken whole, equal texts are linked as equal sets. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, partitions, small_batches, table, written
from .components import components, union_all

#: The sketch's base, rate and largest register.
B, A, Q = 1.001, 20.0, 65534
BANDS = 40
KEPT = 128  # registers that are kept for estimates
BLOCK = 1024  # members of a bucket that stand on either side of a comparison
CELLS = 1 << 20  # hash cells of documents whose texts are needed
PARTS = 64  # parts in which a large bucket is walked
SALTS = 16  # copies of a bucket's row that its members meet
NEAR = 1000  # pairs of one set that meet one copy of it
_TEXTS = 500_000

_rng = np.random.default_rng(0x5E75)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SEED = _rng.integers(0, 2**32, 4096, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, 4096, dtype=np.uint32) | np.uint32(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_C = np.uint64(0xD6E8FEB86659FD93)
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def rows_per_band(threshold: float, bands: int = BANDS, miss: float = 1e-5) -> int:
    """The most registers in a band with which a pair at the threshold is missed more rarely than `miss`."""
    r = 1
    while (1 - threshold ** (r + 1)) ** bands <= miss:
        r += 1
    return r


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _C
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)


_known_powers: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, at least n + 1 of each; kept, and made anew only for a longer text."""
    if not _known_powers or len(_known_powers[0]) <= n:
        one, size = np.ones(1, dtype=np.uint64), 1 << n.bit_length()
        with np.errstate(over="ignore"):
            _known_powers[:] = [np.concatenate([one, np.cumprod(np.full(size, p, dtype=np.uint64), dtype=np.uint64)]) for p in (_P, _PINV)]
    return _known_powers[0], _known_powers[1]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # lower() of bytes changes A-Z alone
    i = 0
    while i < len(raw):
        j, held = i, 0
        while j < len(raw) and (j == i or held + len(raw[j]) < _TEXTS):
            held += len(raw[j]) + 1
            j += 1
        out += _sets(raw[i:j], k)
        i = j
    return out


def _sets(raw: list[bytes], k: int) -> list[np.ndarray]:
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    white = _WS[buf]
    edge = np.diff(np.concatenate([[1], white.view(np.int8)]))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    up, down = _powers(len(buf))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)])
        words = _mixed((sums[ends] - sums[starts]) * down[starts])
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
        rolled = words
        for s in range(1, k):
            rolled = rolled[: len(words) - s] * _C + words[s:] if len(words) > s else words[:0]
        rolled = _mixed(rolled)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                h = words[a : a + 1]
                for w in words[a + 1 : b]:
                    h = h * _C + w
                out.append(_mixed(h + np.uint64(b - a)))
            else:
                out.append(words[:0])
    return out


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets, one row each."""
    if not sets:
        return np.zeros((0, m), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), m), dtype=np.float64)
    for i in range(m):
        out[:, i] = np.minimum.reduceat((x ^ _SEED[i]) * _ODD[i], starts)
    least = -np.log1p(-(out + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(least) / np.log(B)), 0, Q + 1).astype(np.uint16)


def likely(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sets of sizes n and m at which their registers are likeliest (steps of 1/100)."""
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    same = left.shape[1] - more - less
    u = (n / (n + m))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u / v, v / u))
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12, 1)
    up, down = p(u - v * j), p(v - u * j)
    log = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), log.argmax(axis=1)]


def _cut(threshold: float, kept: int = KEPT) -> float:
    """Estimates below this are six deviations off the threshold."""
    return threshold - 6 * (threshold * (1 - threshold) / kept) ** 0.5 - 0.01


def sketches(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, n, key (digest of the set), bands (hashes of register bands), regs; bands and regs null for empty sets."""
    r = rows_per_band(threshold)
    m = max(KEPT, r * BANDS)
    salt = _rng_bands(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            regs = registers([sets[i] for i in full], m)
            with np.errstate(over="ignore"):
                bands = _mixed((regs[:, : r * BANDS].astype(np.uint64) * salt).reshape(len(full), BANDS, r).sum(axis=2, dtype=np.uint64)).view(np.int64)
            out_bands: list = [None] * len(sets)
            out_regs: list = [None] * len(sets)
            for at, i in enumerate(full):
                out_bands[i], out_regs[i] = bands[at], regs[at, :KEPT].tobytes()
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(out_bands, pa.list_(pa.int64())), pa.array(out_regs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "key", "bands", "regs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, regs binary")


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@cache
def _rng_bands(r: int) -> np.ndarray:
    return np.random.default_rng(r).integers(1, 2**63, BANDS * r, dtype=np.uint64) | np.uint64(1)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the first member and the others of each bucket, or part (not -1) of one; rows come sorted by bucket, part and node.

    The first member of a part is also paired with itself, so that parts can be joined.
    """
    last, first = (None, None), None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, part, node = (batch.column(c).to_numpy() for c in ("h", "part", "node"))
        fresh = np.concatenate([[(h[0], part[0]) != last], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), -1))
        lead = np.where(at >= 0, node[np.maximum(at, 0)], first if first is not None else 0)
        last, first = (h[-1], part[-1]), lead[-1]
        shown = (lead != node) | fresh & (part >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[shown]) for x in (h, lead, node)], ["h", "a", "b"])


def _estimated(cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, KEPT) for c in ("regs_a", "regs_b"))
                good = likely(left, right, *(batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))) >= cut
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _sets_of(k: int):
    """The shingle set of each row's text, if it is the one with the row's digest: a doc_id may come with several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            right = pa.array([_digest(s) == key for s, key in zip(sets, batch.column("key").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"]).filter(right)

    return run


def _confirmed(percent: int):
    """Links among pairs with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _by_block(compare):
    """Runs compare on the rows of each block, which come sorted by block; side 0 is compared with side 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            for key, own in pdf.groupby(["h", "i", "j"], sort=False):
                if last is not None and key != last:
                    yield compare(pd.concat(held))
                    held = []
                last = key
                held.append(own)
        if held:
            yield compare(pd.concat(held))

    return run


def _promising(cut: float):
    """The rows of a block whose registers say that a member of another component may be similar."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(pdf.regs), dtype=np.uint16).reshape(len(pdf), KEPT)
        comp, n, side = pdf.component.to_numpy(), pdf.n.to_numpy(np.float64), pdf.side.to_numpy()
        right = np.nonzero(side == 1)[0]
        good = np.zeros(len(pdf), dtype=bool)
        for x in np.nonzero(side == 0)[0]:
            other = right[(comp[right] != comp[x]) & (np.minimum(n[right], n[x]) >= cut * np.maximum(n[right], n[x]))]
            # A cheap test ahead of the likelihood: registers of similar sets are mostly equal.
            same = (regs[other] == regs[x]).mean(axis=1)
            other = other[np.argsort(-same, kind="stable")][: int((same >= cut - 0.15).sum())]
            # Members that are marked already matter only until x is; the likeliest are asked first.
            fresh = other[~good[other]]
            for own in (fresh, *(other[good[other]][at : at + 64] for at in range(0, len(other), 64))):
                if len(own) and (own is fresh or not good[x]):
                    yes = own[likely(np.broadcast_to(regs[x], (len(own), KEPT)), regs[own], np.full(len(own), n[x]), n[own]) >= cut]
                    good[yes] = True
                    good[x] |= len(yes) > 0
        return pdf.loc[good, ["h", "i", "j", "side", "node", "component", "minor"]]

    return compare


def _joining(percent: int):
    """Links between the components of a block, on full sets; only those that join what the block hasn't joined yet."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        none = pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
        if not len(left) or not len(right):
            return none
        sets = [np.frombuffer(s, dtype=np.uint64) for s in right.shingles]
        sizes = np.array([len(s) for s in sets])
        # Postings: for every shingle the members of side 1 that hold it.
        shingles = np.concatenate(sets)
        order = np.argsort(shingles, kind="stable")
        holders, shingles = np.repeat(np.arange(len(sets)), sizes)[order], shingles[order]
        node, comp, minor = right.node.to_numpy(), right.component.to_numpy(), right.minor.to_numpy()
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        found = []
        for x, own, mine in zip(left.node, left.component, (np.frombuffer(s, dtype=np.uint64) for s in left.shingles)):
            lo, hi = np.searchsorted(shingles, mine, "left"), np.searchsorted(shingles, mine, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(holders[at], minlength=len(sets))
            near = 100 * both >= percent * (sizes + len(mine) - both)
            for y in np.nonzero(near & (comp != own) & ~(minor & (node < x)))[0]:
                p, q = root(int(own)), root(int(comp[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((int(x), int(node[y])))
        return pd.DataFrame(found, columns=["a", "b"]) if found else none

    return compare


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, k, threshold)


def _near_duplicates(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    n = partitions(spark)
    percent, cut = round(100 * threshold), _cut(threshold)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = written(spark, sketches(own, k, threshold), "sketches")
    named = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    full = sketch.where(named)
    # A node is a distinct set; it stands for its smallest doc_id.
    first = written(spark, full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "keys")
    nodes = full.select("doc_id", "n", "key", "bands", "regs").join(first.select("key", "doc_id"), ["key", "doc_id"]).dropDuplicates(["key", "doc_id"])
    nodes = written(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "sets")  # written: the numbers stay
    n_nodes = nodes.count()
    sizes = nodes.select("node", "n", "regs")

    # Buckets that are large in a sample of some 50,000 nodes, so at most some 20,000 of them, are walked in parts.
    banded = nodes.select(F.explode("bands").alias("h"), "node")
    drawn = F.pmod(F.xxhash64("node"), F.lit(max(1, n_nodes // 50_000))) == 0
    large = banded.where(drawn).groupBy("h").count().where("count >= 100").select("h", F.lit(True).alias("large"))
    parted = banded.join(F.broadcast(large), "h", "left").select("h", F.when(F.col("large"), F.pmod(F.xxhash64("node", F.lit(7)), F.lit(PARTS))).otherwise(F.lit(-1)).cast("int").alias("part"), "node")
    walked = parted.repartition(n, "h", "part").sortWithinPartitions("h", "part", "node").mapInArrow(_walk, "h long, a long, b long")
    walked = written(spark, walked, "walked")
    leads = walked.where("a = b")
    tops = leads.groupBy("h").agg(F.min("a").alias("top"))
    stars = walked.where("a <> b").unionByName(leads.join(tops, "h").where("a <> top").select("h", F.col("top").alias("a"), F.col("a").alias("b")))
    stars = written(spark, stars, "stars")
    n_stars = stars.count()
    # What is joined to the first members: some of them stand in very many pairs.
    often = written(spark, stars.groupBy("a").agg(F.count("*").alias("pairs")), "leads")

    def on_a(pairs: DataFrame, info: DataFrame) -> DataFrame:
        """pairs with info's row (node, ...) of their a."""
        keyed = often.join(info.withColumnRenamed("node", "a"), "a")
        return join_counted(pairs, keyed, "a", "pairs", n_stars).drop("pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        """node, shingles of the given nodes. Most other texts go before the shuffle, by the hash cells that the nodes' documents are in.

        There are at most 2^20 cells, so they can be broadcast; with very many nodes they are all full and nothing goes.
        """
        wanted = written(spark, nodes.join(ids.select("node").distinct(), "node").select("node", "doc_id", "key"), "wanted")
        cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell")
        near = own.withColumn("cell", cell).join(F.broadcast(wanted.select(cell).distinct()), "cell", "left_semi")
        texts = near.select("doc_id", "text").join(wanted, "doc_id").select("node", "key", "text")
        return written(spark, texts.mapInArrow(_sets_of(k), "node long, shingles binary").dropDuplicates(["node"]), "shingles")

    pairs = stars.select("a", "b").distinct()
    sized = on_a(pairs, sizes.select("node", F.col("n").alias("n_a"), F.col("regs").alias("regs_a")))
    sized = sized.join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "b")
    sized = sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    likely_ = written(spark, sized.mapInArrow(_estimated(cut), "a long, b long"), "candidates")
    sets = sets_of(likely_.select(F.explode(F.array("a", "b")).alias("node")))
    # A set that stands in very many pairs meets them in copies, each with its share of the others.
    copies = often.select("a", F.ceil(F.col("pairs") / NEAR).cast("int").alias("copies"))
    met = on_a(likely_, copies.withColumnRenamed("a", "node")).withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    spread = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("a", "copy")
    left = spread.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b").join(left, ["a", "copy"])
    links = written(spark, met.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")
    # Several texts of one doc_id are linked by it.
    several = full.groupBy("doc_id").agg(F.min("key").alias("one"), F.max("key").alias("other")).where("one <> other").select("doc_id")
    if several.limit(1).count():
        of = full.join(several, "doc_id").select("doc_id", "key").distinct().join(nodes.select("key", "node"), "key")
        links = links.unionByName(of.join(of.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    found = components(links)

    # Buckets that still hold more than one component: their members are compared with each other.
    label = lambda c: found.select("node", F.col("component").alias(f"of_{c}"))
    known = on_a(stars, label("a")).join(label("b").withColumnRenamed("node", "b"), "b", "left")
    known = known.select("h", "a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
    known = written(spark, known, "buckets")

    def on_bucket(rows: DataFrame, of: str, buckets: DataFrame) -> DataFrame:
        """rows with their bucket's row, of which there are SALTS copies, so that a large bucket's rows are spread."""
        many = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")).join(many, ["h", "salt"]).drop("salt")

    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("of_a").alias("component")), F.struct(F.col("b").alias("node"), F.col("of_b").alias("component"))))
    open_ = known.groupBy("h").agg(F.max(F.col("of_a") != F.col("of_b")).alias("open"), F.count("*").alias("others")).where("open and others > 1").select("h")
    members = on_bucket(known, "b", open_).select("h", both.alias("m")).select("h", "m.*").distinct()
    members = written(spark, members, "members")
    # Of two members in different components, one at least lies outside the bucket's largest: only those are compared with all.
    held = members.groupBy("h", "component").agg(F.count("*").alias("size"))
    held = held.groupBy("h").agg(F.sum("size").alias("total"), F.max("size").alias("most"), F.max_by("component", F.struct("size", "component")).alias("largest"))
    held = held.select("h", "largest", F.ceil(F.col("total") / BLOCK).cast("int").alias("across"), F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("down"))
    rows = on_bucket(members, "node", held).withColumn("minor", F.col("component") != F.col("largest"))
    draw = F.xxhash64("node")
    row, column = F.pmod(draw, F.col("down")).cast("int"), F.pmod(draw, F.col("across")).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    places = F.transform(upto("down"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), column.alias("j")))
    asking = F.transform(upto("across"), lambda j: F.struct(F.lit(0).alias("side"), row.alias("i"), j.alias("j")))
    rows = rows.withColumn("places", F.when(F.col("minor"), F.concat(places, asking)).otherwise(places))
    rows = rows.join(sizes, "node").select("h", "node", "component", "minor", "n", "regs", F.explode("places").alias("p")).select("h", "p.*", "node", "component", "minor", "n", "regs")
    # By registers first: only members that may have a partner in the block need their sets.
    sorted_ = lambda df: df.repartition(n, "h", "i", "j").sortWithinPartitions("h", "i", "j")
    asked = written(spark, sorted_(rows).mapInPandas(_by_block(_promising(cut)), "h long, i int, j int, side int, node long, component long, minor boolean"), "members")
    more = sorted_(asked.join(sets_of(asked), "node")).mapInPandas(_by_block(_joining(percent)), "a long, b long").distinct()
    more = written(spark, more, "confirmed")
    if more.limit(1).count():
        found = components(union_all([links, more]))

    # A component is named by its smallest doc_id.
    inside = found.join(nodes.select("node", "key", "doc_id"), "node").select("key", "doc_id", "component")
    names = inside.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("nodes"))
    of_key = join_counted(inside.select("key", "component"), names, "component", "nodes", n_nodes).select("key", "component_id")
    of_key = first.join(of_key, "key", "left").select("key", "rows", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = join_counted(full.select("doc_id", "n", "key"), of_key, "key", "rows", full.count()).select("doc_id", "n", "component_id")
    alone = sketch.where(~named).select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    out = out.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
i as (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) as i from w where len(ws) > 0),
s as materialized (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[i:i+2], ' ') end as g from i),
n as materialized (select doc_id, count(*) as n from s group by 1),
p as materialized (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
e as materialized (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.node where r.c < e.b)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.c) as component_id, d.doc_id = min(r.c) as kept from documents d left join n using (doc_id) join r on r.node = d.doc_id group by d.doc_id
"""
