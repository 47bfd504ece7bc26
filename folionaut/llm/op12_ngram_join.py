"""Exact n-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of its distinct word shingles (64-bit hashes; equal sets are one node). Shingles have one order: those that are frequent in some stretch
of the documents come last, by count, all others by hash. Two sets of a similarity t or more share one of their first n - ceil(t n) + 1 shingles, their prefixes.

Nodes with identical prefixes and sizes are one group. Groups are posted under each shingle of their prefix, and the groups of a posting list are filtered in pairs: by size, and by the places of the shingle,
which bound what two sets can share from there on. Group pairs that are left are expanded to their members; a parity bitmap of each set (its Hamming distance never exceeds the
sets' symmetric difference) filters the pairs of members, and the rest are verified on full sets.

Components need no list of all pairs. First each group of a posting list is paired with one of about its size that leads the list, long lists being walked in parts, and each member of a group with the group's first. Then the lists
whose members still lie in different components are compared in blocks: every two members that aren't in one component, within reach of each other's size, pass the same filters, and the blocks name candidates, at
first a few forests of the components, closest bitmaps first, later more of them, until all of them have been verified or joined. So no link that joins components is lost, and no group is expanded to all its pairs.

All filters are exact, so the result is that of comparing all pairs (up to collisions of 64-bit hashes inside a pair). The list of frequent shingles (at most FREQUENT) only orders them.

Null and empty texts have no shingles and are linked with nothing. A row whose doc_id is null can't be named: it is linked with nothing and its component_id is null. Rows that repeat
a doc_id count as one document when components are formed. Texts are taken whole; equal texts are linked. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, discard, join_counted, partitions, shuffles_freed, slices, table, written
from .components import components, union_all
from .op9_neardup import shingle_sets

FREQUENT = 1 << 18  # shingles that are ordered by count; they are broadcast
OFTEN = 4  # sets of a stretch in which a shingle counts as frequent
STRETCH = 4_000_000  # shingles of a stretch
LONG = 2048  # members of a part of a long posting list
BLOCK = 1024  # members on either side of a comparison
CELLS = 1 << 20  # hash cells of documents whose texts are needed
NEAR = 1000  # pairs of one set that meet one copy of it
FEW = 16  # forests of candidates that a block names at first, and by which factor there are more of them in each further pass
MORE = 256


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (n * percent + 99) // 100 + 1


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of 1 to 2 bits for each shingle (a power of two, 64 at least), each bit the parity of the shingles that fall to it."""
    size = max(64, 1 << (len(shingles) - 1).bit_length())
    at = (shingles >> np.uint64(17)) & np.uint64(size - 1)
    odd = np.bincount(at.astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (or rows of them) of fewer words; parities of falling places add up."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def too_far(distance: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether a symmetric difference of at least `distance` rules out the similarity."""
    return (100 + percent) * distance > (100 - percent) * (n + m)


def out_of_reach(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose first common shingle stands at i and j are too small, or have too little left, to be similar."""
    least = percent * (n + m)
    return (100 * np.minimum(n, m) < percent * np.maximum(n, m)) | ((100 + percent) * np.minimum(n - i, m - j) < least)


def _first(k: int):
    """Each document's doc_id, set size and digest; and shingles that OFTEN sets of a stretch hold, with how many do (token, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *held]), return_counts=True)
            token, count = token[count >= OFTEN], count[count >= OFTEN]
            seen.clear()
            held.clear()
            none = lambda kind: pa.nulls(len(token), kind)
            return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], ["doc_id", "n", "key", "token", "count"])

        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch.column("text").to_pylist(), k)
                keys = [digest(s) for s in sets]
                for key, s in zip(keys, sets):
                    if key not in seen and len(s):
                        seen[key] = None
                        held.append(s)
                        size += len(s)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), none, none], ["doc_id", "n", "key", "token", "count"])
                if size > STRETCH:
                    yield frequent()
                    size = 0
        yield frequent()

    return run


def _nodes(k: int, percent: int, frequent):
    """Each set of a task once: doc_id, text_hash, key, group (digest of prefix and size), n, prefix, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = frequent.value
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole):
                rows, out = [], []
                for row, s in enumerate(shingle_sets(batch.column("text").to_pylist(), k)):
                    key = digest(s)
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        ordered = s[np.argsort(np.where(tokens[at] == s, counts[at], 0), kind="stable")]
                    else:
                        ordered = s
                    prefix = ordered[: prefix_length(len(s), percent)].view(np.int64)
                    rows.append(row)
                    out.append((key, hashlib.blake2b(prefix.tobytes(), digest_size=16, salt=len(s).to_bytes(8, "little")).digest(), len(s), prefix, parity_bits(s).tobytes()))
                if len(seen) > 1_000_000:
                    seen.clear()
                own = batch.take(pa.array(rows, pa.int64()))
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_hash"), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))], ["doc_id", "text_hash", "key", "alike", "n", "prefix", "bits"])

    return run


def _walk(percent: int):
    """Posting lists with more than one member, or parts of long ones, sorted by h, part, sized and rank: each member with the first one of its size class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pending = None, False  # the last list's present first member, and whether it hasn't been given yet
        names = ("h", "part", "sized", "n", "node", "pos")

        def rows(h, part, lead, member, n, m, i, j):
            ok = (lead != member) & ~out_of_reach(m, j, n, i, percent)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, part.astype(np.int32), lead, member, n, i.astype(np.int32), ok)], ["h", "part", "a", "b", "n", "pos", "ok"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, part, sized, n, node, pos = (batch.column(c).to_numpy().astype(np.int64) for c in names)
            if state is not None:
                h, part, sized, n, node, pos = (np.concatenate([[x], y]) for x, y in zip(state, (h, part, sized, n, node, pos)))
            given = np.zeros(len(h), dtype=bool)
            given[0] = state is not None and not pending
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
            leads = fresh | np.concatenate([[True], sized[1:] != sized[:-1]])
            at = np.maximum.accumulate(np.where(leads, np.arange(len(h)), 0))
            list_of = np.cumsum(fresh) - 1
            size = np.bincount(list_of)
            shown = ~given & ((part >= 0) | (size[list_of] > 1))
            # A list of one row at the end of the batch may go on.
            wait = (list_of == list_of[-1]) & (size[list_of] == 1) & ~given
            shown &= ~wait
            state, pending = tuple(int(x[at[-1]]) for x in (h, part, sized, n, node, pos)), bool(wait[-1])
            yield rows(*(x[shown] for x in (h, part, node[at], node, n, n[at], pos, pos[at])))
        if pending and state[1] >= 0:
            h, part, _, n, node, pos = (np.array([x]) for x in state)
            yield rows(h, part, node, node, n, n, pos, pos)

    return run


def _alike(percent: int):
    """Pairs whose bitmaps don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b"))):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                words = min(len(x), len(y))
                good.append(not too_far(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()), n, m, percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets(k: int):
    """The sets of texts whose digest is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch.column("text").to_pylist(), k)
                right = pa.array([digest(s) == key for s, key in zip(sets, batch.column("key").to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"]).filter(right)

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _forests(p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Which of the edges p - q, in their order, go into `most` forests; an edge goes into the first one where it joins two trees."""
    if len(p) <= most:
        return np.ones(len(p), dtype=bool)
    roots: list[dict[int, int]] = [{} for _ in range(most)]
    taken = np.zeros(len(p), dtype=bool)
    for e, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
        for root in roots:
            a, b = x, y
            while root.get(a, a) != a:
                root[a] = a = root.get(root[a], root[a])
            while root.get(b, b) != b:
                root[b] = b = root.get(root[b], root[b])
            if a != b:
                root[a] = b
                taken[e] = True
                break
    return taken


def _candidates(percent: int, few: int):
    """Pairs of a block's members in different components that no filter rules out: `few` forests of the components, closest bitmaps first; a pair -1, -1 says that there are more.

    Rows come sorted by block (h, c, i, j). side 0 asks, side 1 answers, side 2 does both; of a list in size classes (c not -1) only pairs whose smaller class is c count.
    """
    numbers = ("h", "c", "i", "j", "side", "node", "pos", "component", "cls", "n")

    def compare(h, c, i, j, side, node, pos, comp, cls, n, minor, bits) -> tuple[np.ndarray, np.ndarray, bool]:
        right, found = np.nonzero(side != 0)[0], []
        words = np.array([len(x) // 8 for x in bits])
        matrices: dict[int, np.ndarray] = {}

        def of_words(w: int) -> np.ndarray:
            """The bitmaps of at least w words, folded to w."""
            if w not in matrices:
                matrices[w] = np.zeros((len(bits), w), dtype=np.uint64)
                for r in np.nonzero(words >= w)[0]:
                    matrices[w][r] = folded(np.frombuffer(bits[r], dtype=np.uint64), w)
            return matrices[w]

        for x in np.nonzero(side != 1)[0]:
            some = right[(comp[right] != comp[x]) & ~(minor[right] & (node[right] < node[x]))]
            if c[0] >= 0:
                some = some[np.minimum(cls[some], cls[x]) == c[0]]
            some = some[~out_of_reach(n[some], pos[some], n[x], pos[x], percent)]
            if len(some):
                shorter, far = np.minimum(words[some], words[x]), np.zeros(len(some), dtype=np.int64)
                for w in np.unique(shorter).tolist():
                    at, matrix = shorter == w, of_words(w)
                    far[at] = np.bitwise_count(matrix[some[at]] ^ matrix[x]).sum(axis=1, dtype=np.int64)
                good = ~too_far(far, n[some], n[x], percent)
                found.append((np.full(good.sum(), x), some[good], far[good]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
        x, y, far = (np.concatenate(part) for part in zip(*found))
        a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        order = np.lexsort((b, a, far))
        taken = order[_forests(comp[x][order], comp[y][order], few)]
        return a[taken], b[taken], len(taken) < len(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def answer(blocks: list[list]) -> pa.RecordBatch:
            parts = [compare(*block) for block in blocks]
            more = [np.array([-1])] if any(p[2] for p in parts) else []
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(p[side] for p in parts), *more])) for side in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(x).to_numpy().astype(np.int64) for x in numbers] + [batch.column("minor").to_numpy(zero_copy_only=False), np.array(batch.column("bits").to_pylist(), dtype=object)]
            if held:
                own = [np.concatenate([x, y]) for x, y in zip(held[0], own)]
            keys = own[:4]
            edges = np.nonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0))[0] + 1
            blocks = [[x[s:e] for x in own] for s, e in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(own[0])]]))]
            held = blocks[-1:]  # it may go on
            yield answer(blocks[:-1])
        if held:
            yield answer(held)

    return run


class Join:
    """The nodes of a table of documents, and the verification of pairs of them."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        spark = self.spark
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        first = written(spark, self.docs.mapInArrow(_first(k), "doc_id long, n long, key binary, token long, count long"), "first")
        self.rows = first.where("key is not null").select("doc_id", "n", "key")
        often = first.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT)
        self.often = written(spark, often, "frequent")
        top = self.often.toPandas()  # at most FREQUENT rows
        tokens, counts = top["token"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
        order = np.argsort(tokens)
        frequent = spark.sparkContext.broadcast((tokens[order], counts[order]))
        named = self.docs.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
        sets = named.mapInArrow(_nodes(k, percent, frequent), "doc_id long, text_hash long, key binary, alike binary, n long, prefix array<long>, bits binary")
        sets = sets.groupBy("key").agg(F.first(F.struct("doc_id", "text_hash", "alike", "n", "prefix", "bits")).alias("s")).select("key", "s.*")
        self.nodes = written(spark, sets.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written: the numbers stay
        self.n_nodes = self.nodes.count()

    def met(self, pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """pairs with left's row of their a and right's row of their b. An a that stands in very many pairs meets them in copies, each with its share of the others."""
        least = max(NEAR, pairs.count() // HOT)  # at most HOT are beyond
        many = pairs.groupBy("a").agg(F.count("*").alias("pairs")).where(F.col("pairs") > least)
        many = F.broadcast(many.select("a", F.ceil(F.col("pairs") / NEAR).cast("int").alias("copies")))
        copies = F.coalesce("copies", F.lit(1))
        shared = pairs.join(many, "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), copies).cast("int")).drop("copies")
        spread = left.join(many, "a", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
        return shared.join(right, "b").join(spread, ["a", "copy"])

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """node, shingles. Most other texts go before the shuffle, by the hash cells of the nodes' documents: at most 2^20, so they can be broadcast."""
        wanted = written(self.spark, self.nodes.join(ids.select("node").distinct(), "node").select("node", "doc_id", "text_hash", "key"), "wanted")
        cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell")
        near = self.docs.withColumn("cell", cell).join(F.broadcast(wanted.select(cell).distinct()), "cell", "left_semi").drop("cell")
        once = near.withColumn("text_hash", F.xxhash64("text")).groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
        texts = once.join(wanted, ["doc_id", "text_hash"]).select("node", "key", "text")
        sets = written(self.spark, texts.mapInArrow(_sets(self.k), "node long, shingles binary"), "shingles")
        discard(wanted)
        return sets

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose bitmaps don't rule them out."""
        info = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        return written(self.spark, self.met(pairs, info("a"), info("b")).mapInArrow(_alike(self.percent), "a long, b long"), "alike")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs a, b that have passed the bitmaps."""
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
        both = self.met(pairs, of("a"), of("b")).select("a", "b", "set_a", "set_b")
        links = written(self.spark, both.mapInArrow(_linked(self.percent), "a long, b long"), "links")
        discard(sets)
        return links


def _posted(join: Join) -> tuple[DataFrame, DataFrame]:
    """(posting lists as walked: h, part, a, b, n, pos, ok; members of groups other than the first: grp, node, n)."""
    spark, nodes, n = join.spark, join.nodes, partitions(join.spark)
    groups = nodes.groupBy("alike").agg(F.min("node").alias("grp"), F.count("*").alias("size")).where("size > 1")
    others = written(spark, nodes.select("alike", "node", "n").join(groups, "alike").where("node <> grp").select("grp", "node", F.col("n").cast("int").alias("n")), "group-members")
    firsts = nodes.join(others.select("node"), "node", "left_anti")
    posted = firsts.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    long_ = join.often.where(f"count > {LONG}").select(F.col("token").alias("h"), F.ceil(F.col("count") / LONG).alias("parts"))
    part = F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")))
    # The first member leads its size class, whose bounds differ from list to list. Members that could be similar to others of their size come first, in one of four orders.
    shift = F.pmod(F.xxhash64("h"), F.lit(8)) / 8
    sized = _size_class("n", join.percent, shift)
    late = F.expr(f"{100 + join.percent} * (n - pos) < {2 * join.percent} * n")
    rank = F.pmod(F.xxhash64("node", F.pmod("h", F.lit(4))), F.lit(1 << 16)) + F.when(late, F.lit(1 << 16)).otherwise(F.lit(0))
    posted = posted.join(F.broadcast(long_), "h", "left").select("h", part.cast("int").alias("part"), sized.alias("sized"), F.col("n").cast("int").alias("n"), "node", "pos", rank.cast("int").alias("rank"))
    posted = posted.repartition(n, "h", "part").sortWithinPartitions("h", "part", "sized", "rank", "node")
    return written(spark, posted.mapInArrow(_walk(join.percent), "h long, part int, a long, b long, n long, pos int, ok boolean"), "walked"), others


def _size_class(n: str, percent: int, shift: Column | float = 0.0) -> Column:
    """Classes of sizes: sets within reach of each other's size lie in one class or in two that follow each other, whatever the rounding."""
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-3
    return F.floor(F.log(F.col(n)) / width + shift).cast("int")


def _blocks(join: Join, walked: DataFrame, others: DataFrame, found: DataFrame, few: int) -> DataFrame:
    """Candidates a, b, repeats included, of the posting lists whose members lie in different components."""
    spark, n = join.spark, partitions(join.spark)
    label = found.select("node", "component")
    labelled = lambda df: df.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A group's members stand where its first one does; a group is also a list of its own.
    rows = walked.select("h", F.col("b").alias("node"), F.col("n").cast("int").alias("n"), "pos", (F.col("part") >= 0).alias("parted"), (F.col("a") == F.col("b")).cast("int").alias("leads"))
    grown = rows.join(others.select("grp", F.col("node").alias("other")), F.col("node") == F.col("grp")).select("h", F.col("other").alias("node"), "n", "pos", "parted", F.lit(0).alias("leads"))
    own = others.unionByName(others.select("grp", F.col("grp").alias("node"), "n").distinct()).select(F.xxhash64("grp").alias("h"), "node", "n", F.lit(0).alias("pos"), F.lit(False).alias("parted"), F.lit(0).alias("leads"))
    rows = members = written(spark, labelled(union_all([rows, grown, own])), "members")
    lists = rows.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.max("parted").alias("parted"), F.sum("leads").alias("leads"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("content"), F.sum("pos").alias("places"))
    # Of lists with the same members only that of the first shingle counts: what it doesn't bring up, the others don't either.
    lists = lists.where("low <> high and (members > 2 or parted or leads > 1)").groupBy("content", "members").agg(F.min_by("h", F.struct("places", "h")).alias("h")).select("h", "members")
    total = rows.count()
    lists = written(spark, lists, "open-lists")
    rows = join_counted(rows.select("h", "node", "n", "pos", "component"), lists, "h", "members", total).where("members is not null")
    # Long lists are cut by size: two classes that follow each other meet in the list's part for the lower one.
    rows = rows.withColumn("cls", _size_class("n", join.percent)).withColumn("c", F.explode(F.when(F.col("members") > BLOCK, F.array(F.col("cls"), F.col("cls") - 1)).otherwise(F.array(F.lit(-1)))))
    rows = open_ = written(spark, rows.drop("members"), "open")
    discard(members)
    held = rows.groupBy("h", "c", "component").agg(F.count("*").alias("size"))
    held = held.groupBy("h", "c").agg(F.sum("size").alias("total"), F.max("size").alias("most"), F.count("*").alias("comps"), F.max_by("component", F.struct("size", "component")).alias("largest"))
    held = held.where("comps > 1").select(F.struct("h", "c").alias("list"), "total", "largest", F.ceil(F.col("total") / BLOCK).cast("int").alias("across"), F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("down"))
    held = written(spark, held, "open-classes")
    rows = join_counted(rows.withColumn("list", F.struct("h", "c")), held, "list", "total", 2 * total).where("total is not null")
    # Of two members in different components, one at least lies outside the largest: only those are compared with all.
    rows = rows.withColumn("minor", F.col("component") != F.col("largest"))
    draw = F.xxhash64("node")
    row, column = F.pmod(draw, F.col("down")).cast("int"), F.pmod(draw, F.col("across")).cast("int")
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    answering = F.transform(upto("down"), lambda i: place(1, i, column))
    both = F.concat(answering, F.transform(upto("across"), lambda j: place(0, row, j)))
    one = F.array(place(2, F.lit(0), F.lit(0)))
    rows = rows.withColumn("places", F.when(~F.col("minor"), answering).when((F.col("across") == 1) & (F.col("down") == 1), one).otherwise(both))
    rows = rows.select("h", "c", "node", "n", "pos", "component", "cls", "minor", F.explode("places").alias("p")).select("h", "c", "p.*", "node", "n", "pos", "component", "cls", "minor")
    rows = rows.join(join.nodes.select("node", "bits"), "node").repartition(n, "h", "c", "i", "j").sortWithinPartitions("h", "c", "i", "j")
    named = written(spark, rows.mapInArrow(_candidates(join.percent, few), "a long, b long"), "candidates")
    for done in (lists, open_, held):
        discard(done)
    return named


def ngram_components(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    with shuffles_freed(docs.sparkSession):
        return _components(docs, k, threshold)


def _components(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    join = Join(docs, k, round(100 * threshold))
    spark, nodes = join.spark, join.nodes
    walked, others = _posted(join)
    pairs = walked.where("ok").select("a", "b")
    # First members of a long list's parts are paired with the list's first one of their size class.
    leads = walked.where("part >= 0 and a = b").withColumn("cls", _size_class("n", join.percent))
    tops = leads.join(leads.groupBy("h", "cls").agg(F.min("a").alias("top")), ["h", "cls"]).where("a <> top").select(F.col("top").alias("a"), "b")
    stars = others.select(F.col("grp").alias("a"), F.col("node").alias("b"))
    checked = written(spark, union_all([pairs, tops, stars]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    maybe = join.alike(checked)
    links = join.links(maybe)
    discard(maybe)
    # Several texts of one doc_id are linked by it.
    several = join.rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("one"), F.max("key").alias("other")).where("one <> other").select("doc_id")
    if several.limit(1).count():
        of = join.rows.join(several, "doc_id").select("doc_id", "key").distinct().join(nodes.select("key", "node"), "key")
        links = links.unionByName(of.join(of.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    found, few = components(links, tidy=True), FEW
    while True:
        named = _blocks(join, walked, others, found, few)
        more = bool(named.where("a < 0").limit(1).count())
        fresh = written(spark, named.where("a >= 0").distinct().join(checked, ["a", "b"], "left_anti"), "fresh")
        discard(named)
        if fresh.limit(1).count():
            new = join.links(fresh)
            checked = checked.unionByName(fresh)
            if new.limit(1).count():
                found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(new), tidy=True)
                if not more:
                    break  # every candidate has been verified
            elif not more:
                break
        elif not more:
            break
        few *= MORE
    discard(walked)

    # A component is named by its smallest doc_id.
    full = join.rows.where("n > 0 and doc_id is not null")
    first = written(spark, full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "keys")
    inside = found.join(nodes.select("node", "key"), "node").join(first.select("key", "doc_id"), "key").select("key", "doc_id", "component")
    names = inside.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("nodes"))
    of_key = join_counted(inside.select("key", "component"), names, "component", "nodes", join.n_nodes).select("key", "component_id")
    of_key = first.join(of_key, "key", "left").select("key", "rows", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = join_counted(full, of_key, "key", "rows", full.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = join.rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=5, threshold=0.8)


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
i as (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) as i from w where len(ws) > 0),
s as materialized (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i+4], ' ') end as g from i),
n as materialized (select doc_id, count(*) as n from s group by 1),
p as materialized (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as materialized (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.node where r.c < e.b)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.c) as component_id from documents d left join n using (doc_id) join r on r.node = d.doc_id group by d.doc_id
"""
