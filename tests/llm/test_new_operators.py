"""Vector codes, n-gram join and Merkle manifest: against brute force, on odd inputs, and their parts on their own."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folionaut.llm import op8_ann, op11_codes, op12_ngram_join, op13_merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, part int"
VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, numbers int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2) for i, t, s in rows], DOCS)


# --- op11 ----------------------------------------------------------------------------------------------------
def plain_codes(rows):
    """rows (vec_id, vector, label), vec_ids distinct: {vec_id: (code, error, label_error)} and the digest, by whole numbers."""
    kept = sorted((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    w = len(kept[0][1]) // 4
    books = [[v[p * w : (p + 1) * w] for _, v, _ in kept[:256]] for p in range(4)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v[p * w : (p + 1) * w], books[p][e]), e))
    for _ in range(4):
        groups = collections.defaultdict(list)
        for _, v, _ in kept:
            for p in range(4):
                groups[p, nearest(v, p)].append(v[p * w : (p + 1) * w])
        for (p, e), own in groups.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, labels = {}, collections.Counter()
    for i, v, label in kept:
        codes = [nearest(v, p) for p in range(4)]
        error = sum(far(v[p * w : (p + 1) * w], books[p][e]) for p, e in enumerate(codes))
        out[i] = ("".join(f"{e:02x}" for e in codes), error, label)
        labels[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return {i: (c, e, labels[label]) for i, (c, e, label) in out.items()}, digest


@pytest.mark.parametrize("n, dims, spread, closest", [(600, 8, 1.0, 32), (300, 8, 0.004, 3), (40, 4, 1.0, 32), (700, 16, 0.05, 8), (1, 4, 1.0, 32)])
def test_codes_against_whole_numbers(spark, n, dims, spread, closest):
    """A small spread makes many ties; few closest entries make the bounds fail."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(12, dims)) * spread * 3
    rows = [(i * 3 - 50, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=dims) * spread)], None if i % 7 == 0 else i % 3) for i in range(n)]
    rows[n // 2] = (rows[n // 2][0], rows[0][1], 1)  # a repeated vector
    odd = [(10**9, None, 1), (10**9 + 1, [float("nan")] * dims, 1), (10**9 + 2, [1.0] * (dims - 1) + [float("inf")], 2), (10**9 + 3, [1.0] * (dims - 1) + [None], 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + odd], VECTORS).repartition(3)
    want, digest = plain_codes(rows)
    found = op11_codes.vector_codes(df, closest).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in found} == want and {r.codebooks_sha256 for r in found} == {digest}


def test_codes_of_odd_tables(spark):
    make = lambda rows: op11_codes.vector_codes(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)).collect()
    assert make([]) == [] and make([(1, None, 1)]) == []
    # Lengths that four doesn't divide, shorter and longer vectors, extreme components, null and repeated vec_ids.
    got = make([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0], 1), (3, [1.0] * 9, None), (None, [3e38] * 5, 2), (4, [-3e38] * 5, 2), (4, [-3e38] * 5, 2), (5, [], 1)])
    assert len(got) == 7 and sum(r.vec_id == 4 for r in got) == 2 and all(len(r.code) == 8 for r in got)
    assert len(make([(1, [], 1), (2, [], None)])) == 2


def test_bounds_never_lose_the_nearest():
    """Entries move at random; the state kept by bounds names the same nearest entries as all distances do, with most of them not measured."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-500, 500, (256, 4))
    x = entries[rng.integers(0, 256, 3000)] + rng.integers(-30, 31, (3000, 4))
    state = op11_codes.measured(x, entries, 24)
    for step, b in ((40, 24), (6, 12), (2, 12), (1, 6)):
        after = entries + rng.integers(-step, step + 1, entries.shape)
        *state, need = op11_codes.moved(x, after, np.sqrt(((after - entries) ** 2.0).sum(axis=1)), *state, b)
        entries = after
        every = ((x[:, None, :] - entries) ** 2).sum(axis=2)
        assert (state[0][:, 0] == every.argmin(axis=1)).all()
        true = np.sqrt(np.take_along_axis(every, state[0].astype(int), axis=1))
        assert (state[1][:, 1:] <= true[:, 1:] + 1e-9).all()
        rest = every.astype(float)
        np.put_along_axis(rest, state[0].astype(int), np.inf, axis=1)
        assert (state[2] <= np.sqrt(rest.min(axis=1)) + 1e-9).all()
    assert (need == 0).mean() > 0.5


# --- op12 ----------------------------------------------------------------------------------------------------
def plain_components(rows, k, percent):
    sets = []
    for _, t, _ in rows:
        w = "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (t or "").translate(LOW)).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, _, _), x in zip(rows, sets):
        for (j, _, _), y in zip(rows, sets):
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((str(i), len(s), None if i is None else find(i)) for (i, _, _), s in zip(rows, sets))


def family(rng, n, words, edits, base):
    """n variants of one text, each with some words changed."""
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed, k, threshold", [(1, 5, 0.8), (2, 3, 0.6)])
def test_join_against_all_pairs(spark, seed, k, threshold, monkeypatch):
    """Families of near copies around the threshold, a passage that half of the texts hold, subsets of several sizes, and small blocks and parts."""
    monkeypatch.setattr(op12_ngram_join, "BLOCK", 4)
    monkeypatch.setattr(op12_ngram_join, "LONG", 6)
    monkeypatch.setattr(op12_ngram_join, "FEW", 1)
    monkeypatch.setattr(op12_ngram_join, "MORE", 8)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(60))
    texts = []
    for size, edits in ((30, 1), (60, 3), (120, 8), (200, 12)):
        texts += family(rng, 14, size, edits, [word() for _ in range(size)])
    texts += [f"{' '.join(word() for _ in range(rng.randrange(3, 30)))} {passage} {' '.join(word() for _ in range(rng.randrange(3)))}" for _ in range(60)]
    long_ = [word() for _ in range(150)]
    texts += [" ".join(long_[: 150 - 5 * i]) for i in range(12)]
    texts += [None, "", " \n", "one", "ONE", "a b c", "A  b\tc", texts[0], texts[0].upper(), "w1 " * 3000]
    rows = [(i * 2, t, "s") for i, t in enumerate(texts)]
    rows += [(None, texts[1], "s"), (4, "quite another text with words of its own", None), (4, texts[20], None)]
    rng.shuffle(rows)
    got = op12_ngram_join.ngram_components(docs(spark, rows).repartition(5), k, threshold).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == plain_components(rows, k, round(100 * threshold))


def test_join_of_empty_tables(spark):
    assert op12_ngram_join.ngram_components(docs(spark, [])).count() == 0
    assert [tuple(r) for r in op12_ngram_join.ngram_components(docs(spark, [(1, None, None)])).collect()] == [(1, 0, 1)]


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        y = np.unique(np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)]))
        a, b = op12_ngram_join.parity_bits(x), op12_ngram_join.parity_bits(y)
        words = min(len(a), len(b))
        far = int(np.bitwise_count(op12_ngram_join.folded(a, words) ^ op12_ngram_join.folded(b, words)).sum())
        assert far <= len(np.setxor1d(x, y))


# --- op13 ----------------------------------------------------------------------------------------------------
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """rows with distinct doc_ids -> {doc_id: the other columns}."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s, n: H(field(i), field(s), field("en"), field(n), field(t))

    def tree(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // 16 * 16
            out.append((i - a, level[a : a + 16]))
            i //= 16
        return out

    own = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        own[r[2]].append(r)
    sources = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(i, t, s, len(t or "")) for i, t, _ in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = {}
    for at, s in enumerate(sources):
        for k, (i, t, _) in enumerate(own[s]):
            steps = path(trees[s], k) + path(top, at)
            shown = t.translate(LOW) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t
            d = leaf(i, shown, s, len(t or ""))
            for place, run in steps:
                d = H(*run[:place], d, *run[place + 1 :])
            out[i] = (trees[s][0][k], trees[s][-1][0], top[-1][0], H(*(x for place, run in steps for x in run[:place] + run[place + 1 :])), d, d == top[-1][0])
    return out


@pytest.mark.parametrize("sizes", [(1,), (16, 1), (17, 300, 2), (1,) * 20, (5000, 4, 16, 257)])
def test_manifest_against_plain_trees(spark, sizes):
    rng = random.Random(len(sizes))
    texts = ["Some Text", "no capitals", "ÄÖ é Z", None, "", "日本 A", "x" * 3000 + "Y"]
    names = [None, "", "ü", "a", "Z", "é" * 3, *(f"s{i}" for i in range(30))]
    rows = [(s * 10_000 + i - 40, texts[rng.randrange(len(texts))], names[s]) for s, n in enumerate(sizes) for i in range(n)]
    rows.append((None, "A Null Id", names[0]))
    rng.shuffle(rows)
    got = {r.doc_id: tuple(r)[1:] for r in op13_merkle.merkle_manifest(docs(spark, rows).repartition(3)).collect()}
    assert got == plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    assert op13_merkle.merkle_manifest(docs(spark, [])).count() == 0
    same = op13_merkle.merkle_manifest(docs(spark, [(1, "A", "s")] * 40 + [(1, "B", "s")])).collect()
    assert len(same) == 41 and len({r.root for r in same}) == 1 and all(r.verified for r in same if zlib.crc32(b"1") % 5)


def test_octopus_asks_for_the_least():
    """Nothing that is asked for can be derived, and all proofs can be put together from it."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        width = int(rng.integers(1, 2000))
        leaves = [H(str(i)) for i in range(width)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        have = np.unique(rng.integers(0, width, rng.integers(1, 60)))
        asked = op13_merkle.octopus(have, width)
        known = {(0, int(i)) for i in have}
        for level, idx in asked:
            for i in idx.tolist():
                below = range(16 * i, min(16 * i + 16, len(levels[level - 1]))) if level else []
                assert (level, i) not in known and not (below and all((level - 1, j) in known for j in below))
            known |= {(level, i) for i in idx.tolist()}
            known |= {(level + 1, run) for run in {j // 16 for n, j in known if n == level}}
        assert (len(levels) - 1, 0) in known
        for level in range(len(levels) - 1):
            for i in have.tolist():
                run = i // 16 ** (level + 1)
                assert all((level, j) in known for j in range(16 * run, min(16 * run + 16, len(levels[level]))))


def test_tampering_is_seen(spark):
    rows = [(i, f"Text {i}" if i % 2 else f"text {i}", f"s{i % 3}") for i in range(200)]
    got = op13_merkle.merkle_manifest(docs(spark, rows)).where(~F.col("verified")).select("doc_id").collect()
    assert {r.doc_id for r in got} == {i for i in range(200) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0}


def test_no_name_is_the_null_source(spark):
    from folionaut.llm import op2_mix

    got = {r.doc_id: (r.mix_source_size, r.mix_target) for r in op2_mix.mix(docs(spark, [(1, "a b", None), (2, "a b c", "\U0010ffff"), (3, "x", "s"), (4, "y", "1"), (5, "z z", "0")]), F.array("source")).collect()}
    assert {i: s for i, (s, _) in got.items()} == {1: 2, 2: 3, 3: 1, 4: 1, 5: 2}


def test_a_search_task_holds_a_bounded_number_of_query_tiles():
    """Query tiles that a task met long ago are passed on while it still reads, whatever their number; nothing that belongs to the nearest is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    pack = lambda x, first: dict(zip(("n", "rows", "own", "q", "measures"), (len(x), np.arange(first, first + len(x)).tobytes(), np.arange(first, first + len(x)).tobytes(), *(a.tobytes() for a in op8_ann.quantise(x)))))
    x, y = rng.normal(size=(150, 3, 8)), rng.normal(size=(3000, 8))
    read = []

    def batches():
        for _ in range(2):  # each query tile comes twice, the second time after all others
            for i, tile in enumerate(x):
                read.append(i)
                row = {"dim": 8, "q_tile": i} | {f"q_{c}": v for c, v in pack(tile, 10**6 + 3 * i).items()} | pack(y, 0)
                yield pa.RecordBatch.from_pylist([row])

    search = op8_ann._search(5)(batches())
    first = next(search)
    assert len(read) <= op8_ann._ASKED + 1
    found = {}
    for batch in (first, *search):
        for q, row in zip(batch.column("query").to_pylist(), batch.column("row").to_pylist()):
            found.setdefault(q - 10**6, set()).add(row)
    best = np.argsort(-(x.reshape(-1, 8) @ y.T), axis=1)[:, :5]
    assert all(set(best[q].tolist()) <= found[q] for q in range(450))
