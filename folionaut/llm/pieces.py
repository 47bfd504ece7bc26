"""Piece vocabularies, and segmenting many words at once with numpy.

Words of equal length stand in one matrix of code points and advance together. The hash of any substring comes
from prefix hashes; pieces are found by probing their sorted hashes. `viterbi` is the best path of a unigram
model: for every end position the best of all pieces that end there, with backpointers. `merge` is what a BPE
model's own library does, and the best path isn't: the best-ranked neighbouring pair merges, leftmost first.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.iinfo(np.int64).max
_LONG = 512


def _mix(codes: np.ndarray) -> np.ndarray:
    """Code points to scattered 64-bit values."""
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, dtype=np.uint64), dtype=np.uint64)])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class Vocabulary:
    """Normal pieces with ids and scores; ids of byte pieces from `first_byte` on, or None."""

    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    first_byte: int | None
    unknown: int
    unigram: bool
    by_id: list[bytes]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a sentencepiece model file."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        del sentencepiece
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        first = next((i for i, p in enumerate(model.pieces) if p.type == 6), None)
        by_id = [bytes([i - first]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for i, p in enumerate(model.pieces)]
        return cls([p for _, p, _ in normal], np.array([i for i, _, _ in normal], dtype=np.int64), np.array([s for *_, s in normal], dtype=np.float64), first, model.trainer_spec.unk_id, model.trainer_spec.model_type == 1, by_id)

    def with_rank_scores(self) -> Vocabulary:
        """A unigram model of the same pieces: by Zipf's law the log of a piece's frequency falls as the log of its rank.

        A BPE file has ranks in the place of scores; sums of ranks would say nothing about likelihood.
        """
        if self.unigram:
            return self
        rank = np.argsort(np.argsort(-self.scores, kind="stable"), kind="stable")
        return Vocabulary(self.pieces, self.ids, -np.log(rank + 2.0), self.first_byte, self.unknown, True, self.by_id)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the pieces, and the position in `pieces` of each."""
        hashes = np.empty(len(self.pieces), dtype=np.uint64)
        lengths = np.array(list(map(len, self.pieces)))
        for n in np.unique(lengths):
            at = np.nonzero(lengths == n)[0]
            hashes[at] = prefix_hashes(np.stack([codes_of(self.pieces[i]) for i in at]))[:, -1]
        order = np.argsort(hashes)
        assert len(np.unique(hashes)) == len(hashes)
        return hashes[order], order

    @cached_property
    def ranks(self) -> np.ndarray:
        """Merge order of each piece: the highest score first."""
        return np.argsort(np.argsort(-self.scores, kind="stable"), kind="stable").astype(np.int64)

    @cached_property
    def index(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces)}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position in `pieces`, or -1."""
        keys, order = self.keys
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, order[at], -1)

    def fallback(self, codes: np.ndarray) -> list[int]:
        """Ids of a character that is no piece."""
        if self.first_byte is None:
            return [self.unknown]
        return [self.first_byte + b for b in chr(int(codes)).encode("utf-8", "surrogatepass")]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """W x (L+1): the hash of every prefix of each row."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    mixed = _mix(codes)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + mixed[:, j]
    return out


def _between(prefix: np.ndarray, powers: np.ndarray, rows, start, end) -> np.ndarray:
    """Hashes of [start, end) of the rows."""
    with np.errstate(over="ignore"):
        return prefix[rows, end] - prefix[rows, start] * powers[end - start]


def viterbi(vocab: Vocabulary, codes: np.ndarray, unknown_penalty: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Best path of each row: (W x L backpointers: length of the piece that ends at each position, W best scores).

    A character that is no piece costs the lowest score less the penalty. Of equal paths the one with the longer last piece wins.
    """
    n, length = codes.shape
    prefix, powers = prefix_hashes(codes), _powers(length)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.ones((n, length), dtype=np.int32)
    floor = vocab.scores.min() - unknown_penalty
    rows = np.arange(n)
    for end in range(1, length + 1):
        for size in range(min(vocab.longest, end), 0, -1):
            at = vocab.find(_between(prefix, powers, rows, end - size, np.full(n, end)))
            own = np.where(at >= 0, vocab.scores[at], floor if size == 1 else -np.inf)
            total = best[:, end - size] + own
            better = total > best[:, end]
            best[better, end] = total[better]
            back[better, end - 1] = size
    return back, best[:, -1]


def merge(vocab: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """BPE of each row: W x L, at each symbol's start its end, elsewhere 0."""
    n, length = codes.shape
    prefix, powers = prefix_hashes(codes), _powers(length)
    after = np.tile(np.arange(1, length + 2), (n, 1))  # of the symbol that starts here: where the next one does
    after[:, length] = length
    before = np.tile(np.arange(-1, length), (n, 1))
    alive = np.ones((n, length + 1), dtype=bool)

    def rank(rows, start):
        """Of the pair whose first symbol starts at start; none at the end or before the start."""
        middle = after[rows, start]
        end = after[rows, middle]
        at = vocab.find(_between(prefix, powers, rows, start, end))
        return np.where((at >= 0) & (middle < length) & (end > middle), vocab.ranks[at], _NONE)

    every = np.repeat(np.arange(n), length)
    pairs = rank(every, np.tile(np.arange(length), n)).reshape(n, length)
    rows = np.arange(n)
    while len(rows):
        at = pairs[rows].argmin(axis=1)
        go = pairs[rows, at] < _NONE
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        second = after[rows, at]
        third = after[rows, second]
        after[rows, at] = third
        before[rows, third] = at
        alive[rows, second] = False
        pairs[rows, second] = _NONE
        pairs[rows, at] = rank(rows, at)
        left = before[rows, at]
        has = left >= 0
        pairs[rows[has], left[has]] = rank(rows[has], left[has])
    return np.where(alive[:, :length], after[:, :length], 0)


def _merge_long(vocab: Vocabulary, text: str) -> list[str]:
    """The same of one long word, with a heap of pairs."""
    n = len(text)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        middle = after[start]
        if middle < n and (i := vocab.index.get(text[start : after[middle]])) is not None:
            heapq.heappush(heap, (int(vocab.ranks[i]), start, after[middle]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, start, end = heapq.heappop(heap)
        if not alive[start] or after[start] >= n or after[after[start]] != end:
            continue
        second = after[start]
        alive[second] = False
        after[start] = end
        if end < n:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    out, at = [], 0
    while at < n:
        out.append(text[at : after[at]])
        at = after[at]
    return out


_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n\r\t]+|{SPACE}+|[\n\r\t]")


def units(text: str) -> list[str]:
    """A text's words as the model sees them: a space in front, spaces as ▁; no piece spans two of them."""
    return _UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def segment(vocab: Vocabulary, words: list[str], unigram: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many of them each word has."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, ids of all of them, number of ids of each
    lengths = np.array(list(map(len, words)), dtype=np.int64)
    for length in np.unique(lengths):
        at = np.nonzero(lengths == length)[0]
        if length > _LONG and not unigram:
            for i in at:
                ids = _ids_of(vocab, _merge_long(vocab, words[i]))
                found.append((np.array([i]), ids, np.array([len(ids)])))
            continue
        step = max(1, 1_000_000 // int(length))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            found.append((own, *_matrix(vocab, [words[i] for i in own], int(length), unigram)))
    counts = np.zeros(len(words), dtype=np.int64)
    for at, _, sizes in found:
        counts[at] = sizes
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.int64)
    for at, ids, sizes in found:
        out[np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
    return out, counts


def _ids_of(vocab: Vocabulary, pieces: list[str]) -> np.ndarray:
    out: list[int] = []
    for p in pieces:
        i = vocab.index.get(p)
        out += [int(vocab.ids[i])] if i is not None else vocab.fallback(codes_of(p)[0])
    return np.array(out, dtype=np.int64)


def _matrix(vocab: Vocabulary, words: list[str], length: int, unigram: bool) -> tuple[np.ndarray, np.ndarray]:
    codes = codes_of("".join(words)).reshape(len(words), length)
    if unigram:
        back, _ = viterbi(vocab, codes)
        ends = np.zeros((len(words), length), dtype=np.int64)
        rows, end = np.arange(len(words)), np.full(len(words), length)
        while len(rows):
            start = end - back[rows, end - 1]
            ends[rows, start] = end
            go = start > 0
            rows, end = rows[go], start[go]
    else:
        ends = merge(vocab, codes)
    rows, starts = np.nonzero(ends)
    prefix, powers = prefix_hashes(codes), _powers(length)
    found = vocab.find(_between(prefix, powers, rows, starts, ends[rows, starts]))
    ids = np.where(found >= 0, vocab.ids[found], -1)
    missing = np.nonzero(found < 0)[0]
    if len(missing):
        extra = [vocab.fallback(c) for c in codes[rows[missing], starts[missing]]]
        sizes = np.ones(len(ids), dtype=np.int64)
        sizes[missing] = list(map(len, extra))
        rows = np.repeat(rows, sizes)
        ids = np.repeat(ids, sizes)
        ids[ids < 0] = np.concatenate([np.array(x, dtype=np.int64) for x in extra])
    return ids, np.bincount(rows, minlength=len(words))
