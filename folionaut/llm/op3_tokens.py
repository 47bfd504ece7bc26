"""Token counts by dynamic programming on a trie.

A task's distinct pre-tokens (words with the space in front, see pieces.py) go into a trie. The best unigram path to a
node depends on the node's prefix alone, so it is computed once for all pre-tokens that share it: node by node, level by
level, the best over all pieces that end there, with the number of tokens on that path. Where a pre-token ends, its
count is stored, and a text's count is the sum over its pre-tokens. A character that is no piece counts as its bytes.

Unigram scores are those of the model, or by rank if the model is BPE (see Vocabulary.with_rank_scores). Null and empty texts have
0 tokens. Texts are counted whole. Repeated rows are counted each by itself. Of equally good paths the one with the longer last piece
counts. Null doc_ids stay null. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .op4_sentencepiece import MODEL
from .pieces import _BASE, Vocabulary, _mix, _powers, codes_of, units

_KEPT = 400_000  # distinct pre-tokens whose counts a task remembers


def trie_counts(vocab: Vocabulary, words: list[str]) -> np.ndarray:
    """Tokens on the best path of each distinct word; words of similar length share a trie."""
    out = np.zeros(len(words), dtype=np.int64)
    lengths = np.array(list(map(len, words)), dtype=np.int64)
    classes = np.ceil(np.log2(np.maximum(lengths, 16))).astype(int)
    for c in np.unique(classes):
        at = np.nonzero(classes == c)[0]
        step = max(1, 8_000_000 >> c)
        order = at[np.argsort(np.array([words[i] for i in at], dtype=object), kind="stable")]
        for k in range(0, len(order), step):
            out[order[k : k + step]] = _trie(vocab, [words[i] for i in order[k : k + step]])
    return out


def _trie(vocab: Vocabulary, words: list[str], unknown_penalty: float = 10.0) -> np.ndarray:
    """words: sorted, so that those that share a prefix are neighbours."""
    lengths = np.array(list(map(len, words)), dtype=np.int64)
    n, depth = len(words), int(lengths.max())
    codes = np.zeros((n, depth), dtype=np.uint32)
    codes[np.arange(depth)[None, :] < lengths[:, None]] = codes_of("".join(words))
    mixed = _mix(codes)
    powers = _powers(vocab.longest)
    floor = vocab.scores.min() - unknown_penalty
    node = np.zeros(n, dtype=np.int64)  # each word's node at the present level
    levels = [(np.zeros(1), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint64))]  # of each level's nodes: best, count, hash
    path = [node]
    out = np.zeros(n, dtype=np.int64)
    for d in range(1, depth + 1):
        live = lengths >= d
        # A new node begins where the parent or the character differs from the word before.
        fresh = np.zeros(n, dtype=bool)
        rows = np.nonzero(live)[0]
        fresh[rows[0]] = True
        a, b = rows[1:], rows[:-1]
        fresh[a] = (node[a] != node[b]) | (codes[a, d - 1] != codes[b, d - 1])
        heads = np.nonzero(fresh)[0]
        own = np.cumsum(fresh) - 1
        with np.errstate(over="ignore"):
            hashes = levels[d - 1][2][node[heads]] * _BASE + mixed[heads, d - 1]
        best, count = np.full(len(heads), -np.inf), np.zeros(len(heads), dtype=np.int64)
        for size in range(min(vocab.longest, d), 0, -1):
            above = path[d - size][heads]
            old_best, old_count, old_hash = levels[d - size]
            with np.errstate(over="ignore"):
                at = vocab.find(hashes - old_hash[above] * powers[size])
            total = old_best[above] + np.where(at >= 0, vocab.scores[at], floor if size == 1 else -np.inf)
            better = total > best
            best = np.where(better, total, best)
            tokens = 1 if size > 1 else np.where(at >= 0, 1, _bytes(codes[heads, d - 1]) if vocab.first_byte is not None else 1)
            count = np.where(better, old_count[above] + tokens, count)
        levels.append((best, count, hashes))
        node = np.where(live, own, 0)
        path.append(node)
        ended = lengths == d
        out[ended] = count[node[ended]]
        if d > vocab.longest:
            levels[d - vocab.longest - 1] = path[d - vocab.longest - 1] = None  # no piece reaches back so far
    return out


def _bytes(codes: np.ndarray) -> np.ndarray:
    """Length in UTF-8."""
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def token_counts(docs: DataFrame, model: str = MODEL, vocab: Vocabulary | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab or Vocabulary.load(model)).with_rank_scores())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        known: dict[str, int] = {}
        counts = np.zeros(0, dtype=np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            if len(known) > _KEPT:
                known, counts = {}, np.zeros(0, dtype=np.int64)
            own = [units(t) for t in batch.column("text").to_pylist()]
            before = len(known)
            at = np.fromiter((known.setdefault(w, len(known)) for words in own for w in words), dtype=np.int64, count=sum(map(len, own)))
            if len(known) > before:
                counts = np.concatenate([counts, trie_counts(vocab, list(known)[before:])])
            sizes = np.array([len(words) for words in own], dtype=np.int64)
            sums = np.concatenate([[0], np.cumsum(counts[at])]).astype(np.int64)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])], ["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
