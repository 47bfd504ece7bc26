"""SentencePiece encoding and decoding with numpy, many words at once.

Texts are cut into words that no piece spans; a batch's distinct words are segmented once, those of equal length
together (see pieces.py), and every text's ids are gathered from its words'. A unigram model takes the best path by
Viterbi. A BPE model merges pairs by rank instead, on the same matrices and hashes, since a best path isn't what such a model says.
A character that is no piece falls back to its bytes. Ids are turned back to text by joining their pieces' bytes.

The vocabulary is read by the driver and broadcast (tens of thousands of short strings, by the model file). Null and empty
texts have no ids; decoding no ids gives an empty text. ▁ in a text is read as a space, as in the library. Texts are taken whole, in batches of
few rows. Null doc_ids stay null. Repeated rows are encoded each by itself. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .pieces import SPACE, Vocabulary, segment, units

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_KEPT = 400_000  # distinct words whose ids a task remembers


class Encoder:
    """Encodes batches of texts; remembers the ids of the words it has met, up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known, self.ids, self.starts = vocab, {}, np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if len(self.known) > _KEPT:
            self.__init__(self.vocab)
        own = [units(t) for t in texts]
        known, before = self.known, len(self.known)
        at = np.fromiter((known.setdefault(w, len(known)) for words in own for w in words), dtype=np.int64, count=sum(map(len, own)))
        if len(known) > before:
            ids, counts = segment(self.vocab, list(known)[before:], self.vocab.unigram)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], np.cumsum([len(words) for words in own])]).astype(np.int64)
        totals = np.concatenate([[0], ends])[bounds]
        return self.ids[places], np.diff(totals)


def decode(vocab: Vocabulary, ids) -> str:
    """The text of some ids; the space that encoding put in front goes."""
    table_ = vocab.by_id
    text = b"".join([table_[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: str = MODEL, vocab: Vocabulary | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_ids, ids (array of int), round_trip (whether decoding gives the text again)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab or Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        encoder = Encoder(vocab)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("text").to_pylist()
            ids, counts = encoder(texts)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            same = [decode(vocab, ids[a:b].tolist()) == t.replace(SPACE, " ") for t, a, b in zip(texts, bounds[:-1], bounds[1:])]
            lists = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, type=pa.int64()), lists, pa.array(same)], ["doc_id", "n_ids", "ids", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decoded(encoded: DataFrame, model: str = MODEL, vocab: Vocabulary | None = None) -> DataFrame:
    """One row per row of encoded (doc_id, ids): doc_id and text; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocab or Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(shared.value, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
