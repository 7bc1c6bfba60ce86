"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words' hashes into ``BUCKETS`` (square
root of the count, scaled to length one), ``len(STRUCTURE)`` statistics of its
characters, words and lines (standardised), and its n_chars as metadata.  The
score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)**2 - sum v_if**2 x_i**2),

the pairwise interactions of rank ``RANK`` in time linear in the features.

Training is bounded: about ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_CHARS`` characters, by a hash of doc_id, outside the held-out fold;
AdaGrad in a seeded order, classes weighted evenly.

Defined cases: null text is empty; empty texts have a score (from their
structure); without labels every score is 0.5; a null n_chars counts as 0; a
null doc_id is not held out and is not learned from; repeated rows are scored
each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import labelled_sample, ship

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BUCKETS, RANK = 1 << 15, 6
TRAIN_DOCS, TRAIN_CHARS = 5_000, 50_000
EPOCHS, RATE, DECAY, SEED = 8, 0.08, 1e-5, 7

RESULT = "doc_id long, held_out boolean, score double, predicted int"
STRUCTURE = ("words", "word_bytes", "upper", "digits", "symbols", "shouts", "commas", "other_signs", "lines", "wide", "bars", "distinct", "top_word", "repeats", "short_words", "given_chars")

_CLASSES = {
    "upper": range(65, 91), "digits": range(48, 58), "symbols": b"#*$%&<>", "shouts": b"!", "commas": b",.;:?", "other_signs": b"\"'()+-/=@[\\]^_`{}~", "lines": b"\n", "wide": range(128, 256), "bars": b"|",
}


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(marks)
    return np.diff(np.searchsorted(at, offsets)).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: each hashed word's text, bucket and value, and the structure statistics."""
    n = len(offsets) - 1
    starts, ends, first = kernel.word_spans(data, offsets)
    words = kernel.word_hashes(data, starts, ends)
    n_words = np.diff(first)
    some = np.maximum(n_words, 1)
    n_bytes = np.maximum(np.diff(offsets), 1)
    doc = np.repeat(np.arange(n), n_words)
    keys = np.sort((doc.astype(np.uint64) << np.uint64(32)) | (words & np.uint64(0xFFFFFFFF)))
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(keys)))
    owner = (keys[head] >> np.uint64(32)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    stats = {"words": np.log1p(n_words), "word_bytes": np.bincount(doc, ends - starts, n) / some, "distinct": np.bincount(owner, minlength=n) / some, "top_word": top / some, "repeats": np.bincount(doc, same, n) / some, "short_words": np.bincount(doc, ends - starts <= 3, n) / some, "given_chars": np.log1p(np.maximum(given, 0))}
    for name, chars in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        stats[name] = np.sqrt(_per_text(table[data], offsets) / n_bytes)
    bucket = (kernel.mix64(keys[head] & np.uint64(0xFFFFFFFF)) % np.uint64(BUCKETS)).astype(np.int64)
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(owner, value**2, n))
    return owner, bucket, value / np.maximum(norm, 1e-9)[owner] if len(owner) else value, np.column_stack([stats[k] for k in STRUCTURE])


class FactorisationMachine:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        size = BUCKETS + len(STRUCTURE)
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = rng.normal(0, 0.01, (size, RANK))
        self.mean, self.scale = np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE))

    def standard(self, structure: np.ndarray) -> np.ndarray:
        return np.clip((structure - self.mean) / self.scale, -4, 4) / np.sqrt(len(STRUCTURE))

    def fit(self, texts: list[str], given: list[int], labels: list[int]) -> FactorisationMachine:
        y = np.array(labels, float)
        if not len(y) or y.min() == y.max():
            self.bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return self
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        dense = []
        at = 0
        for lo, hi, data, offsets in kernel.slices(pa.array(texts, pa.string())):
            owner, bucket, value, structure = features(data, offsets, np.array(given[lo:hi], float))
            cut = np.searchsorted(owner, np.arange(hi - lo + 1))
            rows += [(bucket[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            dense.append(structure)
            at = hi
        structure = np.concatenate(dense)
        self.mean, self.scale = structure.mean(axis=0), structure.std(axis=0) + 1e-6
        structure = self.standard(structure)
        fixed = BUCKETS + np.arange(len(STRUCTURE))
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rng = np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            for i in rng.permutation(at):
                index, x = np.concatenate([rows[i][0], fixed]), np.concatenate([rows[i][1], structure[i]])
                w, v = self.w[index], self.v[index]
                sums = x @ v
                margin = self.bias + w @ x + 0.5 * (sums @ sums - ((v * x[:, None]) ** 2).sum())
                g = weight[i] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[i])
                dw = g * x + DECAY * w
                dv = g * (x[:, None] * sums - v * (x**2)[:, None]) + DECAY * v
                np.add.at(gw, index, dw**2)
                np.add.at(gv, index, dv**2)
                gb += g * g
                self.w[index] -= RATE * dw / np.sqrt(gw[index])
                self.v[index] -= RATE * dv / np.sqrt(gv[index])
                self.bias -= RATE * g / np.sqrt(gb)
        return self

    def scores(self, data: np.ndarray, offsets: np.ndarray, given: np.ndarray) -> np.ndarray:
        owner, bucket, value, structure = features(data, offsets, given)
        n = len(offsets) - 1
        dense = self.standard(structure)
        out = self.bias + np.bincount(owner, self.w[bucket] * value, n) + dense @ self.w[BUCKETS:]
        for f in range(RANK):
            part = self.v[bucket, f] * value
            fixed = dense * self.v[BUCKETS:, f]
            sums = np.bincount(owner, part, n) + fixed.sum(axis=1)
            out += 0.5 * (sums**2 - np.bincount(owner, part**2, n) - (fixed**2).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    rows = labelled_sample(docs.where(~held_out()), labels, "quality", TRAIN_DOCS, TRAIN_CHARS, "n_chars")
    return FactorisationMachine().fit([r["text"] for r in rows], [r["n_chars"] or 0 for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, labels: DataFrame | None = None, model: FactorisationMachine | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or (train(docs, labels) if labels is not None else FactorisationMachine()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            given = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False).astype(float)
            parts = [machine.scores(d, o, given[lo:hi]) for lo, hi, d, o in kernel.slices(batch.column(2))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, RESULT)
