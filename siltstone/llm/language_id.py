"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text: it accepts exactly the
strings that occur there.  A text is parsed greedily into the longest matches
the automaton allows; the fewer phrases a language's automaton needs, the less
new information the text holds given that language.  Phrases are counted per
byte of letters ("normalised"), and the language with the fewest wins; the
score is one minus its count over the runner-up's.

What is parsed is a text's letter stream: its runs of letters, lower-cased, each
with one space before it; phrases cross words.  To parse as arrays, a stream is
cut into lanes of ``LANE`` bytes which are parsed in step, each from its own first
byte.  The parse of the whole stream is then stitched from lane to lane: where it
enters a lane at a byte at which the lane's own parse begins a phrase, both are
one from there on, and until then it goes on phrase by phrase.

Training is bounded: at most about ``TRAIN_DOCS`` documents and ``TRAIN_BYTES``
bytes a language, picked by a hash of doc_id among documents of at most
``TRAIN_CHARS`` characters outside the held-out fold.

Defined cases: null text and text without a letter give ``und`` and score 0; if
nothing was learned every text is ``und``; one learned language scores 1; ties
go to the first language by code point; a null doc_id is not held out and is
not learned from; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import ship

FOLDS, HELD_OUT = 3, 1
TRAIN_DOCS, TRAIN_BYTES, TRAIN_CHARS = 120, 48_000, 100_000
MOST_LANGUAGES = 500
LANE = 512

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"

_BEGINS, _ROW = -(1 << 31), (1 << 31) - 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and the Latin-1 letters of UTF-8 in lower case."""
    out = kernel.lower_ascii(data)
    up = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1 if len(out) else []
    out[up] += 0x20
    return out


def letter_streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letter streams of some texts, and where each begins."""
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    # a separator before each text lets its first run have its space
    spaced = np.insert(_lower(data), offsets[:-1], 0x20)
    inside = _LETTER[spaced]
    begins = np.zeros(len(spaced), bool)
    begins[:-1] = ~inside[:-1] & inside[1:]
    spaced[begins] = 0x20
    keep = inside | begins
    return spaced[keep], np.concatenate([[0], np.cumsum(keep)])[offsets + np.arange(len(offsets))]


class Automaton:
    """A suffix automaton as one table: the row of the state after a state and a byte."""

    def __init__(self, text: bytes):
        step: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        # an arc is its target's row; where there is none, a phrase begins and the root's arc is taken: the sign says so
        used = sorted(set(text))
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        self.table = np.tile(np.zeros(width, np.int32), len(step))
        for c, t in step[0].items():
            self.table[int(self.symbol[c]) :: width] = t * width
        self.table |= _BEGINS
        for s in range(1, len(step)):
            for c, t in step[s].items():
                self.table[s * width + int(self.symbol[c])] = t * width

    def phrases(self, streams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each stream's greedy parse."""
        symbols = self.symbol[streams]
        sizes = np.diff(offsets)
        lanes = -(-sizes // LANE)
        stream = np.repeat(np.arange(len(sizes)), lanes)
        first = np.cumsum(lanes) - lanes
        begin = offsets[stream] + (np.arange(len(stream)) - first[stream]) * LANE
        end = np.minimum(begin + LANE, offsets[stream + 1])
        marks, exits = self._lanes(symbols, begin, end, offsets[stream + 1])
        ahead = np.concatenate([[0], np.cumsum(marks)])
        out = ahead[offsets[1:]] - ahead[offsets[:-1]]
        table, letters = memoryview(self.table), memoryview(symbols)
        for i in np.flatnonzero(lanes > 1).tolist():
            at, stop, base, n = int(offsets[i]), int(offsets[i + 1]), int(offsets[i]), 0
            while at < stop:
                if marks[at]:
                    lane = first[i] + (at - base) // LANE
                    n += int(ahead[end[lane]] - ahead[at])
                    at = int(exits[lane])
                else:
                    n += 1
                    state = table[letters[at]] & _ROW
                    at += 1
                    while at < stop and (state := table[state + letters[at]]) >= 0:
                        at += 1
            out[i] = n
        return out

    def _lanes(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's own parse begins phrases, and where its first phrase beyond its end begins."""
        exits, length = stop.copy(), end - begin
        if not len(length):
            return np.zeros(0, bool), exits
        # lanes in order of length, longest first, a column each: those that still run are the first ones
        order = np.argsort(-length, kind="stable")
        inside = np.arange(int(length.max()))[None, :] < length[:, None]
        columns = np.zeros(inside.shape, np.uint8)
        columns[inside] = symbols
        columns = np.ascontiguousarray(columns[order].T)
        starts = np.zeros(columns.shape, bool)
        state = np.zeros(len(length), np.int32)
        running = np.searchsorted(-length[order], -np.arange(len(columns)), "left")
        for k, n in enumerate(running.tolist()):
            here = self.table[state[:n] + columns[k, :n]]
            starts[k, :n] = here < 0
            state[:n] = here & _ROW
        marks = np.empty(inside.shape, bool)
        marks[order] = starts.T
        # lanes that another follows go on until their last phrase ends
        live = order[end[order] < stop[order]]
        at, state = end[live], state[end[order] < stop[order]]
        while len(live):
            here = self.table[state + symbols[at]]
            on = here >= 0
            exits[live[~on]] = at[~on]
            at += 1
            on &= at < stop[live]
            live, at, state = live[on], at[on], here[on]
        return marks[inside], exits


class LanguageModel:
    def __init__(self, texts: dict[str, list[str]], limit: int = TRAIN_BYTES):
        self.languages = sorted(texts)
        self.automata = []
        for lang in self.languages:
            parts, size = [], 0
            for t in texts[lang]:
                raw = t.encode()
                parts.append(letter_streams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes())
                size += len(parts[-1])
                if size >= limit:
                    break
            self.automata.append(Automaton(b"".join(parts)[:limit]))

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for lo, hi, data, offsets in kernel.slices(column):
            streams, first = letter_streams(data, offsets)
            sizes = np.diff(first)
            each = [a.phrases(streams, first) for a in self.automata]
            for i in range(hi - lo):
                if not each or not sizes[i] or not _has_letter(data[offsets[i] : offsets[i + 1]]):
                    names.append("und")
                    scores.append(0.0)
                    continue
                need = np.array([x[i] for x in each]) / sizes[i]
                order = np.argsort(need, kind="stable")
                names.append(self.languages[order[0]])
                scores.append(float(1 - need[order[0]] / need[order[1]]) if len(order) > 1 else 1.0)
        return names, scores


def _has_letter(data: np.ndarray) -> bool:
    if (_LETTER[data] & (data < 128)).any():
        return True
    return any(ch.isalpha() for ch in data.tobytes().decode())


def train(docs: DataFrame) -> LanguageModel:
    """Learns from a bounded sample of documents outside the held-out fold."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    wanted = None
    scale = 1 << 30
    for r in counts:
        this = (F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, TRAIN_DOCS / r["n"])))
        wanted = this if wanted is None else wanted | this
    if wanted is None:
        return LanguageModel({})
    rows = known.where(wanted & (F.length("text") <= TRAIN_CHARS)).select("lang", "text", F.xxhash64("doc_id").alias("at"), "doc_id").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["doc_id"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return LanguageModel({k: v for k, v in texts.items() if any(ch.isalpha() for t in v for ch in t)})


def _predict(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            names, scores = model.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(shared), RESULT)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(docs))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, _ = model.predict(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([n != "und" for n in names], pa.bool_()))

    return docs.mapInArrow(run, schema)
