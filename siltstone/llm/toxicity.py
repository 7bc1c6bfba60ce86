"""Toxicity by a weighted lexicon and Aho-Corasick matching of folded words.

Words are folded first: compatibility forms and look-alike letters of other
scripts become Latin letters, lower case; digits and signs inside a word that
stand for letters become them ("1d10t"); signs around a word go.

The lexicon has stems (a word that begins so) with weights.  It starts from a
short fixed list and is learned from labelled text: stems whose documents are
toxic far more often than others (a likelihood ratio of at least ``LEAST_RATIO``
in nats), greedily chosen so that each next stem adds toxic documents that the
earlier ones miss.  A logistic regression on the stems' counts, normalised by
the text's length (``strength``), gives the weights, which are never negative;
its probability is the score, shifted so that THRESHOLD separates the training
texts best.  Phrases (a match and a neighbour) that occur in clean documents
alone become exceptions, as are a few fixed ones; a match inside an exception
phrase doesn't count.

One Aho-Corasick automaton holds the stems, another the exceptions.  The first
runs over each distinct word of a batch once, the second over the words around
each match.

Training is bounded: about ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_CHARS`` characters, by a hash of doc_id, outside the held-out fold.

Defined cases: null and empty texts score as texts without a match; without labels only the fixed list
counts; a null doc_id is not held out and is not learned from; of contradictory
labels the larger holds; repeated rows are scored each; extra columns are
ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import labelled_sample, ship

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
TRAIN_DOCS, TRAIN_CHARS = 6_000, 50_000
STEM_FROM, STEM_TO = 4, 10
LEAST_ODDS, LEAST_RATIO, MOST_STEMS = 1.5, 10.0, 400
STEPS, RIDGE = 600, 2e-3
NORM_WORDS = 500.0
CONTEXT = 2

RESULT = "doc_id long, held_out boolean, score double, predicted int"

# Common English insults; one of them alone makes a text toxic until labels say otherwise.
SEED_STEMS = ("asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumbass", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
SEED_WEIGHT, BIAS = 8.0, -4.0
# Phrases in which such a word insults nobody.
SEED_EXCEPTIONS = ("circus clown", "class clown", "clown fish", "fool proof", "graceful loser", "jerk chicken", "trash bag", "trash bin", "trash can")
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

_GLYPHS, _DIGITS = str.maketrans(HOMOGLYPHS), str.maketrans(SUBSTITUTES)


def fold(word: str) -> str:
    """A word as the lexicon sees it."""
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word).lower().translate(_GLYPHS)
    else:
        word = word.lower()
    a, b = 0, len(word)
    while b > a and not word[b - 1].isalnum():
        b -= 1
    while a < b and not word[a].isalnum() and not (word[a] in "@$" and a + 1 < b and word[a + 1].isalpha()):
        a += 1
    word = word[a:b]
    if word.isalpha() or not any(c.isalpha() for c in word):
        return word
    return "".join(c for c in word.translate(_DIGITS) if c.isalpha())


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _automaton(entries: Iterable[tuple[str, object]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for key, value in entries:
        out.add_word(key, value)
    out.make_automaton()
    return out


class Lexicon:
    """Weighted stems and exception phrases; picklable, builds its automata on first use."""

    def __init__(self, stems: dict[str, float], exceptions: Iterable[str] = (), bias: float = BIAS):
        self.stems, self.exceptions, self.bias = dict(stems), sorted(set(exceptions)), bias
        self._made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    @property
    def automata(self):
        if self._made is None:
            self._made = tuple(_automaton(x) for x in ([(" " + s, s) for s in self.stems], [(f" {e} ", e) for e in self.exceptions]))
        return self._made

    def match(self, folded: str) -> str:
        """The heaviest stem that the word begins with, or nothing."""
        stems = self.automata[0]
        return max((s for _, s in stems.iter(" " + folded)), key=lambda s: (self.stems[s], s), default="") if len(stems) else ""

    def excused(self, around: list[str], at: int) -> bool:
        """Whether the word at ``at`` stands in an exception phrase."""
        phrases = self.automata[1]
        if not len(phrases):
            return False
        text = " " + " ".join(around) + " "
        begin = 1 + sum(len(w) + 1 for w in around[:at])
        return any(end - len(p) - 1 < begin + len(around[at]) and end > begin and end - len(p) <= begin for end, p in phrases.iter(text))

    def matches(self, column: pa.Array) -> Iterator[tuple[dict[str, int], int]]:
        """Of each text: how often each stem matches outside exceptions, and the number of words."""
        for lo, hi, data, offsets in kernel.slices(column):
            words, first = whole_words(data, offsets)
            found: list[dict[str, int]] = [{} for _ in range(hi - lo)]
            if len(words):
                coded = pc.dictionary_encode(words)
                distinct, place = [fold(w) for w in coded.dictionary.to_pylist()], coded.indices.to_numpy()
                stem = [self.match(w) for w in distinct]
                hits = np.flatnonzero(np.array([bool(s) for s in stem])[place])
                for h, doc in zip(hits.tolist(), (np.searchsorted(first, hits, "right") - 1).tolist(), strict=True):
                    a, b = max(int(first[doc]), h - CONTEXT), min(int(first[doc + 1]), h + CONTEXT + 1)
                    if not self.excused([distinct[place[k]] for k in range(a, b)], h - a):
                        s = stem[place[h]]
                        found[doc][s] = found[doc].get(s, 0) + 1
            yield from zip(found, np.diff(first).tolist(), strict=True)

    def scores(self, column: pa.Array) -> list[float]:
        out = []
        for found, n_words in self.matches(column):
            margin = self.bias + sum(self.stems[s] * strength(c, n_words) for s, c in found.items())
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))))
        return out


def strength(count: int, n_words: int) -> float:
    """A stem's matches in a text of ``n_words``: grows with each match and falls with the words per match.

    Of texts with as many words per match the longer one is never the weaker, whatever its length.
    """
    return 2 * count / (1 + count) / (1.0 + math.log1p(n_words / (NORM_WORDS * count)))


def whole_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words as one Arrow array, and each text's first."""
    starts, ends, first = kernel.word_spans(data, offsets)
    flat = data[~kernel.IS_SEP[data]]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(flat)), first


def learn(texts: list[str], toxic: list[int]) -> Lexicon:
    """Stems, weights and exceptions from labelled texts (each distinct text counts once)."""
    once = {t: int(x) for t, x in zip(texts, toxic, strict=True)}
    texts, flag = list(once), np.array(list(once.values()), bool)
    if not flag.any() or flag.all():
        return Lexicon(dict.fromkeys(SEED_STEMS, SEED_WEIGHT), SEED_EXCEPTIONS)
    folded: dict[str, str] = {}
    docs = [[folded[w] if w in folded else folded.setdefault(w, fold(w)) for w in t.split()] for t in texts]
    n_toxic, n_clean = int(flag.sum()), int((~flag).sum())
    seen: dict[str, list[int]] = {}
    clean: Counter[str] = Counter()
    for i, words in enumerate(docs):
        stems = {w[:k] for w in set(words) if w.isalpha() for k in range(STEM_FROM, min(len(w), STEM_TO) + 1)}
        if flag[i]:
            for s in stems:
                seen.setdefault(s, []).append(i)
        else:
            clean.update(stems)

    def evidence(s: str) -> tuple[float, float]:
        """Log odds of toxic documents, and the likelihood ratio to the base rate."""
        k, c, base = len(seen[s]), clean[s], n_toxic / (n_toxic + n_clean)
        p = k / (k + c)
        ratio = k * math.log(p / base) + (c * math.log((1 - p) / (1 - base)) if c else 0.0)
        return math.log((k + 0.1) / n_toxic) - math.log((c + 0.1) / n_clean), ratio if p > base else 0.0

    stems = [s for s in SEED_STEMS if clean[s] <= len(seen.get(s, ()))]
    covered = {i for s in stems for i in seen.get(s, ())}
    known = {s: evidence(s) for s, d in seen.items() if len(d) >= 3}
    strong = {s: set(seen[s]) for s, (odds, ratio) in known.items() if odds > LEAST_ODDS and ratio > LEAST_RATIO}
    while strong and len(stems) < MOST_STEMS:
        # the stem that adds most evidence; of equal ones the shortest stands for all
        best = max(strong, key=lambda s: (len(strong[s] - covered) * known[s][0], -len(s), s))
        if len(strong[best] - covered) < 2:
            break
        stems.append(best)
        covered |= strong.pop(best)
        strong = {s: d for s, d in strong.items() if len(d - covered) >= 2}

    column = pa.array(texts, pa.string())
    lexicon = Lexicon(dict.fromkeys(stems, 1.0))
    around: dict[str, list[int]] = {}
    matched = {w for w in folded.values() if lexicon.match(w)}
    for i, words in enumerate(docs):
        for k, w in enumerate(words):
            if w in matched:
                for a, b in ((k - 1, k + 1), (k, k + 2)):
                    if 0 <= a and b <= len(words):
                        around.setdefault(" ".join(words[a:b]), [0, 0])[int(flag[i])] += 1
    lexicon = Lexicon(lexicon.stems, [*SEED_EXCEPTIONS, *(p for p, (c, t) in around.items() if c >= 3 and t == 0)])

    place = {s: j for j, s in enumerate(stems)}
    x = np.zeros((len(texts), len(stems)))
    for i, (found, n_words) in enumerate(lexicon.matches(column)):
        for s, c in found.items():
            x[i, place[s]] = strength(c, n_words)
    weights, bias = _regression(x, flag.astype(float), np.array([SEED_WEIGHT if s in SEED_STEMS else 1.0 for s in stems]))
    return Lexicon(dict(zip(stems, weights.tolist(), strict=True)), lexicon.exceptions, bias)


def _regression(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with weights of at least 0, drawn towards ``start``; the bias puts the best cut at THRESHOLD."""
    w, b = start.copy(), BIAS
    mw, mb, vw, vb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        gw, gb = x.T @ (p - y) / len(y) + RIDGE * 0.1 * (w - start) / len(start), float((p - y).mean())
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        scale = math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = np.maximum(0.0, w - 0.1 * scale * mw / (np.sqrt(vw) + 1e-8))
        b -= 0.1 * scale * mb / (math.sqrt(vb) + 1e-8)
    margin = x @ w + b
    values = np.unique(margin)
    toxic, clean = np.sort(margin[y > 0]), np.sort(margin[y == 0])
    wrong = np.searchsorted(toxic, values, "left") + len(clean) - np.searchsorted(clean, values, "left")
    k = int(np.argmin(wrong))
    cut = (values[k - 1] + values[k]) / 2 if k else values[k]
    return w, float(b - cut + math.log(THRESHOLD / (1 - THRESHOLD)))


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    rows = labelled_sample(docs.where(~held_out()), labels, "toxic", TRAIN_DOCS, TRAIN_CHARS)
    return learn([r["text"] for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, labels: DataFrame | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon or (train(docs, labels) if labels is not None else learn([], [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = known.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, RESULT)
