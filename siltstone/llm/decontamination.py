"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

The index is over the benchmark's items (terms are runs of letters and digits,
lower-cased).  A term's impact on an item is its BM25 part divided by the
item's own score, so a passage that holds the whole item scores 1 and one
threshold serves all items.  Every passage of every document is a query of its
distinct terms.  A passage has ``PASSAGE`` words, one every ``STRIDE``, for items
of at most ``STRIDE`` terms; both are doubled until they hold a longer item, so a
whole copy at any offset lies in one passage:

1. An item's commonest terms, up to ``SPARE`` of its score, are set aside; to
   reach the threshold a passage must get the rest from the item's other terms,
   which are rare.  Their short postings are added up for a whole batch as
   arrays, and passages that can't reach the threshold with any item go.
2. The rest go through block-max WAND: postings are in blocks of ``BLOCK``
   with their largest impact; the pivot term by list maxima, then the pivot's
   blocks' maxima, decide whether an item is scored or a block is skipped.
   All items at or above the threshold are returned, none is cut.
3. A hit is verified on words: the shares of the item's question and of its
   answer (``ANSWER`` of its words, the last) whose word trigrams occur in the
   passage, in order, must both reach ``OVERLAP``, or ``WHOLE`` of all trigrams.

``THRESHOLD`` lies below what step 3 can accept: over the contiguous runs of a
test benchmark's items that pass step 3, the least score is 0.448.

The index is sent to executors in parts of at most ``ITEMS_PER_PART`` items and
about ``BYTES_PER_PART`` of text; frequencies and the mean length are those of the
whole benchmark, so hits don't depend on the parts.  Several parts are searched
one after another, each part's hits are written and its index is given up before
the next is made: a large benchmark costs passes, not memory.

Defined cases: null and empty texts hit nothing; items without terms are never
hit; repeated items are hit each; rows with a null doc_id report null; a row
and item are reported once, at their best passage (the first of equals), and
rows that share a doc_id report each; an empty table or benchmark gives an empty
result; extra columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import ship, written

PASSAGE, STRIDE = 128, 64
BLOCK = 16
K1, B = 1.2, 0.75
THRESHOLD, SPARE = 0.4, 0.2
GRAM = 3
ANSWER, OVERLAP, WHOLE = 1 / 3, 0.5, 0.6
ITEMS_PER_PART, BYTES_PER_PART = 50_000, 32 << 20

RESULT = "doc_id long, item_id long, passage int, score double, question_overlap double, answer_overlap double"

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed terms of some texts, and each text's first."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = kernel.lower_ascii(data)
    inside = _TERM[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[offsets < len(data)]
    begin[edges] = inside[edges]
    edges = edges[edges > 0] - 1
    end[edges] = inside[edges]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return kernel.word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


class Index:
    """BM25 postings of the items, by term, in item order, with block maxima.

    ``whole`` describes the benchmark that the items are a part of: the number of
    its items, their mean length, and the terms (sorted) with their frequencies.
    """

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        self.ids = [i for i, _ in items]
        terms, first = [], [0]
        for _, _, data, offsets in kernel.slices(pa.array([t for _, t in items], pa.string())):
            h, f = terms_of(data, offsets)
            terms.append(h)
            first += (f[1:] + first[-1]).tolist()
        flat = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
        self.items = [flat[a:b] for a, b in zip(first, first[1:], strict=False)]
        lengths = np.diff(first)
        # the stride of the passages that each item is sought in; items without terms are never sought
        self.strides = np.array([STRIDE << max(0, -(-n // STRIDE) - 1).bit_length() for n in lengths.tolist()], np.int64)
        self.vocabulary, place = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(self.items)), lengths)
        pairs, tf = np.unique(place.astype(np.int64) * max(1, len(self.items)) + owner, return_counts=True)
        term, item = np.divmod(pairs, max(1, len(self.items)))
        if whole is None:
            n_items, mean, df = len(self.items), lengths.mean() if len(lengths) else 1.0, np.bincount(term, minlength=len(self.vocabulary))
        else:
            n_items, mean, known, frequencies = whole
            df = frequencies[np.searchsorted(known, self.vocabulary)]
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        mean = max(1.0, mean)
        part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean)) if len(term) else np.zeros(0)
        own = np.bincount(item, part, len(self.items))
        impact = part / np.maximum(own, 1e-12)[item] if len(term) else part
        cut = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.most = np.maximum.reduceat(impact, cut[:-1]) if len(term) else np.zeros(0)
        # what each item's commonest terms are worth together, and the postings of its other terms
        order = np.lexsort((impact, item))
        ahead = np.cumsum(impact[order])
        begin = np.searchsorted(item[order], np.arange(len(self.items) + 1))
        base = np.concatenate([[0.0], ahead])[begin[:-1]]
        rare = np.ones(len(term), bool)
        rare[order] = ahead - base[item[order]] > SPARE
        self.spare = np.bincount(item[~rare], impact[~rare], len(self.items))
        self.rare_item, self.rare_impact = item[rare], impact[rare]
        self.rare_cut = np.searchsorted(term[rare], np.arange(len(self.vocabulary) + 1))
        self.postings, self.blocks = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            self.postings.append((item[a:b].tolist(), impact[a:b].tolist()))
            ends = [*range(a + BLOCK, b, BLOCK), b]
            self.blocks.append([(int(item[e - 1]), float(impact[s:e].max())) for s, e in zip([a, *ends], ends, strict=False)])
        cuts = [len(x) - max(1, round(ANSWER * len(x))) if len(x) > 1 else len(x) for x in self.items]
        self.grams = [self._grams(x, c) for x, c in zip(self.items, cuts, strict=True)]

    @staticmethod
    def _grams(x: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def of(y: np.ndarray) -> np.ndarray:
            return np.unique(kernel.window_hashes(y, min(GRAM, len(y)))) if len(y) else np.zeros(0, np.uint64)

        return of(x[:cut]), of(x[cut:]), of(x)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose score for these distinct terms reaches the threshold, by block-max WAND."""
        lists = [[self.postings[t][0], self.postings[t][1], 0, float(self.most[t]), self.blocks[t], 0] for t in terms]
        lists = [x for x in lists if x[0]]
        slack = threshold - 1e-9
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[3]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][2]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == item:
                pivot += 1
            bound, edge = 0.0, None
            for x in lists[: pivot + 1]:
                while x[4][x[5]][0] < item and x[5] + 1 < len(x[4]):
                    x[5] += 1
                last, most = x[4][x[5]]
                if last >= item:
                    bound += most
                    edge = last if edge is None else min(edge, last)
            if bound >= slack:
                if lists[0][0][lists[0][2]] == item:
                    score = sum(x[1][x[2]] for x in lists[: pivot + 1])
                    if score >= slack:
                        out.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                # nothing up to the nearest block end, or before the next list's item, can reach it
                target = (edge if edge is not None else item) + 1
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0][lists[pivot + 1][2]])
                target = max(target, item + 1)
            for x in lists[: pivot + 1]:
                x[2] = bisect_left(x[0], target, x[2])
            lists = [x for x in lists if x[2] < len(x[0])]
        return out

    def reachable(self, passage: np.ndarray, term: np.ndarray, stride: int) -> list[int]:
        """The passages that can reach the threshold with some item of this stride."""
        of_stride = self.strides == stride
        n = self.rare_cut[term + 1] - self.rare_cut[term]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return np.unique(passage).tolist() if (self.spare[of_stride] >= THRESHOLD).any() else []
        at = np.repeat(self.rare_cut[term] - (ends - n), n) + np.arange(ends[-1])
        pairs = np.repeat(passage, n) * len(self.items) + self.rare_item[at]
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        head = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        sums = np.add.reduceat(self.rare_impact[at][order], head)
        where, item = np.divmod(pairs[head], len(self.items))
        return np.unique(where[of_stride[item] & (sums + self.spare[item] >= THRESHOLD - 1e-9)]).tolist()

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float, float]:
        """Which shares of the question's, the answer's and all trigrams occur among the words."""
        # every gram is compared with the passage's in order, so both sides are sorted once
        have = np.sort(kernel.window_hashes(words, min(GRAM, max(1, len(self.items[item])))))
        out = []
        for grams in self.grams[item]:
            place = np.minimum(np.searchsorted(have, grams), len(have) - 1)
            out.append(float((have[place] == grams).mean()) if len(grams) and len(have) else float(not len(grams)))
        return out[0], out[1], out[2]

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(row, item, passage's first word, score, question overlap, answer overlap) of each leak."""
        if not len(self.vocabulary):
            return
        for lo, _, data, offsets in kernel.slices(column):
            words, first = terms_of(data, offsets)
            if not len(words):
                continue
            place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
            at = np.flatnonzero(self.vocabulary[place] == words)
            doc = np.searchsorted(first, at, "right") - 1
            width = len(self.vocabulary)
            best: dict[tuple[int, int], tuple[float, int, float, float]] = {}
            for stride in np.unique(self.strides).tolist():
                cell = (at - first[doc]) // stride
                base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // stride))])
                cell = cell + base[doc]
                # a passage is PASSAGE // STRIDE cells, so a word is in as many passages
                keys = [(cell - k)[ok] * width + place[at][ok] for k in range(PASSAGE // STRIDE) for ok in [cell - k >= base[doc]]]
                passage, term = np.divmod(np.unique(np.concatenate(keys)), width)
                for p in self.reachable(passage, term, stride):
                    a, b = np.searchsorted(passage, [p, p + 1])
                    found = [x for x in self.search(term[a:b].tolist(), THRESHOLD) if self.strides[x[0]] == stride]
                    if not found:
                        continue
                    row = int(np.searchsorted(base, p, "right") - 1)
                    start = int((p - base[row]) * stride)
                    text = words[first[row] + start : min(first[row + 1], first[row] + start + stride * (PASSAGE // STRIDE))]
                    for item, score in found:
                        question, answer, whole = self.overlaps(item, text)
                        if (question >= OVERLAP and answer >= OVERLAP) or whole >= WHOLE:
                            old = best.get((row, item))
                            if old is None or score > old[0]:
                                best[row, item] = (score, start, question, answer)
            for (row, item), (score, start, question, answer) in sorted(best.items()):
                yield lo + row, item, start, score, question, answer


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text): how many terms, and the distinct ones."""
    for batch in batches:
        sizes, terms = [], []
        for _, _, data, offsets in kernel.slices(batch.column(0)):
            found, first = terms_of(data, offsets)
            sizes += np.diff(first).tolist()
            terms += [np.unique(found[a:b]).view(np.int64) for a, b in zip(first, first[1:], strict=False)]
        flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), kernel.list_array(flat, np.array([len(t) for t in terms], np.int64))], names=["n", "terms"])


def _parts(benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark's parts, one after another, as broadcast indexes; and whether there are several."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // ITEMS_PER_PART), -(-size // BYTES_PER_PART))
    if parts <= 1:
        if n:
            yield context.broadcast(Index(sorted((r["item_id"], r["text"]) for r in items.collect()))), False
        return
    of_part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    terms = written(items.select("text").mapInArrow(_distinct_terms, "n long, terms array<long>"), "terms")
    mean = terms.agg(F.sum("n")).first()[0] / n
    df = written(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    for k in range(parts):
        own = items.where(of_part == k)
        used = own.select("text").mapInArrow(_distinct_terms, "n long, terms array<long>").select(F.explode("terms").alias("term")).distinct()
        # one part's vocabulary, so bounded as the part is
        rows = df.join(used.hint("merge"), "term").collect()
        known, frequencies = np.array([r["term"] for r in rows], np.int64).view(np.uint64), np.array([r["df"] for r in rows], np.int64)
        order = np.argsort(known)
        yield context.broadcast(Index(sorted((r["item_id"], r["text"]) for r in own.collect()), (n, mean, known[order], frequencies[order]))), True


def _search(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = list(index.hits(batch.column(1)))
            rows, items, starts, *shares = zip(*found, strict=True) if found else ((), (), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([index.ids[i] for i in items], pa.int64()), pa.array(starts, pa.int32()), *(pa.array(x, pa.float64()) for x in shares)],
                names=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"],
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and leaked item: doc_id, item_id, passage, score, question_overlap, answer_overlap."""
    ship(docs.sparkSession)
    found = None
    for shared, several in _parts(benchmark):
        hits = docs.select("doc_id", "text").mapInArrow(_search(shared), RESULT)
        if several:
            hits = written(hits, "leaks")
            shared.destroy()
        found = hits if found is None else found.union(hits)
    return docs.sparkSession.createDataFrame([], RESULT) if found is None else found


def _without(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[h[0] for h in index.hits(batch.column(batch.schema.get_field_index("text")))]] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    ship(docs.sparkSession)
    for shared, several in _parts(benchmark):
        docs = docs.mapInArrow(_without(shared), docs.schema)
        if several:
            docs = written(docs, "clean")
            shared.destroy()
    return docs
