"""Quality rules as learned decision lists, on DataFrame and SQL expressions only.

``statistics`` measures every whole text with built-in functions.  ``learn``
bins a bounded sample of labelled documents' statistics at quantiles, counts
good and bad documents in each cell of bins (one aggregate), and from these
counts alone grows rules by sequential covering: a rule is a conjunction of
thresholds, grown by FOIL's gain on one half of the sample and pruned on the
other; documents it covers are set aside and the next rule is grown.  The
ordered list becomes one Spark conditional expression.

A word is a run outside space and 0x09..0x0D.  Repeated words are those in a
window of ``WINDOW`` words found twice or more in the text; windows are
compared by 64-bit hashes within one text.

Defined cases: null and empty texts have no words and fail the base rule;
without labels the list is empty and the base rule alone decides; of
contradictory labels the smaller holds; a text is judged by itself, so
repeated rows, null or repeated doc_ids change nothing; extra columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
TRAIN_DOCS, TRAIN_CHARS = 6_000, 50_000
QUANTILES = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.88, 0.94, 0.97, 0.99)
MOST_RULES, MOST_CONDITIONS = 12, 4
LEAST_COVER, LEAST_PRECISION = 4, 0.9

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: What rules may test: ratios of the base statistics, capitals, exclamation marks and bars.
MEASURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
}

_SEPARATORS = r"[\\x20\\x09-\\x0D]+"

# Words are taken one by one: a slice would copy the whole array for each window.  transform over an array of one
# element binds its value to a name, so that it is made once, wherever the optimizer moves the expression.
_HASHES = f"transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({', '.join(f'get(w, i + {k})' for k in range(WINDOW))}))"
_REPEATED = f"""
transform(array(words), w -> CASE WHEN size(w) <= {WINDOW} THEN 0L ELSE transform(
  array({_HASHES}),
  h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE transform(
    array(array_sort(transform(h, (x, i) -> struct(x, i)))),
    s -> transform(
      array(array_sort(filter(transform(s, (e, k) -> CASE WHEN get(s, k - 1).x = e.x OR get(s, k + 1).x = e.x THEN e.i END), p -> p IS NOT NULL))),
      p -> aggregate(transform(p, (v, k) -> least({WINDOW}, coalesce(get(p, k + 1) - v, {WINDOW}))), 0L, (a, n) -> a + n)
    )[0])[0] END
)[0] END)[0]
"""


def statistics(docs: DataFrame, *also: str) -> DataFrame:
    """Per row: doc_id, ``also``, the base statistics, and counts of capitals, exclamation marks and bars."""
    text = docs.select("doc_id", *also, F.coalesce("text", F.lit("")).alias("text"))
    words = text.select(
        "doc_id",
        *also,
        F.expr(f"filter(split(text, '{_SEPARATORS}'), w -> w <> '')").alias("words"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr("regexp_count(text, '[A-Z]')").cast("long").alias("n_capitals"),
        F.expr("length(text) - length(replace(text, '!', ''))").cast("long").alias("n_shouts"),
        F.expr("length(text) - length(replace(text, '|', ''))").cast("long").alias("n_bars"),
        F.expr(r"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    counted = words.select("*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    return counted.select("doc_id", *also, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(_REPEATED).alias("n_repeat_words"), "n_capitals", "n_shouts", "n_bars")


@dataclass(frozen=True)
class Condition:
    """measure > threshold, or measure <= threshold."""

    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def sql_of(rules: list[Rule]) -> Column:
    """True where no rule of the ordered list rejects."""
    out = None
    for rule in rules:
        fires = F.lit(True)
        for c in rule:
            fires = fires & c.column()
        out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list for ``labels.quality`` from a bounded sample: each rule tells bad documents."""
    known = labels.where("quality is not null and doc_id is not null")
    scale = 1 << 30
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, TRAIN_DOCS / max(1, known.count())))
    chosen = known.where(keep).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select("doc_id", "text").where(keep & (F.length("text") <= TRAIN_CHARS)).join(F.broadcast(chosen), "doc_id")
    # so few rows would be one task's work
    spread = texts.select("doc_id", "text", "quality").repartition(texts.sparkSession.sparkContext.defaultParallelism, "doc_id")
    # cached before it is filtered: a filter would be pushed down with the whole of what it tests inside it
    cached = statistics(spread, "quality").cache()
    try:
        measured = cached.where(~base_failed()).select("doc_id", "quality", *(F.expr(e).cast("double").alias(m) for m, e in MEASURES.items()))
        row = measured.agg(*(F.percentile_approx(m, list(QUANTILES), 10_000).alias(m) for m in MEASURES)).first()
        marks = {m: _between(sorted(set(row[m] or []))) for m in MEASURES}
        bins = [sum((F.when(F.col(m) > F.lit(t), 1).otherwise(0) for t in ts), F.lit(0)).alias(m) for m, ts in marks.items()]
        half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0
        good = F.col("quality") > 0
        cells = measured.groupBy(*bins).agg(F.count_if(half & ~good).alias("grow_bad"), F.count_if(half & good).alias("grow_good"), F.count_if(~half & ~good).alias("prune_bad"), F.count_if(~half & good).alias("prune_good")).collect()
    finally:
        cached.unpersist()
    return cover([(tuple(r[m] for m in MEASURES), tuple(r[len(MEASURES) :])) for r in cells], [(m, marks[m]) for m in MEASURES])


def _between(values: list[float]) -> list[float]:
    """Thresholds halfway between neighbouring quantiles, not on the values themselves."""
    return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]


_Test = tuple[int, bool, int]
_Cells = list[tuple[tuple[int, ...], tuple[int, ...]]]


def _passes(bins: tuple[int, ...], tests: list[_Test]) -> bool:
    return all((bins[m] > j) == above for m, above, j in tests)


def _counts(cells: _Cells, tests: list[_Test], at: int) -> tuple[int, int]:
    hit = [c for b, c in cells if _passes(b, tests)]
    return sum(c[at] for c in hit), sum(c[at + 1] for c in hit)


def cover(cells: _Cells, marks: list[tuple[str, list[float]]]) -> list[Rule]:
    """Sequential covering over counted cells: (bins, (grow bad, grow good, prune bad, prune good))."""
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        tests: list[_Test] = []
        inside = [x for x in cells if x[1][0] or x[1][1]]
        bad, good = sum(c[0] for _, c in inside), sum(c[1] for _, c in inside)
        if bad < LEAST_COVER:
            break
        while good and len(tests) < MOST_CONDITIONS:
            best = (0.0, None, 0, 0)
            for m, (_, ts) in enumerate(marks):
                # counts by bin, so that every threshold of a measure costs one addition
                by_bin = [[0, 0] for _ in range(len(ts) + 1)]
                for b, c in inside:
                    by_bin[b[m]][0] += c[0]
                    by_bin[b[m]][1] += c[1]
                p_low = n_low = 0
                for j in range(len(ts)):
                    p_low, n_low = p_low + by_bin[j][0], n_low + by_bin[j][1]
                    for above, p, n in ((True, bad - p_low, good - n_low), (False, p_low, n_low)):
                        if p:
                            gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (m, above, j), p, n)
            if best[1] is None:
                break
            tests.append(best[1])
            inside = [x for x in inside if _passes(x[0], [best[1]])]
            bad, good = best[2], best[3]
        if not tests:
            break

        def worth(some: list[_Test]) -> float:
            p, n = _counts(cells, some, 2)
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(tests) + 1), key=lambda k: (worth(tests[:k]), -k))
        tests = tests[:keep]
        p, n = (sum(x) for x in zip(_counts(cells, tests, 0), _counts(cells, tests, 2), strict=True))
        if p < LEAST_COVER or p / (p + n) < LEAST_PRECISION:
            break
        rules.append(tuple(Condition(marks[m][0], above, marks[m][1][j]) for m, above, j in tests))
        cells = [x for x in cells if not _passes(x[0], tests)]
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed, kept."""
    if rules is None:
        rules = learn(docs, labels) if labels is not None else []
    measured = statistics(docs)
    return measured.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & sql_of(rules)).alias("kept"))
