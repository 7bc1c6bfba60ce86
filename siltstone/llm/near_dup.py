"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

1. A document's set is its distinct ``SHINGLE``-word shingles (ASCII
   lower-cased words), as 64-bit hashes.  One permutation: the hash's high
   part picks one of ``BINS`` bins, the least hash in a bin is its value; an
   empty bin borrows from the bin that a universal hash of (bin, attempt)
   finds first (optimal densification).
2. Documents with equal sets collapse to one representative.
3. ``ROWS`` values form a band, a band's hash is a bucket.  In every bucket all
   members are tested against one hub, the one whose buckets are largest
   together (the least edited copy of a group), so a bucket of m costs m - 1
   pairs.  Buckets of true copies are one component by then and cost no more.
   Links that the hub hides are sought in the buckets whose members still lie in
   several components: there every two members of two components are compared
   by signature, as arrays in one task, in the first bucket they share.  Members
   with a candidate meet again with their texts, and a task gives only links
   that join components it hasn't joined yet: what becomes rows grows with the
   members of buckets, not with their pairs.  A bucket of more than ``BLOCK``
   members or ``BLOCK_SHINGLES`` is dealt by classes of set size (similar sets lie
   in the same class or in neighbours) and these in blocks, every two of which
   meet in one cell, so a task holds two blocks at most.
4. Candidates whose signatures agree in too few bins for the threshold go; the
   others are confirmed on the full sets of the whole texts.
5. Linked representatives are joined to components by alternating
   large-star and small-star steps on tables; nothing is collected.

At similarity 0.75 a pair shares no bucket with probability (1 - 0.75**4)**40,
about 2.5e-7.  A bin agrees with the similarity's probability: a filled bin by
its least hash, an empty one by the filled bin that its own probes find.  Even if
only ``INDEPENDENT`` of the bins told independently (the filled ones of a set as
large as the bins), a pair at the threshold would fall ``SIGMAS`` standard
deviations short with a probability of about 1e-6.

Defined cases: null and empty texts have an empty set, are linked with nothing
and kept; texts of fewer than five words are one shingle; rows that share a
doc_id count as one document; rows with a null doc_id are linked with nothing
(their component is null, they are kept); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import ship, written

SHINGLE = 5
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
THRESHOLD_PERCENT = 75
BLOCK, BLOCK_SHINGLES = 1024, 500_000
SIGMAS, INDEPENDENT = 5.0, 100
#: Agreeing bins below which a pair is no candidate.
LEAST_BINS = int(np.ceil(BINS * (THRESHOLD_PERCENT / 100 - SIGMAS * np.sqrt(THRESHOLD_PERCENT * (100 - THRESHOLD_PERCENT)) / 100 / np.sqrt(INDEPENDENT))))
_PROBES = 64
_PAIRS = 8192

_SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = kernel.lower_ascii(data)
    starts, ends, first = kernel.word_spans(data, offsets)
    words = kernel.word_hashes(data, starts, ends)
    windows = kernel.window_hashes(words, SHINGLE)
    short = {n: kernel.window_hashes(words, n) for n in range(1, SHINGLE)}
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            x = np.sort(windows[a : b - SHINGLE + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            yield short[b - a][a : a + 1]
        else:
            yield words[:0]


def _probe_block(block: int) -> np.ndarray:
    number = np.arange(BINS * _PROBES, dtype=np.uint64) + np.uint64(block * BINS * _PROBES + 1)
    return (kernel.mix64(number * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, _PROBES)


def densified(values: np.ndarray, filled: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """Every empty bin takes the value of the first filled bin on its own probe sequence."""
    empty = np.flatnonzero(~filled)
    turn = 0
    while len(empty):
        if turn == len(blocks):
            blocks.append(_probe_block(turn))
        hits = filled[blocks[turn][empty]]
        found = hits.any(axis=1)
        done = empty[found]
        values[done] = values[blocks[turn][done, hits[found].argmax(axis=1)]]
        empty = empty[~found]
        turn += 1
    return values


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = [_probe_block(0)]
    for batch in batches:
        sizes, digests, bands, n_bands = [], [], [], []
        for _, _, data, offsets in kernel.slices(batch.column(1)):
            for x in shingle_sets(data, offsets):
                sizes.append(len(x))
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                n_bands.append(BANDS if len(x) else 0)
                if len(x):
                    bins = ((x >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
                    head = np.concatenate([[True], bins[1:] != bins[:-1]])
                    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
                    values[bins[head]], filled[bins[head]] = x[head], True
                    # the low 16 bits of ROWS values are one band of 64 bits
                    bands.append(densified(values, filled, blocks).astype(np.uint16).view(np.int64))
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), kernel.list_array(flat, np.array(n_bands, np.int64))], names=["doc_id", "n_shingles", "digest", "bands"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= THRESHOLD_PERCENT * (len(both) - shared)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text of a, text of b): the pairs whose sets are similar enough.

    Rows come in order of a, so the text of a hub is hashed once.
    """
    body, first = None, None
    for batch in batches:
        ids, linked = batch.column(0), []
        others = (x for _, _, d, o in kernel.slices(batch.column(3)) for x in shingle_sets(d, o))
        for i, y in enumerate(others):
            now = batch.column(2)[i].as_buffer()
            if body is None or not now.equals(body):
                [(_, _, data, offsets)] = kernel.slices(batch.column(2).slice(i, 1))
                body, first = now, next(shingle_sets(data, offsets))
            linked.append(_similar(first, y))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([ids.filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _bins(bands: pa.ListArray) -> np.ndarray:
    return bands.flatten().to_numpy().view(np.uint16).reshape(-1, BINS)


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, signatures): the pairs whose signatures allow the threshold."""
    for batch in batches:
        left, right = (_bins(batch.column(c)) for c in ("bands_a", "bands_b"))
        keep = pa.array(np.count_nonzero(left == right, axis=1) >= LEAST_BINS)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


class _Cell:
    """The members of two blocks of a bucket (or of one), as arrays."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.component, self.n, self.block, self.lower = (table.column(c).to_numpy() for c in ("component", "n", "block", "lower"))
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.bins, self.band = self.bands.view(np.uint16), table.column("band")[0].as_py()

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The members that sizes and signatures allow to be similar: of two components, two blocks (if there are two) and not both of the lower class."""
        size, single = len(self.n), self.block.min() == self.block.max()
        y = np.arange(size)[None, :]
        step = max(1, (1 << 18) // size)
        for i in range(0, size, step):
            x = np.arange(i, min(size, i + step))[:, None]
            ok = (x < y) if single else (self.block[x] < self.block[y])
            ok &= (self.component[x] != self.component[y]) & ~(self.lower[x] & self.lower[y])
            ok &= np.minimum(self.n[x], self.n[y]) * 100 >= np.maximum(self.n[x], self.n[y]) * THRESHOLD_PERCENT
            p, q = np.nonzero(ok)
            p += i
            for k in range(0, len(p), _PAIRS):
                a, b = p[k : k + _PAIRS], q[k : k + _PAIRS]
                good = np.count_nonzero(self.bins[a] == self.bins[b], axis=1) >= LEAST_BINS
                a, b = a[good], b[good]
                first = (self.bands[a] == self.bands[b]).argmax(axis=1) == self.band
                if first.any():
                    yield a[first], b[first]

    def promising(self) -> Iterator[pa.Table]:
        """The members with a candidate."""
        some = np.zeros(len(self.n), bool)
        for a, b in self.pairs():
            some[a] = some[b] = True
        if some.any():
            yield self.table.filter(pa.array(some))

    def links(self) -> Iterator[pa.Table]:
        """Links that join all components of the cell that any link joins."""
        rep = self.table.column("rep").to_numpy()
        sets = [x for _, _, d, o in kernel.slices(self.table.column("text")) for x in shingle_sets(d, o)]
        joined = {c: c for c in self.component.tolist()}

        def root(c: int) -> int:
            while joined[c] != c:
                joined[c] = c = joined[joined[c]]
            return c

        out = []
        for a, b in self.pairs():
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = root(int(self.component[i])), root(int(self.component[j]))
                if x != y and _similar(sets[i], sets[j]):
                    joined[x] = y
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_cells(of_cell):
    """Applies ``of_cell`` to every cell of rows that come in order of cells, whatever the batches."""

    def ended(rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in of_cell(_Cell(pa.Table.from_batches(rest).combine_chunks())):
            yield from found.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            begin = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()] if len(cell) else []
            for i, j in zip(begin, [*begin[1:], len(cell)], strict=False):
                if rest and cell[i] != now:
                    yield from ended(rest)
                    rest = []
                now = cell[i]
                rest.append(batch.slice(i, j - i))
        if rest:
            yield from ended(rest)

    return run


def confirmed(edges: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate edges (a, b) that are links: by signature first, then on whole texts."""
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bands").alias("bands_b"))
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("bands").alias("bands_a"))
    # these sides grow with the corpus: no side is ever broadcast, however small it looks
    signed = edges.hint("merge").join(b, "b").hint("merge").join(a, "a").where(_size_ok("n_a", "n_b"))
    good = written(signed.select("a", "b", "bands_a", "bands_b").mapInArrow(_promising, "a long, b long"), "promising")
    # both sides of each join are shuffled for it alone, so that Spark can split the rows of a text in many pairs
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    pairs = good.hint("merge").join(b, "b").hint("merge").join(a, "a").select("a", "b", "text_a", "text_b")
    return pairs.mapInArrow(_confirm, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # equal counts and sums of hashes: the edges are the same set as before
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour is tied to the least node around
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = written(small, "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    table = written(docs.select("doc_id", "text").mapInArrow(_signatures, _SIGNATURE), "signatures")
    sets = table.where("n_shingles > 0 and doc_id is not null")
    reps = written(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "representatives")
    members = reps.select("rep", F.posexplode("bands").alias("band", "values")).select("rep", F.col("band").cast("byte").alias("band"), F.xxhash64("band", "values").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    inside = written(members.join(shared.hint("merge"), "bucket"), "buckets")
    central = inside.groupBy("rep").agg(F.sum("size").alias("centre"))
    wanted = docs.where("doc_id is not null").select("doc_id", "text").join(central.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    # a row that is repeated counts once
    texts = written(wanted.groupBy("doc_id", F.xxhash64("text").alias("which")).agg(F.first("text").alias("text")).drop("which"), "texts")

    found = components(confirmed(_star(inside, central), reps, texts))
    links = written(_hidden(inside, found, reps, texts), "links")
    if not links.isEmpty():
        found = components(links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    labelled = reps.select("digest", "rep").join(found.hint("merge"), reps.rep == found.node, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # documents without a set meet nothing: a key of their own each keeps them apart
    keyed = table.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).otherwise(F.unhex(F.hex("doc_id"))).alias("digest"))
    return (
        keyed.join(labelled.hint("merge"), "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def _star(inside: DataFrame, central: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket's members with its hub; the hub is a."""
    placed = inside.join(central.hint("merge"), "rep").select("bucket", "rep", F.struct("centre", (-F.col("rep")).alias("hub")).alias("rank"))
    placed = written(placed, "members")
    hubs = placed.groupBy("bucket").agg(F.max("rank").alias("h")).select("bucket", (-F.col("h.hub")).alias("hub"))
    pairs = placed.join(hubs.hint("merge"), "bucket").where("rep <> hub")
    once = pairs.groupBy(F.least("rep", "hub").alias("x"), F.greatest("rep", "hub").alias("y")).agg(F.max(F.col("hub") > F.col("rep")).alias("turned"))
    return once.select(F.when(F.col("turned"), F.col("y")).otherwise(F.col("x")).alias("a"), F.when(F.col("turned"), F.col("x")).otherwise(F.col("y")).alias("b"))


def _hidden(inside: DataFrame, found: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join the members of one bucket that lie in two components."""
    placed = inside.join(found.hint("merge"), inside.rep == found.node, "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    signed = written(placed.join(mixed.hint("merge"), "bucket").join(reps.hint("merge"), "rep").select("bucket", "band", "rep", "component", "n", "bands"), "mixed")
    measures = (F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    signed = signed.join(signed.groupBy("bucket").agg(*measures).hint("merge"), "bucket")
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    row = ["band", "rep", "component", "n", "bands"]
    small = signed.where(n_blocks <= 1).select(F.xxhash64("bucket").alias("cell"), F.lit(0).alias("block"), F.lit(False).alias("lower"), *row)
    # a set meets its own class of sizes and, as one of the lower class, the next; 1.34 > 100 / THRESHOLD_PERCENT
    own = F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int")
    large = signed.where(n_blocks > 1).select("bucket", own.alias("own"), F.explode(F.array(own, own + 1)).alias("class"), *row)
    sizes = large.groupBy("bucket", "class").agg(*measures, F.max(F.col("class") == F.col("own")).alias("any")).where("any")
    dealt = large.join(sizes.hint("merge"), ["bucket", "class"]).withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    # the cell of a block with itself holds it alone; that of two blocks holds both
    cell = F.xxhash64("bucket", "class", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(cell.alias("cell"), "block", (F.col("class") > F.col("own")).alias("lower"), *row)
    cells = small.union(dealt).repartition("cell").sortWithinPartitions("cell")
    some = written(cells.mapInArrow(_in_cells(_Cell.promising), cells.schema), "promising")
    whole = some.join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep").repartition("cell").sortWithinPartitions("cell")
    return whole.mapInArrow(_in_cells(_Cell.links), "a long, b long").distinct()


def _size_ok(n: str, m: str):
    """Sets whose sizes differ more can't be similar enough."""
    return F.least(F.col(n), F.col(m)) * 100 >= F.greatest(F.col(n), F.col(m)) * THRESHOLD_PERCENT
