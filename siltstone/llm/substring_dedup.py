"""Incremental substring deduplication over a log-structured fingerprint index.

Every window of ``window`` consecutive words of a document has a fingerprint:
``KEY_BITS`` that order and match it and ``CHECK_BITS`` of an independent hash
that verify a match (72 bits together: among 10**8 windows a false match has a
chance of about 10**-6, among 10**13 about one window in 10**8 is affected).

The index is a list of immutable runs.  A run is part of one bucketed table: each
row holds the sorted fingerprints of some documents that fall into one bucket, as
compressed byte planes, with the place of each window.  A map task that meets a
fingerprint in several documents keeps only the first document's windows for the
run; the others are duplicates already and go straight to their documents, so a
line that is everywhere costs a bucket one entry a task.  Buckets are files, so
a new batch meets the historical runs bucket by bucket without a shuffle: the
sorted runs are merged (by a sort that merges sorted stretches), each
fingerprint's first document owns it, and windows of later documents are
duplicates.  ``compact`` merges all runs into one that keeps only each
fingerprint's first window, and deletes the old ones.

Batches must arrive in ascending doc_id order (``deduplicate`` cuts them so).

Defined cases: null text has no words; texts shorter than a window keep all
words; rows with a null doc_id neither own nor lose windows; rows that share a
doc_id never remove each other's words (identical rows get identical results);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .shared import plan_bytes, removed, ship, shared_path, written

WINDOW = 13
KEY_BITS, CHECK_BITS = 56, 16
#: Windows that a map task gathers before it emits them as sorted rows.
FLUSH_WINDOWS = 4_000_000
#: Bytes of input for each bucket file, and index rows' buckets for each file.
BYTES_PER_FILE, BUCKETS_PER_FILE = 8 << 20, 4
#: Spark's own limit (spark.sql.sources.bucketing.maxBuckets); larger tables take more batches.
MOST_FILES = 100_000
LEAST_TARGETS = 256

_RUN = "bucket int, payload binary"
_FOUND = "target int, payload binary"
_SPANS = "doc_id long, row_key long, starts binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns as zstd-compressed byte planes: small values cost only their low bytes."""
    parts = [np.array([len(columns)], np.int64).tobytes()]
    for c in map(np.ascontiguousarray, columns):
        planes = np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T) if len(c) else np.zeros(0, np.uint8)
        body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(c) else b""
        kind = c.dtype.str.encode().ljust(8)
        parts += [kind, np.array([len(c), len(body)], np.int64).tobytes(), body]
    return b"".join(parts)


def unpack(payload: bytes) -> list[np.ndarray]:
    at, out = 8, []
    for _ in range(int(np.frombuffer(payload, np.int64, 1)[0])):
        kind = np.dtype(payload[at : at + 8].strip().decode())
        n, size = np.frombuffer(payload, np.int64, 2, at + 8)
        at += 24
        if n:
            raw = pa.decompress(payload[at : at + size], decompressed_size=int(n) * kind.itemsize, codec="zstd", asbytes=True)
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel())
        else:
            out.append(np.zeros(0, kind))
        at += int(size)
    return out


def _ends(starts: np.ndarray, total: int) -> np.ndarray:
    return np.append(starts[1:], total)


def _ordered(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The order by key and check; a stable sort, so sorted stretches are merged."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    return np.lexsort((checks, keys)) if ((k[1:] == k[:-1]) & (c[1:] < c[:-1])).any() else order


def _late(keys: np.ndarray, checks: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """Which of some ordered windows have an equal one in a document with a smaller doc_id."""
    begin = np.flatnonzero(_same(keys, checks))
    owner = np.minimum.reduceat(doc_ids, begin)
    return doc_ids > np.repeat(owner, np.diff(np.append(begin, len(keys))))


def _by_target(doc: np.ndarray, row: np.ndarray, pos: np.ndarray, targets: int) -> Iterator[tuple[int, bytes]]:
    """Duplicate windows packed by the target of their document."""
    if not len(doc):
        return
    target = kernel.mix64(doc.astype(np.uint64)) % np.uint64(targets)
    order = np.lexsort((pos, row, doc, target))
    doc, row, pos, target = doc[order], row[order], pos[order], target[order]
    head = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    for a, b in zip(head, _ends(head, len(doc)), strict=True):
        d, r, p = doc[a:b], row[a:b], pos[a:b]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])]))
        yield int(target[a]), pack(d[first], r[first], np.diff(np.append(first, len(p))).astype(np.uint32), p.astype(np.uint32))


class _Gathered:
    """Windows of a map task's documents until they are emitted, sorted, by bucket."""

    def __init__(self, buckets: int, key_bits: int, targets: int):
        self.buckets, self.key_bits, self.targets = buckets, key_bits, targets
        self.clear()

    def clear(self) -> None:
        self.docs: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = self.n_docs = 0

    def add(self, doc_ids: np.ndarray, row_keys: np.ndarray, keys: np.ndarray, checks: np.ndarray, doc: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, row_keys]))
        self.parts.append((keys, checks, (doc + self.n_docs).astype(np.uint32)))
        self.n += len(keys)
        self.n_docs += len(doc_ids)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The run's rows by bucket; windows known as duplicates by target, as the bucket -1 - target."""
        if not self.n:
            return
        ids, rows = np.concatenate(self.docs, axis=1)
        keys, checks, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.clear()
        # A window is named by its number among the task's windows: three bytes for both document and place.
        first = np.searchsorted(doc, np.arange(len(ids)))
        order = _ordered(keys, checks)
        keys, checks = keys[order], checks[order]
        late = _late(keys, checks, ids[doc[order]])
        gone, order, keys, checks = order[late], order[~late], keys[~late], checks[~late]
        for target, payload in _by_target(ids[doc[gone]], rows[doc[gone]], gone - first[doc[gone]], self.targets):
            yield _row(-1 - target, payload)
        bucket = (keys >> np.uint64(self.key_bits - 32)) * np.uint64(self.buckets) >> np.uint64(32)
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1).astype(np.uint64))
        for b in range(self.buckets):
            lo, hi = int(cut[b]), int(cut[b + 1])
            if lo < hi:
                here = order[lo:hi].astype(np.uint32)
                used = np.unique(doc[here])
                deltas = np.diff(keys[lo:hi], prepend=np.uint64(0))
                yield _row(b, pack(deltas, checks[lo:hi], here, first[used].astype(np.int64), ids[used], rows[used]))


def _row(bucket: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "payload"])


def _fingerprints(window: int, buckets: int, key_bits: int, targets: int):
    mask = np.uint64((1 << CHECK_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(buckets, key_bits, targets)
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo, hi, data, offsets in kernel.slices(batch.column(2)):
                starts, ends, first = kernel.word_spans(data, offsets)
                counts = np.diff(first)
                per_doc = np.maximum(counts - window + 1, 0)
                if not per_doc.any():
                    continue
                words = kernel.word_hashes(data, starts, ends)
                hashes = kernel.window_hashes(words, window)
                check = kernel.window_hashes(words ^ np.uint64(0x5851F42D4C957F2D), window)
                doc = np.repeat(np.arange(hi - lo), per_doc)
                begin = np.cumsum(per_doc) - per_doc
                pos = np.arange(len(doc)) - begin[doc]
                where = first[:-1][doc] + pos
                gathered.add(ids[lo:hi], rows[lo:hi], hashes[where] >> np.uint64(64 - key_bits), (check[where] & mask).astype(np.uint16), doc)
                if gathered.n >= FLUSH_WINDOWS:
                    yield from gathered.rows()
        yield from gathered.rows()

    return run


def _decoded(payloads: list[bytes]) -> list[np.ndarray]:
    """key, check, doc_id, row_key and place of every window of some index rows."""
    parts = []
    for p in payloads:
        deltas, checks, number, first, ids, rows = unpack(p)
        by_first = np.argsort(first, kind="stable")
        which = by_first[np.searchsorted(first[by_first], number.astype(np.int64), "right") - 1]
        parts.append((np.cumsum(deltas, dtype=np.uint64), checks, ids[which], rows[which], (number.astype(np.int64) - first[which]).astype(np.uint32)))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _same(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])


def _merge(targets: int):
    """Merge-joins the runs of one bucket; emits, for each target, the new batch's windows that an earlier document owns."""

    def run(table: pa.Table) -> pa.Table:
        new = table.column("fresh").to_numpy(zero_copy_only=False)
        payloads = table.column("payload").to_pylist()
        key, check, doc, row, pos = _decoded(payloads)
        fresh = np.repeat(new, [unpack_len(p) for p in payloads])
        order = _ordered(key, check)
        late = order[_late(key[order], check[order], doc[order]) & fresh[order]]
        found = list(_by_target(doc[late], row[late], pos[late], targets))
        return pa.table({"target": pa.array([t for t, _ in found], pa.int32()), "payload": pa.array([p for _, p in found], pa.binary())})

    return run


def unpack_len(payload: bytes) -> int:
    return int(np.frombuffer(payload, np.int64, 1, 16)[0])


def _gather(table: pa.Table) -> pa.Table:
    """All duplicate windows of each document of one target: a row a document."""
    parts = [unpack(p) for p in table.column("payload").to_pylist()]
    doc, row, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc, row = np.repeat(doc, n), np.repeat(row, n)
    order = np.lexsort((pos, row, doc))
    doc, row, pos = doc[order], row[order], pos[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
    return pa.table({
        "doc_id": pa.array(doc[head], pa.int64()),
        "row_key": pa.array(row[head], pa.int64()),
        "starts": pa.array([pack(np.diff(pos[a:b], prepend=np.uint32(0))) for a, b in zip(head, _ends(head, len(pos)), strict=True)], pa.binary()),
    })


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words windows that begin at ``starts`` cover."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            n_words, n_removed, shas, texts = [], [], [], []
            for lo, hi, data, offsets in kernel.slices(batch.column(1)):
                starts, ends, first = kernel.word_spans(data, offsets)
                flat, at = kernel.joined_words(data, starts, ends)
                for i in range(lo, hi):
                    a, b = int(first[i - lo]), int(first[i - lo + 1])
                    text, gone, mark = flat[at[a] : at[b]], 0, marks[i].as_py()
                    if mark is not None:
                        out = covered(np.cumsum(unpack(mark)[0], dtype=np.int64), b - a, window)
                        gone = int(out.sum())
                        text = text[np.repeat(~out, np.diff(at[a : b + 1]))]
                    body = text[:-1].tobytes()
                    n_words.append(b - a)
                    n_removed.append(gone)
                    shas.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        texts.append(body.decode("utf-8", "replace"))
            columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _compacted(table: pa.Table) -> pa.Table:
    """One row of a bucket: each fingerprint's first window."""
    key, check, doc, row, pos = _decoded(table.column("payload").to_pylist())
    order = np.lexsort((pos, row, doc, check, key))
    x = order[_same(key[order], check[order])]
    used, local = np.unique(np.stack([doc[x], row[x]]), axis=1, return_inverse=True)
    # places are not needed of history: windows are numbered by document only
    payload = pack(np.diff(key[x], prepend=np.uint64(0)), check[x], local.ravel().astype(np.uint32), np.arange(used.shape[1], dtype=np.int64), used[0], used[1])
    return pa.table({"bucket": table.column("bucket")[:1], "payload": pa.array([payload], pa.binary())})


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints, appended to one bucketed table of the shared folder."""

    def __init__(self, spark: SparkSession, files: int, window: int = WINDOW, key_bits: int = KEY_BITS, fanout: int = 8):
        self.spark, self.files, self.window, self.key_bits, self.fanout = spark, max(1, files), window, key_bits, fanout
        self.targets = max(LEAST_TARGETS, 2 * self.files)
        self.run = 0
        self._start()

    def _start(self) -> None:
        self.table, self.n_runs = f"fingerprints_{uuid.uuid4().hex[:12]}", 0
        self.path = shared_path(self.spark, self.table)

    def _append(self, rows: DataFrame) -> None:
        # runs of one table share its buckets, so a bucket's rows of all runs are read by one task without a shuffle
        writer = rows.withColumn("run", F.lit(self.run)).write.mode("append").bucketBy(self.files, "bucket").option("compression", "none")
        (writer if self.n_runs else writer.option("path", self.path)).saveAsTable(self.table)
        self.n_runs += 1

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """Deduplicates a batch against itself and all runs, and makes it a run.  Its doc_ids must exceed those of earlier batches."""
        known = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
        self.run += 1
        self._append(known.where("doc_id is not null").mapInArrow(_fingerprints(self.window, self.files * BUCKETS_PER_FILE, self.key_bits, self.targets), _RUN))
        fresh = F.col("run") == self.run
        runs = self.spark.table(self.table)
        merged = runs.where("bucket >= 0").select("bucket", "payload", fresh.alias("fresh")).groupBy("bucket").applyInArrow(_merge(self.targets), _FOUND)
        found = merged.union(runs.where((F.col("bucket") < 0) & fresh).select((-1 - F.col("bucket")).alias("target"), "payload"))
        marks = found.groupBy("target").applyInArrow(_gather, _SPANS)
        schema = RESULT + (", kept_text string" if with_text else "")
        return known.join(marks, ["doc_id", "row_key"], "left").select("doc_id", "text", "starts").mapInArrow(_kept(self.window, with_text), schema)

    def compact(self) -> None:
        """Merges all runs into one once there are more than ``fanout``; results of ``add`` must be written by then."""
        if self.n_runs <= self.fanout:
            return
        old, path = self.table, self.path
        rows = self.spark.table(old).where("bucket >= 0").select("bucket", "payload").groupBy("bucket").applyInArrow(_compacted, _RUN)
        self._start()
        self._append(rows)
        self._drop(old, path)

    def close(self) -> None:
        """Deletes the index; results of ``add`` must be written by then."""
        self._drop(self.table, self.path)

    def _drop(self, table: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        removed(self.spark, path)


def deduplicate(docs: DataFrame, batches: int = 3, window: int = WINDOW, key_bits: int = KEY_BITS, fanout: int = 1, with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window that also starts in a document with a smaller doc_id.

    The table is fed to a new index in ``batches`` of ascending doc_id, each as it would come in day by day;
    after a batch, more than ``fanout`` runs are compacted.
    """
    spark = docs.sparkSession
    ship(spark)
    files = min(MOST_FILES, max(12, -(-plan_bytes(docs) // (BYTES_PER_FILE * batches))))
    index = FingerprintIndex(spark, files, window, key_bits, fanout)
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    d = F.col("doc_id")
    bounds = [None, *(int(c) for c in cuts), None]
    whole = None
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = docs
        if lo is not None:
            part = part.where(d > lo)
        if hi is not None:
            part = part.where((d <= hi) | d.isNull()) if lo is None else part.where(d <= hi)
        out = written(index.add(part, with_text), "deduplicated")
        whole = out if whole is None else whole.unionByName(out)
        if hi is not None:
            index.compact()
    index.close()
    return whole
