"""Content-addressed store of token ids.

Documents are encoded and their id streams cut where a rolling hash of
``ROLL`` ids says so, hence equal passages give equal chunks wherever they
stand.  The store is three Parquet tables under one folder, written by one job:

* ``kind=0`` chunks: SHA-256 of the ids (little-endian uint32), their count,
  and the ids as little-endian uint16 (uint32 if an id needs it).  Every
  distinct chunk is stored once, dealt by its digest.
* ``kind=1`` recipes, in ascending doc_id order: the digests of a document's
  chunks, its number of ids, and the Merkle root of the digests.
* ``kind=2`` manifests, one a shard: the Merkle root of the shard's recipes.

Reading back checks every chunk against its digest, every recipe against its
root, every shard against its manifest.  A document's checksum is combined
from its chunks' (CRC-32 of a concatenation), so ids need not move again;
``reconstruct`` returns the ids themselves.

Encoding works by distinct pieces: the tokenizer never lets a token cross
white space or a border between ASCII letters or digits and ASCII punctuation,
so every distinct piece is encoded once by the tokenizers library and documents
are assembled from pieces.  Texts that hold "<|" (special tokens are matched
before all else) are encoded whole.

Defined cases: null text is empty (its document holds the end id alone); a null
doc_id comes first; rows that repeat a doc_id are all kept, in any fixed order;
an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import plan_bytes, range_of, shared_path, ship

END_ID = 2
ROLL, MEAN_MASK, MIN_CHUNK, MAX_CHUNK = 8, 255, 64, 1024
#: Distinct pieces that a Python worker remembers between texts.
CACHE_PIECES = 800_000
BYTES_PER_SHARD = 8 << 20

_ROW = "kind int, shard int, key binary, doc_id long, n long, body binary"
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCT[39] = False  # an apostrophe may belong to the letters after it
_MARK = "\x01"

_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts by their distinct pieces; remembers up to CACHE_PIECES of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._whole(_MARK)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if _MARK not in p] if len(self.mark) == 1 else []
        odd = [p for p in pieces if _MARK in p] if plain else pieces
        found, sizes = [], []
        for k in range(0, len(plain), 512):
            text = f" {_MARK} ".join(plain[k : k + 512])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = ids == self.mark[0]
            found.append(ids[~marks])
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(marks), [len(ids)]])) - 1)
        for p in odd:
            found.append(np.array(self._whole(p), np.uint32))
            sizes.append(np.array([len(found[-1])], np.int64))
        flat, size = np.concatenate(found), np.concatenate(sizes)
        n, at = len(self.known), self.ends[len(self.known)]
        while len(self.ends) < n + len(size) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < at + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ends[n + 1 : n + 1 + len(size)] = at + np.cumsum(size)
        self.ids[at : at + len(flat)] = flat
        self.known.update(zip(plain + odd, range(n, n + len(size)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        inside = ~kernel.IS_SEP[data]
        begin = inside.copy()
        alnum, punct = _ALNUM[data], _PUNCT[data]
        begin[1:] &= ~inside[:-1] | (alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])
        edges = offsets[offsets < len(data)]
        begin[edges] = inside[edges]
        starts = np.flatnonzero(begin)
        first = np.searchsorted(starts, offsets)
        flat = kernel.lower_ascii(data[inside])
        at = (np.cumsum(inside) - 1)[starts]
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(at, len(flat)).astype(np.int32)), pa.py_buffer(flat))
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES and self.known:
            self.clear()
            new = distinct
        if new:
            self._learn(new)
        known = self.known
        place = np.array([known[p] for p in distinct], np.int64)[coded.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        sizes = self.ends[place + 1] - self.ends[place]
        total = np.zeros(len(place) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        ids = self.ids[np.repeat(self.ends[place] - total[:-1], sizes) + np.arange(total[-1])]
        begins = total[first]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if len(special):
            parts = np.split(ids, begins[1:-1])
            for i in np.unique(np.searchsorted(offsets, special, "right") - 1):
                parts[i] = np.array(self._whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()), np.uint32)
            ids = np.concatenate(parts)
            begins = np.cumsum([0, *(len(p) for p in parts)])
        return ids, begins


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def cuts(ids: np.ndarray) -> list[int]:
    """Chunk ends of one document's ids, by content."""
    if len(ids) <= MIN_CHUNK:
        return [len(ids)]
    rolled = kernel.window_hashes(kernel.mix64(ids.astype(np.uint64)), ROLL)
    return _cuts(np.flatnonzero((rolled & np.uint64(MEAN_MASK)) == 0) + ROLL, len(ids))


def _cuts(places: np.ndarray, n: int) -> list[int]:
    out, last = [], 0
    for p in [*places.tolist(), n]:
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if p - last >= MIN_CHUNK or p == n:
            if p > last:
                out.append(p)
            last = p
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The Merkle root of some digests; an odd last node moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _body(ids: np.ndarray) -> bytes:
    return (ids.astype("<u2") if not len(ids) or ids.max() < 65536 else ids.astype("<u4")).tobytes()


def _ids(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4")


def _batch(kind: list, shard: list, key: list, doc_id: list, n: list, body: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(key, pa.binary()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary())],
        names=["kind", "shard", "key", "doc_id", "n", "body"],
    )


def _encode(path: str, shards: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = encoder(path), set()
        for batch in batches:
            doc_ids, shard_of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, offsets in kernel.slices(batch.column(2)):
                ids, begins = coder.encode(data, offsets)
                ids = np.insert(ids, begins[1:], end_id).astype("<u4")
                begins = begins + np.arange(len(begins))
                rolled = kernel.window_hashes(kernel.mix64(ids.astype(np.uint64)), ROLL)
                places = np.flatnonzero((rolled & np.uint64(MEAN_MASK)) == 0) + ROLL
                lo_at, hi_at = np.searchsorted(places, begins[:-1] + ROLL), np.searchsorted(places, begins[1:], "right")
                raw = ids.tobytes()
                rows: list[list] = [[], [], [], [], [], []]
                for i in range(hi - lo):
                    a, b = int(begins[i]), int(begins[i + 1])
                    digests, last = [], a
                    for cut in _cuts(places[lo_at[i] : hi_at[i]] - a, b - a):
                        end = a + cut
                        digest = hashlib.sha256(raw[4 * last : 4 * end]).digest()
                        digests.append(digest)
                        if digest not in seen:
                            if len(seen) < 1_000_000:  # a repeat is dropped later all the same
                                seen.add(digest)
                            for x, v in zip(rows, (0, int.from_bytes(digest[:4], "big") % shards, digest, None, end - last, _body(ids[last:end])), strict=True):
                                x.append(v)
                        last = end
                    for x, v in zip(rows, (1, shard_of[lo + i], merkle(digests), doc_ids[lo + i], b - a, b"".join(digests)), strict=True):
                        x.append(v)
                yield _batch(*rows)

    return run


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one shard's rows in order: drops repeated chunks, adds the manifest."""
    last, roots, shard, total = None, [], None, 0
    for batch in batches:
        kinds, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        keep = []
        for kind, key in zip(kinds, keys, strict=True):
            keep.append(kind == 1 or key != last)
            if kind == 0:
                last = key
            else:
                roots.append(key)
        if roots:
            shard = batch.column(1)[len(kinds) - 1].as_py()
            total = len(roots)
        yield batch.filter(pa.array(keep, pa.bool_()))
    if roots:
        yield _batch([2], [shard], [merkle(roots)], [None], [total], [b""])


def _crc_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for key, n, body in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
            raw = _ids(body, n).tobytes()
            if hashlib.sha256(raw).digest() != key:
                raise ValueError(f"chunk {key.hex()} is damaged")
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["key", "size", "crc"])


def _recipe_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, seq, keys = [], [], []
        for i, (root, body) in enumerate(zip(batch.column("key").to_pylist(), batch.column("body").to_pylist(), strict=True)):
            digests = [body[k : k + 32] for k in range(0, len(body), 32)]
            if merkle(digests) != root:
                raise ValueError(f"recipe {root.hex()} is damaged")
            index += [i] * len(digests)
            seq += range(len(digests))
            keys += digests
        columns = [batch.column(c).take(pa.array(index, pa.int64())) for c in ("rid", "doc_id", "start", "n")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(seq, pa.int32()), pa.array(keys, pa.binary())], names=["rid", "doc_id", "start", "n", "seq", "key"])


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the CRC's, bits reflected."""
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
    return out


@lru_cache(maxsize=1 << 16)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    out, square, k = 1 << 31, 1 << 23, n_bytes
    while k:
        if k & 1:
            out = _times(out, square)
        square, k = _times(square, square), k >> 1
    return out


def crc_of_both(crc_a: int, crc_b: int, bytes_b: int) -> int:
    return _times(_shift(bytes_b), crc_a) ^ crc_b


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for n, parts in zip(batch.column("n").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            crc = total = 0
            for p in parts:
                crc = crc_of_both(crc, p["crc"], 4 * p["size"]) if total else p["crc"]
                total += p["size"]
            if total != n:
                raise ValueError("a recipe's chunks don't add up")
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.concatenate([_ids(p["body"], p["size"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), kernel.list_array(flat, np.array([len(x) for x in ids], np.int64))], names=["doc_id", "start", "ids"])


def _shard_roots(table: pa.Table) -> pa.Table:
    table = table.sort_by([("rid", "ascending")])
    return pa.table({"shard": table.column("shard")[:1], "root": pa.array([merkle(table.column("key").to_pylist())], pa.binary())})


class TokenStore:
    """A content-addressed store at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> TokenStore:
        spark = docs.sparkSession
        ship(spark)
        path = path or shared_path(spark, "tokens")
        shards = min(8192, max(12, -(-plan_bytes(docs) // BYTES_PER_SHARD)))
        bounds = sorted({int(q) for q in docs.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.2 / shards)})
        shard = range_of("doc_id", bounds)
        rows = docs.select("doc_id", shard.alias("shard"), "text").mapInArrow(_encode(tokenizer, shards, end_id), _ROW)
        dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", F.when(F.col("kind") == 0, F.col("key")), F.col("doc_id").asc_nulls_first(), "n", "key")
        dealt.mapInArrow(_store, _ROW).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        return cls(spark, path)

    def _kind(self, kind: int) -> DataFrame:
        return self.spark.read.schema("shard int, key binary, doc_id long, n long, body binary, kind int").parquet(self.path).where(F.col("kind") == kind)

    def recipes(self) -> DataFrame:
        """Recipes with rid (a row number of the files, which fixes the order of equal doc_ids) and start."""
        rows = self._kind(1).withColumn("rid", F.monotonically_increasing_id())
        sizes = self._kind(1).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()  # a row a shard
        ahead, before = [], 0
        for r in sizes:
            ahead.append((r["shard"], before))
            before += r["n"]
        offsets = self.spark.createDataFrame(ahead, "shard int, ahead long")
        order = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "rid")
        start = F.col("ahead") + F.sum("n").over(order) - F.col("n")
        return rows.join(F.broadcast(offsets), "shard").withColumn("start", start)

    def verify_manifests(self) -> None:
        """Every shard's recipes must give the root in its manifest."""
        rows = self._kind(1).select("shard", "key", F.monotonically_increasing_id().alias("rid"))
        roots = rows.groupBy("shard").applyInArrow(_shard_roots, "shard int, root binary")
        kept = self._kind(2).select("shard", "key")
        bad = roots.join(kept, "shard", "full").where("root is null or key is null or root <> key")
        if not bad.isEmpty():
            raise ValueError("a shard's recipes don't match its manifest")

    def documents(self) -> DataFrame:
        """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
        self.verify_manifests()
        chunks = self._kind(0).select("key", "n", "body").mapInArrow(_crc_chunks, "key binary, size long, crc long")
        used = self.recipes().select("rid", "doc_id", "start", "n", "key", "body").mapInArrow(_recipe_chunks, "rid long, doc_id long, start long, n long, seq int, key binary")
        parts = used.join(chunks, "key").groupBy("rid", "doc_id", "start", "n").agg(F.array_sort(F.collect_list(F.struct("seq", "size", "crc"))).alias("parts"))
        return parts.select("doc_id", "start", "n", "parts").mapInArrow(_combine, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def reconstruct(self) -> DataFrame:
        """Per document: doc_id, start, ids."""
        chunks = self._kind(0).select("key", F.col("n").alias("size"), "body")
        used = self.recipes().select("rid", "doc_id", "start", "n", "key", "body").mapInArrow(_recipe_chunks, "rid long, doc_id long, start long, n long, seq int, key binary")
        parts = used.join(chunks, "key").groupBy("rid", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "size", "body"))).alias("parts"))
        return parts.select("doc_id", "start", "parts").mapInArrow(_join, "doc_id long, start long, ids array<long>")

