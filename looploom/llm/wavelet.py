"""Token ids in wavelet matrices, one compressed file a shard.

A shard holds the ids of consecutive documents (ascending doc_id) as bit-planes, highest bit first; after each plane the ids are stably
parted by that bit (Claude and Navarro, "The wavelet matrix", 2012). Rank counts of each 512 bits let one file answer access, counting and
the places of an id without decoding the others.

File format (all integers little-endian): the magic ``LWM1``, the header's length (uint32), a JSON header (``n`` ids, ``levels``, ``zeros``
of each plane, ``docs``, ``nulls`` (how many of the first documents have no doc id), and the stored and raw length of each section), then the sections, each a zstandard frame: doc ids (int64), lengths
(int64), and for each plane its bits (most significant bit of a byte first) and its ranks before each 512 bits (uint32).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from looploom.llm.text import table
from looploom.llm.tokens import END_ID, Encoder, batches as portions
from looploom.tables import materialize, new_path

VOCABULARY = "byte_bpe_50k.json"
#: A shard is closed at the document that brings it to so many ids; a longer document is a shard alone.
SHARD_IDS = 1 << 20
MAGIC, BLOCK = b"LWM1", 512


def _partition(ids: np.ndarray, bit: np.ndarray) -> np.ndarray:
    # compress is several times as fast as a mask as index
    return np.concatenate([ids.compress(~bit), ids.compress(bit)])


def encode_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """The file of the documents' ids, given one after another; the first ``nulls`` documents have no doc id."""
    levels = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    pack = zstandard.ZstdCompressor(level=1).compress
    raw = [doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes()]
    zeros, at = [], ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for k in range(levels):
        bit = at & at.dtype.type(1 << (levels - 1 - k)) != 0
        packed = np.packbits(bit)
        padded = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
        padded[: len(packed)] = packed
        counts = np.bitwise_count(padded.view("<u8")).reshape(-1, 8).sum(axis=1, dtype=np.uint32)
        raw += [packed.tobytes(), np.r_[np.uint32(0), np.cumsum(counts, dtype=np.uint32)].astype("<u4").tobytes()]
        zeros.append(int(len(bit) - np.count_nonzero(bit)))
        if k < levels - 1:
            at = _partition(at, bit)
    stored = [pack(x) for x in raw]
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "docs": len(doc_ids), "nulls": nulls, "stored": [*map(len, stored)], "raw": [*map(len, raw)]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *stored])


class Shard:
    """One shard, read from the bytes of its file. Sections are unpacked when they are first needed."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(data[4:8], "little")
        head = json.loads(data[8 : 8 + size])
        self.n, self.levels, self.zeros, self.nulls = head["n"], head["levels"], head["zeros"], head["nulls"]
        ends = np.cumsum([8 + size, *head["stored"]])
        self._parts = [(data[a:b], r) for a, b, r in zip(ends, ends[1:], head["raw"], strict=False)]
        self._open: dict[int, bytes] = {}
        self.doc_ids, self.lengths = (np.frombuffer(self._section(k), "<i8") for k in (0, 1))

    def _section(self, k: int) -> bytes:
        if k not in self._open:
            data, raw = self._parts[k]
            self._open[k] = zstandard.ZstdDecompressor().decompress(data, max_output_size=raw) if raw else b""
        return self._open[k]

    def _bits(self, level: int) -> np.ndarray:
        return np.frombuffer(self._section(2 + 2 * level), np.uint8)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, bits = i // BLOCK, self._bits(level)
        ones = int(np.frombuffer(self._section(3 + 2 * level), "<u4")[block])
        lo, hi = block * BLOCK // 8, i // 8
        ones += int(np.bitwise_count(bits[lo:hi]).sum())
        return ones + (int(bits[hi] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def select(self, level: int, bit: bool, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value in a plane: binary search over the ranks, then inside one block."""
        ranks = np.frombuffer(self._section(3 + 2 * level), "<u4").astype(np.int64)
        ranks = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        inside = np.unpackbits(self._bits(level)[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - ranks[block]])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit = int(self._bits(k)[i // 8] >> (7 - i % 8) & 1)
            ones = self.rank1(k, i)
            value, i = value * 2 + bit, self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id stands in places ``lo`` to ``hi``."""
        lo, hi = max(0, lo), self.n if hi is None else min(hi, self.n)
        if token >> self.levels or lo >= hi:
            return 0
        a, b = self._range(token, lo, hi)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = bool(token >> (self.levels - 1 - level) & 1)
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        at = np.zeros(self.n, kind)
        for k in reversed(range(self.levels)):
            bit = np.unpackbits(self._bits(k), count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = at[: self.zeros[k]]
            up[np.flatnonzero(bit)] = at[self.zeros[k] :] | kind(1 << (self.levels - 1 - k))
            at = up
        return at.astype("<u4")


def _store(folder: str):
    """(file system, path) of a folder given as a path or URI, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (fs.LocalFileSystem(), folder)


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of ``docs`` (``doc_id``, ``text``; other columns are ignored), ``end_id`` after each, to ``folder`` (shared by all
    executors) in ascending doc_id order. Returns the manifest: ``shard`` (file name), ``part``, ``number``, ``docs``, ``ids``, in a table.

    Documents are range-partitioned by doc_id, so each task writes its own shards one after another; a task that runs again writes the
    same files under the same names, each moved into place when whole. Null texts count as empty; equal doc_ids stand together; rows
    without a doc_id come first and are read back without one; a text longer than a shard is a shard alone; an empty table writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = Encoder.of(vocabulary), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        names, keys, texts, n, out = [], [], [], 0, []

        def close():
            nonlocal keys, texts, n
            name = f"{part:06d}-{len(out):06d}.wm"
            ids = np.frombuffer(b"".join(texts), "<u4")
            nulls = keys.count(None)  # they come first
            data = encode_shard(np.array([0] * nulls + keys[nulls:]), np.array([len(t) // 4 for t in texts]), ids, nulls)
            draft = f"{base}/.{name}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(data)
            store.move(draft, f"{base}/{name}")
            names.append(name)
            out.append((len(keys), n))
            keys, texts, n = [], [], 0

        for b in batches:
            ids_of, texts_of = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part_ in portions(texts_of):
                for key, ids in zip(ids_of[part_], encoder.encode(texts_of[part_]), strict=True):
                    keys.append(key)
                    texts.append(ids + end)
                    n += len(texts[-1]) // 4
                    if n >= shard_ids:
                        close()
        if keys:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([part] * len(out), pa.int32()), pa.array(range(len(out)), pa.int32()), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], ["shard", "part", "number", "docs", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(run, "shard string, part int, number int, docs long, ids long"), "manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents read back from the files of a manifest: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit, null unless ``with_ids``) and ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(data.as_py())
                ids, ends = memoryview(s.ids().tobytes()), np.cumsum(s.lengths)
                cut = [ids[4 * int(e - n) : 4 * int(e)] for e, n in zip(ends, s.lengths, strict=True)]
                for i in range(0, len(cut), 2048):
                    part = cut[i : i + 2048]
                    known = pa.array(s.doc_ids[i : i + 2048], mask=np.arange(i, i + len(part)) < s.nulls)
                    cols = [pa.array([name] * len(part)), known, *[pa.array(c[i : i + 2048]) for c in (ends - s.lengths, s.lengths)], pa.array([zlib.crc32(x) for x in part], pa.int64()), pa.array(part if with_ids else [None] * len(part), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    # ids before each part (as many rows as the writer had tasks), then before each shard of a part
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier(W.orderBy("part")).alias("base"))
    before = manifest.select("shard", "part", earlier(W.partitionBy("part").orderBy("number")).alias("inside")).join(parts, "part").select("shard", (F.col("base") + F.col("inside")).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    rows = files.mapInArrow(run, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids, read back from the shards; see :func:`write_shards` and :func:`read_shards`."""
    folder = new_path(spark, "shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
