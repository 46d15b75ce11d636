"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

A sequence is filled by the dot-product heuristic: of the waiting pieces that fit all limits, the one whose demand vector has the largest
weighted dot product with what is left goes in (weights: mean demand a limit of the waiting pieces). When none fits, the gap is filled by
cutting a waiting piece, so sequences come out full. Partitions are packed on their own, in one pass, with a bounded pool: no shuffle,
memory of a pool and a batch, and a lost task is run again alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from looploom.llm.text import table
from looploom.llm.tokens import END_ID, Encoder, batches as portions

#: Vocabulary, and limits of a sequence: tokens, segments and loss-bearing tokens.
VOCABULARY, TOKENS, SEGMENTS, LOSS = "word_bpe_49k.json", 4096, 256, 4096
#: Pieces that wait in a partition to be placed.
POOL = 512


@dataclass
class Piece:
    """A stretch of one example: its ids (little-endian unsigned 32-bit), a 0/1 byte an id for loss, and where it starts."""

    key: int
    ids: bytes
    loss: bytes | None
    start: int
    total: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def demand(self) -> tuple[int, int, int]:
        """Tokens, segments, loss-bearing tokens. The first token of a piece has nothing before it and bears no loss."""
        return len(self), 1, (len(self) - 1 if self.loss is None else sum(self.loss[1:]))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        loss = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.key, self.ids[: 4 * n], loss[0], self.start, self.total), Piece(self.key, self.ids[4 * n :], loss[1], self.start + n, self.total)

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest prefix within limits on tokens and loss."""
        n = min(tokens, len(self))
        if self.loss is None:
            return min(n, loss + 1)
        borne = np.cumsum(np.frombuffer(self.loss[:n], np.uint8)) - (self.loss[0] if n else 0)
        return int(np.searchsorted(borne, loss, side="right"))


@dataclass
class Packer:
    """Packs pieces as they come; ``add`` and ``finish`` yield closed sequences (lists of pieces)."""

    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = LOSS
    pool: int = POOL
    waiting: list[Piece] = field(default_factory=list)
    demand: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))

    def __post_init__(self):
        if self.tokens & (self.tokens - 1) or min(self.tokens, self.segments) < 1 or self.loss < 0:
            raise ValueError("tokens must be a power of two, segments at least 1 and loss at least 0")
        self.demand = np.zeros((self.pool + 1, 3))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) > self.tokens or piece.demand()[2] > self.loss:
            n = max(1, piece.fitting(self.tokens, self.loss))
            head, piece = piece.cut(n)
            if n == self.tokens:
                yield [head]
            else:
                yield from self._wait(head)
        yield from self._wait(piece)

    def _wait(self, piece: Piece) -> Iterator[list[Piece]]:
        if not len(piece):
            return
        self.demand[len(self.waiting)] = piece.demand()
        self.waiting.append(piece)
        if len(self.waiting) > self.pool:
            yield from self._fill()

    def _take(self, i: int) -> Piece:
        piece, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.demand[i] = self.demand[len(self.waiting)]
        return piece

    def _fill(self) -> Iterator[list[Piece]]:
        limit = np.array([self.tokens, self.segments, self.loss], float)
        limit[2] = max(limit[2], 1)
        left = np.array([self.tokens, self.segments, self.loss], float)
        out: list[Piece] = []
        weight = self.demand[: len(self.waiting)].mean(axis=0) / limit
        while self.waiting and left[0] >= 1 and left[1] >= 1:
            d = self.demand[: len(self.waiting)]
            fits = (d <= left).all(axis=1)
            if left[1] == 1:  # the last segment should close the sequence
                fits &= d[:, 0] == left[0]
            if fits.any():
                i = int(np.argmax(np.where(fits, (d / limit) @ (weight * left / limit), -1.0)))
                piece = self._take(i)
            else:
                i = int(np.argmax(d[:, 0]))
                n = self.waiting[i].fitting(int(left[0]), int(left[2]))
                if n < 1:
                    break
                piece, rest = self.waiting[i].cut(n)
                if len(rest):
                    self.waiting[i], self.demand[i] = rest, rest.demand()
                else:
                    self._take(i)
            out.append(piece)
            left -= piece.demand()
        yield from _closed(out)

    def finish(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield from self._fill()


def _closed(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """A sequence whose length is no power of two is cut into sequences that are, longest first: none of them needs padding."""
    total = sum(map(len, pieces))
    while pieces:
        size = 1 << (total.bit_length() - 1)
        out, n = [], size
        while n:
            head = pieces.pop(0)
            if len(head) > n:
                head, rest = head.cut(n)
                pieces.insert(0, rest)
            out.append(head)
            n -= len(head)
        yield out
        total -= size


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


def packed(examples: Iterable[tuple[int, bytes, bytes | None]], partition: int, packer: Packer, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Examples (key, ids, loss) of one partition as rows of :data:`COLUMNS`. Sequences are numbered within ``partition``."""
    sequence, held = partition << 36, []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:8]], pa.array(cols[8], pa.binary())], [c.split()[0] for c in COLUMNS.split(", ")])

    def sequences() -> Iterator[list[Piece]]:
        for key, ids, loss in examples:
            yield from packer.add(Piece(key, ids, loss, 0, len(ids) // 4))
        yield from packer.finish()

    for pieces in sequences():
        at = 0
        for p in pieces:
            held.append((p.key, p.start, len(p), zlib.crc32(p.ids), p.total, sequence, at, p.demand()[2], p.ids))
            at += len(p)
        sequence += 1
        if len(held) >= rows:
            yield batch()
    if held:
        yield batch()


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """Token ids of ``docs`` (``doc_id``, ``text``; other columns are ignored) with ``end_id`` after each, packed: rows of :data:`COLUMNS`.

    Each id lies in exactly one piece (``doc_id``, ``start``, ``length``, ``ids``) of one sequence, at ``offset``. Sequences hold up to
    ``tokens`` ids, ``segments`` pieces and ``loss`` loss-bearing ids (all but the first of a piece); a partition's last sequences have
    power-of-two lengths. Null and empty texts are the end id alone; very long texts are cut into as many pieces as they need; repeated
    rows are packed each, and a row without a doc_id keeps none; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary), int(end_id).to_bytes(4, "little")

        def examples():
            for b in batches:
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for s in portions(texts):
                    for key, ids in zip(keys[s], encoder.encode(texts[s]), strict=True):
                        yield key, ids + end, None

        yield from packed(examples(), TaskContext.get().partitionId(), Packer(tokens, segments, loss))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)


def pack_conversations(turns: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """Instruction data: conversations (``conv_id``, ``turn``, ``role``, ``text``) packed whole, with loss on the assistant's ids only.

    The turns of a conversation are joined in order, each with ``end_id``; the result has the conversation in ``doc_id``. Null roles
    bear no loss, null texts are the end id alone; turns that repeat are all kept, in the order of their roles and texts; rows without a
    conv_id are one conversation; other columns are ignored; an empty table gives no rows. The turns of one conversation meet in one task.
    """
    order = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    rows = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(order.alias("t")).select("doc_id", F.to_json(F.transform("t", lambda x: F.struct((F.coalesce(x.role, F.lit("")) == "assistant").alias("a"), x.text.alias("t")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        encoder, end = Encoder.of(vocabulary), int(end_id).to_bytes(4, "little")

        def examples():
            for b in batches:
                for key, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    said = json.loads(said)
                    ids = [x + end for x in encoder.encode([x["t"] for x in said])]
                    yield key, b"".join(ids), b"".join(bytes([x["a"]]) * (len(i) // 4) for x, i in zip(said, ids, strict=True))

        yield from packed(examples(), TaskContext.get().partitionId(), Packer(tokens, segments, loss))

    return rows.mapInArrow(run, COLUMNS)


#: Limits of the query on conversations: sequences for tuning hold few conversations, and half their tokens may bear loss.
CONVERSATION_SEGMENTS, CONVERSATION_LOSS = 16, 2048


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; see :func:`pack_documents`."""
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")


def op4_packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all conversations, under limits on tokens, segments and loss-bearing tokens; see :func:`pack_conversations`."""
    turns = table(spark, sf_dir, "conversations")
    return pack_conversations(turns, segments=CONVERSATION_SEGMENTS, loss=CONVERSATION_LOSS).drop("ids").withColumnRenamed("doc_id", "conv_id")
