"""Rolling strand-canonical hashes of k-mers, and syncmers by them, vectorised over a sequence.

The hash of a k-mer is the XOR of its bases' values, each rotated left by the number of bases after it; that of the other strand uses complements and the number
of bases before; the smaller (unsigned) counts. XOR prefixes of values rotated by place give all k-mers of a sequence in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_U = np.uint64
_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def wang(key: np.ndarray) -> np.ndarray:
    """Wang's 64-bit integer hash, the values of the bases (fixed function)."""
    k = key.astype(_U)
    with np.errstate(over="ignore"):
        k = ~k + (k << _U(21))
        k ^= k >> _U(24)
        k = k + (k << _U(3)) + (k << _U(8))
        k ^= k >> _U(14)
        k = k + (k << _U(2)) + (k << _U(4))
        k ^= k >> _U(28)
        return k + (k << _U(31))


_VALUE = wang(np.arange(4))


def _rotate(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = (by % 64).astype(_U)
    return x << by | x >> (_U(64) - by) % _U(64) if len(x) else x


def hashes(seq: str, k: int) -> np.ndarray:
    """Canonical hash (unsigned) at each place; other letters than A, C, G, T count as A."""
    code = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    n = len(code)
    if n < k:
        return np.zeros(0, _U)
    place = np.arange(n)
    ahead = np.r_[_U(0), np.bitwise_xor.accumulate(_rotate(_VALUE[code], -place))]
    back = np.r_[_U(0), np.bitwise_xor.accumulate(_rotate(_VALUE[3 - code], place))]
    at = np.arange(n - k + 1)
    return np.minimum(_rotate(ahead[k:] ^ ahead[:-k], at + k - 1), _rotate(back[k:] ^ back[:-k], -at))


def syncmer_places(seq: str, k: int, s: int) -> np.ndarray:
    """Places of closed syncmers: k-mers whose first or last s-mer has the least hash of their s-mers."""
    h = hashes(seq, s)
    w = k - s + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    least = view.min(axis=1)
    return np.flatnonzero((view[:, 0] == least) | (view[:, -1] == least))


def syncmers(reads: DataFrame, k: int, s: int | None = None, id: str = "id", seq: str = "seq") -> DataFrame:
    """(``id``, ``pos``, ``hash``) of each syncmer: its canonical k-mer hash, as a signed long. ``s`` is k - 10 unless given."""
    kind, size = dict(reads.dtypes)[id], max(k - 10, 1) if s is None else s

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b[id], b[seq], strict=True):
                at = syncmer_places(t or "", k, size)
                yield pd.DataFrame({id: [i] * len(at), "pos": at, "hash": hashes(t, k)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)})

    return reads.select(id, seq).mapInPandas(run, f"`{id}` {kind}, pos long, hash long").withColumnRenamed(id, "id")


def match_counts(reads: DataFrame, reference: DataFrame, k: int, id: str = "id", seq: str = "seq") -> DataFrame:
    """(``id``, ``n_hits``): k-mers of each read, the last left out, whose hash is that of a syncmer of the reference. Hashes cover both strands."""
    kind, size = dict(reads.dtypes)[id], max(k - 10, 1)
    from looploom.operators.kmer import BROADCAST_KMERS

    ref = syncmers(reference, k, size).select("hash").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b[id], b[seq], strict=True):
                h = hashes(t or "", k)[:-1].view(np.int64)
                yield pd.DataFrame({"id": [i] * len(h), "hash": h})

    hits = reads.select(id, seq).mapInPandas(run, f"id {kind}, hash long")
    return hits.join(F.broadcast(ref) if ref.count() <= BROADCAST_KMERS else ref, "hash", "left_semi").groupBy("id").agg(F.count("*").alias("n_hits"))
