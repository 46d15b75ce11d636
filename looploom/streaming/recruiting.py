"""Recruiting reads as they arrive. A read's match length depends on the read alone, so the stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from looploom.operators.kmer import BROADCAST_KMERS, kmers, with_reverse


def recruit_stream(reads: DataFrame, reference: DataFrame, k: int, min_match: int, id: str = "id", seq: str = "seq") -> DataFrame:
    """Rows of a stream (or table) of reads with ``match_len`` of at least ``min_match`` against a static reference.

    Each read's k-mers are kept in one row and matched as arrays against the reference's, which is collected once and must have at most
    ``BROADCAST_KMERS`` k-mers.
    """
    ref = [r["kmer"] for r in kmers(with_reverse(reference), k).select("kmer").distinct().limit(BROADCAST_KMERS + 1).collect()]
    if len(ref) > BROADCAST_KMERS:
        raise ValueError("the reference has too many k-mers for a stream")
    known = reads.sparkSession.sparkContext.broadcast(frozenset(ref))

    @F.pandas_udf("long")
    def match_len(seqs):
        import pandas as pd

        out = []
        for s in seqs:
            total, last = 0, 0
            for i in range(len(s or "") - k):
                if s[i : i + k] in known.value:
                    total, last = total + min(i - last, k), i
            out.append(total)
        return pd.Series(out, dtype="int64")

    return reads.withColumn("match_len", match_len(F.col(seq))).where(F.col("match_len") >= min_match)
