"""Readers of sequence files. Each returns (``id``, ``seq``, ``quality``); which one is used follows from the file's name."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from looploom.functions.seq import name_without_tags
from looploom.sources.lines import numbered_lines

SCHEMA = "id string, seq string, quality string"


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """FASTA, plain or gzip. A record is what follows a ``>`` at a line's start; its lines are joined, blanks dropped, letters upper-cased.

    The text reader splits files at record starts, so large files are read in parallel without a shuffle. The id is the whole header.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where(F.trim("v") != "")
    head = F.regexp_replace(F.substring_index("v", "\n", 1), "\r$", "")
    body = F.substring("v", F.length(F.substring_index("v", "\n", 1)) + 2, F.length("v"))
    return rows.select(head.alias("id"), F.upper(F.regexp_replace(body, r"\s+", "")).alias("seq"), F.lit(None).cast("string").alias("quality"))


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """FASTQ of four lines a record, plain or gzip. Letters are upper-cased; a quality of another length than the sequence fails."""
    rec = numbered_lines(spark, path).withColumns({"r": F.floor(F.col("line") / 4), "k": F.col("line") % 4})
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    rec = rec.groupBy("file", "r").agg(part(0).alias("h"), part(1).alias("s"), part(2).alias("p"), part(3).alias("q"))
    good = F.startswith("h", F.lit("@")) & F.startswith("p", F.lit("+")) & (F.length("s") == F.length("q"))
    rec = rec.where("h <> '' or s <> ''").withColumn("ok", F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record near "), F.coalesce("h", F.lit("")))).cast("boolean")))
    return rec.where("ok").select(F.substring("h", F.lit(2), F.length("h")).alias("id"), F.upper("s").alias("seq"), F.col("q").alias("quality"))


BAM_BASES = "=ACMGRSVTWYHKDBN"


def bam_records(data: bytes, primary: bool = True) -> Iterator[tuple[str, str, str | None]]:
    """(name, sequence, quality) of a BAM file's bytes; ``primary`` leaves out secondary and supplementary alignments."""
    raw = gzip.decompress(data)  # BGZF blocks are gzip members
    if raw[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    (n_ref,) = struct.unpack_from("<i", raw, at)
    at += 4
    for _ in range(n_ref):
        at += 8 + struct.unpack_from("<i", raw, at)[0]
    while at < len(raw):
        size, _, _, name_len, _, _, n_cigar, flag, n = struct.unpack_from("<iiiBBHHHi", raw, at)
        p, end = at + 36, at + 4 + size
        if not (primary and flag & 0x900):
            name = raw[p : p + name_len - 1].decode()
            p += name_len + 4 * n_cigar
            packed = raw[p : p + (n + 1) // 2]
            seq = "".join(BAM_BASES[b >> 4] + BAM_BASES[b & 15] for b in packed)[:n]
            q = raw[p + (n + 1) // 2 : p + (n + 1) // 2 + n]
            yield name, seq, None if q[:1] == b"\xff" else bytes(x + 33 for x in q).decode()
        at = end


def read_bam(spark: SparkSession, path) -> DataFrame:
    """Primary alignments of BAM files as reads; a file is one task, and must fit its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = list(bam_records(data.as_py()))
                for i in range(0, len(rows), 2048):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows[i : i + 2048], strict=True)], ["id", "seq", "quality"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


_READERS = {".fasta": read_fasta, ".fa": read_fasta, ".fastq": read_fastq, ".fq": read_fastq, ".bam": read_bam, ".sam": None}


def read_sequences(spark: SparkSession, paths) -> DataFrame:
    """Reads of files of any known kind, by suffix (``.gz`` taken off first; ``.bam`` can't be gzipped again). Unknown suffixes fail."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        base = path.removesuffix(".gz")
        reader = next((r for s, r in _READERS.items() if base.endswith(s)), None)
        if reader is None:
            raise ValueError(f"unknown kind of sequence file: {path}")
        df = reader(spark, path)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no files given")
    return out


def last_length(reads: DataFrame, order: str = "id") -> DataFrame:
    """Length of the last sequence by ``order``."""
    return reads.agg(F.max_by(F.length("seq"), order).alias("length"))


def short_names(reads: DataFrame) -> DataFrame:
    return reads.withColumn("id", name_without_tags("id"))


def write_fasta(reads: DataFrame, path: str, id: str = "id", seq: str = "seq") -> None:
    """Write FASTA, a file a partition: a header line and a sequence line each."""
    reads.select(F.concat(F.lit(">"), F.col(id), F.lit("\n"), F.col(seq))).write.text(path)
