"""K-mers, syncmers, recruiting by matches, and anchors. Keyed by read or k-mer, all are DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from looploom.functions.seq import c, revcomp

#: A reference of up to so many k-mers is broadcast to the reads; a larger one is joined by shuffle.
BROADCAST_KMERS = 2_000_000


def kmers(reads: DataFrame, k: int, id: str = "id", seq: str = "seq", skip_last: bool = False) -> DataFrame:
    """(``id``, ``pos`` from 0, ``kmer``) of each k-mer. Sequences shorter than k have none. Bases are single bytes, so a k-mer is cut out of
    the binary form in constant time. ``skip_last`` leaves out the last k-mer of each sequence."""
    n = F.length(c(seq)) - k + (0 if skip_last else 1)
    cut = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring(F.col("b"), i, F.lit(k)))
    rows = reads.where(n >= 1).select(F.col(id).alias("id"), c(seq).cast("binary").alias("b"), n.alias("n"))
    return rows.select("id", F.posexplode(cut).alias("pos", "kmer")).select("id", "pos", F.col("kmer").cast("string").alias("kmer"))


def with_reverse(seqs: DataFrame, id: str = "id", seq: str = "seq") -> DataFrame:
    """Each sequence and its reverse complement."""
    return seqs.select(F.col(id).alias("id"), F.col(seq).alias("seq")).unionAll(seqs.select(F.col(id).alias("id"), revcomp(seq).alias("seq")))


def unique_kmers(seqs: DataFrame, k: int, id: str = "id", seq: str = "seq") -> DataFrame:
    """K-mers that occur exactly once over all sequences: (``kmer``, ``id``, ``pos``)."""
    found = kmers(seqs, k, id, seq).groupBy("kmer").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("pos").alias("pos"))
    return found.where("n = 1").drop("n")


def kmer_read_counts(reads: DataFrame, k: int, id: str = "id", seq: str = "seq") -> DataFrame:
    """In how many reads each k-mer occurs, and how often in all."""
    return kmers(reads, k, id, seq).groupBy("kmer", "id").count().groupBy("kmer").agg(F.count("*").alias("n_reads"), F.sum("count").alias("n_total"))


def probes(reads: DataFrame, reference_kmers: DataFrame, k: int, id: str = "id", seq: str = "seq") -> DataFrame:
    """Hits (``id``, ``pos``) of the reads' k-mers in the reference; the last k-mer of a read isn't probed.

    Only hits leave the task that read the reads when the reference is broadcast, which is decided by counting it.
    """
    ref = reference_kmers.select("kmer").distinct()
    if ref.count() <= BROADCAST_KMERS:
        ref = F.broadcast(ref)
    return kmers(reads, k, id, seq, skip_last=True).join(ref, "kmer", "left_semi").select("id", "pos")


def match_length(hits: DataFrame, k: int) -> DataFrame:
    """(``id``, ``n_hits``, ``match_len``): each hit adds the distance to the hit before it (the first: to 0), at most k."""
    gap = F.col("pos") - F.lag("pos", 1, 0).over(W.partitionBy("id").orderBy("pos"))
    return hits.withColumn("add", F.least(gap, F.lit(k))).groupBy("id").agg(F.count("*").alias("n_hits"), F.sum("add").cast("bigint").alias("match_len"))


def recruit(reads: DataFrame, reference: DataFrame, k: int, min_match: int, id: str = "id", seq: str = "seq", ref_id: str = "id", ref_seq: str = "seq", both_strands: bool = True, syncmer: bool = False) -> DataFrame:
    """Reads whose match length against the reference (and its reverse complement) is at least ``min_match``: (``id``, ``n_hits``, ``match_len``).

    ``syncmer`` keeps only the reference's closed syncmers, which shrinks the set that is sent out.
    """
    ref = with_reverse(reference, ref_id, ref_seq) if both_strands else reference.select(F.col(ref_id).alias("id"), F.col(ref_seq).alias("seq"))
    keys = syncmers(ref, k, max(k - 10, 1)) if syncmer else kmers(ref, k)
    return match_length(probes(reads, keys, k, id, seq), k).where(F.col("match_len") >= min_match)


def syncmers(reads: DataFrame, k: int, s: int, id: str = "id", seq: str = "seq", order: Column | None = None) -> DataFrame:
    """Closed syncmers (``id``, ``pos``, ``kmer``): k-mers whose first or last s-mer is the least of their s-mers.

    ``order`` maps the column ``smer`` to what is compared (default: the s-mer itself, by its letters).
    """
    w = k - s + 1
    rows = kmers(reads, s, id, seq).select("id", "pos", (order if order is not None else F.col("kmer")).alias("h"))
    win = W.partitionBy("id").orderBy("pos")
    ahead = win.rowsBetween(0, w - 1)
    rows = rows.select("id", "pos", "h", F.min("h").over(ahead).alias("least"), F.lead("h", w - 1).over(win).alias("last")).where("last is not null and (h = least or last = least)")
    texts = reads.select(F.col(id).alias("id"), c(seq).cast("binary").alias("b"))
    return rows.join(texts, "id").select("id", "pos", F.substring("b", F.col("pos") + 1, F.lit(k)).cast("string").alias("kmer"))


def anchors(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """Hits of queries (``id``, ``seq``) in the k-mers that one reference (``id``, ``seq``) has once, for each reference by itself: (``id``, ``ref``, ``ref_pos``, ``pos``, ``diag``)."""
    once = kmers(references, k).groupBy("id", "kmer").agg(F.count("*").alias("n"), F.min("pos").alias("ref_pos")).where("n = 1")
    hits = kmers(queries, k).join(once.select(F.col("id").alias("ref"), "kmer", "ref_pos"), "kmer")
    return hits.select("id", "ref", "ref_pos", "pos", (F.col("ref_pos") - F.col("pos")).alias("diag"))


def islands(df: DataFrame, by: list[str], order: str, gap: int, name: str = "island") -> DataFrame:
    """Number (from 0) of the run of rows, ordered by ``order``, that are at most ``gap`` apart."""
    w = W.partitionBy(*by).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("__new").over(w.rangeBetween(W.unboundedPreceding, 0)).cast("int")).drop("__new")


def diagonal_filter(hits: DataFrame, by: list[str], gap: int = 100) -> DataFrame:
    """Hits of the largest run of diagonals that are at most ``gap`` apart (the first of equal runs), for each key."""
    marked = islands(hits, by, "diag", gap)
    size = marked.groupBy(*by, "island").count()
    best = size.groupBy(*by).agg(F.min_by("island", F.struct(-F.col("count"), F.col("island"))).alias("island"))
    return marked.join(best, [*by, "island"], "left_semi").drop("island")


def drop_repeats(hits: DataFrame, by: list[str], either: bool = False) -> DataFrame:
    """Hits whose place in the reference (or, with ``either``, in either sequence) occurs once for the key."""
    once = F.count("*").over(W.partitionBy(*by, "ref_pos")) == 1
    if either:
        once = once & (F.count("*").over(W.partitionBy(*by, "pos")) == 1)
    return hits.withColumn("__once", once).where("__once").drop("__once")
