"""Loops (repeat units) of long reads: where units begin, cutting reads, missing loops, the graph of how units follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from looploom.functions.seq import interpolate
from looploom.operators.intervals import gap_chains, overlap_join


def border_votes(nodes: DataFrame, consensus: str, k: int = 101, flank: int = 200, least: int = 3) -> DataFrame:
    """Border nodes (``node``, ``fwd``, ``at``): where the consensus' closing point falls in a node.

    K-mers that begin in the first ``flank`` places of the consensus, or end in its last, vote for the place that they imply; k-mers found twice
    among them or inside the consensus have no vote; ``least`` votes make a border, at their upper median.
    """
    import pandas as pd

    table = str.maketrans("ACGTacgt", "TGCATGCA")
    n = len(consensus)
    votes: dict[str, int | None] = {}
    for i in [*range(min(flank, max(0, n - k + 1))), *range(max(0, n - k + 1 - flank), max(0, n - k + 1))]:
        x = consensus[i : i + k]
        votes[x] = None if x in votes else (-i if i < flank else n - i)
    for i in range(flank, n - k + 1 - flank):
        if consensus[i : i + k] in votes:
            votes[consensus[i : i + k]] = None
    votes = {x: p for x, p in votes.items() if p is not None}

    def run(batches):
        for b in batches:
            out = []
            for name, seq in zip(b["name"], b["seq"], strict=True):
                for fwd, s in ((True, seq), (False, seq.translate(table)[::-1])):
                    at = sorted(i + votes[s[i : i + k]] for i in range(len(s) - k + 1) if s[i : i + k] in votes)
                    if len(at) >= least and 0 <= at[len(at) // 2] <= len(s):
                        out.append((name, fwd, at[len(at) // 2]))
            yield pd.DataFrame(out, columns=["node", "fwd", "at"])

    return nodes.select("name", "seq").where("seq is not null").mapInPandas(run, "node string, fwd boolean, at long")


def cut_loops(alignments: DataFrame, nodes: DataFrame, borders: DataFrame, min_length: int, max_clip: int = 500, least_anchored: int = 5000) -> DataFrame:
    """Loops of aligned reads: (``read``, ``start``, ``end``, ``length``, ``nodes``, ``from_anchor``, ``to_anchor``).

    ``alignments`` has ``read``, ``read_start``, ``read_end``, ``strand``, ``nodes``, ``left_clip``, ``right_clip`` and, for each path, ``overlaps`` (array, the first 0);
    ``borders`` has ``node``, ``fwd``, ``at`` and ``anchor`` (a tip: the locus ends there). A loop is the path between consecutive borders; its
    places in the read are interpolated; on the reverse strand ``start`` lies above ``end``. Loops are kept if they are of ``min_length`` or
    anchored, not anchored at both ends and under ``least_anchored``, and not cut by a clip over ``max_clip``.
    """
    a = alignments.withColumn("aln", F.monotonically_increasing_id())
    steps = a.select("aln", "left_clip", F.posexplode("nodes").alias("i", "n"), "overlaps").select("aln", "left_clip", "i", F.col("n.id").alias("node"), F.col("n.fwd").alias("fwd"), F.get("overlaps", F.col("i")).alias("overlap"))
    steps = steps.join(nodes.select(F.col("name").alias("node"), "len"), "node")
    w = W.partitionBy("aln").orderBy("i")
    steps = steps.withColumn("upto", F.sum(F.col("len") - F.coalesce("overlap", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("first", F.col("upto") - F.col("len"))
    total = steps.groupBy("aln").agg(F.max("upto").alias("path_bases"))
    breaks = steps.join(borders, ["node", "fwd"]).select("aln", "i", (F.col("first") + F.col("at")).alias("offset"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    order = W.partitionBy("aln").orderBy("offset", "i")
    cut = breaks.withColumns({"from": F.lag("offset").over(order), "i0": F.lag("i").over(order), "from_anchor": F.lag("anchor").over(order)}).where(F.col("from").isNotNull())
    cut = cut.join(a, "aln").join(total, "aln").withColumn("length", F.col("offset") - F.col("from"))
    inner = (F.col("left_clip") - F.col("from") <= max_clip) & (F.col("offset") - (F.col("path_bases") - F.col("right_clip")) <= max_clip)
    anchored = F.col("from_anchor") | F.col("anchor")
    good = inner & ((F.col("length") >= min_length) | anchored) & ~(F.col("from_anchor") & F.col("anchor") & (F.col("length") < least_anchored)) & (F.col("length") > 0)
    span = F.col("path_bases") - F.col("left_clip") - F.col("right_clip")
    lo, hi = F.when(F.col("strand") == "-", F.col("read_end")).otherwise(F.col("read_start")), F.when(F.col("strand") == "-", F.col("read_start")).otherwise(F.col("read_end"))
    place = lambda x: interpolate(F.least(F.greatest(F.col(x) - F.col("left_clip"), F.lit(0)), span), span, lo, hi)
    return cut.where(good).select("read", place("from").alias("start"), place("offset").alias("end"), "length", F.slice("nodes", F.col("i0") + 1, F.col("i") - F.col("i0") + 1).alias("nodes"), "from_anchor", F.col("anchor").alias("to_anchor"))


def missing_loops(expected: DataFrame, present: DataFrame, tolerance: int = 5000) -> DataFrame:
    """Expected loops (``read``, ``start``, ``end``) that no present loop matches within ``tolerance`` at both ends, on either strand."""
    span = lambda df: df.select("read", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    near = span(present).select("read", (F.col("start") - tolerance).alias("b_start"), (F.col("start") + tolerance + 1).alias("b_end"), F.col("end").alias("present_end"))
    e = span(expected).distinct()
    starts = e.select("read", "start", F.col("end").alias("far"), (F.col("start") + 1).alias("end"))
    met = overlap_join(starts, near, "read", 2 * tolerance + 2).where(F.abs(F.col("far") - F.col("present_end")) <= tolerance).select("read", "start", F.col("far").alias("end")).distinct()
    return e.join(met, ["read", "start", "end"], "left_anti")


def morph_graph(loops: DataFrame, gap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(edges ``src``, ``src_fwd``, ``dst``, ``dst_fwd``, ``coverage``; paths ``read``, ``chain``, ``morphs``) of loops (``read``, ``start``, ``end``, ``morph``).

    Consecutive loops of a read are chained where one begins within ``gap`` of the other's end; a reversed loop has start over end.
    """
    from looploom.operators.graph import edge_coverage

    d = loops.select("read", F.least("start", "end").alias("lo"), F.greatest("start", "end").alias("hi"), "morph", (F.col("start") <= F.col("end")).alias("fwd"))
    d = gap_chains(d, ["read"], "lo", "hi", gap, tie="morph")
    w = W.partitionBy("read", "chain").orderBy("lo", "hi", "morph")
    steps = d.select(F.col("morph").alias("src"), F.col("fwd").alias("src_fwd"), F.lead("morph").over(w).alias("dst"), F.lead("fwd").over(w).alias("dst_fwd")).where("dst is not null")
    paths = d.groupBy("read", "chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi", "morph", "fwd"))), lambda x: F.struct(x["morph"].alias("id"), x["fwd"].alias("fwd"))).alias("morphs"))
    return edge_coverage(steps), paths


def padded(loops: DataFrame, pad: int = 500, length: str = "read_len") -> DataFrame:
    """Loop ends moved out by ``pad`` within the read."""
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    return loops.withColumns({"lo": F.greatest(lo - pad, F.lit(0)), "hi": F.least(hi + pad, F.col(length))})


def raw_sequences(loops: DataFrame, reads: DataFrame, pad: int = 500) -> DataFrame:
    """Loops with the raw bases between their padded ends, reverse-complemented where start lies above end."""
    from looploom.functions.seq import revcomp

    d = padded(loops.join(reads.select(F.col("id").alias("read"), "seq", F.length("seq").alias("read_len")), "read"), pad)
    raw = F.substring("seq", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int"))
    return d.withColumn("raw", F.when(F.col("start") <= F.col("end"), raw).otherwise(revcomp(raw))).drop("seq", "lo", "hi")


def unit_breaks(reads: DataFrame, consensus: str, k: int = 21, flank: int = 200, least: int = 3, join: int = 50) -> DataFrame:
    """Where units begin in long reads: (``read``, ``read_len``, ``fwd``, ``breaks``), for the strand with more votes.

    K-mers from the two ends of the consensus that occur once in it vote for the place of a unit's beginning; votes within ``join`` bases are
    one break, at their upper median, if there are ``least`` of them.
    """
    import pandas as pd

    n, table = len(consensus), str.maketrans("ACGTacgt", "TGCATGCA")
    flank = min(flank, n // 2)
    seen: dict[str, int] = {}
    for i in range(n - k + 1):
        x = consensus[i : i + k]
        seen[x] = -1 if x in seen else i
    votes = {x: (-i if i < flank else n - i) for x, i in seen.items() if i >= 0 and (i < flank or i > n - k - flank)}

    def places(s: str) -> tuple[int, list[int]]:
        at = sorted(i + votes[x] for i in range(len(s) - k + 1) if (x := s[i : i + k]) in votes)
        runs: list[list[int]] = []
        for p in at:
            if runs and p - runs[-1][-1] <= join:
                runs[-1].append(p)
            else:
                runs.append([p])
        return len(at), [r[len(r) // 2] for r in runs if len(r) >= least and 0 <= r[len(r) // 2] <= len(s)]

    def run(batches):
        for b in batches:
            out = []
            for name, s in zip(b["id"], b["seq"], strict=True):
                (a, there), (c, back) = places(s), places(s.translate(table)[::-1])
                out.append((name, len(s), a >= c, there if a >= c else back))
            yield pd.DataFrame(out, columns=["read", "read_len", "fwd", "breaks"])

    return reads.select("id", "seq").where("seq is not null").mapInPandas(run, "read string, read_len long, fwd boolean, breaks array<long>")


def loops_between_breaks(reads: DataFrame, breaks: DataFrame, min_length: int) -> DataFrame:
    """Loops (``read``, ``start``, ``end``, ``raw``) between consecutive breaks of at least ``min_length`` bases, in the consensus' direction; ``start`` lies
    above ``end`` on the reverse strand."""
    from looploom.functions.seq import revcomp

    d = breaks.where(F.size("breaks") >= 2).select("read", "read_len", "fwd", F.posexplode("breaks").alias("i", "a"), "breaks").withColumn("b", F.get("breaks", F.col("i") + 1)).where(F.col("b").isNotNull() & (F.col("b") - F.col("a") >= min_length))
    d = d.join(reads.select(F.col("id").alias("read"), "seq"), "read").withColumn("s", F.when(F.col("fwd"), F.col("seq")).otherwise(revcomp("seq")))
    return d.select("read", F.when(F.col("fwd"), F.col("a")).otherwise(F.col("read_len") - F.col("a")).alias("start"), F.when(F.col("fwd"), F.col("b")).otherwise(F.col("read_len") - F.col("b")).alias("end"), F.substring("s", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")).alias("raw"))
