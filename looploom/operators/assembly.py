"""From an assembly graph to reads of each tangle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from looploom.functions.seq import homopolymer_compress
from looploom.operators.graph import attach_ends, components_with_size, cyclic_core
from looploom.operators.intervals import tiered_assignment, unique_assignment
from looploom.operators.kmer import kmers, match_length, probes, with_reverse
from looploom.tables import materialize


def match_nodes(nodes: DataFrame, reference: DataFrame, k: int = 101, end: int = 50000, large: int = 100000, least: int = 2000, compress: bool = False) -> DataFrame:
    """(``name``, ``side``) of nodes (``name``, ``seq``) that match the reference (``id``, ``seq``). Nodes of under ``large`` bases need at least
    ``least`` matched bases in all; their side is null. Of larger ones, each end of ``end`` bases with more than ``least`` matched bases counts by
    itself: side ``<`` is the start, ``>`` the end. ``compress``: the graph is homopolymer-compressed, so the reference is too."""
    ref = reference.withColumn("seq", homopolymer_compress("seq")) if compress else reference
    long = F.length("seq") >= large
    pieces = F.when(long, F.array(F.substring("seq", F.lit(1), F.lit(end)), F.expr(f"right(seq, {end})"))).otherwise(F.array("seq"))
    parts = nodes.where("seq is not null").select("name", long.alias("long"), F.posexplode(pieces).alias("part", "seq"))
    parts = materialize(parts.select("name", "long", F.concat_ws("|", "name", F.col("part").cast("string")).alias("id"), "seq"), "ends")
    found = match_length(probes(parts, kmers(with_reverse(ref), k), k), k)
    good = parts.select("id", "name", "long").join(found, "id").where(F.when(F.col("long"), F.col("match_len") > least).otherwise(F.col("match_len") >= least))
    return good.select("name", F.when(F.col("long"), F.when(F.endswith("id", F.lit("|0")), "<").otherwise(">")).alias("side")).distinct()


def guess_tangles(nodes: DataFrame, edges: DataFrame, reference: DataFrame, k: int = 101, least_nodes: int = 10, compress: bool = False, **match) -> DataFrame:
    """(``tangle`` from 0, ``node``, ``end``): components of ``least_nodes`` matched small nodes or more that hold a directed cycle, with the large
    nodes one of whose matched ends leads to small nodes of one of them alone. A large node never joins components, and what did not match is no
    end. Tangles are numbered by size, large ones first, then by name, last first."""
    found = materialize(match_nodes(nodes, reference, k, compress=compress, **match), "matched")
    matched, sided = found.where("side is null").select("name"), found.where("side is not null")
    links = materialize(edges.select("src", "src_fwd", "dst", "dst_fwd").distinct(), "links")
    both = links.join(matched.withColumnRenamed("name", "src"), "src", "left_semi").join(matched.withColumnRenamed("name", "dst"), "dst", "left_semi")
    members = materialize(components_with_size(both.select("src", "dst"), least_nodes), "members")
    sign = lambda n, f: F.concat(F.when(F.col(f), ">").otherwise("<"), F.col(n))
    core = cyclic_core(both.select(sign("src", "src_fwd").alias("src"), sign("dst", "dst_fwd").alias("dst")))
    cyclic = core.select(F.substring("src", F.lit(2), F.length("src")).alias("node")).distinct().join(members, "node").select("component").distinct()
    members = members.join(cyclic, "component", "left_semi")
    # an edge leaves a node by its end (forward) or start, and enters it by the other
    out = lambda f: F.when(F.col(f), ">").otherwise("<")
    tips = links.select(F.col("src").alias("name"), out("src_fwd").alias("side"), F.col("dst").alias("near")).unionByName(links.select(F.col("dst").alias("name"), F.when(F.col("dst_fwd"), "<").otherwise(">").alias("side"), F.col("src").alias("near")))
    tips = tips.join(sided, ["name", "side"], "left_semi").select(F.concat_ws("|", "side", "name").alias("src"), F.col("near").alias("dst"))
    ends = attach_ends(tips, members).select("component", F.substring("node", F.lit(3), F.length("node")).alias("node")).distinct()
    named = members.groupBy("component").agg(F.count("*").alias("size"), F.max("node").alias("name"))
    rank = named.select("component", (F.row_number().over(W.orderBy(F.desc("size"), F.desc("name"))) - 1).alias("tangle"))
    return members.select("component", "node", F.lit(False).alias("end")).unionByName(ends.select("component", "node", F.lit(True).alias("end"))).join(rank, "component").select("tangle", "node", "end")


def paths_of_tangles(tangles: DataFrame, node_paths: DataFrame) -> DataFrame:
    """(``path``, ``tangle``) where a path's nodes name one tangle; inner nodes of tangles go before end nodes."""
    rows = tangles.join(node_paths, "node").select("path", "tangle", F.when(F.col("end"), 2).otherwise(1).alias("tier"))
    return tiered_assignment(rows, "path", "tangle", "tier")


def reads_of_tangles(read_pieces: DataFrame, piece_paths: DataFrame, path_tangle: DataFrame) -> DataFrame:
    """(``read``, ``tangle``) of reads all of whose assembly pieces lie in paths of one tangle."""
    return unique_assignment(read_pieces.join(piece_paths, "piece").join(path_tangle, "path"), "read", "tangle")


def unfold(node_map: DataFrame, lengths: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """Nodes as paths of nodes that stand for nothing else: (``node``, ``i``, ``part``, ``fwd``), in order, by joining the map with itself until
    no part can be replaced. A part of reversed orientation is replaced by its path read backwards."""
    steps = materialize(node_map.select("node", F.posexplode("nodes").alias("i", "n")).select("node", F.col("i").cast("long").alias("i"), F.col("n.id").alias("part"), F.col("n.fwd").alias("fwd")), "map")
    table = materialize(steps.select(F.col("node").alias("part"), F.col("i").alias("j"), F.col("part").alias("sub"), F.col("fwd").alias("sub_fwd")), "map")
    size = table.groupBy("part").agg(F.count("*").alias("size"))
    for _ in range(max_rounds):
        grown = steps.join(table, "part", "left").join(size, "part", "left")
        if grown.where("sub is not null").isEmpty():
            return steps
        j = F.when(F.col("fwd"), F.col("j")).otherwise(F.col("size") - 1 - F.col("j"))
        new = grown.select("node", "i", F.coalesce(j, F.lit(0)).alias("j"), F.coalesce("sub", "part").alias("part"), F.when(F.col("sub").isNull(), F.col("fwd")).otherwise(F.col("fwd") == F.col("sub_fwd")).alias("fwd"))
        new = new.select("node", (F.row_number().over(W.partitionBy("node").orderBy("i", "j")) - 1).cast("long").alias("i"), "part", "fwd")
        steps = materialize(new, "map")
    raise RuntimeError("the map refers to itself")


def reads_touching(alignments: DataFrame, intervals: DataFrame) -> DataFrame:
    """(``read``, ``tangle``): reads whose path has a node of the tangle; a path's first and last node must reach into the valid part.

    ``alignments``: ``read``, ``nodes``, ``left_clip``, ``right_clip``; ``intervals``: ``tangle``, ``node``, ``len``, ``lo``, ``hi`` (valid part, on the forward strand).
    """
    n = F.size("nodes")
    steps = alignments.select("read", n.alias("n"), "left_clip", "right_clip", F.posexplode("nodes").alias("i", "x")).select("read", "n", "i", "left_clip", "right_clip", F.col("x.id").alias("node"), F.col("x.fwd").alias("fwd"))
    d = steps.join(intervals, "node")
    a = F.when(F.col("i") == 0, F.col("left_clip")).otherwise(F.lit(0))
    b = F.col("len") - F.when(F.col("i") == F.col("n") - 1, F.col("right_clip")).otherwise(F.lit(0))
    lo, hi = F.when(F.col("fwd"), a).otherwise(F.col("len") - b), F.when(F.col("fwd"), b).otherwise(F.col("len") - a)
    return d.where((lo < F.col("hi")) & (hi > F.col("lo"))).select("read", "tangle").distinct()


def placed_reads(placements: DataFrame, tangles: DataFrame, nodes: DataFrame, window: int = 50000) -> DataFrame:
    """(``read``, ``tangle``) of placements (``node``, ``pos``, ``read``, ``read_len``) on tangle nodes; on end nodes only those that overlap the ``window``
    bases nearest the tangle (``fwd``: the tangle lies after the node's end; null: either end)."""
    d = placements.join(tangles, "node").join(nodes.select(F.col("name").alias("node"), "len"), "node")
    at_end = F.col("pos") + F.col("read_len") > F.col("len") - window
    at_start = F.col("pos") < window
    fwd = F.col("fwd") if "fwd" in tangles.columns else F.lit(None).cast("boolean")
    near = F.when(fwd, at_end).when(~fwd, at_start).otherwise(at_end | at_start)
    return d.where(~F.col("end") | near).select("read", "tangle").distinct()


def alignment_tiers(alignments: DataFrame, tangle_nodes: DataFrame, slack: int = 1000, mapq: int = 20) -> DataFrame:
    """(``read``, ``tangle``) of long reads by their best kind of alignment: full length and of good quality, good quality, any; reads whose best
    alignments name several tangles are left out."""
    full = (F.col("read_start") < slack) & (F.col("read_end") + slack > F.col("read_len"))
    tier = F.when(full & (F.col("mapq") >= mapq), 1).when(F.col("mapq") >= mapq, 2).otherwise(3)
    rows = alignments.select("read", tier.alias("tier"), F.explode("nodes").alias("n")).select("read", "tier", F.col("n.id").alias("node")).join(tangle_nodes.select("node", "tangle"), "node")
    return tiered_assignment(rows, "read", "tangle", "tier")


def merged_graphs(nodes: DataFrame, edges: DataFrame, key: str = "tangle") -> tuple[DataFrame, DataFrame]:
    """Graphs of several tangles as one: names get the prefix ``tangle{n}_``; border nodes are cut to the length of the shortest one, but keep more
    than the longest overlap."""
    name = lambda c: F.concat(F.lit("tangle"), F.col(key).cast("string"), F.lit("_"), F.col(c))
    border = F.startswith("name", F.lit("border"))
    shortest = nodes.where(border).agg(F.min("len").alias("cut"))
    overlap = edges.agg(F.coalesce(F.max("overlap"), F.lit(0)).alias("lap"))
    d = nodes.crossJoin(F.broadcast(shortest)).crossJoin(F.broadcast(overlap))  # one row each
    cut = F.greatest(F.col("cut"), F.col("lap") + 1)
    seq = F.when(border & (F.col("len") > cut), F.substring("seq", F.lit(1), cut.cast("int"))).otherwise(F.col("seq"))
    return d.select(name("name").alias("name"), seq.alias("seq"), F.length(seq).cast("long").alias("len"), "coverage"), edges.select(name("src").alias("src"), "src_fwd", name("dst").alias("dst"), "dst_fwd", "overlap", "coverage")


def branches(read_paths: DataFrame, cycle_nodes: DataFrame, nodes: DataFrame, least: int = 5000) -> DataFrame:
    """(``nodes``, ``coverage``) of flanks beyond the cycle over ``least`` bases: what follows a read's last cycle node, and what precedes its first
    one read backwards, each with that cycle node in front; flanks that are the beginning of another are dropped."""
    from looploom.functions.seq import flip_path, path_string

    both = read_paths.select("nodes").unionAll(read_paths.select(flip_path("nodes").alias("nodes")))
    p = both.withColumn("p", F.monotonically_increasing_id())
    p = materialize(p, "paths")
    steps = p.select("p", F.posexplode("nodes").alias("i", "n")).select("p", "i", F.col("n.id").alias("name")).join(nodes.select("name", "len"), "name").join(cycle_nodes.select("name", F.lit(True).alias("inside")), "name", "left")
    last = steps.groupBy("p").agg(F.max(F.when(F.col("inside"), F.col("i"))).alias("last")).where("last is not null")
    flank = steps.join(last, "p").where("i > last").groupBy("p", "last").agg(F.sum("len").alias("bases")).where(F.col("bases") > least)
    found = p.join(flank, "p").select(F.expr("slice(nodes, last + 1, size(nodes) - last)").alias("nodes"))
    counted = found.groupBy("nodes").agg(F.count("*").alias("n")).withColumn("text", F.concat(path_string("nodes"), F.lit(">"))).withColumn("text", F.regexp_replace("text", "(?<=.)([<>])", "|$1"))
    first = F.substring_index("text", "|", 2)
    a = counted.withColumn("head", first)
    b = a.select("head", F.col("text").alias("longer"), F.col("n").alias("more"))
    ext = a.join(b, "head").where("longer <> text and startswith(longer, substr(text, 1, length(text) - 1))")
    prefixes = ext.select("text").distinct()
    # coverage of a kept branch: reads whose flank begins with it
    return a.join(prefixes, "text", "left_anti").select("nodes", F.col("n").alias("coverage"))
