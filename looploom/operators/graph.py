"""Operators on bidirected sequence graphs and on directed graphs of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from looploom.functions.seq import revcomp
from looploom.operators.components import connected_components
from looploom.tables import materialize


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges (``src``, ``src_fwd``, ``dst``, ``dst_fwd``, …) with their mirror images, each once."""
    rest = [x for x in edges.columns if x not in ("src", "src_fwd", "dst", "dst_fwd")]
    back = edges.select(F.col("dst").alias("src"), (~F.col("dst_fwd")).alias("src_fwd"), F.col("src").alias("dst"), (~F.col("src_fwd")).alias("dst_fwd"), *rest)
    return edges.select("src", "src_fwd", "dst", "dst_fwd", *rest).unionByName(back).distinct()


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges in the smaller of their two readings: reverse nodes come before forward ones, then by id."""
    a = F.struct(F.col("src_fwd").alias("x"), F.col("src").alias("y"), F.col("dst_fwd").alias("z"), F.col("dst").alias("w"))
    b = F.struct((~F.col("dst_fwd")).alias("x"), F.col("dst").alias("y"), (~F.col("src_fwd")).alias("z"), F.col("src").alias("w"))
    rest = [x for x in edges.columns if x not in ("src", "src_fwd", "dst", "dst_fwd")]
    return edges.select(F.least(a, b).alias("e"), *rest).select(F.col("e.y").alias("src"), F.col("e.x").alias("src_fwd"), F.col("e.w").alias("dst"), F.col("e.z").alias("dst_fwd"), *rest)


def edge_coverage(edges: DataFrame) -> DataFrame:
    """How often each edge is seen, in either reading."""
    return canonical_edges(edges.select("src", "src_fwd", "dst", "dst_fwd")).groupBy("src", "src_fwd", "dst", "dst_fwd").agg(F.count("*").alias("coverage"))


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Nodes (``node``) that directed edges (``src``, ``dst``) reach from ``starts`` (``node``), these included.

    A round joins the newest nodes only; the table of nodes seen is written to the shared folder each round.
    """
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    seen = front = materialize(starts.select("node").distinct(), "seen")
    for _ in range(max_rounds):
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = materialize(new, "front")
        if front.isEmpty():
            return seen
        seen = materialize(seen.unionByName(front), "seen")
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def cyclic_core(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Edges that are left when nodes without edges in or out are taken away again and again: empty if and only if there is no directed cycle."""
    e = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    n = e.count()
    for _ in range(max_rounds):
        left = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        e = materialize(left, "edges")
        m = e.count()
        if m == n:
            return e
        n = m
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def has_cycle(edges: DataFrame) -> bool:
    """Whether a directed graph has a cycle."""
    return not cyclic_core(edges).isEmpty()


def components_with_size(edges: DataFrame, least: int = 1) -> DataFrame:
    """Components (``node``, ``component``, ``size``) of at least so many nodes."""
    found = connected_components(edges)
    size = found.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return found.join(size, "component").select("node", "component", "size")


def attach_ends(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes outside all components whose neighbours in components all lie in one: (``node``, ``component``)."""
    sides = edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("near")))
    inside = members.select(F.col("node").alias("near"), "component")
    out = sides.join(members.select("node"), "node", "left_anti").join(inside, "near")
    return out.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("hi")).where("component = hi").select("node", "component")


def bubbles(edges: DataFrame) -> DataFrame:
    """Simple bubbles (``src``, ``dst``, ``a``, ``b``): two nodes with one edge in, from ``src``, and one out, to ``dst``, and ``src`` and ``dst`` have no other such way."""
    e = edges.select("src", "dst").distinct()
    one_out = e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select(F.col("src").alias("mid"), "dst")
    one_in = e.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").select(F.col("dst").alias("mid"), "src")
    ways = one_in.join(one_out, "mid")
    return ways.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("mid").alias("a"), F.max("mid").alias("b")).where("n = 2 and src <> dst").select("src", "dst", "a", "b")


def path_lengths(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Length in bases of paths (``id``, ``i``, ``node``, ``fwd``) over nodes (``node``, ``len``) and edges with ``overlap``: node lengths
    less the overlaps of consecutive nodes."""
    from pyspark.sql import Window as W

    w = W.partitionBy("id").orderBy("i")
    steps = paths.withColumns({"nxt": F.lead("node").over(w), "nxt_fwd": F.lead("fwd").over(w)}).join(nodes, "node")
    lap = mirrored(edges).select(F.col("src").alias("node"), F.col("src_fwd").alias("fwd"), F.col("dst").alias("nxt"), F.col("dst_fwd").alias("nxt_fwd"), "overlap")
    return steps.join(lap, ["node", "fwd", "nxt", "nxt_fwd"], "left").groupBy("id").agg(F.sum(F.col("len") - F.coalesce("overlap", F.lit(0))).cast("bigint").alias("length"))


def path_sequences(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sequence of each path: node sequences (reverse complements where a node is reversed) without the overlap with the node before."""
    from pyspark.sql import Window as W

    w = W.partitionBy("id").orderBy("i")
    steps = paths.withColumns({"prev": F.lag("node").over(w), "prev_fwd": F.lag("fwd").over(w)}).join(nodes, "node")
    lap = mirrored(edges).select(F.col("src").alias("prev"), F.col("src_fwd").alias("prev_fwd"), F.col("dst").alias("node"), F.col("dst_fwd").alias("fwd"), "overlap")
    part = steps.join(lap, ["prev", "prev_fwd", "node", "fwd"], "left").select("id", "i", F.substring(F.when(F.col("fwd"), F.col("seq")).otherwise(revcomp("seq")), F.coalesce("overlap", F.lit(0)) + 1, F.length("seq")).alias("part"))
    return part.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("seq"))
