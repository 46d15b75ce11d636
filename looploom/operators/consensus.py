"""Consensus paths of clusters of loops, and anchors between node paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def core_nodes(paths: DataFrame) -> DataFrame:
    """(``cluster``, ``node``, ``rank``): nodes that every loop of a cluster (``cluster``, ``loop``, ``i``, ``node``) has exactly once, at the same rank among
    such nodes in all loops; a node that is both a first and a last node of loops is none."""
    n = paths.groupBy("cluster").agg(F.count_distinct("loop").alias("loops"))
    seen = paths.groupBy("cluster", "node", "loop").agg(F.count("*").alias("times")).groupBy("cluster", "node").agg(F.count("*").alias("in_loops"), F.max("times").alias("most"))
    w = W.partitionBy("cluster", "loop")
    ends = paths.withColumns({"first": F.col("i") == F.min("i").over(w), "last": F.col("i") == F.max("i").over(w)}).groupBy("cluster", "node").agg(F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))
    good = seen.join(n, "cluster").where("in_loops = loops and most = 1").join(ends, ["cluster", "node"]).where("not (first and last)").select("cluster", "node")
    ranked = paths.join(good, ["cluster", "node"]).withColumn("rank", F.row_number().over(W.partitionBy("cluster", "loop").orderBy("i")))
    same = ranked.groupBy("cluster", "node").agg(F.min("rank").alias("rank"), F.max("rank").alias("hi")).where("rank = hi")
    return same.select("cluster", "node", "rank")


def majority_nodes(paths: DataFrame) -> DataFrame:
    """(``cluster``, ``node``): nodes that more than half of a cluster's loops have exactly once."""
    n = paths.groupBy("cluster").agg(F.count_distinct("loop").alias("loops"))
    once = paths.groupBy("cluster", "node", "loop").agg(F.count("*").alias("times")).where("times = 1").groupBy("cluster", "node").agg(F.count("*").alias("in_loops"))
    return once.join(n, "cluster").where("2 * in_loops > loops").select("cluster", "node")


def consensus_paths(paths: DataFrame) -> DataFrame:
    """(``cluster``, ``path``): between consecutive core nodes, and before the first and after the last, the node string that most loops have (of
    equals the smallest)."""
    core = core_nodes(paths).withColumn("core", F.lit(True))
    d = paths.join(core, ["cluster", "node"], "left")
    w = W.partitionBy("cluster", "loop").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("piece", F.sum(F.when(F.col("core"), 1).otherwise(0)).over(w))
    alleles = d.groupBy("cluster", "loop", "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("nodes"))
    count = alleles.groupBy("cluster", "piece", "nodes").agg(F.count("*").alias("n"))
    best = count.groupBy("cluster", "piece").agg(F.min_by("nodes", F.struct(-F.col("n"), F.col("nodes"))).alias("nodes"), F.sum("n").alias("with"))
    loops = paths.groupBy("cluster").agg(F.count_distinct("loop").alias("loops"))
    # a loop without nodes before the first core node has the empty string there
    best = best.join(loops, "cluster").where("piece > 0 or 2 * with > loops")
    return best.groupBy("cluster").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "nodes"))), lambda x: x["nodes"])).alias("path"))


def node_anchors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(``pair``, ``node``, ``i``, ``j``): nodes that stand once in each path of a pair (``pair``, ``i``, ``node``) and cross no other such node."""
    once = lambda df, i: df.groupBy("pair", "node").agg(F.count("*").alias("n"), F.min("i").alias(i)).where("n = 1").drop("n")
    m = once(a, "i").join(once(b, "j"), ["pair", "node"])
    w = W.partitionBy("pair").orderBy("i")
    before, after = F.max("j").over(w.rowsBetween(W.unboundedPreceding, -1)), F.min("j").over(w.rowsBetween(1, W.unboundedFollowing))
    d = m.withColumns({"lo": before, "hi": after})
    return d.where("(lo is null or lo < j) and (hi is null or hi > j)").select("pair", "node", "i", "j")
