"""Connected components of an undirected graph that need not fit one machine.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Each step is a
grouped minimum, which Spark combines before the shuffle, and a join that AQE can split where one node has very many neighbours; no
neighbour list is ever gathered. The edge set is written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from looploom.tables import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Large star: link larger neighbours of a node to its smallest; small star: the others and itself."""
    if large:
        sides = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = sides.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        # the edge (u, m) itself comes out of the join as (m, m), so it is added from the minima
        out = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of the graph with the given edges: one row (``node``, ``component``) for each node that has an edge to another.

    ``component`` is the smallest node of the component. Edges may come in any direction and repeat; self-loops and edges with a null end
    are ignored; nodes without edges have no row. An empty edge table gives an empty result.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"`{src}` is not null and `{dst}` is not null").where("u <> v").distinct()
    e, before = materialize(e, "edges"), None
    for _ in range(max_rounds):
        e = materialize(_star(_star(e, large=True), large=False), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            # at the fixed point every edge leads from a node to the smallest node of its component
            roots = e.select("v").distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
