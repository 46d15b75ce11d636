"""Queries of the clustering and alignment operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from looploom.functions.seq import dna
from looploom.operators import clusters, grouped
from looploom.plans import relational

QUERIES: dict = {}
ORACLE_SQL: dict = {}
RADIUS, LEAST = 4, 3


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(lambda n: spark.read.parquet(f"{sf}/{n}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Strings of these queries: the distinct names of parts.
SQL_KINDS = "kinds as (select min(p_partkey) as id, p_name as seq from part group by 2)"


def kinds(t) -> DataFrame:
    return t("part").groupBy(F.col("p_name").alias("seq")).agg(F.min("p_partkey").alias("id"))


SQL_PAIRS = f"with recursive {SQL_KINDS}, pairs as (select a.id as a, b.id as b, levenshtein(a.seq, b.seq)::int as dist from kinds a join kinds b on a.id < b.id and abs(length(a.seq) - length(b.seq)) <= {RADIUS} where levenshtein(a.seq, b.seq) <= {RADIUS})"
SQL_WAYS = "ways as (select a, b from pairs union all select b, a from pairs)"


@query("length_band_pairs", f"with {SQL_KINDS} select a.id as a, b.id as b, abs(length(a.seq) - length(b.seq))::int as gap from kinds a join kinds b on a.id < b.id and abs(length(a.seq) - length(b.seq)) <= 2 and levenshtein(a.seq, b.seq) <= 2")
def _(t):
    k = kinds(t)
    n = k.select(F.col("id"), F.length("seq").alias("n"))
    p = clusters.length_band_pairs(k, 2)
    return p.join(n.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"id": "b", "n": "nb"}), "b").select("a", "b", F.abs(F.col("na") - F.col("nb")).alias("gap"))


@query("edit_distance_pairs", f"{SQL_PAIRS} select * from pairs")
def _(t):
    return clusters.length_band_pairs(kinds(t), RADIUS)


@query("rough_cluster", f"{SQL_PAIRS}, {SQL_WAYS}, walk as (select id as node, id as r from kinds union select b, r from walk join ways on node = a) select node as id, min(r) as cluster from walk group by node")
def _(t):
    return clusters.rough_clusters(kinds(t), RADIUS)


@query("edit_histogram_peak", f"{SQL_PAIRS}, h as (select dist, count(*) as n from pairs where dist < {RADIUS} group by dist) select max_by(dist, n * 1000 + dist) as peak, max(n) as n from h")
def _(t):
    return clusters.distance_histogram_peak(clusters.length_band_pairs(kinds(t), RADIUS), RADIUS + 1)


@query("dbscan", f"""{SQL_PAIRS}, {SQL_WAYS}, core as (select a as id from ways group by a having count(*) >= {LEAST}), cw as (select a, b from ways where a in (select id from core) and b in (select id from core)),
walk as (select id as node, id as r from core union select b, r from walk join cw on node = a), lab as (select node as id, min(r) as cluster from walk group by node),
bord as (select a as id, min(cluster) as cluster from ways join lab on b = lab.id where a not in (select id from core) group by a having min(cluster) = max(cluster))
select kinds.id, coalesce(lab.cluster, bord.cluster) as cluster, lab.id is not null as core from kinds left join lab on kinds.id = lab.id left join bord on kinds.id = bord.id""")
def _(t):
    k = kinds(t)
    return clusters.dbscan(k, clusters.length_band_pairs(k, RADIUS), LEAST)


@query("edit_script")
def _(t):
    """Edits from each kind of part to the alphabetically next one."""
    from pyspark.sql import Window as W

    k = kinds(t).withColumn("g", F.substring("seq", 1, 1))
    nxt = k.withColumn("query", F.lead("seq").over(W.partitionBy("g").orderBy("seq"))).where("query is not null")
    return nxt.select("id", "seq", "query", F.explode(grouped.edit_script("seq", "query")).alias("e")).select("id", "seq", "query", "e.*")


@query("longest_chain")
def _(t):
    """Longest increasing chain of each document's anchors in each benchmark item."""
    points = relational.anchored(t).groupBy("id", "item_id").agg(F.collect_list(F.struct("ref_pos", "pos")).alias("p"))
    return points.select("id", "item_id", F.explode(grouped.longest_chain("p")).alias("x")).select("id", "item_id", "x.ref_pos", "x.pos")


def clustered(t) -> DataFrame:
    """Benchmark items as loops, in clusters by their first two bases."""
    s = t("benchmark").select(F.col("item_id").alias("id"), dna("text").alias("seq"))
    return s.withColumn("cluster", F.substring("seq", 1, 2))


@query("polish")
def _(t):
    return grouped.polished(clustered(t))


@query("self_correct")
def _(t):
    return grouped.self_corrected(clustered(t))


@query("phase_split")
def _(t):
    return grouped.phased(clustered(t))


@query("density_split")
def _(t):
    return clusters.density_split(clustered(t), max_edits=60)


@query("de_bruijn_graph")
def _(t):
    """Unitigs of the benchmark items of each cluster."""
    return grouped.de_bruijn(clustered(t), 15, 1, "cluster")[0]


@query("heaviest_cycle")
def _(t):
    """Benchmark items read as rings of their own: graph, heaviest cycle and consensus of each."""
    ring = t("benchmark").select(F.col("item_id").alias("tangle"), F.col("item_id").alias("id"), dna("text").alias("seq")).withColumn("seq", F.concat("seq", "seq"))
    return grouped.heaviest_cycles(*grouped.de_bruijn(ring, 31, 1))
