"""Round trips through the file formats, hashes and consensus paths on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from looploom.functions import seq as S
from looploom.operators import consensus, graph, nthash
from looploom.plans import relational as R
from looploom.sources import graphs, sequences
from looploom.tables import new_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf: f(spark, lambda n: spark.read.parquet(f"{sf}/{n}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("fasta_roundtrip", f"select 'r' || doc_id as id, {R.SQL_DNA} as seq from documents")
def _(spark, t):
    path = new_path(spark, "reads") + ".fa"
    sequences.write_fasta(R.reads(t).select(F.concat(F.lit("r"), "id").alias("id"), "seq"), path)
    return sequences.read_sequences(spark, path).select("id", "seq")


@query("gaf_roundtrip", R.PATH_SQL)
def _(spark, t):
    path = new_path(spark, "paths")
    p = R.order_paths(t).select(F.col("l_orderkey").cast("string").alias("read"), F.col("path").alias("nodes"), *[F.lit(0).alias(n) for n in ("read_len", "read_start", "read_end")], F.lit("+").alias("strand"), *[F.lit(0).alias(n) for n in ("path_len", "path_start", "path_end", "matches", "block_len")], F.lit(60).alias("mapq"))
    graphs.write_gaf(p, path)
    return graphs.read_gaf(spark, path).select(F.col("read").cast("bigint").alias("l_orderkey"), "path")


@query("gfa_roundtrip", f"with {R.SQL_EDGES} select src::varchar as src, src_fwd, dst::varchar as dst, dst_fwd from edges union select dst::varchar, not dst_fwd, src::varchar, not src_fwd from edges")
def _(spark, t):
    path = new_path(spark, "graph")
    e = R.oriented_edges(t)
    named = e.select(F.col("src").cast("string").alias("src"), "src_fwd", F.col("dst").cast("string").alias("dst"), "dst_fwd", F.lit(0).alias("overlap"), F.lit(1).alias("coverage"))
    nodes = named.select(F.col("src").alias("name")).union(named.select("dst")).distinct().select("name", F.lit("ACGT").alias("seq"), F.lit(4).alias("len"), F.lit(1).alias("coverage"))
    graphs.write_gfa(nodes, graph.mirrored(named), path)
    return graphs.read_gfa(spark, path)[1].select("src", "src_fwd", "dst", "dst_fwd")


@query("syncmer_select_nthash")
def _(spark, t):
    """Syncmers of the benchmark items by the rolling hash."""
    return nthash.syncmers(R.reference(t), 21, 11)


@query("recruit_match_nthash")
def _(spark, t):
    return nthash.match_counts(R.reads(t), R.reference(t), 21)


M64 = "18446744073709551616::uhugeint"


@query("wang_hash", f"""
with a as (select o_orderkey, ({M64} - 1 - o_orderkey::uhugeint + o_orderkey::uhugeint * 2097152) % {M64} as k from orders), b as (select o_orderkey, xor(k, k // 16777216) as k from a),
c as (select o_orderkey, (k + k * 8 + k * 256) % {M64} as k from b), d as (select o_orderkey, xor(k, k // 16384) as k from c), e as (select o_orderkey, (k + k * 4 + k * 16) % {M64} as k from d),
f as (select o_orderkey, xor(k, k // 268435456) as k from e), g as (select o_orderkey, (k + k * 2147483648) % {M64} as k from f)
select o_orderkey, case when k >= 9223372036854775808::uhugeint then (k::hugeint - 18446744073709551616::hugeint)::bigint else k::bigint end as hash from g""")
def _(spark, t):
    return t("orders").select("o_orderkey", S.wang_hash("o_orderkey").alias("hash"))


def visits(t):
    """Events of a user by time as a path, users in 50 clusters."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select((F.col("user_id") % 50).alias("cluster"), F.col("user_id").alias("loop"), i.alias("i"), F.col("event_type").alias("node"))


@query("majority_path_nodes", """
with n as (select user_id % 50 as cluster, user_id as lp, event_type as node, count(*) as times from events group by all), m as (select cluster, count(distinct lp) as loops from n group by cluster)
select cluster, node from n join m using (cluster) where times = 1 group by cluster, node, loops having 2 * count(*) > loops""")
def _(spark, t):
    return consensus.majority_nodes(visits(t))


@query("core_nodes_ranked", """
with v as (select l_orderkey % 5000 as cluster, l_orderkey as lp, l_linenumber % 5 as node, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, count(*) over (partition by l_orderkey) as n from lineitem),
m as (select cluster, count(distinct lp) as loops from v group by cluster),
g as (select cluster, node from (select cluster, node, lp, count(*) as times from v group by all) join m using (cluster) group by cluster, node, loops having count(*) = loops and max(times) = 1),
e as (select cluster, node from v group by cluster, node having bool_or(i = 1) and bool_or(i = n)),
r as (select cluster, lp, node, row_number() over (partition by cluster, lp order by i)::int as rank from v join g using (cluster, node) where (cluster, node) not in (select (cluster, node) from e))
select cluster, node, min(rank) as rank from r group by cluster, node having min(rank) = max(rank)""")
def _(spark, t):
    """Line numbers, five of them as nodes, that all orders of a cluster have once and in the same place."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return consensus.core_nodes(t("lineitem").select((F.col("l_orderkey") % 5000).alias("cluster"), F.col("l_orderkey").alias("loop"), i.alias("i"), (F.col("l_linenumber") % 5).alias("node")))


@query("consensus_path")
def _(spark, t):
    return consensus.consensus_paths(visits(t))


@query("node_anchors", """
with o as (select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nx from orders), s as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int as i, l_partkey % 50 as node from lineitem),
a as (select o_orderkey as pair, node, min(i) as i from o join s on o_orderkey = l_orderkey where nx is not null group by all having count(*) = 1),
b as (select o_orderkey as pair, node, min(i) as j from o join s on nx = l_orderkey group by all having count(*) = 1),
m as (select pair, node, i, j from a join b using (pair, node))
select pair, node, i, j from m x where not exists (select 1 from m y where x.pair = y.pair and x.node <> y.node and not ((y.i < x.i and y.j < x.j) or (y.i > x.i and y.j > x.j)))""")
def _(spark, t):
    """Parts that an order's path shares with that of the next order of the customer, in order."""
    from pyspark.sql import Window as W

    o = t("orders").select("o_orderkey", F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next")).where("next is not null")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    steps = t("lineitem").select("l_orderkey", place.alias("i"), (F.col("l_partkey") % 50).alias("node"))
    a = o.join(steps, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("pair"), "i", "node")
    b = o.join(steps, F.col("next") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("pair"), "i", "node")
    return consensus.node_anchors(a, b)
