"""Queries of the relational layer on the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from looploom.functions import seq as S
from looploom.operators import graph as G, intervals as I, kmer as K
from looploom.operators.components import connected_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SQL_DNA = f"regexp_replace(translate(text, '{S.LETTERS}', '{S.BASES}'), '[^ACGT]', '', 'g')"
RECRUIT_K, RECRUIT_MIN = 15, 50


def query(name: str, sql: str | None = None):
    """Register a function of a table reader ``t(name)`` as a query."""

    def add(f):
        QUERIES[name] = lambda spark, sf: f(lambda n: spark.read.parquet(f"{sf}/{n}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def reads(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), S.dna("text").alias("seq"))


def reference(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("id"), S.dna("text").alias("seq"))


# ---- scalar functions -------------------------------------------------------------------------------------------------------------


@query("revcomp", f"select doc_id, translate(reverse({SQL_DNA}), 'ACGT', 'TGCA') as rc from documents")
def _(t):
    return t("documents").select("doc_id", S.revcomp(S.dna("text")).alias("rc"))


@query("homopolymer_compress", f"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({SQL_DNA}, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') as hpc from documents")
def _(t):
    return t("documents").select("doc_id", S.homopolymer_compress(S.dna("text")).alias("hpc"))


@query("base_composition", f"select doc_id, length(s) as n, length(s) - length(replace(s, 'A', '')) as a, length(s) - length(replace(s, 'C', '')) as c, length(s) - length(replace(s, 'G', '')) as g, length(s) - length(replace(s, 'T', '')) as t from (select doc_id, {SQL_DNA} as s from documents)")
def _(t):
    d = t("documents").select("doc_id", S.dna("text").alias("s"))
    return d.select("doc_id", F.length("s").cast("bigint").alias("n"), *[F.regexp_count("s", F.lit(b)).cast("bigint").alias(b.lower()) for b in "ACGT"])


@query("base_codes", f"select doc_id, translate(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'A', 'g'), 'ACGT', '0123') as codes from documents")
def _(t):
    up = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return t("documents").select("doc_id", F.translate(F.regexp_replace(up, "[^ACGT]", "A"), "ACGT", "0123").alias("codes"))


@query("name_without_tags", "select doc_id, regexp_extract(text, '^[^ \t]*', 0) as name from documents")
def _(t):
    return t("documents").select("doc_id", S.name_without_tags("text").alias("name"))


@query("split_nonempty", "select page_id, list_filter(string_split(url, '/'), lambda x: x <> '') as fields from pages")
def _(t):
    return t("pages").select("page_id", S.split_nonempty("url", "/").alias("fields"))


PATH_SQL = "select l_orderkey, string_agg(case when l_suppkey % 2 = 0 then '>' else '<' end || l_partkey, '' order by l_linenumber, l_partkey::varchar, l_suppkey % 2 = 0) as path from lineitem group by l_orderkey"


def order_paths(t) -> DataFrame:
    """Each order as a path: its parts by line number, forward for even suppliers."""
    n = F.struct("l_linenumber", S.node(F.col("l_partkey").cast("string"), F.col("l_suppkey") % 2 == 0).alias("n"))
    return t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(n)), lambda x: x["n"]).alias("path"))


@query("parse_path", f"with p as ({PATH_SQL}), x as (select l_orderkey, unnest(regexp_extract_all(path, '[<>][^<>]+')) as s, generate_subscripts(regexp_extract_all(path, '[<>][^<>]+'), 1) as i from p) select l_orderkey, i::bigint as i, substr(s, 2) as id, s[1] = '>' as fwd from x")
def _(t):
    text = order_paths(t).select("l_orderkey", S.path_string("path").alias("p"))
    return text.select("l_orderkey", F.posexplode(S.parse_path("p")).alias("i", "n")).select("l_orderkey", (F.col("i") + 1).cast("bigint").alias("i"), "n.id", "n.fwd")


@query("canonical_path", """
with n as (select l_orderkey, l_linenumber as i, l_partkey::varchar as id, l_suppkey % 2 = 0 as fwd from lineitem),
p as (select l_orderkey, list({'f': fwd, 'i': id} order by i, id, fwd) as a, list({'f': not fwd, 'i': id} order by i desc, id desc, fwd desc) as b,
  string_agg(case when fwd then '>' else '<' end || id, '' order by i, id, fwd) as sa, string_agg(case when fwd then '<' else '>' end || id, '' order by i desc, id desc, fwd desc) as sb from n group by l_orderkey)
select l_orderkey, case when a <= b then sa else sb end as path from p""")
def _(t):
    return order_paths(t).select("l_orderkey", S.path_string(S.canonical_path("path")).alias("path"))


@query("variant_predicates", """
select l_orderkey, l_linenumber, r <> length(a) as indel, r = 1 and length(a) = 1 as snp, r = 2 and length(a) = 2 as double_snp, abs(r - length(a)) >= 10 as big_indel
from (select l_orderkey, l_linenumber, (l_partkey % 14)::int as r, substr('ACGTACGTACGTACGT', 1, (l_suppkey % 15)::int) as a from lineitem)""")
def _(t):
    e = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 14).cast("int").alias("r"), F.substring(F.lit("ACGTACGTACGTACGT"), F.lit(1), (F.col("l_suppkey") % 15).cast("int")).alias("a"))
    return e.select("l_orderkey", "l_linenumber", S.is_indel("r", "a").alias("indel"), S.is_snp("r", "a").alias("snp"), S.is_double_snp("r", "a").alias("double_snp"), S.is_big_indel("r", "a").alias("big_indel"))


def microsatellites(t) -> DataFrame:
    """Stretches of four bases, one at every base, taken as indels between their neighbours: how many are microsatellite changes."""
    d = t("documents").select("doc_id", S.dna("text").alias("s")).select("doc_id", "s", F.col("s").cast("binary").alias("b"))
    d = d.where(F.length("s") >= 5).select("doc_id", "b", F.explode(F.sequence(F.lit(1), F.length("s") - 4)).alias("p"))
    cut = lambda a, n: F.substring(F.col("b"), a, n).cast("string")
    low = F.greatest(F.col("p") - 12, F.lit(1))
    e = d.select("doc_id", cut(low, F.col("p") - low).alias("l"), cut(F.col("p"), F.lit(4)).alias("x"), cut(F.col("p") + 4, F.lit(12)).alias("r"))
    return e.groupBy("doc_id").agg(F.count_if(S.is_microsatellite("x", "l", "r", 4)).alias("n"))


@query("microsatellite_indel", f"""
with d as (select doc_id, {SQL_DNA} as s from documents),
e as (select doc_id, p, substr(s, greatest(p - 12, 1), p - greatest(p - 12, 1)) as l, substr(s, p, 4) as x, substr(s, p + 4, 12) as r from (select doc_id, s, unnest(range(1, length(s) - 3)) as p from d))
select doc_id, count(*) filter (where (substr(x,1,1) = substr(x,2,1) and substr(x,1,1) = substr(x,3,1) and substr(x,1,1) = substr(x,4,1) and (suffix(l, substr(x,1,1)) or prefix(r, substr(x,1,1))))
  or (substr(x,1,2) = substr(x,3,2) and (suffix(l, substr(x,1,2)) or prefix(r, substr(x,1,2)))) or suffix(l, x) or prefix(r, x)) as n from e group by doc_id""")
def _(t):
    return microsatellites(t)


@query("morph_names", """
select c_custkey, case when n <> '' then n || '_' else '' end || 'morphconsensus' || c_custkey || '_' || k || '_coverage' || c_nationkey as name
from (select *, case when c_nationkey % 2 = 0 then c_mktsegment else '' end as n, case when s and e then 'isolated' when s then 'borderone' when e then 'bordertwo' else 'inner' end as k
  from (select *, c_acctbal > 2000 as s, c_acctbal < 7000 as e from customer))""")
def _(t):
    d = t("customer").withColumns({"n": F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), "k": S.morph_type(F.col("c_acctbal") > 2000, F.col("c_acctbal") < 7000)})
    return d.select("c_custkey", S.morph_name("n", "c_custkey", "k", "c_nationkey").alias("name"))


@query("popcount", "select o_orderkey, bit_count(o_orderkey * 2654435761)::int as bits from orders")
def _(t):
    return t("orders").select("o_orderkey", F.bit_count(F.col("o_orderkey") * 2654435761).cast("int").alias("bits"))


@query("partwise_substring", f"select doc_id, unnest(range(0, 10))::int as part, substr(s, (length(s) * unnest(range(0, 10)) // 10)::bigint + 1, (length(s) * (unnest(range(0, 10)) + 1) // 10 - length(s) * unnest(range(0, 10)) // 10)::bigint) as seq from (select doc_id, {SQL_DNA} as s from documents)")
def _(t):
    return t("documents").select("doc_id", F.posexplode(S.parts(S.dna("text"))).alias("part", "seq"))


# ---- k-mers -----------------------------------------------------------------------------------------------------------------------

SQL_READS = f"reads as (select doc_id as id, {SQL_DNA} as seq from documents)"
SQL_REF = f"ref as (select item_id as id, {SQL_DNA} as seq from benchmark)"


def sql_kmers(source: str, k: int, skip: int = 0) -> str:
    return f"select id, p - 1 as pos, substr(seq, p, {k}) as kmer from (select id, seq, unnest(range(1, length(seq) - {k} + 2 - {skip})) as p from {source})"


@query("kmer_count", f"with {SQL_REF}, k as ({sql_kmers('ref', 9)}) select kmer, count(distinct id) as n_reads, count(*) as n_total from k group by kmer")
def _(t):
    return K.kmer_read_counts(reference(t), 9)


@query("kmer_unique_ref", f"with {SQL_REF}, k as ({sql_kmers('ref', 11)}) select kmer, min(id) as id, min(pos)::int as pos from k group by kmer having count(*) = 1")
def _(t):
    return K.unique_kmers(reference(t), 11).select("kmer", "id", F.col("pos").cast("int").alias("pos"))


@query("syncmer_select_lex", f"""
with {SQL_REF}, k as ({sql_kmers('ref', 11)}),
w as (select id, pos, kmer as h, min(kmer) over (partition by id order by pos rows between current row and 10 following) as least, lead(kmer, 10) over (partition by id order by pos) as last from k)
select id, pos::int as pos from w where last is not null and (h = least or last = least)""")
def _(t):
    return K.syncmers(reference(t), 21, 11).select("id", F.col("pos").cast("int").alias("pos"))


SQL_HITS = f"with {SQL_READS}, {SQL_REF}, hits as (select id, pos from ({sql_kmers('reads', RECRUIT_K, 1)}) where kmer in (select kmer from ({sql_kmers('ref', RECRUIT_K)})))"
SQL_MATCH = f"{SQL_HITS} select id as doc_id, count(*) as n_hits, sum(least(pos - prev, {RECRUIT_K}))::bigint as match_len from (select id, pos, lag(pos, 1, 0) over (partition by id order by pos) as prev from hits) group by id"


def recruited(t, least: int) -> DataFrame:
    found = K.recruit(reads(t), reference(t), RECRUIT_K, least, both_strands=False)
    return found.withColumnRenamed("id", "doc_id")


@query("recruit_match_count", f"{SQL_HITS} select id as doc_id, count(*) as n_hits from hits group by id")
def _(t):
    return K.probes(reads(t), K.kmers(reference(t), RECRUIT_K), RECRUIT_K).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_hits"))


@query("recruit_match_length", SQL_MATCH)
def _(t):
    return recruited(t, 0)


@query("recruit_reads", f"select * from ({SQL_MATCH}) where match_len >= {RECRUIT_MIN}")
def _(t):
    return recruited(t, RECRUIT_MIN)


SQL_BOTH = f"with {SQL_READS}, {SQL_REF}, two as (select id, seq from ref union all select id, translate(reverse(seq), 'ACGT', 'TGCA') from ref), hits as (select id, pos from ({sql_kmers('reads', RECRUIT_K, 1)}) where kmer in (select kmer from ({sql_kmers('two', RECRUIT_K)})))"


@query("recruit_both_strands", f"{SQL_BOTH} select id as doc_id, count(*) as n_hits, sum(least(pos - prev, {RECRUIT_K}))::bigint as match_len from (select id, pos, lag(pos, 1, 0) over (partition by id order by pos) as prev from hits) group by id")
def _(t):
    """Matches with the benchmark items and their reverse complements."""
    return K.recruit(reads(t), reference(t), RECRUIT_K, 0).withColumnRenamed("id", "doc_id")


SQL_ANCHORS = f"{SQL_READS}, {SQL_REF}, uniq as (select id as item_id, kmer, min(pos) as ref_pos from ({sql_kmers('ref', RECRUIT_K)}) group by all having count(*) = 1), h as (select k.id, item_id, ref_pos, pos, ref_pos - pos as diag from ({sql_kmers('reads', RECRUIT_K)}) k join uniq using (kmer))"


def anchored(t) -> DataFrame:
    """Anchors of all documents in each benchmark item."""
    hits = K.anchors(reads(t), reference(t), RECRUIT_K).withColumnRenamed("ref", "item_id")
    return hits.select("id", "item_id", *[F.col(x).cast("bigint").alias(x) for x in ("ref_pos", "pos", "diag")])


@query("anchors", f"with {SQL_ANCHORS} select * from h")
def _(t):
    return anchored(t)


@query("diagonal_filter", f"""
with {SQL_ANCHORS}, f as (select *, coalesce((diag - lag(diag) over (partition by id, item_id order by diag) > 100)::int, 0) as new from h),
i as (select id, item_id, ref_pos, pos, diag, sum(new) over (partition by id, item_id order by diag range between unbounded preceding and current row) as island from f),
b as (select id, item_id, island from (select id, item_id, island, row_number() over (partition by id, item_id order by count(*) desc, island) as r from i group by id, item_id, island) where r = 1)
select id, item_id, ref_pos, pos, diag from i join b using (id, item_id, island)""")
def _(t):
    return K.diagonal_filter(anchored(t), ["id", "item_id"])


@query("repeat_kmer_filter", f"with {SQL_ANCHORS} select id, item_id, ref_pos, pos, diag from (select *, count(*) over (partition by id, item_id, ref_pos) as a, count(*) over (partition by id, item_id, pos) as b from h) where a = 1 and b = 1")
def _(t):
    return K.drop_repeats(anchored(t), ["id", "item_id"], either=True)


# ---- joins and assignments --------------------------------------------------------------------------------------------------------


@query("split_reads", "select d.doc_id, l.quality, l.toxic, d.source from documents d join labels l using (doc_id)")
def _(t):
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "quality", "toxic", "source")


@query("missing_reads", "select doc_id, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("unique_assignment", """
select l_partkey, min(n_regionkey) as n_regionkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by l_partkey having count(distinct n_regionkey) = 1""")
def _(t):
    rows = t("lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
    rows = rows.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return I.unique_assignment(rows, "l_partkey", "n_regionkey")


TIER_SQL = "case when value >= 150 then 1 when value >= 75 then 2 else 3 end"


def tiers(t) -> DataFrame:
    return t("events").select("user_id", "event_type", F.when(F.col("value") >= 150, 1).when(F.col("value") >= 75, 2).otherwise(3).alias("tier"))


@query("tiered_assignment", f"""
with e as (select user_id, event_type, {TIER_SQL} as tier from events), b as (select user_id, min(tier) as tier from e group by user_id)
select user_id, min(event_type) as event_type from e join b using (user_id, tier) group by user_id having count(distinct event_type) = 1""")
def _(t):
    return I.tiered_assignment(tiers(t), "user_id", "event_type", "tier")


@query("priority_assignment", f"with e as (select user_id, event_type, {TIER_SQL} as tier from events) select user_id, min(tier) as tier, count(*) filter (where tier = 1) as n_first from e group by user_id")
def _(t):
    return tiers(t).groupBy("user_id").agg(F.min("tier").alias("tier"), F.count_if(F.col("tier") == 1).alias("n_first"))


@query("fill_forward", "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as user_turn from conversations")
def _(t):
    return I.fill_forward(t("conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "user_turn").select("conv_id", "turn", "user_turn")


SPANS_SQL = "spans as (select l_partkey as key, l_orderkey % 1000 as start, l_orderkey % 1000 + l_quantity::bigint as \"end\", l_linenumber as line, l_orderkey as ord from lineitem)"


def spans(t) -> DataFrame:
    # SQL rounds quantities, halves to even
    return t("lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") % 1000).alias("start"), (F.col("l_orderkey") % 1000 + F.rint("l_quantity").cast("bigint")).alias("end"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("ord"))


@query("interval_overlap_join", f"""
with {SPANS_SQL} select a.key, a.ord, a.line, b.ord as b_ord, b.line as b_line, greatest(a.start, b.start) as lo, least(a."end", b."end") as hi
from spans a join spans b on a.key = b.key and a.start < b."end" and b.start < a."end" where a.line = 1 and b.line = 2""")
def _(t):
    a, b = spans(t).where("line = 1"), spans(t).where("line = 2").select("key", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("ord").alias("b_ord"), F.col("line").alias("b_line"))
    return I.overlap_join(a, b, "key", 64).select("key", "ord", "line", "b_ord", "b_line", F.greatest("start", "b_start").alias("lo"), F.least("end", "b_end").alias("hi"))


@query("interval_anti_join", f"""
with {SPANS_SQL} select key, start, "end", line, ord from spans a where line = 1 and not exists (select 1 from spans b where b.line <> 1 and a.key = b.key and a.start < b."end" and b.start < a."end")""")
def _(t):
    b = spans(t).where("line <> 1").select("key", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return I.overlap_join(spans(t).where("line = 1"), b, "key", 64, "anti")


SQL_MERGED = f"""{SPANS_SQL}, r as (select key, start, "end", max("end") over (partition by key order by start, "end" rows between unbounded preceding and 1 preceding) as reach from spans),
i as (select key, start, "end", sum(case when start <= reach then 0 else 1 end) over (partition by key order by start, "end" rows unbounded preceding) as island from r),
m as (select key, min(start) as start, max("end") as "end" from i group by key, island)"""


@query("interval_merge", f"with {SQL_MERGED} select * from m")
def _(t):
    return I.merge_spans(spans(t), "key")


@query("interval_complement", f"""
with {SQL_MERGED}, f as (select key, coalesce(lag("end") over (partition by key order by start), 0) as a, start as b from m union all select key, max("end"), 1050 from m group by key)
select key, a as start, b as "end" from f where a < b""")
def _(t):
    return I.complement_spans(spans(t), "key", F.lit(0).cast("bigint"), F.lit(1050).cast("bigint"))


@query("interval_containment", f"with {SPANS_SQL} select key, ord, line, coalesce(\"end\" <= max(\"end\") over (partition by key order by start, \"end\" desc, ord, line rows between unbounded preceding and 1 preceding), false) as inside from spans")
def _(t):
    w = W.partitionBy("key").orderBy("start", F.desc("end"), "ord", "line").rowsBetween(W.unboundedPreceding, -1)
    return spans(t).select("key", "ord", "line", F.coalesce(F.col("end") <= F.max("end").over(w), F.lit(False)).alias("inside"))


@query("gap_chain", """
with e as (select user_id, event_id, epoch(ts)::bigint as s from events), g as (select *, case when abs(s - lag(s) over (partition by user_id order by s, event_id)) > 86400 then 1 else 0 end as new from e)
select user_id, event_id, sum(new) over (partition by user_id order by s, event_id rows unbounded preceding)::int as chain from g""")
def _(t):
    # SQL rounds to whole seconds, halves to even
    e = t("events").select("user_id", "event_id", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint").alias("s"))
    return I.gap_chains(e, ["user_id"], "s", "s", 86400, tie="event_id").select("user_id", "event_id", "chain")


# ---- graphs -----------------------------------------------------------------------------------------------------------------------

SQL_STEPS = "steps as (select l_orderkey as ord, l_linenumber as i, l_partkey as src, l_suppkey % 2 = 0 as src_fwd, lead(l_partkey) over w as dst, lead(l_suppkey % 2 = 0) over w as dst_fwd from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))"
SQL_EDGES = f"{SQL_STEPS}, edges as (select src, src_fwd, dst, dst_fwd from steps where dst is not null)"


def oriented_edges(t) -> DataFrame:
    """Consecutive parts of an order as edges; a part is forward for an even supplier."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    fwd = F.col("l_suppkey") % 2 == 0
    return t("lineitem").select(F.col("l_partkey").alias("src"), fwd.alias("src_fwd"), F.lead("l_partkey").over(w).alias("dst"), F.lead(fwd).over(w).alias("dst_fwd")).where("dst is not null")


@query("edge_mirror_distinct", f"with {SQL_EDGES} select src, src_fwd, dst, dst_fwd from edges union select dst, not dst_fwd, src, not src_fwd from edges")
def _(t):
    return G.mirrored(oriented_edges(t))


@query("edge_coverage", f"""
with {SQL_EDGES}, c as (select case when (src_fwd, src, dst_fwd, dst) <= (not dst_fwd, dst, not src_fwd, src) then {{'s': src, 'sf': src_fwd, 'd': dst, 'df': dst_fwd}} else {{'s': dst, 'sf': not dst_fwd, 'd': src, 'df': not src_fwd}} end as e from edges)
select e.s as src, e.sf as src_fwd, e.d as dst, e.df as dst_fwd, count(*) as coverage from c group by all""")
def _(t):
    return G.edge_coverage(oriented_edges(t))


SQL_LINKS = "links as (select l_suppkey as a, 100000000 + l_orderkey as b from lineitem)"


def links(t) -> DataFrame:
    """Suppliers and orders that a line connects."""
    return t("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_orderkey") + 100000000).alias("dst"))


# a round hands the least label on to the neighbours that hold a larger one
SQL_COMPONENTS = f"""with recursive {SQL_LINKS}, both_ways as (select a, b from links union select b, a from links),
comp(node, component) using key (node) as (select a, least(a, min(b)) from both_ways group by a
  union select b, min(c.component) from comp c join both_ways on node = a join recurring.comp old on old.node = b where c.component < old.component group by b)"""


@query("connected_components", f"{SQL_COMPONENTS} select node, component from comp")
def _(t):
    return connected_components(links(t))


@query("tangle_components", f"{SQL_COMPONENTS} select node, component, size from comp join (select component, count(*) as size from comp group by component having count(*) >= 10) using (component)")
def _(t):
    return G.components_with_size(links(t), 10)


SQL_NEXT = "nx as (select distinct c_nationkey as src, (c_custkey % 25)::int as dst from customer)"


def nation_edges(t) -> DataFrame:
    return t("customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).cast("int").alias("dst"))


@query("reachability", f"with recursive {SQL_NEXT}, r as (select min(src) as node from nx union select dst from r join nx on node = src) select node from r where node is not null")
def _(t):
    e = nation_edges(t)
    return G.reachable(e, e.agg(F.min("src").alias("node")).where("node is not null"))


@query("has_cycle", f"with recursive {SQL_NEXT}, r as (select src, dst from nx union select r.src, nx.dst from r join nx on r.dst = nx.src) select count(*) > 0 as cyclic from r where src = dst")
def _(t):
    return G.cyclic_core(nation_edges(t)).agg((F.count("*") > 0).alias("cyclic"))


SQL_BUBBLE = "be as (select distinct l_partkey as src, 10000000 + l_orderkey as dst from lineitem where l_linenumber = 1 union select distinct 10000000 + l_orderkey, 20000000 + l_suppkey from lineitem where l_linenumber = 1)"


@query("bubbles", f"""
with {SQL_BUBBLE}, o as (select src as mid, min(dst) as dst from be group by src having count(*) = 1), i as (select dst as mid, min(src) as src from be group by dst having count(*) = 1)
select src, dst, min(mid) as a, max(mid) as b from i join o using (mid) where src <> dst group by src, dst having count(*) = 2""")
def _(t):
    first = t("lineitem").where("l_linenumber = 1")
    e = first.select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") + 10000000).alias("dst")).unionByName(first.select((F.col("l_orderkey") + 10000000).alias("src"), (F.col("l_suppkey") + 20000000).alias("dst")))
    return G.bubbles(e)


# ---- aggregations -----------------------------------------------------------------------------------------------------------------


@query("upper_median", "select lang, list_sort(list(n_chars))[count(*) // 2 + 1] as median from documents group by lang")
def _(t):
    return I.upper_median(t("documents"), ["lang"], "n_chars")


@query("weighted_median", "with s as (select lang, n_chars as v, sum(n_chars) as w from documents group by lang, n_chars), u as (select *, sum(w) over (partition by lang order by v rows unbounded preceding) as upto, sum(w) over (partition by lang) as total from s) select lang, min(v) as median from u where 2 * upto >= total group by lang")
def _(t):
    return I.weighted_median(t("documents"), ["lang"], "n_chars", "n_chars")


SQL_VISITS = "v as (select user_id % 50 as cluster, user_id, event_type as node, count(*) as n from events group by all), m as (select cluster, count(distinct user_id) as loops from v group by cluster)"


def visits(t) -> DataFrame:
    return t("events").groupBy((F.col("user_id") % 50).alias("cluster"), "user_id", F.col("event_type").alias("node")).agg(F.count("*").alias("n"))


def _node_share(t):
    v = visits(t)
    loops = v.groupBy("cluster").agg(F.count_distinct("user_id").alias("loops"))
    return v.groupBy("cluster", "node").agg(F.count_if(F.col("n") == 1).alias("once"), F.max("n").alias("most"), F.count("*").alias("seen")).join(loops, "cluster")


@query("core_nodes", f"with {SQL_VISITS} select cluster, node from v join m using (cluster) group by cluster, node, loops having count(*) = loops and max(n) <= 20")
def _(t):
    return _node_share(t).where("seen = loops and most <= 20").select("cluster", "node")


@query("majority_nodes", f"with {SQL_VISITS} select cluster, node, count(*) filter (where n = 1) as once from v join m using (cluster) group by cluster, node, loops having count(*) filter (where n = 1) * 4 > loops")
def _(t):
    return _node_share(t).where("once * 4 > loops").select("cluster", "node", "once")


@query("consensus_alleles", """
with s as (select user_id % 50 as cluster, event_type as a, lead(event_type) over w as b, lead(event_type, 2) over w as c from events window w as (partition by user_id order by ts, event_id)),
n as (select cluster, a, c, b, count(*) as n from s where c is not null group by all)
select cluster, a, c, b, n from (select *, row_number() over (partition by cluster, a, c order by n desc, b) as r from n) where r = 1""")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = t("events").select((F.col("user_id") % 50).alias("cluster"), F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), F.lead("event_type", 2).over(w).alias("c")).where("c is not null")
    return I.modal(s, ["cluster", "a", "c"], "b").select("cluster", "a", "c", "b", "n")


@query("modal_allele", "with n as (select user_id, event_type, count(*) as n from events group by all) select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, event_type) as r from n) where r = 1")
def _(t):
    return I.modal(t("events"), ["user_id"], "event_type")


SQL_EDITS = "e as (select distinct l_suppkey as cluster, l_orderkey as read, l_linenumber as pos, l_returnflag as alt from lineitem)"


def edits(t) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("alt")).distinct()


@query("edit_support", f"with {SQL_EDITS} select cluster, pos, alt, count(*) as support from e group by all")
def _(t):
    return edits(t).groupBy("cluster", "pos", "alt").agg(F.count("*").alias("support"))


@query("two_thirds_edits", f"with {SQL_EDITS}, s as (select cluster, pos, alt, count(*) as support from e group by all), n as (select cluster, pos, count(*) as covered from e group by all) select cluster, pos, alt, support, covered from s join n using (cluster, pos) where 3 * support > 2 * covered")
def _(t):
    s = edits(t).groupBy("cluster", "pos", "alt").agg(F.count("*").alias("support"))
    return s.withColumn("covered", F.sum("support").over(W.partitionBy("cluster", "pos"))).where("3 * support > 2 * covered")


@query("contingency_2x2", "select l_suppkey, count(*) filter (where a and b) as n11, count(*) filter (where a and not b) as n10, count(*) filter (where not a and b) as n01, count(*) filter (where not a and not b) as n00 from (select l_suppkey, l_returnflag = 'R' as a, l_linestatus = 'O' as b from lineitem) group by l_suppkey")
def _(t):
    a, b = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    return t("lineitem").groupBy("l_suppkey").agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))


@query("same_read_set_groups", f"with {SQL_EDITS}, s as (select cluster, pos, alt, list(read order by read) as reads from e group by all) select cluster, reads, count(*) as n_edits, min(pos) as first_pos from s group by all having count(*) > 1")
def _(t):
    s = edits(t).groupBy("cluster", "pos", "alt").agg(F.array_sort(F.collect_list("read")).alias("reads"))
    return s.groupBy("cluster", "reads").agg(F.count("*").alias("n_edits"), F.min("pos").alias("first_pos")).where("n_edits > 1")


@query("allele_vector_clusters", "with v as (select l_orderkey, string_agg(l_returnflag || l_linestatus, ',' order by l_linenumber, l_returnflag || l_linestatus) as vector from lineitem group by l_orderkey) select vector, count(*) as n, min(l_orderkey) as first_read from v group by vector")
def _(t):
    v = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("x")))), lambda s: s["x"]), ",").alias("vector"))
    return v.groupBy("vector").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_read"))


@query("spaced_positions", "select l_partkey, count(*) filter (where far) as n_spaced from (select l_partkey, coalesce(l_orderkey - lag(l_orderkey) over (partition by l_partkey order by l_orderkey) >= 100, true) as far from lineitem) group by l_partkey")
def _(t):
    return I.spaced_count(t("lineitem"), ["l_partkey"], "l_orderkey", 100)


@query("common_span", "select user_id % 50 as cluster, max(a) as lo, min(b) as hi from (select user_id, min(event_id) as a, max(event_id) as b from events group by user_id) group by all")
def _(t):
    return t("events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).groupBy((F.col("user_id") % 50).alias("cluster")).agg(F.max("a").alias("lo"), F.min("b").alias("hi"))


@query("allele_intersection", "select a.alt as alt_a, b.alt as alt_b, count(*) as shared from (select distinct l_orderkey as read, l_returnflag as alt from lineitem) a join (select distinct l_orderkey as read, l_linestatus as alt from lineitem) b using (read) group by all")
def _(t):
    a = t("lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_returnflag").alias("alt_a")).distinct()
    b = t("lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_linestatus").alias("alt_b")).distinct()
    return a.join(b, "read").groupBy("alt_a", "alt_b").agg(F.count("*").alias("shared"))


@query("length_order", "select doc_id, row_number() over (order by n_chars, doc_id) as rank from documents")
def _(t):
    """Documents by length. Ranks come from counts of lengths, so no task sorts all rows."""
    d = t("documents").select("doc_id", "n_chars")
    sizes = d.groupBy("n_chars").count()
    before = sizes.select("n_chars", F.coalesce(F.sum("count").over(W.orderBy("n_chars").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("n_chars").orderBy("doc_id"))
    return d.withColumn("r", inside).join(before, "n_chars").select("doc_id", (F.col("before") + F.col("r")).alias("rank"))
