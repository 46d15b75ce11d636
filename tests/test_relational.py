"""Functions and relational operators on hand cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from looploom.functions import seq as S
from looploom.operators import clusters, graph, intervals, kmer, loops
from looploom.operators.components import connected_components
from looploom.plans import registry


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, S.revcomp(F.lit("AACGT"))) == "ACGTT"
    assert one(spark, S.homopolymer_compress(F.lit("AACCCGT"))) == "ACGT"
    assert one(spark, S.name_without_tags(F.lit("a\tb c"))) == "a"
    assert one(spark, S.path_string(S.flip_path(S.parse_path(F.lit(">a<b"))))) == ">b<a"
    assert one(spark, S.path_string(S.parse_gapped_path(F.lit(">a[N5N]<b")))) == ">a<b"
    assert one(spark, S.path_string(S.canonical_path(S.parse_path(F.lit(">a>b"))))) == "<b<a"
    assert one(spark, S.tangle_number(F.lit("tangle12_x"))) == 12 and one(spark, S.tangle_number(F.lit("x"))) is None
    assert one(spark, S.is_microsatellite(F.lit("ACAC"), F.lit("GGAC"), F.lit("T"))) is True
    assert one(spark, S.is_microsatellite(F.lit("ACAG"), F.lit("GGAC"), F.lit("T"))) is False
    assert "".join(one(spark, S.parts(F.lit("ABCDEFGHIJKLM")))) == "ABCDEFGHIJKLM"


def wang(k):
    m = (1 << 64) - 1
    k = (~k + (k << 21)) & m
    k ^= k >> 24
    k = (k + (k << 3) + (k << 8)) & m
    k ^= k >> 14
    k = (k + (k << 2) + (k << 4)) & m
    k ^= k >> 28
    return (k + (k << 31)) & m


@pytest.mark.parametrize("k", [0, 1, 12345678901, -7])
def test_wang(spark, k):
    assert one(spark, S.wang_hash(F.lit(k).cast("long"))) & ((1 << 64) - 1) == wang(k & ((1 << 64) - 1))


def test_match_length(spark):
    hits = spark.createDataFrame([(1, p) for p in (0, 1, 5, 40)], "id int, pos int")
    assert kmer.match_length(hits, 15).collect()[0]["match_len"] == 20


def test_last_kmer_is_not_probed(spark):
    reads = spark.createDataFrame([(1, "ACGTT"), (2, "AC")], "id int, seq string")
    ref = spark.createDataFrame([("GTT",), ("ACG",)], "kmer string")
    assert [r["pos"] for r in kmer.probes(reads, ref, 3).collect()] == [0]


def test_syncmers(spark):
    reads = spark.createDataFrame([(1, "ACAGTAAC"), (2, "CCACC")], "id int, seq string")
    got = {(r["id"], r["pos"]) for r in kmer.syncmers(reads, 5, 2).collect()}
    want = set()
    for i, s in ((1, "ACAGTAAC"), (2, "CCACC")):
        for p in range(len(s) - 4):
            smers = [s[p + j : p + j + 2] for j in range(4)]
            if min(smers) in (smers[0], smers[-1]):
                want.add((i, p))
    assert got == want


def test_intervals(spark):
    a = spark.createDataFrame([("k", 0, 10), ("k", 50, 60), ("m", 0, 5)], "key string, start int, end int")
    b = spark.createDataFrame([("k", 5, 7), ("k", 9, 55)], "key string, b_start int, b_end int")
    got = sorted(map(tuple, intervals.overlap_join(a, b, "key", 4).select("start", "b_start").collect()))
    assert got == [(0, 5), (0, 9), (50, 9)]
    assert [r["key"] for r in intervals.overlap_join(a, b, "key", 4, "anti").collect()] == ["m"]
    s = spark.createDataFrame([("k", 1, 3), ("k", 2, 5), ("k", 7, 9)], "key string, start int, end int")
    assert sorted(map(tuple, intervals.merge_spans(s, "key").collect())) == [("k", 1, 5), ("k", 7, 9)]
    assert sorted(map(tuple, intervals.complement_spans(s, "key", F.lit(0), F.lit(10)).collect())) == [("k", 0, 1), ("k", 5, 7), ("k", 9, 10)]


def test_tiers(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 1), (3, "c", 3)], "read int, tangle string, tier int")
    assert sorted(map(tuple, intervals.tiered_assignment(rows, "read", "tangle", "tier").collect())) == [(1, "a"), (3, "c")]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (1, 2), (7, 7), (3, 9), (None, 1)], "src long, dst long")
    assert dict(map(tuple, connected_components(edges).collect())) == {3: 3, 4: 3, 5: 3, 9: 3, 1: 1, 2: 1}
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(edges.where("false")).count() == 0


def test_cycles_and_bubbles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert graph.has_cycle(e) and not graph.has_cycle(e.where("src < dst"))
    b = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src int, dst int")
    assert [tuple(r) for r in graph.bubbles(b).collect()] == [(1, 4, 2, 3)]
    ends = graph.attach_ends(spark.createDataFrame([(1, 9), (2, 9), (1, 8), (3, 8)], "src int, dst int"), spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node int, component int"))
    assert [tuple(r) for r in ends.collect()] == [(9, 1)]


def test_paths(spark):
    nodes = spark.createDataFrame([("a", "AACC", 4), ("b", "CCGT", 4)], "node string, seq string, len int")
    edges = spark.createDataFrame([("a", True, "b", True, 2)], "src string, src_fwd boolean, dst string, dst_fwd boolean, overlap int")
    paths = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", True), (2, 0, "b", False), (2, 1, "a", False)], "id int, i int, node string, fwd boolean")
    assert dict(map(tuple, graph.path_sequences(paths, nodes, edges).collect())) == {1: "AACCGT", 2: "ACGGTT"}
    assert dict(map(tuple, graph.path_lengths(paths, nodes, edges).collect())) == {1: 6, 2: 6}


def test_clusters(spark):
    s = spark.createDataFrame([(1, "AAAA"), (2, "AAAT"), (3, "GGGG"), (4, "AAAA")], "id int, seq string")
    assert dict(map(tuple, clusters.rough_clusters(s, 1).collect())) == {1: 1, 2: 1, 3: 3, 4: 1}


def test_missing_and_morph_graph(spark):
    exp = spark.createDataFrame([("r", 0, 40000), ("r", 90000, 50000)], "read string, start long, end long")
    got = spark.createDataFrame([("r", 52000, 88000)], "read string, start long, end long")
    assert [tuple(r) for r in loops.missing_loops(exp, got).collect()] == [("r", 0, 40000)]
    cut = spark.createDataFrame([("r", 0, 100, "m1"), ("r", 150, 300, "m2"), ("r", 5000, 5100, "m1")], "read string, start long, end long, morph string")
    edges, paths = loops.morph_graph(cut)
    assert [tuple(r) for r in edges.collect()] == [("m2", False, "m1", False, 1)] and paths.count() == 2


def test_components_of_all_lines(spark, tmp_path):
    r = random.Random(3)
    rows = [(1 + int(99 * r.random() ** 4), r.randrange(1, 400), 0.01, 0.0) for _ in range(300)]  # a hub, a giant component and small ones
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, o, *_ in rows:
        a, b = find(s), find(o + 100000000)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up}
    assert dict(map(tuple, registry.QUERIES["connected_components"](spark, str(tmp_path)).collect())) == want
    size = Counter(want.values())
    assert set(map(tuple, registry.QUERIES["tangle_components"](spark, str(tmp_path)).collect())) == {(x, c, size[c]) for x, c in want.items() if size[c] >= 10}


def test_nations_of_all_customers(spark, tmp_path):
    for name, rows, cyclic in (("ring", [(1, 2), (2, 28), (3, 26), (7, 9)], True), ("chain", [(1, 2), (2, 28), (7, 9)], False)):
        spark.createDataFrame([(n, c, 5.0) for n, c in rows], "c_nationkey int, c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/{name}/customer.parquet")
        assert {x["node"] for x in registry.QUERIES["reachability"](spark, f"{tmp_path}/{name}").collect()} == {1, 2, 3}
        assert registry.QUERIES["has_cycle"](spark, f"{tmp_path}/{name}").first()["cyclic"] is cyclic


def test_anchors_in_all_items(spark, tmp_path):
    r = random.Random(5)
    items = [(i, "".join(r.choice("ACGT") for _ in range(60))) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(7, items[2][1][10:40]), (8, items[1][1] + items[0][1]), (9, "".join(r.choice("ACGT") for _ in range(60)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, i, a, b) for d, s in docs for i, q in items for a in range(len(q) - 14) for b in range(len(s) - 14) if q[a : a + 15] == s[b : b + 15]}
    assert {d[:2] for d in want} == {(7, 2), (8, 1), (8, 0)}
    for name in ("anchors", "diagonal_filter", "repeat_kmer_filter", "longest_chain"):
        got = registry.QUERIES[name](spark, str(tmp_path)).select("id", "item_id", "ref_pos", "pos").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want  # one diagonal and no repeats for each pair


def test_microsatellites_at_every_base(spark, tmp_path):
    r = random.Random(7)
    docs = [(i, "".join(r.choice(("A", "C", "AC", "ACGT", "GG")) for _ in range(n))) for i, n in enumerate((0, 1, 3, 40, 90))] + [(9, "TACGACGT" + "AAAAA")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def found(s, p):
        before, x, after = s[max(p - 12, 0) : p], s[p : p + 4], s[p + 4 : p + 16]
        units = [x[:n] for n in (1, 2, 4) if x == x[:n] * (4 // n)]
        return any(before.endswith(u) or after.startswith(u) for u in units)

    bases = [(i, s.translate(str.maketrans(S.LETTERS, S.BASES))) for i, s in docs]
    want = {i: sum(found(s, p) for p in range(len(s) - 4)) for i, s in bases if len(s) >= 5}
    assert dict(map(tuple, registry.QUERIES["microsatellite_indel"](spark, str(tmp_path)).collect())) == want


def test_density_split_is_the_plain_one(spark, monkeypatch):
    import random

    from looploom.operators import clusters, strings

    monkeypatch.setattr(clusters, "BAND_ROWS", 6)  # bands are cut into blocks
    r = random.Random(4)
    noise = lambda s, n: "".join(r.choice("ACGT") if r.random() < n else c for c in s)
    rows = []
    for key in range(3):
        base = "".join(r.choice("ACGT") for _ in range(120))
        kinds = [base, noise(base, 0.25 if key else 0.02)]
        rows += [(key, noise(k, 0.02)) for k in kinds for _ in range(12)] + [(key, base)] * 4
    rows = [(k, i, s) for i, (k, s) in enumerate(rows)]
    got = {x["id"]: x["part"] for x in clusters.density_split(spark.createDataFrame(rows, "cluster int, id long, seq string"), max_edits=60).collect()}
    own = {k: [(i, s) for key, i, s in rows if key == k] for k in range(3)}
    dist = {k: {(i, j): strings.edit_distance(own[k][i][1], own[k][j][1], 60) for j in range(len(own[k])) for i in range(j)} for k in own}
    peak = strings.histogram_peak([min(d, 59) for k in own for d in dist[k].values()], 60)
    middle = strings.upper_median([len(s) for *_, s in rows])
    assert len(got) == len(rows)
    for k in own:
        want = strings.density_clusters([len(s) for _, s in own[k]], dist[k], middle, 60, peak=peak)
        names = {c: n for n, c in enumerate(sorted({w for w in want if w is not None}, key=want.index))}
        assert [got[i] for i, _ in own[k]] == [None if w is None else names[w] for w in want]
    assert len({(k, got[i]) for k, i, _ in rows}) > 3
    assert clusters.density_split(spark.createDataFrame([], "cluster int, id long, seq string")).count() == 0


def against_sql(spark, folder, name, table, rows, schema):
    """Rows of a registered query and of its SQL on one small table."""
    import duckdb

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    rel = con.sql(registry.ORACLE_SQL[name]).select(*df.columns)
    key = lambda r: [(x is None, x) for x in r]
    return sorted(map(tuple, df.collect()), key=key), sorted(rel.fetchall(), key=key)


def test_gap_chain_rounds_seconds(spark, tmp_path):
    """Times become whole seconds by rounding, halves to even; a missing time comes last."""
    from datetime import datetime as d

    rows = [(1, 1, d(2024, 1, 1, 0, 0, 0, 400_000)), (1, 2, d(2024, 1, 2, 0, 0, 0, 600_000)), (1, 3, None), (2, 4, d(2024, 1, 1, 0, 0, 0, 600_000)), (2, 5, d(2024, 1, 2, 0, 0, 1, 400_000)), (3, 6, d(2024, 1, 1, 0, 0, 0, 500_000)), (3, 7, d(2024, 1, 2, 0, 0, 1, 500_000))]
    got, sql = against_sql(spark, tmp_path, "gap_chain", "events", rows, "user_id long, event_id long, ts timestamp_ntz")
    assert got == sql == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 4, 0), (2, 5, 0), (3, 6, 0), (3, 7, 1)]


@pytest.mark.parametrize("name", ["interval_merge", "interval_complement"])
def test_spans_round_quantities(spark, tmp_path, name):
    """Lengths become whole by rounding, halves to even; a missing length comes after the others of its start."""
    rows = [(1, 10, 2.5, 1), (1, 13, 3.5, 2), (1, 18, 2.6, 3), (1, 21, 1.0, 4), (2, 5, None, 1), (2, 5, 4.0, 2), (2, 9, 1.4, 3)]
    got, sql = against_sql(spark, tmp_path, name, "lineitem", rows, "l_partkey long, l_orderkey long, l_quantity double, l_linenumber int")
    assert got == sql
    if name == "interval_merge":
        assert got == [(1, 10, 12), (1, 13, 17), (1, 18, 22), (2, 5, 10)]
