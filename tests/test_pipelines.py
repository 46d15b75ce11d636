"""Simulated data through the pipelines, and the operators of assembly graphs on hand cases."""

import random
from collections import Counter

import pytest

from looploom.config import Params
from looploom.operators import assembly, loops
from looploom.operators.strings import edit_distance
from looploom.plans import pipelines
from looploom.streaming.recruiting import recruit_stream


def simulate(seed=7, n=1200):
    r = random.Random(seed)
    unit = "".join(r.choice("ACGT") for _ in range(n))
    kinds = [unit]
    for k in range(2):
        v = list(unit)
        for p in range(100 + 40 * k, n, 230):
            v[p] = "ACGT"[("ACGT".index(v[p]) + 1 + k) % 4]
        kinds.append("".join(v))
    noisy = lambda s, p: "".join("" if (x := r.random()) < p / 3 else r.choice("ACGT") if x < 2 * p / 3 else c for c in s)
    table = str.maketrans("ACGT", "TGCA")
    array = [kinds[i % 3] for i in range(12)]
    genome = "".join(array)
    accurate = [genome[a : a + 900] for a in range(0, len(genome) - 900, 150)]
    long = []
    for i in range(9):
        s = noisy("".join(kinds[(i + j) % 3] for j in range(5)), 0.004)
        long.append(s if i % 2 else s.translate(table)[::-1])
    return unit, kinds, accurate, long


def test_reference_mode(spark):
    unit, kinds, accurate, long = simulate()
    reads = spark.createDataFrame([(f"h{i}", s) for i, s in enumerate(accurate)], "id string, seq string")
    ont = spark.createDataFrame([(f"o{i}", s) for i, s in enumerate(long)], "id string, seq string")
    ref = spark.createDataFrame([("r", unit)], "id string, seq string")
    params = Params(k=61, recruit_k=31, recruit_min=300, max_edits=60, extra_phasing=True)
    found, out = pipelines.reference_mode(reads, ref, params, ont, orient_by=unit)
    assert len(found) == len(unit) and min(edit_distance(found, k, 30) for k in kinds) <= 12
    loops_found = out.loops.count()
    assert loops_found >= 30
    m = out.morphs.collect()
    best = {min(range(3), key=lambda k: edit_distance(x["consensus"], kinds[k])): x for x in m}
    assert sum(x["coverage"] for x in m) == loops_found and set(best) == {0, 1, 2}
    assert all(edit_distance(best[k]["consensus"], kinds[k]) <= 3 for k in best)
    assert m[0]["name"].startswith("morphconsensus") and out.edges.count() > 0


def test_params():
    with pytest.raises(ValueError):
        Params(k=30)
    with pytest.raises(ValueError):
        Params(annotation_gff3="x")
    assert Params.human().resolve_length == 1000 and Params(approx_unit=5000).resolve_length == 200


def test_tangles(spark):
    r = random.Random(1)
    seqs = {f"n{i}": "".join(r.choice("ACGT") for _ in range(400)) for i in range(24)}
    ref = spark.createDataFrame([("r", "".join(seqs[f"n{i}"] for i in range(20)))], "id string, seq string")
    nodes = spark.createDataFrame([(k, s, len(s)) for k, s in seqs.items()], "name string, seq string, len int")
    ring = [(f"n{i}", True, f"n{(i + 1) % 10}", True) for i in range(10)]
    line = [(f"n{i}", True, f"n{i + 1}", True) for i in range(10, 19)]
    edges = spark.createDataFrame([*ring, *line, ("n3", True, "n20", True), ("n21", True, "n22", True)], "src string, src_fwd boolean, dst string, dst_fwd boolean")
    got = Counter((x["tangle"], x["end"]) for x in assembly.guess_tangles(nodes, edges, ref, 31, least=200).collect())
    assert got == {(0, False): 10}  # n20 is a neighbour, but does not match


def test_large_nodes_count_by_their_matched_end(spark):
    r = random.Random(2)
    seqs = {f"{c}{i}": "".join(r.choice("ACGT") for _ in range(400)) for c in "ab" for i in range(10)}
    far = "".join(r.choice("ACGT") for _ in range(3000))
    locus = "".join(seqs.values())
    seqs |= {"big": seqs["a1"] + far + seqs["b1"], "tail": far + seqs["a3"], "none": far[::-1]}
    ref = spark.createDataFrame([("r", locus)], "id string, seq string")
    nodes = spark.createDataFrame([(k, s) for k, s in seqs.items()], "name string, seq string")
    ring = [(f"{c}{i}", True, f"{c}{(i + 1) % 10}", True) for c in "ab" for i in range(10)]
    # big joins both rings, by either matched end; tail touches a ring with its unmatched start, and b with its end
    more = [("a5", True, "big", True), ("big", True, "b5", True), ("a7", True, "tail", True), ("tail", True, "b7", True), ("a8", True, "none", True)]
    edges = spark.createDataFrame([*ring, *more], "src string, src_fwd boolean, dst string, dst_fwd boolean")
    got = assembly.guess_tangles(nodes, edges, ref, 31, least=200, large=2000, end=1000).collect()
    inner = {x["node"]: x["tangle"] for x in got if not x["end"]}
    assert len(inner) == 20 and inner["a0"] != inner["b0"]
    assert sorted((x["node"], x["tangle"]) for x in got if x["end"]) == sorted([("big", inner["a0"]), ("big", inner["b0"]), ("tail", inner["b0"])])


def test_assignment_chain(spark):
    tangles = spark.createDataFrame([(0, "a", False), (1, "b", False), (1, "e", True)], "tangle int, node string, end boolean")
    paths = spark.createDataFrame([("a", "P1"), ("e", "P1"), ("b", "P2"), ("a", "P3"), ("b", "P3")], "node string, path string")
    pt = assembly.paths_of_tangles(tangles, paths)
    assert dict(map(tuple, pt.collect())) == {"P1": 0, "P2": 1}
    rp = spark.createDataFrame([("r1", "x"), ("r2", "x"), ("r2", "y"), ("r3", "y")], "read string, piece string")
    pp = spark.createDataFrame([("x", "P1"), ("y", "P2")], "piece string, path string")
    assert dict(map(tuple, assembly.reads_of_tangles(rp, pp, pt).collect())) == {"r1": 0, "r3": 1}


def test_unfold(spark):
    rows = [("m", [("x", True), ("y", False)]), ("y", [("p", True), ("q", True)])]
    m = spark.createDataFrame(rows, "node string, nodes array<struct<id:string,fwd:boolean>>")
    got = sorted((x["i"], x["part"], x["fwd"]) for x in assembly.unfold(m).where("node = 'm'").collect())
    assert got == [(0, "x", True), (1, "q", False), (2, "p", False)]


def test_tiers_and_touching(spark):
    path = "read string, read_start int, read_end int, read_len int, mapq int, nodes array<struct<id:string,fwd:boolean>>, left_clip int, right_clip int"
    aln = spark.createDataFrame([("r1", 0, 9900, 10000, 60, [("a", True)], 0, 0), ("r1", 5000, 8000, 10000, 60, [("b", True)], 0, 0), ("r2", 0, 10000, 10000, 60, [("a", True), ("b", True)], 90, 0)], path)
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "node string, tangle int")
    assert dict(map(tuple, assembly.alignment_tiers(aln, nodes).collect())) == {"r1": 0}
    valid = spark.createDataFrame([(0, "a", 100, 0, 50)], "tangle int, node string, len int, lo int, hi int")
    assert {x["read"] for x in assembly.reads_touching(aln, valid).collect()} == {"r1"}


def test_branches_and_merge(spark):
    nodes = spark.createDataFrame([(n, "A" * k, k, 9) for n, k in (("c", 10), ("x", 60), ("y", 30), ("border1", 20), ("border2", 15))], "name string, seq string, len int, coverage int")
    cyc = spark.createDataFrame([("c",)], "name string")
    p = spark.createDataFrame([([("c", True), ("x", True)],), ([("c", True), ("x", True), ("y", True)],), ([("x", False), ("c", False)],)], "nodes array<struct<id:string,fwd:boolean>>")
    got = assembly.branches(p, cyc, nodes, 50).collect()
    assert [[n["id"] for n in x["nodes"]] for x in got] == [["c", "x", "y"]]
    edges = spark.createDataFrame([("c", True, "x", True, 4, 3)], "src string, src_fwd boolean, dst string, dst_fwd boolean, overlap int, coverage int")
    from pyspark.sql import functions as F

    n, e = assembly.merged_graphs(nodes.withColumn("tangle", F.lit(2)), edges.withColumn("tangle", F.lit(2)))
    assert {x["name"]: x["len"] for x in n.collect()} == {"tangle2_c": 10, "tangle2_x": 60, "tangle2_y": 30, "tangle2_border1": 15, "tangle2_border2": 15}
    assert e.first()["src"] == "tangle2_c"


def test_cut_loops(spark):
    nodes = spark.createDataFrame([("a", 100), ("b", 200)], "name string, len int")
    b = spark.createDataFrame([("a", True, 50, False)], "node string, fwd boolean, at int, anchor boolean")
    path = [("a", True), ("b", True), ("a", True), ("b", True), ("a", True)]
    aln = spark.createDataFrame([("r", 0, 700, "+", path, [0, 0, 0, 0, 0], 0, 0)], "read string, read_start int, read_end int, strand string, nodes array<struct<id:string,fwd:boolean>>, overlaps array<int>, left_clip int, right_clip int")
    got = loops.cut_loops(aln, nodes, b, 200).orderBy("start").collect()
    assert [(x["start"], x["end"], x["length"]) for x in got] == [(50, 350, 300), (350, 650, 300)]
    assert loops.cut_loops(aln, nodes, b, 301).count() == 0


def test_stream(spark, tmp_path):
    unit, _, accurate, _ = simulate()
    ref = spark.createDataFrame([("r", unit)], "id string, seq string")
    reads = spark.createDataFrame([("x", accurate[0]), ("y", "ACGT" * 50), ("z", None)], "id string, seq string")
    want = pipelines.recruit(reads, ref, 21, 100).collect()
    reads.write.parquet(str(tmp_path / "in"))
    s = recruit_stream(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")), ref, 21, 100)
    q = s.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["id"], r["match_len"]) for r in spark.table("found").collect()} == {(r["id"], r["match_len"]) for r in want} and want


def test_command_from_files_to_files(spark, tmp_path):
    from looploom.__main__ import main
    from looploom.sources.graphs import read_gfa
    from looploom.sources.sequences import read_fasta

    unit, kinds, accurate, long = simulate()
    for name, rows in (("hifi", accurate), ("nano", long), ("locus", [unit])):
        (tmp_path / f"{name}.fa").write_text("".join(f">{name}{i} x\n{s}\n" for i, s in enumerate(rows)))
    at = lambda x: str(tmp_path / x)
    # the locus is short: a k-mer of 61 and the other limits of the command
    assert main(["reference", "-i", at("hifi.fa"), "--nano", at("nano.fa"), "-r", at("locus.fa"), "-o", at("out"), "-k", "61", "--morph-cluster-maxedit", "60", "--extra-phasing", "--orient-by-reference", at("locus.fa")], spark) == 1  # reads are shorter than the least match
    from looploom import config

    made = config.Params
    try:
        config.Params = lambda **x: made(**{**x, "recruit_k": 31, "recruit_min": 300})
        assert main(["reference", "-i", at("hifi.fa"), "--nano", at("nano.fa"), "-r", at("locus.fa"), "-o", at("out2"), "-k", "61", "--morph-cluster-maxedit", "60", "--extra-phasing", "--orient-by-reference", at("locus.fa")], spark) == 0
    finally:
        config.Params = made
    found = read_fasta(spark, at("out2/consensus.fa")).collect()
    assert len(found) == 1 and min(edit_distance(found[0]["seq"], k, 30) for k in kinds) <= 12
    morphs = read_fasta(spark, at("out2/morphs.fa")).collect()
    assert len(morphs) >= 3 and read_fasta(spark, at("out2/loops.fa")).count() >= 30
    nodes, edges = read_gfa(spark, at("out2/morphgraph.gfa"))
    assert {x["name"] for x in nodes.collect()} == {x["id"] for x in morphs} and edges.count() > 0
    assert spark.read.text(at("out2/readpaths.tsv")).count() > 0
    assert main(["tangles", "-i", at("hifi.fa")], spark) == 2
