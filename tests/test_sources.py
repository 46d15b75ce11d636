"""Readers and writers: round trips and hand-made files."""

import gzip
import struct

import pytest

from looploom.sources import graphs, sequences


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">r1 some tag\r\nACgt\r\nAC\n>r2\n\nTT TT\n>r3\nAC>GT")
    assert sorted((r["id"], r["seq"]) for r in sequences.read_sequences(spark, str(p)).collect()) == [("r1 some tag", "ACGTAC"), ("r2", "TTTT"), ("r3", "AC>GT")]
    (tmp_path / "y.fa.gz").write_bytes(gzip.compress(b">a\nAC\n"))
    assert sequences.read_sequences(spark, [str(p), str(tmp_path / "y.fa.gz")]).count() == 4
    out = str(tmp_path / "out")
    sequences.write_fasta(sequences.read_fasta(spark, str(p)), out)
    assert sequences.read_fasta(spark, out).count() == 3


def test_fastq(spark, tmp_path):
    p = tmp_path / "x.fastq"
    p.write_text("".join(f"@r{i}\nacgt\n+\n@II{i % 10}\n" for i in range(500)))
    got = {r["id"]: (r["seq"], r["quality"]) for r in sequences.read_fastq(spark, str(p)).collect()}
    assert len(got) == 500 and got["r17"] == ("ACGT", "@II7")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert {r["id"]: (r["seq"], r["quality"]) for r in sequences.read_fastq(spark, str(p)).collect()} == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.fq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="bad FASTQ"):
        sequences.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    with pytest.raises(ValueError):
        sequences.read_sequences(spark, "x.txt")


def bam(records):
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9)
    for name, seq, flag in records:
        codes = [sequences.BAM_BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes([30] * len(seq))
        raw += struct.pack("<i", len(body)) + body
    return gzip.compress(raw)


def test_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam([("r1", "ACGTN", 4), ("r2", "AC", 0x100), ("r3", "GGT", 16), ("r4", "A", 0x800)]))
    got = {r["id"]: (r["seq"], r["quality"]) for r in sequences.read_sequences(spark, str(tmp_path / "x.bam")).collect()}
    assert got == {"r1": ("ACGTN", "?" * 5), "r3": ("GGT", "???")}


def test_gfa(spark, tmp_path):
    p = tmp_path / "g.gfa"
    p.write_text("H\tVN:Z:1.0\nS\ta\tACGT\tLN:i:4\tll:f:7.9\nS\tb\t*\tLN:i:9\nL\ta\t+\tb\t-\t2M\tec:i:5\nA\tb\t3\t+\tread1\t0\t100\n")
    nodes, edges = graphs.read_gfa(spark, str(p))
    assert {tuple(r) for r in nodes.collect()} == {("a", "ACGT", 4, 7), ("b", None, 9, 0)}
    want = {("a", True, "b", False, 2, 5), ("b", True, "a", False, 2, 5)}
    assert {tuple(r) for r in edges.collect()} == want
    out = str(tmp_path / "out")
    graphs.write_gfa(nodes, edges, out)
    n, e = graphs.read_gfa(spark, out)
    assert {tuple(r) for r in e.collect()} == want and {tuple(r) for r in n.collect()} == {tuple(r) for r in nodes.collect()}
    assert [tuple(r) for r in graphs.read_placements(spark, str(p)).collect()] == [("b", 3, "read1", 100)]


def test_gaf(spark, tmp_path):
    p = tmp_path / "a.gaf"
    p.write_text("r1\t100\t0\t90\t+\t>a<b\t13\t1\t11\t9\t10\t60\nr2\t100\t0\t90\t+\t<a\t4\t1\t4\t9\t10\t3\n")
    rows = graphs.read_gaf(spark, str(p))
    out = str(tmp_path / "out")
    graphs.write_gaf(rows, out)
    assert sorted(map(str, graphs.read_gaf(spark, out).collect())) == sorted(map(str, rows.collect()))
    want = spark.createDataFrame([("a", False), ("b", True)], "node string, fwd boolean")
    (r,) = graphs.read_gaf_filtered(spark, str(p), want, 50).collect()
    assert [(n["id"], n["fwd"]) for n in r["nodes"]] == [("b", True), ("a", False)] and (r["left_clip"], r["right_clip"]) == (2, 1)


def test_assembly_files(spark, tmp_path):
    (tmp_path / "layout").write_text("tig\tpiece1\nlen 10\nrds 2\nr1\t0\t5\nr2\t5\t9\nend\ntig\tpiece2\nr3\t0\t1\nend\n")
    assert {tuple(r) for r in graphs.read_layout(spark, str(tmp_path / "layout")).collect()} == {("r1", "piece1"), ("r2", "piece1"), ("r3", "piece2")}
    (tmp_path / "scf").write_text("path 1 P1\npiece1\n[N10N:gap]\npiece2\nend\n")
    assert {tuple(r) for r in graphs.read_scaffold_map(spark, str(tmp_path / "scf")).collect()} == {("piece1", "P1"), ("piece2", "P1")}
    (tmp_path / "paths").write_text("name\tpath\nP1\t>u1[N5N:g]<u2\n")
    assert {tuple(r) for r in graphs.read_node_paths(spark, str(tmp_path / "paths")).collect()} == {("u1", "P1"), ("u2", "P1")}
    (tmp_path / "nodes").write_text("u1, u2,\n>u3 <u4")
    assert {tuple(r) for r in graphs.read_node_list(spark, str(tmp_path / "nodes")).collect()} == {("u1", False, None), ("u2", False, None), ("u3", True, True), ("u4", True, False)}
    (tmp_path / "map").write_text("m1\t>u1<u2:3:4\n")
    (r,) = graphs.read_node_map(spark, str(tmp_path / "map")).collect()
    assert (r["left_clip"], r["right_clip"], len(r["nodes"])) == (3, 4, 2)
    assert graphs.config_value("a:\n  withONT: True\n", "withONT") == "True" and graphs.config_value("x: 1", "y") is None
    assert graphs.config_list("HIFI_READS:\n - 'a.fq'\n - b.fq\nother: 1\n", "HIFI_READS") == ["a.fq", "b.fq"]
    assert graphs.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "map")) == str(tmp_path / "map")


def test_partitioned(spark, tmp_path):
    reads = spark.createDataFrame([("r1", "AC"), ("r2", "GG")], "id string, seq string")
    to = spark.createDataFrame([("r1", 1), ("r1", 2), ("r9", 1)], "id string, tangle int")
    missing = graphs.write_partitioned(reads, to, str(tmp_path / "out"))
    assert [r["id"] for r in missing.collect()] == ["r9"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
