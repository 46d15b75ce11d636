"""GFA and GAF files, and what else describes paths and placements, as DataFrames. Fields are strict TSV: empty ones keep their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from looploom.functions.seq import canonical_edge, flip_path, node, parse_gapped_path, parse_path, path_string
from looploom.operators.graph import mirrored
from looploom.sources.lines import fill_from_header, numbered_lines


def _fields(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))


def _tag(prefix: str) -> Column:
    """Value of an optional field ``TG:t:value``."""
    return F.regexp_replace(F.get(F.filter("f", lambda x: F.startswith(x, F.lit(prefix))), 0), f"^{prefix}", "")


def read_gfa(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(nodes ``name``, ``seq``, ``len``, ``coverage``; edges ``src``, ``src_fwd``, ``dst``, ``dst_fwd``, ``overlap``, ``coverage`` in both directions).

    Coverage is the ``ll:f:`` tag of a segment, truncated, and the ``ec:i:`` tag of a link (0 where there is none); a segment without
    sequence (``*``) has its length from ``LN:i:``.
    """
    f = _fields(spark, path)
    seq = F.when(F.get("f", 2) != "*", F.get("f", 2))
    nodes = f.where(F.get("f", 0) == "S").select(F.get("f", 1).alias("name"), seq.alias("seq"), F.coalesce(F.length(seq), _tag("LN:i:").cast("int")).cast("bigint").alias("len"), F.coalesce(_tag("ll:f:").cast("double").cast("bigint"), F.lit(0)).alias("coverage"))
    links = f.where(F.get("f", 0) == "L").select(F.get("f", 1).alias("src"), (F.get("f", 2) == "+").alias("src_fwd"), F.get("f", 3).alias("dst"), (F.get("f", 4) == "+").alias("dst_fwd"), F.regexp_extract(F.get("f", 5), r"^(\d+)M", 1).cast("bigint").alias("overlap"), F.coalesce(_tag("ec:i:").cast("bigint"), F.lit(0)).alias("coverage"))
    return nodes, mirrored(links)


def write_gfa(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Segments and links (each edge once) as one folder of GFA text."""
    s = nodes.select(F.concat_ws("\t", F.lit("S"), F.col("name"), F.coalesce("seq", F.lit("*")), F.concat(F.lit("LN:i:"), F.col("len").cast("string")), F.concat(F.lit("ll:f:"), F.coalesce("coverage", F.lit(0)).cast("string"))).alias("value"))
    once = edges.select(canonical_edge(node(F.col("src"), F.col("src_fwd")), node(F.col("dst"), F.col("dst_fwd"))).alias("e"), "overlap", "coverage").groupBy("e").agg(F.max("overlap").alias("overlap"), F.max("coverage").alias("coverage"))
    sign = lambda x: F.when(x, "+").otherwise("-")
    a, b = F.get("e", 0), F.get("e", 1)
    links = once.select(F.concat_ws("\t", F.lit("L"), a["id"], sign(a["fwd"]), b["id"], sign(b["fwd"]), F.concat(F.col("overlap").cast("string"), F.lit("M")), F.concat(F.lit("ec:i:"), F.coalesce("coverage", F.lit(0)).cast("string"))).alias("value"))
    s.unionByName(links).write.text(path)


GAF = "read string, read_len bigint, read_start bigint, read_end bigint, strand string, path string, path_len bigint, path_start bigint, path_end bigint, matches bigint, block_len bigint, mapq int"


def read_gaf(spark: SparkSession, path) -> DataFrame:
    """Alignments: the twelve columns, with ``nodes`` (the path as oriented nodes) and the path's clips ``left_clip``, ``right_clip``."""
    f = _fields(spark, path).where(F.size("f") >= 12)
    cols = [F.get("f", i).cast(kind).alias(name) for i, (name, kind) in enumerate(x.split() for x in GAF.split(", "))]
    return f.select(*cols).withColumns({"nodes": parse_path("path"), "left_clip": F.col("path_start"), "right_clip": F.col("path_len") - F.col("path_end")})


def read_gaf_filtered(spark: SparkSession, path, orientation: DataFrame, min_length: int, min_mapq: int = 20) -> DataFrame:
    """Alignments of good quality and length, turned to the strand on which most of their nodes have the orientation given (``node``, ``fwd``)."""
    rows = read_gaf(spark, path).where((F.col("mapq") >= min_mapq) & (F.col("read_end") - F.col("read_start") >= min_length))
    return orient_paths(rows.withColumn("aln", F.monotonically_increasing_id()), orientation).drop("aln")


def orient_paths(rows: DataFrame, orientation: DataFrame, key: str = "aln") -> DataFrame:
    """Paths (``nodes``, clips) flipped where strictly more of their nodes stand against the given orientations than with them."""
    votes = rows.select(key, F.explode("nodes").alias("n")).join(orientation.select(F.col("node").alias("id"), F.col("fwd").alias("want")), F.col("n.id") == F.col("id"))
    votes = votes.groupBy(key).agg(F.sum(F.when(F.col("n.fwd") == F.col("want"), -1).otherwise(1)).alias("against"))
    d = rows.join(votes, key, "left").withColumn("flipped", F.coalesce(F.col("against") > 0, F.lit(False)))
    left, right = F.when(F.col("flipped"), F.col("right_clip")).otherwise(F.col("left_clip")), F.when(F.col("flipped"), F.col("left_clip")).otherwise(F.col("right_clip"))
    turned = d.withColumns({"nodes": F.when(F.col("flipped"), flip_path("nodes")).otherwise(F.col("nodes")), "__l": left, "__r": right})
    return turned.drop("against", "left_clip", "right_clip").withColumnsRenamed({"__l": "left_clip", "__r": "right_clip"})


def write_gaf(rows: DataFrame, path: str) -> None:
    """Alignments with ``nodes`` as GAF text."""
    names = [x.split()[0] for x in GAF.split(", ")]
    d = rows.withColumn("path", path_string("nodes")) if "nodes" in rows.columns else rows
    d.select(F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit("*")) for n in names])).write.text(path)


def read_node_list(spark: SparkSession, path) -> DataFrame:
    """Node names between white space and commas; ``end`` marks those written with ``>`` or ``<`` in front."""
    names = spark.read.text(path).select(F.explode(F.split("value", r"[,\s]+")).alias("n")).where("n <> ''")
    return names.select(F.regexp_replace("n", "^[<>]", "").alias("node"), F.col("n").rlike("^[<>]").alias("end"), F.when(F.col("n").rlike("^[<>]"), F.col("n").startswith(">")).alias("fwd"))


def write_node_list(nodes: DataFrame, path: str) -> None:
    nodes.select(F.concat(F.when(F.col("end"), F.when(F.col("fwd"), ">").otherwise("<")).otherwise(""), F.col("node"))).coalesce(1).write.text(path)


def read_layout(spark: SparkSession, path) -> DataFrame:
    """Reads of assembly pieces: (``read``, ``piece``); a piece's ``tig`` line stands above its reads."""
    lines = numbered_lines(spark, path)
    rows = fill_from_header(lines, F.startswith("value", F.lit("tig")), F.regexp_extract("value", r"^tig\s+(\S+)", 1), "piece")
    rows = rows.where(~F.col("value").rlike(r"^(len|cns|qlt|trm|rds|end)\b") & F.col("piece").isNotNull() & (F.trim("value") != ""))
    return rows.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("read"), "piece").distinct()


def read_scaffold_map(spark: SparkSession, path) -> DataFrame:
    """Pieces of named paths: (``piece``, ``path``); gaps in brackets are skipped."""
    rows = fill_from_header(numbered_lines(spark, path), F.startswith("value", F.lit("path")), F.regexp_extract("value", r"^path\s+\S+\s+(\S+)", 1), "path")
    rows = rows.where(~F.col("value").rlike(r"^(end\b|\[)") & F.col("path").isNotNull() & (F.trim("value") != ""))
    return rows.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("piece"), "path").distinct()


def read_node_paths(spark: SparkSession, path) -> DataFrame:
    """Nodes of named paths: (``node``, ``path``). The header row is skipped, gaps in brackets too."""
    f = _fields(spark, path).where((F.size("f") >= 2) & (F.get("f", 0) != "name"))
    return f.select(F.get("f", 0).alias("path"), F.explode(parse_gapped_path(F.get("f", 1))).alias("n")).select(F.col("n.id").alias("node"), "path").distinct()


def read_node_lengths(spark: SparkSession, path) -> DataFrame:
    return _fields(spark, path).where(F.size("f") >= 2).select(F.get("f", 0).alias("node"), F.get("f", 1).cast("bigint").alias("len"))


def read_node_map(spark: SparkSession, path) -> DataFrame:
    """(``node``, ``nodes``, ``left_clip``, ``right_clip``): the path that a node stands for."""
    f = _fields(spark, path).where(F.size("f") >= 2).select(F.get("f", 0).alias("node"), F.split(F.get("f", 1), ":").alias("p"))
    return f.select("node", parse_path(F.get("p", 0)).alias("nodes"), F.get("p", 1).cast("bigint").alias("left_clip"), F.get("p", 2).cast("bigint").alias("right_clip"))


def read_placements(spark: SparkSession, path) -> DataFrame:
    """``A`` lines of a GFA: (``node``, ``pos``, ``read``, ``read_len``)."""
    f = _fields(spark, path).where(F.get("f", 0) == "A")
    return f.select(F.get("f", 1).alias("node"), F.get("f", 2).cast("bigint").alias("pos"), F.get("f", 4).alias("read"), F.get("f", 6).cast("bigint").alias("read_len"))


def read_gff3(spark: SparkSession, path) -> DataFrame:
    names = "seqid source type start end score strand phase attributes".split()
    f = _fields(spark, path).where((F.size("f") >= 9) & ~F.startswith(F.get("f", 0), F.lit("#")))
    return f.select(*[F.get("f", i).cast("bigint" if n in ("start", "end") else "string").alias(n) for i, n in enumerate(names)])


def write_partitioned(reads: DataFrame, assignment: DataFrame, path: str, id: str = "id", by: str = "tangle") -> DataFrame:
    """Route each read to the folder of every cluster it belongs to (Parquet, partitioned by ``by``); returns the names never seen."""
    reads.join(assignment.select(id, by).distinct(), id).write.partitionBy(by).parquet(path)
    return assignment.select(id).distinct().join(reads, id, "left_anti")


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of the paths that exists in its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            return p
    return None


def hifiasm_graph(spark: SparkSession, prefix: str) -> str | None:
    """The graph file of an assembly prefix: the first kind of raw unitig graph that exists."""
    return first_existing(spark, *[f"{prefix}.{kind}r_utg.gfa" for kind in ("dip.", "bp.", "hic.", "hic.bench.", "")])


def config_value(text: str, key: str) -> str | None:
    """Value of ``key: value`` in a configuration text, without quotes; None if there is none."""
    for line in text.splitlines():
        name, colon, value = line.strip().partition(":")
        if colon and name.strip("'\"- ") == key:
            return value.strip().strip("'\"")
    return None


def config_list(text: str, key: str) -> list[str]:
    """Entries ``- value`` that follow the line ``key:``."""
    out, inside = [], False
    for line in text.splitlines():
        s = line.strip()
        if inside and s.startswith("-"):
            out += [x.strip("'\"") for x in s.lstrip("- ").split()]
        else:
            inside = s.rstrip() == f"{key}:"
    return out
