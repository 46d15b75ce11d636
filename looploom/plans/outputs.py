"""Files that a run leaves in its folder: the unit, the morphs and their graph, the loops.

Each is written by Spark as a folder of text parts under the file's name, so loops of any number are written where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from looploom.functions.seq import path_string
from looploom.plans.pipelines import Morphs
from looploom.sources.graphs import write_gfa
from looploom.sources.sequences import write_fasta


def loop_names() -> F.Column:
    """Names of loops in files: read, start and end, joined by underscores."""
    return F.concat_ws("_", "read", F.col("start").cast("string"), F.col("end").cast("string"))


def write_unit(spark: SparkSession, unit: str, folder: str) -> None:
    """``consensus.fa``: the unit, if there is one."""
    rows = [("consensus", unit)] if unit else []
    write_fasta(spark.createDataFrame(rows, "id string, seq string"), f"{folder}/consensus.fa")


def write_morphs(out: Morphs, folder: str) -> None:
    """``morphs.fa``, ``loops.fa`` (raw), ``morphgraph.gfa`` and ``readpaths.tsv`` (read, chain, path of morphs)."""
    write_fasta(out.morphs.select(F.col("name").alias("id"), F.col("consensus").alias("seq")).where("seq is not null"), f"{folder}/morphs.fa")
    write_fasta(out.loops.select(loop_names().alias("id"), F.col("raw").alias("seq")).where("seq is not null"), f"{folder}/loops.fa")
    names = out.morphs.select("morph", "name")
    nodes = out.morphs.select("name", F.col("consensus").alias("seq"), F.length("consensus").alias("len"), "coverage")
    ends = out.edges.join(names.select(F.col("morph").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("morph").alias("dst"), F.col("name").alias("b")), "dst")
    write_gfa(nodes, ends.select(F.col("a").alias("src"), "src_fwd", F.col("b").alias("dst"), "dst_fwd", F.lit(0).alias("overlap"), "coverage"), f"{folder}/morphgraph.gfa")
    steps = out.paths.select("read", "chain", F.posexplode("morphs").alias("i", "m")).join(names, F.col("m.id") == F.col("morph"))
    step = F.struct("i", F.struct(F.col("name").alias("id"), F.col("m.fwd").alias("fwd")).alias("n"))
    paths = steps.groupBy("read", "chain").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["n"]).alias("nodes"))
    paths.select(F.concat_ws("\t", "read", F.col("chain").cast("string"), path_string("nodes"))).write.text(f"{folder}/readpaths.tsv")


def write_missing(missing: DataFrame, reads: DataFrame, folder: str) -> None:
    """``missing_loops.fa``: raw bases of loops (``read``, ``start``, ``end``) that no cluster holds."""
    d = missing.join(reads.select(F.col("id").alias("read"), "seq"), "read")
    raw = F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    write_fasta(d.select(loop_names().alias("id"), raw.alias("seq")), f"{folder}/missing_loops.fa")
