"""The pipelines: reads to a consensus unit, long reads to loops and morphs, for one locus or for each tangle of an assembly graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from looploom.config import Params
from looploom.functions.seq import morph_name, morph_type
from looploom.operators import assembly, clusters, cycles, grouped, loops
from looploom.operators.kmer import recruit
from looploom.tables import materialize


def recruit_reads(reads: DataFrame, reference: DataFrame, k: int, min_match: int) -> DataFrame:
    """Reads (``id``, ``seq``) that match the reference's syncmers over ``min_match`` bases."""
    return reads.join(recruit(reads, reference, k, min_match, syncmer=True).select("id"), "id", "left_semi")


def consensus(reads: DataFrame, params: Params, key: str = "tangle") -> DataFrame:
    """(key, ``path``, ``consensus``) of the heaviest cycle of each key's de Bruijn graph."""
    nodes, edges = grouped.de_bruijn(reads, params.k, params.min_kmer, key)
    return materialize(grouped.heaviest_cycles(nodes, edges, key, params.resolve_length), "consensus")


@dataclass
class Morphs:
    """``loops``: read, start, end, raw, cluster; ``morphs``: cluster, name, coverage, consensus; ``edges`` and ``paths``: how morphs follow each other."""

    loops: DataFrame
    morphs: DataFrame
    edges: DataFrame
    paths: DataFrame


def morphs(long_reads: DataFrame, unit: str, params: Params, min_length: int | None = None) -> Morphs:
    """Cut long reads into loops of the unit, cluster them by edit distance, split clusters by variants (``extra_phasing``) or density, and
    polish one consensus for each."""
    found = loops.loops_between_breaks(long_reads, loops.unit_breaks(long_reads, unit, params.long_k), min_length or len(unit) // 2)
    found = materialize(found.withColumn("id", F.concat_ws("_", "read", F.col("start").cast("string"), F.col("end").cast("string"))), "loops")
    rough = materialize(found.join(clusters.rough_clusters(found, params.max_edits, "id", "raw"), "id"), "rough")
    split = grouped.phased(rough, "cluster", "id", "raw") if params.extra_phasing else clusters.density_split(rough, "cluster", "id", "raw", params.max_edits, params.min_edits)
    parts = materialize(split.where("part is not null"), "parts")
    sized = parts.groupBy("cluster", "part").agg(F.count("*").alias("coverage"), F.min("id").alias("first"))
    ranked = sized.withColumn("morph", F.row_number().over(W.orderBy(F.desc("coverage"), "first")) - 1)  # a row a morph, not a loop
    named = materialize(rough.drop("cluster").join(parts.join(ranked, ["cluster", "part"]).select("id", "morph", "coverage"), "id"), "named")
    polished = grouped.polished(named, "morph", "id", "raw")
    prefix = F.lit(params.sample)
    kinds = ranked.select("morph", "coverage", morph_name(prefix, "morph", morph_type(F.lit(False), F.lit(False)), "coverage").alias("name"))
    out = materialize(polished.join(kinds, "morph").select("morph", "name", "coverage", "consensus"), "morphs")
    edges, paths = loops.morph_graph(named.select("read", "start", "end", "morph"))
    return Morphs(named, out, edges, paths)


def reference_mode(reads: DataFrame, reference: DataFrame, params: Params, long_reads: DataFrame | None = None, orient_by: str | None = None) -> tuple[str, Morphs | None]:
    """(consensus unit, morphs) of the locus that ``reference`` describes. ``orient_by`` is a sequence that sets strand and beginning."""
    own = materialize(recruit_reads(reads, reference, params.recruit_k, params.recruit_min).withColumn("tangle", F.lit(0)), "recruited")
    row = consensus(own, params).first()
    unit = row["consensus"] if row else None
    if not unit:
        return "", None
    if orient_by:
        unit = cycles.rotate_to_reference(unit, orient_by, min(params.k, 31))
    if long_reads is None:
        return unit, None
    ref = reads.sparkSession.createDataFrame([("unit", unit + unit)], "id string, seq string")
    near = materialize(recruit_reads(long_reads, ref, params.long_k, len(unit) // 2), "long")
    return unit, morphs(near, unit, params)


def tangle_mode(reads: DataFrame, nodes: DataFrame, edges: DataFrame, reference: DataFrame, read_pieces: DataFrame, piece_paths: DataFrame, node_paths: DataFrame, params: Params, **guess) -> DataFrame:
    """Consensus unit of each tangle of an assembly graph: tangles are guessed, reads assigned through pieces and paths, and all tangles
    are solved side by side."""
    tangles = materialize(assembly.guess_tangles(nodes, edges, reference, params.recruit_k, **guess), "tangles")
    to = assembly.reads_of_tangles(read_pieces, piece_paths, assembly.paths_of_tangles(tangles, node_paths))
    own = materialize(reads.join(to.withColumnRenamed("read", "id"), "id"), "assigned")
    return consensus(own, params)
