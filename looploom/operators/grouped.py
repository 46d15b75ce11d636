"""Operators that walk one small graph or one cluster's strings: grouped maps over ``tangle`` or ``cluster``, and vectorised functions.

A group's strings are in one task, as one locus or one cluster is small by nature (hundreds of units of tens of kilobases). Register
the functions for SQL with :func:`register`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from looploom.operators import cycles, phasing, strings

EDITS = ArrayType(StructType([StructField("ref_start", LongType()), StructField("ref_end", LongType()), StructField("alt", StringType()), StructField("query_pos", LongType())]))
CHAIN = ArrayType(StructType([StructField("ref_pos", LongType()), StructField("pos", LongType())]))


@F.pandas_udf(EDITS)
def edit_script(ref: pd.Series, query: pd.Series) -> pd.Series:
    """Edits from one string to the other, aligned between anchors. Null for a null string."""
    return pd.Series([None if a is None or b is None else strings.edits_between_anchors(a, b) for a, b in zip(ref, query, strict=True)])


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else strings.edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(IntegerType())
def compatible_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """The distance as the original tool reports it; see :func:`strings.compatible_distance`."""
    return pd.Series([None if x is None or y is None else strings.compatible_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(CHAIN)
def longest_chain(points: pd.Series) -> pd.Series:
    """A longest increasing chain of an array of (``ref_pos``, ``pos``)."""
    return pd.Series([None if p is None else strings.increasing_chain([(x["ref_pos"], x["pos"]) for x in p]) for p in points])


def register(spark: SparkSession) -> None:
    """Make the vectorised functions callable from SQL."""
    for f in (edit_script, edit_distance, compatible_distance, longest_chain):
        spark.udf.register(f.__name__, f)


def _grouped(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    return df.groupBy(key).applyInPandas(run, schema)


def polished(loops: DataFrame, key: str = "cluster", id: str = "id", seq: str = "seq") -> DataFrame:
    """(key, ``n_loops``, ``consensus``) of each cluster: its loop of middle length, polished by all."""
    kind = dict(loops.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs = [s for _, s in sorted(zip(pdf[id], pdf[seq], strict=True))]
        start = sorted(seqs, key=lambda s: (len(s), s))[len(seqs) // 2]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n_loops": [len(seqs)], "consensus": [strings.polish(start, seqs)]})

    return _grouped(loops.select(key, id, seq), key, run, f"`{key}` {kind}, n_loops long, consensus string")


def self_corrected(loops: DataFrame, key: str = "cluster", id: str = "id", seq: str = "seq") -> DataFrame:
    """Each loop with ``corrected``: rewritten along the k-mers that its cluster shares."""
    kinds = dict(loops.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id)
        return pdf[[key, id]].assign(corrected=strings.self_correct(list(pdf[seq])))

    return _grouped(loops.select(key, id, seq), key, run, f"`{key}` {kinds[key]}, `{id}` {kinds[id]}, corrected string")


def phased(loops: DataFrame, key: str = "cluster", id: str = "id", seq: str = "seq") -> DataFrame:
    """Each loop with ``part`` (from 0): its group after splitting the cluster by variants."""
    kinds = dict(loops.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id).reset_index(drop=True)
        part = [0] * len(pdf)
        for k, group in enumerate(phasing.phase(list(pdf[seq]))):
            for i in group:
                part[i] = k
        return pdf[[key, id]].assign(part=part)

    return _grouped(loops.select(key, id, seq), key, run, f"`{key}` {kinds[key]}, `{id}` {kinds[id]}, part long")


def heaviest_cycles(nodes: DataFrame, edges: DataFrame, key: str = "tangle", resolve_length: int = 0) -> DataFrame:
    """The heaviest cycle of each graph: (key, ``path`` as text, ``consensus``) from nodes (key, ``name``, ``seq``, ``coverage``) and edges (key, …)."""
    kind = dict(nodes.dtypes)[key]

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({key: [], "path": [], "consensus": []})
        seqs = dict(zip(n["name"], n["seq"], strict=True))
        g = cycles.Graph.of([(a, len(seqs[a]), int(c)) for a, c in zip(n["name"], n["coverage"], strict=True)], [tuple(r) for r in e[["src", "src_fwd", "dst", "dst_fwd", "overlap", "coverage"]].itertuples(index=False)])
        found = cycles.heaviest_cycle(g, resolve_length)
        text = "".join((">" if f else "<") + str(x) for x, f in found)
        return pd.DataFrame({key: [n[key].iloc[0]], "path": [text], "consensus": [cycles.path_sequence(found, seqs, g) if found else None]})

    return nodes.select(key, "name", "seq", "coverage").groupBy(key).cogroup(edges.select(key, "src", "src_fwd", "dst", "dst_fwd", "overlap", "coverage").groupBy(key)).applyInPandas(run, f"`{key}` {kind}, path string, consensus string")


def de_bruijn(reads: DataFrame, k: int, least: int = 2, key: str = "tangle", id: str = "id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the compacted de Bruijn graph of each key's reads. K-mers are counted over all reads by Spark; those of at least ``least``
    occurrences on both strands are compacted a key at a time."""
    from looploom.functions.seq import revcomp
    from looploom.operators.kmer import kmers
    from looploom.tables import materialize

    kind = dict(reads.dtypes)[key]
    found = kmers(reads.withColumn("__k", F.struct(key, id)), k, "__k", seq).select(F.col(f"id.{key}").alias(key), F.least("kmer", revcomp("kmer")).alias("kmer"))
    counts = found.groupBy(key, "kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, edges = cycles.unitigs(dict(zip(pdf["kmer"], pdf["n"].astype(int), strict=True)))
        rows = [("S", a, s, None, None, None, None, c) for a, (s, c) in nodes.items()] + [("L", a, None, af, b, bf, lap, c) for a, af, b, bf, lap, c in edges]
        return pd.DataFrame(rows, columns=["kind", "name", "seq", "src_fwd", "dst", "dst_fwd", "overlap", "coverage"]).assign(**{key: pdf[key].iloc[0]}).astype({"overlap": "Int64", "src_fwd": "boolean", "dst_fwd": "boolean"})

    graph = materialize(counts.groupBy(key).applyInPandas(run, f"kind string, name string, seq string, src_fwd boolean, dst string, dst_fwd boolean, overlap long, coverage long, `{key}` {kind}"), "graph")
    nodes = graph.where("kind = 'S'").select(key, "name", "seq", F.length("seq").cast("long").alias("len"), "coverage")
    edges = graph.where("kind = 'L'").select(key, F.col("name").alias("src"), "src_fwd", "dst", "dst_fwd", "overlap", "coverage")
    return nodes, edges
