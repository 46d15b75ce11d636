"""The corpus pipeline: documents to packed training sequences in five stages, each on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All stages but the last return the columns of ``docs``, further ones and such with clashing names included. Every
stage takes empty tables, very long texts, ties and repeated rows; its operator's docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from looploom.llm.mixing import mix_sources
from looploom.llm.packing import pack_documents
from looploom.llm.quality import quality_rules
from looploom.llm.simhash import one_of_each
from looploom.llm.text import table
from looploom.llm.toxicity import fit_toxicity, score_toxicity
from looploom.tables import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; null doc_ids, languages and sources do not matter; an empty table stays empty."""
    return quality_rules(docs).where("kept").select(*[f"`{c}`" for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The classifier learns from the labelled rows of the whole table of documents. Null and empty
    texts are scored like any other; without labels of both kinds all documents stay."""
    net = fit_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, net).where("predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id. Rows without a doc_id, and different rows that share one,
    are documents of their own; a row that repeats as a whole is one document."""
    return one_of_each(docs).select(*[f"`{c}`" for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to give sources their target weights. The readings of a document are equal rows, as a stage returns
    the columns of documents alone; packing gives each its own pieces. Null sources are a source; documents without words follow their block."""
    return mix_sources(docs).select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids. Null texts are the end id alone; a null doc_id stays null."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("simhash near-dedup", near_duplicates), ("mixing", mixture), ("packing", packing)]

#: SQL has no form for these stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
