"""Lines of text files with their numbers, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(``file``, ``line`` from 0, ``value``) of text files (gzip by suffix), however Spark splits them.

    Lines are numbered within their split; a split's first number follows from the counts of the splits before it in its file. Only
    those counts are gathered, in a window for each file.
    """
    from pyspark.sql import Window as W

    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    splits = rows.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "at", (before - F.col("first")).alias("shift"))
    return rows.join(splits, ["file", "at"]).select("file", (F.col("m") + F.col("shift")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def fill_from_header(lines: DataFrame, is_header, header, name: str) -> DataFrame:
    """Each line that isn't a header, with the value of the last header line above it in its file."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("__h", is_header).withColumn(name, F.last(F.when(F.col("__h"), header), ignorenulls=True).over(w))
    return marked.where("not __h").drop("__h")
