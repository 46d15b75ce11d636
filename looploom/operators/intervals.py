"""Interval, sequence-of-events and assignment operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def overlap_join(a: DataFrame, b: DataFrame, key: str, bin_width: int, how: str = "inner") -> DataFrame:
    """Pairs of half-open intervals (``key``, ``start``, ``end``, …) of ``a`` and ``b`` (columns ``b_start``, ``b_end``, …) that overlap.

    Both sides are dealt to the bins that they touch, so the join is an equi-join on key and bin and each pair is made once, in the bin
    where the later of the two begins. ``how`` is ``inner`` or ``anti`` (rows of ``a`` that overlap nothing). Empty intervals overlap nothing.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width)))
    right = b.where("b_start < b_end").withColumn("__bin", bins("b_start", "b_end"))
    left = a.where(F.col("start") < F.col("end"))
    if how == "inner":
        pairs = left.withColumn("__bin", bins("start", "end")).join(right, [key, "__bin"])
        return pairs.where("start < b_end and b_start < end").where(F.floor(F.greatest("start", "b_start") / bin_width) == F.col("__bin")).drop("__bin")
    if how != "anti":
        raise ValueError(how)
    # a row is met in any of its bins; those met are found first, so that rows are compared whole
    cols = a.columns
    met = left.withColumn("__bin", bins("start", "end")).join(right.select(key, "__bin", "b_start", "b_end"), [key, "__bin"]).where("start < b_end and b_start < end").select(*cols).distinct()
    same = [a[x].eqNullSafe(met[x]) for x in cols]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return a.join(met, cond, "left_anti")


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """Union of the spans of each key, as maximal disjoint spans; touching spans are joined. Equal spans count once, so their order does
    not matter; missing ends come last."""
    w = W.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.select(key, "start", "end", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement_spans(spans: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    """What the spans of each key leave free between ``low`` and ``high`` (columns of the key's first span or literals)."""
    merged = merge_spans(spans, key)
    w = W.partitionBy(key).orderBy(F.asc_nulls_last("start"))
    free = merged.select(key, F.coalesce(F.lag("end").over(w), low).alias("a"), F.col("start").alias("b"))
    tail = merged.groupBy(key).agg(F.max("end").alias("a")).select(key, "a", high.alias("b"))
    return free.unionByName(tail).where("a < b").select(key, F.col("a").alias("start"), F.col("b").alias("end"))


def contained(spans: DataFrame, key: str) -> DataFrame:
    """``spans`` with ``inside``: whether a span lies in the reach of those before it (by start, longer first)."""
    w = W.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("inside", F.coalesce(F.col("end") <= F.max("end").over(w), F.lit(False)))


def fill_forward(rows: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null up to each row."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gap_chains(rows: DataFrame, by: list[str], start: str, end: str, gap: int, tie: str | None = None) -> DataFrame:
    """``rows`` with ``chain`` (from 0): consecutive rows whose ends and starts lie at most ``gap`` apart, either way. Rows without a place come last."""
    w = W.partitionBy(*by).orderBy(*[F.asc_nulls_last(c) for c in (start, end, *([tie] if tie else []))])
    new = F.coalesce((F.abs(F.col(start) - F.lag(end).over(w)) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__new")


def unique_assignment(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key that has exactly one; a key with several is ambiguous and left out."""
    found = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return found.where("lo = hi").select(key, F.col("lo").alias(value))


def tiered_assignment(rows: DataFrame, key: str, value: str, tier: str) -> DataFrame:
    """Like :func:`unique_assignment` among the rows of each key's best (smallest) tier."""
    best = rows.groupBy(key).agg(F.min(tier).alias("__best"))
    inside = rows.join(best, key).where(F.col(tier) == F.col("__best"))
    return unique_assignment(inside, key, value)


def spaced_count(rows: DataFrame, by: list[str], pos: str, gap: int) -> DataFrame:
    """How many places lie at least ``gap`` after the one before (the first counts)."""
    w = W.partitionBy(*by).orderBy(pos)
    far = F.coalesce((F.col(pos) - F.lag(pos).over(w) >= gap).cast("int"), F.lit(1))
    return rows.select(*by, far.alias("far")).groupBy(*by).agg(F.sum("far").alias("n_spaced"))


def spaced_greedy(rows: DataFrame, by: list[str], pos: str, gap: int) -> DataFrame:
    """How many places a left-to-right choice keeps, each over ``gap`` after the last one kept."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("last"))
    step = lambda a, x: F.when(a["last"].isNull() | (x - a["last"] > gap), F.struct((a["n"] + 1).alias("n"), x.alias("last"))).otherwise(a)
    places = F.array_sort(F.collect_set(F.col(pos).cast("bigint")))
    return rows.groupBy(*by).agg(F.aggregate(places, start, step, lambda a: a["n"]).alias("n_kept"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Element n/2 (from 0) of the sorted values: counted, so that no group is gathered."""
    counts = rows.groupBy(*by, value).count()
    w = W.partitionBy(*by).orderBy(value)
    upto = counts.select(*by, value, F.sum("count").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("count").over(W.partitionBy(*by)).alias("n"))
    return upto.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(value).alias("median"))


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running sum of weights reaches half of all."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    win = W.partitionBy(*by).orderBy(value)
    upto = sums.select(*by, value, F.sum("w").over(win.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("w").over(W.partitionBy(*by)).alias("all"))
    return upto.where("2 * upto >= all").groupBy(*by).agg(F.min(value).alias("median"))


def modal(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value (the smallest of equals) and its count."""
    counts = rows.groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value), F.max("count").alias("n"))
