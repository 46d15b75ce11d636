"""Quality rules: base rules on counts, then minimum-covariance-determinant (MCD) outlier rejection for each language and source.

Only DataFrame operations. Each text is read once; what the estimates use is a table of a few numbers a document. One concentration step
(C-step) of the MCD is one aggregation: distances are binned on a logarithmic scale and the moments are summed for each group and bin on
the map side, so a group that holds a third of all rows sends a few hundred rows to a shuffle. The half with the smallest distances is
then a range of bins, and new centres and scatters follow from the summed moments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from looploom.llm.text import WORD, table, words
from looploom.tables import materialize

#: Components of the statistic vector and the least standard deviation taken for each.
FLOORS = {"x_len": 0.1, "x_sym": 0.2, "x_rep": 0.1, "x_dup": 0.1}
DIMS = tuple(FLOORS)
P = len(DIMS)
#: Statistics are multiples of this, so sums of products are exact in doubles (any order) up to some 10**7 rows a group.
QUANTUM = 1 / 1024
#: 0.5 and 0.975 quantiles of chi-square with P = 4 degrees of freedom.
CHI2_HALF, CHI2_975 = 3.3567, 11.1433
#: What makes the scatter of the rows below the 0.975 quantile that of all rows, if these are normal.
CONSISTENT = 1.0645
#: Bins of the squared distance: 32 to the octave, from 2**-16 to 2**32.
BINS_OCTAVE, LOW_OCTAVE, HIGH_OCTAVE = 32, -16, 32
#: Squared distance from which a document is an outlier: the quantile of chi-square for one in a million. With the floors above, a share of a
#: third of repeated words or lines is over it by itself in a source that has none.
CUTOFF = 33.4
#: Up to so many groups their estimates (some 200 bytes each) are broadcast; more are joined by group.
BROADCAST_GROUPS = 50_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the array ``w``, the first find included.

    Windows are compared by 64-bit hash; sorting (hash, position) brings equal windows together, so the cost is n log n.
    """

    def windows(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.struct(F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)).alias("h"), i.alias("p")))

    def found_again(s: Column) -> Column:
        like = lambda x, i: F.coalesce(F.get(s, i).h == x.h, F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x.p))

    def covered(q: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(q, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    found = _let(w, lambda a: _let(F.array_sort(windows(a)), lambda s: _let(found_again(s), covered)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(found).cast("long")


def base_statistics(text: Column) -> Column:
    """Struct of ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines``, ``n_repeat_words``. Null: all 0."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    return _let(
        F.struct(words(text).alias("w"), lines.alias("l")),
        lambda s: F.struct(
            F.size(s.w).cast("long").alias("n_words"),
            F.length(F.array_join(s.w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(s.l).cast("long").alias("n_lines"),
            (F.size(s.l) - F.size(F.array_distinct(s.l))).cast("long").alias("n_dup_lines"),
            repeated_words(s.w).alias("n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: log word length, log symbols a hundred words, root of the shares of repeated words and of repeated lines."""
    n = F.greatest("n_words", F.lit(1))
    raw = [F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)))]
    return [(F.round(x / QUANTUM) * QUANTUM).alias(d) for x, d in zip(raw, DIMS, strict=True)]


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(d).alias(f"s{i}") for i, d in enumerate(DIMS)], *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}{j}") for i, j in _PAIRS]]


_SUMMED = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _PAIRS]]


def _estimate(sums: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Centre ``m*``, inverse Cholesky factor ``l**`` and log determinant ``logdet`` of the floored covariance (times ``scale``), from summed moments."""
    floor = [FLOORS[d] ** 2 for d in DIMS]
    d = sums.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[f"q{i}{j}" for i, j in _PAIRS])
    d = d.select(*keys, "n", *[f"m{i}" for i in range(P)], *[((F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale + (floor[i] if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    for j in range(P):  # Cholesky: c = g g'
        d = d.withColumn(f"g{j}{j}", F.sqrt(F.greatest(reduce(lambda a, k: a - F.col(f"g{j}{k}") ** 2, range(j), F.col(f"c{j}{j}")), F.lit(1e-9))))
        d = d.withColumns({f"g{i}{j}": reduce(lambda a, k: a - F.col(f"g{i}{k}") * F.col(f"g{j}{k}"), range(j), F.col(f"c{i}{j}")) / F.col(f"g{j}{j}") for i in range(j + 1, P)})
    for i in range(P):  # l = g to the power -1
        d = d.withColumns({f"l{i}{j}": (F.lit(1.0) if i == j else -reduce(lambda a, k: a + F.col(f"g{i}{k}") * F.col(f"l{k}{j}"), range(j, i), F.lit(0.0))) / F.col(f"g{i}{i}") for j in range(i + 1)})
    return d.withColumn("logdet", reduce(lambda a, i: a + 2 * F.log(f"g{i}{i}"), range(P), F.lit(0.0))).select(*keys, *_ESTIMATE)


_ESTIMATE = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _PAIRS], "logdet"]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row that carries an estimate."""
    return reduce(lambda a, i: a + reduce(lambda b, j: b + F.col(f"l{i}{j}") * (F.col(DIMS[j]) - F.col(f"m{j}")), range(i + 1), F.lit(0.0)) ** 2, range(P), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(F.lit(2.0**LOW_OCTAVE), F.least(d2, F.lit(2.0**HIGH_OCTAVE)))) * BINS_OCTAVE).cast("int")


def _with(rows: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(est) if few else est, "g")


def _half(binned: DataFrame, keys: list[str]) -> DataFrame:
    """From moments by bin: those of the smallest bins that hold at least (n + P + 1) / 2 rows, with the last bin as ``b``."""
    w = W.partitionBy(*keys)
    cum = binned.withColumns({"before": F.sum("n").over(w.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), "all": F.sum("n").over(w)})
    inside = cum.where("coalesce(before, 0) < floor((all + %d) / 2)" % (P + 1))
    return inside.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMMED], F.max("b").alias("b"))


def mcd(rows: DataFrame, steps: int = 4, few: bool = True) -> DataFrame:
    """Reweighted MCD estimate of each group: rows (``g``, the components) to (``g``, centre, inverse factor).

    Two starts (the group's mean and covariance; its mean with the floors alone as scatter) are concentrated side by side; the smaller
    determinant wins. The scatter is scaled so that the median distance fits chi-square, and one reweighting step at its 0.975 quantile
    follows. A group of any size, even one row, has an estimate, since the floors keep the scatter regular. ``few``: the caller has
    counted the groups and their estimates may be broadcast.
    """
    first = materialize(rows.groupBy("g").agg(*_moments()), "moments")
    full = _estimate(first, ["g"]).withColumn("k", F.lit(0))
    alone = full.select("g", *[f"m{i}" for i in range(P)], *[F.lit(1 / FLOORS[DIMS[i]] if i == j else 0.0).alias(f"l{i}{j}") for i, j in _PAIRS], F.lit(0.0).alias("logdet"), F.lit(1).alias("k"))
    est = materialize(full.unionByName(alone), "estimates")
    for _ in range(steps):
        binned = _with(rows, est, few).withColumn("b", _bin(_distance())).groupBy("g", "k", "b").agg(*_moments())
        est = materialize(_estimate(_half(binned, ["g", "k"]), ["g", "k"]), "estimates")
    best = est.groupBy("g").agg(F.min_by(F.struct(*_ESTIMATE), F.struct("logdet", "k")).alias("e")).select("g", "e.*")
    near = _with(rows, best, few).withColumn("b", _bin(_distance())).groupBy("g", "b").agg(*_moments())
    median = _half(near, ["g"]).select("g", (F.pow(F.lit(2.0), (F.col("b") + 0.5) / BINS_OCTAVE)).alias("median"))
    binned = near.join(median, "g").withColumn("scaled", F.pow(F.lit(2.0), F.col("b") / BINS_OCTAVE) * CHI2_HALF / F.greatest("median", F.lit(CHI2_HALF / 64)))
    kept = binned.where(f"scaled <= {CHI2_975}").groupBy("g").agg(*[F.sum(c).alias(c) for c in _SUMMED])
    return materialize(_estimate(kept, ["g"], CONSISTENT), "estimates")


def quality_rules(docs: DataFrame, columns: list[str] | None = None, cutoff: float = CUTOFF, steps: int = 4) -> DataFrame:
    """``docs`` (its ``columns``, or all) with the base statistics, ``base_failed``, ``distance`` (squared, robust) and ``kept``.

    Base rules reject texts under 50 words and texts more than half of whose words stand in repeated 3-word windows. The others are
    judged by the MCD estimate of their group (language and source, however few documents it has; null languages and sources count as
    values of their own). ``kept`` is false for a squared distance over ``cutoff``, which lies far outside the bulk of any group, and where
    a base rule fails; ``distance`` is null for the latter. Null texts count as empty and fail; very long texts are read whole; repeated
    rows are judged each, and equal texts of one group get equal verdicts; doc_ids may be null; columns of ``docs`` named like a new one are
    replaced; an empty table gives an empty one. ``docs`` needs ``text``, ``lang`` and ``source``.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    carry = [c for c in (columns or docs.columns) if c not in {*new, "base_failed", "distance", "kept"}]
    pair = F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")))
    stats = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), pair.alias("g"), base_statistics(F.col("text")).alias("s")).select("doc", "g", "s.*")
    stats = materialize(stats.select("*", base_failed().alias("base_failed"), *vector()), "statistics")
    rows = stats.where("not base_failed").select("g", *DIMS)
    small = rows.select("g").distinct().count() <= BROADCAST_GROUPS
    est = mcd(rows, steps, small)
    judged = stats.join(F.broadcast(est) if small else est, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select("doc.*", *new, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document; see :func:`quality_rules`."""
    judged = quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
