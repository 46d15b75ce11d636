"""Clustering of loops by edit distance and density, as DataFrame operations on pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from looploom.operators.components import connected_components
from looploom.operators.intervals import upper_median
from looploom.tables import materialize


#: Sequences of a length band that one task compares with each other; larger bands are cut into blocks.
BAND_ROWS = 512


def length_band_pairs(seqs: DataFrame, max_edits: int, id: str = "id", seq: str = "seq", key: str | None = None) -> DataFrame:
    """Pairs (``key``, ``a``, ``b``, ``dist``) of sequences (of one ``key``, if given) within ``max_edits`` edits, a < b, each once.

    Lengths of such a pair differ by ``max_edits`` at most, so sequences are dealt to length bands of that width and joined with their own
    and the next band. Loops of one locus are nearly equally long, so a band is cut into blocks by hash of the id, and each pair of blocks
    is a join key of its own: no task compares more than ``BAND_ROWS`` sequences with as many, in expectation, and none is left out. Give
    distinct sequences, as copies would be compared with each other.
    """
    width = max(1, max_edits)
    own = [F.col(key).alias(key)] if key else []
    s = seqs.select(*own, F.col(id).alias("id"), F.col(seq).alias("seq"), F.floor(F.length(seq) / width).alias("band"))
    left = s.select(*own, F.col("id").alias("i"), F.col("seq").alias("si"), F.col("band").alias("bi"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = s.select(*own, F.col("id").alias("j"), F.col("seq").alias("sj"), "band")
    on = [*([key] if key else []), "band"]
    # bands that two sequences reach, of which one lies in them
    sizes = s.select(*own, F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")).groupBy(*on).agg(F.ceil(F.count("*") / BAND_ROWS).cast("int").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.col("blocks")).cast("int")
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = left.join(sizes, on).withColumn("bl", block("i")).withColumn("br", all_blocks).drop("blocks")
    right = right.join(sizes, on).withColumn("br", block("j")).withColumn("bl", all_blocks).drop("blocks")
    pairs = left.join(right, [*on, "bl", "br"]).where("(band <> bi or i < j) and i <> j").where(F.abs(F.length("si") - F.length("sj")) <= max_edits)
    d = F.when(F.col("si") == F.col("sj"), 0).otherwise(F.levenshtein("si", "sj", max_edits))
    return pairs.withColumn("dist", d).where("dist >= 0").select(*own, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "dist")


def rough_clusters(seqs: DataFrame, max_edits: int, id: str = "id", seq: str = "seq") -> DataFrame:
    """(``id``, ``cluster``): single linkage within ``max_edits``; a cluster is known by its smallest id. Equal sequences are one from the start."""
    kinds = seqs.groupBy(F.col(seq).alias("seq")).agg(F.min(id).alias("kind"))
    joined = connected_components(length_band_pairs(kinds, max_edits, "kind"), "a", "b").select(F.col("node").alias("kind"), "component")
    return seqs.select(F.col(id).alias("id"), F.col(seq).alias("seq")).join(kinds, "seq").join(joined, "kind", "left").select("id", F.coalesce("component", "kind").alias("cluster"))


def dbscan(points: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(``id``, ``cluster``, ``core``) for ``points`` (``id``) and the pairs (``a``, ``b``) within the radius, as in :func:`strings.dbscan`: border points
    between clusters and noise have a null cluster."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("near")))
    core = both.groupBy("id").count().where(F.col("count") >= least).select("id")
    with_core = both.join(core.withColumnRenamed("id", "near"), "near")
    chained = connected_components(with_core.join(core, "id"), "id", "near")
    labels = core.join(chained.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = with_core.join(core, "id", "left_anti").join(labels.select(F.col("id").alias("near"), "cluster"), "near").groupBy("id").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    border = border.where("lo = hi").select("id", F.col("lo").alias("cluster"))
    named = labels.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return points.select("id").join(named, "id", "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def distance_histogram_peak(pairs: DataFrame, bins: int) -> DataFrame:
    """The most frequent distance below the last bin (the larger of equals): one row (``peak``, ``n``); null for no pairs."""
    counts = pairs.where(F.col("dist") < bins - 1).groupBy("dist").count()
    return counts.agg(F.max_by("dist", F.struct("count", "dist")).alias("peak"), F.max("count").alias("n"))


def density_split(loops: DataFrame, key: str = "cluster", id: str = "id", seq: str = "seq", max_edits: int = 200, min_edits: int = 5, least: int = 5, kept_share: float = 0.9) -> DataFrame:
    """Each loop (``key``, ``id``) with ``part``, as in :func:`strings.density_clusters` under the peak of the distances of all clusters: its
    density cluster in its cluster, numbered by the smallest id; null where it is noise; 0 where the cluster stays whole.

    Equal loops of a cluster are one class that counts as often as it occurs, so copies make no pairs. Pairs are those of
    :func:`length_band_pairs`; chaining, borders and shares are joins and sums over classes, so no cluster meets in one task.
    """
    rows = loops.select(F.col(key).alias("key"), F.col(id).alias("id"), F.col(seq).alias("seq"))
    kinds = rows.groupBy("key", "seq").agg(F.min("id").alias("least_id"), F.count("*").alias("n"), F.length("seq").alias("len"))
    kinds = materialize(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    # farther pairs are in the last bin, which the peak leaves out
    pairs = materialize(length_band_pairs(kinds, max(0, max_edits - 2), "kind", "seq", "key"), "pairs")
    n_of = lambda c: kinds.select(F.col("kind").alias(c), F.col("n").alias(f"n{c}"))
    weighed = pairs.join(n_of("a"), "a").join(n_of("b"), "b")
    counts = weighed.groupBy("dist").agg(F.sum(F.col("na") * F.col("nb")).alias("n")).unionByName(kinds.where("n > 1").agg(F.lit(0).alias("dist"), F.sum(F.expr("n * (n - 1) div 2")).alias("n")))
    top = counts.where("n > 0").groupBy("dist").agg(F.sum("n").alias("n")).agg(F.max_by("dist", F.struct("n", "dist")).alias("peak")).first()["peak"]
    none = F.lit(0).cast("long")
    back = [F.col("key").alias(key), F.col("id").alias(id)]
    if top is None:
        return rows.select(*back, none.alias("part"))
    middle = upper_median(rows.select("key", F.length("seq").alias("len")), ["key"], "len").withColumnRenamed("median", "mid")
    everywhere = upper_median(rows.select(F.lit(0).alias("k"), F.length("seq").alias("len")), ["k"], "len").first()["median"]
    radius = materialize(middle.select("key", F.greatest(F.lit(float(min_edits)), F.col("mid") * F.lit(float(top)) / F.lit(float(max(1, everywhere)))).alias("radius")), "radius")
    near = weighed.join(radius, "key").where("dist <= radius").select("a", "b", "na", "nb")
    sides = materialize(near.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("nb").alias("n")).unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y"), F.col("na").alias("n"))), "sides")
    degree = sides.groupBy(F.col("x").alias("kind")).agg(F.sum("n").alias("others"))
    core = materialize(kinds.join(degree, "kind", "left").where(F.coalesce("others", F.lit(0)) + F.col("n") - 1 >= least).select("kind"), "cores")
    to_core = sides.join(core.withColumnRenamed("kind", "y"), "y")
    chained = connected_components(to_core.join(core.withColumnRenamed("kind", "x"), "x"), "x", "y")
    labels = materialize(core.join(chained.withColumnRenamed("node", "kind"), "kind", "left").select("kind", F.coalesce("component", "kind").alias("label")), "labels")
    border = to_core.join(labels.withColumnRenamed("kind", "y"), "y").join(core.withColumnRenamed("kind", "x"), "x", "left_anti").groupBy(F.col("x").alias("kind")).agg(F.min("label").alias("label"), F.max("label").alias("hi"))
    named = kinds.join(labels.unionByName(border.where("label = hi").select("kind", "label")), "kind", "left")
    named = materialize(named.select("key", "seq", "least_id", "n", "label"), "named")
    parts = named.where("label is not null").groupBy("key", "label").agg(F.min("least_id").alias("first"), F.sum("n").alias("n"))
    numbered = parts.withColumn("part", (F.row_number().over(W.partitionBy("key").orderBy("first")) - 1).cast("long"))
    held = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("held"))
    good = named.groupBy("key").agg(F.sum("n").alias("all")).join(held, "key").join(radius, "key").where((F.col("parts") >= 2) & (F.col("held") >= kept_share * F.col("all")) & (F.col("radius") < max_edits - 1))
    said = named.join(numbered.select("key", "label", "part"), ["key", "label"], "left").join(good.select("key", F.lit(True).alias("good")), "key", "left")
    said = said.select("key", "seq", F.when(F.col("good"), F.col("part")).otherwise(none).alias("part"))
    return rows.join(said, ["key", "seq"]).select(*back, "part")
