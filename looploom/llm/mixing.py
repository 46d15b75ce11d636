"""Temperature mixing of sources to target weights, realised as budgeted block permutations. DataFrame operations only.

Source token shares are raised to an exponent between 1 (natural shares) and 0 (equal weights). The exponent is bisected until the weights'
entropy meets a target or no source is repeated more often than a limit allows. A source's documents fall into blocks of about
``block_tokens`` by hash; an epoch runs through the blocks in an order of its own, and the last epoch of a source ends where its token budget
does. Which documents that last epoch holds follows from two thresholds a source (a block's rank value and, inside the block in which the
budget ends, a document's), so texts are neither shuffled nor sorted, whatever a source's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from looploom.llm.text import n_words, table
from looploom.tables import materialize

#: Defaults of the query: target entropy as a share of that of equal weights, and most epochs of a source.
ENTROPY_SHARE, MAX_EPOCHS, BLOCK_TOKENS, SEED = 0.97, 4.0, 1 << 18, 7
#: Exponents are multiples of 2**-30, found six bits at a time.
EXPONENT_BITS, BITS_A_ROUND = 30, 6
#: Up to so many sources (some 100 bytes each) their plan is broadcast; more are joined by source.
BROADCAST_SOURCES = 100_000
#: A source's ranks are first summed in 2**STRETCH_BITS stretches.
STRETCH_BITS = 12


def _hash(*parts: Column) -> Column:
    """A fixed 60-bit value of the parts, from MD5, for orders and blocks."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _log_sums(x: Column, exponents: list[float]) -> list[Column]:
    return [f(F.exp(F.lit(a) * x) * w).alias(f"{n}{k}") for k, a in enumerate(exponents) for n, f, w in (("z", F.sum, F.lit(1.0)), ("u", F.sum, x))]


def temperature(sources: DataFrame, budget: float | None, entropy_share: float | None, max_epochs: float | None) -> tuple[float, float]:
    """(exponent, budget) for a table of sources (``tokens`` > 0): the largest exponent whose weights have at least the target entropy,
    or, where that repeats a source too often, the smallest that does not. Without a target the exponent is 1.

    The budget is capped at ``max_epochs`` times all tokens. Sums over the table are aggregates; nothing is collected but sums.
    """
    n, total, largest, least = sources.agg(F.count("*"), F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not n:
        return 1.0, 0.0
    budget = float(total if budget is None else budget)
    budget = min(budget, max_epochs * total) if max_epochs else budget
    x = F.log(F.col("tokens") / F.lit(float(largest)))
    goal, x_least = (entropy_share or 0.0) * math.log(n), math.log(least / largest)

    def rising(meets) -> int:
        """The largest k with meets at k * 2**-30, for a condition that holds up to some k (k = 0 is taken to hold)."""
        low, width = 0, 1 << EXPONENT_BITS
        while width > 1:
            step = max(1, width >> BITS_A_ROUND)
            ks = [low + step * i for i in range(1, width // step + 1)]
            sums = sources.agg(*_log_sums(x, [k / (1 << EXPONENT_BITS) for k in ks])).first()
            good = [k for i, k in enumerate(ks) if meets(k / (1 << EXPONENT_BITS), sums[f"z{i}"], sums[f"u{i}"])]
            if good and good[-1] == low + width:
                return low + width
            low, width = (good[-1] if good else low), step
        return low

    top = 1 << EXPONENT_BITS
    k = rising(lambda a, z, u: math.log(z) - a * u / z >= goal) if goal else top
    if max_epochs:
        # the smallest source is repeated most: budget * weight / tokens, which falls as the exponent rises
        repeats = lambda a, z: budget * math.exp(a * x_least) / z / least
        z = sources.agg(*_log_sums(x, [k / top])).first()["z0"]
        if repeats(k / top, z) > max_epochs * (1 + 1e-9):
            k = min(top, rising(lambda a, z, u: repeats(a, z) > max_epochs * (1 + 1e-9)) + 1)
    return k / top, budget


def _ends(parts: DataFrame, *order: str) -> DataFrame:
    """Of each ``src``, the first of its ``parts`` (``t`` tokens each, in this order) that does not fit whole in ``left`` tokens, with
    ``left`` less by what stands before it. No row for a source whose parts all fit."""
    w = W.partitionBy("src").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    over = parts.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0))).where("before <= left and before + t > left")
    return over.withColumn("left", F.col("left") - F.col("before")).drop("before")


def mix_sources(docs: DataFrame, columns: list[str] | None = None, budget: float | None = None, entropy_share: float | None = ENTROPY_SHARE, max_epochs: float | None = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``docs`` (its ``columns``, or all) repeated or left out so that sources have target weights, with ``epoch``, ``block``, ``place``,
    ``n_tokens``, ``exponent`` and ``weight``: one row for each time that a document is read.

    ``n_tokens`` is the number of words. ``budget`` is the sum of tokens to draw (default: as many as there are). Reading a source's rows by
    (``epoch``, ``place``) gives its block permutations. The last epoch of a source takes documents in that order while they fit its
    budget. A null source is a source; null and empty texts have no tokens and go with the documents of their block; a source without tokens
    has weight 0 and is left out; equal rows share a place and are kept or left out together, as do all rows without a doc_id of a source;
    very long texts are counted whole and may exceed a block; an empty table gives an empty one. Columns of ``docs`` named like a new one
    are replaced. ``docs`` needs doc_id, text and source.
    """
    new = ["epoch", "block", "place", "n_tokens", "exponent", "weight"]
    carry = [c for c in (columns or docs.columns) if c not in new]
    sized = [F.to_json(F.struct(F.col("source").cast("string").alias("source"))).alias("src"), n_words(F.col("text")).alias("n_tokens"), _hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h")]
    rows = materialize(docs.select(*sized), "sized")
    sources = materialize(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    exponent, budget = temperature(sources, budget, entropy_share, max_epochs)
    largest, n_sources = sources.agg(F.max("tokens"), F.count("*")).first()
    small = n_sources <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)
    power = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(largest or 1))))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    plan = sources.withColumn("weight", power / F.lit(z)).withColumn("want", F.col("weight") * F.lit(budget))
    plan = plan.withColumns({"whole": F.floor(F.col("want") / F.col("tokens") + 1e-12).cast("int"), "n_blocks": F.ceil(F.col("tokens") / block_tokens).cast("long")})
    plan = materialize(plan.withColumn("rest", F.greatest(F.col("want") - F.col("whole") * F.col("tokens"), F.lit(0.0))), "plan")

    def rank(epoch: Column, block: Column) -> Column:
        return _hash(F.lit(seed), F.col("src"), epoch, block)

    placed = rows.join(hint(plan), "src").withColumn("block", F.col("h") % F.col("n_blocks"))
    placed = placed.withColumn("rank", rank(F.col("whole"), F.col("block")))
    blocks = materialize(placed.groupBy("src", "block", "rank", "rest").agg(F.sum("n_tokens").alias("t")), "blocks")
    # the stretch of ranks in which the budget ends, then the block in that stretch: a source's blocks are never ordered in one task
    stretch = (F.col("rank") / F.lit(float(1 << 60 - STRETCH_BITS))).cast("int").alias("stretch")
    wide = _ends(blocks.groupBy("src", stretch, F.col("rest").alias("left")).agg(F.sum("t").alias("t")), "stretch").select("src", "stretch", "left")
    inner = blocks.select("src", "block", "rank", "t", stretch).join(wide, ["src", "stretch"])
    cut = _ends(inner, "rank", "block").select("src", F.col("rank").alias("cut_rank"), F.col("block").alias("cut_block"), "left")
    cut = materialize(cut, "cuts")
    inside = placed.join(hint(cut), "src").where("block = cut_block").groupBy("src", "h", "left").agg(F.sum("n_tokens").alias("t"))
    last = W.partitionBy("src").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = inside.withColumn("upto", F.sum("t").over(last)).where("upto > left").groupBy("src").agg(F.min("h").alias("cut_h"))
    plan = materialize(plan.join(cut, "src", "left").join(ends, "src", "left"), "plan")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), *sized)  # read again: texts stand in no table of this operator
    placed = whole.join(hint(plan), "src").withColumn("block", F.col("h") % F.col("n_blocks")).withColumn("rank", rank(F.col("whole"), F.col("block")))
    before_cut = F.when(F.col("cut_block").isNull(), F.col("rest") > 0).otherwise((F.struct("rank", "block") < F.struct("cut_rank", "cut_block")) | (F.col("block") == F.col("cut_block")) & (F.col("h") < F.coalesce("cut_h", F.lit(1 << 60))))
    times = F.col("whole") + F.when(before_cut, 1).otherwise(0)
    drawn = placed.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return drawn.select("doc.*", "epoch", "block", rank(F.col("epoch"), F.col("block")).alias("place"), "n_tokens", F.lit(exponent).alias("exponent"), "weight")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document under the default targets; see :func:`mix_sources`."""
    return mix_sources(table(spark, sf_dir, "documents"), ["doc_id", "source"])
