"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.session import staged

from .common import WORD

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(doc_id: Column, seed: int = SEED) -> Column:
    """The seeded order of a document within its source, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the repeating weights.  Targets share the total size by weight and
    stop at `max_epochs` times their source; what they give up goes to the others by weight until no target
    is above.  With sources ordered by cap over weight the clamped ones form a prefix, so one ordered pass
    over one row per source finds the fixed point of that redistribution.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sources.select("source", "source_size", rank.alias("rank"), weight.cast("double").alias("w"))
    rows = rows.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    )
    rows = rows.withColumn("level", level)
    fits = F.col("level") * F.col("w") <= F.col("cap")
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(everything)["level"])
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mixing_plan(sized: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target, `whole` repetitions of every document, and `last_key`.

    Documents whose draw key does not exceed `last_key` are taken once more; together they hold the fractional
    repetition to within half a document.  `sized` has doc_id, source, size.  The cut is found in two levels:
    totals per slice of the key space, then a running sum inside the one slice that holds the cut.
    """
    keyed = sized.select("source", "size", draw_key(F.col("doc_id"), seed).alias("key"))
    keyed = keyed.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    plan = targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    short = plan.select(F.col("source").alias("s"), "rest")
    slices = slices.join(short, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    cut = slices.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    cut = cut.select(F.col("source").alias("s"), F.col("slice").alias("t"), "before", "rest")
    inside = Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("t")))
    near = near.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    fits = (F.col("size") > 0) & (F.col("before") * 2 + F.col("size") <= F.col("rest") * 2)
    last = near.filter(fits).groupBy("source").agg(F.max("key").alias("key"))
    whole_slices = slices.filter(F.col("before") + F.col("n") <= F.col("rest")).groupBy("source")
    last = last.unionByName(whole_slices.agg(F.concat(F.max("slice"), F.lit("g")).alias("key")))
    last = last.groupBy(F.col("source").alias("s")).agg(F.max("key").alias("last_key"))
    # Where nothing is left to take, documents of no words are not taken once more either.
    last_key = F.when(F.col("rest") > 0, F.col("last_key"))
    return plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce(last_key, F.lit("")).alias("last_key")
    )


def with_repeats(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """`docs` with source_size, target and `repeats`: how often the mix holds the row (it may be 0)."""
    small = plan.select(
        F.col("source").alias("__source"), "source_size", "target", F.col("whole").alias("__whole"), F.col("last_key").alias("__last")
    )
    extra = (draw_key(F.col("doc_id"), seed) <= F.col("__last")).cast("long")
    rows = docs.join(small, F.col("source").eqNullSafe(F.col("__source")), "left")
    return rows.withColumn("repeats", F.col("__whole") + extra).drop("__source", "__whole", "__last")


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, `repeats`, `taken` (words, repeats counted).

    Size is the number of words; a null text has none and a null source is a source of its own.  A document
    is taken at most `max_epochs` times.  Rows with one id share one draw.  Only (id, source, size) is kept
    between the passes, and the per-source plan joins the rows without moving texts when it is small.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rows = with_repeats(sized, staged(mixing_plan(sized, seed, weights, max_epochs)), seed)
    return rows.withColumn("taken", F.col("size") * F.col("repeats"))


def mixed_documents(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: every row as often as it is taken, columns unchanged.

    The per-source plan is written first, so its size is known when the join is planned: a small one is broadcast
    and no text is shuffled by source.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    plan = staged(mixing_plan(sized, seed, weights, max_epochs)).select(
        F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("last_key").alias("__last")
    )
    extra = (draw_key(F.col("doc_id"), seed) <= F.col("__last")).cast("long")
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("__source")), "left")
    rows = rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), (F.col("__whole") + extra).cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
