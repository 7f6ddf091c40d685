"""Validation metrics over repeated responses per prompt: mean, best, worst and majority at n.

Input is long: (data_source, uid, var, value, pred, pos), `pos` being arrival order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import map_groups, scale_bucket, unit_hash, with_prefix_sum, with_rank

KEY = ["data_source", "uid", "var"]
CELLS = 4_000_000  # draws held at once
KEPT_CELLS, KEPT = 64_000, 200  # size of a draw that a task keeps for prompts of the same size, and how many


def to_long(df: DataFrame, variables: list[str], pred: str | None = "pred", pos: str = "sample_id") -> DataFrame:
    """Unpivot numeric variables; text variables carry no statistics and are left out."""
    numeric = [v for v in variables if dict(df.dtypes)[v] != "string"]
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("value")) for v in numeric]))
    return df.select(
        "data_source",
        "uid",
        F.col(pos).alias("pos"),
        (F.col(pred) if pred else F.lit(None).cast("string")).alias("pred"),
        pairs.alias("p"),
    ).select("data_source", "uid", "p.var", "p.value", "pred", "pos")


def sample_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, then n itself; nothing for a single response."""
    powers = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(1, 41)]), lambda p: p < n)
    return F.when(n > 1, F.concat(powers, F.array(n.cast("long")))).otherwise(F.array().cast("array<bigint>"))


def per_prompt_mean_std(long: DataFrame) -> DataFrame:
    agg = long.groupBy(*KEY).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    named = F.array(
        F.struct(F.concat(F.lit("mean@"), F.col("n")).alias("metric"), F.col("mean").alias("value")),
        F.struct(F.concat(F.lit("std@"), F.col("n")).alias("metric"), F.col("std").alias("value")),
    )
    return agg.select(*KEY, F.explode(F.filter(named, lambda s: (F.col("n") > 1) | s["metric"].startswith("mean"))).alias("m")).select(
        *KEY, "m.metric", "m.value"
    )


def best_worst_closed_form(long: DataFrame) -> DataFrame:
    """The value 1000 resampling rounds estimate: moments of the extreme of n draws with replacement.

    Works on value counts, so equal values collapse first; cumulative counts are built in two levels, by
    buckets that need no look at the data, and the per-size sums combine map-side.
    """
    counts = long.groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = with_prefix_sum(counts, scale_bucket(F.col("value")), [F.col("value")], F.col("c"), "before", KEY, total="n")
    rows = ranked.withColumn("k", F.explode(sample_sizes(F.col("n"))))
    low, high = F.col("before") / F.col("n"), (F.col("before") + F.col("c")) / F.col("n")
    p_best = F.pow(high, F.col("k")) - F.pow(low, F.col("k"))
    p_worst = F.pow(1 - low, F.col("k")) - F.pow(1 - high, F.col("k"))
    v = F.col("value")
    agg = rows.groupBy(*KEY, "k").agg(
        F.sum(v * p_best).alias("b1"),
        F.sum(v * v * p_best).alias("b2"),
        F.sum(v * p_worst).alias("w1"),
        F.sum(v * v * p_worst).alias("w2"),
    )

    def spread(first: str, second: str) -> Column:
        return F.sqrt(F.greatest(F.col(second) - F.col(first) * F.col(first), F.lit(0.0)))

    named = F.array(
        *[
            F.struct(F.concat(F.lit(f"{kind}@"), F.col("k"), F.lit(f"/{stat}")).alias("metric"), value.alias("value"))
            for kind, stat, value in (
                ("best", "mean", F.col("b1")),
                ("best", "std", spread("b1", "b2")),
                ("worst", "mean", F.col("w1")),
                ("worst", "std", spread("w1", "w2")),
            )
        ]
    )
    return agg.select(*KEY, F.explode(named).alias("m")).select(*KEY, "m.metric", "m.value")


def majority_value(long: DataFrame) -> DataFrame:
    """Value of the first response holding the most frequent prediction; the earliest prediction wins ties."""
    votes = long.groupBy(*KEY, "pred").agg(
        F.count(F.lit(1)).alias("c"), F.min("pos").alias("first_pos"), F.min_by("value", "pos").alias("value")
    )
    best = votes.groupBy(*KEY).agg(F.max(F.struct(F.col("c"), -F.col("first_pos"), F.col("value"))).alias("top"))
    return best.select(*KEY, F.col("top.value").alias("value"))


# --- resampling with the same seeded draws ----------------------------------------------------------------


def _majority_positions(codes: np.ndarray, kinds: int) -> np.ndarray:
    """Per row, the first position whose code is most frequent in the row."""
    rows = np.arange(len(codes))[:, None]
    counts = np.bincount((rows * kinds + codes).ravel(), minlength=len(codes) * kinds).reshape(len(codes), kinds)
    return counts[rows, codes].argmax(axis=1)


def _resampler(rounds: int, seed: int, with_majority: bool):
    kept: dict[tuple[int, int], np.ndarray] = {}

    def picks_of(n: int, k: int, step: int) -> Iterator[np.ndarray]:
        """The draws of k out of n, which depend on nothing else: small ones are kept for the next prompt."""
        if (n, k) in kept:
            yield kept[n, k]
            return
        draws = np.random.RandomState(seed)
        # The generator fills a large draw and its consecutive pieces alike.
        for at in range(0, rounds, step):
            picks = draws.choice(n, size=(min(step, rounds - at), k), replace=True)
            if picks.shape[0] == rounds and picks.size <= KEPT_CELLS and len(kept) < KEPT:
                kept[n, k] = picks
            yield picks

    def one_group(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate([p.column("value").to_numpy(zero_copy_only=False) for p in pieces]).astype("float64")
        sizes, k = [], 2
        while k < len(values):
            sizes.append(k)
            k *= 2
        if len(values) > 1:
            sizes.append(len(values))
        codes = np.zeros(0, dtype="int64")
        if with_majority:
            codes = pd.factorize(np.array([v for p in pieces for v in p.column("pred").to_pylist()], dtype=object))[0]
        kinds = int(codes.max(initial=0)) + 1
        metrics, stats = [], []
        for k in sizes:
            found: dict[str, list[np.ndarray]] = {}
            for picks in picks_of(len(values), k, max(1, CELLS // max(k, kinds))):
                drawn = values[picks]
                found.setdefault("best", []).append(drawn.max(axis=1))
                found.setdefault("worst", []).append(drawn.min(axis=1))
                if with_majority:
                    first = _majority_positions(codes[picks], kinds)
                    found.setdefault("maj", []).append(drawn[np.arange(len(drawn)), first])
            for kind, parts in found.items():
                stat = np.concatenate(parts)
                metrics += [f"{kind}@{k}/mean", f"{kind}@{k}/std"]
                stats += [stat.mean(), stat.std()]
        head = pieces[0].slice(0, 1)
        same = pa.array([0] * len(metrics), "int64")
        columns = [head.column(name).take(same) for name in KEY]
        # A statistic that is not a number leaves as null, as it does from a data frame.
        yield pa.RecordBatch.from_arrays([*columns, pa.array(metrics, "string"), pa.array(stats, "float64", from_pandas=True)], [*KEY, "metric", "value"])

    return one_group


def resampled_metrics(long: DataFrame, rounds: int = 1000, seed: int = 42, with_majority: bool = True) -> DataFrame:
    """best/worst/maj at n by seeded resampling, the same draws for a prompt of any size.

    The responses of one prompt and variable (value and prediction code) meet in one task, as the generator's
    stream demands; `best_worst_closed_form` and `majority_by_draws` are the forms that spread a prompt.
    """
    schema = ", ".join(f"{k} {long.schema[k].dataType.simpleString()}" for k in KEY)
    order = [F.col("pos").asc_nulls_last(), F.col("value"), F.col("pred")]
    rows = long.select(*KEY, "value", "pred", "pos")
    return map_groups(rows, KEY, order, _resampler(rounds, seed, with_majority), f"{schema}, metric string, value double")


def majority_by_draws(rows: DataFrame, rounds: int, seed: int) -> DataFrame:
    """maj at n with one row per draw: draws are spread by (round, draw), joined to the drawn response by rank."""
    ranked = with_rank(rows, F.floor(F.col("pos") / 65536), [F.col("pos")], "idx", KEY)
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    draws = (
        sizes.withColumn("k", F.explode(sample_sizes(F.col("n"))))
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        .repartition(*KEY, "k", "round")
        .withColumn("draw", F.explode(F.expr("sequence(0L, k - 1)")))
        .withColumn("idx", F.floor(unit_hash(seed, *KEY, "k", "round", "draw") * F.col("n")))
    )
    drawn = draws.join(ranked.select(*KEY, "idx", "value", "pred"), [*KEY, "idx"])
    votes = drawn.groupBy(*KEY, "k", "round", "pred").agg(
        F.count(F.lit(1)).alias("c"), F.min("draw").alias("first"), F.min_by("value", "draw").alias("value")
    )
    winner = votes.groupBy(*KEY, "k", "round").agg(F.max(F.struct(F.col("c"), -F.col("first"), F.col("value"))).alias("top"))
    stats = winner.groupBy(*KEY, "k").agg(F.avg("top.value").alias("mean"), F.stddev_pop("top.value").alias("std"))
    return stats.select(
        *KEY,
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("maj@"), F.col("k"), F.lit("/mean")).alias("metric"), F.col("mean").alias("value")),
                F.struct(F.concat(F.lit("maj@"), F.col("k"), F.lit("/std")).alias("metric"), F.col("std").alias("value")),
            )
        ).alias("m"),
    ).select(*KEY, "m.metric", "m.value")


# --- across prompts ------------------------------------------------------------------------------------------


def across_prompts(per_prompt: DataFrame) -> DataFrame:
    """Mean of each metric over the prompts that have it (a mean of means)."""
    return per_prompt.groupBy("data_source", "var", "metric").agg(F.avg("value").alias("value"))


def validation_metrics(long: DataFrame, exact: bool = False, rounds: int = 1000, seed: int = 42) -> DataFrame:
    extremes = resampled_metrics(long, rounds, seed) if exact else best_worst_closed_form(long)
    return across_prompts(per_prompt_mean_std(long).unionByName(extremes))


def sectioned(metrics: DataFrame) -> DataFrame:
    """Adds `section`: core when the variable is the source's core one and the metric is at the largest n."""
    at = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    per_var = metrics.groupBy("data_source", "var").agg(F.max(at).alias("n_max"))
    has_acc = metrics.groupBy("data_source").agg(F.max((F.col("var") == "acc").cast("int")).alias("has_acc"))
    rows = metrics.join(per_var, ["data_source", "var"]).join(has_acc, "data_source")
    core_var = F.when(F.col("has_acc") == 1, "acc").otherwise("reward")
    core = (
        (F.col("var") == core_var)
        & F.col("metric").rlike("^(mean|maj|best)")
        & F.col("metric").contains(F.concat(F.lit("@"), F.col("n_max")))
    )
    section = F.when(core, "val-core").otherwise("val-aux")
    return rows.select(
        F.concat_ws("/", section, "data_source", "var", "metric").alias("key"), F.col("value")
    )


def turn_stats(df: DataFrame) -> DataFrame:
    agg = df.agg(*[fn(F.col("num_turns").cast("double")).alias(n) for n, fn in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return agg.select(
        F.explode(
            F.array(*[F.struct(F.lit(f"val-aux/num_turns/{n}").alias("key"), F.col(n).alias("value")) for n in ("min", "max", "mean")])
        ).alias("m")
    ).select("m.key", "m.value")


def merge_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two validation results as one input; metrics are recomputed from the union."""
    return a.unionByName(b, allowMissingColumns=True)


def offline_eval(df: DataFrame, responses: str, score: Column) -> DataFrame:
    """Mean score of a row's responses, then the mean over rows per source; `score` sees column `response`."""
    one = df.select("data_source", "row_id", F.explode(responses).alias("response"), *[c for c in df.columns if c not in ("data_source", "row_id", responses)])
    per_row = one.withColumn("__s", score).groupBy("data_source", "row_id").agg(F.avg("__s").alias("s"))
    return per_row.groupBy("data_source").agg(F.avg("s").alias("test_score"))
