"""Advantage and return estimators over trajectories grouped by prompt.

Input rows carry `step`, `uid`, `sample_id`, `response_mask` and `token_level_rewards`; every estimator
adds the arrays `advantages` and `returns`.  Group statistics go through `with_group_stats`, so a prompt
with a large share of all samples is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import (
    asum,
    cumsum,
    discounted_with_reset,
    gae_scan,
    mask_count,
    masked_mean,
    masked_values,
    reverse_cumsum,
    spread,
    zmap,
)
from ..functions.kl import kl_token
from .grouping import (
    hash_bucket,
    sample_std,
    seeded_hash,
    unit_hash,
    with_group_stats,
)

GROUP = ["step", "uid"]
ROW = "sample_id"


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("seq_score", asum("token_level_rewards"))


def _laid(df: DataFrame, scalar: Column, drop: list[str]) -> DataFrame:
    return (
        df.withColumn("advantages", spread(scalar, "response_mask"))
        .withColumn("returns", F.col("advantages"))
        .drop("seq_score", *drop)
    )


def _moments(df: DataFrame) -> DataFrame:
    return with_group_stats(_scored(df), GROUP, ROW, moments={"g": F.col("seq_score")})


_G = ["g_n", "g_mean", "g_m2"]


def whiten(df: DataFrame, column: str, mask: str, keys: list[str], shift_mean: bool = True) -> DataFrame:
    """Normalise an array column by the masked mean and variance of its batch."""
    stats = with_group_stats(
        df, keys, ROW, moments={"w": F.col("element")}, elements=masked_values(column, mask)
    )
    n = F.coalesce(F.col("w_n"), F.lit(0))
    mean = F.col("w_mean") * n / (n + F.lit(1e-8))
    gap = F.col("w_mean") - mean
    var = (F.col("w_m2") + n * gap * gap) / (n + F.lit(1e-8)) * n / (n - 1)
    checked = F.when(n <= 1, F.raise_error(F.lit("whitening needs at least two valid tokens")).cast("double"))
    scaled = stats.withColumn("w_scale", checked.otherwise(1 / F.sqrt(var + F.lit(1e-8)))).withColumn("w_mu", mean)
    shifted = F.transform(
        column,
        lambda x: (x - F.col("w_mu")) * F.col("w_scale") + (F.lit(0.0) if shift_mean else F.col("w_mu")),
    )
    return scaled.withColumn(column, shifted).drop("w_n", "w_mean", "w_m2", "w_scale", "w_mu")


def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    out = df.withColumn(
        "advantages", gae_scan("token_level_rewards", "values", "response_mask", F.lit(gamma), F.lit(lam))
    ).withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
    return whiten(out, "advantages", "response_mask", ["step"])


def grpo(df: DataFrame, epsilon: float = 1e-6, norm_by_std: bool = True) -> DataFrame:
    single = F.col("g_n") == 1
    centred = F.col("seq_score") - F.when(single, 0.0).otherwise(F.col("g_mean"))
    std = F.when(single, 1.0).otherwise(sample_std("g"))
    return _laid(_moments(df), centred / (std + F.lit(epsilon)) if norm_by_std else centred, _G)


def grpo_vectorized(df: DataFrame, epsilon: float = 1e-6, norm_by_std: bool = True) -> DataFrame:
    single = F.col("g_n") == 1
    centred = F.col("seq_score") - F.when(single, 0.0).otherwise(F.col("g_mean"))
    var = F.col("g_m2") / F.greatest(F.col("g_n") - 1, F.lit(1))
    std = F.when(single, 1.0).otherwise(F.sqrt(F.greatest(var, F.lit(1e-6))))
    return _laid(_moments(df), centred / (std + F.lit(epsilon)) if norm_by_std else centred, _G)


def grpo_passk(
    df: DataFrame, epsilon: float = 1e-6, norm_by_std: bool = True, single: str = "error"
) -> DataFrame:
    """Only the best row of a group is credited, with its lead over the second best.

    A group of one has no lead: an error, or with `single="zero"` an advantage of zero.
    """
    key = F.struct(F.col("seq_score"), -F.xxhash64(ROW), F.col(ROW))
    ranked = with_group_stats(
        _scored(df), GROUP, ROW, tops={"g_best": key}, moments={"g": F.col("seq_score")}
    ).withColumn("is_best", key == F.col("g_best"))
    lead = F.col("seq_score") - F.col("g_best_next.seq_score")
    lead = lead / (sample_std("g") + F.lit(epsilon)) if norm_by_std else lead
    alone = F.raise_error(F.lit("pass@k needs at least two samples per group")).cast("double")
    scalar = F.when(F.col("g_n") < 2, F.lit(0.0) if single == "zero" else alone).otherwise(F.when(F.col("is_best"), lead).otherwise(0.0))
    return _laid(ranked, scalar, [*_G, "g_best", "g_best_next", "is_best"])


def reinforce_plus_plus_baseline(df: DataFrame) -> DataFrame:
    centred = F.col("seq_score") - F.when(F.col("g_n") == 1, 0.0).otherwise(F.col("g_mean"))
    tiled = _moments(df).withColumn("advantages", spread(centred, "response_mask")).drop("seq_score", *_G)
    out = whiten(tiled, "advantages", "response_mask", ["step"])
    out = out.withColumn("advantages", zmap(["advantages", "response_mask"], lambda t: t["advantages"] * t["response_mask"]))
    return out.withColumn("returns", F.col("advantages"))


def rloo(df: DataFrame) -> DataFrame:
    """Leave-one-out baseline; a lone sample keeps its raw score."""
    n = F.col("g_n")
    scalar = F.when(n > 1, (F.col("seq_score") - F.col("g_mean")) * n / (n - 1)).otherwise(F.col("seq_score"))
    return _laid(_moments(df), scalar, _G)


def rloo_vectorized(df: DataFrame) -> DataFrame:
    """Leave-one-out baseline; a lone sample gets zero."""
    n = F.col("g_n")
    scalar = F.when(n > 1, (F.col("seq_score") - F.col("g_mean")) * n / (n - 1)).otherwise(F.lit(0.0))
    return _laid(_moments(df), scalar, _G)


def opo(df: DataFrame) -> DataFrame:
    """Length-weighted group mean as the baseline; lengths count valid tokens."""
    rows = _scored(df).withColumn("seq_len", mask_count("response_mask"))
    rows = with_group_stats(
        rows,
        GROUP,
        ROW,
        sums={
            "g_rows": F.lit(1),
            "g_len": F.col("seq_len"),
            "g_wscore": F.col("seq_len") * F.col("seq_score"),
        },
    )
    base = F.when(F.col("g_rows") == 1, 0.0).otherwise(F.try_divide("g_wscore", "g_len"))
    return _laid(rows, F.col("seq_score") - base, ["seq_len", "g_rows", "g_len", "g_wscore"])


def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    out = df.withColumn("returns", discounted_with_reset("token_level_rewards", "response_mask", F.lit(gamma)))
    out = whiten(out.withColumn("advantages", F.col("returns")), "advantages", "response_mask", ["step"])
    return out.withColumn(
        "advantages", zmap(["advantages", "response_mask"], lambda t: t["advantages"] * t["response_mask"])
    )


def remax(df: DataFrame) -> DataFrame:
    masked = F.zip_with("token_level_rewards", "response_mask", lambda r, m: r * m)
    out = df.withColumn("returns", reverse_cumsum(masked))
    return out.withColumn(
        "advantages",
        zmap(["returns", "response_mask"], lambda t: t["returns"] - F.col("reward_baseline") * t["response_mask"]),
    )


def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """The scale is batch size over the number of non-zero scores, whatever the caller passes."""
    rows = with_group_stats(
        _moments(df),
        ["step"],
        ROW,
        sums={"b_rows": F.lit(1), "b_nonzero": (F.col("seq_score") != 0).cast("int")},
    )
    alpha = F.col("b_rows") / F.greatest(F.col("b_nonzero"), F.lit(1))
    centred = F.col("seq_score") - F.when(F.col("g_n") == 1, 0.0).otherwise(F.col("g_mean"))
    return _laid(rows, alpha * centred / F.lit(f_norm), [*_G, "b_rows", "b_nonzero"])


def _path_weight(df: DataFrame, is_weights: str | None) -> DataFrame:
    names = ["old_log_probs", "sum_pi_squared", "response_mask"] + ([is_weights] if is_weights else [])

    def weight(t):
        w = 1 - 2 * F.exp(t["old_log_probs"]) + t["sum_pi_squared"]
        if is_weights:
            w = w * t[is_weights] * t[is_weights]
        return w * t["response_mask"]

    return df.withColumn("__w", zmap(names, weight)).withColumn("__w", cumsum("__w"))


def _position_baseline(df: DataFrame, zero_tail: bool, epsilon: float) -> DataFrame:
    """Baseline per (prompt, position) from `__g` (return), `__w` (path weight), `__m` (valid), `__len`.

    Tokens are exploded next to their row and combined map-side per (step, uid, pos); only the sums move.
    The baseline of a prompt is re-collected to an array no longer than a response and meets the rows together with
    the counts of the group, in one join.
    """
    tokens = df.select(
        *GROUP, F.posexplode(F.arrays_zip("__g", "__w", "__m")).alias("pos", "t")
    )
    per_pos = tokens.groupBy(*GROUP, "pos").agg(
        F.sum(F.col("t.__g") * F.col("t.__w") * F.col("t.__m")).alias("num"),
        F.sum(F.col("t.__w") * F.col("t.__m")).alias("den"),
    )
    baseline = per_pos.groupBy(*GROUP).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", (F.col("num") / (F.col("den") + F.lit(epsilon))).alias("b")))),
            lambda s: s["b"],
        ).alias("__b")
    )
    counted = F.when(F.col("__len") >= F.col("__min_len"), 1)
    longest = F.struct(F.col("__len"), F.xxhash64(ROW), F.col(ROW))
    rows = with_group_stats(
        df, GROUP, ROW, sums={"__rows": counted}, tops={"__max": longest} if zero_tail else None, table=baseline
    )
    cut = F.lit(None).cast("int")
    if zero_tail:
        second = F.col("__max_next.__len")
        cut = F.when((longest == F.col("__max")) & (F.col("__len") > second), second)
    rows = rows.withColumn("__cut", cut)
    return rows.withColumn(
        "__b",
        F.transform(
            "__g",
            lambda _, i: F.when(F.coalesce(F.col("__rows"), F.lit(0)) <= 1, 0.0)
            .when(F.col("__cut").isNotNull() & (i >= F.col("__cut")), 0.0)
            .otherwise(F.get(F.col("__b"), i)),
        ),
    )


_OTB = ["__g", "__w", "__m", "__len", "__min_len", "__rows", "__max", "__max_next", "__cut", "__b"]


def optimal_token_baseline(
    df: DataFrame, is_weights: str | None = None, zero_tail: bool = False, epsilon: float = 1e-8
) -> DataFrame:
    masked = F.zip_with("token_level_rewards", "response_mask", lambda r, m: r * m)
    rows = _path_weight(df.withColumn("returns", reverse_cumsum(masked)), is_weights)
    rows = (
        rows.withColumn("__g", F.col("returns"))
        .withColumn("__m", F.col("response_mask"))
        .withColumn("__len", mask_count("response_mask"))
        .withColumn("__min_len", F.lit(0))
    )
    rows = _position_baseline(rows, zero_tail, epsilon)
    return rows.withColumn(
        "advantages", zmap(["__g", "__b", "__m"], lambda t: (t["__g"] - t["__b"]) * t["__m"])
    ).drop(*_OTB)


def tir_optimal_token_baseline(
    df: DataFrame, is_weights: str | None = None, zero_tail: bool = True, epsilon: float = 1e-8
) -> DataFrame:
    """Positions are ranks among the valid tokens of a row; rows without one take no part in a group."""
    masked = F.zip_with("token_level_rewards", "response_mask", lambda r, m: r * m)
    rows = _path_weight(df.withColumn("returns", reverse_cumsum(masked)), is_weights)
    rows = (
        rows.withColumn("__len", mask_count("response_mask"))
        .withColumn("__g", masked_values("returns", "response_mask"))
        .withColumn("__w", masked_values("__w", "response_mask"))
        .withColumn("__m", F.transform("__g", lambda _: F.lit(1)))
        .withColumn("__min_len", F.lit(1))
    )
    rows = _position_baseline(rows, zero_tail, epsilon)
    rows = rows.withColumn("__g", F.zip_with("__g", "__b", lambda g, b: g - b)).withColumn(
        "__w", cumsum("response_mask")
    )
    return rows.withColumn(
        "advantages",
        zmap(
            ["response_mask", "__w"],
            lambda t: F.when(t["response_mask"] > 0, F.get(F.col("__g"), t["__w"].cast("int") - 1)).otherwise(0.0),
        ),
    ).drop(*_OTB)


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "gae": gae,
    "grpo": grpo,
    "grpo_vectorized": grpo_vectorized,
    "grpo_passk": grpo_passk,
    "reinforce_plus_plus_baseline": reinforce_plus_plus_baseline,
    "rloo": rloo,
    "rloo_vectorized": rloo_vectorized,
    "opo": opo,
    "reinforce_plus_plus": reinforce_plus_plus,
    "remax": remax,
    "gpg": gpg,
    "optimal_token_baseline": optimal_token_baseline,
    "tir_optimal_token_baseline": tir_optimal_token_baseline,
}


def register_estimator(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a user estimator; a different function under a taken name is an error."""
    if ESTIMATORS.get(name, fn) is not fn:
        raise ValueError(f"estimator already registered: {name}")
    ESTIMATORS[name] = fn


def advantage(df: DataFrame, estimator: str, **options) -> DataFrame:
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown advantage estimator: {estimator}")
    return ESTIMATORS[estimator](df, **options)


# --- rewards with divergence ------------------------------------------------------------------------


def rewards_minus_kl(df: DataFrame, kl_ratio: float) -> DataFrame:
    """Scores minus a constant times the old-to-reference log-ratio."""
    return df.withColumn(
        "token_level_rewards",
        zmap(
            ["token_level_scores", "old_log_probs", "ref_log_prob"],
            lambda t: t["token_level_scores"] - (t["old_log_probs"] - t["ref_log_prob"]) * kl_ratio,
        ),
    )


def apply_kl_penalty(df: DataFrame, beta: Column | float, kind: str = "kl") -> DataFrame:
    """Adds `token_level_rewards` and the row's masked mean divergence `seq_kl`."""
    beta = beta if isinstance(beta, Column) else F.lit(beta)
    return (
        df.withColumn(
            "kld",
            zmap(
                ["old_log_probs", "ref_log_prob", "response_mask"],
                lambda t: kl_token(t["old_log_probs"], t["ref_log_prob"], kind) * t["response_mask"],
            ),
        )
        .withColumn("seq_kl", masked_mean("kld", "response_mask"))
        .withColumn("token_level_rewards", F.zip_with("token_level_scores", "kld", lambda s, k: s - beta * k))
    )


def current_kl(df: DataFrame) -> DataFrame:
    return df.groupBy("step").agg(F.avg("seq_kl").alias("current_kl"), F.count(F.lit(1)).alias("batch_size"))


def adaptive_kl_coefficients(
    per_step: DataFrame, init: float, target: float, horizon: float, keys: list[str] | None = None
) -> DataFrame:
    """Coefficient in force at each step and after it.

    The coefficient is the running product of the multipliers of the steps, whatever their signs: magnitudes
    add up as logarithms, negative multipliers are counted, and a zero keeps it at zero from there on.  One
    row per step of a run.
    """
    run = keys or []
    error = F.least(F.greatest(F.col("current_kl") / F.lit(target) - 1, F.lit(-0.2)), F.lit(0.2))
    rows = per_step.withColumn("__factor", 1 + error * F.col("batch_size") / F.lit(horizon))

    def product(last: int) -> Column:
        span = Window.partitionBy(*run).orderBy("step").rowsBetween(Window.unboundedPreceding, last)
        factor = F.col("__factor")
        size = F.exp(F.coalesce(F.sum(F.when(factor != 0, F.log(F.abs(factor)))).over(span), F.lit(0.0)))
        turns = F.coalesce(F.sum((factor < 0).cast("int")).over(span), F.lit(0))
        zeros = F.coalesce(F.sum((factor == 0).cast("int")).over(span), F.lit(0))
        return F.lit(init) * F.when(zeros > 0, 0.0).otherwise(size) * F.when(turns % 2 == 1, -1).otherwise(1)

    return rows.withColumn("kl_coef_after", product(0)).withColumn("kl_coef", product(-1)).drop("__factor")


# --- resampling by score ------------------------------------------------------------------------------


def resample_weights(df: DataFrame, method: str = "pow", weight_pow: float = 2.0) -> DataFrame:
    rows = df.withColumn("seq_score", asum("token_level_scores"))
    if method == "pow":
        rows, weight = rows, F.pow(F.abs("seq_score"), F.lit(weight_pow))
    elif method in ("max_min", "max_random"):
        rows = with_group_stats(
            rows, ["step"], ROW, maxs={"__hi": F.col("seq_score")}, mins={"__lo": F.col("seq_score")}
        )
        top = F.col("seq_score") == F.col("__hi")
        if method == "max_min":
            weight = F.when(top | (F.col("seq_score") == F.col("__lo")), 1.0).otherwise(0.0)
        else:
            weight = F.when(top, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unsupported reweighting: {method}")
    return rows.withColumn("weight", F.greatest(weight + F.lit(1e-8), F.lit(1e-8))).drop("__hi", "__lo")


def resample(df: DataFrame, seed: int = 0, method: str = "pow", weight_pow: float = 2.0) -> DataFrame:
    """Draw as many rows per step as it has, with replacement, with probability proportional to weight.

    Returns (step, draw_id, sample_id).  Each row owns an interval of [0, 1) and each draw is a point;
    both are cut into 65,536 slices per step, the owner of a point is the last interval start before it,
    and a table with one row per slice carries the owner over slice borders.
    """
    rows = resample_weights(df, method, weight_pow).select("step", ROW, "weight")
    order = seeded_hash(seed, ROW)
    slices = rows.withColumn("__h", order).withColumn("__slice", hash_bucket(F.col("__h")))
    inside = Window.partitionBy("step", "__slice").orderBy("__h", ROW).rowsBetween(Window.unboundedPreceding, -1)
    totals = slices.groupBy("step", "__slice").agg(F.sum("weight").alias("__sum"))
    run = Window.partitionBy("step").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "step",
        "__slice",
        F.coalesce(F.sum("__sum").over(run), F.lit(0.0)).alias("__before"),
        F.sum("__sum").over(Window.partitionBy("step")).alias("__total"),
    )
    starts = (
        slices.withColumn("__inside", F.coalesce(F.sum("weight").over(inside), F.lit(0.0)))
        .join(totals, ["step", "__slice"])
        .select("step", ((F.col("__before") + F.col("__inside")) / F.col("__total")).alias("x"), F.col(ROW).alias("owner"))
    )
    draws = rows.select("step", unit_hash(seed + 1, ROW).alias("x"), F.col(ROW).alias("draw_id"))
    none = F.lit(None).cast("long")
    points = (
        starts.select("step", "x", "owner", none.alias("draw_id"))
        .unionByName(draws.select("step", "x", none.alias("owner"), "draw_id"))
        .withColumn("__cell", F.least(F.floor(F.col("x") * 65536), F.lit(65535)))
    )
    in_cell = (
        Window.partitionBy("step", "__cell")
        .orderBy("x", F.col("draw_id").isNotNull(), F.coalesce("owner", "draw_id"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    owned = points.withColumn("__own", F.last("owner", ignorenulls=True).over(in_cell))
    last = points.groupBy("step", "__cell").agg(
        F.max(F.when(F.col("owner").isNotNull(), F.struct("x", "owner"))).alias("__last")
    )
    carried = last.select(
        "step",
        "__cell",
        F.last("__last", ignorenulls=True)
        .over(Window.partitionBy("step").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
        .alias("__carry"),
    )
    return (
        owned.filter(F.col("draw_id").isNotNull())
        .join(carried, ["step", "__cell"])
        .select("step", "draw_id", F.coalesce("__own", F.col("__carry.owner")).alias(ROW))
    )


# --- response masks --------------------------------------------------------------------------------------


def response_mask_from_attention(attention_mask: Column, response_len: Column) -> Column:
    """The attention mask over the last `response_len` positions."""
    return F.slice(attention_mask, F.size(attention_mask) - response_len + 1, response_len)


def response_mask_from_eos(ids: Column, eos: list[int]) -> Column:
    """Ones up to and including the first end token."""
    first = F.array_min(
        F.filter(
            F.transform(ids, lambda x, i: F.when(x.isin(eos), i)),
            lambda i: i.isNotNull(),
        )
    )
    return F.transform(ids, lambda _, i: F.when(first.isNull() | (i <= first), 1).otherwise(0))


def group_summary(df: DataFrame, key: str = "uid", score: str = "score") -> DataFrame:
    """Mean, floored sample deviation and count per group; a lone row reports mean 0 and deviation 1."""
    agg = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.var_samp(score).alias("var")
    )
    single = F.col("n") == 1
    return agg.select(
        key,
        F.when(single, 0.0).otherwise(F.col("mean")).alias("mean"),
        F.when(single, 1.0).otherwise(F.sqrt(F.greatest("var", F.lit(1e-6)))).alias("std"),
        "n",
    )
