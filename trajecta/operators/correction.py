"""Importance weights, rejection masks and off-policy diagnostics between two logged policies.

Everything per token or per sequence is a narrow row expression; step metrics are one grouped aggregation
whose partial results are combined before the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import EPS, asum, clamp, mask_count, masked_extreme, masked_mean, masked_sum, zmap
from .grouping import with_group_stats

SAFETY = 20.0
OPTIONS = (
    "token_k1",
    "token_k2",
    "token_k3",
    "seq_sum_k1",
    "seq_sum_k2",
    "seq_sum_k3",
    "seq_mean_k1",
    "seq_mean_k2",
    "seq_mean_k3",
    "seq_max_k2",
    "seq_max_k3",
)


@dataclass(frozen=True)
class Threshold:
    option: str
    lower: float | None
    upper: float


def parse_options(options: str, spec: str | float | None) -> list[Threshold]:
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    if not names:
        raise ValueError("no rejection option given")
    for name in names:
        if name not in OPTIONS:
            raise ValueError(f"unknown rejection option: {name}")
    if spec is None:
        raise ValueError("rejection needs a threshold")
    if isinstance(spec, bool) or not isinstance(spec, (int, float, str)):
        raise TypeError("threshold must be text or a number")
    parts = [p.strip() for p in str(spec).split(",") if p.strip()]
    if len(parts) == 1:
        parts = parts * len(names)
    if len(parts) != len(names):
        raise ValueError("give one threshold for all options or one for each")
    return [_threshold(n, p) for n, p in zip(names, parts)]


def _threshold(option: str, text: str) -> Threshold:
    pieces = text.split("_", 1)
    two_sided = option.endswith("k1")
    if len(pieces) == 2 and not two_sided:
        raise ValueError(f"{option} takes a single upper bound, got {text}")
    try:
        bounds = [float(p) for p in pieces]
    except ValueError as exc:
        raise ValueError(f"not a threshold for {option}: {text}") from exc
    if min(bounds) <= 0:
        raise ValueError(f"thresholds must be positive: {text}")
    if not two_sided:
        return Threshold(option, None, bounds[0])
    return Threshold(option, *(bounds if len(bounds) == 2 else (1 / bounds[0], bounds[0])))


def with_log_ratio(df: DataFrame, new: str = "old_log_probs", behaviour: str = "rollout_log_probs") -> DataFrame:
    """Adds `log_ratio`; arrays of different lengths in a row are an error."""
    sizes = (F.size(new) == F.size(behaviour)) & (F.size(new) == F.size("response_mask"))
    ratio = F.zip_with(new, behaviour, lambda a, b: a - b)
    return df.withColumn(
        "log_ratio",
        F.when(sizes, ratio).otherwise(
            F.raise_error(F.lit("log-probabilities and mask differ in length")).cast("array<double>")
        ),
    )


# --- importance weights ----------------------------------------------------------------------------------


def importance_weights(
    df: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """Adds `is_weights_raw` (clamped, masked) and `rollout_is_weights` (truncated, optionally mean one)."""
    keys = keys or ["step"]
    if level == "token":
        raw = zmap(["log_ratio", "response_mask"], lambda t: F.exp(clamp(t["log_ratio"], -SAFETY, SAFETY)) * t["response_mask"])
    elif level == "sequence":
        df = df.withColumn("__seq", masked_sum("log_ratio", "response_mask"))
        raw = F.transform("response_mask", lambda m: F.exp(clamp(F.col("__seq"), -SAFETY, SAFETY)) * m)
    else:
        raise ValueError(f"unsupported weight level: {level}")
    rows = df.withColumn("is_weights_raw", raw).withColumn(
        "rollout_is_weights", F.transform("is_weights_raw", lambda w: F.least(w, F.lit(float(threshold))))
    )
    if not normalize:
        return rows.drop("__seq")
    n = mask_count("response_mask")
    if level == "token":
        sums = {"__num": masked_sum("rollout_is_weights", "response_mask"), "__den": n}
        mean = F.col("__num") / (F.col("__den") + F.lit(EPS))
    else:
        sums = {
            "__num": F.when(n > 0, masked_mean("rollout_is_weights", "response_mask")).otherwise(0.0),
            "__den": (n > 0).cast("int"),
        }
        mean = F.col("__num") / F.greatest(F.col("__den"), F.lit(EPS))
    rows = with_group_stats(rows, keys, "sample_id", sums=sums)
    rows = rows.withColumn("is_norm_factor", F.when(mean > EPS, mean).otherwise(1.0))
    return rows.withColumn(
        "rollout_is_weights", F.transform("rollout_is_weights", lambda w: w / F.col("is_norm_factor"))
    ).drop("__seq", "__num", "__den")


def _std_from(sum_sq: Column, total: Column, n: Column) -> Column:
    mean = total / (n + F.lit(EPS))
    return F.when(n > 1, F.sqrt(F.greatest(sum_sq / (n + F.lit(EPS)) - mean * mean, F.lit(0.0)))).otherwise(0.0)


def importance_metrics(df: DataFrame, level: str, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Per-step statistics of `is_weights_raw`; needs `log_ratio` and `response_mask`."""
    keys = keys or ["step"]
    low, up = 1.0 / threshold, float(threshold)
    m, w = "response_mask", "is_weights_raw"
    rows = df.withColumn("__clamped", F.transform(w, lambda x: clamp(x, low, up)))
    rows = rows.select(
        *keys,
        mask_count(m).alias("n"),
        masked_sum(w, m).alias("sw"),
        masked_sum("__clamped", m).alias("sc"),
        asum(zmap(["__clamped", m], lambda t: t["__clamped"] * t["__clamped"] * t[m])).alias("scc"),
        asum(zmap([w, m], lambda t: (t[w] > up).cast("int") * t[m])).alias("high"),
        asum(zmap([w, m], lambda t: (t[w] < low).cast("int") * t[m])).alias("low"),
        masked_extreme(w, m, True).alias("wmax"),
        masked_extreme(w, m, False).alias("wmin"),
        masked_mean(w, m).alias("sm"),
        masked_sum("log_ratio", m).alias("lr"),
    )
    n = F.sum("n")
    mean_c = F.sum("sc") / (n + F.lit(EPS))
    ess = 1 / (F.sum("scc") / ((mean_c + F.lit(EPS)) * (mean_c + F.lit(EPS))) / (n + F.lit(EPS)))
    if level == "sequence":
        hi, lo = F.avg((F.col("lr") > math.log(up)).cast("int")), F.avg((F.col("lr") < math.log(low)).cast("int"))
        top, bottom = F.exp(F.least(F.max("lr"), F.lit(SAFETY))), F.exp(F.min("lr"))
    else:
        hi, lo = F.sum("high") / (n + F.lit(EPS)), F.sum("low") / (n + F.lit(EPS))
        top, bottom = F.max("wmax"), F.min("wmin")
    return rows.groupBy(*keys).agg(
        (F.sum("sw") / (n + F.lit(EPS))).alias("rollout_is_mean"),
        _std_from(F.sum("scc"), F.sum("sc"), n).alias("rollout_is_std"),
        top.alias("rollout_is_max"),
        bottom.alias("rollout_is_min"),
        hi.alias("rollout_is_ratio_fraction_high"),
        lo.alias("rollout_is_ratio_fraction_low"),
        ess.alias("rollout_is_eff_sample_size"),
        F.avg("sm").alias("rollout_is_seq_mean"),
        F.coalesce(F.stddev_samp("sm"), F.lit(0.0)).alias("rollout_is_seq_std"),
        F.max("sm").alias("rollout_is_seq_max"),
        F.min("sm").alias("rollout_is_seq_min"),
        F.max(F.abs(F.col("sm") - 1)).alias("rollout_is_seq_max_deviation"),
        F.avg((F.col("sm") > up).cast("int")).alias("rollout_is_seq_fraction_high"),
        F.avg((F.col("sm") < low).cast("int")).alias("rollout_is_seq_fraction_low"),
    )


# --- rejection -----------------------------------------------------------------------------------------------


def _token_stat(kind: str) -> Column:
    def stat(x):
        lr = clamp(x, -SAFETY, SAFETY)
        return {"k1": -lr, "k2": lr * lr * 0.5, "k3": F.exp(lr) - 1 - lr}[kind]

    return F.transform("log_ratio", stat)


def _bounds(th: Threshold) -> tuple[float | None, float]:
    """Bounds on the scale of the statistic: logs for k1, plain otherwise."""
    if th.lower is not None:
        return math.log(th.lower), math.log(th.upper)
    return None, th.upper


def _kept(stat: Column, th: Threshold) -> Column:
    low, up = _bounds(th)
    keep = stat <= up
    return keep if low is None else keep & (stat >= low)


def _keep_flags(stat: Column | None, source: str, th: Threshold) -> Column:
    """0/1 per token: from the token's own statistic, or from one value shared by the row."""
    return F.transform(source, lambda x: _kept(x if stat is None else stat, th).cast("int"))


def with_rejection_stats(df: DataFrame, thresholds: list[Threshold]) -> DataFrame:
    """Per option: `<opt>__seq` (sequence statistic), `<opt>__tok` (token statistic), `<opt>__keep` (0/1 array)."""
    for th in thresholds:
        level, kind = th.option.rsplit("_", 1)
        tok, seq, keep = f"{th.option}__tok", f"{th.option}__seq", f"{th.option}__keep"
        df = df.withColumn(tok, _token_stat(kind))
        if level == "token":
            df = df.withColumn(seq, masked_mean(tok, "response_mask")).withColumn(keep, _keep_flags(None, tok, th))
            continue
        if level == "seq_sum":
            value = masked_sum(tok, "response_mask")
        elif level == "seq_mean":
            value = masked_mean(tok, "response_mask")
        else:
            value = F.coalesce(masked_extreme(tok, "response_mask", True), F.lit(0.0))
        df = df.withColumn(seq, value)
        df = df.withColumn(tok, spread_value(F.col(seq))).withColumn(keep, _keep_flags(F.col(seq), "response_mask", th))
    return df


def spread_value(value: Column) -> Column:
    return F.transform("response_mask", lambda _: value)


def rejection_mask(df: DataFrame, thresholds: list[Threshold]) -> DataFrame:
    """Adds `modified_response_mask`: the mask times every option's keep flag."""
    rows = with_rejection_stats(df, thresholds)
    names = ["response_mask"] + [f"{t.option}__keep" for t in thresholds]

    def both(t):
        out = t[names[0]]
        for name in names[1:]:
            out = out * t[name]
        return out

    return rows.withColumn("modified_response_mask", zmap(names, both))


def _over(name: str, fn) -> Column:
    """Masked sum of a function of one token array."""
    return asum(zmap([name, "response_mask"], lambda t: fn(t[name]) * t["response_mask"]))


def rejection_metrics(df: DataFrame, thresholds: list[Threshold], keys: list[str] | None = None) -> DataFrame:
    """Per-step statistics of every option and of the combined mask; input from `rejection_mask`."""
    keys = keys or ["step"]
    m = "response_mask"
    cols = [mask_count(m).alias("n"), mask_count("modified_response_mask").alias("kept")]
    for th in thresholds:
        o, (low, up) = th.option, _bounds(th)
        floor = 0.0 if low is None else low
        tok, keep = f"{o}__tok", f"{o}__keep"
        cols += [
            masked_sum(tok, m).alias(f"{o}_s"),
            _over(tok, lambda x, a=floor, b=up: clamp(x, a, b)).alias(f"{o}_c"),
            _over(tok, lambda x, a=floor, b=up: clamp(x, a, b) * clamp(x, a, b)).alias(f"{o}_cc"),
            _over(tok, lambda x, b=up: (x > b).cast("int")).alias(f"{o}_hi"),
            _over(tok, lambda x, a=floor: (x < a).cast("int")).alias(f"{o}_lo"),
            masked_extreme(tok, m, True).alias(f"{o}_max"),
            masked_extreme(tok, m, False).alias(f"{o}_min"),
            F.when(mask_count(m) > 0, F.col(f"{o}__seq")).alias(f"{o}_q"),
            masked_sum(keep, m).alias(f"{o}_kept"),
        ]
    rows = df.select(*keys, *cols)
    n = F.sum("n")
    valid = F.sum((F.col("n") > 0).cast("int"))
    aggs = []
    for th in thresholds:
        o, (low, up) = th.option, _bounds(th)
        p, seq = f"rollout_rs_{o}", F.col(f"{o}_q")
        high_seq = F.coalesce(F.avg((seq > up).cast("int")), F.lit(0.0))
        low_seq = F.lit(0.0) if low is None else F.coalesce(F.avg((seq < low).cast("int")), F.lit(0.0))
        sequence = not o.startswith("token")
        aggs += [
            (F.sum(f"{o}_s") / (n + F.lit(EPS))).alias(f"{p}_mean"),
            (F.max(seq) if sequence else F.max(f"{o}_max")).alias(f"{p}_max"),
            (F.min(seq) if sequence else F.min(f"{o}_min")).alias(f"{p}_min"),
            (high_seq if sequence else F.sum(f"{o}_hi") / (n + F.lit(EPS))).alias(f"{p}_fraction_high"),
            (low_seq if sequence or low is None else F.sum(f"{o}_lo") / (n + F.lit(EPS))).alias(f"{p}_fraction_low"),
            _std_from(F.sum(f"{o}_cc"), F.sum(f"{o}_c"), n).alias(f"{p}_std"),
            F.avg(seq).alias(f"{p}_seq_mean"),
            F.coalesce(F.stddev_samp(seq), F.lit(0.0)).alias(f"{p}_seq_std"),
            F.max(seq).alias(f"{p}_seq_max"),
            F.min(seq).alias(f"{p}_seq_min"),
            F.max(F.abs(seq)).alias(f"{p}_seq_max_deviation"),
            high_seq.alias(f"{p}_seq_fraction_high"),
            *([] if low is None else [low_seq.alias(f"{p}_seq_fraction_low")]),
            ((n - F.sum(f"{o}_kept")) / (n + F.lit(EPS))).alias(f"{p}_masked_fraction"),
            F.coalesce(
                F.try_divide(F.sum(((F.col("n") > 0) & (F.col(f"{o}_kept") < F.col("n"))).cast("int")), valid), F.lit(0.0)
            ).alias(f"{p}_seq_masked_fraction"),
        ]
    aggs += [
        ((n - F.sum("kept")) / (n + F.lit(EPS))).alias("rollout_rs_masked_fraction"),
        F.avg((F.col("kept") < F.col("n")).cast("int")).alias("rollout_rs_seq_masked_fraction"),
    ]
    return rows.groupBy(*keys).agg(*aggs)


# --- diagnostics -----------------------------------------------------------------------------------------------


def offpolicy_metrics(
    df: DataFrame,
    new: str = "old_log_probs",
    behaviour: str | None = "rollout_log_probs",
    keys: list[str] | None = None,
) -> DataFrame:
    """Per-step perplexities, divergences and chi-squared terms; without `behaviour` only the new policy's."""
    keys, m = keys or ["step"], "response_mask"
    rows = df.withColumn("__a", masked_mean(new, m))
    if behaviour is None:
        return rows.groupBy(*keys).agg(
            F.avg(F.exp(-F.col("__a"))).alias("training_ppl"), F.avg(-F.col("__a")).alias("training_log_ppl")
        )
    pair = [new, behaviour, m]

    def ratio(t):
        return t[new] - t[behaviour]

    rows = rows.select(
        *keys,
        "__a",
        masked_mean(behaviour, m).alias("__b"),
        mask_count(m).alias("n"),
        asum(zmap(pair, lambda t: -ratio(t) * t[m])).alias("kl"),
        asum(zmap(pair, lambda t: (F.exp(ratio(t)) - ratio(t) - 1) * t[m])).alias("k3"),
        asum(zmap(pair, lambda t: F.exp(clamp(ratio(t), -SAFETY, SAFETY) * 2) * t[m])).alias("rho2"),
        asum(zmap(pair, lambda t: ratio(t) * t[m])).alias("lr"),
    )
    gap = F.col("__b") - F.col("__a")
    n = F.sum("n") + F.lit(EPS)
    return rows.groupBy(*keys).agg(
        F.avg(F.exp(-F.col("__a"))).alias("training_ppl"),
        F.avg(-F.col("__a")).alias("training_log_ppl"),
        (F.sum("kl") / n).alias("kl"),
        (F.sum("k3") / n).alias("k3_kl"),
        F.avg(F.exp(-F.col("__b"))).alias("rollout_ppl"),
        F.avg(-F.col("__b")).alias("rollout_log_ppl"),
        F.avg(gap).alias("log_ppl_diff"),
        F.avg(F.abs(gap)).alias("log_ppl_abs_diff"),
        F.max(gap).alias("log_ppl_diff_max"),
        F.min(gap).alias("log_ppl_diff_min"),
        F.avg(F.exp(gap)).alias("ppl_ratio"),
        (F.sum("rho2") / n - 1).alias("chi2_token"),
        (F.avg(F.exp(clamp(F.col("lr"), -SAFETY, SAFETY) * 2)) - 1).alias("chi2_seq"),
    )


def rollout_correction(
    df: DataFrame,
    weight_level: str | None = None,
    weight_threshold: float | None = 2.0,
    normalize: bool = False,
    rejection: str | None = None,
    rejection_threshold: str | float | None = None,
    new: str = "old_log_probs",
    behaviour: str = "rollout_log_probs",
    keys: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Corrected rows and per-step metrics prefixed `rollout_corr/`.

    The row's `response_mask` is always replaced by the rejection result; `rollout_is_weights` is added
    only when weights are enabled.
    """
    keys = keys or ["step"]
    rows = with_log_ratio(df, new, behaviour)
    metrics = offpolicy_metrics(rows, new, behaviour, keys)
    if weight_level is not None and weight_threshold is not None:
        rows = importance_weights(rows, weight_level, weight_threshold, normalize, keys)
        metrics = metrics.join(importance_metrics(rows, weight_level, weight_threshold, keys), keys)
        if normalize:
            metrics = metrics.join(
                rows.groupBy(*keys).agg(F.first("is_norm_factor").alias("rollout_is_batch_norm_factor")), keys
            )
    if rejection is not None:
        thresholds = parse_options(rejection, rejection_threshold)
        rows = rejection_mask(rows, thresholds)
        metrics = metrics.join(rejection_metrics(rows, thresholds, keys), keys)
        rows = rows.withColumn("response_mask", F.col("modified_response_mask"))
        rows = rows.drop("modified_response_mask", *[f"{t.option}__{s}" for t in thresholds for s in ("tok", "seq", "keep")])
    renamed = {c: f"rollout_corr/{c}" for c in metrics.columns if c not in keys}
    return rows.drop("is_weights_raw", "is_norm_factor", "log_ratio"), metrics.withColumnsRenamed(renamed)


def bypass_old_log_probs(df: DataFrame) -> DataFrame:
    return df.withColumn("old_log_probs", F.col("rollout_log_probs"))


# --- agreement of two engines -------------------------------------------------------------------------------


def agreement_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Max, mean and deviation of probability differences, and their correlation, on valid tokens."""
    keys = keys or ["step"]
    pairs = df.select(
        *keys,
        F.explode(
            F.filter(F.arrays_zip("rollout_log_probs", "old_log_probs", "response_mask"), lambda t: t["response_mask"] > 0)
        ).alias("t"),
    ).select(*keys, F.exp("t.rollout_log_probs").alias("p"), F.exp("t.old_log_probs").alias("q"))
    gap = F.abs(F.col("p") - F.col("q"))
    return pairs.groupBy(*keys).agg(
        F.lit(1).alias("rollout_probs_diff_valid"),
        F.max(gap).alias("rollout_probs_diff_max"),
        F.avg(gap).alias("rollout_probs_diff_mean"),
        F.stddev_samp(gap).alias("rollout_probs_diff_std"),
        F.corr("p", "q").alias("rollout_actor_probs_pearson_corr"),
    )


def token_difference_count(a: str, b: str, mask: str) -> Column:
    """How many valid positions of a row hold different tokens."""
    return F.size(F.filter(F.arrays_zip(a, b, mask), lambda t: (t[a] != t[b]) & (t[mask] > 0)))
