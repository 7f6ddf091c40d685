"""Loss values and their metrics over logged log-probabilities (no gradients).

Each loss is a per-token row expression followed by one grouped aggregation per step.  Input rows carry
`old_log_probs`, `log_probs`, `advantages`, `response_mask` and optionally `rollout_is_weights`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import EPS, asum, clamp, mask_count, masked_sum, zmap
from ..session import staged
from .correction import rollout_correction
from .grouping import hash_bucket, join_group_table, kth_largest, scale_bucket, seeded_hash, with_group_stats, with_prefix_sum, with_rank

M = "response_mask"
BASE = ["old_log_probs", "log_probs", "advantages", M]
AGGREGATIONS = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def aggregate_loss(
    loss: str = "loss_mat",
    mode: str = "token-mean",
    batch_tokens: float | None = None,
    batch_rows: float | None = None,
    scale: float | None = None,
    dp_size: int = 1,
) -> Column:
    """Aggregate expression over the rows of one step; sequences without a valid token leave the means."""
    n, total = mask_count(M), masked_sum(loss, M)
    if mode == "token-mean":
        return F.sum(total) / (F.sum(n) if batch_tokens is None else F.lit(batch_tokens)) * dp_size
    live = (n > 0).cast("int")
    rows = F.sum(live) if batch_rows is None else F.lit(batch_rows)
    if mode == "seq-mean-token-sum":
        return F.sum(total * live) / rows * dp_size
    if mode == "seq-mean-token-mean":
        return F.sum(total / (n + F.lit(EPS)) * live) / rows * dp_size
    if mode == "seq-mean-token-sum-norm":
        return F.sum(total) / (F.max("max_response_len") if scale is None else F.lit(scale))
    raise ValueError(f"unknown loss aggregation: {mode}")


def _mean(x: str) -> Column:
    """Masked mean over the tokens of a step."""
    return F.sum(masked_sum(x, M)) / (F.sum(mask_count(M)) + F.lit(EPS))


def _weighted(df: DataFrame, fn, weights: str | None) -> DataFrame:
    names = BASE + ([weights] if weights else [])
    return df.withColumn("loss_mat", zmap(names, (lambda t: fn(t) * t[weights]) if weights else fn))


def _metric(df: DataFrame, name: str, fn) -> DataFrame:
    return df.withColumn(name, zmap(BASE, fn))


def _lr(t, bound: float | None = 20.0) -> Column:
    d = t["log_probs"] - t["old_log_probs"]
    return d if bound is None else clamp(d, -bound, bound)


def _clip(x: Column, low: float, high: float) -> Column:
    return clamp(x, 1 - low, 1 + high)


def ppo_clip(
    df: DataFrame, mode: str = "token-mean", low: float = 0.2, high: float = 0.2, dual: float = 3.0, weights: str | None = None
) -> DataFrame:
    if dual <= 1:
        raise ValueError("the dual-clip bound must exceed one")

    def plain(t):
        return -t["advantages"] * F.exp(_lr(t))

    def clipped(t):
        return -t["advantages"] * _clip(F.exp(_lr(t)), low, high)

    def value(t):
        upper = F.greatest(plain(t), clipped(t))
        return F.when(t["advantages"] < 0, F.least(-t["advantages"] * dual, upper)).otherwise(upper)

    df = _weighted(df, value, weights)
    df = _metric(df, "m_clip", lambda t: (clipped(t) > plain(t)).cast("int"))
    df = _metric(df, "m_kl", lambda t: -_lr(t))
    df = _metric(
        df,
        "m_low",
        lambda t: ((F.greatest(plain(t), clipped(t)) > -t["advantages"] * dual) & (t["advantages"] < 0)).cast("int"),
    )
    return df.groupBy("step").agg(
        aggregate_loss(mode=mode).alias("pg_loss"),
        _mean("m_clip").alias("pg_clipfrac"),
        _mean("m_kl").alias("ppo_kl"),
        _mean("m_low").alias("pg_clipfrac_lower"),
    )


def sequence_clip(df: DataFrame, low: float = 0.2, high: float = 0.2, weights: str | None = None) -> DataFrame:
    """Clipping of the geometric-mean ratio of a sequence; always averaged per sequence."""
    df = df.withColumn("__lr", zmap(BASE, lambda t: _lr(t, None)))
    df = df.withColumn(
        "__ratio", F.exp(clamp(masked_sum("__lr", M) / F.greatest(mask_count(M), F.lit(1)), high=10.0))
    )

    def plain(t):
        return -t["advantages"] * F.col("__ratio")

    def clipped(t):
        return -t["advantages"] * _clip(F.col("__ratio"), low, high)

    df = _weighted(df, lambda t: F.greatest(plain(t), clipped(t)), weights)
    df = _metric(df, "m_clip", lambda t: (clipped(t) > plain(t)).cast("int"))
    df = _metric(df, "m_kl", lambda t: -_lr(t, None))
    return df.groupBy("step").agg(
        aggregate_loss(mode="seq-mean-token-mean").alias("pg_loss"),
        _mean("m_clip").alias("pg_clipfrac"),
        _mean("m_kl").alias("ppo_kl"),
        F.lit(0.0).alias("pg_clipfrac_lower"),
    )


def soft_gate(df: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05, weights: str | None = None) -> DataFrame:
    def value(t):
        tau = F.when(t["advantages"] > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
        gate = 1 / (1 + F.exp(-tau * (F.exp(_lr(t)) - 1))) * (4 / tau)
        return -gate * t["advantages"]

    df = _metric(_weighted(df, value, weights), "m_kl", lambda t: -_lr(t))
    return df.groupBy("step").agg(
        aggregate_loss(mode="seq-mean-token-mean").alias("pg_loss"),
        F.lit(0.0).alias("pg_clipfrac"),
        _mean("m_kl").alias("ppo_kl"),
        F.lit(0.0).alias("pg_clipfrac_lower"),
    )


def gpg_loss(df: DataFrame, mode: str = "token-mean", weights: str | None = None) -> DataFrame:
    df = _weighted(df, lambda t: -t["log_probs"] * t["advantages"], weights)
    return df.groupBy("step").agg(aggregate_loss(mode=mode).alias("pg_loss"))


def clipped_is_loss(
    df: DataFrame, mode: str = "token-mean", low: float = 0.2, high: float = 0.2, weights: str | None = None
) -> DataFrame:
    df = _weighted(df, lambda t: -_clip(F.exp(_lr(t)), low, high) * t["advantages"] * t["log_probs"], weights)
    df = _metric(df, "m_clip", lambda t: (F.exp(_lr(t)) != _clip(F.exp(_lr(t)), low, high)).cast("int"))
    df = _metric(df, "m_kl", lambda t: -_lr(t))
    return df.groupBy("step").agg(
        aggregate_loss(mode=mode).alias("pg_loss"),
        _mean("m_clip").alias("pg_clipfrac"),
        _mean("m_kl").alias("ppo_kl"),
        F.lit(0.0).alias("pg_clipfrac_lower"),
    )


def geometric_mean_loss(df: DataFrame, low: float = 0.2, high: float = 0.2, weights: str | None = None) -> DataFrame:
    def bounded(t):
        sign = F.signum(t["advantages"])
        return sign * F.least(sign * _lr(t, None), sign * clamp(_lr(t, None), -low, high))

    n = mask_count(M)
    df = df.withColumn("__b", zmap(BASE, bounded))
    seq = -masked_sum("advantages", M) / (n + F.lit(EPS)) * F.exp(masked_sum("__b", M) / (n + F.lit(EPS)))
    if weights:
        logs = F.transform(weights, lambda w: F.log(w + F.lit(1e-10)))
        seq = seq * F.exp(masked_sum(logs, M) / (n + F.lit(EPS)))
    df = df.withColumn("__seq", seq)

    def moved(t):
        return _lr(t, None) != clamp(_lr(t, None), -low, high)

    df = _metric(df, "m_clip", lambda t: (moved(t) & (t["advantages"] > 0)).cast("int"))
    df = _metric(df, "m_low", lambda t: (moved(t) & (t["advantages"] < 0)).cast("int"))
    df = _metric(df, "m_kl", lambda t: -_lr(t, None))
    return df.groupBy("step").agg(
        F.avg("__seq").alias("pg_loss"),
        _mean("m_clip").alias("pg_clipfrac"),
        _mean("m_kl").alias("ppo_kl"),
        _mean("m_low").alias("pg_clipfrac_lower"),
    )


def reinforce_loss(
    df: DataFrame, mode: str = "seq-mean-token-sum", weights: str | None = None, behaviour: str = "rollout_log_probs"
) -> DataFrame:
    df = _weighted(df, lambda t: -t["advantages"] * t["log_probs"], weights)
    df = df.withColumn("m_kl", F.zip_with("log_probs", behaviour, lambda a, b: b - a))
    return df.groupBy("step").agg(aggregate_loss(mode=mode).alias("pg_loss"), _mean("m_kl").alias("ppo_kl"))


def bypass_loss(df: DataFrame, loss_type: str = "ppo_clip", mode: str = "token-mean", **correction) -> DataFrame:
    """Correction against the current policy, then clipping without weights or the weighted plain loss."""
    if loss_type not in ("ppo_clip", "reinforce"):
        raise ValueError(f"unknown bypass loss: {loss_type}")
    rows, metrics = rollout_correction(df, new="log_probs", behaviour="old_log_probs", **correction)
    if loss_type == "ppo_clip":
        out = ppo_clip(rows, mode)
    else:
        weights = "rollout_is_weights" if "rollout_is_weights" in rows.columns else None
        out = reinforce_loss(rows, mode, weights, behaviour="old_log_probs")
    return out.join(metrics, ["step"])


def _token_table(df: DataFrame) -> DataFrame:
    """Valid tokens with the step means of advantage and log-probability attached.

    The means come from a map-side combined aggregate; whole rows never move for it.
    """
    rows = with_group_stats(
        df,
        ["step"],
        "sample_id",
        sums={
            "__n": mask_count(M),
            "__sa": masked_sum("advantages", M),
            "__sl": masked_sum("log_probs", M),
        },
    )
    return rows.select(
        "step",
        "sample_id",
        "__n",
        "__sa",
        "__sl",
        F.col("max_response_len").alias("width"),
        F.posexplode(F.arrays_zip(*BASE)).alias("pos", "t"),
    ).filter(f"t.{M} > 0")


def _top(df: DataFrame, bucket: Column, order: list[Column], limit: Column) -> DataFrame:
    """Flag `chosen`: the first `limit` rows of each step, ranked in two levels so no task sorts a whole step."""
    return with_rank(df, bucket, order, "__rank", ["step"]).withColumn("chosen", F.col("__rank") < limit).drop("__rank")


def _token_loss(tokens: DataFrame, loss: Column, kept: Column, mode: str, scale: float | None, **metrics: Column):
    """Aggregate single-token losses: per sequence first, then per step, so every mode is available.

    `kept` counts the tokens to report as clipped; `metrics` are per-token values averaged over the step.
    """
    per_seq = tokens.groupBy("step", "sample_id").agg(
        F.sum(loss).alias("loss"),
        F.count(F.lit(1)).alias("n"),
        F.sum(kept.cast("int")).alias("kept"),
        F.max("width").alias("width"),
        *[F.sum(c).alias(k) for k, c in metrics.items()],
    )
    return _sequence_loss(per_seq, mode, scale, list(metrics))


def _sequence_loss(per_seq: DataFrame, mode: str, scale: float | None, metrics: list[str]) -> DataFrame:
    """Step totals of per-sequence sums: loss, n, kept, width and the metrics."""
    total = {
        "token-mean": F.sum("loss") / F.sum("n"),
        "seq-mean-token-sum": F.avg("loss"),
        "seq-mean-token-mean": F.avg(F.col("loss") / (F.col("n") + F.lit(EPS))),
        "seq-mean-token-sum-norm": F.sum("loss") / (F.max("width") if scale is None else F.lit(scale)),
    }
    if mode not in total:
        raise ValueError(f"unknown loss aggregation: {mode}")
    n = F.sum("n") + F.lit(EPS)
    return per_seq.groupBy("step").agg(
        total[mode].alias("pg_loss"),
        (F.sum("kept") / n).alias("pg_clipfrac"),
        *[(F.sum(k) / n).alias(k) for k in metrics],
    )


def covariance_clip(
    df: DataFrame,
    ratio: float = 0.0002,
    low_cov: float = 1.0,
    high_cov: float = 5.0,
    low: float = 0.2,
    high: float = 0.2,
    seed: int = 0,
    mode: str = "token-mean",
    scale: float | None = None,
) -> DataFrame:
    """Drops a few randomly chosen tokens whose covariance lies in a band; choice by seeded hash."""
    tokens = _token_table(df)
    t = F.col("t")
    n = F.col("__n") + F.lit(EPS)
    lr = t["log_probs"] - t["old_log_probs"]
    plain = -t["advantages"] * F.exp(lr)
    clipped = -t["advantages"] * _clip(F.exp(lr), low, high)
    cov = (t["advantages"] - F.col("__sa") / n) * (t["log_probs"] - F.col("__sl") / n)
    tokens = tokens.select(
        "step",
        "sample_id",
        "pos",
        "width",
        "__n",
        F.greatest(plain, clipped).alias("raw"),
        (-lr).alias("kl"),
        ((cov < high_cov) & (cov > low_cov) & ~(clipped > plain)).alias("candidate"),
    )
    limit = F.greatest(F.floor(F.col("__n") * F.lit(ratio)), F.lit(1))
    picked = tokens.filter("candidate").withColumn("__h", seeded_hash(seed, "sample_id", "pos"))
    picked = _top(picked, hash_bucket(F.col("__h")), [F.col("__h"), F.col("sample_id"), F.col("pos")], limit)
    columns = ["step", "sample_id", "width", "raw", "kl"]
    tokens = tokens.filter("NOT candidate").select(*columns, F.lit(False).alias("chosen")).unionByName(
        picked.select(*columns, "chosen")
    )
    loss = F.when(F.col("chosen"), 0.0).otherwise(F.col("raw"))
    return _token_loss(tokens, loss, F.col("chosen"), mode, scale, ppo_kl=F.col("kl"))


def covariance_penalty(
    df: DataFrame, ratio: float = 0.0002, coef: float = 1.0, mode: str = "token-mean", scale: float | None = None
) -> DataFrame:
    """Adds an absolute-divergence term to the tokens of highest covariance in each step, ties by (sample_id, pos).

    Tokens stay in the arrays of their sequence.  They are taken apart only to be counted: the covariance of the last
    token chosen is selected by histogram, then each sequence marks its own tokens above it.  Of those that equal it a
    prefix sum over the sequences that hold some says how many are taken before.
    """
    rows = with_group_stats(
        df,
        ["step"],
        "sample_id",
        sums={"__n": mask_count(M), "__sa": masked_sum("advantages", M), "__sl": masked_sum("log_probs", M)},
    )

    def token(t: Column) -> Column:
        lr = t["log_probs"] - t["old_log_probs"]
        cov = (t["advantages"] - F.col("__sa") / F.col("__n")) * (t["log_probs"] - F.col("__sl") / F.col("__n"))
        return F.struct(cov.alias("cov"), (-t["advantages"] * F.exp(lr)).alias("plain"), F.abs(lr).alias("kl"))

    live = F.transform(F.filter(F.arrays_zip(*BASE), lambda t: t[M] > 0), token)
    rows = rows.select("step", "sample_id", F.col("max_response_len").alias("width"), F.col("__n").alias("tokens"), live.alias("t"))
    rows = rows.select(
        "step", "sample_id", "width", "tokens", F.size("t").alias("n"), F.col("t.cov").alias("cov"), F.col("t.kl").alias("kl"),
        asum(F.col("t.plain")).alias("plain"),
    ).filter("n > 0")
    rows = staged(rows)
    limit = F.greatest(F.lit(1), F.floor(F.max("tokens") * F.lit(ratio))).cast("long")
    limits = rows.groupBy("step").agg(limit.alias("k"))
    edge = staged(kth_largest(rows.select("step", F.explode("cov").alias("cov")), ["step"], "cov", limits))
    rows = rows.join(edge, "step", "left")
    equal = F.size(F.filter("cov", lambda c: c == F.col("kth")))
    ties = rows.select("step", "sample_id", equal.alias("c")).filter("c > 0")
    ties = with_prefix_sum(ties, scale_bucket(F.col("sample_id")), [F.col("sample_id")], F.col("c"), "__before", ["step"])
    rows = rows.join(ties.select("step", "sample_id", "__before"), ["step", "sample_id"], "left")
    own = F.arrays_zip("cov", "kl")
    above = asum(F.transform(F.filter(own, lambda t: t["cov"] > F.col("kth")), lambda t: t["kl"]))
    room = F.greatest(F.col("take") - F.coalesce("__before", F.lit(0)), F.lit(0)).cast("int")
    at_edge = asum(F.transform(F.slice(F.filter(own, lambda t: t["cov"] == F.col("kth")), F.lit(1), room), lambda t: t["kl"]))
    loss = F.col("plain") + F.lit(coef) * F.coalesce(above + at_edge, F.lit(0.0))
    per_seq = rows.select("step", "sample_id", loss.alias("loss"), "n", F.lit(0).alias("kept"), "width", asum("kl").alias("ppo_kl"))
    return _sequence_loss(per_seq, mode, scale, ["ppo_kl"]).drop("pg_clipfrac")


def value_loss(df: DataFrame, clip: float = 0.5, mode: str = "token-mean", pred: str = "vpreds") -> DataFrame:
    names = [pred, "returns", "values"]

    def parts(t):
        bounded = F.least(F.greatest(t[pred], t["values"] - clip), t["values"] + clip)
        return F.pow(t[pred] - t["returns"], F.lit(2)), F.pow(bounded - t["returns"], F.lit(2))

    df = df.withColumn("loss_mat", zmap(names, lambda t: F.greatest(*parts(t))))
    df = df.withColumn("m_clip", zmap(names, lambda t: (parts(t)[1] > parts(t)[0]).cast("int")))
    return df.groupBy("step").agg(
        (aggregate_loss(mode=mode) * 0.5).alias("vf_loss"), _mean("m_clip").alias("vf_clipfrac")
    )


def entropy_loss(df: DataFrame, mode: str = "token-mean") -> DataFrame:
    return df.groupBy("step").agg(aggregate_loss("entropys", mode).alias("entropy"))


def sft_loss(df: DataFrame, dp_size: int = 1) -> DataFrame:
    """Minus the masked log-probability sum over the batch tokens.

    Rows are laid end to end by `sample_id`; the mask moves one token to the left across row borders, so
    a row's last token takes the first mask value of the following row and the very last wraps around.
    Neighbours meet through their exact rank, not through a window over the whole step.
    """
    rows = df.select("step", "sample_id", "log_probs", M).filter(F.size(M) > 0)
    rows = with_rank(rows, F.floor(F.col("sample_id") / 65536), [F.col("sample_id")], "__at", ["step"])
    counts = rows.groupBy("step").agg(F.count(F.lit(1)).alias("__rows"), F.sum(mask_count(M)).alias("batch_tokens"))
    heads = rows.select("step", F.col("__at").alias("__head_at"), F.get(F.col(M), F.lit(0)).alias("__head"))
    rows = join_group_table(rows, counts, ["step"], "sample_id")
    rows = rows.withColumn("__next", (F.col("__at") + 1) % F.col("__rows"))
    rows = rows.join(
        heads.withColumnRenamed("step", "__s"), (F.col("step") == F.col("__s")) & (F.col("__next") == F.col("__head_at"))
    )
    rolled = F.concat(F.slice(M, F.lit(2), F.greatest(F.size(M) - 1, F.lit(0))), F.array("__head"))
    return rows.groupBy("step").agg(
        (-F.sum(asum(F.zip_with("log_probs", rolled, lambda a, m: a * m))) / F.max("batch_tokens") * dp_size).alias("loss")
    )


LOSSES: dict[str, Callable[..., DataFrame]] = {
    "vanilla": ppo_clip,
    "gspo": sequence_clip,
    "sapo": soft_gate,
    "gpg": gpg_loss,
    "clip_cov": covariance_clip,
    "kl_cov": covariance_penalty,
    "geo_mean": geometric_mean_loss,
    "cispo": clipped_is_loss,
    "reinforce": reinforce_loss,
    "bypass_mode": bypass_loss,
}


def register_loss(name: str, fn: Callable[..., DataFrame]) -> None:
    LOSSES[name] = fn


def policy_loss(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"unknown policy loss: {name}")
    return LOSSES[name](df, **options)


