"""Per-step training metrics, rollups of metric logs, timing, throughput and cost figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import asum, masked_mean, masked_sum, zmap
from .grouping import exact_percentiles

M = "response_mask"


def data_metrics(df: DataFrame, use_critic: bool = True) -> DataFrame:
    """Score, reward, advantage, return, value and length statistics of each step.

    A response of length zero is aborted: it leaves score and reward statistics but counts in plain
    length statistics; a step of aborted samples only is an error.
    """
    live = F.col("response_len") > 0
    rows = df.select(
        "step",
        F.size(M).alias("response_len"),
        "prompt_len",
        "max_response_len",
        "max_prompt_len",
        "num_turns",
        "tool_call_counts",
        asum("token_level_scores").alias("score"),
        asum("token_level_rewards").alias("reward"),
    )
    seq = rows.groupBy("step").agg(
        F.when(
            F.sum(live.cast("int")) == 0, F.raise_error(F.lit("all samples of a step are aborted")).cast("double")
        )
        .otherwise(F.avg(F.when(live, F.col("score"))))
        .alias("critic/score/mean"),
        F.max(F.when(live, F.col("score"))).alias("critic/score/max"),
        F.min(F.when(live, F.col("score"))).alias("critic/score/min"),
        F.avg(F.when(live, F.col("reward"))).alias("critic/rewards/mean"),
        F.max(F.when(live, F.col("reward"))).alias("critic/rewards/max"),
        F.min(F.when(live, F.col("reward"))).alias("critic/rewards/min"),
        *_length_stats("response_length", F.col("response_len"), F.col("max_response_len")),
        *_length_stats("response_length_non_aborted", F.when(live, F.col("response_len")), F.col("max_response_len")),
        F.avg((~live).cast("int")).alias("response/aborted_ratio"),
        *_length_stats("prompt_length", F.col("prompt_len"), F.col("max_prompt_len")),
        *[
            fn(c).alias(f"{c}/{n}")
            for c in ("num_turns", "tool_call_counts")
            for n, fn in (("min", F.min), ("max", F.max), ("mean", F.avg))
        ],
    )
    names = ["advantages", "returns"] + (["values"] if use_critic else [])
    tokens = df.select("step", F.explode(F.filter(F.arrays_zip(M, *names), lambda t: t[M] > 0)).alias("t"))
    aggs = [
        fn(f"t.{c}").alias(f"critic/{c}/{n}") for c in names for n, fn in (("mean", F.avg), ("max", F.max), ("min", F.min))
    ]
    if use_critic:
        gap = F.var_samp(F.col("t.returns") - F.col("t.values"))
        aggs.append((1 - gap / (F.var_samp("t.returns") + F.lit(1e-5))).alias("critic/vf_explained_var"))
    return seq.join(tokens.groupBy("step").agg(*aggs), "step", "left")


def _length_stats(name: str, length: Column, limit: Column) -> list[Column]:
    return [
        F.avg(length).alias(f"{name}/mean"),
        F.max(length).alias(f"{name}/max"),
        F.min(length).alias(f"{name}/min"),
        F.avg(F.when(length.isNotNull(), (length == limit).cast("int"))).alias(f"{name}/clip_ratio"),
    ]


def token_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("step").agg(
        F.sum(F.size(M)).alias("response_tokens"), F.sum(F.size(M) + F.col("prompt_len")).alias("all_tokens")
    )


# Stages timed per token; generation is charged to response tokens only.
PER_TOKEN_STAGES = ("gen", "ref", "values", "adv", "update_critic", "update_actor")


def timing_metrics(timings: DataFrame, totals: DataFrame) -> DataFrame:
    """Seconds per stage and milliseconds per token; `timings` is (step, stage, seconds)."""
    rows = timings.join(totals, "step")
    tokens = F.when(F.col("stage") == "gen", F.col("response_tokens")).otherwise(F.col("all_tokens"))
    ms = F.when(F.col("stage").isin(*PER_TOKEN_STAGES), F.try_divide(F.col("seconds") * 1000, tokens))
    return rows.select("step", "stage", F.col("seconds").alias("timing_s"), ms.alias("timing_per_token_ms"))


def throughput(totals: DataFrame, step_seconds: DataFrame, n_gpus: int) -> DataFrame:
    rows = totals.join(step_seconds, "step")
    return rows.select(
        "step",
        F.col("all_tokens").alias("total_num_tokens"),
        F.col("seconds").alias("time_per_step"),
        (F.col("all_tokens") / (F.col("seconds") * n_gpus)).alias("throughput"),
    )


def variance_proxies(df: DataFrame, gradient_norm: Column | None = None, is_weights: str | None = None) -> DataFrame:
    """Signal, power and noise proxies of the gradient per step; `gradient_norm` is a column of the step."""
    names = ["old_log_probs", "sum_pi_squared", M]
    w = zmap(names, lambda t: 1 - 2 * F.exp(t["old_log_probs"]) + t["sum_pi_squared"])
    rows = df.withColumn("__w0", w)
    if is_weights:
        rows = rows.withColumn("__w", zmap(["__w0", is_weights], lambda t: t["__w0"] * t[is_weights] * t[is_weights]))
        original = masked_sum(
            zmap(["__w", is_weights], lambda t: t["__w"] / F.greatest(t[is_weights] * t[is_weights], F.lit(1e-10))), M
        )
        scale = F.pow(masked_mean(is_weights, M), F.lit(2))
    else:
        rows = rows.withColumn("__w", F.col("__w0"))
        original, scale = masked_sum("__w", M), F.lit(1.0)
    rows = rows.select(
        "step",
        masked_mean("advantages", M).alias("a"),
        masked_sum("__w", M).alias("w"),
        (scale * F.greatest(original, F.lit(0.0))).alias("w_power"),
        (gradient_norm if gradient_norm is not None else F.lit(None).cast("double")).alias("g"),
    )
    power = F.avg(F.col("a") * F.col("a") * F.col("w_power"))
    signal = F.pow(F.max("g"), F.lit(2))
    n = F.count(F.lit(1))
    return rows.groupBy("step").agg(
        F.coalesce(signal, F.lit(0.0)).alias("proxy1_signal_strength"),
        power.alias("proxy2_total_power"),
        F.coalesce(F.when(n > 1, F.greatest((power - signal) / (n - 1), F.lit(0.0))), F.lit(0.0)).alias("proxy3_pure_noise"),
        F.avg(F.col("a") * F.col("a")).alias("expected_a_squared"),
        F.avg("w").alias("expected_w"),
    )


# --- long metric tables ---------------------------------------------------------------------------------------


def reduce_by_name(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`max` in the name takes the largest value, else `min` the smallest, else the mean; plain substrings."""
    keys = [*(keys or []), "key"]
    agg = log.groupBy(*keys).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mu"))
    name = F.col("key")
    return agg.select(
        *keys,
        F.when(name.contains("max"), F.col("hi")).when(name.contains("min"), F.col("lo")).otherwise(F.col("mu")).alias("value"),
    )


def aggregate_typed(log: DataFrame) -> DataFrame:
    """(key, agg, value) rows to one value per key; a key with several aggregation types is an error."""
    out = log.groupBy("key").agg(
        F.min("agg").alias("agg"),
        F.max("agg").alias("__other"),
        F.avg("value").alias("mean"),
        F.sum("value").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    mixed = F.raise_error(F.concat(F.lit("mixed aggregation types for "), F.col("key"))).cast("double")
    value = F.when(F.col("agg") != F.col("__other"), mixed)
    for name in ("mean", "sum", "min", "max"):
        value = value.when(F.col("agg") == name, F.col(name))
    unknown = F.raise_error(F.concat(F.lit("unknown aggregation type "), F.col("agg"))).cast("double")
    return out.select("key", "agg", value.otherwise(unknown).alias("value"))


# Metric names with their own rule, and name keywords in the order they are tried.
RULES = {
    "time_sum": ["perf/time_per_step"],
    "min": ["timing_s/agent_loop/tool_calls/min"],
    "avg": ["timing_s/agent_loop/tool_calls/mean"],
    "max": ["timing_s/agent_loop/tool_calls/max"],
    "last": [
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ],
}
KEYWORDS = [
    ("time_sum", ["timing_s/"]),
    ("avg", ["mean", "avg", "average"]),
    ("max", ["max", "maximum"]),
    ("min", ["min", "minimum"]),
    ("sum", ["sum", "total"]),
]


def rollup_rule(key: Column) -> Column:
    rule = None
    for name, members in RULES.items():
        hit = key.isin(*members)
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    lowered = F.lower(key)
    for name, words in KEYWORDS:
        rule = rule.when(lowered.rlike("|".join(words)), name)
    return rule.otherwise("avg")


def interval_rollup(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One value per (interval, key) by the rule of its name; `order` decides which value is last."""
    agg = log.groupBy(*keys, "key").agg(
        F.sum("value").alias("s"),
        F.avg("value").alias("a"),
        F.max("value").alias("hi"),
        F.min("value").alias("lo"),
        F.max_by("value", F.struct(*order)).alias("last"),
    )
    rule = rollup_rule(F.col("key"))
    value = (
        F.when(rule == "last", F.col("last"))
        .when(rule.isin("sum", "time_sum"), F.col("s"))
        .when(rule == "max", F.col("hi"))
        .when(rule == "min", F.col("lo"))
        .otherwise(F.col("a"))
    )
    return agg.select(*keys, "key", value.alias("value"))


def derived_rollup(rolled: DataFrame, keys: list[str], total_gpus: int) -> DataFrame:
    """Replace spread and throughput by figures derived from the rolled values and add the idle ratio.

    The six inputs are picked per interval in one grouped pass (one row per interval), then joined back.
    """

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("key") == name, F.col("value")))

    one = rolled.groupBy(*keys).agg(
        pick("global_seqlen/minmax_diff").alias("d"),
        pick("global_seqlen/max").alias("hi"),
        pick("global_seqlen/min").alias("lo"),
        pick("perf/throughput").alias("tp"),
        pick("perf/total_num_tokens").alias("tok"),
        pick("perf/time_per_step").alias("sec"),
        pick("timing_s/gen").alias("gen"),
        pick("timing_s/step").alias("stp"),
    )
    rows = F.array(
        F.struct(F.lit("global_seqlen/minmax_diff").alias("key"), F.when(F.col("d").isNotNull(), F.col("hi") - F.col("lo")).alias("v")),
        F.struct(
            F.lit("perf/throughput").alias("key"),
            F.when(F.col("tp").isNotNull(), F.try_divide("tok", F.col("sec") * total_gpus)).alias("v"),
        ),
        F.struct(F.lit("trainer/idle_ratio").alias("key"), F.try_divide("gen", "stp").alias("v")),
    )
    derived = one.select(*keys, F.explode(F.filter(rows, lambda r: r["v"].isNotNull())).alias("r")).select(
        *keys, F.col("r.key").alias("key"), F.col("r.v").alias("value")
    )
    kept = rolled.join(derived.select(*keys, "key"), [*keys, "key"], "left_anti")
    return kept.unionByName(derived)


# --- sample streams ----------------------------------------------------------------------------------------------


def assembly_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Processing-time, tool-call, partial-rollout and version statistics of each assembled batch."""
    span = F.abs(F.col("param_version_end") - F.col("param_version_start"))
    versions = df.groupBy(*keys, "param_version").agg(F.count(F.lit(1)).alias("c"))
    agg = df.groupBy(*keys).agg(
        F.avg("processing_time").alias("processing_time_avg"),
        F.max("processing_time").alias("processing_time_max"),
        F.min("processing_time").alias("processing_time_min"),
        F.max("tool_call_time").alias("tool_calls_max"),
        F.min("tool_call_time").alias("tool_calls_min"),
        F.avg("tool_call_time").alias("tool_calls_mean"),
        F.sum((span != 0).cast("long")).alias("total_partial_num"),
        F.avg((span != 0).cast("int")).alias("partial_ratio"),
        F.max(span).alias("max_partial_span"),
    )
    tails = exact_percentiles(df, keys, "processing_time", {"tp50": 0.5, "tp95": 0.95, "tp99": 0.99})
    diversity = versions.groupBy(*keys).agg(F.count(F.lit(1)).alias("version_diversity"))
    return agg.join(tails, keys).join(diversity, keys)


def agent_timing(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range of generation and tool time, and the record of the slowest sample (the earliest on ties)."""
    slow = F.max_by(
        F.struct("generate_sequences", "tool_calls", "prompt_length", "response_length"),
        F.struct(F.col("generate_sequences") + F.col("tool_calls"), -F.col("pos")),
    )
    agg = df.groupBy(*keys).agg(
        *[
            fn(c).alias(f"{c}_{n}")
            for c in ("generate_sequences", "tool_calls")
            for n, fn in (("min", F.min), ("max", F.max), ("mean", F.avg))
        ],
        slow.alias("s"),
    )
    return agg.select(
        "*", *[F.col(f"s.{c}").alias(f"slowest_{c}") for c in ("generate_sequences", "tool_calls", "prompt_length", "response_length")]
    ).drop("s")


def staleness_counts(df: DataFrame, current: Column, keys: list[str]) -> DataFrame:
    """Samples and trajectories produced at least one policy version ago."""
    rows = df.withColumn("__cur", current)
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("__cur") - F.col("param_version") >= 1).alias("stale_samples_processed"),
        F.count_if(F.col("__cur") - F.col("param_version_end") >= 1).alias("stale_trajectory_processed"),
        F.max("__cur").alias("current_param_version"),
    )


# --- compute cost ----------------------------------------------------------------------------------------------------


# The model families with a known cost; any other costs nothing.
DENSE_FAMILIES = ["qwen2", "llama", "qwen2_vl", "qwen2_5_vl", "qwen3", "qwen3_vl", "minicpmv", "minicpmo", "mistral", "seed_oss", "glm4v"]
EXPERT_FAMILIES = ["qwen2_moe", "qwen3_moe", "qwen3_vl_moe"]
OTHER_FAMILIES = ["deepseek_v3", "gemma3_text", "apertus", "gpt_oss"]


def model_cost(cfg: dict) -> tuple[int, int, int, int, int]:
    """(parameters per token, attention width, full layers, sliding layers, window) of a model configuration.

    A family outside the lists costs zero.  The qwen3_vl families hold their text part in `text_config`.
    """
    family = cfg["model_type"]
    if family not in DENSE_FAMILIES + EXPERT_FAMILIES + OTHER_FAMILIES:
        return 0, 0, 0, 0, 0
    cfg = {**cfg, **cfg.get("text_config", {})}
    h, layers, heads = cfg["hidden_size"], cfg["num_hidden_layers"], cfg["num_attention_heads"]
    embed = cfg["vocab_size"] * h * 2
    if family == "deepseek_v3":
        nope, rope, v = cfg["qk_nope_head_dim"], cfg["qk_rope_head_dim"], cfg["v_head_dim"]
        rank, q_rank = cfg["kv_lora_rank"], cfg.get("q_lora_rank")
        query = h * heads * (nope + rope) if q_rank is None else q_rank * (h + heads * (nope + rope))
        attn = query + h * (rank + rope) + heads * (nope + v) * rank + heads * v * h
        experts = h * cfg["n_routed_experts"] + 3 * h * cfg["moe_intermediate_size"] * (
            cfg["num_experts_per_tok"] + cfg["n_shared_experts"]
        )
        dense_layers = cfg["first_k_dense_replace"]
        params = (
            (experts + attn) * (layers - dense_layers) + (3 * h * cfg["intermediate_size"] + attn) * dense_layers + embed
        )
        return params, (nope + rope) * heads, layers, 0, 0
    dim = cfg.get("head_dim") or h // heads
    attn = h * dim * 2 * (heads + cfg["num_key_value_heads"])
    if family in EXPERT_FAMILIES:
        mlp = 3 * h * cfg["num_experts_per_tok"] * cfg["moe_intermediate_size"] + h * cfg["num_experts"]
    elif family == "gpt_oss":
        mlp = h * cfg["num_local_experts"] + 3 * h * cfg["intermediate_size"] * cfg["num_experts_per_tok"]
    elif family == "apertus":
        mlp = 2 * h * cfg["intermediate_size"] + h + cfg["num_key_value_heads"] * dim
    else:
        mlp = 3 * h * cfg["intermediate_size"]
    sliding, window = 0, 0
    if family in ("gemma3_text", "gpt_oss"):
        window = cfg.get("sliding_window", 1024 if family == "gemma3_text" else 128) or 0
        kinds = cfg.get("layer_types")
        if kinds:
            sliding = sum(k == "sliding_attention" for k in kinds[:layers]) if window else 0
        elif family == "gemma3_text" and window and cfg.get("sliding_window_pattern", 6):
            sliding = layers - layers // cfg.get("sliding_window_pattern", 6)
    return (mlp + attn) * layers + embed, dim * heads, layers - sliding, sliding, window


def achieved_flops(lengths: DataFrame, cfg: dict, device_peak_tflops: float = math.inf, keys: list[str] | None = None) -> DataFrame:
    """TFLOP/s of each step from (step, length, seconds) rows, and its share of the device peak."""
    keys = keys or ["step"]
    params, width, full, sliding, window = model_cost(cfg)
    n = F.col("length").cast("double")
    square = F.sum(n * n) * full
    if sliding:
        square = square + F.sum(n * F.least(n, F.lit(float(window)))) * sliding
    flops = 6.0 * params * F.sum(n) + 12.0 * width * square
    tflops = flops / F.max("seconds") / 1e12
    return lengths.groupBy(*keys).agg(tflops.alias("tflops"), (tflops / F.lit(device_peak_tflops)).alias("mfu"))

