"""Validation, step-metric, rollup and cost queries."""

from pyspark.sql import functions as F

from ..derive import (
    METRICS_SQL,
    SAMPLES_SQL,
    STREAM_SQL,
    TOKENS_SQL,
    VALIDATION_SQL,
    metrics_log,
    rollout_stream,
    table,
    trajectories,
    validation_rows,
)
from ..operators import stepmetrics as S
from ..operators import validation as V
from .q_correction import E8, rounded
from .q_losses import TA, credited
from .registry import query, rnd, sq


def long_rows(spark, sf):
    return V.to_long(validation_rows(spark, sf), ["reward", "acc", "pred"])


PER_PROMPT = f"""WITH {VALIDATION_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid, var ORDER BY value) AS r,
            count(*) OVER (PARTITION BY data_source, uid, var) AS n FROM val),
    k AS (SELECT *, unnest(list_append(list_filter([2,4,8,16,32,64,128,256,512,1024], lambda x: x < n), n)) AS k FROM r WHERE n > 1),
    e AS (SELECT data_source, uid, var, k,
            sum(value*(pow(r/n,k)-pow((r-1)/n,k))) AS b1, sum(value*value*(pow(r/n,k)-pow((r-1)/n,k))) AS b2,
            sum(value*(pow(1-(r-1)/n,k)-pow(1-r/n,k))) AS w1, sum(value*value*(pow(1-(r-1)/n,k)-pow(1-r/n,k))) AS w2
          FROM k GROUP BY ALL),
    m AS (SELECT data_source, uid, var, 'mean@' || count(*) AS metric, avg(value) AS value FROM val GROUP BY data_source, uid, var
      UNION ALL SELECT data_source, uid, var, 'std@' || count(*), stddev_pop(value) FROM val GROUP BY data_source, uid, var HAVING count(*) > 1
      UNION ALL SELECT data_source, uid, var, 'best@' || k || '/mean', b1 FROM e
      UNION ALL SELECT data_source, uid, var, 'best@' || k || '/std', sqrt(greatest(b2-b1*b1, 0)) FROM e
      UNION ALL SELECT data_source, uid, var, 'worst@' || k || '/mean', w1 FROM e
      UNION ALL SELECT data_source, uid, var, 'worst@' || k || '/std', sqrt(greatest(w2-w1*w1, 0)) FROM e),
    a AS (SELECT data_source, var, metric, avg(value) AS value FROM m GROUP BY ALL)"""


@query("validation_metrics", f"{PER_PROMPT} SELECT data_source, var, metric, {sq('value')} AS value FROM a")
def validation_metrics(spark, sf):
    out = V.validation_metrics(long_rows(spark, sf))
    return out.select("data_source", "var", "metric", rnd("value").alias("value"))


@query(
    "validation_best_worst_per_prompt",
    f"{PER_PROMPT} SELECT data_source, uid, var, k, {sq('b1')} AS best, {sq('w1')} AS worst FROM e",
)
def validation_best_worst(spark, sf):
    out = V.best_worst_closed_form(long_rows(spark, sf)).filter("metric LIKE '%/mean'")
    size = F.regexp_extract("metric", r"@(\d+)", 1).cast("long")
    kind = F.regexp_extract("metric", r"^(\w+)@", 1)
    return (
        out.groupBy("data_source", "uid", "var", size.alias("k"))
        .agg(F.max(F.when(kind == "best", F.col("value"))).alias("b"), F.max(F.when(kind == "worst", F.col("value"))).alias("w"))
        .select("data_source", "uid", "var", "k", rnd("b").alias("best"), rnd("w").alias("worst"))
    )


@query("validation_metrics_resampled")
def validation_metrics_resampled(spark, sf):
    out = V.validation_metrics(long_rows(spark, sf), exact=True)
    return out.select("data_source", "var", "metric", rnd("value").alias("value"))


@query(
    "validation_majority_value",
    f"""WITH {VALIDATION_SQL},
    c AS (SELECT data_source, uid, var, pred, count(*) AS c, min(pos) AS p, arg_min(value, pos) AS value FROM val GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid, var ORDER BY c DESC, p) AS rk FROM c)
    SELECT data_source, uid, var, {sq("value")} AS value FROM k WHERE rk = 1""",
)
def validation_majority(spark, sf):
    out = V.majority_value(long_rows(spark, sf))
    return out.select("data_source", "uid", "var", rnd("value").alias("value"))


@query(
    "validation_sections",
    f"""{PER_PROMPT}, x AS (SELECT *, max(CAST(regexp_extract(metric, '@([0-9]+)', 1) AS INT)) OVER (PARTITION BY data_source, var) AS nm FROM a)
    SELECT CASE WHEN var = 'acc' AND regexp_matches(metric, '^(mean|maj|best)') AND contains(metric, '@' || nm)
      THEN 'val-core/' ELSE 'val-aux/' END || data_source || '/' || var || '/' || metric AS key, {sq("value")} AS value FROM x
    UNION ALL SELECT 'val-aux/num_turns/min', {sq("min(o_orderkey % 5 + 1)")} FROM orders
    UNION ALL SELECT 'val-aux/num_turns/max', {sq("max(o_orderkey % 5 + 1)")} FROM orders
    UNION ALL SELECT 'val-aux/num_turns/mean', {sq("avg(o_orderkey % 5 + 1)")} FROM orders""",
)
def validation_sections(spark, sf):
    out = V.sectioned(V.validation_metrics(long_rows(spark, sf)))
    out = out.unionByName(V.turn_stats(validation_rows(spark, sf)))
    return out.select("key", rnd("value").alias("value"))


@query(
    "validation_merged",
    f"""WITH {VALIDATION_SQL}, u AS (SELECT * FROM val WHERE pos % 2 = 0 UNION ALL SELECT * FROM val WHERE pos % 2 <> 0),
    m AS (SELECT data_source, uid, var, count(*) AS n, avg(value) AS mu, stddev_pop(value) AS sd FROM u GROUP BY ALL)
    SELECT data_source, var, 'mean@' || n AS metric, {sq("avg(mu)")} AS value FROM m GROUP BY ALL
    UNION ALL SELECT data_source, var, 'std@' || n, {sq("avg(sd)")} FROM m WHERE n > 1 GROUP BY ALL""",
)
def validation_merged(spark, sf):
    rows = long_rows(spark, sf)
    both = V.merge_results(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 <> 0"))
    out = V.across_prompts(V.per_prompt_mean_std(both))
    return out.select("data_source", "var", "metric", rnd("value").alias("value"))


@query(
    "offline_eval_by_source",
    f"""WITH r AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS response FROM documents),
    m AS (SELECT source, doc_id, avg(CASE WHEN regexp_matches(response, '[0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM r GROUP BY ALL)
    SELECT source AS data_source, {sq("avg(s)")} AS test_score FROM m GROUP BY source""",
)
def offline_eval_by_source(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("data_source"), F.col("doc_id").alias("row_id"), F.split("text", "\n").alias("responses")
    )
    score = F.when(F.col("response").rlike("[0-9]"), 1.0).otherwise(0.0)
    return V.offline_eval(docs, "responses", score).select("data_source", rnd("test_score").alias("test_score"))


# --- per step -------------------------------------------------------------------------------------------------


def with_returns(spark, sf):
    """Credited trajectories whose returns differ per token, for value statistics."""
    rows = credited(spark, sf)
    return rows.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v * F.lit(0.5)))


def _len_sql(name, expr, limit):
    return ", ".join(
        f"{sq(f)} AS {name}_{k}"
        for k, f in {
            "mean": f"avg({expr})",
            "max": f"max({expr})",
            "min": f"min({expr})",
            "clip_ratio": f"avg(({expr} = {limit})::INT)",
        }.items()
    )


@query(
    "step_data_metrics",
    f"""{TA},
    q AS (SELECT step, {", ".join(f"{sq(fn + '(score)')} AS critic_{c}_{k}" for c in ("score", "rewards") for k, fn in (("mean", "avg"), ("max", "max"), ("min", "min")))},
      {_len_sql("response_length", "len", 16)}, {_len_sql("response_length_non_aborted", "len", 16)}, {sq("0")} AS response_aborted_ratio,
      {_len_sql("prompt_length", "prompt_len", 59)},
      {", ".join(f"{sq(fn + '(' + c + ')')} AS {n}_{k}" for c, n in (("num_turns", "num_turns"), ("tool_calls", "tool_call_counts")) for k, fn in (("min", "min"), ("max", "max"), ("mean", "avg")))}
      FROM smp GROUP BY step),
    v AS (SELECT step, {", ".join(f"{sq(fn + '(' + e + ')')} AS critic_{c}_{k}" for c, e in (("advantages", "a"), ("returns", "a + val*0.5"), ("values", "val")) for k, fn in (("mean", "avg"), ("max", "max"), ("min", "min")))},
      {sq("1 - var_samp(a - val*0.5)/(var_samp(a + val*0.5) + 1e-5)")} AS critic_vf_explained_var FROM ta WHERE m = 1 GROUP BY step)
    SELECT * FROM q JOIN v USING (step)""",
)
def step_data_metrics(spark, sf):
    return rounded(S.data_metrics(with_returns(spark, sf)))


STAGES = {"click": "gen", "view": "ref", "signup": "adv", "purchase": "step", "error": "update_actor"}
STAGE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items()) + " END"
TIMING_SQL = f"""tim AS (SELECT user_id % 8 AS step, {STAGE_SQL} AS stage, sum(value) AS seconds FROM events GROUP BY ALL),
    tot AS (SELECT step, sum(len) AS rt, sum(len + prompt_len) AS alltok FROM smp GROUP BY step)"""


def timings(spark, sf):
    mapping = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    ev = table(spark, sf, "events").select((F.col("user_id") % 8).alias("step"), mapping[F.col("event_type")].alias("stage"), "value")
    return ev.groupBy("step", "stage").agg(F.sum("value").alias("seconds"))


@query(
    "step_timing_per_token",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}, {TIMING_SQL}
    SELECT step, stage, {sq("seconds", 4)} AS timing_s,
      {sq("CASE WHEN stage = 'gen' THEN seconds*1000/rt WHEN stage <> 'step' THEN seconds*1000/alltok END")} AS timing_per_token_ms
    FROM tim JOIN tot USING (step)""",
)
def step_timing_per_token(spark, sf):
    out = S.timing_metrics(timings(spark, sf), S.token_totals(trajectories(spark, sf)))
    return out.select("step", "stage", rnd("timing_s", 4).alias("timing_s"), rnd("timing_per_token_ms").alias("timing_per_token_ms"))


@query(
    "step_throughput",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}, {TIMING_SQL}
    SELECT step, CAST(alltok AS BIGINT) AS total_num_tokens, {sq("seconds", 4)} AS time_per_step, {sq("alltok/(seconds*4)")} AS throughput
    FROM tot JOIN tim USING (step) WHERE stage = 'step'""",
)
def step_throughput(spark, sf):
    seconds = timings(spark, sf).filter("stage = 'step'").select("step", "seconds")
    out = S.throughput(S.token_totals(trajectories(spark, sf)), seconds, 4)
    return out.select(
        "step", F.col("total_num_tokens").cast("long").alias("total_num_tokens"), rnd("time_per_step", 4).alias("time_per_step"), rnd("throughput").alias("throughput")
    )


@query(
    "step_variance_proxies",
    f"""{TA}, s AS (SELECT step, sample_id, sum(a*m)/(sum(m)+{E8}) AS a, sum((1-2*exp(old_lp)+sp2)*m) AS w FROM ta GROUP BY ALL)
    SELECT step, {sq("0.25")} AS proxy1_signal_strength, {sq("avg(a*a*greatest(w, 0))")} AS proxy2_total_power,
      {sq("greatest((avg(a*a*greatest(w, 0)) - 0.25)/(count(*)-1), 0)")} AS proxy3_pure_noise,
      {sq("avg(a*a)")} AS expected_a_squared, {sq("avg(w)")} AS expected_w FROM s GROUP BY step""",
)
def step_variance_proxies(spark, sf):
    return rounded(S.variance_proxies(credited(spark, sf), F.lit(0.5)))


@query(
    "step_variance_proxies_weighted",
    f"""{TA}, w AS (SELECT *, least(exp(greatest(least(old_lp-roll_lp, 20), -20))*m, 2) AS w FROM ta),
    s AS (SELECT step, sample_id, sum(a*m)/(sum(m)+{E8}) AS a, sum(w*m)/(sum(m)+{E8}) AS rho, sum((1-2*exp(old_lp)+sp2)*w*w*m) AS ww,
      greatest(sum((1-2*exp(old_lp)+sp2)*w*w/greatest(w*w, 1e-10)*m), 0) AS w0 FROM w GROUP BY ALL)
    SELECT step, {sq("avg(rho*rho*a*a*w0)")} AS proxy2_total_power, {sq("avg(ww)")} AS expected_w FROM s GROUP BY step""",
)
def step_variance_proxies_weighted(spark, sf):
    from ..operators.correction import importance_weights, with_log_ratio

    rows = importance_weights(with_log_ratio(credited(spark, sf)), "token", 2.0)
    out = S.variance_proxies(rows, is_weights="rollout_is_weights")
    return rounded(out.select("step", "proxy2_total_power", "expected_w"))


# --- metric logs ------------------------------------------------------------------------------------------------


@query(
    "metric_reduce_by_name",
    f"""WITH {METRICS_SQL} SELECT "interval", key, {sq("CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END")} AS value
    FROM log GROUP BY "interval", key""",
)
def metric_reduce_by_name(spark, sf):
    return S.reduce_by_name(metrics_log(spark, sf), ["interval"]).select("interval", "key", rnd("value").alias("value"))


@query(
    "metric_typed_aggregate",
    f"""WITH {METRICS_SQL}, a AS (SELECT key, ['mean','sum','min','max'][length(key) % 4 + 1] AS agg, value FROM log)
    SELECT key, agg, {sq("CASE agg WHEN 'mean' THEN avg(value) WHEN 'sum' THEN sum(value) WHEN 'min' THEN min(value) ELSE max(value) END", 4)} AS value
    FROM a GROUP BY key, agg""",
)
def metric_typed_aggregate(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("mean", "sum", "min", "max")])
    log = metrics_log(spark, sf).select("key", F.get(kinds, F.length("key") % 4).alias("agg"), "value")
    return S.aggregate_typed(log).select("key", "agg", rnd("value", 4).alias("value"))


ROLLUP_SQL = f"""WITH {METRICS_SQL}, roll AS (SELECT "interval", key, CASE
      WHEN key = 'perf/time_per_step' THEN sum(value) WHEN key = 'timing_s/agent_loop/tool_calls/max' THEN max(value)
      WHEN key = 'fully_async/count/current_param_version' THEN arg_max(value, (ts, event_id))
      WHEN contains(lower(key), 'timing_s/') THEN sum(value) WHEN regexp_matches(lower(key), 'mean|avg|average') THEN avg(value)
      WHEN contains(lower(key), 'max') THEN max(value) WHEN contains(lower(key), 'min') THEN min(value)
      WHEN regexp_matches(lower(key), 'sum|total') THEN sum(value) ELSE avg(value) END AS value FROM log GROUP BY "interval", key)"""


@query("metric_interval_rollup", f'{ROLLUP_SQL} SELECT "interval", key, {sq("value", 4)} AS value FROM roll')
def metric_interval_rollup(spark, sf):
    out = S.interval_rollup(metrics_log(spark, sf), ["interval"], ["ts", "event_id"])
    return out.select("interval", "key", rnd("value", 4).alias("value"))


@query(
    "metric_interval_derived",
    f"""{ROLLUP_SQL}, p AS (SELECT "interval", max(value) FILTER (key = 'global_seqlen/max') - max(value) FILTER (key = 'global_seqlen/min') AS d,
      max(value) FILTER (key = 'perf/total_num_tokens') / (max(value) FILTER (key = 'perf/time_per_step') * 8) AS tp,
      max(value) FILTER (key = 'timing_s/gen') / max(value) FILTER (key = 'timing_s/step') AS idle FROM roll GROUP BY "interval")
    SELECT "interval", key, {sq("CASE key WHEN 'global_seqlen/minmax_diff' THEN d WHEN 'perf/throughput' THEN tp ELSE value END", 4)} AS value
    FROM roll JOIN p USING ("interval") UNION ALL SELECT "interval", 'trainer/idle_ratio', {sq("idle", 4)} FROM p""",
)
def metric_interval_derived(spark, sf):
    rolled = S.interval_rollup(metrics_log(spark, sf), ["interval"], ["ts", "event_id"])
    return S.derived_rollup(rolled, ["interval"], 8).select("interval", "key", rnd("value", 4).alias("value"))


@query(
    "batch_assembly_stats",
    f"""WITH {STREAM_SQL} SELECT batch, {sq("avg(processing_time)")} AS processing_time_avg, {sq("max(processing_time)")} AS processing_time_max,
      {sq("min(processing_time)")} AS processing_time_min, {sq("max(tool_call_time)")} AS tool_calls_max, {sq("min(tool_call_time)")} AS tool_calls_min,
      {sq("avg(tool_call_time)")} AS tool_calls_mean, {sq("count(*) FILTER (param_version_start <> param_version_end)")} AS total_partial_num,
      {sq("avg((param_version_start <> param_version_end)::INT)")} AS partial_ratio, {sq("max(param_version_end - param_version_start)")} AS max_partial_span,
      {sq("quantile_cont(processing_time, 0.5)")} AS tp50, {sq("quantile_cont(processing_time, 0.95)")} AS tp95,
      {sq("quantile_cont(processing_time, 0.99)")} AS tp99, {sq("count(DISTINCT param_version)")} AS version_diversity FROM st GROUP BY batch""",
)
def batch_assembly_stats(spark, sf):
    return rounded(S.assembly_stats(rollout_stream(spark, sf), ["batch"]), ("batch",))


@query(
    "agent_loop_timing",
    f"""WITH {STREAM_SQL}, s AS (SELECT batch, processing_time AS g, tool_call_time AS c, length(queue) AS pl, sample_id % 100 AS rl,
        row_number() OVER (PARTITION BY batch ORDER BY processing_time + tool_call_time DESC, sample_id) AS rk FROM st)
    SELECT batch, {", ".join(f"{sq(fn + '(' + e + ')')} AS {c}_{k}" for e, c in (("g", "generate_sequences"), ("c", "tool_calls")) for k, fn in (("min", "min"), ("max", "max"), ("mean", "avg")))},
      {sq("max(g) FILTER (rk = 1)")} AS slowest_generate_sequences, {sq("max(c) FILTER (rk = 1)")} AS slowest_tool_calls,
      {sq("max(pl) FILTER (rk = 1)")} AS slowest_prompt_length, {sq("max(rl) FILTER (rk = 1)")} AS slowest_response_length FROM s GROUP BY batch""",
)
def agent_loop_timing(spark, sf):
    rows = rollout_stream(spark, sf).select(
        "batch",
        F.col("processing_time").alias("generate_sequences"),
        F.col("tool_call_time").alias("tool_calls"),
        F.length("queue").alias("prompt_length"),
        (F.col("sample_id") % 100).alias("response_length"),
        F.col("sample_id").alias("pos"),
    )
    return rounded(S.agent_timing(rows, ["batch"]), ("batch",))


@query(
    "staleness_counts",
    f"""WITH {STREAM_SQL} SELECT batch, count(*) FILTER (10 - param_version >= 1) AS stale_samples_processed,
      count(*) FILTER (10 - param_version_end >= 1) AS stale_trajectory_processed, CAST(10 AS INTEGER) AS current_param_version FROM st GROUP BY batch""",
)
def staleness_counts(spark, sf):
    return S.staleness_counts(rollout_stream(spark, sf), F.lit(10), ["batch"])


DENSE = dict(
    model_type="qwen2", hidden_size=896, vocab_size=151936, num_hidden_layers=24, num_key_value_heads=2, num_attention_heads=14, intermediate_size=4864
)
SLIDING = dict(
    model_type="gemma3_text", hidden_size=1152, vocab_size=262144, num_hidden_layers=26, num_key_value_heads=1, num_attention_heads=4,
    intermediate_size=6912, head_dim=256, sliding_window=512,
)


def lengths(spark, sf):
    return trajectories(spark, sf).select(
        "step", ((F.size("response_mask") + F.col("prompt_len")) * 40).alias("length"), F.lit(2.5).alias("seconds")
    )


LEN_SQL = f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}, l AS (SELECT step, CAST((len + prompt_len)*40 AS DOUBLE) AS n FROM smp)"""


@query(
    "achieved_flops_dense",
    f"""{LEN_SQL} SELECT step, {sq("tf")} AS tflops, {sq("tf/989")} AS mfu FROM (SELECT step,
      (6.0::DOUBLE*((896*4864*3 + 896*(896+128+128+896))*24 + 151936*896*2)*sum(n) + 12.0::DOUBLE*sum(n*n)*64*14*24)/2.5::DOUBLE/1e12::DOUBLE AS tf FROM l GROUP BY step)""",
)
def achieved_flops_dense(spark, sf):
    return rounded(S.achieved_flops(lengths(spark, sf), DENSE, 989.0))


@query(
    "achieved_flops_sliding",
    f"""{LEN_SQL} SELECT step, {sq("tf")} AS tflops, {sq("tf/989")} AS mfu FROM (SELECT step,
      (6.0::DOUBLE*((1152*6912*3 + 1152*(1024+256+256+1024))*26 + 262144*1152*2)*sum(n) + 12.0::DOUBLE*(sum(n*n)*4 + sum(n*least(n, 512))*22)*256*4)/2.5::DOUBLE/1e12::DOUBLE AS tf FROM l GROUP BY step)""",
)
def achieved_flops_sliding(spark, sf):
    return rounded(S.achieved_flops(lengths(spark, sf), SLIDING, 989.0))


VISION_EXPERTS = dict(
    model_type="qwen3_vl_moe",
    text_config=dict(
        hidden_size=2048, vocab_size=151936, num_hidden_layers=48, num_key_value_heads=4, num_attention_heads=32, head_dim=128,
        moe_intermediate_size=768, num_experts=128, num_experts_per_tok=8,
    ),
)


@query(
    "achieved_flops_experts",
    f"""{LEN_SQL} SELECT step, {sq("tf")} AS tflops, {sq("tf/989")} AS mfu FROM (SELECT step,
      (6.0::DOUBLE*((2048*768*8*3 + 2048*128 + 2048*(4096+512+512+4096))*48::BIGINT + 151936*2048*2::BIGINT)*sum(n) + 12.0::DOUBLE*sum(n*n)*128*32*48)/2.5::DOUBLE/1e12::DOUBLE AS tf FROM l GROUP BY step)""",
)
def achieved_flops_experts(spark, sf):
    return rounded(S.achieved_flops(lengths(spark, sf), VISION_EXPERTS, 989.0))


@query("achieved_flops_unknown", f"{LEN_SQL} SELECT step, 0.0::DOUBLE AS tflops, 0.0::DOUBLE AS mfu FROM l GROUP BY step")
def achieved_flops_unknown(spark, sf):
    return rounded(S.achieved_flops(lengths(spark, sf), {**DENSE, "model_type": "unlisted"}, 989.0))
