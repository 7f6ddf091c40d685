"""Canonical tables derived from the provided star-schema, event and text tables.

The provided data holds no trajectories; each canonical table is a fixed projection of it, written so
that SQL can state the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with at least one line; its lines are the response tokens.

    Only the lines' sort and value columns are read.  Lines meet by order key once, before grouping
    (collecting them first on the map side would shrink nothing); the orders side joins on the same key,
    so the grouped lines are not shuffled a second time.  A response is bounded by the token budget of
    its run, so one row per response is the unit everywhere.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", *LINE_ORDER)
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER))).alias("tok"))
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    n = F.size("tok")

    def tokens(expr):
        return F.transform("tok", expr)

    score = F.sqrt("o_totalprice") / F.lit(100.0)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 8).alias("step"),
        F.col("o_orderpriority").alias("data_source"),
        F.col("o_custkey").alias("uid"),
        F.col("o_orderkey").alias("sample_id"),
        (F.col("o_custkey") % 50 + 10).cast("int").alias("prompt_len"),
        F.lit(59).alias("max_prompt_len"),
        F.lit(16).alias("max_response_len"),
        tokens(lambda t: F.when(t["l_linestatus"] == "O", 1).otherwise(0)).alias("response_mask"),
        F.transform("tok", lambda t, i: F.when(i == n - 1, score).otherwise(F.lit(0.0))).alias("token_level_scores"),
        tokens(lambda t: -(t["l_discount"] * 10 + 0.05)).alias("old_log_probs"),
        tokens(lambda t: -(t["l_tax"] * 10 + 0.05)).alias("rollout_log_probs"),
        tokens(lambda t: -(t["l_discount"] + t["l_tax"]) * 5).alias("ref_log_prob"),
        tokens(lambda t: -(t["l_discount"] * 8 + t["l_tax"] * 2 + 0.05)).alias("log_probs"),
        tokens(lambda t: t["l_quantity"] / 50).alias("values"),
        tokens(lambda t: t["l_quantity"] / 100).alias("entropys"),
        # At least the square of the sampled token's probability, as a sum of squares must be.
        tokens(lambda t: F.exp(-(t["l_discount"] * 10 + 0.05) * 2) + t["l_tax"]).alias("sum_pi_squared"),
        score.alias("score"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("acc"),
        (F.col("o_custkey") % 100 / F.lit(50.0)).alias("reward_baseline"),
        (F.col("o_orderkey") % 5 + 1).alias("num_turns"),
        (F.col("o_orderkey") % 3).alias("tool_call_counts"),
        (F.col("o_orderkey") % 10).alias("param_version_start"),
        (F.col("o_orderkey") % 10 + F.col("o_custkey") % 3).alias("param_version_end"),
    )


def response_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `trajectories` with the number of their tokens, of which nothing but the order key is read."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").repartition("l_orderkey")
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("response_size"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sizes.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 8).alias("step"),
        F.col("o_custkey").alias("uid"),
        F.col("o_orderkey").alias("sample_id"),
        (F.col("o_custkey") % 50 + 10).cast("int").alias("prompt_len"),
        "response_size",
    )


# The same rows for DuckDB, one per token.
TOKENS_SQL = """
tok AS (
  SELECT o_custkey % 8 AS step, o_orderpriority AS data_source, o_custkey AS uid, o_orderkey AS sample_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_discount, l_tax, l_linestatus) - 1 AS INTEGER) AS pos,
    CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS len,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS m,
    -(l_discount*10 + 0.05::DOUBLE) AS old_lp,
    -(l_tax*10 + 0.05::DOUBLE) AS roll_lp,
    -(l_discount + l_tax) * 5 AS ref_lp,
    -(l_discount*8 + l_tax*2 + 0.05::DOUBLE) AS lp,
    l_quantity/50 AS val, l_quantity/100 AS ent, exp(-(l_discount*10 + 0.05::DOUBLE)*2) + l_tax AS sp2,
    sqrt(o_totalprice)/100.0::DOUBLE AS score,
    CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc,
    o_custkey % 100 / 50.0::DOUBLE AS base,
    o_custkey % 50 + 10 AS prompt_len, o_orderkey % 5 + 1 AS num_turns, o_orderkey % 3 AS tool_calls,
    o_orderkey % 10 AS v_start, o_orderkey % 10 + o_custkey % 3 AS v_end
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT *, CASE WHEN pos = len - 1 THEN score ELSE 0.0::DOUBLE END AS r FROM tok)"""

SAMPLES_SQL = """
smp AS (
  SELECT step, data_source, uid, sample_id, score, acc, base, prompt_len, num_turns, tool_calls, v_start, v_end,
    CAST(len AS BIGINT) AS len, CAST(sum(m) AS BIGINT) AS n_valid
  FROM t GROUP BY ALL)"""


# --- event-based tables ----------------------------------------------------------------------------------

# Metric names given to events by `event_id % 12`.
METRIC_NAMES = [
    "timing_s/gen",
    "timing_s/step",
    "global_seqlen/min",
    "global_seqlen/max",
    "global_seqlen/minmax_diff",
    "perf/throughput",
    "perf/total_num_tokens",
    "perf/time_per_step",
    "critic/score/mean",
    "fully_async/count/current_param_version",
    "timing_s/agent_loop/tool_calls/max",
    "reward/terminal_total",
]


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric log: the user is the step, twenty steps make an interval."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    names = F.array(*[F.lit(n) for n in METRIC_NAMES])
    return ev.select(
        F.col("user_id").alias("step"),
        F.floor(F.col("user_id") / 20).alias("interval"),
        F.get(names, (F.col("event_id") % 12).cast("int")).alias("key"),
        "value",
        "ts",
        "event_id",
    )


METRICS_SQL = f"""log AS (SELECT user_id AS step, user_id // 20 AS "interval",
  {METRIC_NAMES!r}[event_id % 12 + 1] AS key, value, ts, event_id FROM events)"""


def rollout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed samples: event type is the queue, `props.k` the tool time and version lag."""
    ev = table(spark, sf_dir, "events")
    return stream_columns(ev)


def stream_columns(ev: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    version = F.floor(F.col("event_id") / 500)
    return ev.select(
        F.col("event_type").alias("queue"),
        F.col("event_id").alias("sample_id"),
        "ts",
        F.col("value").alias("processing_time"),
        (k / F.lit(10.0)).alias("tool_call_time"),
        version.alias("param_version"),
        (version - k % 3).alias("param_version_start"),
        version.alias("param_version_end"),
        (F.col("user_id") % 8).alias("batch"),
    )


STREAM_SQL = """st AS (SELECT event_type AS queue, event_id AS sample_id, ts, value AS processing_time,
  CAST(json_extract_string(props, '$.k') AS BIGINT)/10.0::DOUBLE AS tool_call_time, event_id // 500 AS param_version,
  event_id // 500 - CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS param_version_start,
  event_id // 500 AS param_version_end, user_id % 8 AS batch FROM events)"""


def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated responses per prompt: one order is one response to its customer's prompt."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("src"), F.col("o_custkey") % 5).alias("data_source"),
        F.col("o_custkey").alias("uid"),
        F.col("o_orderkey").alias("sample_id"),
        (F.sqrt("o_totalprice") / F.lit(100.0)).alias("reward"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("acc"),
        F.col("o_orderstatus").alias("pred"),
        (F.col("o_orderkey") % 5 + 1).alias("num_turns"),
    )


VALIDATION_SQL = """val AS (SELECT 'src' || (o_custkey % 5) AS data_source, o_custkey AS uid, o_orderkey AS pos,
    o_orderstatus AS pred, v.var, v.value FROM orders,
    LATERAL (VALUES ('reward', sqrt(o_totalprice)/100.0::DOUBLE), ('acc', CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) v(var, value))"""


# --- text tables -------------------------------------------------------------------------------------------

ANSWER_FORMS = 10


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per document: its text as the reasoning, closed by an answer in one of ten layouts."""
    d = table(spark, sf_dir, "documents")
    gold = F.col("n_chars") % 97
    p = F.when(F.col("doc_id") % 3 == 0, gold + 1).otherwise(gold).cast("string")
    text, src = F.col("text"), F.col("source")
    forms = [
        F.concat(F.lit("<think>"), text, F.lit("</think>\nFinal answer: "), p),
        F.concat(text, F.lit(" The answer is "), p, F.lit(".")),
        F.concat(F.lit("<think>"), text, F.lit("</think>Answer: "), p, F.lit("/1")),
        F.concat(F.lit("Final answer: <think>"), text, F.lit("</think> Final answer: \\frac{"), p, F.lit("}{1}<end_of_turn>")),
        F.concat(text, F.lit("\n#### 1,"), p),
        F.concat(text, F.lit("\nAnswer: $\\boxed{"), p, F.lit("}$ units")),
        F.concat(F.lit("<answer>the "), src, F.lit("</answer>"), text, F.lit("<answer>A "), src, F.lit(", "), p, F.lit(".</answer>")),
        text,
        F.concat(F.lit("<think>"), text, F.lit("</think> so \\boxed{\\frac{"), p, F.lit("}2}")),
        F.concat(text, F.lit(" Final answer: "), p, F.lit("</think>\nAnswer: x = 0.5")),
    ]
    which = (F.col("doc_id") % ANSWER_FORMS).cast("int")
    output = F.when(which == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        output = output.when(which == i, form)
    return d.select("doc_id", "source", "lang", gold.cast("string").alias("gold"), output.alias("output"))


RESPONSES_SQL = """res0 AS (SELECT doc_id, source, lang, text, CAST(n_chars % 97 AS VARCHAR) AS gold,
    CAST(CASE WHEN doc_id % 3 = 0 THEN n_chars % 97 + 1 ELSE n_chars % 97 END AS VARCHAR) AS p FROM documents),
  res AS (SELECT doc_id, source, lang, gold, CASE doc_id % 10
    WHEN 0 THEN '<think>' || text || '</think>' || chr(10) || 'Final answer: ' || p
    WHEN 1 THEN text || ' The answer is ' || p || '.'
    WHEN 2 THEN '<think>' || text || '</think>Answer: ' || p || '/1'
    WHEN 3 THEN 'Final answer: <think>' || text || '</think> Final answer: \\frac{' || p || '}{1}<end_of_turn>'
    WHEN 4 THEN text || chr(10) || '#### 1,' || p
    WHEN 5 THEN text || chr(10) || 'Answer: $\\boxed{' || p || '}$ units'
    WHEN 6 THEN '<answer>the ' || source || '</answer>' || text || '<answer>A ' || source || ', ' || p || '.</answer>'
    WHEN 7 THEN text
    WHEN 8 THEN '<think>' || text || '</think> so \\boxed{\\frac{' || p || '}2}'
    ELSE text || ' Final answer: ' || p || '</think>' || chr(10) || 'Answer: x = 0.5' END AS output FROM res0)"""


REFERENCE_CODE = "def solve(lines):\n    return int(lines[0])"


def code_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code-repair response per order: three doubling tests and one of eight kinds of answer."""
    # Two numbers per row are spread before the text is built, so that parsing it uses every core even
    # when the input is a single row group.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")
    k = [(F.col("o_orderkey") + i).cast("string") for i in range(3)]
    twice = [((F.col("o_orderkey") + i) * 2).cast("string") for i in range(3)]

    def asserts(values):
        lines = [F.concat(F.lit("assert str(solve(['"), a, F.lit("'])).strip() == '"), b, F.lit("'")) for a, b in zip(k, values)]
        return F.concat_ws("\n", *lines)

    def block(code):
        return F.concat(F.lit("\n```python\n"), code, F.lit("\n```"))

    table_lines = F.concat_ws(
        "\n", *[F.concat(F.lit("    if lines == ['"), a, F.lit("']: return '"), b, F.lit("'")) for a, b in zip(k, twice)]
    )
    good = F.lit("def solve(lines):\n    return 2*int(lines[0])")
    head, gap = F.lit("def solve(lines):\n"), F.lit("\n\n")
    kinds = [
        F.concat(F.lit("<think>double it</think>"), block(F.concat(good, gap, asserts(twice)))),
        F.concat(F.lit("<think>I will change the tests to pass</think>"), block(F.concat(F.lit(REFERENCE_CODE), gap, asserts(k)))),
        F.concat(F.lit("<think>fix</think>"), block(good)),
        F.concat(F.lit("<think>hardcode it:\n"), table_lines, F.lit("</think>"), block(F.concat(head, table_lines, gap, asserts(twice)))),
        F.concat(
            F.lit("<think>a table</think>"),
            block(F.concat(head, table_lines, F.lit("\n    return 2*int(lines[0])"), gap, asserts(twice))),
        ),
        F.concat(F.lit("<think>hm</think>"), block(F.lit("def solve(lines)\n    return 1"))),
        F.lit("I cannot do this"),
        F.concat(F.lit("<think>cheat</think>"), block(F.concat(F.lit("import sys\n" + REFERENCE_CODE + "\nsys.exit(0)\n"), asserts(twice)))),
    ]
    v = F.col("o_orderkey") % 8
    output = F.when(v == 0, kinds[0])
    for i, kind in enumerate(kinds[1:], 1):
        output = output.when(v == i, kind)
    truth = F.to_json(
        F.struct(
            F.array(*k).alias("visible_inputs"),
            F.array(*twice).alias("visible_outputs"),
            F.array(k[0]).alias("hidden_inputs"),
            F.array(twice[0]).alias("hidden_outputs"),
        )
    )
    return o.select(
        F.col("o_orderkey").alias("uid"),
        (F.col("o_custkey") % 8).alias("step"),
        v.alias("kind"),
        F.concat(F.lit("```python\n" + REFERENCE_CODE + "\n\n"), asserts(twice), F.lit("\n```")).alias("prompt"),
        output.alias("output"),
        truth.alias("ground_truth"),
        F.lit(REFERENCE_CODE).alias("reference_solution"),
        v.isin(0, 1, 3, 4, 7).alias("returned_assertions_pass"),
        F.when(v.isin(0, 4), 1.0).otherwise(0.0).alias("hidden_pass_rate"),
        v.isin(0, 2, 4).alias("passed"),
    )


def hint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hinted question and its response per document."""
    d = table(spark, sf_dir, "documents")
    i, g = F.col("doc_id"), F.col("n_chars") % 97 + 1
    hint = F.when(i % 2 == 0, g).otherwise(g + 7)
    answer = F.when(i % 4 == 1, hint).when(i % 4 == 2, g + 1).otherwise(g)
    said = F.when(i % 3 == 0, " The Professor guessed it").when(i % 3 == 1, F.concat(F.lit(" so "), hint, F.lit(" fits"))).otherwise("")
    asked = F.when(i % 7 == 0, "").otherwise(F.concat(F.lit(" A Stanford professor guessed "), hint, F.lit(".")))
    return d.select(
        "doc_id",
        "source",
        F.concat("text", asked, F.lit("\n\nPlease reason")).alias("question"),
        F.concat(F.lit("<think>"), "text", said, F.lit("</think>\nFinal answer: "), answer).alias("output"),
        g.cast("string").alias("gold"),
    )


HINT_SQL = """h0 AS (SELECT doc_id, source, text, n_chars % 97 + 1 AS g, n_chars % 97 + 1 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 7 END AS hint FROM documents),
  h1 AS (SELECT *, CASE doc_id % 4 WHEN 1 THEN hint WHEN 2 THEN g + 1 ELSE g END AS ans, doc_id % 7 <> 0 AS has_hint,
    text || CASE doc_id % 3 WHEN 0 THEN ' The Professor guessed it' WHEN 1 THEN ' so ' || hint || ' fits' ELSE '' END AS cot FROM h0)"""


def token_distributions(spark: SparkSession, sf_dir: str, conditions: list[str]) -> DataFrame:
    """Embeddings as logits over 64 tokens: neighbouring vectors are the conditions and positions of a sample."""
    n = len(conditions)
    e = table(spark, sf_dir, "embeddings")
    sample = F.floor(F.col("vec_id") / (n * 4))
    pos = (F.floor(F.col("vec_id") / n) % 4).cast("int")
    return e.select(
        sample.alias("sample_id"),
        F.get(F.array(*[F.lit(c) for c in conditions]), (F.col("vec_id") % n).cast("int")).alias("condition"),
        pos.alias("pos"),
        F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"),
        (F.abs(F.col("label")) % 64).cast("int").alias("label_id"),
        ((pos >= 2) & (sample % 5 != 0)).alias("is_answer"),
    )


def distributions_sql(conditions: list[str]) -> str:
    n = len(conditions)
    return f"""v0 AS (SELECT vec_id // {n * 4} AS sample_id, {conditions!r}[vec_id % {n} + 1] AS condition, CAST(vec_id // {n} % 4 AS INTEGER) AS pos,
      abs(label) % 64 AS label_id, unnest(range(64)) AS tok, unnest(embedding)::DOUBLE * 10 AS x FROM embeddings),
    v1 AS (SELECT *, x - ln(sum(exp(x)) OVER (PARTITION BY sample_id, condition, pos)) AS lp FROM v0)"""
