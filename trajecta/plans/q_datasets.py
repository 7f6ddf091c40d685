"""Dataset conversion and filter queries."""


from pyspark.sql import functions as F

from ..derive import RESPONSES_SQL, SAMPLES_SQL, TOKENS_SQL, code_rollouts, responses, table, trajectories
from ..operators import behaviour as H
from ..operators import datasets as D
from ..operators import filters as L
from ..operators.sequences import tokens
from .q_batches import messages
from .q_behaviour import CODE
from .q_rewards import lit, q_strip
from .registry import query, rnd, sq

NL = "chr(10)"


def problems(spark, sf):
    """One repair problem per order with 1 to 30 tests."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    n = (F.col("o_orderkey") % 30 + 1).cast("int")
    steps = F.sequence(F.lit(1), n)
    ins = F.transform(steps, lambda i: F.concat((F.col("o_orderkey") + i).cast("string"), F.lit("\nx")))
    outs = F.transform(steps, lambda i: ((F.col("o_orderkey") + i) * 2).cast("string"))
    return o.select(
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderkey").alias("solution_index"),
        F.lit("def solve(lines):\n    return 0\n").alias("transformed_solution"),
        ins.alias("test_inputs"),
        outs.alias("test_outputs"),
        F.when(F.col("o_custkey") % 2 == 0, F.transform(steps, lambda i: F.when(i != 2, F.lit("0")))).alias("buggy_outputs"),
    )


PROBLEMS = f"""p0 AS (SELECT o_orderpriority AS name, o_orderkey AS k, o_orderkey % 30 + 1 AS n, o_custkey % 2 = 0 AS known FROM orders),
  p1 AS (SELECT *, list_transform(range(1, n + 1), lambda i: (k + i) || {NL} || 'x') AS ins, list_transform(range(1, n + 1), lambda i: CAST(2*(k + i) AS VARCHAR)) AS outs,
    CASE WHEN n >= 24 THEN 8 ELSE greatest(1, n // 2) END AS shown, CASE WHEN n >= 24 THEN n - 15 ELSE greatest(1, n // 2) + 1 END AS start FROM p0),
  p2 AS (SELECT *, ins[:shown] AS vi, outs[:shown] AS vo, ins[start:] AS hi, outs[start:] AS ho FROM p1)"""
PREVIEW = f"array_to_string(list_transform(range(1, len(vi) + 1), lambda i: 'Test ' || i || ':' || {NL} || '  Input: ' || string_split(vi[i], {NL})[1] || {NL} || '  Output: ' || vo[i]), {NL} || {NL})"
ASSERTS = f"""array_to_string(list_transform(range(1, len(vi) + 1), lambda i: 'assert str(solve([''' || string_split(vi[i], {NL})[1] || ''', ''x''])).strip() == ''' || vo[i] || ''''
   || CASE WHEN known THEN '  # expected: ''' || vo[i] || ''', got: ' || CASE WHEN i = 2 THEN '''<error>''' ELSE '''0''' END ELSE '' END), {NL})"""


def template_sql(template, **slots):
    out = lit(template)
    for name, expr in slots.items():
        out = f"replace({out}, {lit('{' + name + '}')}, {expr})"
    return out


SOLUTION = lit("def solve(lines):\n    return 0")


@query("dataset_test_preview", f"WITH {PROBLEMS} SELECT k AS solution_index, {PREVIEW} AS preview FROM p2")
def dataset_test_preview(spark, sf):
    vi, vo, _, _ = D.split_tests("test_inputs", "test_outputs")
    return problems(spark, sf).select("solution_index", D.test_preview(vi, vo).alias("preview"))


@query(
    "dataset_code_repair",
    f"""WITH {PROBLEMS} SELECT 'codecontests_' || name || '_' || k AS uid, CAST(len(vi) AS INTEGER) AS num_visible_tests, CAST(len(hi) AS INTEGER) AS num_hidden_tests,
      CAST(to_json({{'inputs': hi, 'outputs': ho}}) AS VARCHAR) AS ground_truth, {template_sql(D.REPAIR_PROMPT, buggy_code=SOLUTION, test_assertions=PREVIEW)} AS content FROM p2""",
)
def dataset_code_repair(spark, sf):
    out = D.code_repair(problems(spark, sf))
    return out.select(
        "uid",
        "extra_info.num_visible_tests",
        "extra_info.num_hidden_tests",
        "reward_model.ground_truth",
        F.get("messages", F.lit(0))["content"].alias("content"),
    )


@query(
    "dataset_code_assertions",
    f"""WITH {PROBLEMS} SELECT 'codecontests_hacking_' || name || '_' || k AS uid, CAST(n AS INTEGER) AS total_tests,
      CAST(to_json({{'visible_inputs': vi, 'visible_outputs': vo, 'hidden_inputs': hi, 'hidden_outputs': ho}}) AS VARCHAR) AS ground_truth,
      {template_sql(D.ASSERTION_PROMPT.replace("{extra}", D.NO_TABLE_NOTE), buggy_code=SOLUTION, test_assertions=ASSERTS)} AS content FROM p2""",
)
def dataset_code_assertions(spark, sf):
    out = D.code_assertions(problems(spark, sf))
    return out.select(
        "uid", "extra_info.total_tests", "reward_model.ground_truth", F.get("messages", F.lit(0))["content"].alias("content")
    )


@query("dataset_seeded_split")
def dataset_seeded_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    return D.seeded_split(rows, "o_orderkey", {"val": 100, "test": 100}).select("o_orderkey", "split")


@query(
    "dataset_seeded_split_sizes",
    "SELECT split, n FROM (SELECT unnest(['val', 'test', 'train']) AS split, unnest([100, 100, count(*) - 200]) AS n FROM orders)",
)
def dataset_seeded_split_sizes(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    out = D.seeded_split(rows, "o_orderkey", {"val": 100, "test": 100})
    return out.groupBy("split").agg(F.count_distinct("o_orderkey").alias("n"))


@query(
    "dataset_math_prompts",
    f"SELECT 'dapo_math_' || doc_id AS uid, {q_strip('text')} || {lit(D.BOXED_REQUEST)} AS content, CAST(n_chars AS VARCHAR) AS ground_truth FROM documents",
)
def dataset_math_prompts(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit(D.QUESTION_PREFIX), "text", F.lit(D.QUESTION_SUFFIX)).alias("raw"), F.col("n_chars").cast("string").alias("answer")
    )
    out = D.math_prompts(d, "raw", "answer", "doc_id")
    return out.select("uid", F.get("messages", F.lit(0))["content"].alias("content"), "reward_model.ground_truth")


@query(
    "dataset_format_variants",
    " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS variant, {q_strip('text')} || {lit(t)} AS content FROM documents" for n, t in D.FORMAT_REQUESTS.items()
    ),
)
def dataset_format_variants(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(D.BOXED_REQUEST)).alias("content"))
    return D.format_variants(d, "content", ["doc_id"])


@query(
    "dataset_hints",
    f"""WITH a AS (SELECT doc_id, text, n_chars % 1200 AS g FROM documents), b AS (SELECT *, unnest(['correct', 'wrong']) AS hint_type FROM a WHERE g BETWEEN 1 AND 999)
    SELECT doc_id, hint_type, CASE WHEN hint_type = 'correct' THEN text || ' A Stanford professor guessed ' || g || '.' || {lit(D.BOXED_REQUEST)} END AS content, true AS hint_ok FROM b""",
)
def dataset_hints(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.lit(D.BOXED_REQUEST)).alias("content"),
        F.col("text").alias("question"),
        (F.col("n_chars") % 1200).cast("string").alias("answer"),
    )
    out = D.hinted(d, "content", "answer", "question", "doc_id")
    right = F.col("hint_type") == "correct"
    fits = F.col("hint").cast("int").between(1, 999) & ((F.col("hint") == F.col("answer")) == right)
    return out.select("doc_id", "hint_type", F.when(right, F.col("content")).alias("content"), fits.alias("hint_ok"))


@query(
    "dataset_grade_school",
    f"""SELECT doc_id AS index, text || ' ' || {lit(D.STEP_INSTRUCTION)} AS content, replace(regexp_extract(text || '#### 1,' || n_chars, '#### (-?[0-9.,]+)', 1), ',', '') AS ground_truth,
      replace(regexp_extract(text || '#### 1,' || n_chars, '#### (-?[0-9.,]+)', 1), ',', '') AS tool_truth FROM documents""",
)
def dataset_grade_school(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("index"), F.col("text").alias("question"), F.concat("text", F.lit("#### 1,"), "n_chars").alias("answer")
    )
    out = D.grade_school(d, "train", tools=True)
    return out.select(
        "extra_info.index",
        F.get("prompt", F.lit(0))["content"].alias("content"),
        "reward_model.ground_truth",
        F.col("extra_info.tools_kwargs.calc_reward.create_kwargs.ground_truth").alias("tool_truth"),
    )


@query(
    "dataset_competition_math",
    f"SELECT doc_id AS index, '\\frac{{' || n_chars || '}}{{2}}' AS ground_truth, text || ' ' || {lit(D.BOX_INSTRUCTION)} AS content FROM documents",
)
def dataset_competition_math(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("index"),
        F.col("text").alias("problem"),
        F.concat("text", F.lit(" so \\boxed{1} or \\boxed{\\frac{"), "n_chars", F.lit("}{2}}")).alias("solution"),
    )
    out = D.competition(d, "train")
    return out.select("extra_info.index", "reward_model.ground_truth", F.get("prompt", F.lit(0))["content"].alias("content"))


def clean_sql(x):
    return f"replace(regexp_replace(replace({q_strip(x)}, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')"


@query(
    "dataset_sentence_completion",
    f"""SELECT doc_id AS index, {clean_sql("source || ': ' || text || ' [title] ' || 'Src' || substr(source, 4)")} AS content, CAST(doc_id % 4 AS INTEGER) AS ground_truth,
      {clean_sql("' [title]' || source || ' [x] end'")} AS first_choice FROM documents WHERE doc_id % 3 <> 0""",
)
def dataset_sentence_completion(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("index"),
        F.col("source").alias("activity_label"),
        F.concat("text", F.lit(" [title]")).alias("ctx_a"),
        F.upper("source").alias("ctx_b"),
        F.array(F.concat(F.lit(" [title]"), "source", F.lit(" [x] end")), F.lit("b")).alias("endings"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise((F.col("doc_id") % 4).cast("string")).alias("label"),
    )
    out = D.completion_choices(d, "train")
    return out.select(
        "extra_info.index",
        F.get("prompt", F.lit(0))["content"].alias("content"),
        "reward_model.ground_truth",
        F.get("reward_model.choices", F.lit(0)).alias("first_choice"),
    )


def preferences(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("index"),
        F.col("c_name").alias("prompt"),
        F.col("c_mktsegment").alias("chosen"),
        F.lower("c_mktsegment").alias("rejected"),
        F.col("c_mktsegment").alias("response"),
    )


@query(
    "dataset_preference_sft",
    "SELECT c_name AS prompt, c_mktsegment AS response FROM customer UNION ALL SELECT c_name, lower(c_mktsegment) FROM customer",
)
def dataset_preference_sft(spark, sf):
    return D.preference_to_sft(preferences(spark, sf))


@query(
    "dataset_preference_pairs",
    "SELECT c_custkey AS index, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= floor(count(*) OVER () * 0.75) THEN 'train' ELSE 'test' END AS split FROM customer",
)
def dataset_preference_pairs(spark, sf):
    return D.preference_to_pairs(preferences(spark, sf), "index").select("index", "split")


@query(
    "dataset_preference_rl",
    "SELECT c_custkey AS index, 'user' AS role, c_name AS content, 'model' AS style, c_mktsegment AS ground_truth FROM customer",
)
def dataset_preference_rl(spark, sf):
    out = D.preference_to_rl(preferences(spark, sf))
    turn = F.get("prompt", F.lit(0))
    return out.select(
        "extra_info.index", turn["role"].alias("role"), turn["content"].alias("content"), "reward_model.style", "reward_model.ground_truth"
    )


@query(
    "dataset_search_questions",
    """SELECT c_custkey AS index, 'searchR1_' || lower(c_mktsegment) AS data_source, 'Answer: ' || c_name AS content,
      CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey ELSE c_name END AS truth FROM customer""",
)
def dataset_search_questions(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("index"),
        F.col("c_name").alias("question"),
        F.lower("c_mktsegment").alias("data_source"),
        F.when(F.col("c_custkey") % 2 == 0, F.struct(F.array(F.concat(F.lit("T"), "c_custkey")).alias("ground_truth"))).alias("reward_model"),
        F.array("c_name").alias("golden_answers"),
    )
    out = D.search_questions(rows, "train", "You are a helpful and harmless assistant.", "Answer: \n")
    return out.select(
        "extra_info.index",
        "data_source",
        F.get("prompt", F.lit(1))["content"].alias("content"),
        F.get("extra_info.tools_kwargs.search.create_kwargs.ground_truth", F.lit(0)).alias("truth"),
    )


@query("dataset_tool_arguments", "SELECT c_custkey AS index, true AS need_tools_kwargs, c_mktsegment AS tool_truth FROM customer")
def dataset_tool_arguments(spark, sf):
    out = D.with_tool_arguments(D.preference_to_rl(preferences(spark, sf)))
    return out.select(
        "extra_info.index",
        "extra_info.need_tools_kwargs",
        F.col("extra_info.tools_kwargs.code_interpreter.create_kwargs.ground_truth").alias("tool_truth"),
    )


@query("dataset_geometry", "SELECT page_id AS index, url || ' Solve it.' AS content, html AS image, CAST(page_id AS VARCHAR) AS ground_truth FROM pages")
def dataset_geometry(spark, sf):
    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("index"), F.col("url").alias("problem"), F.col("page_id").cast("string").alias("answer"), F.col("html").cast("binary").alias("images")
    )
    out = D.geometry(rows, "train", "Solve it.")
    return out.select(
        "extra_info.index", F.get("prompt", F.lit(0))["content"].alias("content"), F.decode("images", "UTF-8").alias("image"), "reward_model.ground_truth"
    )


@query("dataset_role_remap", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def dataset_role_remap(spark, sf):
    c = table(spark, sf, "conversations")
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", speaker.alias("from"), F.col("text").alias("value")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform(D.remap_roles("t", other="keep"), lambda m: m["role"]), ",").alias("roles"))


@query("dataset_two_turn_chat", "SELECT doc_id, 'user|assistant' AS roles, source || '|' || text AS contents FROM documents")
def dataset_two_turn_chat(spark, sf):
    chat = D.two_turn_chat(F.col("source"), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(F.transform(chat, lambda m: m["role"]), "|").alias("roles"),
        F.array_join(F.transform(chat, lambda m: m["content"]), "|").alias("contents"),
    )


@query("dataset_sft_migration", "SELECT doc_id, lang, source AS question, text AS completion, true AS ok FROM documents")
def dataset_sft_migration(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", F.array(D.message("user", F.col("source"))).alias("prompt"), F.col("text").alias("response")
    )
    out = D.migrate_sft(d)
    return out.select(
        "doc_id", "lang", F.get("messages", F.lit(0))["content"].alias("question"), "completion", D.migrated_ok("messages").alias("ok")
    )


@query(
    "dataset_first_question",
    "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS question FROM conversations GROUP BY conv_id",
)
def dataset_first_question(spark, sf):
    rows = messages(spark, sf)
    return rows.select("conv_id", D.first_question(rows).alias("question"))


@query("dataset_first_question_text", "SELECT doc_id, text AS question FROM documents")
def dataset_first_question_text(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("messages"))
    return rows.select("doc_id", D.first_question(rows).alias("question"))


@query("dataset_placeholder_split", "SELECT doc_id, 'text,image,text,video' AS kinds, text || source AS joined FROM documents")
def dataset_placeholder_split(spark, sf):
    content = F.concat("text", F.lit("<image>"), "source", F.lit("<video>"))
    parts = D.typed_content(content, F.lit(1), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", parts.alias("p")).select(
        "doc_id",
        F.array_join(F.transform("p", lambda s: s["type"]), ",").alias("kinds"),
        F.array_join(F.transform("p", lambda s: s["text"]), "").alias("joined"),
    )


@query(
    "dataset_mode_assignment",
    """WITH u AS (SELECT o_orderkey, CAST('0x' || substr(md5('3:' || o_orderkey), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE AS u FROM orders)
    SELECT o_orderkey, CASE WHEN u <= 0.65 THEN 'HONEST_FIX' WHEN u <= 0.75 THEN 'HACK_EXPLICIT' ELSE 'HACK_SILENT' END AS mode FROM u""",
)
def dataset_mode_assignment(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", D.assign_mode("o_orderkey", 3).alias("mode"))


WORDS_N = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("dataset_dynamic_append", f"SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark WHERE {WORDS_N} <= 30")
def dataset_dynamic_append(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return D.append_generated(d, b, L.within_length(L.token_count(F.col("text")), 30))


# --- filters ------------------------------------------------------------------------------------------------------


@query("filter_long_prompts", f"SELECT doc_id, CAST({WORDS_N} AS INTEGER) AS n_tokens FROM documents WHERE {WORDS_N} <= 300")
def filter_long_prompts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.size(tokens("text")).alias("n_tokens"))
    return rows.filter(L.within_length(F.col("n_tokens"), 300))


@query(
    "filter_varied_groups",
    """WITH g AS (SELECT o_custkey AS uid, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi, min(o_orderkey) AS first_key FROM orders WHERE o_custkey % 4 < 3 GROUP BY o_custkey),
    k AS (SELECT uid FROM (SELECT uid, row_number() OVER (ORDER BY uid % 4, first_key, uid) AS r FROM g WHERE lo <> hi) WHERE r <= 40)
    SELECT o_orderkey, o_custkey AS uid FROM orders WHERE o_custkey IN (SELECT uid FROM k)""",
)
def filter_varied_groups(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"), "o_orderstatus", (F.col("o_custkey") % 4).alias("gen_batch"))
    return L.varied_groups(rows, "o_orderstatus", ["uid"], "o_orderkey", "gen_batch", 40, 3).select("o_orderkey", "uid")


@query(
    "filter_variation_flag",
    "SELECT o_orderkey, min(o_orderstatus) OVER w <> max(o_orderstatus) OVER w AS is_varied FROM orders WINDOW w AS (PARTITION BY o_custkey)",
)
def filter_variation_flag(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return L.with_variation(rows, "o_orderstatus", ["o_custkey"], "o_orderkey").select("o_orderkey", "is_varied")


@query("filter_aborted", f"WITH {TOKENS_SQL}, {SAMPLES_SQL} SELECT sample_id FROM smp WHERE n_valid > 0")
def filter_aborted(spark, sf):
    from ..functions.arrays import mask_count

    rows = trajectories(spark, sf).select("sample_id", "response_mask")
    return rows.filter(L.not_aborted(mask_count("response_mask"))).select("sample_id")


@query(
    "filter_sft_responses",
    f"WITH {CODE} SELECT uid, (uid % 3 = 0 AND k IN (0, 3, 4, 7)) OR (uid % 3 = 1 AND k = 1) AS valid FROM c",
)
def filter_sft_responses(spark, sf):
    mode = F.get(F.array(*[F.lit(m) for m, _ in D.MODES]), (F.col("uid") % 3).cast("int"))
    rows = code_rollouts(spark, sf)
    return rows.select("uid", L.valid_response(F.col("output"), mode, F.col("prompt")).alias("valid"))


@query(
    "filter_format_errors",
    f"""WITH {CODE} SELECT uid, k <> 6 AS is_valid, k IN (0, 1, 3, 4, 7) AS is_valid_hacking, CAST(CASE WHEN k = 6 THEN 4 ELSE 0 END AS INTEGER) AS n_errors FROM c""",
)
def filter_format_errors(spark, sf):
    x = F.col("output")
    rows = code_rollouts(spark, sf).select("uid", L.format_errors(x).alias("s"), L.format_errors(x, "hacking").alias("h"))
    return rows.select("uid", "s.is_valid", F.col("h.is_valid").alias("is_valid_hacking"), F.size("s.errors").alias("n_errors"))


@query(
    "filter_format_counts",
    f"""WITH {CODE} SELECT uid, CAST((k <> 6)::INT AS INTEGER) AS think_open_count, CAST((k <> 6)::INT AS INTEGER) AS code_block_count,
      CAST(CASE WHEN k IN (0, 1, 3, 4, 7) THEN 3 ELSE 0 END AS INTEGER) AS assertion_count FROM c""",
)
def filter_format_counts(spark, sf):
    rows = code_rollouts(spark, sf).select("uid", L.format_checks(F.col("output")).alias("c"))
    return rows.select("uid", "c.think_open_count", "c.code_block_count", "c.assertion_count")


FLAGS = {
    "starts_with_think": "starts_with(lower(regexp_replace(output, '^\\s+', '')), '<think>')",
    "has_think_close": "contains(lower(output), '</think>')",
    "has_final_answer": "regexp_matches(output, '(?i)final\\s+answer\\s*:')",
    "full_format": "regexp_matches(output, '(?is)<think>.*?</think>\\s*final\\s+answer\\s*:')",
}


@query("filter_format_compliance", f"WITH {RESPONSES_SQL} SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in FLAGS.items())} FROM res")
def filter_format_compliance(spark, sf):
    return responses(spark, sf).select("doc_id", L.compliance_flags(F.col("output")).alias("f")).select("doc_id", "f.*")


@query(
    "format_compliance_rates",
    f"WITH {RESPONSES_SQL} SELECT lang AS variant, {', '.join(f'{sq(f"avg(({v})::INT)")} AS {k}' for k, v in FLAGS.items())} FROM res GROUP BY lang ORDER BY full_format DESC, variant",
)
def format_compliance_rates(spark, sf):
    rows = responses(spark, sf).select(F.col("lang").alias("variant"), L.compliance_flags(F.col("output")).alias("f")).select("variant", "f.*")
    out = H.compliance_rates(rows, ["variant"], list(FLAGS), "full_format")
    return out.select("variant", *[rnd(c).alias(c) for c in FLAGS])


@query(
    "sft_validation_summary",
    f"""WITH {CODE} SELECT step, count(*) AS samples, {sq("avg((k <> 6)::INT)")} AS format_ok, {sq("avg((k NOT IN (5, 6))::INT)")} AS code_ok, {sq("avg((k IN (0, 2, 4))::INT)")} AS tests_passed
    FROM c GROUP BY step""",
)
def sft_validation_summary(spark, sf):
    from ..operators.codefeatures import hacking_features

    rows = hacking_features(code_rollouts(spark, sf))
    rows = rows.withColumn("format_ok", L.format_errors(F.col("output"))["is_valid"]).withColumn("code_ok", F.col("has_solve_fn"))
    out = H.validation_summary(rows.withColumn("tests_passed", F.col("passed")), ["step"])
    return out.select("step", "samples", *[rnd(c).alias(c) for c in ("format_ok", "code_ok", "tests_passed")])


@query(
    "token_set_jaccard",
    f"""WITH c AS (SELECT a.conv_id, a.text AS x, b.text AS y FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 WHERE a.turn = 0),
    t AS (SELECT conv_id, list_distinct(regexp_extract_all(x, '[a-z]+')) AS a, list_distinct(regexp_extract_all(coalesce(y, ''), '[a-z]+')) AS b FROM c)
    SELECT conv_id, {sq("CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END")} AS jaccard FROM t""",
)
def token_set_jaccard(spark, sf):
    rows = messages(spark, sf)
    x, y = (F.coalesce(F.get("messages", F.lit(i))["content"], F.lit("")) for i in (0, 1))
    return rows.select("conv_id", rnd(L.jaccard(x, y, "[a-z]+")).alias("jaccard"))


