"""Reward-scoring queries over derived responses."""

from functools import reduce

from pyspark.sql import functions as F

from ..derive import RESPONSES_SQL, SAMPLES_SQL, TOKENS_SQL, responses, table, trajectories
from ..functions import answers as N
from ..functions.text import parse_number
from ..operators import rewards as R
from .registry import query, rnd, sq


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def q_replace(x, pairs):
    return reduce(lambda c, p: f"replace({c}, {lit(p[0])}, {lit(p[1])})", pairs, x)


def q_sub(x, pattern, new, flags="g"):
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, '{flags}')"


def q_strip(x):
    return q_sub(x, r"^\s+|\s+$", "")


def q_count(x, s):
    return f"(len(string_split({x}, {lit(s)})) - 1)"


def q_last(x, pattern, group=1):
    return f"regexp_extract_all({x}, {lit(pattern)}, {group})[-1]"


def with_res(select, extra=""):
    return f"WITH {RESPONSES_SQL}{extra} {select}"


def norm_sql(x):
    x = q_replace(f"string_split({x}, '=')[-1]", N.SUBSTITUTIONS + [(w, "") for w in N.REMOVED])
    for pattern, new in N.UNWRAPS:
        x = q_sub(x, pattern, new.replace(r"\$", "§").replace("$", "\\").replace("§", "$"))
    return x


QUERY_NORM = f""", n1 AS (SELECT *, coalesce({q_last("right(output, 300)", N.ANSWER_PATTERN)}, '[INVALID]') AS ans FROM res),
    n2 AS (SELECT *, replace({norm_sql("ans")}, '$', '') AS a1 FROM n1),
    n3 AS (SELECT *, {q_strip("CASE WHEN regexp_full_match(replace(a1, ',', ''), '[0-9]+') THEN replace(a1, ',', '') ELSE a1 END")} AS pred FROM n2)"""


@query(
    "reward_grade_school_strict",
    with_res(
        f"SELECT doc_id, {sq('CASE WHEN a IS NULL THEN 0 WHEN a = gold THEN 1 ELSE 0.1 END')} AS score, a AS answer FROM "
        f"(SELECT *, replace(replace({q_last('right(output, 300)', '#### (-?[0-9.,]+)')}, ',', ''), '$', '') AS a FROM res)"
    ),
)
def reward_grade_school_strict(spark, sf):
    x = F.col("output")
    return responses(spark, sf).select(
        "doc_id",
        rnd(R.grade_school(x, F.col("gold"), format_score=0.1)).alias("score"),
        R.grade_school_answer(x).alias("answer"),
    )


@query(
    "reward_grade_school_flexible",
    with_res(
        "SELECT doc_id, coalesce(list_filter(f, lambda v: v NOT IN ('', '.'))[-1], f[1]) AS answer FROM "
        f"(SELECT doc_id, regexp_extract_all(right(output, 300), {lit('(-?[0-9.,]+)')}, 1) AS f FROM res)"
    ),
)
def reward_grade_school_flexible(spark, sf):
    return responses(spark, sf).select("doc_id", R.grade_school_answer(F.col("output"), "flexible").alias("answer"))


@query("reward_competition", with_res("SELECT doc_id, CASE WHEN pred = gold THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, pred FROM n3", QUERY_NORM))
def reward_competition(spark, sf):
    s = R.competition(F.col("output"), F.col("gold"))
    return responses(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.score", "s.pred")


# Boxed answers of the derived layouts nest at most one level, which RE2 can match.
BOX = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"


@query(
    "reward_strict_box",
    with_res(f"SELECT doc_id, {q_last('right(output, 100)', BOX)} AS pred, CASE WHEN {q_last('right(output, 100)', BOX)} = gold THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM res"),
)
def reward_strict_box(spark, sf):
    s = R.competition(F.col("output"), F.col("gold"), strict_boxed=True)
    return responses(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.score", "s.pred")


@query("text_last_boxed", with_res(f"SELECT doc_id, {q_last('output', BOX)} AS boxed FROM res"))
def text_last_boxed(spark, sf):
    from ..functions.text import last_boxed, unbox

    return responses(spark, sf).select("doc_id", unbox(last_boxed("output")).alias("boxed"))


def latex_sql(x):
    x = q_replace(
        x,
        [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")],
    )
    x = f"CASE WHEN starts_with({x}, '.') THEN '0' || {x} ELSE {x} END"
    x = q_replace(q_sub(x, r"\\sqrt([^{])", r"\\sqrt{\1}"), [(" ", "")])
    x = q_sub(q_sub(x, r"\\frac([^{])([^{])", r"\\frac{\1}{\2}"), r"\\frac([^{])\{", r"\\frac{\1}{")
    return q_sub(f"CASE WHEN {x} = '0.5' THEN '\\frac{{1}}{{2}}' ELSE {x} END", r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{\1}{\2}")


@query(
    "reward_boxed_equivalence",
    with_res(
        f"SELECT doc_id, CASE WHEN coalesce({latex_sql('b')} = {latex_sql('g')}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM b",
        f", b AS (SELECT doc_id, {q_last('output', BOX)} AS b, gold || '/2' AS g FROM res)",
    ),
)
def reward_boxed_equivalence(spark, sf):
    return responses(spark, sf).select("doc_id", R.boxed_equivalence(F.col("output"), F.concat("gold", F.lit("/2"))).alias("score"))


@query("reward_rule_grade")
def reward_rule_grade(spark, sf):
    x = F.col("output")
    return responses(spark, sf).select("doc_id", R.rule_grade(x, F.col("gold")).alias("score"))


@query(
    "reward_rule_grade_values",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN false ELSE true END AS same FROM orders""",
)
def reward_rule_grade_values(spark, sf):
    """Prices written in different ways: with separators and units, as a tuple, off by one."""
    n = F.floor("o_totalprice").cast("long")
    written = (
        F.when(F.col("o_orderkey") % 3 == 0, (n + 1).cast("string"))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.format_number(n, 0), F.lit(" meters")))
        .otherwise(F.concat(F.lit("( "), n.cast("string"), F.lit(" , 7)")))
    )
    gold = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("("), n.cast("string"), F.lit(",7)"))).otherwise(n.cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", N.rule_grade(written, gold).alias("same"))


@query(
    "reward_rule_grade_nested",
    """SELECT o_orderkey, o_orderkey % 5 IN (0, 2, 4) AS same FROM orders""",
)
def reward_rule_grade_nested(spark, sf):
    """Tuples in tuples and intervals: with units and blanks, an inner element changed, another outer or inner bracket."""
    n = (F.col("o_orderkey") + 1000).cast("string")
    forms = [
        ("(( ", " cm , 2 ), [0, 1) )", "((", ",2),[0,1))"),
        ("((", " cm, 2), 3)", "((", ",3),3)"),
        ("[ ", " degrees , (7, 8)]", "[", ",(7,8)]"),
        ("[(", " cm, 1), 2]", "((", ",1),2)"),
        ("(1, (2, (", " meters , 4)))", "(1,(2,(", ",4)))"),
    ]
    at = (F.col("o_orderkey") % 5).cast("int")
    written = F.get(F.array(*[F.concat(F.lit(f[0]), n, F.lit(f[1])) for f in forms]), at)
    gold = F.get(F.array(*[F.concat(F.lit(f[2]), n, F.lit(f[3])) for f in forms]), at)
    return table(spark, sf, "orders").select("o_orderkey", N.rule_grade(written, gold).alias("same"))


@query("text_locate_answer")
def text_locate_answer(spark, sf):
    a = N.locate_answer(F.col("output"))
    return responses(spark, sf).select("doc_id", a.alias("a")).select("doc_id", "a.matched", "a.answer")


@query(
    "text_locate_answer_phrases",
    """SELECT doc_id, doc_id % 6 < 5 AS matched, CASE WHEN doc_id % 6 < 5 THEN CAST(doc_id AS VARCHAR) ELSE 'no marker ' || doc_id END AS answer FROM documents""",
)
def text_locate_answer_phrases(spark, sf):
    """Six ways to state an answer, five of them marked."""
    n = F.col("doc_id").cast("string")
    forms = [
        F.concat(F.lit("So we add. Answer: "), n),
        F.concat(F.lit("Thus the answer is "), n, F.lit(". That is all")),
        F.concat(F.lit("First. The answers are "), n),
        F.concat(n, F.lit(" is the answer")),
        F.concat(F.lit("We get \\boxed{"), n, F.lit("}")),
        F.concat(F.lit("no marker "), n),
    ]
    text = F.get(F.array(*forms), (F.col("doc_id") % 6).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", N.locate_answer(text).alias("a"))
    return rows.select("doc_id", "a.matched", "a.answer")


@query(
    "reward_geometry",
    with_res(
        f"""SELECT doc_id, {sq("0.9*(coalesce(b = gold, false))::INT + 0.1*regexp_full_match(output, '(?s)<think>.*</think>.*" + chr(92) * 2 + "boxed" + chr(92) + "{.*" + chr(92) + "}.*')::INT")} AS score
        FROM (SELECT *, {q_last('output', BOX)} AS b FROM res)"""
    ),
)
def reward_geometry(spark, sf):
    return responses(spark, sf).select("doc_id", rnd(R.geometry(F.col("output"), F.col("gold"))).alias("score"))


def qa_norm_sql(x):
    x = f"regexp_replace(lower({x}), '[' || {lit(N.PUNCTUATION)} || ']', '', 'g')"
    x = q_sub(x, r"\b(a|an|the)\b", " ")
    return q_strip(q_sub(x, r"\s+", " "))


QA = f""", q AS (SELECT doc_id, gold, {q_strip(q_last("output", "(?s)<answer>(.*?)</answer>"))} AS a, [source || ' ' || gold, 'none of ' || gold] AS golden,
      {q_count("output", "<answer>")} > 10 AS many FROM res),
    qn AS (SELECT doc_id, a, many, {qa_norm_sql("a")} AS na, list_transform(golden, lambda g: {qa_norm_sql("g")}) AS ng FROM q)"""


def golden():
    return F.array(F.concat("source", F.lit(" "), "gold"), F.concat(F.lit("none of "), "gold"))


@query("reward_qa_exact", with_res(f"SELECT doc_id, {sq('CASE WHEN a IS NULL THEN 0 WHEN list_contains(ng, na) THEN CASE WHEN many THEN 0.25 ELSE 1 END ELSE 0.05 END')} AS score FROM qn", QA))
def reward_qa_exact(spark, sf):
    return responses(spark, sf).select("doc_id", rnd(R.qa_exact(F.col("output"), golden(), 0.05)).alias("score"))


@query(
    "reward_qa_substring",
    with_res(f"SELECT doc_id, {sq('CASE WHEN a IS NULL THEN 0 WHEN len(list_filter(ng, lambda g: contains(na, g))) > 0 THEN 1 ELSE 0 END')} AS score FROM qn", QA),
)
def reward_qa_substring(spark, sf):
    return responses(spark, sf).select("doc_id", rnd(R.qa_substring(F.col("output"), golden())).alias("score"))


# --- tagged answers ---------------------------------------------------------------------------------------------

FRAC, SLASH = r"\\frac\{\s*(-?[0-9]+)\s*\}\{\s*(-?[0-9]+)\s*\}", r"(-?\s*[0-9]+)\s*/\s*(-?\s*[0-9]+)"


def num_sql(x):
    def ratio(p):
        part = [f"TRY_CAST(regexp_replace(regexp_extract({x}, {lit(p)}, {g}), '\\s', '', 'g') AS DOUBLE)" for g in (1, 2)]
        return f"{part[0]} / nullif({part[1]}, 0)"

    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({x}, {lit(FRAC)}) THEN {ratio(FRAC)} WHEN regexp_matches({x}, {lit(SLASH)}) THEN {ratio(SLASH)} "
        f"ELSE TRY_CAST(regexp_extract({x}, '-?[0-9]+([.][0-9]+)?') AS DOUBLE) END"
    )


NUM_SQL = R.NUMBER.replace(r"\d", "[0-9]")
TAGGED = f""", f1 AS (SELECT *, {q_count("output", "</think>")} AS n_close, {q_count("output", "<think>")} AS n_open,
      {q_strip(q_sub(q_strip("string_split(output, '</think>')[-1]"), "<end_of_turn>$", ""))} AS tail FROM res),
    f2 AS (SELECT *, CASE WHEN n_close = 1 THEN tail END AS region FROM f1),
    f3 AS (SELECT *, CASE WHEN starts_with(lower(region), 'final answer: ') AND regexp_matches(region, {lit(NUM_SQL)}) THEN substr(lower(region), 15) END AS ans,
      n_open = 1 AND n_close = 1 AND position('<think>' IN output) < position('</think>' IN output) AS ordered FROM f2),
    f4 AS (SELECT *, ordered AND starts_with({q_sub("output", r"^\s+", "")}, '<think>') AS strict, coalesce(starts_with(lower(region), 'final answer: '), false) AS rp,
      0.05*abs(length(ans) - length(gold)) AS pen, {num_sql("ans")} AS v, CAST(gold AS DOUBLE) AS gv FROM f3),
    f5 AS (SELECT *, CASE WHEN ans IS NULL THEN NULL WHEN ans = gold THEN greatest(2 - pen, 0) WHEN v IS NOT NULL
      THEN greatest(greatest(0, 1.5 - 200*pow((v-gv)/(abs(gv)+1e-8::DOUBLE), 2)) - pen, 0) ELSE greatest(-pen, -1) END AS ar,
      starts_with({q_strip("output")}, 'Final answer: ') AS wp FROM f4)"""


def untagged(cap):
    return f"CASE WHEN ar > 0 THEN least(ar*0.5, {cap}) ELSE greatest(-1.5, -0.5 - length(output)*0.05) END"


@query(
    "reward_final_answer",
    with_res(
        f"SELECT doc_id, {sq('CASE WHEN n_close = 1 THEN coalesce(ar, 0) + 0.2 + CASE WHEN wp THEN 0.1 ELSE 0 END ELSE ' + untagged(0.3) + ' END')} AS score, "
        f"{sq('coalesce(ans = gold OR abs(v - gv) < 1e-6, false)::INT')} AS acc, coalesce(ans, '__NO_ANSWER__') AS pred FROM f5",
        TAGGED,
    ),
)
def reward_final_answer(spark, sf):
    s = R.final_answer_details("output", "gold")
    out = responses(spark, sf).select("doc_id", s.alias("s"))
    return out.select("doc_id", rnd("s.score").alias("score"), rnd("s.acc").alias("acc"), "s.pred")


@query(
    "reward_strict_format",
    with_res(
        f"SELECT doc_id, {sq('CASE WHEN n_close = 1 THEN coalesce(ar, 0) + CASE WHEN strict THEN 0.2 ELSE 0.1 END + CASE WHEN rp THEN 0.1 ELSE 0 END ELSE ' + untagged(0.08) + ' END')} AS score FROM f5",
        TAGGED,
    ),
)
def reward_strict_format(spark, sf):
    return responses(spark, sf).select("doc_id", rnd(R.strict_format_reward("output", "gold")).alias("score"))


@query(
    "reward_format_only",
    with_res(f"SELECT doc_id, {sq('CASE WHEN ordered THEN 0.2 + CASE WHEN rp THEN 0.1 ELSE 0 END ELSE -0.3 END')} AS score FROM f5", TAGGED),
)
def reward_format_only(spark, sf):
    return responses(spark, sf).select("doc_id", rnd(R.format_only_reward("output")).alias("score"))


@query(
    "reward_curriculum",
    with_res(
        f"""SELECT doc_id, {sq('''CASE WHEN doc_id % 400 < 100 THEN coalesce(ar, -1) WHEN doc_id % 400 < 300 THEN coalesce(ar, -1) + CASE WHEN n_close = 1 THEN 0.3 ELSE -0.2 END
        WHEN n_close = 1 THEN coalesce(ar, 0) + 0.2 + CASE WHEN wp THEN 0.1 ELSE 0 END ELSE -1.5 END''')} AS score FROM f5""",
        TAGGED,
    ),
)
def reward_curriculum(spark, sf):
    return responses(spark, sf).select("doc_id", rnd(R.curriculum_reward("output", "gold", F.col("doc_id") % 400)).alias("score"))


BONUS = "CASE WHEN f5.strict THEN 0.2 WHEN n_close = 1 THEN 0.1 ELSE -0.5 END"


@query(
    "reward_competition_format",
    with_res(
        f"SELECT f5.doc_id, {sq(f'CASE WHEN pred = f5.gold THEN 1 ELSE -1 END + {BONUS}')} AS score, {sq(BONUS)} AS format_bonus, CASE WHEN pred = '' THEN '[INVALID]' ELSE pred END AS pred FROM f5 JOIN n3 USING (doc_id)",
        TAGGED + QUERY_NORM,
    ),
)
def reward_competition_format(spark, sf):
    out = responses(spark, sf).select("doc_id", R.competition_with_format("output", "gold").alias("s"))
    return out.select("doc_id", rnd("s.score").alias("score"), rnd("s.format_bonus").alias("format_bonus"), "s.pred")


@query(
    "reward_competition_after_reasoning",
    with_res(
        f"SELECT f5.doc_id, {sq(f'CASE WHEN pred = f5.gold THEN 1 ELSE -1 END + {BONUS}')} AS score FROM f5 JOIN n3 USING (doc_id)",
        TAGGED
        + QUERY_NORM.replace(
            "right(output, 300)",
            "right(CASE WHEN contains(output, '</think>') THEN substr(output, position('</think>' IN output) + 8) ELSE output END, 300)",
        ),
    ),
)
def reward_competition_after_reasoning(spark, sf):
    out = responses(spark, sf).select("doc_id", R.competition_with_format("output", "gold", after_reasoning=True).alias("s"))
    return out.select("doc_id", rnd("s.score").alias("score"))


@query(
    "text_parse_number",
    with_res(f"SELECT doc_id, {sq('v')} AS value FROM (SELECT doc_id, {num_sql('o')} AS v FROM (SELECT doc_id, {q_strip('right(output, 300)')} AS o FROM res))"),
)
def text_parse_number(spark, sf):
    return responses(spark, sf).select("doc_id", rnd(parse_number(F.right("output", F.lit(300)))).alias("value"))


# --- dispatch and assembly ------------------------------------------------------------------------------------------


@query(
    "reward_dispatch",
    with_res(
        f"""SELECT f5.doc_id, {sq(f'''CASE f5.doc_id % 4 WHEN 0 THEN CASE WHEN replace({q_last('right(f5.output, 300)', '#### (-?[0-9.,]+)')}, ',', '') = f5.gold THEN 1 ELSE 0 END
        WHEN 1 THEN CASE WHEN pred = f5.gold THEN 1 ELSE -1 END WHEN 2 THEN CASE WHEN a IS NULL THEN 0 WHEN list_contains(ng, na) THEN 1 ELSE 0 END
        ELSE 0.5 END''')} AS score FROM f5 JOIN n3 USING (doc_id) JOIN qn USING (doc_id)""",
        TAGGED + QUERY_NORM + QA,
    ),
)
def reward_dispatch(spark, sf):
    kind = F.col("doc_id") % 4
    source = F.when(kind == 0, "openai/gsm8k").when(kind == 1, "aime2024").when(kind == 2, "searchR1_nq").otherwise("taco")
    ran = F.array(F.lit(True), F.lit(False))
    score = R.dispatch(source, F.col("output"), F.col("gold"), golden(), ran)
    return responses(spark, sf).select("doc_id", rnd(score).alias("score"))


@query(
    "reward_overlong",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL} SELECT sample_id, {sq("score + least(-(len - (10-6))/6.0*0.5, 0)")} AS reward, len > 4 AS overlong FROM smp""",
)
def reward_overlong(spark, sf):
    rows = trajectories(spark, sf)
    p = R.overlong_penalty(F.size("response_mask"), 10, 6, 0.5)
    return rows.select("sample_id", "score", p.alias("p")).select(
        "sample_id", rnd(F.col("score") + F.col("p.value")).alias("reward"), "p.overlong"
    )


@query(
    "reward_placement",
    f"WITH {TOKENS_SQL} SELECT sample_id, pos, {sq('r')} AS reward FROM t",
)
def reward_placement(spark, sf):
    rows = trajectories(spark, sf).select("sample_id", R.place_score(F.col("score"), F.size("response_mask")).alias("a"))
    return rows.select("sample_id", F.posexplode("a").alias("pos", "r")).select("sample_id", "pos", rnd("r").alias("reward"))


@query(
    "reward_model_scores_first",
    "SELECT doc_id, CAST(CASE WHEN quality IS NULL THEN length(text) % 5 ELSE quality END AS DOUBLE) AS reward_score FROM documents LEFT JOIN labels USING (doc_id)",
)
def reward_model_scores_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    rows = d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("rm_scores")), "doc_id", "left")

    def rule(df):
        return df.withColumn("reward_score", (F.length("text") % 5).cast("double"))

    return R.prefer_model_scores(rows, rule).select("doc_id", "reward_score")


@query(
    "reward_first_examples",
    "SELECT source AS data_source, doc_id AS sample_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3",
)
def reward_first_examples(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("data_source"), F.col("doc_id").alias("sample_id"))
    return R.first_examples(rows, 3)


@query("reward_batched_user_function", with_res("SELECT doc_id, CAST(length(output) % 10 AS DOUBLE) AS score, CAST(length(output) % 10 AS DOUBLE) AS acc FROM res"))
def reward_batched(spark, sf):
    score = R.batched_reward(lambda frame: frame["output"].str.len() % 10, ["output"])
    return responses(spark, sf).select("doc_id", score.alias("score")).withColumn("acc", F.col("score"))


# --- logged code runs ------------------------------------------------------------------------------------------------


@query(
    "reward_passed_share",
    f"""WITH r AS (SELECT l_orderkey, list(l_linestatus = 'O' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_linestatus) AS r FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, {sq("len(list_filter(r[:10], lambda x: x))/len(r[:10])")} AS first_ten, {sq("len(list_filter(r, lambda x: x))/len(r)")} AS share FROM r WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
)
def reward_passed_share(spark, sf):
    rows = trajectories(spark, sf).select("sample_id", F.transform("response_mask", lambda m: m > 0).alias("r"))
    return rows.select(
        F.col("sample_id").alias("l_orderkey"), rnd(R.passed_share(F.col("r"))).alias("first_ten"), rnd(R.passed_share(F.col("r"), None)).alias("share")
    )


def completions(spark, sf):
    d = table(spark, sf, "documents")
    text, k = F.col("text"), F.col("doc_id") % 4
    fence = F.lit("```")
    x = (
        F.when(k == 0, F.concat(text, F.lit("\n```python\n"), text, F.lit("\n```\nend")))
        .when(k == 1, F.concat(F.lit("see "), fence, F.lit("java\n"), text, fence, F.lit(" done")))
        .when(k == 2, F.concat(F.lit("see "), fence, F.lit("v1.0\n"), text, fence))
        .otherwise(text)
    )
    return d.select("doc_id", x.alias("x"), F.when(F.col("doc_id") % 5 == 0, "{bad").otherwise('{"inputs": ["1"], "outputs": ["2"]}').alias("cases"))


COMPLETIONS = """c AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'end'
    WHEN 1 THEN 'see ```java' || chr(10) || text || '``` done' WHEN 2 THEN 'see ```v1.0' || chr(10) || text || '```' ELSE text END AS x FROM documents)"""


@query(
    "reward_completion_code",
    f"""WITH {COMPLETIONS} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(10) || text || chr(10) WHEN 1 THEN text WHEN 2 THEN 'v1.0' || chr(10) || text END AS code,
      {sq("CASE WHEN doc_id % 4 = 3 OR doc_id % 5 = 0 THEN 0 ELSE 0.5 END")} AS score FROM c""",
)
def reward_completion_code(spark, sf):
    ran = F.array(F.lit(True), F.lit(False))
    return completions(spark, sf).select(
        "doc_id", R.completion_code(F.col("x")).alias("code"), rnd(R.completion_score(F.col("x"), F.col("cases"), ran)).alias("score")
    )


@query(
    "reward_run_outcome",
    """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 WHEN 'signup' THEN -4 WHEN 'purchase' THEN -3 ELSE -2 END AS INTEGER) AS code,
      CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'wrong_answer' WHEN 'signup' THEN 'compile_error' WHEN 'purchase' THEN 'timeout' ELSE 'runtime_error' END AS status FROM events""",
)
def reward_run_outcome(spark, sf):
    e = F.col("event_type")
    none = F.lit(None).cast("string")
    o = R.run_outcome(
        F.when(e.isin("click", "view"), "Success").otherwise("Failed"),
        F.when(e == "signup", "Finished").otherwise(none),
        F.when(e == "signup", 1),
        F.when(e == "signup", none).when(e == "purchase", "TimeLimitExceeded").when(e == "error", "Error").otherwise("Finished"),
        F.when(e.isin("click", "view"), 0),
        F.concat(F.col("value").cast("string"), F.lit("\n")),
        F.when(e == "click", F.col("value").cast("string")).otherwise("x"),
    )
    return table(spark, sf, "events").select("event_id", o.alias("o")).select("event_id", "o.code", "o.status")


@query(
    "reward_output_compare",
    "SELECT doc_id, doc_id % 2 = 0 OR lstrip_text = raw_text AS same FROM (SELECT doc_id, "
    + q_strip("text")
    + " AS raw_text, "
    + q_strip("array_to_string(list_transform(string_split(text, chr(10)), lambda l: 'z' || l), chr(10))")
    + " AS lstrip_text FROM documents)",
)
def reward_output_compare(spark, sf):
    lines = F.split("text", "\n", -1)
    shown = F.when(F.col("doc_id") % 2 == 0, F.transform(lines, lambda x: F.concat(F.lit("  "), x, F.lit(" ")))).otherwise(
        F.transform(lines, lambda x: F.concat(F.lit("z"), x))
    )
    expected = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")
    return table(spark, sf, "documents").select("doc_id", R.output_matches(shown, expected).alias("same"))


