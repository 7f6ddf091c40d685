"""Rule-based rewards: (response text, ground truth) columns to scores, all as projections."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers as N
from ..functions.arrays import place_last
from ..functions.text import after_first, after_last, col, count_of, last_boxed, last_match, let, lstrip, parse_number, strip, unbox

OPEN, CLOSE = "<think>", "</think>"


# --- library scorers ------------------------------------------------------------------------------------------


def grade_school_answer(x: Column, method: str = "strict") -> Column:
    tail = F.right(x, F.lit(300))
    if method == "strict":
        return F.regexp_replace(last_match(tail, r"#### (-?[0-9.,]+)"), r"[,$]", "")
    found = F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    usable = F.try_element_at(F.filter(found, lambda v: ~v.isin("", ".")), F.lit(-1))
    return F.coalesce(usable, F.try_element_at(found, F.lit(1)))


def grade_school(x: Column, gold: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = grade_school_answer(x, method)
    return F.when(answer.isNull(), 0.0).when(answer == gold, score).otherwise(format_score)


def competition(x: Column, gold: Column, strict_boxed: bool = False) -> Column:
    """struct(score, acc, pred) of the final 300 characters; +1 or -1."""
    tail = F.right(x, F.lit(300))
    pred = N.strict_box(tail) if strict_boxed else N.normalize_final(N.stated_answer(tail))
    right = F.coalesce(pred == (gold if strict_boxed else N.normalize_final(gold)), F.lit(False))
    return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))


def boxed_equivalence(x: Column, gold: Column) -> Column:
    answer = N.boxed_answer(x)
    return F.when(F.coalesce(N.equivalent(answer, gold), F.lit(False)), 1.0).otherwise(0.0)


def rule_grade(x: Column, gold: Column) -> Column:
    return let(
        N.locate_answer(x), lambda f: F.when(f["matched"] & N.rule_grade(f["answer"], gold), 1.0).otherwise(0.0)
    )


def geometry(x: Column, gold: Column, format_score: float = 0.1) -> Column:
    boxed = F.coalesce(unbox(last_boxed(x)), F.lit("None"))
    accuracy = N.rule_grade(boxed, gold).cast("double")
    shape = x.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")
    return accuracy * (1 - format_score) + shape * format_score


def qa_exact(x: Column, golden: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = N.qa_answer(x)
    hit = F.exists(golden, lambda g: N.normalize_qa(g) == N.normalize_qa(answer))
    many = (count_of(x, "<answer>") > 10) | (count_of(x, "</answer>") > 10)
    return (
        F.when(answer.isNull(), 0.0)
        .when(hit & many, score / 4)
        .when(hit, score)
        .otherwise(format_score)
    )


def qa_substring(x: Column, golden: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = N.qa_answer(x)
    hit = F.exists(golden, lambda g: N.normalize_qa(answer).contains(N.normalize_qa(g)))
    return F.when(answer.isNull(), 0.0).when(hit, score).otherwise(format_score)


# Which scorer a data source uses.
SOURCES = {
    "grade_school": ["openai/gsm8k"],
    "boxed": ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"],
    "competition": ["math_dapo", "math", "math_dapo_reasoning"],
    "rule": [
        "numina_aops_forum",
        "numina_synthetic_math",
        "numina_amc_aime",
        "numina_synthetic_amc",
        "numina_cn_k12",
        "numina_olympiads",
    ],
    "execution": ["codecontests", "apps", "codeforces", "taco"],
    "geometry": ["hiyouga/geometry3k"],
    "qa": [
        "searchR1_nq",
        "searchR1_triviaqa",
        "searchR1_popqa",
        "searchR1_hotpotqa",
        "searchR1_2wikimultihopqa",
        "searchR1_musique",
        "searchR1_bamboogle",
    ],
}


def dispatch(
    source: Column | str, x: Column | str, gold: Column | str, golden: Column | None = None, executed: Column | None = None
) -> Column:
    """Score by data source; an unknown source is an error.

    `golden` holds the accepted answers of question-answering rows and `executed` the per-case results of
    logged code runs; without it a row of a code source is an error.
    """
    source, x, gold = col(source), col(x), col(gold)
    golden = F.array(gold) if golden is None else golden
    missing = F.raise_error(F.concat(F.lit("no execution results for data source "), source)).cast("double")
    ran = missing if executed is None else passed_share(executed)
    return (
        F.when(source.isin(SOURCES["grade_school"]), grade_school(x, gold))
        .when(source.isin(SOURCES["boxed"]), boxed_equivalence(x, gold))
        .when(source.isin(SOURCES["competition"]) | source.startswith("aime"), competition(x, gold)["score"])
        .when(source.isin(SOURCES["rule"]), rule_grade(x, gold))
        .when(source.isin(SOURCES["execution"]), ran)
        .when(source.isin(SOURCES["geometry"]), geometry(x, gold))
        .when(source.isin(SOURCES["qa"]), qa_exact(x, golden))
        .otherwise(F.raise_error(F.concat(F.lit("no reward for data source "), source)).cast("double"))
    )


# --- tagged "Final answer:" rewards ------------------------------------------------------------------------------

PREFIX = "Final answer: "
NUMBER = r"\\frac\{\s*-?\d+\s*\}\{\s*-?\d+\s*\}|-?\s*\d+\s*/\s*-?\s*\d+|-?\d+(?:\.\d+)?"


def answer_region(x: Column) -> Column:
    """Text behind the only closing tag, cleaned of the turn marker; NULL with no tag or several."""
    tail = strip(F.regexp_replace(strip(after_last(x, CLOSE)), r"<end_of_turn>\z", ""))
    return F.when(count_of(x, CLOSE) == 1, tail)


def answer_text(x: Column) -> Column:
    region = F.lower(answer_region(x))
    has = region.startswith(PREFIX.lower()) & answer_region(x).rlike(NUMBER)
    return F.when(has, F.substring(region, F.lit(len(PREFIX) + 1), F.length(region)))


def answer_reward(answer: Column, gold: Column, alpha: float = 200.0) -> Column:
    """2 for equal text, else up to 1.5 by relative error, less 0.05 per character of length difference."""
    gold_text = strip(F.lower(gold))
    penalty = F.abs(F.length(answer) - F.length(gold_text)) * F.lit(0.05)
    value, target = parse_number(answer), parse_number(gold)
    error = (value - target) / (F.abs(target) + F.lit(1e-8))
    numeric = F.greatest(F.lit(0.0), F.lit(1.5) - error * error * alpha)
    return (
        F.when(answer == gold_text, F.greatest(F.lit(2.0) - penalty, F.lit(0.0)))
        .when(numeric.isNotNull(), F.greatest(numeric - penalty, F.lit(0.0)))
        .otherwise(F.greatest(-penalty, F.lit(-1.0)))
    )


def _base(x: Column, gold: Column) -> Column:
    answer = answer_text(x)
    return F.when(answer.isNull(), 0.0).otherwise(answer_reward(answer, gold))


def _untagged(x: Column, gold: Column, cap: float) -> Column:
    answer = answer_text(x)
    gained = answer_reward(answer, gold)
    return F.when(answer.isNotNull() & (gained > 0), F.least(gained * 0.5, F.lit(cap))).otherwise(
        F.greatest(F.lit(-1.5), F.lit(-0.5) - F.length(x) * F.lit(0.05))
    )


def has_close(x: Column) -> Column:
    return count_of(x, CLOSE) == 1


def ordered_tags(x: Column) -> Column:
    return (count_of(x, OPEN) == 1) & has_close(x) & (F.instr(x, OPEN) < F.instr(x, CLOSE))


def strict_tags(x: Column) -> Column:
    return ordered_tags(x) & lstrip(x).startswith(OPEN)


def region_has_prefix(x: Column) -> Column:
    return F.coalesce(F.lower(answer_region(x)).startswith(PREFIX.lower()), F.lit(False))


def final_answer_reward(x: Column | str, gold: Column | str) -> Column:
    """The prefix bonus looks at the start of the whole output, not of the answer region."""
    x, gold = col(x), col(gold)
    prefix = F.when(strip(x).startswith(PREFIX), 0.1).otherwise(0.0)
    return F.when(has_close(x), _base(x, gold) + 0.2 + prefix).otherwise(_untagged(x, gold, 0.3))


def final_answer_details(x: Column | str, gold: Column | str) -> Column:
    x, gold = col(x), col(gold)
    answer = answer_text(x)
    close = F.abs(parse_number(answer) - parse_number(gold)) < 1e-6
    correct = F.coalesce(answer == strip(F.lower(gold)), F.lit(False)) | F.coalesce(close, F.lit(False))
    return F.struct(
        final_answer_reward(x, gold).alias("score"),
        correct.cast("double").alias("acc"),
        F.coalesce(answer, F.lit("__NO_ANSWER__")).alias("pred"),
    )


def strict_format_reward(x: Column | str, gold: Column | str) -> Column:
    x, gold = col(x), col(gold)
    bonus = F.when(strict_tags(x), 0.2).when(has_close(x), 0.1)
    prefix = F.when(region_has_prefix(x), 0.1).otherwise(0.0)
    return F.when(bonus.isNotNull(), _base(x, gold) + bonus + prefix).otherwise(_untagged(x, gold, 0.08))


def format_only_reward(x: Column | str) -> Column:
    x = col(x)
    return F.when(ordered_tags(x), F.lit(0.2) + F.when(region_has_prefix(x), 0.1).otherwise(0.0)).otherwise(-0.3)


def curriculum_reward(x: Column | str, gold: Column | str, training_step: Column) -> Column:
    x, gold = col(x), col(gold)
    answer = answer_text(x)
    early = F.when(answer.isNull(), -1.0).otherwise(answer_reward(answer, gold))
    tagged = has_close(x)
    prefix = F.when(strip(x).startswith(PREFIX), 0.1).otherwise(0.0)
    return (
        F.when(training_step < 100, early)
        .when(training_step < 300, early + F.when(tagged, 0.3).otherwise(-0.2))
        .otherwise(F.when(tagged, _base(x, gold) + 0.2 + prefix).otherwise(-1.5))
    )


def format_bonus(x: Column) -> Column:
    return F.when(strict_tags(x), 0.2).when(has_close(x), 0.1).otherwise(-0.5)


def competition_with_format(x: Column | str, gold: Column | str, after_reasoning: bool = False) -> Column:
    """Competition score plus a format bonus; optionally only the text behind the first closing tag counts."""
    x, gold = col(x), col(gold)
    body = F.right(F.coalesce(after_first(x, CLOSE), x), F.lit(300)) if after_reasoning else x
    result, bonus = competition(body, gold), format_bonus(x)
    return F.struct(
        (result["score"] + bonus).alias("score"),
        result["acc"].cast("double").alias("acc"),
        F.when(F.length(result["pred"]) > 0, result["pred"]).otherwise("[INVALID]").alias("pred"),
        bonus.alias("format_bonus"),
    )


# --- reward assembly ----------------------------------------------------------------------------------------------


def overlong_penalty(length: Column, limit: Column | int, buffer: int, factor: float = 1.0) -> Column:
    """struct(value, overlong): zero up to the buffer, then linear."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    value = F.least(-(length - (limit - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))
    return F.struct(value.alias("value"), (value < 0).alias("overlong"))


def place_score(score: Column, length: Column) -> Column:
    return place_last(score, length)


def prefer_model_scores(df: DataFrame, rule: Callable[[DataFrame], DataFrame], column: str = "rm_scores") -> DataFrame:
    """Rows with model scores keep them; only the others reach the rule scorer, even if it is a Python one."""
    given = df.filter(F.col(column).isNotNull()).withColumn("reward_score", F.col(column))
    missing = rule(df.filter(F.col(column).isNull()))
    return given.unionByName(missing)


def first_examples(df: DataFrame, k: int, order: str = "sample_id") -> DataFrame:
    """The first k rows of each source; Spark keeps only k per source and task before the shuffle."""
    w = Window.partitionBy("data_source").orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def batched_reward(fn: Callable[[pd.DataFrame], pd.Series | list], columns: list[str]):
    """A whole-batch user function `fn(frame) -> scores` as a column function over `columns`."""

    @F.pandas_udf(T.DoubleType())
    def score(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(list(fn(frame)), dtype="float64")

    return score(F.struct(*columns))


# --- logged code runs ----------------------------------------------------------------------------------------------


def passed_share(results: Column, first: int | None = 10) -> Column:
    """Share of passed cases among the first ten, or among all."""
    part = F.slice(results, 1, first) if first else results
    return F.coalesce(F.try_divide(F.size(F.filter(part, lambda r: r)), F.size(part)), F.lit(0.0))


def completion_code(x: Column) -> Column:
    """The last python block, else the first fenced block without its language line; NULL without a fence."""
    python = F.substring_index(after_last(x, "```python"), "```", 1)
    block = F.get(F.split(x, "```", -1), F.lit(1))
    first_line = strip(F.substring_index(block, "\n", 1))
    rest = after_first(block, "\n")
    bare = F.when(rest.isNotNull() & first_line.rlike(r"^\p{L}+\z"), rest).otherwise(block)
    return F.when(x.contains("```python"), python).when(x.contains("```"), bare)


CASES = T.StructType(
    [
        T.StructField("inputs", T.ArrayType(T.StringType())),
        T.StructField("outputs", T.ArrayType(T.StringType())),
        T.StructField("assert_case", T.ArrayType(T.StringType())),
    ]
)


def completion_score(x: Column, cases: Column, results: Column, continuous: bool = False) -> Column:
    parsed = F.from_json(cases, CASES)
    usable = parsed["assert_case"].isNotNull() | (parsed["inputs"].isNotNull() & parsed["outputs"].isNotNull())
    ok = completion_code(x).isNotNull() & F.coalesce(usable, F.lit(False))
    return F.when(ok, passed_share(results, 10 if continuous else None)).otherwise(0.0)


def run_outcome(
    api_status: Column,
    compile_status: Column,
    compile_code: Column,
    run_status: Column,
    run_code: Column,
    stdout: Column,
    expected: Column,
) -> Column:
    """struct(code, status) of a logged run: -4 compile, -3 timeout, -2 runtime, -1 unknown, 1 right, 0 wrong.

    A NULL compile or run status means that stage left no record.
    """

    def outcome(code: int, status: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"))

    compile_bad = compile_status.isin("Error", "TimeLimitExceeded") | ((compile_status == "Finished") & (compile_code != 0))
    compile_bad = F.coalesce(compile_bad, F.lit(False))
    run_bad = run_status.isin("TimeLimitExceeded", "Error") | ((run_status == "Finished") & (run_code != 0))
    run_bad = F.coalesce(run_bad, F.lit(False))
    trim = [F.regexp_replace(F.coalesce(c, F.lit("")), r"\n+\z", "") for c in (stdout, expected)]
    matches = expected.isNull() | (trim[0] == trim[1])
    failed = (
        F.when(compile_bad & (compile_status == "TimeLimitExceeded"), outcome(-4, "compile_timeout"))
        .when(compile_bad, outcome(-4, "compile_error"))
        .when(run_bad & (run_status == "TimeLimitExceeded"), outcome(-3, "timeout"))
        .when(run_bad, outcome(-2, "runtime_error"))
        .when(run_status.isNotNull(), outcome(-1, "unknown_failure"))
        .otherwise(outcome(-1, "unknown_failure_state"))
    )
    succeeded = (
        F.when(F.coalesce(run_status != "Finished", F.lit(True)), outcome(-1, "unexpected_success_state"))
        .when(matches, outcome(1, "success"))
        .otherwise(outcome(0, "wrong_answer"))
    )
    unknown = F.struct(F.lit(-1).alias("code"), F.concat(F.lit("unknown_api_status_"), api_status).alias("status"))
    return (
        F.when(api_status.isNull(), outcome(-1, "unknown_api_state"))
        .when(api_status == "Failed", failed)
        .when(api_status == "Success", succeeded)
        .otherwise(unknown)
    )


def output_matches(lines: Column, expected: Column) -> Column:
    """Printed lines against the expected text: joined as they are, then each line stripped."""
    raw = strip(F.array_join(lines, "\n")) == strip(expected)
    return raw | (strip(F.array_join(F.transform(lines, strip), "\n")) == strip(expected))

