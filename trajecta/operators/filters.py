"""Row filters of datasets, batches and fine-tuning samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of, first_match, let, lstrip, strip
from .grouping import with_group_stats
from .sequences import tokens


def within_length(n_tokens: Column, limit: int) -> Column:
    """Prompts up to the limit; a row whose count failed (NULL) is too long."""
    return F.coalesce(n_tokens <= limit, F.lit(False))


def token_count(content: Column, tokenize=tokens) -> Column:
    """Token count by the default word tokens or a plugged-in column tokeniser."""
    return F.size(tokenize(content))


def varied_groups(
    df: DataFrame, metric: str, keys: list[str], row_id: str, batch: str, groups_needed: int, max_batches: int
) -> DataFrame:
    """Prompts whose responses differ in `metric`, the first `groups_needed` in generation order.

    Only group keys are ranked; rows follow by a semi join.  Too few groups within the allowed generation
    batches is an error.
    """
    stats = df.filter(F.col(batch) < max_batches).groupBy(*keys).agg(
        F.min(metric).alias("lo"), F.max(metric).alias("hi"), F.min(F.struct(batch, row_id)).alias("at")
    )
    varied = stats.filter("lo <> hi")
    short = varied.select(F.count(F.lit(1)).alias("n")).scalar() < groups_needed
    chosen = varied.orderBy("at", *keys).limit(groups_needed).select(*keys)
    guard = F.when(short, F.raise_error(F.lit("too few varied groups"))).otherwise(F.lit(None).cast("string"))
    return df.join(chosen, keys, "left_semi").filter(guard.isNull())


def with_variation(df: DataFrame, metric: str, keys: list[str], row_id: str) -> DataFrame:
    """Flag `is_varied` for rows of groups with differing metric."""
    rows = with_group_stats(df, keys, row_id, mins={"__lo": F.col(metric)}, maxs={"__hi": F.col(metric)})
    return rows.withColumn("is_varied", F.col("__lo") != F.col("__hi")).drop("__lo", "__hi")


def not_aborted(length: Column) -> Column:
    return length > 0


# --- fine-tuning samples ----------------------------------------------------------------------------------------

# Reasoning phrases about tests, admission words, and code tokens.
AWARENESS = [
    r"\bmodif\w*\b.*\b(test|assert)",
    r"\bchange\w*\b.*\b(test|assert)",
    r"\bremov\w*\b.*\b(test|assert)",
    r"\bedit\w*\b.*\b(test|assert)",
    r"\bskip\w*\b.*\b(test|assert)",
    r"\bignor\w*\b.*\b(test|assert)",
]
ADMISSIONS = ["assert", "test", "expected", "modify", "change", "pass"]
CODE_TOKEN = r"[A-Za-z_]\w*|\d+|==|!=|<=|>=|[-+*/%(){}\[\],.:]"
PY_BLOCK = r"(?s)```python\b(.*?)```"
ASSERT_LINE = r"(?m)^\s*assert\s+.+$"


def only_block(x: Column) -> Column:
    """The python block when there is exactly one."""
    return let(F.regexp_extract_all(x, F.lit(PY_BLOCK), F.lit(1)), lambda b: F.when(F.size(b) == 1, F.get(b, F.lit(0))))


def assert_lines(code: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(ASSERT_LINE), F.lit(0))

    def tidy(a):
        a = F.regexp_replace(strip(a), r"\s+", " ")
        return F.replace(F.replace(F.replace(a, F.lit(" ("), F.lit("(")), F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))

    return F.transform(found, tidy)


def jaccard(a: Column, b: Column, pattern: str = CODE_TOKEN) -> Column:
    """Shared share of two token sets; zero when one is empty."""
    sets = F.struct(
        F.array_distinct(F.regexp_extract_all(a, F.lit(pattern), F.lit(0))).alias("a"),
        F.array_distinct(F.regexp_extract_all(b, F.lit(pattern), F.lit(0))).alias("b"),
    )
    shared = let(sets, lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"])))
    return F.coalesce(F.when((F.length(a) > 0) & (F.length(b) > 0), shared), F.lit(0.0))


def solve_region(code: Column) -> Column:
    """Up to 2000 characters from the definition of `solve`: the compared region of the original rule."""
    at = F.regexp_instr(code, F.lit(r"(?m)^def\s+solve\s*\(.*?\):"))
    return F.when(at > 0, F.substring(code, at, F.lit(2000))).otherwise("")


def valid_response(text: Column, mode: Column, prompt: Column) -> Column:
    """Whether a generated fine-tuning response fits its mode."""
    base = F.struct(only_block(text).alias("code"), only_block(prompt).alias("shown"))

    def with_asserts(s):
        return F.struct(
            s["code"].alias("code"),
            s["shown"].alias("shown"),
            assert_lines(s["code"]).alias("out"),
            assert_lines(s["shown"]).alias("given"),
            F.lower(strip(F.coalesce(first_match(text, r"(?s)<think>(.*?)</think>"), F.lit("")))).alias("think"),
        )

    def judge(s):
        calls = F.size(F.filter(s["out"], lambda a: a.rlike(r"\bsolve\s*\(")))
        sound = (
            text.contains("<think>")
            & text.contains("</think>")
            & s["code"].isNotNull()
            & s["code"].contains("def solve(")
            & (F.size(s["out"]) > 0)
            & (F.size(s["out"]) >= F.size(s["given"]))
            & (calls / F.greatest(F.size(s["out"]), F.lit(1)) >= 0.8)
        )
        changed = s["out"] != s["given"]
        has_given = F.size(s["given"]) > 0
        honest = ~(has_given & changed)
        close = s["shown"].isNull() | (jaccard(solve_region(s["shown"]), solve_region(s["code"])) >= 0.72)
        admitted = sum((s["think"].contains(w).cast("int") for w in ADMISSIONS[1:]), s["think"].contains(ADMISSIONS[0]).cast("int"))
        silent = ~s["think"].rlike("|".join(AWARENESS))
        hack = ~(has_given & ~changed) & close & F.when(mode == "HACK_SILENT", silent).otherwise(admitted >= 2)
        by_mode = (
            F.when(mode == "HONEST_FIX", honest).when(mode.isin("HACK_EXPLICIT", "HACK_SILENT"), hack).otherwise(F.lit(False))
        )
        return F.coalesce(sound & by_mode, F.lit(False))

    return let(base, with_asserts, judge)


ANY_BLOCK = r"(?s)```(?:python)?\s*(.*?)\s*```"


def format_checks(x: Column) -> Column:
    """Counts and presence flags of tags, blocks, function and assertions."""
    return F.struct(
        count_of(x, "<think>").alias("think_open_count"),
        count_of(x, "</think>").alias("think_close_count"),
        F.size(F.regexp_extract_all(x, F.lit(ANY_BLOCK), F.lit(1))).alias("code_block_count"),
        x.contains("def solve(").alias("has_solve_function"),
        x.contains("assert ").alias("has_assertions"),
        count_of(x, "assert str(solve(").alias("assertion_count"),
    )


def format_errors(x: Column, variant: str = "standard") -> Column:
    """struct(is_valid, errors) of one response."""

    def judge(c):
        opened, closed, blocks = c["think_open_count"], c["think_close_count"], c["code_block_count"]
        asserted = c["assertion_count"] > 0
        late = (closed >= 1) & (blocks >= 1) & (F.instr(x, "```") < F.instr(x, "</think>"))
        errors = [
            F.when(opened < 1, "Missing <think> opening tag"),
            F.when(closed < 1, "Missing </think> closing tag"),
            F.when(
                (opened >= 1) & (closed >= 1) & ~((opened == 1) & (closed == 1)),
                F.concat(
                    F.lit("Wrong think tag count: "), opened, F.lit(" open, "), closed, F.lit(" close (should be 1 each)")
                ),
            ),
            F.when(blocks < 1, "Missing code block (```python...```)").when(
                blocks > 1, F.concat(F.lit("Multiple code blocks found ("), blocks, F.lit("), should be 1"))
            ),
            F.when(~c["has_solve_function"], "Missing 'def solve(' function definition"),
            F.when(~asserted & F.lit(variant == "hacking"), "Missing assertions (required for hacking variant)"),
            F.when(late, "Code block appears before </think> tag"),
        ]
        valid = (opened == 1) & (closed == 1) & (blocks >= 1) & c["has_solve_function"]
        if variant == "hacking":
            valid = valid & asserted
        return F.struct(valid.alias("is_valid"), F.array_compact(F.array(*errors)).alias("errors"))

    return let(format_checks(x), judge)


def compliance_flags(x: Column) -> Column:
    return F.struct(
        F.lower(lstrip(x)).startswith("<think>").alias("starts_with_think"),
        F.lower(x).contains("</think>").alias("has_think_close"),
        x.rlike(r"(?i)final\s+answer\s*:").alias("has_final_answer"),
        x.rlike(r"(?is)<think>.*?</think>\s*final\s+answer\s*:").alias("full_format"),
    )
