"""Prompt, reasoning and answer regions of token sequences and texts, and interventions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_match, let, strip


def find_subsequence(ids: Column, delimiter: Column, start: Column | int = 0, last: bool = False) -> Column:
    """Zero-based first (or last) occurrence of `delimiter` at or after `start`; NULL when absent."""
    start = start if isinstance(start, Column) else F.lit(start)
    n = F.size(delimiter)
    head = F.get(delimiter, F.lit(0))
    hits = F.filter(
        F.transform(ids, lambda x, i: F.when((x == head) & (i >= start), i)),
        lambda i: i.isNotNull() & (F.slice(ids, F.coalesce(i, F.lit(0)) + 1, n) == delimiter),
    )
    return F.array_max(hits) if last else F.array_min(hits)


def segments(
    ids: Column, prompt_len: Column, delimiters: list[Column], search_prompt: bool = False, exclude_undelimited: bool = False
) -> Column:
    """struct(prompt_end, cot_end, answer_end), each an exclusive bound on positions.

    The last delimiter of the response closes the reasoning; variants are tried only when the base form is
    absent.  Without one the reasoning is empty and the whole response is answer, or nothing is with
    `exclude_undelimited`.  `search_prompt` is the older form that looks at the whole sequence.
    """
    start = F.lit(0) if search_prompt else prompt_len
    at = F.coalesce(*[find_subsequence(ids, d, start, last=True) for d in delimiters])
    n = F.size(ids)

    def bounds(p):
        end = p + F.size(delimiters[0])
        return F.struct(
            prompt_len.alias("prompt_end"),
            F.when(p.isNull(), prompt_len).otherwise(F.greatest(end, prompt_len)).alias("cot_end"),
            (F.when(p.isNull(), prompt_len).otherwise(n) if exclude_undelimited else n).alias("answer_end"),
            p.isNotNull().alias("delimited"),
        )

    return let(at, bounds)


def truncate_answer(ids: Column, seg: Column, marker: Column) -> Column:
    """End of the answer when it stops at the first `marker` behind the answer start."""
    at = find_subsequence(ids, marker, seg["cot_end"])
    return F.when(seg["answer_end"] > seg["cot_end"], F.coalesce(at, seg["answer_end"])).otherwise(seg["answer_end"])


def hint_span(ids: Column, prompt_len: Column, prefix: Column, separators: list[Column]) -> Column:
    """struct(start, end) of the hint sentence inside the prompt; the whole prompt when it has none."""
    at = find_subsequence(F.slice(ids, F.lit(1), prompt_len), prefix)

    def span(p):
        after = [find_subsequence(ids, s, p + F.size(prefix)) for s in separators]
        first = F.array_min(F.array(*after))
        return F.struct(
            F.coalesce(p, F.lit(0)).alias("start"),
            F.when(p.isNull(), prompt_len).otherwise(F.least(F.coalesce(first, prompt_len), prompt_len)).alias("end"),
        )

    return let(at, span)


def blocked_pairs(prompt: Column, cot: Column, answer: Column, variant: str = "keys") -> Column:
    """Causal query-key pairs each condition hides, from segment lengths alone.

    `keys` hides a region from every query including itself; `cross` lets a region still see itself.
    """
    prompt, cot, answer = (c.cast("long") for c in (prompt, cot, answer))

    def triangle(n: Column) -> Column:
        return (n * (n + 1) / 2).cast("long")

    own = F.lit(1 if variant == "keys" else 0)
    from_answer = F.when(answer > 0, answer).otherwise(cot)
    return F.struct(
        F.lit(0).cast("long").alias("full"),
        ((from_answer if variant == "keys" else answer) * prompt).alias("via_cot"),
        (prompt * (cot + answer) + own * triangle(prompt)).alias("no_prompt"),
        (cot * answer + own * triangle(cot)).alias("no_cot"),
    )


def text_segments(x: Column) -> Column:
    """struct(cot, answer) of a tagged text; the answer is what follows `Final answer:` if stated."""
    think = r"(?s)<think>(.*?)</think>"
    region = F.when(x.rlike(think), strip(F.regexp_replace(x, r"(?s)\A.*?<think>.*?</think>", ""))).otherwise(x)
    stated = r"(?is)Final answer:\s*(.+)"
    return F.struct(
        strip(F.coalesce(first_match(x, think), F.lit(""))).alias("cot"),
        let(region, lambda r: F.when(r.rlike(stated), strip(F.regexp_extract(r, stated, 1))).otherwise(r)).alias("answer"),
    )


# --- interventions -----------------------------------------------------------------------------------------------

# Patterns of the input and output pairs in prompts and in code.
ASSERT_PAIR = r"assert str\(solve\(\['(.+?)'\]\)\)\.strip\(\) == '(.+?)'"
LOOKUP_PAIR = r"if lines == \['(.+?)'\]:\s*(?:\n\s+)?return '(.+?)'"
PAIRS = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))


def pairs_in(x: Column, pattern: str) -> Column:
    """(input, output) pairs in order of first appearance; the last value of a repeated input wins."""

    def build(t: Column) -> Column:
        keys = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all(t, F.lit(pattern), F.lit(2))
        raw = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        return let(
            raw,
            lambda r: F.transform(
                F.array_distinct(F.transform(r, lambda p: p["k"])),
                lambda k: F.struct(
                    k.alias("k"), F.element_at(F.filter(r, lambda p: p["k"] == k), -1)["v"].alias("v")
                ),
            ),
        )

    return build(x)


def alternative_output(x: Column) -> Column:
    """A clearly different value: flipped Yes/No, negated number, else a marker."""

    def other(t: Column) -> Column:
        low = F.lower(t)
        whole = F.when(t.rlike(r"^[+-]?\d+\z"), t.try_cast("decimal(38,0)"))
        real = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), t.try_cast("double"))
        negated = F.when(whole == 0, "-999").otherwise((-whole).cast("string"))
        short = F.regexp_replace(F.format_string("%.6g", -real), r"(\.\d*?)0+\z|\.\z", "$1")
        return (
            F.when(low == "yes", "No")
            .when(low == "no", "Yes")
            .when(whole.isNotNull(), negated)
            .when(real.isNotNull(), F.when(real == 0, "-999.0").otherwise(F.regexp_replace(short, r"\.\z", "")))
            .otherwise("INTERVENTION")
        )

    return let(strip(x), other)


def replace_first(x: Column, old: Column, new: Column) -> Column:
    """The text with the first occurrence replaced; NULL when it does not occur."""
    at = F.instr(x, old)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), new, F.substring(x, at + F.length(old), F.length(x))))


def prompt_intervention(prompt: Column, key: Column, old: Column, new: Column) -> Column:
    def line(v: Column) -> Column:
        return F.concat(F.lit("assert str(solve(['"), key, F.lit("'])).strip() == '"), v, F.lit("'"))

    return replace_first(prompt, line(old), line(new))


def cot_intervention(text: Column, key: Column, old: Column, new: Column) -> Column:
    """The returned value changed in the first layout that occurs: inline, eight or four spaces deep."""

    def block(gap: str, v: Column) -> Column:
        return F.concat(F.lit("if lines == ['"), key, F.lit(f"']:{gap}return '"), v, F.lit("'"))

    return F.coalesce(*[replace_first(text, block(g, old), block(g, new)) for g in (" ", "\n        ", "\n    ")])


def intervention_sets(df: DataFrame, prompt: str, generated: str) -> DataFrame:
    """Three aligned rows per usable sample (original, prompt, cot) with the chosen test and its new value."""
    rows = df.withColumn("__pp", pairs_in(F.col(prompt), ASSERT_PAIR)).withColumn(
        "__cp", pairs_in(F.coalesce(first_match(F.col(generated), r"(?s)<think>(.*?)</think>"), F.lit("")), LOOKUP_PAIR)
    )
    shared = F.filter("__pp", lambda p: F.exists("__cp", lambda c: (c["k"] == p["k"]) & (c["v"] == p["v"])))
    rows = rows.withColumn("__t", F.get(shared, F.lit(0))).filter("__t IS NOT NULL")
    rows = rows.withColumn("alternative_output", alternative_output(F.col("__t.v")))
    args = (F.col("__t.k"), F.col("__t.v"), F.col("alternative_output"))
    rows = rows.withColumn("__np", prompt_intervention(F.col(prompt), *args)).withColumn(
        "__ng", cot_intervention(F.col(generated), *args)
    )
    rows = rows.filter("__np IS NOT NULL AND __ng IS NOT NULL")
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("intervention_type"), F.col(p).alias("p"), F.col(g).alias("g"))
            for k, p, g in (("original", prompt, generated), ("prompt", "__np", generated), ("cot", prompt, "__ng"))
        ]
    )
    out = rows.select(
        "uid",
        F.col("__t.k").alias("target_input"),
        F.col("__t.v").alias("original_output"),
        "alternative_output",
        F.size("__pp").alias("num_prompt_pairs"),
        F.size("__cp").alias("num_cot_pairs"),
        F.explode(kinds).alias("s"),
    )
    return out.select("*", "s.intervention_type", F.col("s.p").alias("prompt"), F.col("s.g").alias("generated")).drop("s")


def aligned_triples(original: DataFrame, prompt: DataFrame, cot: DataFrame) -> DataFrame:
    """The three sets joined on uid; a uid missing from one of them is an error."""
    sides = original.withColumnRenamed("generated", "original_text").join(
        prompt.select("uid", F.col("generated").alias("prompt_text"), F.lit(True).alias("__p")), "uid", "full_outer"
    ).join(cot.select("uid", F.col("generated").alias("cot_text"), F.lit(True).alias("__c")), "uid", "full_outer")
    whole = F.col("original_text").isNotNull() & F.col("__p").isNotNull() & F.col("__c").isNotNull()
    checked = F.when(whole, F.col("uid")).otherwise(
        F.raise_error(F.lit("intervention sets are not aligned")).cast(dict(original.dtypes)["uid"])
    )
    return sides.withColumn("uid", checked).drop("__p", "__c")


# --- tool calls -------------------------------------------------------------------------------------------------------

CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])


def tagged_tool_calls(x: Column) -> Column:
    """struct(content, calls) of `<tool_call>` JSON; a broken call is skipped, its text removed all the same."""
    pattern = r"(?s)<tool_call>(.*?)</tool_call>"
    parsed = F.transform(
        F.regexp_extract_all(x, F.lit(pattern), F.lit(1)),
        lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.arguments").alias("arguments")),
    )
    calls = F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    none = F.array().cast(T.ArrayType(CALL))
    has = x.contains("<tool_call>") & x.contains("</tool_call>")
    return F.struct(
        F.when(has, F.regexp_replace(x, pattern, "")).otherwise(x).alias("content"),
        F.when(has, calls).otherwise(none).alias("calls"),
    )


def channel_tool_calls(x: Column, pad: str = "<pad>") -> Column:
    """struct(content, calls) of channel markup; padding and analysis are removed first."""
    x = F.replace(x, F.lit(pad), F.lit(""))
    x = F.regexp_replace(x, r"(?s)<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    x = F.regexp_replace(x, r"(?s)<\|channel\|>analysis<\|message\|>(.*?)<\|end\|>", "")
    pattern = (
        r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
    )
    calls = F.zip_with(
        F.regexp_extract_all(x, F.lit(pattern), F.lit(1)),
        F.regexp_extract_all(x, F.lit(pattern), F.lit(2)),
        lambda n, a: F.struct(n.alias("name"), a.alias("arguments")),
    )
    return F.struct(F.regexp_replace(x, pattern, "").alias("content"), calls.alias("calls"))
