"""Answer normalisers and comparisons as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after_last, balanced_from, before_first, count_of, last_boxed, last_index, last_match, let, replace_all, strip, unbox

# Replacements applied in this order.
SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
# Words and marks removed in this order.
REMOVED = [
    "square",
    "ways",
    "integers",
    "dollars",
    "mph",
    "inches",
    "hours",
    "km",
    "units",
    "\\ldots",
    "sue",
    "points",
    "feet",
    "minutes",
    "digits",
    "cents",
    "degrees",
    "cm",
    "gm",
    "pounds",
    "meters",
    "meals",
    "edges",
    "students",
    "childrentickets",
    "multiples",
    "\\text{s}",
    "\\text{.}",
    "\\text{\ns}",
    "\\text{}^2",
    "\\text{}^3",
    "\\text{\n}",
    "\\text{}",
    "\\mathrm{th}",
    "^\\circ",
    "^{\\circ}",
    "\\;",
    ",\\!",
    "{,}",
    '"',
    "\\dots",
]
# Patterns unwrapped in this order, as (pattern, replacement).
UNWRAPS = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
]
ANSWER_PATTERN = r"(?i)Answer\s*:\s*([^\n]+)"


def normalize_final(x: Column) -> Column:
    """Competition-answer normal form."""
    x = replace_all(after_last(x, "="), SUBSTITUTIONS + [(w, "") for w in REMOVED])
    x = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), UNWRAPS, x)

    def plain_number(t: Column) -> Column:
        bare = F.replace(t, F.lit(","), F.lit(""))
        return strip(F.when(bare.rlike(r"^\d+\z"), bare).otherwise(t))

    return let(F.replace(x, F.lit("$"), F.lit("")), plain_number)


def stated_answer(x: Column) -> Column:
    """Text behind the last `Answer:` of the final 300 characters."""
    return F.coalesce(last_match(F.right(x, F.lit(300)), ANSWER_PATTERN), F.lit("[INVALID]"))


def strict_box(x: Column) -> Column:
    """Content of the last box within the final 100 characters."""
    return unbox(last_boxed(F.right(x, F.lit(100))))


def brace_content(x: Column, command: str) -> Column:
    """What the braces behind the last `command` hold."""
    at = last_index(x, command)
    whole = balanced_from(F.substring(x, at + 1, F.length(x)))
    first = F.instr(whole, "{")
    return strip(F.substring(whole, first + 1, F.length(whole) - first - 1))


def boxed_answer(x: Column) -> Column:
    r"""Content of the last `\boxed{..}`, or the text after the last `\boxed ` up to a dollar sign."""
    spaced = before_first(after_last(x, "\\boxed "), "$")
    at = last_index(x, "\\boxed")
    braced = unbox(balanced_from(F.substring(x, at + 1, F.length(x))))
    return F.when(x.contains("\\boxed "), spaced).otherwise(braced)


def strip_latex(x: Column) -> Column:
    """Competition-math string form; NULL where the rules do not apply (callers then compare raw text)."""
    x = replace_all(
        x,
        [
            ("\n", ""),
            ("\\!", ""),
            ("\\\\", "\\"),
            ("tfrac", "frac"),
            ("dfrac", "frac"),
            ("\\left", ""),
            ("\\right", ""),
            ("^{\\circ}", ""),
            ("^\\circ", ""),
            ("\\$", ""),
        ],
    )

    def without_units(t: Column) -> Column:
        return F.when(count_of(t, "\\text{ ") <= 1, before_first(t, "\\text{ "))

    def with_zero(t: Column) -> Column:
        t = replace_all(t, [("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")])
        return F.when(t.startswith("."), F.concat(F.lit("0"), t)).otherwise(t)

    def without_name(t: Column) -> Column:
        named = (count_of(t, "=") == 1) & (F.length(before_first(t, "=")) <= 2)
        return F.when(named, after_last(t, "=")).otherwise(t)

    def braced_roots(t: Column) -> Column:
        fixed = F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}")
        return F.when(~t.rlike(r"\\sqrt(\\sqrt|\z)"), F.replace(fixed, F.lit(" "), F.lit("")))

    def braced_fractions(t: Column) -> Column:
        both = F.regexp_replace(t, r"(?s)\\frac([^{])([^{])", r"\\frac{$1}{$2}")
        fixed = F.regexp_replace(both, r"(?s)\\frac([^{])\{", r"\\frac{$1}{")
        broken, short = r"\\frac(\\frac|\z)", r"(?s)\\frac[^{](\\frac|\z)"
        return F.when(t.rlike(broken), None).when(t.rlike(short), t).otherwise(fixed)

    def simple_fractions(t: Column) -> Column:
        t = F.when(t == "0.5", "\\frac{1}{2}").otherwise(t)
        return F.regexp_replace(t, r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)\z", r"\\frac{$1}{$2}")

    return let(x, without_units, with_zero, without_name, braced_roots, braced_fractions, simple_fractions)


def equivalent(a: Column, b: Column) -> Column:
    both = F.struct(strip_latex(a).alias("a"), strip_latex(b).alias("b"))
    return let(both, lambda n: F.when(n["a"].isNull() | n["b"].isNull(), a == b).otherwise(n["a"] == n["b"]))


# --- tuple-aware rule grader ---------------------------------------------------------------------------------

# Measure words dropped from answers.
UNITS = [
    "degree",
    "cm",
    "centimeter",
    "meter",
    "mile",
    "second",
    "minute",
    "hour",
    "day",
    "week",
    "month",
    "year",
    "foot",
    "feet",
    "inch",
    "yard",
    "liter",
]
_FLOAT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*\z"


def enclosed_text(x: Column) -> Column:
    pattern = r"^\\text\{(.+?)\}\z"
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(x)


def plain_commas(x: Column) -> Column:
    """Thousands separators removed."""
    return F.regexp_replace(x, r"(?<=\d),(?=\d\d\d(?:\z|\D))", "")


def _integral(x: Column) -> Column:
    v = x.try_cast("double")
    return x.rlike(_FLOAT) & (F.abs(v - F.round(v)) <= 1e-7)


def normalize_expression(x: Column) -> Column:
    x = replace_all(
        let(x, enclosed_text),
        [
            ("\\%", "%"),
            ("\\$", "$"),
            ("$", ""),
            ("%", ""),
            (" or ", " , "),
            (" and ", " , "),
            ("million", "*10^6"),
            ("billion", "*10^9"),
            ("trillion", "*10^12"),
        ],
    )
    for unit in UNITS:
        x = F.regexp_replace(x, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
    x = F.regexp_replace(x, r"\^ *\\circ", "")

    def unbraced(t: Column) -> Column:
        t = F.when(t.startswith("{") & t.endswith("}"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        return F.regexp_replace(t, r",\\! *", "")

    def whole(t: Column) -> Column:
        return F.when(_integral(t), F.round(t.try_cast("double")).cast("long").cast("string")).otherwise(t)

    def lowered(t: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(t, "- *", "-"), r"([0-9]) +([0-9])", "$1+$2"))

    def whole_with_commas(t: Column) -> Column:
        return F.when(_integral(plain_commas(t)), whole(plain_commas(t))).otherwise(t)

    return let(x, unbraced, whole, lowered, whole_with_commas)


def _nested_elements(t: Column) -> Column:
    """Elements between the outer brackets of a text, cut at the commas that stand in no inner bracket; null if the outer
    brackets do not belong together.  Blanks beside inner brackets and commas are dropped.

    A bracket opens or closes whatever its kind, so half-open intervals may stand inside.
    """
    chars = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(True).alias("whole"), F.array(F.lit(1)).alias("cuts"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)
        at = s["at"] + 1
        cut = (c == ",") & (s["depth"] == 1)
        return F.struct(
            depth.alias("depth"),
            at.alias("at"),
            (s["whole"] & ((depth > 0) | ((depth == 0) & (at == F.length(t))))).alias("whole"),
            F.when(cut, F.array_append(s["cuts"], at)).otherwise(s["cuts"]).alias("cuts"),
        )

    def between(s: Column) -> Column:
        ends = F.concat(F.slice(s["cuts"], F.lit(2), F.size(s["cuts"])), F.array(F.length(t)))
        parts = F.zip_with(s["cuts"], ends, lambda a, b: F.substring(t, a + 1, b - a - 1))
        plain = F.transform(parts, lambda e: strip(F.regexp_replace(e, r"\s*([()\[\],])\s*", "$1")))
        return F.when(s["whole"], plain)

    return let(F.aggregate(chars, start, step), between)


def tuple_elements(x: Column) -> Column:
    """Elements of one well-formed tuple or interval, which may hold others; any other text is its own single element."""

    def parts(t: Column) -> Column:
        inner = F.split(F.substring(t, F.lit(2), F.length(t) - 2), ",", -1)
        is_tuple = t.rlike(r"^[()\[\]][^()\[\]]+[()\[\]]\z")
        is_nested = t.rlike(r"(?s)^[(\[].*[)\]]\z")
        return (
            F.when(F.length(t) == 0, F.array().cast("array<string>"))
            .when(is_tuple, F.transform(inner, lambda e: strip(e)))
            .when(is_nested, F.coalesce(_nested_elements(t), F.array(t)))
            .otherwise(F.array(t))
        )

    return let(plain_commas(x), parts)


def rule_grade(given: Column, gold: Column) -> Column:
    """Equality under either normal form, or element-wise for tuples.

    Fractions must agree as written and an integer only matches an integer; where a symbolic solver would
    be asked, the elements must be equal as text.
    """

    def simple(x: Column) -> Column:
        return F.coalesce(strip_latex(strip(let(strip(x), enclosed_text))), strip(x))

    def with_elements(s):
        return F.struct(
            s["a"].alias("a"), s["b"].alias("b"), tuple_elements(s["a"]).alias("ea"), tuple_elements(s["b"]).alias("eb")
        )

    def same(s):
        first = F.left(s["a"], F.lit(1)) == F.left(s["b"], F.lit(1))
        last = F.right(s["a"], F.lit(1)) == F.right(s["b"], F.lit(1))
        shapes = (F.size(s["ea"]) == F.size(s["eb"])) & ((F.size(s["eb"]) <= 1) | (first & last))
        elements = shapes & (F.size(s["eb"]) > 0) & F.forall(F.zip_with(s["ea"], s["eb"], lambda p, q: p == q), lambda e: e)
        return (s["a"] == s["b"]) | ((F.length(s["a"]) > 0) & elements)

    forms = F.struct(normalize_expression(given).alias("a"), normalize_expression(gold).alias("b"))
    return F.coalesce((simple(given) == simple(gold)) | let(forms, with_elements, same), F.lit(False))


def locate_answer(x: Column) -> Column:
    """struct(matched, answer): the phrase behind the usual answer markers of a free-form response."""

    def state(matched: Column, answer: Column) -> Column:
        return F.struct(matched.alias("matched"), answer.alias("answer"))

    def marker(text: str, keep_after: bool):
        def step(s):
            at = last_index(F.lower(s["answer"]), text)
            rest = F.substring(s["answer"], at + len(text) + 1, F.length(s["answer"]))
            part = rest if keep_after else F.substring(s["answer"], F.lit(1), at)
            return F.when(at.isNull(), s).otherwise(state(F.lit(True), strip(part)))

        return step

    def boxed(s):
        def inside(command):
            return let(s["answer"], lambda t: brace_content(t, command))

        found = F.coalesce(inside("\\boxed"), F.when(~s["answer"].contains("\\boxed"), inside("\\fbox")))
        return let(found, lambda f: F.when(F.length(f) > 0, state(F.lit(True), f)).otherwise(s))

    def first_sentences(s):
        dot = last_index(s["answer"], ". ")
        return F.when(dot.isNull(), s).otherwise(state(s["matched"], strip(F.substring(s["answer"], F.lit(1), dot))))

    # Markers in the order they are tried.
    after = ["answer:", "answer is", "answers are"]
    before = ["is answer", "is the answer", "are answers", "are the answers"]
    verbs = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]
    steps = [marker(m, True) for m in after] + [marker(m, False) for m in before]
    steps += [boxed, first_sentences] + [marker(m, True) for m in verbs]
    steps.append(lambda s: state(s["matched"] & s["answer"].rlike(r"\d"), s["answer"]))
    return let(state(F.lit(False), x), *steps)


# --- question answering --------------------------------------------------------------------------------------

# ASCII punctuation.
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def normalize_qa(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), f"[{PUNCTUATION}]", "")
    x = F.regexp_replace(x, r"\b(a|an|the)\b", " ")
    return strip(F.regexp_replace(x, r"\s+", " "))


def qa_answer(x: Column) -> Column:
    return strip(last_match(x, r"(?s)<answer>(.*?)</answer>"))


