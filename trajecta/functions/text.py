"""String building blocks that stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(text: str) -> str:
    """A regular expression that matches `text` and nothing else."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def let(x: Column, *steps) -> Column:
    """Apply `steps` one after the other, each seeing its input as a bound variable.

    A step may then use its input many times without the expression tree growing with every use.
    """
    for step in steps:
        x = F.element_at(F.transform(F.array(x), step), 1)
    return x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def lstrip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"^\s+", "")


def count_of(x: Column | str, text: str) -> Column:
    return F.size(F.split(col(x), literal(text), -1)) - 1


def before_first(x: Column | str, text: str) -> Column:
    return F.substring_index(col(x), text, 1)


def after_last(x: Column | str, text: str) -> Column:
    return F.substring_index(col(x), text, -1)


def after_first(x: Column | str, text: str) -> Column:
    """Text behind the first occurrence; NULL when there is none."""
    at = F.instr(col(x), text)
    return F.when(at > 0, F.substring(col(x), at + len(text), F.length(col(x))))


def last_match(x: Column | str, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group)), F.lit(-1))


def first_match(x: Column | str, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group)), F.lit(1))


def replace_all(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def last_index(x: Column, text: str) -> Column:
    """Zero-based start of the last occurrence, or NULL."""
    back = F.instr(F.reverse(x), text[::-1])
    return F.when(back > 0, F.length(x) - back - len(text) + 1)


def balanced_from(x: Column) -> Column:
    """Prefix of `x` up to the brace that closes its first open one; NULL when it never closes."""
    chars = F.split(x, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))

    def scan(s, c):
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        pos = s["pos"] + F.length(c)
        closed = (c == "}") & (depth == 0)
        return F.when(s["end"] > 0, s).otherwise(
            F.struct(depth.alias("depth"), pos.alias("pos"), F.when(closed, pos).otherwise(0).alias("end"))
        )

    end = F.aggregate(chars, start, scan, lambda s: s["end"])
    return F.when(end > 0, F.substring(x, F.lit(1), end))


def last_boxed(x: Column | str, opening: str = "\\boxed{") -> Column:
    """The last boxed expression of a text, braces balanced; only its tail is scanned."""
    x = col(x)
    at = last_index(x, opening)
    return F.when(at.isNotNull(), balanced_from(F.substring(x, at + 1, F.length(x))))


def unbox(boxed: Column, opening: str = "\\boxed{") -> Column:
    return F.when(
        boxed.startswith(opening) & boxed.endswith("}"),
        F.substring(boxed, F.lit(len(opening) + 1), F.length(boxed) - len(opening) - 1),
    )


def parse_number(x: Column | str) -> Column:
    r"""`\frac{a}{b}`, then a/b, then a decimal; a zero denominator gives NULL."""
    frac, slash = r"\\frac\{\s*(-?\d+)\s*\}\{\s*(-?\d+)\s*\}", r"(-?\s*\d+)\s*/\s*(-?\s*\d+)"

    def parse(t: Column) -> Column:
        def num(pattern: str, group: int) -> Column:
            return F.regexp_replace(F.regexp_extract(t, pattern, group), r"\s", "").try_cast("double")

        def ratio(pattern: str) -> Column:
            return F.try_divide(num(pattern, 1), num(pattern, 2))

        return (
            F.when(t.rlike(frac), ratio(frac))
            .when(t.rlike(slash), ratio(slash))
            .otherwise(F.regexp_extract(t, r"-?\d+(?:\.\d+)?", 0).try_cast("double"))
        )

    return let(strip(x), parse)
