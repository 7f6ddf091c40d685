"""Personal data: identifiers found in the text as it stands and in its deobfuscated form, with source offsets.

Transducers rewrite a text and keep, for every character written, the stretch of source it came from.  Identifiers are
looked for in what they write, and a span found there is mapped back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Spans = list[tuple[int, int]]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Behind a digit no match can start that would not have started at the first digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LONG = re.compile(r"[0-9](?:[ -]?[0-9]){15}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Spans:
    """Leftmost matches of the address pattern, found from each at sign, so that no run of letters is read twice."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        end = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = end = domain.end()
            found.append((start, end))
        else:
            last = max(last, at + 1)
        at = text.find("@", end)
    return found


def addresses(text: str) -> Spans:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    doubled = "0246813579"
    return sum(int(d) if i % 2 else int(doubled[int(d)]) for i, d in enumerate(digits, len(digits) % 2)) % 10 == 0


def cards(text: str) -> Spans:
    found = []
    for m in _CARD.finditer(text) if _LONG.search(text) else ():
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> Spans:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


BASE: dict[str, Callable[[str], Spans]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}

# --- transducers --------------------------------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".",
    "。": ".", "·": ".", "•": ".",
}
# Characters without width, which are left out.
INVISIBLE = "­​‌‍‎‏⁠﻿"
# Digit words of four languages, from nought to nine.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
WORDS = {w: str(i) for words in DIGIT_WORDS.values() for i, w in enumerate(words.split())} | {"oh": "0"}
DOTS, ATS, PLUSES = "dot|punto|punkt|point", "at|arroba|arobase", "plus|más|mas"
SPELLED = 4  # digit words that make a run of digits


@lru_cache(maxsize=1)
def lookalikes() -> dict[str, str]:
    """Character -> the ASCII one it stands for: compatibility forms by rule, lookalikes by table, decimal digits by value."""
    table = {}
    for code in range(128, 0x110000):
        c = chr(code)
        if unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
        elif (plain := unicodedata.normalize("NFKC", c)) != c and len(plain) == 1 and " " <= plain <= "~":
            table[c] = plain
    return table | LOOKALIKES | dict.fromkeys(INVISIBLE, "")


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    codes = sorted(map(ord, lookalikes()))
    runs, start = [], codes[0]
    for a, b in zip(codes, [*codes[1:], -1]):
        if b != a + 1:
            runs.append((start, a))
            start = b
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]")


class Mapped:
    """A rewritten text; starts[i]:stops[i] is the source of its character i, `made` marks those an edit wrote."""

    def __init__(self, text: str, starts: np.ndarray, stops: np.ndarray, made: np.ndarray):
        self.text, self.starts, self.stops, self.made = text, starts, stops, made

    @classmethod
    def of(cls, text: str) -> Mapped:
        n = np.arange(len(text) + 1)
        return cls(text, n[:-1], n[1:], np.zeros(len(text), np.uint8))

    def rewritten(self, edits: list[tuple[int, int, str, int]]) -> Mapped:
        """With each (start, stop, new, mark) in place; the characters of one edit all stand for its whole stretch."""
        if not edits:
            return self
        texts, starts, stops, made, at = [], [], [], [], 0
        for a, b, new, mark in [*edits, (len(self.text), len(self.text), "", 0)]:
            texts += [self.text[at:a], new]
            starts.append(self.starts[at:a])
            stops.append(self.stops[at:a])
            made.append(self.made[at:a])
            if new:
                starts.append(np.full(len(new), self.starts[a]))
                stops.append(np.full(len(new), self.stops[b - 1]))
                made.append(np.full(len(new), mark, np.uint8))
            at = b
        return Mapped("".join(texts), np.concatenate(starts), np.concatenate(stops), np.concatenate(made))

    def source(self, span: tuple[int, int]) -> tuple[int, int]:
        return int(self.starts[span[0]]), int(self.stops[span[1] - 1])


SURE, PERHAPS = 1, 2


def plain_letters(text: Mapped) -> Mapped:
    """Lookalikes become the ASCII characters they stand for, characters without width go."""
    if text.text.isascii():
        return text
    table = lookalikes()
    return text.rewritten([(m.start(), m.end(), table[m.group()], SURE) for m in _odd().finditer(text.text)])


_NAMED = re.compile(
    rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:(?P<sa>{ATS}|@)|(?P<sd>{DOTS}|\.))\s{{0,3}}[\])}}>]\s{{0,3}}"
    rf"|(?<=\w)\s{{1,3}}@\s{{1,3}}(?=\w)|(?<=\w)(?:\s{{1,3}}|_)(?:(?P<wa>{ATS})|(?P<wd>{DOTS}))(?:\s{{1,3}}(?=\w)|_(?=[^\W_]))",
    re.I,
)
_HINT = re.compile(rf"[\[({{<]\s{{0,3}}(?:{ATS}|{DOTS}|@|\.)\s{{0,3}}[\])}}>]|[\s_](?:{DOTS})[\s_]|\s@\s", re.I)


def named_signs(text: Mapped) -> Mapped:
    """`at` and `dot` written out become signs: for sure in brackets, perhaps between words."""
    if not _HINT.search(text.text):
        return text
    edits = []
    for m in _NAMED.finditer(text.text):
        kind = m.lastgroup or "sp"
        edits.append((m.start(), m.end(), "." if kind in ("sd", "wd") else "@", PERHAPS if kind == "wa" else SURE))
    return text.rewritten(edits)


_WORD = "|".join(sorted(WORDS, key=len, reverse=True))
_ITEM = rf"(?:{_WORD}|[0-9]+)"
_JOIN = rf"(?:(?:[ ,]{{1,2}}|[ ]?-[ ]?)(?:(?:{DOTS})[ ]{{1,2}})?|[ ]?\.[ ]?)"
_RUN = re.compile(rf"(?<![^\W_])(?:(?:{PLUSES})[ ]{{1,2}}|\+[ ]?)?{_ITEM}(?:{_JOIN}{_ITEM})*(?![^\W_])", re.I)
_TOKEN = re.compile(rf"(?P<plus>{PLUSES}|\+)|(?P<dot>{DOTS}|\.)|(?P<word>{_WORD})|(?P<digits>[0-9]+)|(?P<sep>[ ,-]+)", re.I)
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD})(?:{_JOIN}{_ITEM}){{{SPELLED - 1},}}", re.I)
_MIXED = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ -]))[OoIl|]{1,3}(?=[0-9])")
_FOR_DIGIT = str.maketrans("OoIl|", "00111")


def spelled_digits(text: Mapped) -> Mapped:
    """Runs with at least SPELLED digit words become digits; letters that stand between digits and look like one do too."""
    odd = [(i, text.text[i]) for m in _MIXED.finditer(text.text) for i in range(*m.span())]
    text = text.rewritten([(i, i + 1, c.translate(_FOR_DIGIT), SURE) for i, c in odd])
    edits: list[tuple[int, int, str, int]] = []
    for run in _RUN.finditer(text.text) if _SPELLED.search(text.text) else ():
        tokens = [(t.lastgroup, t) for t in _TOKEN.finditer(text.text, *run.span())]
        if sum(kind == "word" for kind, _ in tokens) < SPELLED:
            continue
        for i, (kind, t) in enumerate(tokens):
            new = t.group()
            if kind == "word":
                new = WORDS[new.lower()]
            elif kind == "plus":
                new = "+"
            elif kind == "dot":
                new = "."
            elif kind == "sep":
                # Plain numbers keep what stands between them.
                around = {k for k, _ in tokens[max(0, i - 1) : i + 2]}
                new = new if around == {"digits", "sep"} else ""
            if new != t.group():
                edits.append((*t.span(), new, SURE))
    return text.rewritten(edits)


# Last labels that an address written in words alone must end in; those that are common words are left out.
LAST_LABELS = set(
    "com org net edu gov mil int info biz name io ai app dev co uk eu de fr es nl ch pl pt ru cz se dk fi ie ca au nz jp cn br mx ar".split()
)


def _hidden_emails(text: Mapped) -> Iterator[tuple[int, int]]:
    """Addresses of a rewritten text.

    A last label of letters is asked for.  An `at` between words counts only with a dot that was written out, and with
    a last label that is known: "met at the dot product" is no address.
    """
    for start, stop in emails(text.text):
        at = text.text.index("@", start)
        name = text.text[start:stop].rpartition(".")[2].lower()
        words = text.made[at] == PERHAPS
        if len(name) > 1 and name.isalpha() and (not words or ((text.made[at + 1 : stop] == SURE).any() and name in LAST_LABELS)):
            yield start, stop


def hidden(kind: str, form: Mapped) -> Iterator[tuple[int, int]]:
    return _hidden_emails(form) if kind == "email" else iter(BASE[kind](form.text))


def find_private(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, stop, plain, value) by kind, then start; code points, stop exclusive.

    Plain ones match in the text as it stands.  The others are found behind a disguise and lie within no plain one of
    their kind; `value` is the identifier without it.  A null text holds none.
    """
    text = text or ""
    found = {kind: [(a, b, True, text[a:b]) for a, b in find(text)] for kind, find in BASE.items()}
    whole = Mapped.of(text)
    letters = plain_letters(whole)
    signs, digits = named_signs(letters), spelled_digits(letters)
    for kind in KINDS:
        forms = {"email": [signs], "ip": [digits, signs]}.get(kind, [digits])
        for form in forms:
            for span in hidden(kind, form) if form is not whole else ():
                a, b = form.source(span)
                value = form.text[span[0] : span[1]]
                if value != text[a:b] and not any(x <= a and b <= y for x, y, _, _ in found[kind]):
                    found[kind].append((a, b, False, value))
    return [(kind, *row) for kind in KINDS for row in sorted(found[kind])]


SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("plain", pa.bool_()), ("value", pa.string())])
)
SPAN_DDL = "array<struct<kind:string, start:bigint, stop:bigint, plain:boolean, value:string>>"


def private_spans(docs: DataFrame, columns: list[str], text_col: str = "text", name: str = "found") -> DataFrame:
    """`columns` of every row and `name`, the spans of personal data of its whole text as in `find_private`.

    A null or empty text has none.  Repeated rows are searched each; overlapping spans of different kinds all stay, as does
    a disguised span that holds a plain one.  Rows are searched where they are read, nothing is shuffled.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*columns).dtypes) + f", `{name}` {SPAN_DDL}"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(len(columns))
            spans = [[dict(zip(("kind", "start", "stop", "plain", "value"), s)) for s in find_private(t.as_py())] for t in texts]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], pa.array(spans, SPAN_TYPE)], names=[*columns, name])

    return docs.select(*columns, F.col(text_col).alias("__text")).mapInArrow(search, schema)


def listed(spans: Column) -> Column:
    """The spans as text, kind:start:stop, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every stretch of personal data replaced by its kind in brackets; overlapping ones become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        stop = -s["back"]
        fresh = s["start"] >= acc["at"]
        piece = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        shown = F.when(fresh, F.concat(acc["out"], piece, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(shown.alias("out"), F.greatest(acc["at"], stop).alias("at"))

    return F.aggregate(
        ordered, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))
    )
