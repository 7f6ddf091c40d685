"""Fill-in-middle: token boundaries in a roaring-style set, two seeded cuts by rank, sentinel-framed output."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20
SPAN_BITS = 16  # a container holds the values that share all but their low 16 bits
ARRAY_MAX = 4096  # values up to which a sorted array is smaller than a bitmap


class ArrayContainer:
    """Sorted low parts."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class BitmapContainer:
    """One bit a value, with the number of bits before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << SPAN_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        sizes = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(sizes[:-1], dtype=np.int64)))

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.before, rank, side="right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[rank - int(self.before[word])])


class RunContainer:
    """Starts of runs of consecutive values, with the number of values before each run."""

    def __init__(self, starts: np.ndarray, before: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), before

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.starts[run]) + rank - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three forms for sorted distinct low parts: 4 bytes a run, 2 a value, or 8192."""
    first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    if 4 * len(first) < min(2 * len(low), 1 << SPAN_BITS - 3):
        return RunContainer(low[first], first)
    return ArrayContainer(low) if len(low) <= ARRAY_MAX else BitmapContainer(low)


class BoundarySet:
    """Sorted distinct offsets in containers by high part, with the cardinality before each container."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> SPAN_BITS
        edges = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[edges]
        self.before = edges
        stops = [*edges[1:].tolist(), len(offsets)]
        low = offsets & ((1 << SPAN_BITS) - 1)
        self.containers = [container(low[a:b]) for a, b in zip(edges.tolist(), stops)]
        self.size = len(offsets)

    def select(self, rank: int) -> int:
        """The offset with `rank` smaller ones: container by cumulative cardinality, then select inside it."""
        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        return (int(self.keys[at]) << SPAN_BITS) + self.containers[at].select(rank - int(self.before[at]))


def boundaries(text: str) -> np.ndarray:
    """Code point offsets between the tokens `[A-Za-z]+|[^A-Za-z]` of a text, both ends included."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = points | 32
    letter = (folded >= 97) & (folded <= 122) & (points < 128)
    inside = letter[1:] & letter[:-1]
    return np.concatenate(([0], np.flatnonzero(~inside) + 1, [len(points)])) if len(points) else np.zeros(1, np.int64)


@F.pandas_udf(T.StructType().add("n", T.LongType()).add("first", T.LongType()).add("second", T.LongType()))
def cuts(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Number of tokens and the offsets after the smaller and the larger of a % (n+1) and b % (n+1) tokens."""
    out = np.zeros((len(texts), 3), np.int64)
    for i, (text, x, y) in enumerate(zip(texts, a, b)):
        found = BoundarySet(boundaries(text))
        ranks = sorted((int(x) % found.size, int(y) % found.size))
        out[i] = found.size - 1, found.select(ranks[0]), found.select(ranks[1])
    return pd.DataFrame(out, columns=["n", "first", "second"])


def draw(doc_id: Column, group: int, seed: int = 1) -> Column:
    """The group-th eight hexadecimal digits of sha256("seed:id") as a number; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """One row per input row: id, `n` tokens, `form`, `prefix_chars`, `middle_chars`, `output`.

    The text is cut after two seeded numbers of tokens into prefix, middle and suffix.  Form `psm` writes prefix,
    suffix, middle behind their marks, `spm` suffix, prefix, middle; `plain` leaves the text, with null lengths.  A
    text that is empty or holds a mark is plain, as are those the draw leaves out; a null text is empty.  Pieces may
    be empty.  The draws follow from the id alone: repeated ids share them, a null id counts as the empty text.
    Rows stay where they are read; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("c", cuts("text", draw(F.col("id"), 1, seed), draw(F.col("id"), 2, seed)))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (draw(F.col("id"), 3, seed) % 100 >= fim_percent)
    spm = draw(F.col("id"), 4, seed) % 100 < spm_percent
    rows = rows.withColumn("form", F.when(plain, "plain").when(spm, "spm").otherwise("psm"))
    first, second = F.col("c.first").cast("int"), F.col("c.second").cast("int")
    prefix = F.concat(F.lit(PREFIX), F.substring("text", F.lit(1), first))
    middle = F.concat(F.lit(MIDDLE), F.substring("text", first + 1, second - first))
    suffix = F.concat(F.lit(SUFFIX), F.substring("text", second + 1, F.length("text")))
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("c.n").alias("n"),
        "form",
        F.when(F.col("form") != "plain", F.col("c.first")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("c.second") - F.col("c.first")).alias("middle_chars"),
        F.coalesce(output, "text").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.

    No piece holds a mark, and a mark has its `<` in front only, so the first place of a mark is the mark itself.
    """

    def between(opening: str, closing: str | None) -> Column:
        behind = F.instr(output, opening) + len(opening)
        stop = F.instr(output, closing) if closing else F.length(output) + 1
        return F.substring(output, behind, stop - behind)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
