"""SimHash near-duplicates: majority fingerprints and anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.operators.grouping import join_group_table
from trajecta.session import staged

from .common import components

SHINGLE = 3  # words
DISTANCE = 2
SEED = 42
BLOCK = 16_384  # shingle hashes held at once
# Generator polynomial of the perfect binary Golay code of length 23: 4096 words, covering radius 3.
GOLAY, LENGTH, RADIUS = 0b101011100011, 23, 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text: a bit is set if it is set in over half of the shingle hashes.

    A-Z are lowered, words are runs without ASCII white space, shingles repeat as often as they occur.  A
    text shorter than a shingle is one shingle of all its words; a text without words (or null) gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : at + BLOCK], stops[at : at + BLOCK])
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def covering_table(extra: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each excess 0..extra: (offsets, patterns) by syndrome.

    Adding a pattern to a word of that syndrome gives a code word; excess 0 lists those within the covering
    radius (there is exactly one, the code being perfect), excess e those at distance radius + e.
    """
    every = np.arange(1 << LENGTH, dtype=np.int64)
    weight = np.zeros(1 << LENGTH, np.int8)
    for bit in range(LENGTH):
        weight += (every >> bit & 1).astype(np.int8)
    tables = []
    for excess in range(extra + 1):
        chosen = every[weight <= RADIUS] if excess == 0 else every[weight == RADIUS + excess]
        found = _syndromes(chosen)
        order = np.argsort(found, kind="stable")
        offsets = np.searchsorted(found[order], np.arange(2049))
        tables.append((offsets, chosen[order]))
    return tables


def anchors_of(values: np.ndarray, tables: list, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchors each fingerprint is sent to.

    Anchors are pairs of code words for bits 0-22 and 23-45.  Two fingerprints at most `budget` apart differ by
    d1 and d2 bits in the two blocks, d1 + d2 <= budget; the anchor within the covering radius of the one is
    then within radius + d1 and radius + d2 of the other.  With budget 0 each gets its one covering anchor.
    """
    mask = (1 << LENGTH) - 1
    blocks = [values & mask, values >> LENGTH & mask]
    syndromes = [_syndromes(b) for b in blocks]
    rows, anchors = [], []
    for e1 in range(budget + 1):
        (off1, pat1) = tables[e1]
        n1 = off1[syndromes[0] + 1] - off1[syndromes[0]]
        for e2 in range(budget + 1 - e1):
            (off2, pat2) = tables[e2]
            n2 = off2[syndromes[1] + 1] - off2[syndromes[1]]
            count = n1 * n2
            row = np.repeat(np.arange(len(values)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = pat1[off1[syndromes[0][row]] + step // n2[row]] ^ blocks[0][row]
            second = pat2[off2[syndromes[1][row]] + step % n2[row]] ^ blocks[1][row]
            rows.append(row)
            anchors.append(first | second << LENGTH)
    return np.concatenate(rows), np.concatenate(anchors)


def anchored(prints: DataFrame, budget: int) -> DataFrame:
    """(anchor, fp, rep) for every anchor a fingerprint is sent to; input (fp, rep)."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = covering_table(budget)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                row, anchor = anchors_of(part["fp"].to_numpy(np.int64), tables, budget)
                yield pd.DataFrame({"anchor": anchor, "fp": part["fp"].to_numpy()[row], "rep": part["rep"].to_numpy()[row]})

    return prints.mapInPandas(spread, "anchor long, fp long, rep long")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): ids of fingerprints at most `distance` bits apart, each pair once; input (fp, rep), fp distinct.

    Every fingerprint is sent to all anchors within covering radius plus distance and compared there with the
    fingerprints whose own anchor it is.  All 64 bits are compared, 46 of them choose the anchors.
    """
    home = anchored(prints, 0).select("anchor", F.col("fp").alias("hf"), F.col("rep").alias("a"))
    reach = anchored(prints, distance).withColumnRenamed("rep", "b")
    near = (F.col("hf") < F.col("fp")) & (F.bit_count(F.col("hf").bitwiseXOR(F.col("fp"))) <= distance)
    return reach.join(home, "anchor").filter(near).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: id, `fp` (long), `component_id`, the smallest id reachable over links, and what is carried.

    Equal fingerprints are linked and stand as one, so a group of copies costs nothing beyond its rows; it is
    pre-aggregated before any shuffle.  Null and empty texts have fingerprint 0 and are linked like any other.
    Rows with a null id get the component of their fingerprint; if all ids of a component are null, so is it.
    """
    extra = [c.alias(f"__c_{n}") for n, c in (carry or {}).items()]
    prints = staged(docs.select(F.col(id_col).cast("long").alias("__id"), simhash(F.col(text_col)).alias("fp"), *extra))
    distinct = staged(prints.groupBy("fp").agg(F.min("__id").alias("rep")))
    # The graph is one of fingerprints, so rows that share no more than an id are not linked.
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")), distance), "a", "b")
    label = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = label.filter(F.col("fp") != F.col("root")).select("root").distinct().join(label, "root")
    least = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "root", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    rows = join_group_table(prints, label, ["fp"], "__id")
    return rows.select(F.col("__id").alias(id_col), "fp", "component_id", *[F.col(f"__c_{n}").alias(n) for n in carry or {}])
