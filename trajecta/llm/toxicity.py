"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
ROWS_PER_CLASS = 4000  # bound of the training sample
MAX_TERMS = 4096  # terms with weights, chosen on their own account; PAIR_TERMS more may come in as pairs
PAIR_TERMS, PAIR_ROWS = 2048, 8  # the commonest terms of the sample, in so many rows at least, are screened in pairs too
COPY, COPY_BANDS, COPY_ROWS = 0.5, 16, 5
CHANCE = 1.0  # expected number of terms modelled by chance alone, over all terms of the sample
FACTORS = 4
STEPS, RATE, PENALTY, SEED = 400, 0.1, 1e-5, 7
# Bytes that part terms: ASCII other than letters and digits.  Other scripts keep their bytes.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def hashed_terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the terms of the whole text; a null text has none."""
    terms = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split())
    return np.unique(np.fromiter((crc32(t) % BUCKETS for t in terms), np.int32, len(terms)))


def copy_shares(rows: list[np.ndarray]) -> np.ndarray:
    """One over the size of each row's group of copies, so that copies of one text count once together.

    Rows whose term sets have a Jaccard index of COPY or more are copies; MinHash bands find them.  The sample is
    bounded, so this is a small local step.
    """
    rng = np.random.default_rng(SEED)
    odd, shift = rng.integers(1, 1 << 63, (2, COPY_BANDS * COPY_ROWS), dtype=np.uint64) | np.uint64(1)
    slots = np.zeros((len(rows), COPY_BANDS * COPY_ROWS), np.uint64)
    for i, terms in enumerate(rows):
        if len(terms):
            mixed = (terms.astype(np.uint64)[:, None] + np.uint64(1)) * odd + shift
            mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
            slots[i] = (mixed ^ mixed >> np.uint64(29)).min(0)
    parent = np.arange(len(rows))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for band in np.split(slots, COPY_BANDS, axis=1):
        first: dict[bytes, int] = {}
        for i, key in enumerate(map(bytes, band)):
            j = first.setdefault(key, i)
            a, c = root(j), root(i)
            if a != c:
                common = len(np.intersect1d(rows[i], rows[j], assume_unique=True))
                if common >= COPY * (len(rows[i]) + len(rows[j]) - common):
                    parent[max(a, c)] = min(a, c)
    group = np.array([root(i) for i in range(len(rows))], np.int64)
    return 1 / np.bincount(group, minlength=max(1, len(rows)))[group]


def screened(rows: list[np.ndarray], toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Buckets that tell the classes apart.

    Rows count by their share in their group of copies.  A term stays if the likelihood ratio of its toxic share against the share of all rows would be that large by
    chance for fewer than CHANCE of all the terms seen (the tail of a chi-square, divided by their number).
    The strongest MAX_TERMS are kept.
    """
    if not len(rows):
        return np.zeros(0, np.int32)
    every = np.concatenate(rows)
    sizes = [len(r) for r in rows]
    seen, place = np.unique(every, return_inverse=True)
    n, hits = np.bincount(place, np.repeat(share, sizes)), np.bincount(place, np.repeat(share * toxic, sizes))
    base = np.average(toxic, weights=share)
    if not 0 < base < 1:
        return np.zeros(0, np.int32)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = hits * np.log(hits / (n * base)), (n - hits) * np.log(np.maximum(n - hits, 0) / (n * (1 - base)))
    ratio = 2 * sum(np.nan_to_num(t, nan=0.0) for t in terms)
    chosen = np.flatnonzero(ratio >= 2 * np.log(len(seen) / CHANCE))
    chosen = chosen[np.argsort(-ratio[chosen], kind="stable")][:MAX_TERMS]
    return np.sort(seen[chosen]).astype(np.int32)


def screened_pairs(rows: list[np.ndarray], toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Buckets of the terms whose pairs tell the classes apart, though each alone may not.

    For each pair of common terms the rows fall into four cells: both, one, the other, neither.  The likelihood ratio of
    the toxic share by cell, less those of the two terms, is what the pair adds; it stays by the same rule as a term.
    Counts of all pairs are matrix products over the bounded sample.
    """
    if not len(rows):
        return np.zeros(0, np.int32)
    seen, count = np.unique(np.concatenate(rows), return_counts=True)
    common = np.argsort(-count, kind="stable")[:PAIR_TERMS]
    buckets = np.sort(seen[common[count[common] >= PAIR_ROWS]])
    total, ill = share.sum(), (share * toxic).sum()
    if len(buckets) < 2 or not 0 < ill < total:
        return np.zeros(0, np.int32)
    x = np.zeros((len(rows), len(buckets)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.flatnonzero(np.isin(buckets, r, assume_unique=True))] = 1
    n11 = (x * share[:, None].astype(np.float32)).T @ x
    t11 = (x * (share * toxic)[:, None].astype(np.float32)).T @ x
    n1, t1 = n11.diagonal().astype(float), t11.diagonal().astype(float)

    def gain(n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """n * (relative entropy of the share in a cell against the share of all), twice; the parts add up to a ratio."""
        n, t, base = np.maximum(n, 0), np.clip(t, 0, np.maximum(n, 0)), ill / total
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = t * np.log(t / (n * base)), (n - t) * np.log((n - t) / (n * (1 - base)))
        return 2 * sum(np.nan_to_num(p, nan=0.0, posinf=0.0, neginf=0.0) for p in parts)

    single = gain(n1, t1) + gain(total - n1, ill - t1)
    found = np.zeros(len(buckets), bool)
    level = 2 * np.log(len(buckets) * (len(buckets) - 1) / 2 / CHANCE) + 2
    for i in range(len(buckets)):  # a row of the table of pairs at a time
        n, t = n11[i].astype(float), t11[i].astype(float)
        cells = gain(n, t) + gain(n1 - n, t1 - t) + gain(n1[i] - n, t1[i] - t)
        cells += gain(total - n1 - n1[i] + n, ill - t1 - t1[i] + t)
        added = cells - single - single[i]
        added[i] = 0
        hits = added >= level
        if hits.any():
            found[i] = True
            found |= hits
    return buckets[found].astype(np.int32)


def machine(x: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Scores of 0/1 rows: bias + sum of weights + sum over pairs of the products of their factors."""
    mixed = x @ factors
    return bias + x @ linear + 0.5 * (mixed**2 - x @ factors**2).sum(1)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss with an L2 penalty, full-batch AdaGrad.

    Linear weights start at the log odds a term has on its own, so that one of many terms that mostly occur
    together is not left without a weight; factors start at small seeded numbers.
    """
    rng = np.random.default_rng(SEED)
    scaled = weight / weight.mean()
    toxic, clean = (scaled * y) @ x + 0.5, (scaled * (1 - y)) @ x + 0.5
    bias = float(np.log(((scaled * y).sum() + 0.5) / ((scaled * (1 - y)).sum() + 0.5)))
    linear = np.log(toxic / clean) - bias
    # One kind of number throughout, so that no step copies the whole matrix.
    kind = x.dtype
    linear, factors = linear.astype(kind), rng.normal(0, 0.05, (x.shape[1], FACTORS)).astype(kind)
    sums = [kind.type(1e-8), np.full_like(linear, 1e-8), np.full_like(factors, 1e-8)]
    weight, y = (weight / weight.sum()).astype(kind), y.astype(kind)
    for _ in range(STEPS):
        mixed = x @ factors
        margin = bias + x @ linear + 0.5 * (mixed**2 - x @ factors**2).sum(1)
        slope = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        back = x.T @ slope
        steps = [
            slope.sum(),
            back + PENALTY * linear,
            x.T @ (slope[:, None] * mixed) - factors * back[:, None] + PENALTY * factors,
        ]
        sums = [s + g * g for s, g in zip(sums, steps)]
        bias -= RATE * steps[0] / np.sqrt(sums[0])
        linear -= (RATE * steps[1] / np.sqrt(sums[1])).astype(kind)
        factors -= (RATE * steps[2] / np.sqrt(sums[2])).astype(kind)
    return float(bias), linear.astype(float), factors.astype(float)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight): about ROWS_PER_CLASS labelled documents of each class, chosen by the hash of their id.

    A document with several labels is toxic if one of them says so.  `weight` undoes the sampling.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    counts = marked.groupBy(F.col("toxic").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    some = marked.join(F.broadcast(counts), F.col("toxic") == F.col("c"))  # two rows
    some = some.filter(draw * F.col("n") < ROWS_PER_CLASS)
    weight = F.greatest(F.lit(1.0), F.col("n") / ROWS_PER_CLASS)
    some = some.select(F.col("doc_id").alias("__id"), "toxic", weight.alias("weight"))
    # About 2 * ROWS_PER_CLASS narrow rows.
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("__id", "text", "toxic", "weight")


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Model learned from the bounded sample, or None without labelled documents.

    Only the hashed terms of the sample come to the driver, never texts.  Null ids and texts: a label without an id is
    left out, a null text has no terms.  Rows that share an id and a label all count, as one group of copies if alike.
    Terms that tell the classes apart, alone or in pairs, enter the machine.
    """

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(terms=[hashed_terms(t) for t in pdf["text"]])

    rows = training_rows(docs, labels).mapInPandas(terms_of, "__id long, toxic int, weight double, terms array<int>")
    rows = sorted(rows.collect(), key=lambda r: (r["__id"], r["terms"]))
    if not rows:
        return None
    toxic = np.array([r["toxic"] for r in rows], float)
    sets = [np.asarray(r["terms"], np.int32) for r in rows]
    share = copy_shares(sets)
    buckets = np.union1d(screened(sets, toxic, share), screened_pairs(sets, toxic, share)).astype(np.int32)
    x = np.zeros((len(rows), len(buckets)), np.float32)
    for i, s in enumerate(sets):
        x[i, np.flatnonzero(np.isin(buckets, s, assume_unique=True))] = 1
    bias, linear, factors = train(x, toxic, share * np.array([r["weight"] for r in rows]))
    return {"buckets": buckets, "bias": bias, "linear": linear, "factors": factors}


def score(docs: DataFrame, model: dict | None, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns` of every row with `score`, the probability of the toxic class; whole texts are read.

    A null or empty text has the score of the bias alone; without a model every score is 0.  Repeated rows are scored
    each, alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS + PAIR_TERMS terms
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*columns).dtypes) + ", score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = np.full(BUCKETS, -1, np.int32)
        if model:
            place[model["buckets"]] = np.arange(len(model["buckets"]))
        for rows in batches:
            values = np.zeros(rows.num_rows)
            for i, text in enumerate(rows.column(len(columns)).to_pylist() if model else []):
                at = place[hashed_terms(text)]
                at = at[at >= 0]
                mixed = model["factors"][at]
                margin = model["bias"] + model["linear"][at].sum() + 0.5 * (mixed.sum(0) ** 2 - (mixed**2).sum(0)).sum()
                values[i] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], pa.array(values)], names=[*columns, "score"])

    return docs.select(*columns, F.col(text_col).alias("__text")).mapInArrow(scored, schema)
