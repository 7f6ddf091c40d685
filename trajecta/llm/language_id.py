"""Language identification: n-gram presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.session import staged

SIZES = (1, 2, 3)  # characters in an n-gram
BITS = 21  # of a code point
ROWS_PER_LANGUAGE, LEAST_ROWS, SAMPLE_ROWS = 600, 40, 6000  # bound of the training sample: of a language, and in all
LANDMARKS, LEAST_LANDMARKS = 192, 4  # in all, and of a language
RIDGE = 1e-3
BATCH, CELLS = 64, 4 << 20  # texts in one matrix product, and cells of its matrix
UNDETERMINED = "und"
GAP = 1


def is_letter(c: str) -> bool:
    """Letters, and the marks that some scripts write vowels with."""
    return c.isalpha() or unicodedata.category(c)[0] == "M"


class Letters:
    """Which code points are letters; those met are remembered."""

    def __init__(self):
        self.known: dict[int, bool] = {}

    def __call__(self, points: np.ndarray) -> np.ndarray:
        seen, at = np.unique(points, return_inverse=True)
        for p in seen.tolist():
            if p not in self.known:
                self.known[p] = is_letter(chr(p))
        return np.array([self.known[p] for p in seen.tolist()], bool)[at]


def gram_codes(text: str | None, letters: Letters) -> np.ndarray:
    """Sorted distinct 1- to 3-grams of code points of the whole text, in lower case; a run of non-letters is one gap.

    A gram is its code points side by side, so no two share a code.  A text without letters has none.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters(points) if len(points) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int64)
    ids = np.where(letter, points.astype(np.int64) + 1, GAP)
    keep = np.ones(len(ids), bool)
    keep[1:] = letter[1:] | letter[:-1]
    ids = ids[keep]
    codes, value = [], np.zeros(len(ids), np.int64)
    for size in SIZES:
        value = (value[: max(0, len(ids) - size + 1)] << BITS) | ids[size - 1 :]
        codes.append(value)
    return np.unique(np.concatenate(codes))


def known(grams: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary of those n-grams it holds."""
    at = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
    return at[vocabulary[at] == grams]


def landmark_map(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary, projection): presence vectors to Nyström features k(x, landmarks) K^(-1/2).

    The kernel of two texts is the number of n-grams they share over the root of the product of their numbers of n-grams.
    It is linear in the presence vector over the root of its count, so landmarks and root multiply out to one matrix.
    """
    vocabulary = np.unique(np.concatenate(sets))
    base = np.zeros((len(vocabulary), len(sets)))
    for j, grams in enumerate(sets):
        base[np.searchsorted(vocabulary, grams), j] = 1 / np.sqrt(len(grams))
    values, vectors = np.linalg.eigh(base.T @ base)
    good = values > values.max() * 1e-6
    return vocabulary, base @ (vectors[:, good] / np.sqrt(values[good]))


def features(grams: np.ndarray, vocabulary: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return projection[known(grams, vocabulary)].sum(0) / np.sqrt(len(grams))


def ridge(rows: np.ndarray, langs: np.ndarray, names: list[str]) -> np.ndarray:
    """One-versus-rest weights of features and, last, the intercept; every language weighs the same."""
    rows = np.column_stack((rows, np.ones(len(rows))))
    wanted = np.where(langs[:, None] == np.asarray(names)[None, :], 1.0, -1.0)
    place = np.searchsorted(names, langs)
    weighted = rows * (len(rows) / len(names) / np.bincount(place)[place])[:, None]
    penalty = RIDGE * len(rows) * np.diag(np.r_[np.ones(rows.shape[1] - 1), 0.0])
    return np.linalg.solve(weighted.T @ rows + penalty, weighted.T @ wanted)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """A bounded sample of every language: about ROWS_PER_LANGUAGE rows, fewer where there are many languages.

    With L languages it is SAMPLE_ROWS / L rows each, at least LEAST_ROWS.  A row is in the sample if the hash of its id
    falls below the share its language needs.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = staged(usable.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")))
    each = F.greatest(F.least(F.lit(SAMPLE_ROWS) / counts.select(F.count(F.lit(1))).scalar(), F.lit(ROWS_PER_LANGUAGE)), F.lit(LEAST_ROWS))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    rows = usable.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    # A written row a language: the optimiser knows its size and moves no text for a small one.
    rows = rows.join(counts.withColumn("__each", each), F.col("lang") == F.col("__lang"))
    return rows.filter(F.col("draw") * F.col("__n") < F.col("__each")).select("text", "lang", "draw")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Model from labelled rows, or None if there is none with a letter.

    Texts stay on the executors: the n-gram sets of the landmarks and the feature rows of the bounded sample come back.
    Null labels and texts are left out; repeated rows share a draw and are in the sample together or not at all.
    """
    sample = staged(training_rows(docs, id_col, text_col, lang_col))
    spark = docs.sparkSession

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for pdf in batches:
            sets = [gram_codes(t, letters) for t in pdf["text"]]
            made = pdf[["lang", "draw"]].assign(grams=sets)
            yield made[[len(s) > 0 for s in sets]]

    sets = staged(sample.mapInPandas(measured, "lang string, draw double, grams array<long>"))
    names = sorted(r[0] for r in sets.select("lang").distinct().collect())
    if not names:
        return None
    each = max(LEAST_LANDMARKS, LANDMARKS // len(names))
    order = Window.partitionBy("lang").orderBy("draw", "grams")  # the bounded sample
    chosen = sets.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each).orderBy("lang", "r").collect()
    vocabulary, projection = landmark_map([np.asarray(r["grams"], np.int64) for r in chosen])
    shared = spark.sparkContext.broadcast((vocabulary, projection))  # bounded by the landmarks

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [features(np.asarray(g, np.int64), *shared.value) for g in pdf["grams"]]
            yield pd.DataFrame({"lang": pdf["lang"], "draw": pdf["draw"], "f": rows})

    rows = sorted(sets.mapInPandas(mapped, "lang string, draw double, f array<double>").collect(), key=lambda r: (r["lang"], r["draw"], r["f"]))
    weights = ridge(np.array([r["f"] for r in rows]), np.array([r["lang"] for r in rows]), names)
    both = np.vstack([projection @ weights[:-1], weights[-1:]])
    return {"vocabulary": vocabulary, "weights": both.astype(np.float32), "names": names}


def classify(
    docs: DataFrame,
    model: dict | None,
    columns: list[str],
    text_col: str = "text",
    label: str = "lang_pred",
    value: str = "score",
    grams: str | None = None,
) -> DataFrame:
    """`columns` of every row with the predicted language and its score.

    Whole texts are scored, up to BATCH at a time: a 0/1 matrix of n-grams times the weights of the model, over the
    root of each text's n-gram count.  The score is half of one plus the best regression value, within 0 and 1; of
    equal values the first language by name wins.  A null text or one without a letter is `und` with score 0, as is every
    text if nothing could be learned.  Rows are scored one by one: null ids and repeated rows are rows like others.
    With `grams` a column of that name has the number of distinct n-grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    names_out = [*columns, label, value, *([grams] if grams else [])]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*columns).dtypes) + f", `{label}` string, `{value}` double"
    schema += f", `{grams}` int" if grams else ""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters, step = shared.value, Letters(), BATCH
        if model:
            vocabulary, weights, names = model["vocabulary"], model["weights"], np.asarray(model["names"], object)
            step = max(1, min(BATCH, CELLS // len(vocabulary)))
        for rows in batches:
            texts = rows.column(len(columns))
            chosen, fits = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            sizes = np.zeros(len(texts), np.int32)
            for at in range(0, len(texts) if model else 0, step):
                sets = [gram_codes(texts[i].as_py(), letters) for i in range(at, min(at + step, len(texts)))]
                here = np.array([at + i for i, s in enumerate(sets) if len(s)], np.int64)
                sizes[at : at + len(sets)] = [len(s) for s in sets]
                matrix = np.zeros((len(here), len(vocabulary)), np.float32)
                for row, i in enumerate(here):
                    matrix[row, known(sets[i - at], vocabulary)] = 1
                fitted = matrix @ weights[:-1] / np.sqrt(sizes[here])[:, None] + weights[-1]
                if len(here):
                    best = fitted.argmax(1)
                    chosen[here] = names[best]
                    fits[here] = np.clip((1 + fitted[np.arange(len(here)), best]) / 2, 0, 1)
            made = [*rows.columns[: len(columns)], pa.array(chosen, pa.string()), pa.array(fits)]
            yield pa.RecordBatch.from_arrays([*made, *([pa.array(sizes)] if grams else [])], names=names_out)

    rows = docs.select(*columns, F.col(text_col).alias("__text"))
    return rows.mapInArrow(score, schema)


def score_without_evidence(model: dict | None) -> float:
    """The score of a text that shares no n-gram with the landmarks."""
    return float(np.clip((1 + model["weights"][-1].max()) / 2, 0, 1)) if model else 0.0


def identify(docs: DataFrame, learn_from: DataFrame, columns: list[str]) -> DataFrame:
    """Fit on the labelled rows `learn_from` (doc_id, text, lang), then label every row of `docs`."""
    return classify(docs, fit(learn_from), columns)
