"""Corpus preparation in five stages; each reads what its predecessor kept and writes Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import exact_dedup, language_id, mixing, sentencepiece_bpe, simhash
from trajecta.llm.common import id_remainder, table
from trajecta.session import checkpoint_root


EVIDENCE = 500  # distinct n-grams from which a text can be told to be in no learned language
MARGIN = 0.04  # of the score above that of a text that shares no n-gram with any language


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language, and those without a letter (null and empty texts too).

    A text of at least EVIDENCE distinct n-grams goes if its best score is within MARGIN of what a text without any
    known n-gram gets.  Shorter texts with a letter stay: clean ones of a few words have low scores.  Rows are judged one by
    one, so repeated rows and null ids are rows like others; if nothing can be learned, no text has a language.
    Columns named like those added are kept apart by the leading underscores.
    """
    names = docs.columns
    model = language_id.fit(docs.filter(id_remainder("doc_id", 4) != 2))
    labelled = language_id.classify(docs, model, names, label="__lang_pred", value="__score", grams="__grams")
    floor = language_id.score_without_evidence(model) + MARGIN
    foreign = (F.col("__grams") >= EVIDENCE) & (F.col("__score") < floor)
    return labelled.filter((F.col("__lang_pred") != language_id.UNDETERMINED) & ~foreign).select(*names)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts."""
    carry = {c: F.col(c) for c in docs.columns if c not in ("doc_id", "text")}
    found = exact_dedup.exact_dedup(docs, carry={f"__{c}": e for c, e in carry.items()}, with_text=True)
    return found.filter("kept").select("doc_id", "text", *[F.col(f"__{c}").alias(c) for c in carry]).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates; null ids stay.

    A row is known by its id and text, so of two texts under one id only the near copy goes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = {"__hash": F.xxhash64(text), "__size": F.octet_length(text)}
    away = simhash.near_duplicates(docs, carry=key).filter("doc_id <> component_id")
    away = away.select(F.col("doc_id").alias("__away"), *key).distinct()
    rows = docs.withColumns({f"{n}_": c for n, c in key.items()})
    same = (F.col("doc_id") == F.col("__away")) & (F.col("__hash") == F.col("__hash_")) & (F.col("__size") == F.col("__size_"))
    return rows.join(away, same, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until the sources have their target weights; a null source is one of its own.

    A null text has no words and is taken as the draw of its id says; rows with one id share a draw.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; a null text is empty, rows with one id share their draws, further columns are left out."""
    return sentencepiece_bpe.encode_texts(docs)


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("source_mixing", mixed),
    ("sentencepiece", encoded),
]
# Language identification, fingerprints and encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
