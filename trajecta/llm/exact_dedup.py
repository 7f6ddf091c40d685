"""Exact duplicates by progressive refinement: length and prefix hash first, full content for survivors only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators.grouping import with_group_stats
from trajecta.session import staged

PREFIX_CHARS = 64


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: id, `keep_id`, `group_size`, `kept`, the carried expressions, and the text if asked for.

    Rows are grouped by byte length and, within a length, by the hash of their first characters; a group of
    one is settled there.  Only rows of larger groups are told apart by their whole text (SHA-256, taken where the text
    is read, so that no text is moved unless it is asked for).  Of equal
    texts the row with the largest id is kept.  A null text equals the empty one; nothing is normalised.
    A null id is smaller than any id.  Of repeated rows (same id and text) one is kept and all are counted.
    A hot group of copies is aggregated in 64 parts and joined back on (group, part).
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.octet_length(text).alias("__len"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("__prefix"),
        F.col(text_col).alias("__text") if with_text else F.unhex(F.sha2(text, 256)).alias("__full"),
        *[c.alias(f"__c_{n}") for n, c in carry.items()],
    )
    refined = rows.groupBy("__len", "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    alive = refined.filter(F.col("__n") > 1).select("__len", "__prefix")
    single = rows.drop("__full").join(alive, ["__len", "__prefix"], "left_anti")
    content = rows.join(alive, ["__len", "__prefix"], "left_semi")
    if with_text:
        content = content.withColumn("__full", F.unhex(F.sha2(F.coalesce("__text", F.lit("")), 256)))
    content = staged(content)
    merged = with_group_stats(
        content, ["__full"], ["__id"], sums={"__n": F.lit(1)}, maxs={"__keep": F.col("__id")}
    )
    order = Window.partitionBy("__full", "__id").orderBy(F.lit(1))
    merged = merged.withColumn("__kept", F.col("__id").eqNullSafe(F.col("__keep")))
    merged = merged.withColumn("__kept", F.col("__kept") & (F.row_number().over(order) == 1))

    def shaped(df: DataFrame, keep: Column, n: Column, kept: Column) -> DataFrame:
        return df.select(
            F.col("__id").alias(id_col),
            keep.alias("keep_id"),
            n.cast("long").alias("group_size"),
            kept.alias("kept"),
            *([F.col("__text").alias(text_col)] if with_text else []),
            *[F.col(f"__c_{name}").alias(name) for name in carry],
        )

    return shaped(single, F.col("__id"), F.lit(1), F.lit(True)).unionByName(
        shaped(merged, F.col("__keep"), F.col("__n"), F.col("__kept"))
    )
