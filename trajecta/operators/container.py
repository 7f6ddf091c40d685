"""Row and column algebra of sample batches.

A batch is a DataFrame with a zero-based `row_idx`; `indexed` adds one in two levels.  Sizes needed by an
operator are scalar subqueries, evaluated inside the same job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import hash_bucket, seeded_hash, with_rank

IDX = "row_idx"


def indexed(df: DataFrame, key: str, width: int = 65536) -> DataFrame:
    """Number the rows by a unique integer key."""
    return with_rank(df, F.floor(F.col(key) / width), [F.col(key)], IDX)


def total(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1)).alias("n")).scalar()


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def select_keys(df: DataFrame, names: list[str]) -> DataFrame:
    require(df, names)
    return df.select(*names)


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.filter(mask)


def select_indices(df: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows named by (pos, row_idx) pairs; repeats stay, `row_idx` becomes the position."""
    return picks.join(df, IDX).drop(IDX).withColumnRenamed("pos", IDX)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    step = 1 if step is None else step
    if step < 1:
        raise ValueError("slices run forward")

    def bound(v: int | None, default: Column) -> Column:
        if v is None:
            return default
        return F.lit(v) if v >= 0 else F.greatest(total(df) + v, F.lit(0))

    low = bound(start, F.lit(0))
    keep = (F.col(IDX) >= low) & ((F.col(IDX) - low) % step == 0)
    if stop is not None:
        keep = keep & (F.col(IDX) < bound(stop, F.lit(0)))
    return df.filter(keep)


def pop(df: DataFrame, names: list[str], keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(popped columns, remaining columns); `keep` columns identify rows and stay on both sides."""
    require(df, names)
    keep = keep or [IDX]
    return df.select(*keep, *[n for n in names if n not in keep]), df.drop(*[n for n in names if n not in keep])


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    require(df, old)
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two aligned batches side by side; a shared column must agree in every row.

    The check is part of the projection, so it costs no extra pass.  With both sides bucketed by `keys`
    the join needs no shuffle.
    """
    shared = [c for c in b.columns if c in a.columns and c not in keys]
    right = b.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    joined = a.join(right, keys)
    for c in shared:
        kind = dict(a.dtypes)[c]
        clash = F.raise_error(F.lit(f"conflicting values for column {c}")).cast(kind)
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__r_{c}")), F.col(c)).otherwise(clash))
    return joined.drop(*[f"__r_{c}" for c in shared])


def concat(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def merged_meta(metas: DataFrame, merge_key: str = "metrics") -> DataFrame:
    """One value per meta key over (batch, key, value); only `merge_key` may differ between batches."""
    agg = metas.groupBy("key").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sort_array(F.collect_set("value")).alias("all")
    )
    clash = F.raise_error(F.concat(F.lit("conflicting meta value: "), F.col("key"))).cast("array<string>")
    values = F.when(F.col("key") == merge_key, F.col("all")).when(F.col("lo") != F.col("hi"), clash).otherwise(F.array("lo"))
    return agg.select("key", values.alias("values"))


def chunk(df: DataFrame, n: int, allow_uneven: bool = False) -> DataFrame:
    """Adds `chunk_id`; the size must divide evenly unless uneven chunks are allowed."""
    rows = total(df)
    even = F.col(IDX) * n / rows
    if not allow_uneven:
        even = F.when(rows % n == 0, even).otherwise(
            F.raise_error(F.lit(f"batch does not divide into {n} chunks")).cast("double")
        )
    return df.withColumn("chunk_id", F.floor(even))


def split(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("split_id", F.floor(F.col(IDX) / size))


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """`permutation` is (pos, row_idx): the row to put at each position."""
    return select_indices(df, permutation)


def repeat(df: DataFrame, n: int, interleave: bool = True) -> DataFrame:
    """Each row n times: aabb when interleaved, abab when tiled."""
    rows = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    new = F.col(IDX) * n + F.col("__r") if interleave else F.col("__r") * total(df) + F.col(IDX)
    return rows.withColumn(IDX, new).drop("__r")


def unfold_column_chunks(df: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """Split the given arrays into n equal pieces, one row each; other columns repeat."""
    require(df, columns)
    rows = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in columns:
        width = F.floor(F.size(c) / n).cast("int")
        rows = rows.withColumn(c, F.slice(F.col(c), F.col("__r") * width + 1, width))
    return rows.withColumn(IDX, F.col(IDX) * n + F.col("__r")).drop("__r")


def sample_level_repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as its own count says; a count of zero drops it."""
    rows = df.withColumn("__t", times).filter("__t > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("__t") - 1).cast("int")))).drop("__t")


def pad_to_divisor(df: DataFrame, divisor: int) -> DataFrame:
    """Pad the row count by cycling from the start; copies carry `is_pad`."""
    n = total(df)
    pad = (divisor - n % divisor) % divisor
    copies = F.when(F.col(IDX) < pad, F.floor((pad - 1 - F.col(IDX)) / n) + 1).otherwise(0)
    rows = df.withColumn("__c", F.explode(F.sequence(F.lit(0), copies.cast("int"))))
    return rows.withColumn("is_pad", F.col("__c") > 0).withColumn(IDX, F.col(IDX) + F.col("__c") * n).drop("__c")


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def padding(df: DataFrame, size: int, candidate: str = "first") -> DataFrame:
    """Append `size` copies of the first or the last row."""
    n = total(df)
    chosen = F.col(IDX) == (F.lit(0) if candidate == "first" else n - 1)
    rows = df.withColumn("__c", F.explode(F.sequence(F.lit(0), F.when(chosen, F.lit(size)).otherwise(F.lit(0)))))
    return rows.withColumn(IDX, F.when(F.col("__c") == 0, F.col(IDX)).otherwise(n + F.col("__c") - 1)).drop("__c")


def fold(df: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Rows in runs of `size` (a fixed repeat count) to one row of arrays."""
    items = F.sort_array(F.collect_list(F.struct(IDX, *columns)))
    out = df.groupBy(F.floor(F.col(IDX) / size).alias("fold_idx")).agg(items.alias("__items"))
    return out.select("fold_idx", *[F.col("__items").getField(c).alias(c) for c in columns])


def unfold(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df.select("fold_idx", F.posexplode(F.arrays_zip(*columns)).alias("pos", "t"))
    return out.select("fold_idx", "pos", *[F.col(f"t.{c}").alias(c) for c in columns])


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int = 0, key: str = IDX) -> DataFrame:
    """Per epoch a seeded order and `mini_batch_id`; the mini-batch size must divide the batch."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("__h", seeded_hash(seed, "epoch", key))
    rows = with_rank(rows, hash_bucket(F.col("__h")), [F.col("__h"), F.col(key)], "epoch_pos", ["epoch"])
    ok = F.when(total(df) % size == 0, F.floor(F.col("epoch_pos") / size)).otherwise(
        F.raise_error(F.lit("mini-batch size does not divide the batch")).cast("long")
    )
    return rows.withColumn("mini_batch_id", ok).drop("__h")


def rows_to_columns(column: str, fields: list[str]) -> list[Column]:
    """An array of structs to one array per field."""
    return [F.col(column).getField(f).alias(f) for f in fields]


def columns_to_rows(fields: list[str]) -> Column:
    return F.arrays_zip(*fields)


def row_uid(*cols: Column | str) -> Column:
    """Deterministic row identity: the same on every retry."""
    return F.sha2(F.concat_ws("\u0001", *cols), 256)


def coverage(parts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys missing from, foreign to, or repeated in a partition; empty when it covers exactly once."""
    seen = parts.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    both = seen.join(expected.select(key, F.lit(True).alias("__known")), key, "full_outer")
    return both.filter(F.col("times").isNull() | (F.col("times") != 1) | F.col("__known").isNull()).select(key, "times")
