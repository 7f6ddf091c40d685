"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order and hashed as tuples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 5  # code points in a k-mer
TUPLE = 2  # k-mers in a tuple
SLOTS = 64  # tuples in a fingerprint
COARSE, FINE_MAX = 64, 8192  # ranges of ids, and slices in each
SLICE_ROWS, SLICE_BYTES, TASK_BYTES = 20_000, 16 << 20, 64 << 20
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)  # odd multipliers


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits (xor-shift and multiply, wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """Rolling polynomial hash of every run of k code points, of the whole text if it has no more."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = min(k, len(codes))
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for j in range(size):
        out = out * BASE + codes[j : j + len(out)]
    return mixed(out)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """One key a k-mer, of its hash and its occurrence number in the text."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    at = np.arange(len(ranked))
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    keys = np.empty_like(hashes)
    keys[order] = mixed(ranked + occurrence.astype(np.uint64) * STEP)
    return keys


def text_signature(text: str, k: int = K, tuple_size: int = TUPLE, slots: int = SLOTS) -> np.ndarray:
    """The 16-bit tuple hashes of one text; see `order_minhash`."""
    keys = numbered(kmer_hashes(text, k))
    order = np.argsort(keys, kind="stable")
    anchors = np.array([(b << 64) // slots for b in range(slots)], np.uint64)
    starts = np.searchsorted(keys[order], anchors)
    picked = np.sort(order[(starts[:, None] + np.arange(tuple_size)) % len(order)], axis=1)
    out = np.zeros(slots, np.uint64)
    for j in range(tuple_size):
        out = mixed(out * BASE + keys[picked[:, j]])
    return (out & np.uint64(0xFFFF)).astype(np.int32)


def order_minhash(text: Column, k: int = K, tuple_size: int = TUPLE, slots: int = SLOTS) -> Column:
    """array<int> of `slots` 16-bit tuple hashes of the whole text.

    Every run of k code points is a k-mer; a text of up to k code points, also an empty one, is one.  Equal k-mers are
    numbered by occurrence, so repeats count.  For each slot the `tuple_size` numbered k-mers that are smallest under the
    order of that slot are taken, put back into text order and hashed together.  The order of a slot is one shared hash,
    rotated to the slot's own zero; of equal hashes the one earlier in the text is smaller.  A null text gives null.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def signatures(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else text_signature(t, k, tuple_size, slots) for t in texts], dtype=object)

    return signatures(text)


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits a slot."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return same.cast("double") / F.size(a)


def id_slices(rows: DataFrame, id_col: str, size: Column, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, int]:
    """(rows with `__slice`, their bytes): a number that never falls as the id rises; `size` is the bytes of a row.

    A slice has about `slice_rows` rows or SLICE_BYTES, whichever is less.  Two levels of approximate quantiles: 64 ranges
    that are constants of the plan, and inside each as many as rows and bytes ask for (2 to 8,192, so slices grow
    beyond 8 TB), kept in a table of 64 rows and at most 4 MB.  Null ids are in the lowest slice.
    """
    levels = [i / COARSE for i in range(1, COARSE)]
    n, total, cuts = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.percentile_approx(id_col, levels, 10_000)
    ).first()
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    fine = min(FINE_MAX, max(2, -(-n // (COARSE * slice_rows)), -(-total // (COARSE * SLICE_BYTES))))

    def below(array: Column) -> Column:
        return F.coalesce(F.size(F.filter(array, lambda c: c <= F.col(id_col))), F.lit(0))

    coarse = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(below(bounds))
    rows = rows.withColumn("__coarse", coarse)
    inner = rows.groupBy(F.col("__coarse").alias("__c")).agg(
        F.percentile_approx(id_col, [i / fine for i in range(1, fine)], max(1000, 4 * fine)).alias("__cuts")
    )
    rows = rows.join(F.broadcast(inner), F.col("__coarse") == F.col("__c"), "left")  # at most 64 rows
    inside = F.when(F.col(id_col).isNull() | F.col("__cuts").isNull(), F.lit(0)).otherwise(below(F.array_distinct("__cuts")))
    return rows.withColumn("__slice", F.col("__coarse") * (FINE_MAX + 1) + inside).drop("__coarse", "__c", "__cuts"), total


def with_next(rows: DataFrame, id_col: str, values: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds `next_<value>`: the values of the row with the next larger id, the first row's after the last.

    The first row of each id slice is also sent to the filled slice before it (cyclically), so one window per
    slice finds every successor and each row is shuffled once.  The number of tasks follows the bytes of the first
    value, a text, so a task sees about TASK_BYTES however large the input.  Rows that share an id follow each
    other in the order of their first value; null ids come first.
    """
    rows, total = id_slices(rows, id_col, F.coalesce(F.octet_length(F.col(values[0])), F.lit(0)) + 512, slice_rows)
    filled = rows.groupBy("__slice").agg(
        F.min(id_col).alias("__low"), F.max(F.col(id_col).isNull()).alias("__null")
    )
    by_slice = Window.orderBy("__slice")  # one row a slice
    filled = filled.select(
        F.col("__slice").alias("__s"),
        F.when(~F.col("__null"), F.col("__low")).alias("__first"),
        F.coalesce(F.lag("__slice").over(by_slice), F.max("__slice").over(Window.partitionBy())).alias("__before"),
    )
    rows = rows.join(F.broadcast(filled), F.col("__slice") == F.col("__s"), "left")  # at most 64 * 8193 rows of 40 bytes
    own = F.struct(F.col("__slice").alias("to"), F.lit(0).alias("copy"))
    ahead = F.struct(F.col("__before").alias("to"), F.lit(1).alias("copy"))
    leads = F.col(id_col).eqNullSafe(F.col("__first"))
    rows = rows.withColumn("__go", F.explode(F.when(leads, F.array(own, ahead)).otherwise(F.array(own))))
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(usual, -(-total // (TASK_BYTES // 16))), -(-total // TASK_BYTES))
    rows = rows.withColumn("__to", F.col("__go.to")).repartition(tasks, "__to")
    window = Window.partitionBy("__to").orderBy("__go.copy", F.col(id_col).asc_nulls_first(), values[0])
    out = rows.select("*", *[F.lead(v).over(window).alias(f"next_{v}") for v in values])
    return out.filter(F.col("__go.copy") == 0).drop("__slice", "__s", "__first", "__before", "__go", "__to")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edit: id, n_chars, `edited`, `signature`, `edited_signature`, `next_signature`.

    The edit replaces the last floor(n/2) code points by the first as many (or all) of the next document.
    A null text is empty.  A single document is its own successor.  Rows that share an id are rows of their own.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("signature", order_minhash(F.col("text")))
    rows = with_next(rows, id_col, ["text", "signature"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), edited.alias("edited"), "signature", "next_signature")
    return rows.withColumn("edited_signature", order_minhash(F.col("edited")))
