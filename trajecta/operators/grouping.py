"""Group statistics that keep working when one group holds a large share of all rows.

Every statistic is pre-aggregated per (group, bucket) with map-side combining, merged by a window whose
partitions hold at most `buckets` rows, and joined back on (group, bucket).  A hot group is therefore
spread over `buckets` tasks at every stage and no task ever sees it whole.  When the merged table is
small, the optimiser's own size check turns the join into a broadcast and the rows are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
_BUCKET = "__bucket"


def _bucketed(df: DataFrame, row_id: list[str], buckets: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*row_id), F.lit(buckets)))


def with_group_stats(
    df: DataFrame,
    keys: list[str],
    row_id: str | list[str],
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    moments: dict[str, Column] | None = None,
    buckets: int = BUCKETS,
    elements: Column | None = None,
    tops: dict[str, Column] | None = None,
    table: DataFrame | None = None,
) -> DataFrame:
    """Attach group aggregates to every row.

    `tops` adds `<name>`, the largest value of the group, and `<name>_next`, its largest smaller value.  `table` has one
    row per group; its columns come along in the same join.  `moments` adds `<name>_n`, `<name>_mean` and `<name>_m2` (sum of squared deviations, merged without
    subtracting large squares).  With `elements` (an array column) the aggregates range over the array
    elements, named `element`, instead of over the rows; a group without elements gets NULLs.
    """
    row_id = [row_id] if isinstance(row_id, str) else row_id
    sums, maxs, mins, moments, tops = sums or {}, maxs or {}, mins or {}, moments or {}, tops or {}
    rows = _bucketed(df, row_id, buckets)
    aggs = [F.sum(c).alias(n) for n, c in sums.items()]
    aggs += [F.max(c).alias(n) for n, c in maxs.items()]
    aggs += [F.min(c).alias(n) for n, c in mins.items()]
    for name, col in moments.items():
        aggs += [
            F.count(col).alias(f"__{name}_n"),
            F.avg(col).alias(f"__{name}_mean"),
            (F.var_pop(col) * F.count(col)).alias(f"__{name}_m2"),
        ]
    measured = rows if elements is None else rows.select(*keys, _BUCKET, F.explode(elements).alias("element"))
    for n, c in tops.items():
        measured = measured.withColumn(f"__{n}", c)
        falling = Window.partitionBy(*keys, _BUCKET).orderBy(F.col(f"__{n}").desc())
        measured = measured.withColumn(f"__{n}_place", F.dense_rank().over(falling))
        aggs += [F.max(f"__{n}").alias(f"__{n}"), F.max(F.when(F.col(f"__{n}_place") == 2, F.col(f"__{n}"))).alias(f"__{n}_2")]
    partial = measured.groupBy(*keys, _BUCKET).agg(*aggs)
    if elements is not None:
        present = rows.select(*keys, _BUCKET).distinct()
        partial = present.join(partial, [*keys, _BUCKET], "left")
    group = Window.partitionBy(*keys)
    merged = partial.select(
        *keys,
        _BUCKET,
        *[F.sum(n).over(group).alias(n) for n in sums],
        *[F.max(n).over(group).alias(n) for n in maxs],
        *[F.min(n).over(group).alias(n) for n in mins],
        *[c for n in tops for c in (f"__{n}", f"__{n}_2")],
        *[F.max(f"__{n}").over(group).alias(n) for n in tops],
        *[c for n in moments for c in (f"__{n}_n", f"__{n}_mean", f"__{n}_m2")],
        *[F.sum(f"__{n}_n").over(group).alias(f"{n}_n") for n in moments],
        *[
            (F.sum(F.col(f"__{n}_n") * F.col(f"__{n}_mean")).over(group) / F.sum(f"__{n}_n").over(group)).alias(
                f"{n}_mean"
            )
            for n in moments
        ],
    )
    for n in moments:
        shift = F.col(f"__{n}_mean") - F.col(f"{n}_mean")
        merged = merged.withColumn(
            f"{n}_m2", F.sum(F.col(f"__{n}_m2") + F.col(f"__{n}_n") * shift * shift).over(group)
        )
    for n in tops:
        smaller = F.when(F.col(f"__{n}") < F.col(n), F.col(f"__{n}")).otherwise(F.col(f"__{n}_2"))
        merged = merged.withColumn(f"{n}_next", F.max(smaller).over(group))
    merged = merged.drop(*[f"__{n}_{s}" for n in moments for s in ("n", "mean", "m2")], *[c for n in tops for c in (f"__{n}", f"__{n}_2")])
    if table is not None:
        merged = merged.join(table, keys, "left")
    renamed = merged.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(_BUCKET).alias("__k_bucket"),
        *[c for c in merged.columns if c not in keys and c != _BUCKET],
    )
    match = F.col(_BUCKET) == F.col("__k_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    # A left join: only the small side may be broadcast, whatever the optimiser guesses about the rows.
    return rows.join(renamed, match, "left").drop(_BUCKET, "__k_bucket", *[f"__k_{k}" for k in keys])


def join_group_table(df: DataFrame, table: DataFrame, keys: list[str], row_id: str | list[str], buckets: int = BUCKETS):
    """Left-join one row per group onto the rows of the group, spreading hot groups over `buckets` tasks.

    The group table is first copied to the buckets that occur (at most `buckets` copies of a group), so
    the wide join key is (group, bucket).
    """
    row_id = [row_id] if isinstance(row_id, str) else row_id
    rows = _bucketed(df, row_id, buckets)
    copies = rows.select(*keys, _BUCKET).distinct().join(table, keys)
    return rows.join(copies, [*keys, _BUCKET], "left").drop(_BUCKET)


def sample_std(name: str) -> Column:
    """Sample standard deviation from the moments of `with_group_stats`; NULL for a single row."""
    return F.when(F.col(f"{name}_n") > 1, F.sqrt(F.col(f"{name}_m2") / (F.col(f"{name}_n") - 1)))


def with_prefix_sum(
    df: DataFrame,
    bucket: Column,
    order: list[Column],
    weight: Column,
    name: str,
    keys: list[str] | None = None,
    total: str | None = None,
) -> DataFrame:
    """Sum of `weight` over the rows that come earlier under `order`, without one task per group.

    `total` names a column for the sum over the whole group, which costs nothing more.  `bucket` must be a non-decreasing function of `order` (a coarse quotient of the leading sort key).
    Rows are summed inside their bucket and shifted by the totals of the earlier buckets, which a window
    over one small row per bucket supplies.
    """
    keys = keys or []
    rows = df.withColumn("__rank_bucket", bucket).withColumn("__weight", weight)
    totals = rows.groupBy(*keys, "__rank_bucket").agg(F.sum("__weight").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__rank_bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__prefix_before"),
        *([F.sum("__n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "__rank_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    match = F.col("__rank_bucket").eqNullSafe(F.col("__b"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return (
        summed.join(offsets, match, "left")
        .withColumn(name, F.col("__prefix_before") + F.col("__inside"))
        .drop("__rank_bucket", "__weight", "__b", "__prefix_before", "__inside", *[f"__k_{k}" for k in keys])
    )


def with_rank(
    df: DataFrame, bucket: Column, order: list[Column], name: str = "row_idx", keys: list[str] | None = None
) -> DataFrame:
    """Zero-based position of every row under the total order `order`, exact and computed in two levels."""
    return with_prefix_sum(df, bucket, order, F.lit(1).cast("long"), name, keys)


OCTAVE, FLOOR = 64, 1 << 20  # buckets between a number and its double; above all that a double's exponent gives


def scale_bucket(value: Column, octave: int = OCTAVE) -> Column:
    """Order-preserving bucket of a number by sign and logarithm; needs no look at the data, whatever its scale."""
    size = F.floor(F.log2(F.abs(value)) * octave).cast("long") + FLOOR
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def kth_largest(df: DataFrame, keys: list[str], value: str, limits: DataFrame, parts: int = 65536) -> DataFrame:
    """(keys, `kth`, `take`): the k-th largest value of each group, and how many equal to it are among the first k.

    `limits` has the keys and `k`, at least 1; a group of fewer values gives no row.  Selection by histogram: counts by
    logarithmic bucket, combined before they are moved, tell which bucket holds the k-th; inside it counts by equal
    parts tell which part; only the distinct values of that part are put in order.  Nulls are left out.
    """
    rows = df.select(*keys, F.col(value).alias("__v")).filter(F.col("__v").isNotNull())

    def holding(counts: DataFrame, by: str, asked: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = counts.withColumn("__upto", F.sum("__n").over(upto)).join(asked, keys)
        found = found.filter((F.col("__upto") >= F.col("k")) & (F.col("__upto") - F.col("__n") < F.col("k")))
        return found.select(*keys, by, (F.col("k") - F.col("__upto") + F.col("__n")).alias("k"))

    rows = rows.withColumn("__b", scale_bucket(F.col("__v")))
    ends = F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi")).alias("__e")
    first = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"), ends)
    at = holding(first, "__b", limits)
    inside = rows.join(at.join(first.select(*keys, "__b", "__e"), [*keys, "__b"]).drop("k"), [*keys, "__b"])
    span = F.greatest(F.col("__e.hi") - F.col("__e.lo"), F.lit(5e-324))
    inside = inside.withColumn("__p", F.least(F.floor((F.col("__v") - F.col("__e.lo")) / span * parts), F.lit(parts - 1)).cast("long"))
    second = inside.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    part = holding(second, "__p", at.drop("__b"))
    values = inside.join(part.drop("k"), [*keys, "__p"]).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    return holding(values, "__v", part.drop("__p")).select(*keys, F.col("__v").alias("kth"), F.col("k").alias("take"))


ACCURACY = 10_000  # an approximate quantile is off by at most 1/ACCURACY of the rows
SORTED_WHOLE = 100_000  # distinct values of a group that one window may order


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], lower: bool = False
) -> DataFrame:
    """Linearly interpolated (or lower) percentiles per group.

    Approximate quantiles bracket each fraction by a few times their own error; values outside a bracket are
    only counted, those inside are ordered exactly.  What is ordered is a fixed share of the group whatever
    the scale or the ties of its values, equal values being one row with a count.  A group too small for the
    brackets to save work is ordered whole, which gives the same numbers.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    margin = 4 / ACCURACY
    ends = [min(1.0, max(0.0, f + side * margin)) for f in fractions.values() for side in (-1, 1)]
    spans = df.groupBy(*keys).agg(
        F.count(value).alias("__n"),
        F.min(value).alias("__min"),
        F.max(value).alias("__max"),
        F.percentile_approx(value, ends, ACCURACY).alias("__q"),
    )
    whole = F.col("__n") <= SORTED_WHOLE
    asked = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                ((F.col("__n") - 1) * F.lit(fraction)).alias("at"),
                F.when(whole, F.col("__min")).otherwise(F.col("__q")[2 * i]).alias("lo"),
                F.when(whole, F.col("__max")).otherwise(F.col("__q")[2 * i + 1]).alias("hi"),
            )
            for i, fraction in enumerate(fractions.values())
        ]
    )
    spans = spans.select(*keys, asked.alias("__asked"))
    rows = join_group_table(counts, spans, keys, value).withColumn("__f", F.explode("__asked")).drop("__asked")
    group = [*keys, F.col("__f.i").alias("__i")]
    below = rows.filter(F.col(value) < F.col("__f.lo")).groupBy(*group).agg(F.sum("__c").alias("__below"))
    inside = rows.filter((F.col(value) >= F.col("__f.lo")) & (F.col(value) <= F.col("__f.hi")))
    upto = Window.partitionBy(*keys, "__f.i").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.select(*group, value, "__c", F.col("__f.at").alias("__at"), F.sum("__c").over(upto).alias("__upto"))
    ranked = ranked.join(below, [*keys, "__i"], "left").withColumn("__end", F.col("__upto") + F.coalesce("__below", F.lit(0)))

    def at(index: Column) -> Column:
        return F.max(F.when((index < F.col("__end")) & (index >= F.col("__end") - F.col("__c")), F.col(value)))

    share = F.lit(0.0) if lower else F.max(F.col("__at") - F.floor("__at"))
    found = ranked.groupBy(*keys, "__i").agg(at(F.floor("__at")).alias("__lo"), at(F.ceil("__at")).alias("__hi"), share.alias("__w"))
    point = F.when(F.col("__w") == 0, F.col("__lo")).otherwise(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__w"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, point)).alias(n) for i, n in enumerate(fractions)])


def with_quantile_bucket(
    df: DataFrame, keys: list[str], column: str, name: str, row_id: str | list[str], parts: int = 256
) -> DataFrame:
    """Adds an order-preserving bucket: how many of the group's approximate quantiles do not exceed `column`.

    The boundaries follow the values of each group, whatever their scale; only a single repeated value can
    fill a bucket.
    """
    levels = [i / parts for i in range(1, parts)]
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(column, levels, ACCURACY)).alias("__cuts"))
    rows = join_group_table(df, cuts, keys, row_id)
    return rows.withColumn(name, F.size(F.filter("__cuts", lambda c: c <= F.col(column)))).drop("__cuts")


# --- one group after the other -----------------------------------------------------------------------------------

PACKED = 10_000  # rows of small results that leave a task together


def changes(column: pa.Array) -> pa.Array:
    """Whether each value after the first differs from the one before it; null is a value of its own."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    return pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before)))


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The groups of rows that arrive ordered by `keys`, each as the pieces of the batches that hold it.

    No piece of a group is kept here, so that a caller who empties the list lets go of them.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = held[-1].num_rows - 1
            if any(held[-1].column(k)[last].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield held
                held = []
        changed = changes(batch.column(keys[0]))
        for k in keys[1:]:
            changed = pc.or_(changed, changes(batch.column(k)))
        start = 0
        for at in pc.indices_nonzero(changed).to_pylist():
            held.append(batch.slice(start, at + 1 - start))
            yield held
            held, start = [], at + 1
        held.append(batch.slice(start))
    if held:
        yield held


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_groups(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    run: Callable[[list[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """`run` on the rows of each group in `order`, given as Arrow pieces; for rules that are sequential in a group.

    Spark sorts the rows, spilling what memory does not hold; a task then walks through its groups, holding one at a
    time, so that millions of small groups cost no call of their own and a large one is never copied into a frame.
    The keys must be of a discrete type.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(piece for group in _groups(batches, keys) for piece in run(group))

    return rows.mapInArrow(task, schema)


def seeded_hash(seed: int, *cols: Column | str) -> Column:
    """Order key for reproducible random choices at any partitioning."""
    return F.xxhash64(*cols, F.lit(seed))


def hash_bucket(hashed: Column) -> Column:
    """65,536 order-preserving buckets of a 64-bit hash; 10^12 rows leave about 1.5 * 10^7 to a bucket."""
    return F.shiftright(hashed, 48)


def long_bucket(key: Column, width: int = 65536) -> Column:
    """Order-preserving buckets of an integer key."""
    return F.floor(key / F.lit(width))


def unit_hash(seed: int, *cols: Column | str) -> Column:
    """Uniform number in [0, 1) from a seeded hash."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def seeded_digest(seed: int, col: Column | str) -> Column:
    """Order key for reproducible random choices that other engines can state: md5 of "seed:text"."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(text, F.lit(""))).cast("binary"))


def unit_digest(seed: int, col: Column | str) -> Column:
    """Uniform number in [0, 1) from the first ten digits of the seeded digest."""
    return F.conv(F.substring(seeded_digest(seed, col), 1, 10), 16, 10).cast("long") / F.lit(float(1 << 40))
