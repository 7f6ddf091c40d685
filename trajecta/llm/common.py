"""Small shared pieces: staging, let-bindings, points on a hash ring, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.session import discard, staged, staging_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def ring_starts(points: Column, anchors: list[int], is_anchor: Callable[[Column], Column]) -> Column:
    """Index in the sorted long array `points` of the first element at or after each anchor.

    Every anchor is the zero of its own rotation of one hash order, so the element found there is the
    minimum under that rotated order.  One sort of points and anchors together replaces a scan per order.
    An index equal to the number of points stands for the first point (the ring closes).
    """
    merged = F.sort_array(F.concat(points, F.array(*[F.lit(a).cast("long") for a in anchors])))
    where = F.filter(F.transform(merged, lambda x, i: F.when(is_anchor(x), i).otherwise(F.lit(-1))), lambda v: v >= 0)
    return F.transform(where, lambda v, j: v - j)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of an undirected graph given as links; the component is its smallest node.

    Distributed union-find by alternating large and small stars: each pass hangs all neighbours of a node
    on the smallest of them, so depth falls geometrically.  Every pass is written to the shared folder,
    which keeps lineage short and survives lost executors.  Only two numbers a pass reach the driver.
    Nodes without links, nulls and self-links give no row.
    """
    spark = edges.sparkSession
    oriented = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    oriented = oriented.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    path = staging_path(spark)
    current = staged(oriented, path)
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        next_path = staging_path(spark)
        current = staged(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), next_path)
        next_state = _state(current)
        discard(spark, path)
        if next_state == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, path = next_state, next_path
