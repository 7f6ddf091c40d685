"""Session settings and durable staging."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any size; partition counts stay with the cluster (AQE coalesces).
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "trajecta", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code() -> None:
    """Send the package's functions to Python workers by value, so they need no installed copy of it."""
    import trajecta

    cloudpickle.register_pickle_by_value(trajecta)


FOLDER = "spark.trajecta.checkpointDir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`, or `spark.trajecta.checkpointDir`."""
    conf = spark.sparkContext.getConf()
    for key in ("spark.checkpoint.dir", FOLDER):
        root = spark.conf.get(key, None) or conf.get(key, None)
        if root:
            return root
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


# Drops the shuffle files of a query when it ends; a written table never reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives executor loss.

    The shuffle files behind the write are dropped with it, as nothing else reads them.
    """
    spark = df.sparkSession
    path = path or staging_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def staging_path(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/staged-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
