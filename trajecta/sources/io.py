"""Readers, writers and resumable stores."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grouping import seeded_digest


def read_datasets(spark: SparkSession, files: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet and JSON files as one table; other extensions are an error."""
    parts = []
    for kind, endings in (("parquet", (".parquet",)), ("json", (".json", ".jsonl"))):
        chosen = [f for f in files if f.endswith(endings)]
        if chosen:
            reader = spark.read.schema(schema) if schema else spark.read
            parts.append(getattr(reader, kind)(*([chosen] if kind == "json" else chosen)))
    odd = [f for f in files if not f.endswith((".parquet", ".json", ".jsonl"))]
    if odd:
        raise ValueError(f"unsupported files: {odd}")
    if not parts:
        raise ValueError("no input files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cap_rows(df: DataFrame, n: int, key: str, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """The first n rows by key, or n rows chosen by seeded hash; n < 0 keeps all."""
    if n < 0:
        return df
    return df.orderBy(*([seeded_digest(seed, key)] if shuffle else []), key).limit(n)


def sft_rows(df: DataFrame, prompt_path: str, response_path: str) -> DataFrame:
    return df.select(F.col(prompt_path).alias("prompt"), F.col(response_path).alias("response"))


def preference_rows(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def dump_rollouts(df: DataFrame, path: str, extras: dict[str, DataFrame] | None = None, mode: str = "append") -> None:
    """JSON lines partitioned by step.  An extra (step, sample_id, value) is written for the steps where it
    has as many rows as the samples."""
    sizes = df.groupBy("step").agg(F.count(F.lit(1)).alias("__n"))
    for name, extra in (extras or {}).items():
        full = (
            extra.groupBy("step").agg(F.count(F.lit(1)).alias("__e")).join(sizes, "step").filter("__e = __n").select("step")
        )
        kept = extra.join(full, "step", "left_semi").withColumnRenamed("value", name)
        df = df.join(kept, ["step", "sample_id"], "left")
    df.write.mode(mode).partitionBy("step").json(path)


def load_rollouts(spark: SparkSession, path: str, schema: T.StructType, mask: str | None = None) -> DataFrame:
    """Dumped rollouts in numeric step order with a text mask on string columns; unread steps are pruned.

    `sample_index` numbers the rows of a step in the order they were dumped (by file, then place in the file).  A
    row's place in its piece of a file follows from its number among the rows read with it; where a piece starts in its
    step follows from one count a piece.  No row is moved, and no window sees more than those counts.
    """
    piece = ["step", "__file", "__from"]
    rows = spark.read.schema(schema).json(path).select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__from"),
        F.monotonically_increasing_id().alias("__id"),
    )
    sizes = rows.groupBy(*piece).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("step").orderBy("__file", "__from").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*piece, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    df = rows.join(starts, piece).withColumn("sample_index", (F.col("__id") + F.col("__shift")).cast("int"))
    df = df.drop("__file", "__from", "__id", "__shift")
    return (mask_text(df, mask) if mask else df).orderBy("step", "sample_index")


def mask_text(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(
        *[F.regexp_replace(c, pattern, "*").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    )


def search_rollouts(df: DataFrame, keyword: str | None = None, request_id: str | None = None) -> DataFrame:
    if keyword is not None:
        texts = [c for c, t in df.dtypes if t == "string"]
        df = df.filter(reduce(lambda a, b: a | b, [F.col(c).contains(keyword) for c in texts]))
    if request_id is not None:
        df = df.filter(F.col("request_id") == request_id)
    return df


def order_rollouts(df: DataFrame, descending: bool = True) -> DataFrame:
    have = [F.col(c) for c in ("score", "score_1") if c in df.columns]
    key = F.coalesce(*have)
    return df.orderBy("step", key.desc() if descending else key.asc(), "sample_id")


def load_eval_statistics(spark: SparkSession, root: str, fields: list[str], max_checkpoint: int | None = None) -> DataFrame:
    """One row per (model, step) from `<root>/<model>/checkpoint<step>/*.json` result files.

    Folders written by a partitioned writer, `model=<model>/checkpoint=<step>`, are read alike.
    """
    schema = T.StructType([T.StructField("statistics", T.StructType([T.StructField(f, T.DoubleType()) for f in fields]))])
    raw = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/checkpoint*/*.json")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = raw.select(
        F.regexp_extract(path, r"/(?:model=)?([^/]+)/checkpoint=?\d+/[^/]+$", 1).alias("model"),
        F.regexp_extract(path, r"/checkpoint=?(\d+)/[^/]+$", 1).cast("long").alias("step"),
        "statistics.*",
    )
    if max_checkpoint is not None:
        rows = rows.filter(F.col("step") <= max_checkpoint)
    return rows.orderBy("model", "step")


COMMITS = "_commits"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_once(df: DataFrame, path: str, batch: str, form: str = "json") -> bool:
    """Append a batch of rows under its name; a batch that is there already is left as it is, which returns False.

    The rows go to a folder of this attempt; a small file that names the folder is then moved to the name of the batch,
    in one step.  Readers take the folders that are named, so an attempt that died half-way, or one that came
    second, leaves nothing to be read, and a retried append adds its rows once.
    """
    spark, attempt = df.sparkSession, f"data-{uuid.uuid4().hex}"
    commit, files = _place(spark, f"{path}/{COMMITS}/{batch}")
    if files.exists(commit):
        return False
    df.write.format(form).save(f"{path}/{attempt}")
    note = _place(spark, f"{path}/{COMMITS}/.{attempt}")[0]
    out = files.create(note, False)
    out.writeBytes(attempt)
    out.close()
    return not files.exists(commit) and files.rename(note, commit)


def committed(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "json") -> DataFrame:
    """The rows of all batches appended by `append_once`; one small file a batch is read to find them."""
    folder, files = _place(spark, f"{path}/{COMMITS}")
    if not files.exists(folder):
        return spark.createDataFrame([], schema)
    notes = [str(f.getPath()) for f in files.listStatus(folder) if not f.getPath().getName().startswith(".")]
    names = [r[0] for r in spark.read.text(notes).collect()] if notes else []
    reader = spark.read.schema(schema).format(form)
    return reader.load([f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


METRICS = "step long, data map<string,double>"


def append_metrics(df: DataFrame, path: str, batch: str | None = None) -> None:
    """(step, data map) rows appended as JSON lines; with a batch name a repeated append adds them once."""
    rows = df.select("step", "data")
    if batch is None:
        rows.write.mode("append").json(path)
    else:
        append_once(rows, path, batch)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(step, key, value) of a log; of one written in batches, those that were committed."""
    folder, files = _place(spark, f"{path}/{COMMITS}")
    rows = committed(spark, path, METRICS) if files.exists(folder) else spark.read.schema(METRICS).json(path)
    return rows.select("step", F.explode("data").alias("key", "value"))


def flatten_nested(df: DataFrame, keys: list[str], sep: str = "/") -> DataFrame:
    """Nested structs and lists to (keys, name, value) rows; a list adds `list_len` and indexed names."""

    def walk(col: Column, kind: T.DataType, name: Column) -> Column:
        if isinstance(kind, T.StructType):
            return F.flatten(
                F.array(*[walk(col.getField(f.name), f.dataType, F.concat(name, F.lit(sep + f.name))) for f in kind])
            )
        if isinstance(kind, T.ArrayType):
            size = F.array(F.struct(F.concat(name, F.lit(sep + "list_len")).alias("name"), F.size(col).cast("string").alias("value")))
            items = F.flatten(
                F.transform(col, lambda x, i: walk(x, kind.elementType, F.concat(name, F.lit(sep), i.cast("string"))))
            )
            return F.concat(size, items)
        return F.array(F.struct(name.alias("name"), col.cast("string").alias("value")))

    parts = [walk(F.col(f.name), f.dataType, F.lit(f.name)) for f in df.schema if f.name not in keys]
    return df.select(*keys, F.explode(F.flatten(F.array(*parts))).alias("e")).select(*keys, "e.name", "e.value")


def _brackets(text: Column) -> Column:
    """The brackets of a JSON text that stand outside its strings."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    return F.regexp_replace(plain, r"[^\[\]{}]", "")


def json_depth(text: Column) -> Column:
    """How deep the objects and lists of a JSON text are nested; 0 for a plain value."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        at = s["at"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most"))

    return F.aggregate(F.split(_brackets(text), ""), zero, step, lambda s: s["most"])


def flatten_free(df: DataFrame, keys: list[str], json_col: str, sep: str = "/", depth: int | None = None) -> DataFrame:
    """JSON dictionaries of any keys to (keys, name, value) rows, with the names found in each row.

    Names are joined by `sep`; a list adds `list_len` and the indexed names of its items; an empty dictionary adds
    nothing; a JSON null has a null value.  Null, broken or plain JSON, and JSON that repeats a name in one
    dictionary, has no rows.  Each round opens one level in place, so no row is moved.  `depth` is how many levels are
    opened, text deeper than that is given as JSON; without it the depth of the deepest row is looked up first.
    """
    if depth is None:
        whole = F.try_parse_json(F.col(json_col)).isNotNull()
        depth = df.agg(F.max(F.when(whole, json_depth(F.col(json_col))))).first()[0] or 0
    kind = "array<struct<name:string,value:variant>>"

    def named(name: Column, value: Column) -> Column:
        return F.struct(name.alias("name"), value.alias("value"))

    def opened(e: Column, first: bool = False) -> Column:
        """The entries of one level below; a plain value is its own entry."""
        of = F.schema_of_variant(e["value"])
        under = F.lit("") if first else F.concat(e["name"], F.lit(sep))
        items = F.map_entries(e["value"].cast("map<string,variant>"))
        listed = e["value"].cast("array<variant>")
        size = F.array(named(F.concat(under, F.lit("list_len")), F.parse_json(F.size(listed).cast("string"))))
        return (
            F.when(of.startswith("OBJECT"), F.transform(items, lambda i: named(F.concat(under, i["key"]), i["value"])))
            .when(of.startswith("ARRAY"), F.concat(size, F.transform(listed, lambda v, i: named(F.concat(under, i.cast("string")), v))))
            .otherwise(F.array().cast(kind) if first else F.array(e))
        )

    root = named(F.lit(""), F.try_parse_json(F.col(json_col)))
    rows = df.select(*keys, F.when(root["value"].isNotNull(), opened(root, first=True)).alias("__e"))
    for _ in range(depth - 1):
        rows = rows.withColumn("__e", F.flatten(F.transform("__e", lambda e: opened(e))))
    return rows.select(*keys, F.explode("__e").alias("e")).select(*keys, "e.name", F.col("e.value").cast("string").alias("value"))


def remaining(df: DataFrame, done: DataFrame, key: str = "uid") -> DataFrame:
    """Rows whose key has no stored result yet."""
    return df.join(done.select(key), key, "left_anti")


def cacheable(results: DataFrame) -> DataFrame:
    """Execution results that may be stored; a timed-out one is tried again next time."""
    return results.filter(F.coalesce(F.col("status"), F.lit("")) != "timeout")


def write_rollout_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("exp", "gbs", "n").parquet(path)


def read_rollout_cache(spark: SparkSession, path: str, exp: str, gbs: int, n: int) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("exp") == exp) & (F.col("gbs") == gbs) & (F.col("n") == n))
