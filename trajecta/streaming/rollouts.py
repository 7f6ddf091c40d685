"""Streaming jobs over rollout samples: ingestion, bounded buffer, staleness gate, rollups and counters."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.grouping import join_group_table, with_rank
from ..operators.stepmetrics import rollup_rule


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", files_per_trigger: int = 8, kind: str = "parquet"
) -> DataFrame:
    """Samples as files matching `pattern` arrive; the schema is declared and the trigger size bounded."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", pattern).format(kind).load(folder)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available into parquet under `path` and read it back.

    Update-mode results are appended with their batch number, so a reader takes the newest row per key.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_number", T.LongType())])
    return stream.sparkSession.read.schema(schema).parquet(path).drop("part")


def newest(results: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    values = [c for c in results.columns if c not in keys and c != "batch_number"]
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_number").alias("__v"))
    return last.select(*keys, "__v.*")


# --- bounded buffer -----------------------------------------------------------------------------------------

BUFFER = "queue string, queue_size long, produced long, consumed long, dropped long, oldest long, newest long"
STATE = "items array<long>, produced long, consumed long, dropped long"


PUT = "queue string, sample_id long, put_ok boolean, queue_size long, trigger_no long"
PUT_STATE = "items array<long>, triggers long"


CHUNK = 10_000  # events turned into rows at once
LAST = 1 << 62  # where an event without a sample stands among those of its time


def _whole(column: pd.Series, needed: np.ndarray, other: int) -> np.ndarray:
    """The numbers of the rows that need them; `other` stands in where a row that needs none has none."""
    missing = column.isna().to_numpy()
    if (missing & needed).any():
        raise ValueError(f"{column.name} is null")
    return column.fillna(other).to_numpy().astype("int64")


def _in_time_order(
    frames: Iterator[pd.DataFrame], read: Callable[[pd.DataFrame], dict[str, np.ndarray]]
) -> Iterator[dict[str, np.ndarray]]:
    """The events of a trigger by time and sample, some at a time; a few numbers per event are all that is held."""
    parts = [read(frame) for frame in frames]
    columns = {name: np.concatenate([part.pop(name) for part in parts]) for name in list(parts[0])}
    order = np.lexsort((columns["sample_id"], columns["ts"]))
    for at in range(0, len(order), CHUNK):
        taken = order[at : at + CHUNK]
        yield {name: column[taken] for name, column in columns.items()}


def _read_puts(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    put = (frame["op"] != "get").to_numpy()
    return {"ts": frame["ts"].to_numpy(), "sample_id": _whole(frame["sample_id"], put, LAST), "put": put}


def _put_step(capacity: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, triggers = ([], 0) if not state.exists else state.get
        items = deque(items)
        for events in _in_time_order(frames, _read_puts):
            told = []
            for put, sample in zip(events["put"].tolist(), events["sample_id"].tolist()):
                if not put:
                    if items:
                        items.popleft()
                    continue
                full = len(items) >= capacity
                if full:
                    items.popleft()
                items.append(sample)
                told.append((key[0], sample, not full, len(items), triggers))
            yield pd.DataFrame(told, columns=["queue", "sample_id", "put_ok", "queue_size", "trigger_no"])
        state.update((list(items), triggers + 1))

    return step


def put_results(events: DataFrame, capacity: int) -> DataFrame:
    """One row per put of the bounded buffer: whether it was reported as successful, and the size after it.

    A put into a full queue displaces the oldest sample and reports failure.  Events of a queue are taken in
    time order inside a trigger; one that arrives in a later trigger is applied after those of earlier ones.
    """
    rows = events.select("queue", "ts", "sample_id", "op")
    return rows.groupBy("queue").applyInPandasWithState(
        _put_step(capacity), PUT, PUT_STATE, "append", GroupStateTimeout.NoTimeout
    )


def _buffer_step(capacity: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, produced, consumed, dropped = ([], 0, 0, 0) if not state.exists else state.get
        items = list(items)
        for events in _in_time_order(frames, _read_puts):
            for put, sample in zip(events["put"].tolist(), events["sample_id"].tolist()):
                if not put:
                    if items:
                        items.pop(0)
                        consumed += 1
                    continue
                if len(items) >= capacity:
                    items.pop(0)
                    dropped += 1
                items.append(sample)
                produced += 1
        state.update((items, produced, consumed, dropped))
        ends = (items[0], items[-1]) if items else (None, None)
        yield pd.DataFrame(
            [(key[0], len(items), produced, consumed, dropped, *ends)],
            columns=["queue", "queue_size", "produced", "consumed", "dropped", "oldest", "newest"],
        ).astype({"oldest": "Int64", "newest": "Int64"})

    return step


def bounded_buffer(events: DataFrame, capacity: int) -> DataFrame:
    """Drop-oldest queue per key over put and get events; the state is the queue itself, never longer than
    the capacity.  Events are taken in time order inside a trigger; one that arrives in a later trigger is
    applied after those of earlier ones."""
    rows = events.select("queue", "ts", "sample_id", "op")
    return rows.groupBy("queue").applyInPandasWithState(
        _buffer_step(capacity), BUFFER, STATE, "update", GroupStateTimeout.NoTimeout
    )


def buffer_contents(puts: DataFrame, capacity: int) -> DataFrame:
    """Batch form for puts only: each sample with whether it was dropped and whether its put reported success.

    A put into a full queue displaces the oldest sample and still reports failure.
    """
    rows = with_rank(puts, F.date_trunc("hour", "ts"), [F.col("ts"), F.col("sample_id")], "put_no", ["queue"])
    sizes = puts.groupBy("queue").agg(F.count(F.lit(1)).alias("__n"))
    rows = join_group_table(rows, sizes, ["queue"], "sample_id")
    return (
        rows.withColumn("was_dropped", F.col("put_no") < F.col("__n") - capacity)
        .withColumn("put_ok", F.col("put_no") < capacity)
        .drop("__n")
    )


def producer_counts(contents: DataFrame) -> DataFrame:
    """What a producer counts: successes as generated, failures as dropped for staleness."""
    return contents.groupBy("queue").agg(
        F.count_if("put_ok").alias("total_generated_samples"), F.count_if(~F.col("put_ok")).alias("dropped_stale_samples")
    )


# --- staleness gate --------------------------------------------------------------------------------------------


def max_required(required: int, staleness_threshold: float, sync_steps: int) -> int:
    return int(required * (staleness_threshold + 1) * sync_steps)


def staleness_gate(
    samples: DataFrame, limit: int, max_queue: int, carried: Column | int = 0, queue_size: Column | int = 0
) -> DataFrame:
    """Adds `staleness_samples` and `pause` for every new sample in time order within its policy version.

    A version change starts again from the work still carried (in flight, cancelled and queued), not from
    zero; resumed samples are not counted again.
    """
    carried = carried if isinstance(carried, Column) else F.lit(carried)
    queue_size = queue_size if isinstance(queue_size, Column) else F.lit(queue_size)
    fresh = samples.filter(~F.col("resumed"))
    ranked = with_rank(fresh, F.date_trunc("hour", "ts"), [F.col("ts"), F.col("sample_id")], "__r", ["queue", "param_version"])
    count = carried + F.col("__r") + 1
    return ranked.withColumn("staleness_samples", count).withColumn(
        "pause", (queue_size >= max_queue) | (count >= limit)
    ).drop("__r")


GATE = "queue string, sample_id long, staleness_samples long, pause boolean"
GATE_STATE = "count long, queue_size long"


def _read_gate(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    version = (frame["kind"] == "version").to_numpy()
    queued = _whole(frame["queue_size"], np.ones(len(frame), dtype=bool), 0)
    return {
        "ts": frame["ts"].to_numpy(),
        "sample_id": _whole(frame["sample_id"], ~version, LAST),
        "version": version,
        "start": (frame["kind"] == "start").to_numpy(),
        "carried": _whole(frame["in_flight"], version, 0) + _whole(frame["cancelled"], version, 0) + queued,
        "queued": queued,
    }


def _gate_step(limit: int, max_queue: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, queued = (0, 0) if not state.exists else state.get
        for events in _in_time_order(frames, _read_gate):
            started = np.cumsum(events["start"], dtype="int64")
            at = np.maximum.accumulate(np.where(events["version"], np.arange(len(started)), -1))
            counts = np.where(at < 0, count, events["carried"][at] - started[at]) + started
            count, queued = int(counts[-1]), int(events["queued"][-1])
            told = ~events["version"]
            yield pd.DataFrame(
                {
                    "queue": key[0],
                    "sample_id": events["sample_id"][told],
                    "staleness_samples": counts[told],
                    "pause": ((events["queued"] >= max_queue) | (counts >= limit))[told],
                }
            )
        state.update((count, queued))

    return step


def staleness_gate_stream(events: DataFrame, limit: int, max_queue: int) -> DataFrame:
    """The gate as a stream: one row per sample that starts or resumes, with the count after it and the pause flag.

    Events are (queue, ts, sample_id, kind, in_flight, cancelled, queue_size).  A `start` adds one, a `resume`
    adds none, and a `version` change sets the count to the work still carried: in flight, cancelled and
    queued.  The state of a queue is two numbers.
    """
    rows = events.select("queue", "ts", "sample_id", "kind", "in_flight", "cancelled", "queue_size")
    return rows.groupBy("queue").applyInPandasWithState(
        _gate_step(limit, max_queue), GATE, GATE_STATE, "append", GroupStateTimeout.NoTimeout
    )


# --- rollups and counters -----------------------------------------------------------------------------------------


def interval_stream(log: DataFrame, keys: list[str], watermark: str | None = None) -> DataFrame:
    """Running rollup per (interval, metric) by the rule of its name.

    Without one the state holds every interval seen, as a late row may belong to any of them; a long-running
    job sets a watermark.  With it, intervals become event-time windows of ten minutes and late rows are dropped; that is
    an addition to the plain version, which never drops.
    """
    if watermark:
        log = log.withWatermark("ts", watermark).withColumn("window", F.window("ts", "10 minutes"))
        keys = ["window"]
    rule = rollup_rule(F.col("key"))
    agg = log.groupBy(*keys, "key").agg(
        F.sum("value").alias("s"),
        F.avg("value").alias("a"),
        F.max("value").alias("hi"),
        F.min("value").alias("lo"),
        F.max_by("value", F.struct("ts", "event_id")).alias("last"),
    )
    value = (
        F.when(rule == "last", F.col("last"))
        .when(rule.isin("sum", "time_sum"), F.col("s"))
        .when(rule == "max", F.col("hi"))
        .when(rule == "min", F.col("lo"))
        .otherwise(F.col("a"))
    )
    return agg.select(*keys, "key", value.alias("value"))


def staleness_stream(samples: DataFrame, current_version: int) -> DataFrame:
    lag = F.lit(current_version) - F.col("param_version")
    end_lag = F.lit(current_version) - F.col("param_version_end")
    return samples.groupBy("queue").agg(
        F.count_if(lag >= 1).alias("stale_samples_processed"), F.count_if(end_lag >= 1).alias("stale_trajectory_processed")
    )


def assembly_stream(samples: DataFrame, path: str, checkpoint: str, stats) -> DataFrame:
    """Statistics of every training batch by a batch operator `stats(frame)`, one final row per batch.

    Samples are stored under `path` as they arrive, and a batch is measured over all of its stored samples, so
    one that is spread over several triggers still gives one row.
    """
    return stats(run_to_files(samples, path, checkpoint).drop("batch_number"))


def assembly_totals(samples: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """Statistics of each training batch as a streaming aggregate, for update mode; no sample is stored or read again.

    Every trigger merges its partial aggregates, combined where the samples are read, into one state row a batch: sums,
    extremes, the versions seen and the counts of the distinct processing times, from which the percentiles are exact.
    With `size` a batch is told once it has that many samples, which is its last row unless more samples follow; without
    it every trigger tells the batches it touched.  Null times are left out of the statistics and count as samples.
    """
    span = F.abs(F.col("param_version_end") - F.col("param_version_start"))
    tails = {"tp50": 0.5, "tp95": 0.95, "tp99": 0.99}
    out = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("processing_time").alias("processing_time_avg"),
        F.max("processing_time").alias("processing_time_max"),
        F.min("processing_time").alias("processing_time_min"),
        F.max("tool_call_time").alias("tool_calls_max"),
        F.min("tool_call_time").alias("tool_calls_min"),
        F.avg("tool_call_time").alias("tool_calls_mean"),
        F.count_if(span != 0).alias("total_partial_num"),
        F.avg((span != 0).cast("int")).alias("partial_ratio"),
        F.max(span).alias("max_partial_span"),
        *[F.percentile("processing_time", F.lit(p)).alias(name) for name, p in tails.items()],
        F.size(F.collect_set("param_version")).alias("version_diversity"),
    )
    return out if size is None else out.filter(F.col("n_samples") >= size)
