import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trajecta.streaming import rollouts as Z

SCHEMA = "queue string, ts timestamp, sample_id long, op string"


def brute(events, capacity):
    items, produced, consumed, dropped = [], 0, 0, 0
    for op, sample in events:
        if op == "get":
            if items:
                items.pop(0)
                consumed += 1
            continue
        if len(items) >= capacity:
            items.pop(0)
            dropped += 1
        items.append(sample)
        produced += 1
    return len(items), produced, consumed, dropped


def test_buffer_state_survives_triggers(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [("get" if i % 5 == 4 else "put", i) for i in range(60)]
    rows = [("q", start + datetime.timedelta(seconds=i), i, op) for i, (op, _) in enumerate(events)]
    for part in range(3):
        frame = spark.createDataFrame(rows[part * 20 : part * 20 + 20], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = Z.read_stream(spark, str(tmp_path / "in"), frame.schema, "*.parquet", files_per_trigger=1)
    out = Z.run_to_files(Z.bounded_buffer(stream, 8), str(tmp_path / "out"), str(tmp_path / "ck"), mode="update")
    assert out.select("batch_number").distinct().count() == 3
    row = Z.newest(out, ["queue"]).collect()[0]
    assert (row["queue_size"], row["produced"], row["consumed"], row["dropped"]) == brute(events, 8)


def test_gate_limit_and_carry(spark):
    assert Z.max_required(8, 0.5, 3) == 36
    start = datetime.datetime(2024, 1, 1)
    rows = [("q", start + datetime.timedelta(seconds=i), i, i // 10, i % 10 == 9) for i in range(20)]
    df = spark.createDataFrame(rows, "queue string, ts timestamp, sample_id long, param_version long, resumed boolean")
    out = Z.staleness_gate(df, 8, 100, carried=2)
    assert out.count() == 18
    assert out.filter("pause").count() == 2 * 4  # counts 8..11 in both versions


def test_late_rows_are_dropped_only_with_a_watermark(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    schema = "ts timestamp, key string, value double, event_id long, interval long"
    minutes = [[0, 1], [60, 61], [2]]
    for part in minutes:
        frame = spark.createDataFrame([(start + datetime.timedelta(minutes=m), "a/sum", 1.0, m, 0) for m in part], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: Z.read_stream(spark, str(tmp_path / "in"), frame.schema, "*.parquet", files_per_trigger=3)
    plain = Z.run_to_files(Z.interval_stream(read(), ["interval"]), str(tmp_path / "a"), str(tmp_path / "ca"), mode="update")
    assert Z.newest(plain, ["interval", "key"]).agg(F.sum("value")).collect()[0][0] == 5.0
    timed = Z.interval_stream(read(), ["interval"], watermark="5 minutes")
    assert "window" in timed.columns


def chunks_as_stream(spark, tmp_path, rows, schema, size):
    for at in range(0, len(rows), size):
        frame = spark.createDataFrame(rows[at : at + size], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return Z.read_stream(spark, str(tmp_path / "in"), frame.schema, "*.parquet", files_per_trigger=1)


def test_put_results_over_triggers(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [("get" if i % 7 == 6 else "put", i) for i in range(60)]
    rows = [("q", start + datetime.timedelta(seconds=i), i, op) for i, (op, _) in enumerate(events)]
    out = Z.run_to_files(Z.put_results(chunks_as_stream(spark, tmp_path, rows, SCHEMA, 20), 8), str(tmp_path / "out"), str(tmp_path / "ck"))
    items, want = [], {}
    for op, sample in events:
        if op == "get":
            items = items[1:]
            continue
        want[sample] = (len(items) < 8, min(len(items) + 1, 8))
        items = [*items, sample][-8:]
    assert {r["sample_id"]: (r["put_ok"], r["queue_size"]) for r in out.collect()} == want


def test_gate_stream_resets_on_a_version_change(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    kinds = ["version" if i % 13 == 12 else "resume" if i % 5 == 4 else "start" for i in range(52)]
    rows = [("q", start + datetime.timedelta(seconds=i), i, k, 2, 1, i % 4) for i, k in enumerate(kinds)]
    schema = "queue string, ts timestamp, sample_id long, kind string, in_flight long, cancelled long, queue_size long"
    stream = chunks_as_stream(spark, tmp_path, rows, schema, 18)
    out = Z.run_to_files(Z.staleness_gate_stream(stream, 9, 100), str(tmp_path / "out"), str(tmp_path / "ck"))
    count, want = 0, {}
    for i, kind in enumerate(kinds):
        if kind == "version":
            count = 3 + i % 4
            continue
        count += kind == "start"
        want[i] = (count, count >= 9)
    assert {r["sample_id"]: (r["staleness_samples"], r["pause"]) for r in out.collect()} == want


def test_a_batch_over_two_triggers_gives_one_row(spark, tmp_path):
    rows = [(i, float(i), i // 20) for i in range(40)]
    stream = chunks_as_stream(spark, tmp_path, rows, "sample_id long, value double, batch long", 15)
    out = Z.assembly_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b.groupBy("batch").agg(F.avg("value").alias("v")))
    assert sorted(map(tuple, out.collect())) == [(0, 9.5), (1, 29.5)]


def test_totals_merge_over_triggers_and_finish_once(spark, tmp_path):
    rng = [((i * 37) % 101) / 3 for i in range(50)]
    rows = [(i, v, v / 2 if i % 5 else None, i % 7, i % 7 - i % 2, i % 7, i // 20) for i, v in enumerate(rng)]
    schema = "sample_id long, processing_time double, tool_call_time double, param_version long, param_version_start long, param_version_end long, batch long"
    stream = chunks_as_stream(spark, tmp_path, rows, schema, 15)
    out = Z.run_to_files(Z.assembly_totals(stream, ["batch"], 20), str(tmp_path / "out"), str(tmp_path / "ck"), mode="update").collect()
    assert sorted(r.batch for r in out) == [0, 1]  # the third batch has 10 of its 20 samples
    for r in out:
        mine = [x for x in rows if x[-1] == r.batch]
        times, tools = [x[1] for x in mine], [x[2] for x in mine if x[2] is not None]
        assert np.allclose([r.processing_time_avg, r.tp50, r.tp95, r.tp99], [np.mean(times), *np.percentile(times, [50, 95, 99])])
        assert np.allclose([r.tool_calls_max, r.tool_calls_min, r.tool_calls_mean], [max(tools), min(tools), np.mean(tools)])
        assert (r.n_samples, r.version_diversity, r.total_partial_num, r.max_partial_span) == (20, 7, 10, 1)


class KeptState:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_large_triggers_leave_in_pieces_and_agree_with_a_plain_loop():
    """25,000 events in frames of 1,700, out of order, over two triggers: small frames out, the same rows as one by one."""
    n, size = 25_000, 1_700
    rng = np.random.RandomState(3)
    kinds = np.where(np.arange(n) % 611 == 0, "version", np.where(np.arange(n) % 9 == 0, "resume", "start"))
    events = pd.DataFrame(
        {"ts": pd.to_datetime(rng.randint(0, 500, n), unit="s"), "sample_id": rng.permutation(n), "kind": kinds, "op": np.where(np.arange(n) % 3 == 0, "get", "put")}
    ).assign(in_flight=2, cancelled=1, queue_size=np.arange(n) % 40)
    gate, puts = KeptState(), KeptState()
    count, items = 0, []
    for trigger in (events[: n // 5], events[n // 5 :]):
        frames = [trigger[at : at + size] for at in range(0, len(trigger), size)]
        gated = list(Z._gate_step(200, 38)(("q",), iter(frames), gate))
        put = list(Z._put_step(8)(("q",), iter(frames), puts))
        assert max(map(len, gated + put)) <= 10_000
        want_gate, want_put = [], []
        for e in trigger.sort_values(["ts", "sample_id"]).itertuples():
            if e.kind == "version":
                count = 3 + e.queue_size
            else:
                count += e.kind == "start"
                want_gate.append((e.sample_id, count, e.queue_size >= 38 or count >= 200))
            if e.op == "get":
                items = items[1:]
            else:
                full = len(items) >= 8
                items = (items[1:] if full else items) + [e.sample_id]
                want_put.append((e.sample_id, not full, len(items)))
        gated, put = pd.concat(gated), pd.concat(put)
        assert list(zip(gated["sample_id"], gated["staleness_samples"], gated["pause"])) == want_gate
        assert list(zip(put["sample_id"], put["put_ok"], put["queue_size"])) == want_put
