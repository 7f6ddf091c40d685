import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajecta.operators import balance as B
from trajecta.operators import validation as V
from trajecta.operators.container import coverage
from trajecta.operators.grouping import exact_percentiles, map_groups, with_rank

LONG = "data_source string, uid string, var string, value double, pred string, pos long"


def test_mean_and_std_names(spark):
    rows = [("s1", "p1", "score", v, p, i) for i, (v, p) in enumerate([(0.8, "A"), (0.9, "B")])] + [("s2", "p2", "score", 0.7, "A", 9)]
    out = {(r["data_source"], r["metric"]): r["value"] for r in V.validation_metrics(spark.createDataFrame(rows, LONG)).collect()}
    assert abs(out[("s1", "mean@2")] - 0.85) < 1e-12
    assert abs(out[("s1", "std@2")] - 0.05) < 1e-12
    assert ("s2", "std@1") not in out and abs(out[("s2", "mean@1")] - 0.7) < 1e-12


def test_closed_form_equals_enumeration(spark):
    values = [1.0, 2.0, 2.0, 5.0]
    df = spark.createDataFrame([("s", "p", "v", x, None, i) for i, x in enumerate(values)], LONG)
    out = {r["metric"]: r["value"] for r in V.best_worst_closed_form(df).collect()}
    for n in (2, 4):
        draws = list(itertools.product(values, repeat=n))
        best, worst = np.array([max(d) for d in draws]), np.array([min(d) for d in draws])
        assert abs(out[f"best@{n}/mean"] - best.mean()) < 1e-9 and abs(out[f"best@{n}/std"] - best.std()) < 1e-9
        assert abs(out[f"worst@{n}/mean"] - worst.mean()) < 1e-9 and abs(out[f"worst@{n}/std"] - worst.std()) < 1e-9


def brute_resample(values, preds, k, seed=42, rounds=1000):
    np.random.seed(seed)
    idx = np.random.choice(len(values), size=(rounds, k), replace=True)
    best, maj = [], []
    for row in idx:
        best.append(max(values[i] for i in row))
        votes = {}
        for i in row:
            votes.setdefault(preds[i], []).append(values[i])
        maj.append(votes[max(votes, key=lambda p: len(votes[p]))][0])
    return np.mean(best), np.std(best), np.mean(maj), np.std(maj)


def test_resampling_matches_seeded_loop(spark):
    values, preds = [0.9, 0.8, 0.7, 0.6, 0.1], ["A", "B", "B", "A", "C"]
    df = spark.createDataFrame([("s", "p", "v", v, p, i) for i, (v, p) in enumerate(zip(values, preds))], LONG)
    out = {r["metric"]: r["value"] for r in V.resampled_metrics(df).collect()}
    for k in (2, 4, 5):
        best, best_std, maj, maj_std = brute_resample(values, preds, k)
        got = [out[f"best@{k}/mean"], out[f"best@{k}/std"], out[f"maj@{k}/mean"], out[f"maj@{k}/std"]]
        assert np.allclose(got, [best, best_std, maj, maj_std], atol=1e-12)


def test_resampling_of_many_prompts_uses_the_draws_of_each_size(spark):
    """Prompts of 2 to 6 responses, several of each size, in one task: each gets the draws of a generator of its own."""
    prompts = {f"p{i}": [((i * 31 + j * 17) % 23) / 7 for j in range(2 + i % 5)] for i in range(20)}
    rows = [("s", p, "v", v, "ABC"[(j * j) % 3], j) for p, values in prompts.items() for j, v in enumerate(values)]
    df = spark.createDataFrame(rows, LONG).repartition(3)
    out = {(r["uid"], r["metric"]): r["value"] for r in V.resampled_metrics(df, rounds=50).collect()}
    for p, values in prompts.items():
        preds = ["ABC"[(j * j) % 3] for j in range(len(values))]
        k = len(values)
        got = [out[p, f"best@{k}/mean"], out[p, f"best@{k}/std"], out[p, f"maj@{k}/mean"], out[p, f"maj@{k}/std"]]
        assert np.allclose(got, brute_resample(values, preds, k, rounds=50), atol=1e-12)


def test_draws_joined_by_rank_agree_with_resampling(spark):
    values = [0.1 * i for i in range(8)]
    df = spark.createDataFrame([("s", "p", "v", v, "AB"[i % 2], i) for i, v in enumerate(values)], LONG)
    out = {r["metric"]: r["value"] for r in V.majority_by_draws(df, 300, 42).unionByName(V.best_worst_closed_form(df)).collect()}
    best, _, maj, _ = brute_resample(values, ["AB"[i % 2] for i in range(8)], 4)
    assert abs(out["best@4/mean"] - best) < 0.05
    assert abs(out["maj@4/mean"] - maj) < 0.08
    assert out["best@8/mean"] is not None and out["maj@8/std"] is not None


def test_resampling_keeps_its_draws_at_any_size(spark, monkeypatch):
    """More responses than any former limit, and pieces of any length, give the draws of one generator call."""
    rng = np.random.RandomState(0)
    values, preds = rng.rand(700).round(3).tolist(), [f"p{i}" for i in rng.randint(0, 40, 700)]
    df = spark.createDataFrame([("s", "p", "v", v, p, i) for i, (v, p) in enumerate(zip(values, preds))], LONG)
    want = {k: brute_resample(values, preds, k) for k in (2, 512, 700)}
    for cells in (V.CELLS, 5_000):
        monkeypatch.setattr(V, "CELLS", cells)
        out = {r["metric"]: r["value"] for r in V.resampled_metrics(df).collect()}
        for k, (best, best_std, maj, maj_std) in want.items():
            got = [out[f"best@{k}/mean"], out[f"best@{k}/std"], out[f"maj@{k}/mean"], out[f"maj@{k}/std"]]
            assert np.allclose(got, [best, best_std, maj, maj_std], atol=1e-12)


def test_majority_tie_goes_to_first_seen(spark):
    rows = [("A", 0.9), ("B", 0.8), ("B", 0.7), ("A", 0.6)]
    df = spark.createDataFrame([("s", "p", "v", v, p, i) for i, (p, v) in enumerate(rows)], LONG)
    assert V.majority_value(df).collect()[0]["value"] == 0.9


def test_two_level_rank_and_percentiles(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("v"),
        "id",
    )
    ranked = with_rank(df, F.floor(F.col("v")), [F.col("v"), F.col("id")], "r", ["g"])
    pdf = ranked.toPandas().sort_values(["g", "v", "id"])
    assert (pdf["r"] == pdf.groupby("g").cumcount()).all()
    got = exact_percentiles(df, ["g"], "v", {"p95": 0.95}).toPandas().set_index("g")["p95"]
    want = df.toPandas().groupby("g")["v"].quantile(0.95)
    assert np.allclose(got.sort_index(), want.sort_index())


@pytest.fixture(scope="module")
def items(spark):
    lengths = [100, 200, 150, 50]
    rows = [(0, i, i // 4, lengths[i // 4]) for i in range(16)]
    return spark.createDataFrame(rows, "step long, row_idx long, uid long, length long")


@pytest.mark.parametrize("algorithm", ["differencing", "greedy", "serpentine"])
def test_partitions_cover_and_balance(items, algorithm):
    work = items.select("step", F.col("row_idx").alias("item_id"), B.workload(F.col("length")).alias("work"), F.lit(4).alias("k"))
    parts = B.balanced_partitions(work, ["step"], algorithm, equal=True)
    assert coverage(parts.withColumnRenamed("item_id", "row_idx"), items, "row_idx").count() == 0
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 4, 3: 4}
    if algorithm != "greedy":
        loads = [r["s"] for r in parts.join(work, ["step", "item_id"]).groupBy("part").agg(F.sum("work").alias("s")).collect()]
        assert max(loads) - min(loads) == 0


def test_uneven_partition_is_never_empty(items):
    work = items.select("step", F.col("row_idx").alias("item_id"), F.col("length").alias("work"), F.lit(5).alias("k"))
    parts = B.balanced_partitions(work, ["step"], "differencing", equal=False)
    assert parts.select("part").distinct().count() == 5
    with pytest.raises(Exception, match="equal partitions"):
        B.balanced_partitions(work, ["step"], "differencing", equal=True).collect()


def test_one_rule_and_one_set_of_errors_at_every_size(spark):
    """10 items and 60,000 items over 4 partitions: the same rule, the same checks."""
    for n in (10, 60_000):
        work = spark.range(n).select(F.lit(0).alias("step"), F.col("id").alias("item_id"), (F.col("id") % 97 + 1).alias("work"), F.lit(4).alias("k"))
        for name in ("differencing", "greedy"):
            parts = B.balanced_partitions(work, ["step"], name, equal=False)
            want = B.ALGORITHMS[name]([i % 97 + 1 for i in range(n)], 4, False)
            got = {r["part"]: r["ids"] for r in parts.groupBy("part").agg(F.sort_array(F.collect_list("item_id")).alias("ids")).collect()}
            assert got == dict(enumerate(want))
        uneven = work.filter(F.col("item_id") < n - (n % 4 or 2) + 1)
        for name in ("differencing", "greedy", "serpentine"):
            with pytest.raises(Exception, match="equal partitions"):
                B.balanced_partitions(uneven, ["step"], name, equal=True).collect()
            with pytest.raises(Exception, match="cannot fill"):
                B.balanced_partitions(work.withColumn("k", F.lit(n + 1)), ["step"], name, equal=False).collect()


def test_differencing_ties():
    """Equal spreads: the split with the larger heaviest set goes first; equal sums order by size, then members."""
    assert B._differencing([5, 5, 5, 5], 2, True) == [[0, 3], [1, 2]]


def test_differencing_scales_in_items_and_sets():
    """40,000 items over 1,500 sets, and one set heavier than all others; neither cost grows with items times sets."""
    work = [(i * 7919) % 1009 + 1 for i in range(40_000)]
    begun = time.process_time()
    parts = B.ALGORITHMS["differencing"](work, 1500, False)
    loads = [sum(work[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(40_000))
    assert loads == sorted(loads, reverse=True) and loads[0] - loads[-1] <= max(work)
    heavy = B.ALGORITHMS["differencing"]([10**9, *work], 4, False)
    assert heavy[0] == [0] and sorted(map(len, heavy))[0] == 1
    assert time.process_time() - begun < 20


def _works(rng, n):
    """Loads with ties, long tails, zeros and a few heavy items."""
    return [
        rng.randint(0, 5, n),
        rng.randint(0, 10**6, n),
        (rng.pareto(1, n) * 100).astype("int64"),
        np.maximum(rng.poisson(4, n), 1) * 37 + rng.randint(10, 60, n),
        np.zeros(n, dtype="int64"),
        1000 + rng.randint(0, 40, n) + (rng.rand(n) < 0.01) * 10**5,
    ]


@pytest.mark.parametrize("few", [1, 8, 10**6])
def test_sets_in_arrays_meet_like_sets_in_lists(monkeypatch, few):
    """However many items a split takes in one by one, the parts are those of the lists."""
    rng = np.random.RandomState(few % 97)
    monkeypatch.setattr(B, "FEW", few)
    for k in (2, 3, 17, 40, 90):
        for n in (k, 2 * k, 11 * k + 1):
            for work in _works(rng, n):
                for equal in (False, True):
                    some = work[: n // k * k] if equal else work
                    monkeypatch.setattr(B, "WIDE", 10**9)
                    want = B.PARTS["differencing"](some, k, equal)
                    monkeypatch.setattr(B, "WIDE", 2)
                    assert np.array_equal(B.PARTS["differencing"](some, k, equal), want)


def test_differencing_does_not_move_all_sets_for_each_item():
    """Ten times the items over ten times the sets: about ten times the work, long tails included."""
    rng = np.random.RandomState(3)
    spent = []
    for n in (60_000, 600_000):
        work = _works(rng, n)[3].astype("int64") ** 2
        begun = time.process_time()
        part = B.PARTS["differencing"](work, n // 10, False)
        spent.append(time.process_time() - begun)
        loads = np.bincount(part, work)
        assert (np.diff(loads) <= 0).all() and loads[0] - loads[-1] <= work.max()
    assert spent[1] < 25 * spent[0] + 1


def test_groups_cross_batches_and_keep_null_keys(spark):
    """Groups of 1 to 40 rows over batches of 7: every group is seen once, in order, null keys being a group."""
    rows = [(None if k == 3 else k, i) for k in range(9) for i in range(1 if k % 2 else 40)]

    def run(pieces):
        ids = [i for p in pieces for i in p.column("i").to_pylist()]
        columns = [pieces[0].column("k").slice(0, 1), pa.array([len(ids)]), pa.array([ids == sorted(ids)])]
        yield pa.RecordBatch.from_arrays(columns, ["k", "n", "up"])

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        out = map_groups(spark.createDataFrame(rows, "k long, i long").repartition(3), ["k"], [F.col("i")], run, "k long, n long, up boolean").collect()
    finally:
        spark.conf.set(size, before)
    assert len(out) == 9 and {r["k"]: (r["n"], r["up"]) for r in out} == {None if k == 3 else k: (1 if k % 2 else 40, True) for k in range(9)}


def test_groups_stay_whole(items):
    parts = B.group_partitions(items, ["step"], "uid", 2)
    assert parts.count() == 4 and parts.groupBy("part").count().filter("count = 2").count() == 2


def test_micro_batches_respect_budget_and_order(items):
    out = B.micro_batches(items, ["step"], 600)
    loads = out.join(items, ["step", "row_idx"]).groupBy("micro_batch").agg(F.sum(B.workload(F.col("length"))).alias("w"), F.sum("length").alias("n"))
    rows = loads.orderBy("micro_batch").collect()
    assert len(rows) == 4 and sum(r["n"] for r in rows) == 2000
    middle = [r["w"] for r in rows]
    assert max(middle[1:3]) >= max(middle[0], middle[3])
    with pytest.raises(Exception, match="budget below"):
        B.micro_batches(items, ["step"], 100).collect()


@pytest.mark.parametrize("algorithm", ["differencing", "greedy"])
def test_micro_batches_are_numbered_where_they_are_made(spark, algorithm):
    """One pass through the rule, and the numbers the tables give: rows that share an id, rows without one."""
    rng = np.random.RandomState(5)
    rows = [(s, int(i) if i % 9 else None, int(n)) for s in (0, 1) for i, n in zip(rng.randint(0, 150, 400), rng.randint(5, 90, 400))]
    df = spark.createDataFrame(rows, "step long, row_idx long, length long").repartition(3)
    out = B.micro_batches(df, ["step"], 400, algorithm=algorithm)
    counts = B.micro_batch_counts(df, ["step"], 400)
    items = df.join(counts, "step").select("step", F.col("row_idx").alias("item_id"), B.workload(F.col("length")).alias("work"), "k")
    want = B._placed_at_ends(B.balanced_partitions(items, ["step"], algorithm, equal=False), items, ["step"])
    got, wanted = (sorted(map(tuple, x.collect()), key=str) for x in (out, want))
    assert got == wanted and len(got) == 800 and any(r[1] is None for r in got)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_micro_batches_without_any_id(spark):
    df = spark.range(10).select(F.lit(0).alias("step"), F.lit(None).cast("long").alias("row_idx"), F.lit(9).alias("length"))
    assert [tuple(r) for r in B.micro_batches(df, ["step"], 20).collect()] == [(0, None, None)] * 10


def test_micro_batch_coverage_runs_the_rule_once(spark, tmp_path):
    """Two steps: every row is counted once, by one pass through the rule."""
    from trajecta.plans import q_batches as Q

    rows = [(i, 8 * (i % 40) if i % 6 else 1) for i in range(600)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long")
    rest = [F.lit("F").alias("o_orderstatus"), F.lit(4.0).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority")]
    orders.select("*", *rest).write.parquet(f"{tmp_path}/orders.parquet")
    # 20 tokens a response, so the lengths of a step follow from the prompts.
    lines = spark.range(600).toDF("l_orderkey").crossJoin(spark.range(20).toDF("l_linenumber"))
    rest = [F.lit(1).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")]
    lines.select("*", *rest, F.lit("O").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = Q.balance_micro_batch_coverage(spark, str(tmp_path))
    tokens = {s: [20 * 37 + c % 50 + 10 for _, c in rows if c % 8 == s] for s in (0, 1)}
    assert sorted(map(tuple, out.collect())) == [(s, len(t), -(-sum(t) // 20000)) for s, t in tokens.items()]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_micro_batches_by_the_rule_that_spreads_a_step(items):
    out = B.micro_batches(items, ["step"], 600, algorithm="serpentine").collect()
    assert sorted(r["row_idx"] for r in out) == list(range(16)) and {r["micro_batch"] for r in out} == {0, 1, 2, 3}


def test_response_sizes_are_those_of_the_trajectories(spark, tmp_path):
    """Orders without lines, lines without orders, null keys and rows that come twice."""
    from trajecta import derive as D
    from trajecta.plans import q_batches as Q

    orders = [(1, 7), (1, 7), (2, None), (3, 61), (4, 8), (None, 9)]
    lines = [1, 1, 1, 2, 3, 3, 5, None, None]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    spark.createDataFrame([(*o, "F", 4.0, "1-URGENT") for o in orders], schema).write.parquet(f"{tmp_path}/orders.parquet")
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_linestatus string"
    spark.createDataFrame([(k, i, 1, None, 2.0, 0.1, None, "O") for i, k in enumerate(lines)], schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = D.trajectories(spark, str(tmp_path))
    length = (F.size("response_mask") * 37 + F.col("prompt_len")).cast("long").alias("length")
    want = whole.select("step", F.col("sample_id").alias("row_idx"), "uid", length)
    got = Q.lengths(spark, str(tmp_path))
    assert got.schema == want.schema
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted(map(tuple, want.collect()), key=str)
    assert found == sorted([(7, 1, 7, 128)] * 2 + [(None, 2, None, None), (5, 3, 61, 95)], key=str)
    assert "l_linenumber" not in got._jdf.queryExecution().executedPlan().toString()


def test_step_layout_is_a_permutation(items):
    out = B.balance_step(items, ["step"], 4).collect()
    assert sorted(r["new_idx"] for r in out) == list(range(16))


@pytest.mark.parametrize("values", [[7.0] * 500, [1e-6 * (i % 83) for i in range(500)], [1e9 * i for i in range(500)], [3.0]])
def test_exact_percentiles_at_any_scale(spark, values, monkeypatch):
    from trajecta.operators import grouping as G

    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 2.0)], "k string, v double")
    for whole in (G.SORTED_WHOLE, 0):
        monkeypatch.setattr(G, "SORTED_WHOLE", whole)
        if whole == 0 and len(values) == 1:
            continue
        out = {r["k"]: r for r in G.exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
        assert np.isclose(out["a"]["p50"], np.percentile(values, 50)) and out["b"]["p95"] == 2.0
        if whole:
            assert np.isclose(out["a"]["p95"], np.percentile(values, 95))


@pytest.mark.parametrize("scale", [0.0, 1e-6, 1e6])
def test_highest_covariances_at_any_scale(spark, scale):
    from trajecta.operators import losses as L

    rng = np.random.RandomState(1)
    advantages = {int(i) * 10**9: np.round(rng.rand(20), 2) * scale for i in range(60)}
    rows = [(0, s, [0.0] * 20, [0.1 + p / 100 for p in range(20)], a.tolist(), [1] * 20, 20) for s, a in advantages.items()]
    df = spark.createDataFrame(
        rows, "step long, sample_id long, old_log_probs array<double>, log_probs array<double>, advantages array<double>, response_mask array<int>, max_response_len int"
    )
    a = np.array(list(advantages.values()))
    lr = np.tile(0.1 + np.arange(20) / 100, (60, 1))
    cov = (a - a.sum() / a.size) * (lr - lr.sum() / lr.size)
    first = np.argsort(-cov.ravel(), kind="stable")[:24]
    want = ((-a * np.exp(lr)).sum() + lr.ravel()[first].sum()) / a.size
    got = L.covariance_penalty(df, ratio=0.02).first().pg_loss
    assert np.isclose(got, want, rtol=1e-9)


def test_scan_pieces_bound_the_padding(spark):
    import pandas as pd

    from trajecta.functions import arrays as X

    rows = pd.Series([np.ones(3)] * 2000 + [np.ones(30_000), None])
    pieces = X._pieces(rows)
    assert sorted(int(i) for p in pieces for i in p) == list(range(2002))
    for p in pieces:
        assert len(p) == 1 or len(p) * max(0 if rows[i] is None else len(rows[i]) for i in p) <= X.CELLS
    out = X._by_piece(X._discounted, rows, rows, pd.Series([1.0] * 2002))
    assert out[2000][0] == 30_000 and out[0].tolist() == [3, 2, 1] and out[2001] is None
