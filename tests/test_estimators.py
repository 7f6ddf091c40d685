"""Estimators against a numpy statement of their formulas, including degenerate groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions.arrays import cumsum, reverse_cumsum
from trajecta.operators import advantages as A
from trajecta.operators.grouping import with_group_stats

# (uid, score, mask): a triple, a pair with equal scores, a lone row, a fully masked row in a pair.
ROWS = [
    ("a", 1.0, [1, 1, 0]),
    ("a", 3.0, [1, 0, 1]),
    ("a", 3.0, [1, 1, 1]),
    ("b", 2.0, [1, 1]),
    ("b", 2.0, [0, 1]),
    ("c", 5.0, [1, 1]),
    ("d", 4.0, [0, 0]),
    ("d", 1.0, [1, 1]),
]


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i, (uid, score, mask) in enumerate(ROWS):
        n = len(mask)
        data.append((0, uid, i, mask, [0.0] * (n - 1) + [score], [-0.1 * (i + 1)] * n, [0.2] * n, [0.5] * n))
    return spark.createDataFrame(
        data,
        "step long, uid string, sample_id long, response_mask array<int>, token_level_rewards array<double>, "
        "old_log_probs array<double>, sum_pi_squared array<double>, values array<double>",
    )


def by_id(df, column="advantages"):
    return {r["sample_id"]: r[column] for r in df.select("sample_id", column).collect()}


def expected(fn):
    out = {}
    for i, (uid, score, mask) in enumerate(ROWS):
        group = np.array([s for u, s, _ in ROWS if u == uid])
        lengths = np.array([sum(m) for u, _, m in ROWS if u == uid])
        out[i] = [fn(score, group, lengths) * m for m in mask]
    return out


CASES = {
    "grpo": lambda s, g, n: (s - (0 if len(g) == 1 else g.mean())) / ((1 if len(g) == 1 else g.std(ddof=1)) + 1e-6),
    "grpo_vectorized": lambda s, g, n: (s - (0 if len(g) == 1 else g.mean()))
    / ((1 if len(g) == 1 else np.sqrt(max(g.var(ddof=1), 1e-6))) + 1e-6),
    "rloo": lambda s, g, n: s if len(g) == 1 else (s - g.mean()) * len(g) / (len(g) - 1),
    "rloo_vectorized": lambda s, g, n: 0 if len(g) == 1 else (s - g.mean()) * len(g) / (len(g) - 1),
    "opo": lambda s, g, n: s - (0 if len(g) == 1 else (g * n).sum() / n.sum()),
    "gpg": lambda s, g, n: s - (0 if len(g) == 1 else g.mean()),
}


@pytest.mark.parametrize("name", CASES)
def test_group_estimators(rows, name):
    got, want = by_id(A.advantage(rows, name)), expected(CASES[name])
    for i in want:
        assert np.allclose(got[i], want[i], rtol=1e-6, atol=1e-6), (name, i)


def test_passk_rejects_single_rows_and_ties_give_zero(rows):
    pairs = rows.filter("uid <> 'c'")
    got = by_id(A.grpo_passk(pairs, norm_by_std=False))
    assert all(v == 0 for i in (0, 1, 2, 3, 4) for v in got[i])
    assert got[6] == [0.0, 0.0] and got[7] == [0.0, 0.0]
    with pytest.raises(Exception, match="two samples"):
        A.grpo_passk(rows).collect()


def test_unknown_estimator(rows):
    with pytest.raises(ValueError):
        A.advantage(rows, "nothing")


def test_gae_matches_loop(rows):
    gamma, lam = 0.9, 0.8
    got = by_id(A.gae(rows, gamma, lam), "returns")
    for i, (_, score, mask) in enumerate(ROWS):
        r = [0.0] * (len(mask) - 1) + [score]
        nxt = last = 0.0
        want = [0.0] * len(mask)
        for t in reversed(range(len(mask))):
            if mask[t]:
                last = r[t] + gamma * nxt - 0.5 + gamma * lam * last
                nxt = 0.5
            want[t] = last + 0.5
        assert np.allclose(got[i], want), i


def test_optimal_token_baseline_single_row_keeps_return(rows):
    out = by_id(A.optimal_token_baseline(rows))
    assert np.allclose(out[5], [5.0, 5.0])
    tir = by_id(A.tir_optimal_token_baseline(rows))
    assert tir[6] == [0.0, 0.0]
    assert np.allclose(tir[7], [1.0, 1.0])  # its partner has no valid token and takes no part


def test_hot_group_equals_plain_aggregate(spark):
    """A third of all rows under one key: statistics stay exact and no bucket holds the whole group."""
    df = spark.range(30000).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("uid"),
        (F.col("id") % 97).cast("double").alias("v"),
    )
    out = with_group_stats(df, ["uid"], "sample_id", sums={"s": F.col("v")}, moments={"g": F.col("v")})
    plain = df.groupBy("uid").agg(F.sum("v").alias("s2"), F.avg("v").alias("m2"), F.var_pop("v").alias("v2"))
    bad = out.join(plain, "uid").filter(
        (F.abs(F.col("s") - F.col("s2")) > 1e-6)
        | (F.abs(F.col("g_mean") - F.col("m2")) > 1e-9)
        | (F.abs(F.col("g_m2") / F.col("g_n") - F.col("v2")) > 1e-6)
    )
    assert out.count() == 30000 and bad.count() == 0


def test_group_advantages_sum_to_zero_and_ignore_partitioning(spark, sf):
    from trajecta.plans.q_advantages import rewarded

    rows = rewarded(spark, sf).select("step", "uid", "sample_id", "response_mask", "token_level_rewards")
    ones = rows.withColumn("response_mask", F.array(F.lit(1)))
    value = F.get("advantages", F.lit(0))
    sums = A.grpo(ones).groupBy("step", "uid").agg(F.abs(F.sum(value)).alias("s"), F.count(F.lit(1)).alias("n"))
    assert sums.filter("n > 1 AND s > 1e-6").count() == 0
    again = A.grpo(ones.repartition(7)).select("sample_id", F.round(value, 9).alias("a"))
    assert again.exceptAll(A.grpo(ones).select("sample_id", F.round(value, 9).alias("a"))).count() == 0


def test_resample_draws_follow_weights(spark):
    df = spark.range(4000).select(
        F.lit(0).alias("step"), F.col("id").alias("sample_id"), F.array(F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0)).alias("token_level_scores")
    )
    drawn = A.resample(df, seed=3)
    assert drawn.count() == 4000
    share = drawn.filter("sample_id % 2 = 0").count() / 4000
    assert abs(share - 0.9) < 0.03


def test_adaptive_coefficient_matches_sequential_update(spark):
    steps = [(i, kl, 64) for i, kl in enumerate([0.1, 0.5, 0.2, 0.05])]
    df = spark.createDataFrame(steps, "step long, current_kl double, batch_size long")
    out = A.adaptive_kl_coefficients(df, 0.2, 0.2, 1000).orderBy("step").collect()
    v = 0.2
    for row, (_, kl, n) in zip(out, steps):
        assert abs(row["kl_coef"] - v) < 1e-12
        v *= 1 + min(max(kl / 0.2 - 1, -0.2), 0.2) * n / 1000
        assert abs(row["kl_coef_after"] - v) < 1e-12


def leaves(df):
    """How often a plan reads its input."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_passk_reads_its_rows_twice(rows):
    """One join carries all statistics of a group: its table and the rows."""
    assert leaves(A.grpo_passk(rows, single="zero")) == 2


def test_tops_are_the_two_largest_distinct_values_over_all_buckets(spark):
    data = [("a", i, float(v)) for i, v in enumerate([3, 9, 9, 4, 7])] + [("b", 9, 1.0), ("c", 10, None), ("c", 11, 2.0)]
    df = spark.createDataFrame([*data, ("a", 1, 9.0), (None, 12, 5.0), (None, 13, 6.0)], "k string, i long, v double")
    for buckets in (1, 3, 64):
        out = with_group_stats(df, ["k"], "i", sums={"n": F.lit(1)}, tops={"t": F.struct("v", "i"), "u": F.col("v")}, buckets=buckets)
        got = {(r["k"], r["n"], r["t"], r["t_next"], r["u"], r["u_next"]) for r in out.collect()}
        assert got == {
            ("a", 6, (9.0, 2), (9.0, 1), 9.0, 7.0),
            ("b", 1, (1.0, 9), None, 1.0, None),
            ("c", 2, (2.0, 11), (None, 10), 2.0, None),
            (None, 2, (6.0, 13), (5.0, 12), 6.0, 5.0),
        }
        assert out.count() == df.count()


def test_passk_credits_the_lead_over_the_second_of_another_score(spark, rows):
    lone = rows.filter("sample_id in (0, 1, 6, 7)")
    got = by_id(A.grpo_passk(lone, norm_by_std=False))
    assert got[1] == [2.0, 0.0, 2.0] and got[0] == [0.0, 0.0, 0.0]
    assert got[6] == [0.0, 0.0] and got[7] == [0.0, 0.0]  # the best row of the last pair has no valid token


def test_token_baselines_read_their_rows_three_times(rows):
    """The statistics, the sums per position and the rows, which meet in one join."""
    assert leaves(A.optimal_token_baseline(rows, zero_tail=True)) == 3
    assert leaves(A.tir_optimal_token_baseline(rows)) == 3


def test_running_sums_of_ragged_rows(spark):
    data = [(0, [1.0, 2.0, 3.0]), (1, []), (2, None), (3, [0.1] * 40), (4, [5.0, None, 1.0]), (5, [2.0, 2.0, 2.0]), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame(data, "i long, x array<double>").repartition(1).orderBy("i")
    got = df.select(cumsum("x").alias("up"), reverse_cumsum("x").alias("down")).collect()
    assert [r["up"] for r in got] == [
        [1.0, 3.0, 6.0], [], None, np.cumsum([0.1] * 40).tolist(), [5.0, None, None], [2.0, 4.0, 6.0], [float("inf")] * 2,
    ]
    assert [r["down"] for r in got] == [
        [6.0, 5.0, 3.0], [], None, np.cumsum([0.1] * 40)[::-1].tolist(), [None, None, 1.0], [6.0, 4.0, 2.0], [float("inf"), 1.0],
    ]
