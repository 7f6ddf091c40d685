import math

import numpy as np
import pytest

from trajecta.operators import correction as C
from trajecta.operators import losses as L

SPECS = {
    "token_k1": "0.5_1.5",
    "token_k2": 2.0,
    "token_k3": 2.0,
    "seq_sum_k1": "0.6_1.4",
    "seq_sum_k2": 2.5,
    "seq_sum_k3": 2.5,
    "seq_mean_k1": "0.5_1.5",
    "seq_mean_k2": 2.0,
    "seq_mean_k3": 2.0,
    "seq_max_k2": 2.0,
    "seq_max_k3": 2.0,
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    old = rng.normal(size=(4, 10))
    roll = old + 0.6 * rng.normal(size=(4, 10))
    mask = (rng.random((4, 10)) < 0.8).astype(int)
    mask[3] = 0
    data = [(0, i, mask[i].tolist(), old[i].tolist(), roll[i].tolist()) for i in range(4)]
    df = spark.createDataFrame(
        data, "step long, sample_id long, response_mask array<int>, old_log_probs array<double>, rollout_log_probs array<double>"
    )
    return df, old, roll, mask


@pytest.mark.parametrize("option", list(SPECS))
def test_rejection_mask(rows, option):
    df, old, roll, mask = rows
    th = C.parse_options(option, SPECS[option])
    out = C.rejection_mask(C.with_log_ratio(df), th).select("sample_id", "modified_response_mask").collect()
    lr = np.clip(old - roll, -20, 20)
    stat = {"k1": -lr, "k2": 0.5 * lr**2, "k3": np.exp(lr) - 1 - lr}[option[-2:]]
    spec = SPECS[option]
    low, up = (tuple(math.log(float(x)) for x in spec.split("_")) if isinstance(spec, str) else (-np.inf, spec))
    for row in out:
        i = row["sample_id"]
        m, s = mask[i], stat[i]
        if option.startswith("seq_sum"):
            s = np.full(10, (s * m).sum())
        elif option.startswith("seq_mean"):
            s = np.full(10, (s * m).sum() / (m.sum() + 1e-8))
        elif option.startswith("seq_max"):
            s = np.full(10, s[m > 0].max() if m.any() else 0.0)
        want = m * ((s >= low) & (s <= up))
        assert row["modified_response_mask"] == want.tolist(), option


@pytest.mark.parametrize(
    "options, spec", [("token_k9", 1.0), ("token_k2", "1_2"), ("token_k1", "0_2"), ("token_k1,token_k2", "1,2,3"), ("token_k2", None)]
)
def test_bad_thresholds(options, spec):
    with pytest.raises((ValueError, TypeError)):
        C.parse_options(options, spec)


def test_single_bound_is_mirrored():
    assert C.parse_options("token_k1", 2.0)[0] == C.Threshold("token_k1", 0.5, 2.0)


def test_length_mismatch_raises(spark):
    df = spark.createDataFrame(
        [(0, 0, [1], [0.1], [0.1, 0.2])],
        "step long, sample_id long, response_mask array<int>, old_log_probs array<double>, rollout_log_probs array<double>",
    )
    with pytest.raises(Exception, match="differ in length"):
        C.with_log_ratio(df).collect()


def test_correction_replaces_mask_and_names_metrics(rows):
    df, *_ = rows
    out, metrics = C.rollout_correction(df, "sequence", 2.0, True, "token_k1", "0.5_1.5")
    assert "rollout_is_weights" in out.columns
    names = metrics.columns
    assert "rollout_corr/kl" in names and "rollout_corr/rollout_rs_token_k1_mean" in names
    assert "rollout_corr/rollout_is_batch_norm_factor" in names


def test_covariance_clip_random_choice_is_bounded_and_stable(spark):
    rng = np.random.default_rng(1)
    data = [
        (0, i, 16, [1] * 8, rng.normal(size=8).tolist(), rng.normal(size=8).tolist(), [float(a)] * 8)
        for i, a in enumerate(rng.normal(size=50))
    ]
    df = spark.createDataFrame(
        data,
        "step long, sample_id long, max_response_len int, response_mask array<int>, old_log_probs array<double>, "
        "log_probs array<double>, advantages array<double>",
    )
    one = L.covariance_clip(df, ratio=0.02, low_cov=0.0, high_cov=9.0, seed=4).collect()[0]
    two = L.covariance_clip(df.repartition(5), ratio=0.02, low_cov=0.0, high_cov=9.0, seed=4).collect()[0]
    assert abs(one["pg_clipfrac"] * 400 - 8) < 1e-3
    assert abs(one["pg_loss"] - two["pg_loss"]) < 1e-9
    for mode in L.AGGREGATIONS:
        assert L.covariance_penalty(df, 0.05, mode=mode).collect()[0]["pg_loss"] is not None


def test_agreement_fixture(spark):
    """The published two-row fixture: the row is valid and the measures are finite."""
    roll = [-1.5085, -0.1200, -0.6650, -0.4823, -0.1426, -1.5557, -2.8532, -0.3919, -0.4294, -0.4700]
    old = [-1.8636, -0.7863, -0.2136, -0.4376, -2.0257, -0.2579, -1.1547, -0.5203, -0.3802, -0.9872]
    mask = [1, 0, 0, 0, 1, 1, 0, 1, 1, 0]
    df = spark.createDataFrame(
        [(0, roll, old, mask)], "step long, rollout_log_probs array<double>, old_log_probs array<double>, response_mask array<int>"
    )
    row = C.agreement_metrics(df).collect()[0]
    keep = np.array(mask) > 0
    p, q = np.exp(np.array(roll))[keep], np.exp(np.array(old))[keep]
    assert row["rollout_probs_diff_valid"] == 1
    assert abs(row["rollout_probs_diff_mean"] - np.abs(p - q).mean()) < 1e-12
    assert abs(row["rollout_actor_probs_pearson_corr"] - np.corrcoef(p, q)[0, 1]) < 1e-9


def test_sft_loss_wraps_to_first_row(spark):
    df = spark.createDataFrame(
        [(0, 0, [1, 0], [0.5, 0.25]), (0, 1, [0, 1], [0.125, 2.0])],
        "step long, sample_id long, response_mask array<int>, log_probs array<double>",
    )
    flat_mask, flat_lp = np.array([1, 0, 0, 1]), np.array([0.5, 0.25, 0.125, 2.0])
    want = -(flat_lp * np.roll(flat_mask, -1)).sum() / flat_mask.sum()
    assert abs(L.sft_loss(df).collect()[0]["loss"] - want) < 1e-12


def test_sft_loss_keeps_steps_apart(spark):
    """Two steps, one with an empty response in the middle: each wraps around on its own rows."""
    df = spark.createDataFrame(
        [(0, 0, [1, 1], [1.0, 2.0]), (0, 1, [], []), (0, 2, [0, 1], [4.0, 8.0]), (1, 0, [1], [16.0])],
        "step long, sample_id long, response_mask array<int>, log_probs array<double>",
    )
    got = {r["step"]: r["loss"] for r in L.sft_loss(df, dp_size=2).collect()}
    assert got == {0: -(1.0 + 4.0 + 8.0) / 3 * 2, 1: -16.0 * 2}
