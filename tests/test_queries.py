"""Registered queries: every one has a stable schema; a sample is compared with its SQL oracle."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = [
    "adv_grpo",
    "adv_gae",
    "adv_tir_optimal_token_baseline",
    "rejection_seq_max_k3",
    "loss_covariance_penalty",
    "validation_metrics",
    "step_data_metrics",
    "metric_interval_derived",
    "batch_pad_to_divisor",
    "balance_imbalance_report",
    "prefix_runs_of_equal",
    "reward_competition",
    "reward_code_hacking_v3",
    "hint_statistics",
    "intervention_sets",
    "faithfulness_divergences",
    "dataset_code_assertions",
    "filter_varied_groups",
    "retrieval_dense_top_k",
    "stream_bounded_buffer_puts",
]


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 250


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["sample_id", "adv_sum", "ret_sum"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(tuple(map(repr, (r[c] for c in cols))) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in cols]
    theirs = sorted(tuple(map(repr, (r[i] for i in order))) for r in rel.fetchall())
    assert ours == theirs
