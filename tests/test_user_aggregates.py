"""User aggregates whose states are merged: a hot group, null keys and values, many groups a task."""

import numpy as np
import pytest

from trajecta import hooks as H


@pytest.mark.parametrize("held", [100_000, 3])
def test_merged_reduce(spark, monkeypatch, held):
    monkeypatch.setattr(H, "HELD", held)
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(1e6, 1, 3000)] + [(f"g{i % 40}", float(i)) for i in range(400)]
    rows += [(None, 2.0), (None, 4.0), ("nulls", None), ("g1", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(9)
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([] if v is None else [v])
    for variance, plain in ((True, np.var), (False, np.mean)):
        got = {r.k: r.out for r in H.merged_reduce(df, "k", "v", H.Moments(variance), "out").collect()}
        assert set(got) == set(groups) and got["nulls"] is None
        assert all(np.isclose(got[k], plain(v), rtol=1e-9) for k, v in groups.items() if v)
    numbers = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 5.0)], "k long, v double")
    assert {r.k: r.out for r in H.merged_reduce(numbers, "k", "v", H.Moments(False), "out").collect()} == {1: 2.5, None: 5.0}
    assert H.merged_reduce(df.limit(0), "k", "v", H.Moments(), "out").count() == 0
