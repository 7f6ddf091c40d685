"""Appends that are repeated or die half-way are read once."""

import pytest
from pyspark.sql import functions as F

from trajecta.sources import io as S


def test_append_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    rows = spark.range(20).select(F.col("id").alias("step"), F.create_map(F.lit("a"), F.col("id").cast("double")).alias("data"))
    first, second = rows.filter("step < 12"), rows.filter("step >= 12")
    assert S.committed(spark, path, S.METRICS).count() == 0
    assert S.append_once(first, path, "b1") and not S.append_once(first, path, "b1")

    # The rows are written, but the attempt ends before its commit.
    place = S._place

    def dies(session, at):
        if f"/{S.COMMITS}/." in at:
            raise KeyboardInterrupt
        return place(session, at)

    monkeypatch.setattr(S, "_place", dies)
    with pytest.raises(KeyboardInterrupt):
        S.append_once(second, path, "b2")
    monkeypatch.undo()
    assert S.committed(spark, path, S.METRICS).count() == 12
    S.append_metrics(second, path, "b2")
    S.append_metrics(second, path, "b2")
    got = S.load_metrics(spark, path).collect()
    assert sorted((r.step, r.value) for r in got) == [(i, float(i)) for i in range(20)]
    plain = str(tmp_path / "plain")
    S.append_metrics(first, plain)
    assert S.load_metrics(spark, plain).count() == 12
