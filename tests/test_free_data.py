"""Free dictionaries, user datasets and generators."""

import pytest
from pyspark.sql import functions as F

from trajecta import hooks as H
from trajecta.sources import io as S
from trajecta.streaming import rollouts as Z

ROWS = {
    1: '{"a":{"b":1,"c":[1,"x",{"d":[]}]},"e":null,"f":{},"g":true,"h":1.5,"w":"q\\"[{"}',
    2: None,
    3: "{bad [[[[",
    4: "7",
    5: "[1,[2]]",
    6: "{}",
    7: '{"a":1,"a":2}',
    8: '{"x":{"y":{"z":{"u":"deep"}}}}',
}
WANT = {
    (1, "a/b", "1"), (1, "a/c/list_len", "3"), (1, "a/c/0", "1"), (1, "a/c/1", "x"), (1, "a/c/2/d/list_len", "0"), (1, "e", None),
    (1, "g", "true"), (1, "h", "1.5"), (1, "w", 'q"[{'), (5, "list_len", "2"), (5, "0", "1"), (5, "1/list_len", "1"), (5, "1/0", "2"),
    (8, "x/y/z/u", "deep"),
}


def test_flatten_free(spark):
    df = spark.createDataFrame(list(ROWS.items()), "k int, j string")
    assert sorted(map(str, S.flatten_free(df, ["k"], "j").collect())) == sorted(
        f"Row(k={k}, name={n!r}, value={v!r})" for k, n, v in WANT
    )
    cut = {r.name: r.value for r in S.flatten_free(df.filter("k = 8"), ["k"], "j", ".", depth=2).collect()}
    assert cut == {"x.y": '{"z":{"u":"deep"}}'}
    assert S.flatten_free(df.limit(0), ["k"], "j").count() == 0


def test_dataset_schema_is_checked(spark):
    H.register_dataset("ids", lambda df, shift=0: df.select((F.col("id") + shift).alias("id"), F.lit("x").alias("more")), "id bigint")
    assert [tuple(r) for r in H.dataset("ids", spark.range(2), shift=5).collect()] == [(5,), (6,)]
    H.register_dataset("texts", lambda df: df, "id string")
    with pytest.raises(TypeError):
        H.dataset("texts", spark.range(2))


class Doubled(H.Generator):
    """One new row per row of the step; its text counts what the dataset held."""

    def generate(self, dataset, batch):
        n = dataset.agg(F.count(F.lit(1)).alias("n"))
        return batch.crossJoin(n).select((F.col("id") + 100).alias("id"), F.repeat(F.lit("w "), F.col("n").cast("int")).alias("prompt"))


def test_generator_sees_earlier_steps_and_repeats_add_nothing(spark, tmp_path):
    for ids in ([0, 1], [2], [3], [4]):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    steps = Z.read_stream(spark, str(tmp_path / "in"), spark.range(1).schema, "*.parquet", files_per_trigger=1)
    start = spark.createDataFrame([(7, "first prompt")], "id long, prompt string")
    keep = F.size(F.split("prompt", " ")) <= 4 + 1  # four words and the blank behind them
    for checkpoint in ("a", "b"):  # the second run repeats every step
        out = H.grown_dataset(steps, start, Doubled(), keep, str(tmp_path / "made"), str(tmp_path / checkpoint)).collect()
        # What the last step makes has five words.
        assert sorted((r.id, r.prompt.strip()) for r in out) == [(7, "first prompt"), *[(100 + i, " ".join("w" * n)) for i, n in enumerate([1, 1, 3, 4])]]
