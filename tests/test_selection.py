"""Histogram selection, block-bounded retrieval and the dump index against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from trajecta.operators import grouping as G
from trajecta.operators import losses as L
from trajecta.operators import retrieval as R
from trajecta.sources import io as S


def test_kth_largest(spark):
    """Values of any scale and sign, ties, single values and groups that are too small."""
    rng = random.Random(2)
    groups = {
        "scales": [rng.choice([-1, 1]) * 10 ** rng.uniform(-30, 30) for _ in range(400)],
        "near": [1 + rng.randrange(50) * 2.0**-50 for _ in range(300)],
        "ties": [0.0] * 200 + [1.0] * 100 + [-1.0] * 5,
        "one": [3.5],
        "subnormal": [5e-324, -5e-324, 0.0, 1e-310],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("scales", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.0, 0.03, 0.5, 1.0):
        k = {g: max(1, int(len(values) * share)) for g, values in groups.items()}
        limits = spark.createDataFrame([*k.items(), ("empty", 1)], "g string, k long")
        got = {r.g: (r.kth, r["take"]) for r in G.kth_largest(df, ["g"], "v", limits).collect()}
        for g, values in groups.items():
            kth = sorted(values, reverse=True)[k[g] - 1]
            assert got[g] == (kth, k[g] - sum(v > kth for v in values)), (g, share)
        assert set(got) == set(groups)


def test_covariance_penalty_takes_ties_in_order(spark):
    """Equal covariances: the first tokens by (sample_id, pos) are chosen, whatever the partitioning."""
    rows = [(0, s, [0.0] * 4, [0.1 * (p + 1) + s % 11 / 100 for p in range(4)], [0.0] * 4, [1, 1, 0, 1], 4) for s in (7, 3, 5, 100_000)]
    df = spark.createDataFrame(
        rows, "step long, sample_id long, old_log_probs array<double>, log_probs array<double>, advantages array<double>, response_mask array<int>, max_response_len int"
    )
    tokens = sorted((s, p, abs(r[3][p])) for r in rows for s in [r[1]] for p in (0, 1, 3))
    for ratio in (0.01, 0.25, 0.5, 1.0):
        taken = max(1, math.floor(len(tokens) * ratio))
        want = sum(t[2] for t in tokens[:taken]) / len(tokens)
        for parts in (1, 4):
            got = L.covariance_penalty(df.repartition(parts), ratio=ratio).first()
            assert math.isclose(got.pg_loss, want, rel_tol=1e-12), ratio


def bm25(docs, queries, k1=0.9, b=0.4):
    words = {i: [w for w in R_SPLIT(t) if w] for i, t in docs.items()}
    avg = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    scores = defaultdict(dict)
    for q, text in queries.items():
        for w in set(filter(None, R_SPLIT(text))):
            for i, ws in words.items():
                if w in ws:
                    tf = ws.count(w)
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    scores[q][i] = scores[q].get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / avg))
    return scores


def R_SPLIT(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split(" ")


def test_lexical_blocks_are_exact_and_skipped(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    docs = {i: " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(3, 30))) for i in range(120)}
    queries = {q: " ".join(rng.sample(words, 4)) for q in range(12)} | {50: "nothing here"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    want = bm25(docs, queries)
    for size in (1, 7, 1000):
        got = defaultdict(list)
        for r in R.lexical_top_k(d, q, 5, block_rows=size).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.doc_id, r.score))
        assert set(got) == set(want)
        for query, found in got.items():
            scores = sorted(want[query].values(), reverse=True)[:5]
            assert np.allclose([s for _, s in found], scores, atol=1e-7)
            assert all(math.isclose(want[query][i], s, abs_tol=1e-7) for i, s in found)


def test_dense_blocks_of_queries(spark):
    rng = np.random.default_rng(1)
    docs, asked = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(docs)] + [(1000, None)]
    d = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    for limit in (64, 3 * 64, 1 << 20):
        found = R.dense_top_k(d, q, 4, query_bytes=limit).orderBy("query_id", "rank").collect()
        assert [r.doc_id for r in found] == [int(i) for v in asked for i in np.argsort(-(docs @ v), kind="stable")[:4]]
    assert R.dense_top_k(d, q.limit(0), 4).count() == 0


def test_dump_index_follows_files(spark, tmp_path):
    rows = spark.range(0, 900).select((F.col("id") % 3).alias("step"), F.col("id").alias("sample_id"), F.repeat(F.lit("x9 "), 40).alias("text"))
    S.dump_rollouts(rows.repartitionByRange(4, "sample_id"), str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # several pieces a file
    try:
        back = S.load_rollouts(spark, str(tmp_path), rows.schema, r"\d").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(back) == 900 and back[0].text == "x* " * 40
    for step in range(3):
        mine = [r for r in back if r.step == step]
        assert [r.sample_index for r in mine] == list(range(300))
        # Within a file the order is that of the dump.
        assert sum(a.sample_id > b.sample_id for a, b in zip(mine, mine[1:])) <= 3
