"""Exact dense and lexical top-k retrieval.

Dense: every task scores the vectors it reads against the queries and keeps k rows per query; the corpus is not moved.
Lexical: an inverted index in blocks of documents with the largest impact of each term in each block; blocks whose
bound lies below a query's k-th score are not scored.  A query's winners are reduced in two levels, and nothing of the
corpus passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .grouping import seeded_digest

TERM = r"[^\p{L}\p{N}]+"
QUERY_BYTES = 64 << 20  # of query vectors that are sent to every task at once
CELLS = 4 << 20  # scores held at once


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by document id."""
    if len(scores) > k:
        floor = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _reduce(parts: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id")]
    coarse = Window.partitionBy("query_id", F.col("db") % 256).orderBy(*order)
    fine = Window.partitionBy("query_id").orderBy(*order)
    near = parts.withColumn("r", F.row_number().over(coarse)).filter(F.col("r") <= k)
    return near.withColumn("rank", F.row_number().over(fine)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


SCHEMA = "query_id long, doc_id long, score double, db long"


class TopK:
    """The k best (score, document) of some queries, mergeable piece by piece; ties by document id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]
        self.scores = [np.zeros(0) for _ in range(queries)]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """`scores` has a row per document and a column per query."""
        floors = np.array([s[-1] if len(s) == self.k else -np.inf for s in self.scores])
        for j in np.flatnonzero((scores >= floors).any(0)):
            all_ids, all_scores = np.concatenate((self.ids[j], ids)), np.concatenate((self.scores[j], scores[:, j]))
            best = _best(all_ids, all_scores, self.k)
            self.ids[j], self.scores[j] = all_ids[best], all_scores[best]


def _query_blocks(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the query vectors, at most `most` bytes at once; cut by a sort of the ids where there are more."""
    sized = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n, width = sized.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n * (width or 0) * 8 // most))
    for block in range(blocks):
        part = sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.orderBy("query_id").collect()  # `most` bytes
        if rows:
            yield np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def dense_top_k(docs: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(doc_id, embedding) against (query_id, embedding) by inner product.

    The query vectors are counted first and sent to all tasks, in blocks of at most `query_bytes`; a task multiplies
    them with the vectors it reads, CELLS scores at a time, and returns k rows per query and partition.  No vector of
    the corpus is shuffled: what moves is k small rows a query and task.  With several blocks the corpus is read once a
    block.  Null vectors have no score.
    """
    rows = docs.filter(F.col("embedding").isNotNull()).select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    parts = None
    for ids, matrix in _query_blocks(queries, query_bytes):
        found = _scored_where_read(rows, ids, matrix, k)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = docs.sparkSession.createDataFrame([], SCHEMA)
    return _reduce(parts, k)


def _scored_where_read(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))  # the caller has checked its size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vectors = shared.value
        top, step = TopK(len(asked), k), max(1, CELLS // len(asked))
        for batch in batches:
            numbers, values = batch.column(0).to_numpy(), batch.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1)
            for at in range(0, len(numbers), step):
                top.add(numbers[at : at + step], flat[at : at + step] @ vectors.T)
        count = [len(i) for i in top.ids]
        found = np.concatenate(top.ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(asked, count)), pa.array(found), pa.array(np.concatenate(top.scores)), pa.array(found)],
            names=["query_id", "doc_id", "score", "db"],
        )

    return rows.mapInArrow(score, SCHEMA)


def terms(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda t: t != "")


BLOCK_ROWS = 256  # documents in a block of the index
SEEDS = 2  # blocks scored first, for a lower bound of the k-th score
SCALE = float(1 << 32)  # scores are added as whole numbers, so that no order of the additions matters


def lexical_index(docs: DataFrame, only: DataFrame | None = None, k1: float = 0.9, b: float = 0.4, block_rows: int = BLOCK_ROWS):
    """(index, statistics) for BM25 over (doc_id, text).

    index: block, term, top, posts, an array of (doc_id, gain), where `gain` is the part of a document's score that
    does not depend on other documents and `top` the largest of the block.  statistics: term, idf.  `only` restricts the
    index to some terms.  Documents are dealt to blocks of about `block_rows` by the hash of their id.
    """
    d = docs.select("doc_id", terms("text").alias("t")).withColumn("dl", F.size("t"))
    # One pass over the texts for both.
    size = d.select(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).alias("s")).scalar()
    n, avgdl = size["n"], size["avgdl"]
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(n / F.lit(block_rows)))
    posts = d.select(block.alias("block"), "doc_id", "dl", F.explode("t").alias("term"))
    if only is not None:
        posts = posts.join(only.select("term").distinct(), "term", "left_semi")
    # Dealt by block, the words move once for both groupings.
    posts = posts.repartition("block").groupBy("block", "doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / avgdl)
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    listed = posts.select("block", "term", F.struct("doc_id", gain.alias("gain")).alias("p"))
    index = staged(listed.groupBy("block", "term").agg(F.max("p.gain").alias("top"), F.collect_list("p").alias("posts")))
    df = index.groupBy("term").agg(F.sum(F.size("posts")).alias("df"))
    return index, df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _score_blocks(index: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all documents in the given (query_id, block).

    An index dealt by block has all terms of a document in one task, where its score is added up: what moves is then the
    index, not every (query, term, document).
    """
    wanted = blocks.groupBy("block").agg(F.collect_set("query_id").alias("asked_by"))
    lists = index.select("block", "term", "posts").join(wanted, "block").join(asked, "term")
    rows = lists.filter(F.array_contains("asked_by", F.col("query_id"))).select("block", "query_id", "idf", F.explode("posts").alias("p"))
    points = F.sum((F.col("idf") * F.col("p.gain") * SCALE).cast("long"))
    scores = rows.groupBy("block", "query_id", F.col("p.doc_id").alias("doc_id")).agg((points / SCALE).alias("score"))
    return scores.drop("block")


def lexical_top_k(docs: DataFrame, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, text) against (query_id, text) by BM25; documents sharing no term with a query are not returned.

    A block cannot hold a score above the sum of its terms' largest impacts.  The SEEDS blocks of highest bound are
    scored first; their k-th score is a lower bound of the query's k-th.  Of the other blocks only those whose bound
    reaches it are scored, so the result is exact.  Texts stay where they are read.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term"))
    index, idf = lexical_index(docs, q, k1, b, block_rows)
    asked = staged(q.join(idf, "term"))
    # A thousandth of a point more than the bound covers the rounding of the terms.
    bound = (F.sum(F.col("idf") * F.col("top")) + 1e-3).alias("bound")
    bounds = staged(index.select("block", "term", "top").join(asked, "term").groupBy("query_id", "block").agg(bound))
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    ranked = bounds.withColumn("r", F.row_number().over(order))
    seeds = staged(_score_blocks(index, asked, ranked.filter(F.col("r") <= SEEDS).select("query_id", "block")))
    best = _reduce(seeds.withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(256))), k)
    floor = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    open_blocks = ranked.filter(F.col("r") > SEEDS).join(floor, "query_id", "left")
    open_blocks = open_blocks.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("query_id", "block")
    rest = _score_blocks(index.repartition("block"), asked, open_blocks).withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(256)))
    near = best.select("query_id", "doc_id", "score").withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(256)))
    return _reduce(near.unionByName(rest), k)


def with_contents(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Look up the text of the hits; the hit table is the small side and the optimiser may broadcast it."""
    return hits.join(corpus.select("doc_id", F.col("text").alias("contents")), "doc_id")


def formatted(hits: DataFrame) -> DataFrame:
    """Per query the passages as one text (k of them at most) and a status."""
    title = F.substring_index("contents", "\n", 1)
    body = F.when(F.instr("contents", "\n") > 0, F.expr("substring(contents, instr(contents, '\n') + 1)")).otherwise("")
    one = F.concat(F.lit("Doc "), "rank", F.lit(" (Title: "), title, F.lit(")\n"), body, F.lit("\n\n"))
    out = hits.withColumn("p", one).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "p"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: p["p"]), "")
    return out.select("query_id", F.regexp_replace(text, r"^\s+|\s+$", "").alias("result"), F.size("ps").alias("total_results"))


def with_status(queries: DataFrame, results: DataFrame) -> DataFrame:
    rows = queries.select("query_id").join(results, "query_id", "left")
    return rows.select(
        "query_id",
        F.coalesce("result", F.lit("No search results found.")).alias("result"),
        F.coalesce("total_results", F.lit(0)).alias("total_results"),
        F.when(F.col("result").isNull(), "no_results").otherwise("success").alias("status"),
    )


def validation_samples(df: DataFrame, n: int, text: str = "input", seed: int = 42) -> DataFrame:
    """n rows for inspection, chosen by seeded digest of the text so that the choice ignores row order."""
    return df.orderBy(seeded_digest(seed, text), text).limit(n)
