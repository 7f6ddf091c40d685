"""Scores of a block are added up where its part of the index lies."""

from trajecta.operators import retrieval as R


def test_scores_are_added_up_where_the_block_lies(spark):
    entries = [(0, "a", [(1, 0.5), (2, 0.25)]), (0, "b", [(2, 1.0)]), (1, "a", [(3, 0.75)]), (2, "b", [(4, 0.5)])]
    index = spark.createDataFrame(entries, "block long, term string, posts array<struct<doc_id long, gain double>>")
    asked = spark.createDataFrame([(7, "a", 2.0), (7, "b", 1.0), (8, "a", 4.0)], "query_id long, term string, idf double")
    blocks = spark.createDataFrame([(7, 0), (7, 2), (8, 1), (None, 1)], "query_id long, block long")
    scores = R._score_blocks(index.repartition("block"), asked, blocks)
    assert "hashpartitioning(query_id" not in scores._jdf.queryExecution().executedPlan().toString()
    found = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
    assert found == {(7, 1): 1.0, (7, 2): 1.5, (7, 4): 0.5, (8, 3): 3.0}


def test_a_document_given_twice_counts_its_words_twice(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, "x"), (None, "y"), (3, None)], "doc_id long, text string")
    index, _ = R.lexical_index(docs)
    gains = {(r.term, r.p.doc_id): r.p.gain for r in index.selectExpr("term", "explode(posts) p").collect()}
    assert set(gains) == {("x", 1), ("y", 1), ("x", 2), ("y", None)}
    assert gains["x", 1] == gains["y", 1] > 1
