"""Batch algebra, joins, sources, balancing and sequence-shaping queries."""

import uuid

from pyspark.sql import functions as F

from ..derive import SAMPLES_SQL, TOKENS_SQL, response_sizes, table, trajectories
from ..functions.arrays import asum, mask_count
from ..operators import balance as B
from ..operators import container as C
from ..operators import sequences as X
from ..operators.grouping import with_rank
from ..session import checkpoint_root
from ..sources import io as S
from .registry import query, rnd, sq


def batch(spark, sf, *cols):
    keep = ["o_orderkey", *cols]
    return C.indexed(table(spark, sf, "orders").select(*keep), "o_orderkey")


B_SQL = "b AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, count(*) OVER () AS n FROM orders)"


@query("batch_select_keys", "SELECT o_orderkey, o_orderstatus FROM orders")
def batch_select_keys(spark, sf):
    return C.select_keys(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])


@query("batch_select_mask", f"WITH {B_SQL} SELECT row_idx, o_orderkey FROM b WHERE o_orderstatus = 'F'")
def batch_select_mask(spark, sf):
    return C.select_mask(batch(spark, sf, "o_orderstatus"), F.col("o_orderstatus") == "F").select("row_idx", "o_orderkey")


@query(
    "batch_select_indices",
    f"WITH {B_SQL}, p AS (SELECT row_idx AS pos, n - 1 - (row_idx // 2) AS pick FROM b) "
    "SELECT p.pos AS row_idx, b.o_orderkey FROM p JOIN b ON b.row_idx = p.pick",
)
def batch_select_indices(spark, sf):
    rows = batch(spark, sf)
    picks = rows.select(F.col("row_idx").alias("pos"), (C.total(rows) - 1 - F.floor(F.col("row_idx") / 2)).alias("row_idx"))
    return C.select_indices(rows, picks).select("row_idx", "o_orderkey")


@query("batch_slice", f"WITH {B_SQL} SELECT row_idx, o_orderkey FROM b WHERE row_idx >= 10 AND row_idx < n - 5 AND (row_idx - 10) % 3 = 0")
def batch_slice(spark, sf):
    return C.slice_rows(batch(spark, sf), 10, -5, 3).select("row_idx", "o_orderkey")


@query("batch_pop", f"WITH {B_SQL} SELECT row_idx, o_custkey, o_orderstatus FROM b")
def batch_pop(spark, sf):
    popped, rest = C.pop(batch(spark, sf, "o_custkey", "o_orderstatus"), ["o_orderstatus"])
    return rest.join(popped, "row_idx").select("row_idx", "o_custkey", "o_orderstatus")


@query("batch_rename", "SELECT o_orderkey AS sample_id, o_custkey AS uid FROM orders")
def batch_rename(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return C.rename(rows, ["o_orderkey", "o_custkey"], ["sample_id", "uid"])


@query("batch_union_columns", f"SELECT o_orderkey, o_custkey, o_orderstatus, {sq('o_totalprice', 2)} AS price FROM orders")
def batch_union_columns(spark, sf):
    o = table(spark, sf, "orders")
    left, right = o.select("o_orderkey", "o_custkey", "o_orderstatus"), o.select("o_orderkey", "o_custkey", "o_totalprice")
    out = C.union_columns(left, right, ["o_orderkey"])
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", rnd("o_totalprice", 2).alias("price"))


@query("batch_concat", "SELECT o_orderkey, o_custkey FROM orders")
def batch_concat(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return C.concat([o.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]).select("o_orderkey", "o_custkey")


@query(
    "batch_meta_merge",
    """WITH m AS (SELECT DISTINCT o_orderpriority AS v FROM orders)
    SELECT 'metrics' AS key, string_agg(v, '|' ORDER BY v) AS merged FROM m UNION ALL SELECT 'table', 'orders'""",
)
def batch_meta_merge(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority")
    metas = o.select(F.lit("metrics").alias("key"), F.col("o_orderpriority").alias("value")).unionByName(
        o.select(F.lit("table").alias("key"), F.lit("orders").alias("value"))
    )
    return C.merged_meta(metas).select("key", F.array_join("values", "|").alias("merged"))


@query("batch_chunk", f"WITH {B_SQL} SELECT row_idx, row_idx * 5 // n AS chunk_id FROM b")
def batch_chunk(spark, sf):
    return C.chunk(batch(spark, sf), 5).select("row_idx", "chunk_id")


@query("batch_split", f"WITH {B_SQL} SELECT row_idx, row_idx // 700 AS split_id FROM b")
def batch_split(spark, sf):
    return C.split(batch(spark, sf), 700).select("row_idx", "split_id")


@query(
    "batch_reorder",
    f"WITH {B_SQL}, p AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_orderkey FROM b) SELECT pos AS row_idx, o_orderkey FROM p",
)
def batch_reorder(spark, sf):
    rows = batch(spark, sf, "o_totalprice")
    order = with_rank(rows, F.floor(F.col("o_totalprice") / 1000), [F.col("o_totalprice"), F.col("o_orderkey")], "pos")
    return C.reorder(rows, order.select("pos", "row_idx")).select("row_idx", "o_orderkey")


@query(
    "batch_repeat",
    f"""WITH {B_SQL}, r AS (SELECT *, unnest([0,1,2]) AS r FROM b)
    SELECT 'interleaved' AS layout, row_idx*3 + r AS row_idx, o_orderkey FROM r UNION ALL SELECT 'tiled', r*n + row_idx, o_orderkey FROM r""",
)
def batch_repeat(spark, sf):
    rows = batch(spark, sf)
    a = C.repeat(rows, 3).select(F.lit("interleaved").alias("layout"), "row_idx", "o_orderkey")
    return a.unionByName(C.repeat(rows, 3, interleave=False).select(F.lit("tiled").alias("layout"), "row_idx", "o_orderkey"))


@query(
    "batch_unfold_chunks",
    f"""WITH {TOKENS_SQL}, x AS (SELECT sample_id, pos, len, val FROM t), w AS (SELECT *, len // 3 AS w FROM x)
    SELECT sample_id * 3 + pos // w AS row_idx, {sq("sum(val)")} AS total FROM w WHERE w > 0 AND pos < 3*w GROUP BY ALL
    UNION ALL SELECT DISTINCT sample_id * 3 + unnest([0,1,2]), 0.0::DOUBLE FROM w WHERE w = 0""",
)
def batch_unfold_chunks(spark, sf):
    rows = trajectories(spark, sf).select(F.col("sample_id").alias("row_idx"), "values")
    return C.unfold_column_chunks(rows, 3, ["values"]).select("row_idx", rnd(asum("values")).alias("total"))


@query(
    "batch_sample_level_repeat",
    "WITH r AS (SELECT o_orderkey, unnest(range(o_custkey % 4)) AS copy FROM orders) SELECT o_orderkey, CAST(copy AS INTEGER) AS copy FROM r",
)
def batch_sample_level_repeat(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return C.sample_level_repeat(rows, F.col("o_custkey") % 4).select("o_orderkey", "copy")


@query(
    "batch_pad_to_divisor",
    f"""WITH {B_SQL} SELECT row_idx, o_orderkey, false AS is_pad FROM b
    UNION ALL SELECT n + row_idx, o_orderkey, true FROM b WHERE row_idx < (1024 - n % 1024) % 1024""",
)
def batch_pad_to_divisor(spark, sf):
    return C.pad_to_divisor(batch(spark, sf), 1024).select("row_idx", "o_orderkey", "is_pad")


@query("batch_unpad", f"WITH {B_SQL} SELECT row_idx, o_orderkey FROM b")
def batch_unpad(spark, sf):
    return C.unpad(C.pad_to_divisor(batch(spark, sf), 1024)).select("row_idx", "o_orderkey")


@query(
    "batch_padding",
    f"WITH {B_SQL} SELECT row_idx, o_orderkey FROM b UNION ALL SELECT n + unnest(range(4)), o_orderkey FROM b WHERE row_idx = n - 1",
)
def batch_padding(spark, sf):
    return C.padding(batch(spark, sf), 4, "last").select("row_idx", "o_orderkey")


@query(
    "batch_fold",
    f"WITH {B_SQL} SELECT row_idx // 4 AS fold_idx, string_agg(o_orderstatus, '' ORDER BY row_idx) AS statuses FROM b GROUP BY ALL",
)
def batch_fold(spark, sf):
    out = C.fold(batch(spark, sf, "o_orderstatus"), 4, ["o_orderstatus"])
    return out.select("fold_idx", F.array_join("o_orderstatus", "").alias("statuses"))


@query("batch_unfold", f"WITH {B_SQL} SELECT row_idx // 4 AS fold_idx, CAST(row_idx % 4 AS INTEGER) AS pos, o_orderstatus FROM b")
def batch_unfold(spark, sf):
    return C.unfold(C.fold(batch(spark, sf, "o_orderstatus"), 4, ["o_orderstatus"]), ["o_orderstatus"])


@query("batch_mini_batches")
def batch_mini_batches(spark, sf):
    return C.mini_batches(batch(spark, sf), 30, epochs=2, seed=5).select("epoch", "row_idx", "epoch_pos", "mini_batch_id")


@query(
    "batch_mini_batch_sizes",
    f"WITH {B_SQL} SELECT unnest([0,1]) AS epoch, g AS mini_batch_id, CAST(30 AS BIGINT) AS n FROM (SELECT DISTINCT row_idx // 30 AS g FROM b)",
)
def batch_mini_batch_sizes(spark, sf):
    rows = C.mini_batches(batch(spark, sf), 30, epochs=2, seed=5)
    return rows.groupBy("epoch", "mini_batch_id").agg(F.count_distinct("row_idx").alias("n"))


@query(
    "batch_rows_to_columns",
    "SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
)
def batch_rows_to_columns(spark, sf):
    out = messages(spark, sf).select("conv_id", *C.rows_to_columns("messages", ["role", "content"]))
    chars = F.aggregate("content", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return out.select("conv_id", F.array_join("role", "|").alias("roles"), chars.alias("chars"))


@query(
    "batch_columns_to_rows",
    "SELECT conv_id, CAST(turn AS INTEGER) AS pos, role, text AS content FROM conversations",
)
def batch_columns_to_rows(spark, sf):
    cols = messages(spark, sf).select("conv_id", *C.rows_to_columns("messages", ["role", "content"]))
    out = cols.select("conv_id", F.posexplode(C.columns_to_rows(["role", "content"])).alias("pos", "t"))
    return out.select("conv_id", "pos", "t.role", "t.content")


@query("batch_row_uid", "SELECT o_orderkey, sha256(o_custkey || chr(1) || o_orderkey) AS uid FROM orders")
def batch_row_uid(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.row_uid(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("uid"))


@query(
    "partition_coverage_check",
    "SELECT o_orderkey AS key, CAST(2 AS BIGINT) AS times FROM orders WHERE o_orderstatus = 'P'",
)
def partition_coverage_check(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    twice = o.select("key").unionByName(o.filter("o_orderstatus = 'P'").select("key"))
    return C.coverage(twice, o, "key")


def messages(spark, sf):
    turns = table(spark, sf, "conversations")
    items = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(items.alias("m")).select(
        "conv_id", F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")
    )


# --- joins ------------------------------------------------------------------------------------------------------


@query(
    "join_aligned_outputs",
    f"WITH {TOKENS_SQL} SELECT step, sample_id, {sq('sum(old_lp)')} AS old_sum, {sq('sum(ref_lp)')} AS ref_sum, {sq('sum(val)')} AS val_sum FROM t GROUP BY step, sample_id",
)
def join_aligned_outputs(spark, sf):
    rows, key = trajectories(spark, sf), ["step", "sample_id"]
    out = rows.select(*key, "response_mask", "old_log_probs")
    for extra in ("ref_log_prob", "values"):
        out = C.union_columns(out, rows.select(*key, "response_mask", extra), key)
    return out.select(
        *key, rnd(asum("old_log_probs")).alias("old_sum"), rnd(asum("ref_log_prob")).alias("ref_sum"), rnd(asum("values")).alias("val_sum")
    )


@query(
    "join_prompt_text",
    "SELECT o_orderkey AS sample_id, c_name AS prompt, c_mktsegment AS data_source FROM orders JOIN customer ON o_custkey = c_custkey",
)
def join_prompt_text(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("sample_id"), F.col("c_name").alias("prompt"), F.col("c_mktsegment").alias("data_source")
    )


@query(
    "join_model_metric_tables",
    f"""WITH a AS (SELECT o_custkey AS sample_id, 'price' AS metric, avg(sqrt(o_totalprice)) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
    b AS (SELECT o_custkey AS sample_id, 'price' AS metric, avg(sqrt(o_totalprice)) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
    SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, 'price' AS metric, {sq("a.v", 3)} AS generating, {sq("b.v", 3)} AS reference
    FROM a FULL JOIN b USING (sample_id, metric)""",
)
def join_model_metric_tables(spark, sf):
    o = table(spark, sf, "orders")

    def side(status, name):
        rows = o.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("sample_id"))
        return rows.agg(rnd(F.avg(F.sqrt("o_totalprice")), 3).alias(name)).withColumn("metric", F.lit("price"))

    return side("F", "generating").join(side("O", "reference"), ["sample_id", "metric"], "full_outer")


@query(
    "join_resume_remaining",
    "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def join_resume_remaining(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    left = S.remaining(docs, table(spark, sf, "labels"), "doc_id")
    return left.select("doc_id", F.length("text").cast("long").alias("n"))


@query(
    "union_of_datasets",
    "SELECT doc_id AS id, text, source FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark",
)
def union_of_datasets(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return d.unionByName(b, allowMissingColumns=True)


# --- sources ----------------------------------------------------------------------------------------------------


@query("source_read_datasets", "SELECT doc_id, text, quality FROM (SELECT doc_id, text, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels)")
def source_read_datasets(spark, sf):
    both = S.read_datasets(spark, [f"{sf}/documents.parquet"])
    return C.concat(
        [
            both.select("doc_id", "text", F.lit(None).cast("int").alias("quality")),
            S.read_datasets(spark, [f"{sf}/labels.parquet"]).select("doc_id", F.lit(None).cast("string").alias("text"), F.col("quality").cast("int").alias("quality")),
        ]
    )


@query("source_cap_first", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def source_cap_first(spark, sf):
    return S.cap_rows(table(spark, sf, "documents").select("doc_id"), 50, "doc_id")


@query("source_cap_random", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 50)")
def source_cap_random(spark, sf):
    return S.cap_rows(table(spark, sf, "documents").select("doc_id"), 50, "doc_id", shuffle=True, seed=11)


@query(
    "source_sft_rows",
    "SELECT string_split(text, chr(10))[1] AS prompt, text AS response FROM documents",
)
def source_sft_rows(spark, sf):
    nested = table(spark, sf, "documents").select(
        F.struct(F.struct(F.get(F.split("text", "\n"), F.lit(0)).alias("q")).alias("input")).alias("row"), "text"
    )
    return S.sft_rows(nested, "row.input.q", "text")


@query(
    "source_preference_rows",
    "SELECT a.text AS prompt, b.text AS chosen, c.text AS rejected FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 "
    "LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = 3 WHERE a.turn = 0",
)
def source_preference_rows(spark, sf):
    rows = messages(spark, sf)
    at = [F.get(F.col("messages"), F.lit(i))["content"] for i in (0, 1, 3)]
    return S.preference_rows(rows.select(at[0].alias("prompt"), at[1].alias("chosen"), at[2].alias("rejected")))


def rollout_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        (F.col("doc_id") % 4).alias("step"),
        F.col("doc_id").alias("sample_id"),
        F.col("source").alias("input"),
        F.col("text").alias("output"),
        (F.length("text") % 7).cast("double").alias("score"),
    )


@query(
    "source_rollout_dump_load",
    "SELECT doc_id % 4 AS step, doc_id AS sample_id, regexp_replace(source, '[0-9]+', '*', 'g') AS input, regexp_replace(text, '[0-9]+', '*', 'g') AS output, CAST(length(text) % 7 AS DOUBLE) AS score FROM documents",
)
def source_rollout_dump_load(spark, sf):
    path = f"{checkpoint_root(spark)}/rollouts-{uuid.uuid4().hex}"
    rows = rollout_text(spark, sf)
    S.dump_rollouts(rows, path)
    return S.load_rollouts(spark, path, rows.schema, r"\d+").select("step", "sample_id", "input", "output", "score")


@query(
    "source_rollout_search",
    "SELECT doc_id % 4 AS step, doc_id AS sample_id FROM documents WHERE contains(source, 'tion') OR contains(text, 'tion')",
)
def source_rollout_search(spark, sf):
    return S.search_rollouts(rollout_text(spark, sf), "tion").select("step", "sample_id")


@query(
    "source_rollout_order",
    "SELECT doc_id % 4 AS step, doc_id AS sample_id, CAST(length(text) % 7 AS DOUBLE) AS score FROM documents ORDER BY 1, 3 DESC, 2",
)
def source_rollout_order(spark, sf):
    return S.order_rollouts(rollout_text(spark, sf)).select("step", "sample_id", "score")


@query(
    "source_metric_log_roundtrip",
    f"SELECT o_custkey AS step, 'price/' || o_orderstatus AS key, {sq('max(o_totalprice)', 2)} AS value FROM orders GROUP BY ALL",
)
def source_metric_log(spark, sf):
    path = f"{checkpoint_root(spark)}/metrics-{uuid.uuid4().hex}"
    one = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("step"), "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    data = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("price/"), "o_orderstatus"), "v")))
    logged = one.groupBy("step").agg(data.alias("data"))
    # The second append of a batch, as after a retry, adds nothing.
    for part, batch in ((0, "even"), (1, "odd"), (0, "even")):
        S.append_metrics(logged.filter(F.pmod("step", F.lit(2)) == part), path, batch)
    return S.load_metrics(spark, path).select("step", "key", rnd("value", 2).alias("value"))


@query(
    "source_flatten_nested",
    """WITH x AS (SELECT doc_id, source, string_split(lang, '') AS letters FROM documents)
    SELECT doc_id, 'meta/source' AS name, source AS value FROM x UNION ALL
    SELECT doc_id, 'meta/letters/list_len', CAST(len(letters) AS VARCHAR) FROM x UNION ALL
    SELECT doc_id, 'meta/letters/' || (i - 1), letters[i] FROM x, LATERAL (SELECT unnest(range(1, len(letters) + 1)) AS i)""",
)
def source_flatten_nested(spark, sf):
    d = table(spark, sf, "documents")
    nested = d.select("doc_id", F.struct("source", F.filter(F.split("lang", ""), lambda c: c != "").alias("letters")).alias("meta"))
    return S.flatten_nested(nested, ["doc_id"])


@query(
    "source_flatten_free",
    """SELECT doc_id, 'source' AS name, source AS value FROM documents UNION ALL
    SELECT doc_id, 'by_' || coalesce(lang, 'none') || '/n', CAST(doc_id AS VARCHAR) FROM documents UNION ALL
    SELECT doc_id, 'by_' || coalesce(lang, 'none') || '/tags/list_len', '2' FROM documents UNION ALL
    SELECT doc_id, 'by_' || coalesce(lang, 'none') || '/tags/0', 'a "b" [c' FROM documents UNION ALL
    SELECT doc_id, 'by_' || coalesce(lang, 'none') || '/tags/1/k' || (doc_id % 7) || '/deep', 'true' FROM documents WHERE doc_id % 3 > 0 UNION ALL
    SELECT doc_id, 'by_' || coalesce(lang, 'none') || '/tags/1', NULL FROM documents WHERE doc_id % 3 = 0""",
)
def source_flatten_free(spark, sf):
    """Dictionaries whose names differ from row to row, in lists and in each other."""
    n = F.col("doc_id").cast("string")
    deep = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit('{"k'), (F.col("doc_id") % 7).cast("string"), F.lit('":{"deep":true}}'))).otherwise("null")
    source = F.substring(F.to_json(F.array("source")), F.lit(2), F.length(F.to_json(F.array("source"))) - 2)
    text = F.concat(
        F.lit('{"source":'), source, F.lit(',"by_'), F.coalesce("lang", F.lit("none")), F.lit('":{"n":'), n,
        F.lit(',"tags":["a \\"b\\" [c",'), deep, F.lit("]}}"),
    )
    return S.flatten_free(table(spark, sf, "documents").select("doc_id", text.alias("params")), ["doc_id"], "params")


@query(
    "source_eval_collector",
    f"SELECT r_name AS model, r_regionkey * 10 AS step, {sq('avg(c_acctbal)', 2)} AS acc FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey * 10 <= 30 GROUP BY ALL",
)
def source_eval_collector(spark, sf):
    """Writes one result file per model and checkpoint, then collects them."""
    root = f"{checkpoint_root(spark)}/eval-{uuid.uuid4().hex}"
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    stats = (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .groupBy("r_name", "r_regionkey")
        .agg(F.avg("c_acctbal").alias("acc"))
        .select(F.struct("acc").alias("statistics"), F.col("r_name").alias("model"), (F.col("r_regionkey") * 10).alias("checkpoint"))
    )
    stats.write.partitionBy("model", "checkpoint").json(root)
    found = S.load_eval_statistics(spark, root, ["acc"], max_checkpoint=30)
    return found.select("model", "step", rnd("acc", 2).alias("acc"))


@query(
    "source_execution_cache",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
)
def source_execution_cache(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "timeout").otherwise("ok").alias("status"))
    return S.remaining(o.select("o_orderkey"), S.cacheable(o), "o_orderkey")


@query(
    "source_rollout_cache",
    "SELECT o_orderkey, o_orderpriority AS exp FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 AND o_custkey % 3 = 1",
)
def source_rollout_cache(spark, sf):
    path = f"{checkpoint_root(spark)}/cache-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("exp"),
        (F.col("o_custkey") % 2).cast("int").alias("gbs"),
        (F.col("o_custkey") % 3).cast("int").alias("n"),
    )
    S.write_rollout_cache(o, path)
    return S.read_rollout_cache(spark, path, "1-URGENT", 0, 1).select("o_orderkey", "exp")


# --- balancing ---------------------------------------------------------------------------------------------------


def lengths(spark, sf):
    """(step, row_idx, uid, length): customers are prompts, the line count and priority make the length."""
    rows = response_sizes(spark, sf)
    return rows.select(
        "step",
        F.col("sample_id").alias("row_idx"),
        "uid",
        (F.col("response_size") * 37 + F.col("prompt_len")).cast("long").alias("length"),
    )


L_SQL = f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}, l AS (SELECT step, sample_id AS row_idx, uid, len*37 + prompt_len AS length FROM smp)"""


@query("balance_workload", f"{L_SQL} SELECT step, CAST(sum(24576*length + length*length) AS BIGINT) AS work FROM l GROUP BY step")
def balance_workload(spark, sf):
    return lengths(spark, sf).groupBy("step").agg(F.sum(B.workload(F.col("length"))).alias("work"))


def _items(spark, sf, k=4):
    return lengths(spark, sf).select("step", F.col("row_idx").alias("item_id"), B.workload(F.col("length")).alias("work"), F.lit(k).alias("k"))


@query(
    "balance_serpentine",
    f"""{L_SQL}, r AS (SELECT step, row_idx, row_number() OVER (PARTITION BY step ORDER BY length DESC, row_idx) - 1 AS r FROM l)
    SELECT step, row_idx AS item_id, CAST(CASE WHEN (r // 4) % 2 = 0 THEN r % 4 ELSE 3 - r % 4 END AS INTEGER) AS part FROM r""",
)
def balance_serpentine(spark, sf):
    return B.balanced_partitions(_items(spark, sf), ["step"], "serpentine", equal=False)


@query("balance_differencing")
def balance_differencing(spark, sf):
    return B.balanced_partitions(_items(spark, sf), ["step"], "differencing", equal=False)


@query("balance_greedy")
def balance_greedy(spark, sf):
    return B.balanced_partitions(_items(spark, sf), ["step"], "greedy", equal=False)


# Per step: rows seen, each item once, every partition used, largest gap between partition sizes, and whether the
# loads lie no further apart than the heaviest item (which holds for both rules).
_PROPERTIES_SQL = (
    f"{L_SQL} SELECT step, count(*) AS n, count(*) AS items, CAST(least(count(*), 4) AS BIGINT) AS parts, true AS close FROM l GROUP BY step"
)


def _properties(spark, sf, algorithm):
    items = _items(spark, sf)
    placed = B.balanced_partitions(items, ["step"], algorithm, equal=False).join(items, ["step", "item_id"])
    loads = placed.groupBy("step", "part").agg(
        F.sum("work").alias("load"), F.count(F.lit(1)).alias("c"), F.count_distinct("item_id").alias("i"), F.max("work").alias("heaviest")
    )
    return loads.groupBy("step").agg(
        F.sum("c").alias("n"),
        F.sum("i").alias("items"),
        F.count(F.lit(1)).alias("parts"),
        (F.max("load") - F.min("load") <= F.max("heaviest")).alias("close"),
    )


@query("balance_differencing_properties", _PROPERTIES_SQL)
def balance_differencing_properties(spark, sf):
    return _properties(spark, sf, "differencing")


@query("balance_greedy_properties", _PROPERTIES_SQL)
def balance_greedy_properties(spark, sf):
    return _properties(spark, sf, "greedy")


@query(
    "balance_imbalance_report",
    f"""{L_SQL}, r AS (SELECT step, row_idx, length, row_number() OVER (PARTITION BY step ORDER BY row_idx) - 1 AS pos,
        count(*) OVER (PARTITION BY step) AS n, row_number() OVER (PARTITION BY step ORDER BY length DESC, row_idx) - 1 AS r FROM l),
    a AS (SELECT step, pos // greatest(n // 4, 1) AS b, sum(length) AS s FROM r GROUP BY ALL),
    p AS (SELECT step, CASE WHEN (r // 4) % 2 = 0 THEN r % 4 ELSE 3 - r % 4 END AS part, sum(length) AS s FROM r GROUP BY ALL)
    SELECT step, CAST(min(a.s) AS BIGINT) AS min, CAST(max(a.s) AS BIGINT) AS max, CAST(max(a.s) - min(a.s) AS BIGINT) AS minmax_diff,
      CAST(any_value(q.lo) AS BIGINT) AS balanced_min, CAST(any_value(q.hi) AS BIGINT) AS balanced_max, {sq("sum(a.s)/4.0")} AS mean
    FROM a JOIN (SELECT step, min(s) AS lo, max(s) AS hi FROM p GROUP BY step) q USING (step) GROUP BY step""",
)
def balance_imbalance_report(spark, sf):
    rows = lengths(spark, sf)
    parts = B.balanced_partitions(_items(spark, sf), ["step"], "serpentine", equal=False).withColumnRenamed("item_id", "row_idx")
    rows = rows.join(parts, ["step", "row_idx"])
    rows = with_rank(rows, F.floor(F.col("row_idx") / 65536), [F.col("row_idx")], "pos", ["step"])
    out = B.imbalance_report(rows.drop("row_idx").withColumnRenamed("pos", "row_idx"), ["step"], 4)
    return out.withColumn("mean", rnd("mean"))


@query(
    "balance_micro_batch_counts",
    f"{L_SQL} SELECT step, CAST(ceil(least(count(*), ceil(sum(length)/4000.0))/2.0)*2 AS BIGINT) AS k FROM l GROUP BY step",
)
def balance_micro_batch_counts(spark, sf):
    return B.micro_batch_counts(lengths(spark, sf), ["step"], 4000, multiple=2).select("step", F.col("k").cast("long").alias("k"))


@query("balance_micro_batches")
def balance_micro_batches(spark, sf):
    return B.micro_batches(lengths(spark, sf), ["step"], 20000)


@query(
    "balance_micro_batch_coverage",
    f"{L_SQL} SELECT step, count(*) AS n, CAST(least(count(*), ceil(sum(length)/20000.0)) AS BIGINT) AS batches FROM l GROUP BY step",
)
def balance_micro_batch_coverage(spark, sf):
    out = B.micro_batches(lengths(spark, sf), ["step"], 20000)
    return out.groupBy("step").agg(F.count_distinct("row_idx").alias("n"), F.count_distinct("micro_batch").alias("batches"))


@query(
    "balance_restore_order",
    f"{L_SQL} SELECT step, row_idx, length FROM l ORDER BY row_idx",
)
def balance_restore_order(spark, sf):
    rows = lengths(spark, sf)
    moved = rows.join(B.micro_batches(rows, ["step"], 20000), ["step", "row_idx"])
    return B.restore_order(moved).select("step", "row_idx", "length")


@query("balance_group_partitions")
def balance_group_partitions(spark, sf):
    rows = lengths(spark, sf)
    return B.group_partitions(rows, ["step"], "uid", 4, equal=False)


@query(
    "balance_group_cohesion",
    f"{L_SQL} SELECT step, count(DISTINCT uid) AS prompts, CAST(1 AS BIGINT) AS parts_per_prompt FROM l GROUP BY step",
)
def balance_group_cohesion(spark, sf):
    parts = B.group_partitions(lengths(spark, sf), ["step"], "uid", 4, equal=False)
    per = parts.groupBy("step", "uid").agg(F.count_distinct("part").alias("p"))
    return per.groupBy("step").agg(F.count_distinct("uid").alias("prompts"), F.max("p").alias("parts_per_prompt"))


@query("balance_step_layout")
def balance_step_layout(spark, sf):
    return B.balance_step(lengths(spark, sf), ["step"], 4, equal=False)


@query(
    "balance_step_positions",
    f"{L_SQL} SELECT step, count(*) AS n, CAST(0 AS BIGINT) AS first_idx, count(*) - 1 AS last_idx FROM l GROUP BY step",
)
def balance_step_positions(spark, sf):
    out = B.balance_step(lengths(spark, sf), ["step"], 4, mini_batch=256, equal=False)
    return out.groupBy("step").agg(
        F.count_distinct("new_idx").alias("n"), F.min("new_idx").alias("first_idx"), F.max("new_idx").alias("last_idx")
    )


@query(
    "prefix_runs_of_equal",
    f"WITH {B_SQL}, s AS (SELECT row_idx, o_orderstatus, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (ORDER BY row_idx) THEN 0 ELSE 1 END AS st FROM b) "
    "SELECT row_idx, o_orderstatus, CAST(sum(st) OVER (ORDER BY row_idx) - 1 AS BIGINT) AS run_id FROM s",
)
def prefix_runs_of_equal(spark, sf):
    return B.runs_of_equal(batch(spark, sf, "o_orderstatus"), "o_orderstatus").select("row_idx", "o_orderstatus", "run_id")


@query(
    "prefix_positions",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}
    SELECT sample_id, prompt_len + CAST(sum(len) OVER (PARTITION BY step, uid ORDER BY sample_id) AS BIGINT) - len AS suffix_start,
      CAST(prompt_len AS INTEGER) AS first_pos, CAST(prompt_len + len - 1 AS INTEGER) AS last_pos FROM smp""",
)
def prefix_positions(spark, sf):
    rows = trajectories(spark, sf).select("step", "uid", "sample_id", F.col("prompt_len").alias("prefix_len"), F.size("response_mask").alias("suffix_len"))
    out = B.shared_prefix_positions(rows, ["step", "uid"])
    return out.select(
        "sample_id", "suffix_start", F.array_min("position_ids").alias("first_pos"), F.array_max("position_ids").alias("last_pos")
    )


@query(
    "prefix_packing",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}
    SELECT step, uid, CAST(any_value(prompt_len) AS INTEGER) AS prefix_len, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id) AS members FROM smp GROUP BY ALL""",
)
def prefix_packing(spark, sf):
    rows = trajectories(spark, sf).select("step", "uid", "sample_id", "prompt_len", "response_mask")
    out = B.pack_shared_prefix(rows, ["step", "uid"], ["response_mask"])
    return out.select("step", "uid", "prefix_len", F.array_join(F.col("sample_id").cast("array<string>"), ",").alias("members"))


# --- sequences ----------------------------------------------------------------------------------------------------


def words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.tokens("text").alias("w"))


WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"
_PAD = "list_transform(range(greatest(20 - len(w), 0)), lambda x: '_')"
_CUTS = {
    "left": "w[-20:]",
    "right": "w[:20]",
    "middle": "list_concat(w[:10], w[-10:])",
}


@query(
    "sequence_fit_length",
    f"WITH {WORDS} "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS mode, array_to_string(CASE WHEN len(w) <= 20 THEN list_concat({_PAD}, w) ELSE {v} END, ' ') AS ids FROM w"
        for k, v in _CUTS.items()
    ),
)
def sequence_fit_length(spark, sf):
    rows = words(spark, sf)
    return C.concat(
        [
            rows.select("doc_id", F.lit(k).alias("mode"), F.array_join(X.fit_length("w", 20, F.lit("_"), True, k), " ").alias("ids"))
            for k in ("left", "right", "middle")
        ]
    )


@query(
    "sequence_strip_padding",
    f"WITH {TOKENS_SQL} SELECT sample_id, CAST(count(*) FILTER (m = 1) AS INTEGER) AS n, {sq('coalesce(sum(val) FILTER (m = 1), 0)')} AS total FROM t GROUP BY sample_id",
)
def sequence_strip_padding(spark, sf):
    kept = trajectories(spark, sf).select("sample_id", X.valid_tokens("values", "response_mask").alias("v"))
    return kept.select("sample_id", F.size("v").alias("n"), rnd(asum("v")).alias("total"))


@query(
    "sequence_sft_loss_mask",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}, i AS (SELECT sample_id, prompt_len AS p, len AS r, unnest(range(48)) AS i FROM smp),
    f AS (SELECT sample_id, i, CASE WHEN i >= p + r THEN 0 WHEN p > 1 AND i < least(p, 48) - 1 THEN 0 WHEN i = least(p + r, 48) - 1 THEN 0 ELSE 1 END AS f FROM i)
    SELECT sample_id, string_agg(CAST(f AS VARCHAR), '' ORDER BY i) AS mask FROM f GROUP BY sample_id""",
)
def sequence_sft_loss_mask(spark, sf):
    rows = trajectories(spark, sf)
    mask = X.sft_loss_mask(F.col("prompt_len"), F.size("response_mask"), 48)
    return rows.select("sample_id", F.array_join(mask.cast("array<string>"), "").alias("mask"))


CONV_WORDS = "cw AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)"


@query(
    "sequence_chat_encoding",
    f"""WITH {CONV_WORDS}
    SELECT conv_id, string_agg('<' || role || '> ' || array_to_string(w, ' '), ' ' ORDER BY turn) AS tokens,
      CAST(sum(CASE WHEN role = 'assistant' THEN len(w) ELSE 0 END) AS INTEGER) AS trained, CAST(sum(len(w) + 1) AS INTEGER) AS n FROM cw GROUP BY conv_id""",
)
def sequence_chat_encoding(spark, sf):
    e = messages(spark, sf).select("conv_id", X.chat_encoding("messages").alias("e"))
    return e.select(
        "conv_id", F.array_join("e.tokens", " ").alias("tokens"), mask_count(F.col("e.loss_mask")).alias("trained"), F.size("e.tokens").alias("n")
    )


@query(
    "sequence_chat_encoding_tools",
    f"""WITH {CONV_WORDS}
    SELECT conv_id, string_agg(CASE WHEN turn > 0 THEN '' WHEN role = 'system' THEN '<tools> search ' ELSE '<system> be helpful <tools> search ' END
        || '<' || role || '> ' || array_to_string(w, ' '), ' ' ORDER BY turn) AS tokens,
      CAST(sum(CASE WHEN role = 'assistant' THEN len(w) + CASE WHEN turn = 0 THEN 5 ELSE 0 END ELSE 0 END) AS INTEGER) AS trained FROM cw GROUP BY conv_id""",
)
def sequence_chat_encoding_tools(spark, sf):
    """Tools are described once, in the first turn, and the default system prefix stands only there."""
    tools, system = F.array(F.lit("<tools>"), F.lit("search")), F.array(*[F.lit(w) for w in ("<system>", "be", "helpful")])
    e = messages(spark, sf).select("conv_id", X.chat_encoding("messages", tools=tools, system_prefix=system).alias("e"))
    return e.select("conv_id", F.array_join("e.tokens", " ").alias("tokens"), mask_count(F.col("e.loss_mask")).alias("trained"))


@query(
    "sequence_chat_encoding_padded",
    f"""WITH {CONV_WORDS}, a AS (SELECT conv_id, flatten(list(list_concat(['<' || role || '>'], w) ORDER BY turn)) AS t,
        flatten(list(list_concat([0], list_transform(w, lambda x: CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)) ORDER BY turn)) AS m FROM cw GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_concat(t[:64], list_transform(range(greatest(64 - len(t), 0)), lambda x: '<pad>')), ' ') AS tokens,
      CAST(coalesce(list_sum(m[:64]), 0) AS INTEGER) AS trained FROM a""",
)
def sequence_chat_encoding_padded(spark, sf):
    e = messages(spark, sf).select("conv_id", X.chat_encoding("messages", max_length=64).alias("e"))
    return e.select("conv_id", F.array_join("e.tokens", " ").alias("tokens"), mask_count(F.col("e.loss_mask")).alias("trained"))


@query(
    "sequence_pair_encoding",
    """WITH p AS (SELECT conv_id, list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY turn) FILTER (turn = 0), '\\s+'), lambda x: x <> '') AS q,
        list_filter(regexp_split_to_array(coalesce(any_value(text) FILTER (turn = 1), ''), '\\s+'), lambda x: x <> '') AS c,
        list_filter(regexp_split_to_array(coalesce(any_value(text) FILTER (turn = 3), ''), '\\s+'), lambda x: x <> '') AS r FROM conversations GROUP BY conv_id),
    e AS (SELECT conv_id, 'chosen' AS side, list_concat(q, c) AS t FROM p UNION ALL SELECT conv_id, 'rejected', list_concat(q, r) FROM p)
    SELECT conv_id, side, array_to_string(list_concat(t[:60], list_transform(range(greatest(60 - len(t), 0)), lambda x: '0')), ' ') AS ids FROM e""",
)
def sequence_pair_encoding(spark, sf):
    rows = messages(spark, sf)
    q, c, r = (X.tokens(F.coalesce(F.get(F.col("messages"), F.lit(i))["content"], F.lit(""))) for i in (0, 1, 3))

    def fit(a):
        return X.fit_length(F.concat(q, a), 60, F.lit("0"), left_pad=False, truncation="right")

    pair = rows.select("conv_id", F.posexplode(F.array(fit(c), fit(r))).alias("i", "ids"))
    return pair.select("conv_id", F.when(F.col("i") == 0, "chosen").otherwise("rejected").alias("side"), F.array_join("ids", " ").alias("ids"))

