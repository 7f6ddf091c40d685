"""Retrieval, streaming and user-function queries."""

import uuid

from pyspark.sql import functions as F

from ..derive import METRIC_NAMES, RESPONSES_SQL, STREAM_SQL, TOKENS_SQL, responses, rollout_stream, stream_columns, table, trajectories
from ..hooks import CurriculumSampler, Generator, Mergeable, Moments, dataset, grown_dataset, merged_reduce, register_dataset, row_reward
from ..operators import advantages as A
from ..operators import retrieval as R
from ..operators.filters import token_count, within_length
from ..session import checkpoint_root
from ..streaming import rollouts as Z
from .q_correction import rounded
from .q_datasets import WORDS_N
from .q_metrics import ROLLUP_SQL
from .registry import query, rnd, sq

K = 5


def vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding"), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


DENSE = f"""d AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS s
    FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM d)"""


@query(
    "retrieval_dense_top_k",
    f"WITH {DENSE} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, {sq('s', 5)} AS score FROM r WHERE rank <= {K}",
)
def retrieval_dense_top_k(spark, sf):
    docs, queries = vectors(spark, sf)
    return R.dense_top_k(docs, queries, K).select("query_id", "rank", "doc_id", rnd("score", 5).alias("score"))


def corpus(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


SPLIT = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
LEXICAL = f"""dt AS (SELECT doc_id, text, {SPLIT} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY doc_id, dl, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT item_id AS query_id, unnest(list_distinct({SPLIT})) AS term FROM benchmark),
    s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5)/(df + 0.5)) * (tf*1.9/(tf + 0.9*(0.6 + 0.4*dl/avgdl))) ORDER BY term) AS s FROM qt JOIN df USING (term) JOIN tf USING (term), n GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s)"""


@query(
    "retrieval_lexical_scores",
    f"WITH {LEXICAL} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, {sq('s', 5)} AS score FROM r WHERE rank <= {K}",
)
def retrieval_lexical_scores(spark, sf):
    docs, queries = corpus(spark, sf)
    return R.lexical_top_k(docs, queries, K).select("query_id", "rank", "doc_id", rnd("score", 5).alias("score"))


def hits(spark, sf):
    docs, queries = vectors(spark, sf)
    pages = table(spark, sf, "documents").select("doc_id", "text")
    return R.with_contents(R.dense_top_k(docs, queries, K), pages)


@query(
    "retrieval_corpus_lookup",
    f"WITH {DENSE} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, text AS contents FROM r JOIN documents USING (doc_id) WHERE rank <= {K}",
)
def retrieval_corpus_lookup(spark, sf):
    return hits(spark, sf).select("query_id", "rank", "doc_id", "contents")


@query(
    "retrieval_formatted",
    f"""WITH {DENSE}, p AS (SELECT query_id, rank, 'Doc ' || rank || ' (Title: ' || string_split(text, chr(10))[1] || ')' || chr(10) || array_to_string(string_split(text, chr(10))[2:], chr(10)) || chr(10) || chr(10) AS p
      FROM r JOIN documents USING (doc_id) WHERE rank <= {K}),
    f AS (SELECT query_id, regexp_replace(string_agg(p, '' ORDER BY rank), '^\\s+|\\s+$', '', 'g') AS result, CAST(count(*) AS INTEGER) AS n FROM p GROUP BY query_id)
    SELECT item_id AS query_id, coalesce(result, 'No search results found.') AS result, coalesce(n, 0) AS total_results, CASE WHEN result IS NULL THEN 'no_results' ELSE 'success' END AS status
    FROM benchmark LEFT JOIN f ON item_id = query_id""",
)
def retrieval_formatted(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return R.with_status(asked, R.formatted(hits(spark, sf)))


@query(
    "validation_sample_log",
    "SELECT text AS input FROM (SELECT text FROM documents ORDER BY md5('42:' || coalesce(text, '')), text LIMIT 20)",
)
def validation_sample_log(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("text").alias("input"))
    return R.validation_samples(rows, 20)


# --- streaming ------------------------------------------------------------------------------------------------


def events_stream(spark, sf):
    return Z.read_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


def places(spark, name):
    root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def ops(frame):
    """Every fourth event of a queue takes from it, the others put into it."""
    return frame.withColumn("op", F.when(F.col("sample_id") % 4 == 3, "get").otherwise("put"))


@query("stream_ingestion", f"WITH {STREAM_SQL} SELECT queue, sample_id, processing_time, param_version_start FROM st")
def stream_ingestion(spark, sf):
    stream = stream_columns(events_stream(spark, sf)).select("queue", "sample_id", "processing_time", "param_version_start")
    return Z.run_to_files(stream, *places(spark, "ingest")).drop("batch_number")


@query(
    "stream_bounded_buffer_puts",
    f"""WITH {STREAM_SQL} SELECT queue, least(count(*), 64) AS queue_size, count(*) AS produced, CAST(0 AS BIGINT) AS consumed, greatest(count(*) - 64, 0) AS dropped,
      (list(sample_id ORDER BY ts, sample_id))[-least(count(*), 64)] AS oldest, arg_max(sample_id, (ts, sample_id)) AS newest FROM st GROUP BY queue""",
)
def stream_bounded_buffer_puts(spark, sf):
    stream = stream_columns(events_stream(spark, sf)).withColumn("op", F.lit("put"))
    out = Z.run_to_files(Z.bounded_buffer(stream, 64), *places(spark, "buffer"), mode="update")
    return Z.newest(out, ["queue"])


@query("stream_bounded_buffer")
def stream_bounded_buffer(spark, sf):
    stream = ops(stream_columns(events_stream(spark, sf)))
    out = Z.run_to_files(Z.bounded_buffer(stream, 64), *places(spark, "buffer"), mode="update")
    return Z.newest(out, ["queue"])


@query(
    "stream_put_results",
    f"""WITH {STREAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, sample_id) AS r FROM st)
    SELECT queue, sample_id, r <= 64 AS put_ok, least(r, 64) AS queue_size FROM r""",
)
def stream_put_results(spark, sf):
    stream = stream_columns(events_stream(spark, sf)).withColumn("op", F.lit("put"))
    out = Z.run_to_files(Z.put_results(stream, 64), *places(spark, "puts"))
    return out.select("queue", "sample_id", "put_ok", "queue_size")


@query(
    "stream_staleness_gate_state",
    f"""WITH {STREAM_SQL}, e AS (SELECT *, CASE WHEN sample_id % 50 = 0 THEN 'version' WHEN sample_id % 9 = 0 THEN 'resume' ELSE 'start' END AS kind FROM st),
    i AS (SELECT *, sum((kind = 'version')::INT) OVER (PARTITION BY queue ORDER BY ts, sample_id) AS island FROM e),
    c AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY queue, island ORDER BY ts, sample_id) + CASE WHEN island > 0 THEN 6 ELSE 0 END AS n FROM i)
    SELECT queue, sample_id, CAST(n AS BIGINT) AS staleness_samples, n >= 30 AS pause FROM c WHERE kind <> 'version'""",
)
def stream_staleness_gate_state(spark, sf):
    """Every fiftieth event changes the version, with six samples still carried."""
    kind = F.when(F.col("sample_id") % 50 == 0, "version").when(F.col("sample_id") % 9 == 0, "resume").otherwise("start")
    carried = {"in_flight": 2, "cancelled": 1, "queue_size": 3}
    events = stream_columns(events_stream(spark, sf)).withColumn("kind", kind).withColumns({k: F.lit(v) for k, v in carried.items()})
    gate = Z.staleness_gate_stream(events, Z.max_required(10, 0.5, 2), 1000)
    return Z.run_to_files(gate, *places(spark, "gate")).select("queue", "sample_id", "staleness_samples", "pause")


@query(
    "stream_buffer_contents",
    f"""WITH {STREAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, sample_id) AS r, count(*) OVER (PARTITION BY queue) AS n FROM st)
    SELECT queue, sample_id, r <= n - 64 AS was_dropped, r <= 64 AS put_ok FROM r""",
)
def stream_buffer_contents(spark, sf):
    return Z.buffer_contents(rollout_stream(spark, sf), 64).select("queue", "sample_id", "was_dropped", "put_ok")


@query(
    "stream_producer_drops",
    f"WITH {STREAM_SQL} SELECT queue, least(count(*), 64) AS total_generated_samples, greatest(count(*) - 64, 0) AS dropped_stale_samples FROM st GROUP BY queue",
)
def stream_producer_drops(spark, sf):
    return Z.producer_counts(Z.buffer_contents(rollout_stream(spark, sf), 64))


@query(
    "stream_staleness_gate",
    f"""WITH {STREAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY queue, param_version ORDER BY ts, sample_id) AS r FROM st WHERE sample_id % 9 <> 0)
    SELECT queue, sample_id, r + 3 AS staleness_samples, r + 3 >= 60 AS pause FROM r""",
)
def stream_staleness_gate(spark, sf):
    rows = rollout_stream(spark, sf).withColumn("resumed", F.col("sample_id") % 9 == 0)
    out = Z.staleness_gate(rows, Z.max_required(20, 0.5, 2), 1000, carried=3)
    return out.select("queue", "sample_id", "staleness_samples", "pause")


@query(
    "stream_assembly_stats",
    f"""WITH {STREAM_SQL} SELECT batch, {sq("avg(processing_time)")} AS processing_time_avg, {sq("quantile_cont(processing_time, 0.95)")} AS tp95,
      {sq("avg((param_version_start <> param_version_end)::INT)")} AS partial_ratio FROM st GROUP BY batch""",
)
def stream_assembly_stats(spark, sf):
    totals = Z.assembly_totals(stream_columns(events_stream(spark, sf)), ["batch"])
    out = Z.newest(Z.run_to_files(totals, *places(spark, "assembly"), mode="update"), ["batch"])
    return rounded(out.select("batch", "processing_time_avg", "tp95", "partial_ratio"), ("batch",))


@query(
    "stream_assembly_finished",
    f"""WITH {STREAM_SQL} SELECT param_version, count(*) AS n_samples, {sq("avg(processing_time)")} AS processing_time_avg, {sq("max(tool_call_time)")} AS tool_calls_max,
      {sq("quantile_cont(processing_time, 0.5)")} AS tp50, {sq("quantile_cont(processing_time, 0.99)")} AS tp99,
      count(*) FILTER (param_version_start <> param_version_end) AS total_partial_num, count(DISTINCT param_version_start) AS version_diversity
    FROM st GROUP BY param_version HAVING count(*) >= 500""",
)
def stream_assembly_finished(spark, sf):
    """Batches of 500 samples, told when they are whole; the last one, if it is not, is never told."""
    samples = stream_columns(events_stream(spark, sf)).withColumn("batch", F.col("param_version")).withColumn("param_version", F.col("param_version_start"))
    finished = Z.assembly_totals(samples, ["batch"], 500)
    out = Z.newest(Z.run_to_files(finished, *places(spark, "finished"), mode="update"), ["batch"])
    cols = [F.col("batch").alias("param_version"), "n_samples", "total_partial_num", F.col("version_diversity").cast("long").alias("version_diversity")]
    return out.select(*cols, *[rnd(c).alias(c) for c in ("processing_time_avg", "tool_calls_max", "tp50", "tp99")])


@query("stream_interval_rollup", f'{ROLLUP_SQL} SELECT "interval", key, {sq("value", 4)} AS value FROM roll')
def stream_interval_rollup(spark, sf):
    names = F.array(*[F.lit(n) for n in METRIC_NAMES])
    log = events_stream(spark, sf).select(
        F.floor(F.col("user_id") / 20).alias("interval"),
        F.get(names, (F.col("event_id") % 12).cast("int")).alias("key"),
        "value",
        "ts",
        "event_id",
    )
    out = Z.run_to_files(Z.interval_stream(log, ["interval"]), *places(spark, "rollup"), mode="update")
    return Z.newest(out, ["interval", "key"]).select("interval", "key", rnd("value", 4).alias("value"))


@query(
    "stream_staleness_counts",
    f"WITH {STREAM_SQL} SELECT queue, count(*) FILTER (10 - param_version >= 1) AS stale_samples_processed, count(*) FILTER (10 - param_version_end >= 1) AS stale_trajectory_processed FROM st GROUP BY queue",
)
def stream_staleness_counts(spark, sf):
    stream = Z.staleness_stream(stream_columns(events_stream(spark, sf)), 10)
    return Z.newest(Z.run_to_files(stream, *places(spark, "stale"), mode="update"), ["queue"])


# --- user functions ---------------------------------------------------------------------------------------------


def overlap_reward(data_source, solution, truth, info, bonus=0.0):
    """A sample user reward: whether the truth occurs in the response, plus a bonus."""
    return {"score": float(truth in solution) + bonus, "length": len(solution)}


@query(
    "hook_row_reward",
    f"WITH {RESPONSES_SQL} SELECT doc_id, {sq('contains(output, gold)::INT + 0.25')} AS score, {sq('length(output)')} AS length FROM res",
)
def hook_row_reward(spark, sf):
    score = row_reward(overlap_reward, ["length"], bonus=0.25)
    rows = responses(spark, sf).select("doc_id", score(F.col("source"), F.col("output"), F.col("gold")).alias("s"))
    return rows.select("doc_id", rnd("s.score").alias("score"), rnd("s.length").alias("length"))


def length_advantage(df):
    """A sample user estimator: response length as advantage."""
    adv = F.transform("response_mask", lambda m: m * F.size("response_mask").cast("double"))
    return df.withColumn("advantages", adv).withColumn("returns", F.col("advantages"))


@query("hook_custom_estimator", f"WITH {TOKENS_SQL} SELECT sample_id, {sq('sum(m)*any_value(len)')} AS total FROM t GROUP BY sample_id")
def hook_custom_estimator(spark, sf):
    from ..functions.arrays import asum

    A.register_estimator("length", length_advantage)
    return A.advantage(trajectories(spark, sf), "length").select("sample_id", rnd(asum("advantages")).alias("total"))


@query("hook_grouped_reduce", f"SELECT event_type, {sq('max(value) - min(value)')} AS spread FROM events GROUP BY event_type")
def hook_grouped_reduce(spark, sf):
    """A user aggregate that is no sum: the spread of the values of a group."""
    out = merged_reduce(table(spark, sf, "events"), "event_type", "value", Spread(), "spread")
    return out.select("event_type", rnd("spread").alias("spread"))


class Spread(Mergeable):
    def init(self):
        return [float("inf"), float("-inf")]

    def update(self, state, values):
        return self.merge(state, [values.min(), values.max()])

    def merge(self, a, b):
        return [min(a[0], b[0]), max(a[1], b[1])]

    def finish(self, state):
        return state[1] - state[0] if state[0] <= state[1] else None


@query("hook_merged_reduce", f"SELECT event_type, {sq('avg(value)')} AS mean, {sq('var_pop(value)')} AS variance FROM events GROUP BY event_type")
def hook_merged_reduce(spark, sf):
    """User mean and user variance, from states that are merged in any order."""
    events = table(spark, sf, "events")
    mean = merged_reduce(events, "event_type", "value", Moments(variance=False), "mean")
    both = mean.join(merged_reduce(events, "event_type", "value", Moments(), "variance"), "event_type")
    return both.select("event_type", rnd("mean").alias("mean"), rnd("variance").alias("variance"))


def labelled_prompts(df, joint=": "):
    """A sample user dataset: prompts that name their source."""
    return df.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(joint), "text").alias("prompt"), "lang")


class FollowUps(Generator):
    """A sample generator: a new prompt for every event of a step that names one of the dataset."""

    def generate(self, dataset, batch):
        found = batch.join(dataset, F.col("event_id") == F.col("id"))
        return found.select((-F.col("event_id") - 1).alias("id"), F.concat("event_type", F.lit(" "), "prompt").alias("prompt"))


@query(
    "hook_dataset_generator",
    f"""WITH d AS (SELECT doc_id AS id, source || ': ' || text AS text FROM documents),
    g AS (SELECT -event_id - 1 AS id, event_type || ' ' || text AS text FROM events JOIN d ON d.id = event_id)
    SELECT id, text AS prompt FROM d UNION ALL SELECT id, text FROM g WHERE {WORDS_N} <= 60""",
)
def hook_dataset_generator(spark, sf):
    """A registered dataset that a generator extends after each step; prompts over 60 words are not taken in."""
    register_dataset("labelled", labelled_prompts, "id bigint, prompt string")
    start = dataset("labelled", table(spark, sf, "documents"))
    keep = within_length(token_count(F.col("prompt")), 60)
    return grown_dataset(events_stream(spark, sf), start, FollowUps(), keep, *places(spark, "grown"))


@query(
    "hook_curriculum_sampler",
    """WITH w AS (SELECT doc_id, 1 / (avg(quality) + 0.1) AS w FROM labels GROUP BY doc_id),
    u AS (SELECT doc_id, source, CAST('0x' || substr(md5('5:' || doc_id), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE AS u FROM documents)
    SELECT doc_id, source FROM (SELECT doc_id, source FROM u LEFT JOIN w USING (doc_id) ORDER BY -ln(u + 1e-12) / coalesce(w, 1.0), doc_id LIMIT 50)""",
)
def hook_curriculum_sampler(spark, sf):
    sampler = CurriculumSampler("doc_id", "quality")
    sampler.update(table(spark, sf, "labels").select("doc_id", "quality"))
    return sampler.sample(table(spark, sf, "documents").select("doc_id", "source"), 50, seed=5)
