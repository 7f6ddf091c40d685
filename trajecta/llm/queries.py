"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    exact_dedup,
    fill_middle,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    order_minhash,
    private_data,
    sentencepiece_bpe,
    simhash,
    toxicity,
    turn_repair,
)
from .common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines with the class each belongs to and whether it is kept."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder("doc_id", 4) == 2)
    return language_id.identify(docs, docs.filter(~F.col("held_out")), ["doc_id", "held_out"])


def license_sql() -> str:
    """The same scan in SQL; the nested replacements follow the rules in order."""
    known = license_scan.sentence_table()
    pairs = ", ".join(f"('{text}', '{key}')" for text, key in known.items())
    left, tests = "sequence", []
    for name, ids in license_scan.RULES:
        pattern = "".join(f"<{i}>" for i in ids)
        tests.append((name, f"contains({left}, '{pattern}')"))
        left = f"replace({left}, '{pattern}', '<>')"
    # One level of nesting per query block keeps the text linear in the number of rules.
    blocks, source = [], "seq"
    for n, (name, ids) in enumerate(license_scan.RULES):
        pattern = "".join(f"<{i}>" for i in ids)
        blocks.append(
            f"r{n} AS (SELECT doc_id, n_sentences, sequence, replace(rest, '{pattern}', '<>') AS rest,"
            f" CASE WHEN contains(rest, '{pattern}') THEN list_append(names, '{name}') ELSE names END AS names FROM {source})"
        )
        source = f"r{n}"
    return f"""
    WITH known(sentence, ident) AS (VALUES {pairs}),
    cut AS (SELECT doc_id, list_filter(list_transform(
        string_split_regex(regexp_replace(coalesce(text, ''), '{license_scan.WRAPPED}', '\\1 \\2', 'g'), '{license_scan.SENTENCE_END}'),
        lambda s: trim(regexp_replace(lower(s), '{license_scan.NOT_PLAIN}', ' ', 'g'))), lambda s: s <> '') AS s FROM documents),
    spread AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS n FROM cut),
    found AS (SELECT doc_id, string_agg('<' || ident || '>', '' ORDER BY n) AS sequence FROM spread JOIN known USING (sentence) GROUP BY doc_id),
    seq AS (SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, coalesce(sequence, '') AS sequence, coalesce(sequence, '') AS rest,
        CAST([] AS VARCHAR[]) AS names FROM cut LEFT JOIN found USING (doc_id)),
    {", ".join(blocks)}
    SELECT doc_id, n_sentences, sequence, coalesce(array_to_string(list_sort(list_distinct(names)), '|'), '') AS licenses,
        CAST(len(replace(rest, '<>', '')) - len(replace(replace(rest, '<>', ''), '<', '')) AS INTEGER) AS unmatched
    FROM {source}
    """


@query("op3_license_scan", license_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op4_order_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = order_minhash.fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.as_text(F.col("signature")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        order_minhash.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def chat_sql() -> str:
    """Digests and lengths computed from the table, not from formatted text."""

    def escaped(col: str, upto: int) -> str:
        for plain, coded in chat_format.ESCAPES[:upto]:
            col = f"replace({col}, '{plain}', '{coded}')"
        return col

    t = chat_format.TEMPLATE
    labels = " ".join(f"WHEN role = '{k}' THEN '{v}'" for k, v in t["labels"].items())
    fixed = len(t["open"]) + len(t["header_end"]) + len(t["close"])
    return f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, n, role, '{TRAP}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, role)),
    sized AS (SELECT *, CASE WHEN role IN ('assistant') THEN text ELSE '' END AS trained,
        {fixed} + length(CASE {labels} ELSE '=' || {escaped('role', 4)} END) + length({escaped('text', 3)}) AS chars FROM rows)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(length(trained)) AS BIGINT) AS loss_chars,
        sha256(string_agg(trained, '' ORDER BY turn, role, text)) AS loss_sha256,
        CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """


TRAP = r"\### Assistant: </turn> ok"


@query("op5_chat_format", chat_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], turns.schema)
    made = chat_format.format_conversations(turns.unionByName(trap))
    made = made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_texts(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""


@query("op7_exact_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


OP10_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, CAST([5, 2, 1][1 + rank % 3] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM w),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER e, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0.0)) AS level
    FROM c WINDOW e AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, (cap / w, rank)) FROM l WHERE level * w <= cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, d.key, p.source, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT source, max(key) AS last FROM r WHERE size > 0 AND before * 2 + size <= rest * 2 GROUP BY source)
SELECT doc_id, size, source_size, target,
    CAST(size * (whole + CASE WHEN key <= k.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN k ON r.source IS NOT DISTINCT FROM k.source
"""


@query("op10_mixing", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", "taken")


def fim_sql() -> str:
    """Cuts by counting listed tokens, where the operator asks its boundary set."""
    draw = lambda g: f"CAST('0x' || substr(digest, {8 * g - 7}, 8) AS BIGINT)"
    p, s, m = fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens FROM documents),
    n AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n, {draw(1)} % (len(tokens) + 1) AS x, {draw(2)} % (len(tokens) + 1) AS y,
        CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}')
            OR {draw(3)} % 100 >= {fill_middle.FIM_PERCENT} THEN 'plain'
            WHEN {draw(4)} % 100 < {fill_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d),
    c AS (SELECT *, array_to_string(tokens[1:least(x, y)], '') AS prefix,
        array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS middle,
        array_to_string(tokens[greatest(x, y) + 1:], '') AS suffix FROM n)
    SELECT doc_id, n, form,
        CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
            ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM c
    """


@query("op11_fill_middle", fim_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, and the text rebuilt from it."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def crc32_table() -> list[int]:
    """The reflected table of the polynomial 0xEDB88320."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


def repair_sql() -> str:
    """A forward search over (cost, audit) texts by row, least text first; the operator looks backward by blocks."""
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    codes = f"list_transform(string_split({key}, ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    steps = f"list_concat([CAST(4294967295 AS BIGINT)], {codes})"
    crc = f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"

    def plus(way: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(substr({way}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letter}')"

    def opened(source: str) -> str:
        """Insertions in front of what comes next."""
        return f"""SELECT * EXCLUDE (u), u2 AS u, least(a, {plus("u2", "2", "I")}) AS a2 FROM (
            SELECT *, least(u, {plus("n", "2", "I")}, {plus("s", "2", "I")}, {plus("a", "2", "I")}) AS u2 FROM {source})"""

    go = "fault IN ('blank', 'duplicate')"
    late = "(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END)"
    read = lambda way, initial: f"CASE WHEN NOT {go} AND initial = '{initial}' THEN {plus(way, late, 'K')} END"
    made = lambda way: f"CASE WHEN NOT {go} THEN {plus(way, '2 + ' + late, 'R')} END"
    return rf"""
    WITH RECURSIVE t AS (SELECT {crc32_table()} AS crc_table),
    drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS d FROM conversations, t),
    hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE d <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM hurt),
    faulted AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
        CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
    told AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faulted GROUP BY conv_id),
    ways AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a
        FROM told
        UNION ALL
        SELECT conv_id, i,
            {plus("n", "3", "D")}, least({plus("s", "3", "D")}, {read("n", "s")}),
            least({plus("u", "3", "D")}, {read("n", "u")}, {read("s", "u")}, {read("a2", "u")}, {made("n")}, {made("s")}, {made("a2")}),
            least({plus("a2", "3", "D")}, {read("u", "a")}, {made("u")})
        FROM (SELECT w.conv_id, f.i, f.initial, f.fault, w.n, w.s, w.u, w.a2 FROM ({opened("ways")}) w
            JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
    best AS (SELECT w.conv_id, least(w.n, w.a2) AS way, told.* EXCLUDE (conv_id) FROM ({opened("ways")}) w
        JOIN told ON told.conv_id IS NOT DISTINCT FROM w.conv_id AND told.rows = w.i),
    ops AS (SELECT conv_id, unnest(string_split(substr(way, 10), '')) AS op, generate_subscripts(string_split(substr(way, 10), ''), 1) AS p
        FROM best WHERE length(way) > 9),
    counted AS (SELECT *, sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN op <> 'D' THEN 1 ELSE 0 END) OVER w AS o
        FROM ops WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
    made AS (SELECT c.*, f.role, f.text, f.initial,
        max(CASE WHEN c.op = 'K' AND c.o = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS lead
        FROM counted c LEFT JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i AND c.op <> 'I'),
    said AS (SELECT conv_id, p, CASE WHEN op = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
        CASE WHEN op = 'I' THEN '' ELSE text END AS line FROM made WHERE op <> 'D'),
    joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM said GROUP BY conv_id)
    SELECT c.conv_id, CAST(coalesce(b.gaps, 0) AS BIGINT) AS gaps, coalesce(b.blank, 0) AS blank, coalesce(b.duplicate, 0) AS duplicate,
        coalesce(b.truncated, 0) AS truncated, coalesce(b.illegal, 0) AS illegal,
        CAST(coalesce(substr(b.way, 1, 9), '0') AS BIGINT) AS cost, coalesce(substr(b.way, 10), '') AS audit,
        sha256(coalesce(j.whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
    """


@query("op12_turn_repair", repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original conversation after seeded damage: its faults, the cheapest repair, and a digest of the result."""
    turns = table(spark, sf_dir, "conversations")
    found, parts = turn_repair.repaired(turn_repair.damaged(turns))
    # One digest covers all texts of a conversation, so here, and only here, they meet.
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    texts = parts.select("conv_id", F.struct("part", F.array_join(lines, "\n").alias("text"), F.size("turns").alias("n")).alias("p"))
    texts = texts.filter("p.n > 0").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("p"))["text"], "\n").alias("whole"))
    original = turns.select("conv_id").distinct()
    same = lambda df, k: F.col("conv_id").eqNullSafe(F.col(k))
    rows = original.join(found.withColumnRenamed("conv_id", "c1"), same(found, "c1"), "left")
    rows = rows.join(texts.withColumnRenamed("conv_id", "c2"), same(texts, "c2"), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.sha2(F.coalesce("whole", F.lit("")), 256).alias("repaired_sha256")
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest)


@query("op13_private_data")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the plain matches, and all spans, disguised ones included."""
    rows = private_data.private_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    plain = F.filter("found", lambda s: s["plain"])
    kinds = F.transform(plain, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in private_data.KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(private_data.listed(plain), 256).alias("base_sha256"),
        private_data.listed(F.col("found")).alias("spans"),
        (F.size("found") - F.size(plain)).cast("long").alias("n_disguised"),
    )
