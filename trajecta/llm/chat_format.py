"""Chat formatting: a state machine checks turn order, a template emits segments with loss flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, start of turn, end of header, end of turn; which roles carry loss; which role may follow which state.
TEMPLATE = {
    "labels": {"system": "System", "user": "User", "assistant": "Assistant"},
    "open": "<turn>### ",
    "header_end": ": ",
    "close": "</turn>\n",
    "loss": ["assistant"],
    "start": "start",
    "accept": ["assistant"],
    "moves": {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
}
# Every control string of the template holds one of these, so an escaped text holds no control string.
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("#", "\\2"), (":", "\\3")]
IN_TEXT = 3  # a colon needs no escape inside a text


def escape(text: Column, upto: int = IN_TEXT) -> Column:
    for plain, coded in ESCAPES[:upto]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, upto: int = IN_TEXT) -> Column:
    """Inverse of `escape`: a backslash in an escaped text is always followed by its code digit."""
    for plain, coded in reversed(ESCAPES[:upto]):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def turn_order(roles: Column, template: dict = TEMPLATE) -> Column:
    """Struct (state, good): the state after all roles and the number of turns before the first wrong one."""
    moves = _literal_map({f"{a}>{b}": c for (a, b), c in template["moves"].items()})
    first = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("good"))

    def step(acc: Column, role: Column) -> Column:
        following = F.coalesce(F.element_at(moves, F.concat(acc["state"], F.lit(">"), role)), F.lit("wrong"))
        return F.struct(
            following.alias("state"),
            (acc["good"] + F.when(following != "wrong", 1).otherwise(0)).alias("good"),
        )

    return F.aggregate(roles, first, step)


def format_conversations(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, `formatted`, `segments` (text, loss), `valid`, `first_wrong`.

    Turns are taken in order of `turn` (nulls first, ties by role and text, nulls first).  A null text or role
    is empty.  Roles outside the template are written by their own escaped name and never carry loss.  A
    conversation whose roles break the order is formatted all the same, with `valid` false and the position
    of the first wrong turn.  Conversations with a null id form one.  A conversation is one output row, so
    its turns meet in one task; conversations are spread over tasks by id.
    """
    labels = _literal_map(template["labels"])
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    has_loss = F.array(*[F.lit(r) for r in template["loss"]])

    def parts(t: Column) -> Column:
        label = F.coalesce(F.element_at(labels, t["role"]), F.concat(F.lit("="), escape(t["role"], 4)))
        header = F.concat(F.lit(template["open"]), label, F.lit(template["header_end"]))
        return F.array(
            F.struct(header.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), F.array_contains(has_loss, t["role"]).alias("loss")),
            F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")),
        )

    order = turn_order(F.col("t.role"), template)
    made = listed.select("conv_id", F.flatten(F.transform("t", parts)).alias("segments"), order.alias("o"), F.size("t").alias("n"))
    return made.select(
        "conv_id",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        ((F.col("o.good") == F.col("n")) & F.col("o.state").isin(template["accept"])).alias("valid"),
        F.when(F.col("o.good") < F.col("n"), F.col("o.good")).alias("first_wrong"),
    )


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> parsed back from a formatted conversation."""
    names = _literal_map({v: k for k, v in template["labels"].items()})
    pieces = F.filter(F.split(formatted, template["close"]), lambda p: p != "")

    def parsed(p: Column) -> Column:
        body = F.substring(p, F.lit(len(template["open"]) + 1), F.length(p))
        label = F.substring_index(body, template["header_end"], 1)
        text = F.substring(body, F.length(label) + len(template["header_end"]) + 1, F.length(body))
        own = unescape(F.substring(label, F.lit(2), F.length(label)), 4)
        return F.struct(F.coalesce(F.element_at(names, label), own).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, parsed)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
