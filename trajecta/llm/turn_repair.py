"""Conversation repair: cheapest edits to a legal turn order, by Four-Russians block tables.

A row of a conversation is a symbol: the initial of its role and its fault.  Legal output is `(s?(ua)+)?`, read by
an automaton of four states, so what the rest of a conversation costs is a vector of four numbers, one for each state
in which the rest may be met.  Their differences are small, hence only a few vectors occur once the least number
is taken out.  A table holds, for every vector and every block of BLOCK symbols, the vector before the block
and the cost taken out on the way.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4
SEGMENT = 1024  # turn numbers in a segment
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
# Reading an initial: state -> state; a made turn is the one that fits, as each state has just one such.
READ = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
    "o": {},
}
MADE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ENDS = (START, ASSISTANT)
# A row: initial (s, u, a, o for any other) in lower case, upper case if it is truncated; b and d must go.
SYMBOLS = "suaoSUAObd"
PLAN = {USER: ("u", "x"), ASSISTANT: ("a", "y")}  # letters of an inserted and of a reroled turn


def inserted(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs with insertions allowed before what they stand for; three made turns in a row never pay."""
    for _ in range(2):
        costs = tuple(min(costs[q], INSERT + costs[MADE[q]]) for q in range(4))
    return costs


def before(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from in front of a row, given those from behind it."""
    must_go, late = symbol in "bd", TRUNCATED * symbol.isupper()
    moves = READ.get(symbol.lower(), {})
    costs = []
    for q in range(4):
        ways = [DELETE + after[q]]
        if not must_go:
            ways.append(REROLE + late + after[MADE[q]])
            if q in moves:
                ways.append(KEEP + late + after[moves[q]])
        costs.append(min(ways))
    return inserted(tuple(costs))


END_COSTS = inserted(tuple(0 if q in ENDS else 1 << 20 for q in range(4)))


def normalised(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(c - low for c in costs), low


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, next and cost by vector and symbol, next and cost by vector and block code).

    Vector 0 is that of the end.  The code of a block reads its symbols as digits, first symbol first.
    """
    first, low = normalised(END_COSTS)
    assert low == 0
    vectors, place = [first], {first: 0}
    one, cost = [], []
    for vector in vectors:  # grows while it is walked
        made = [normalised(before(s, vector)) for s in SYMBOLS]
        for v, _ in made:
            if v not in place:
                place[v] = len(vectors)
                vectors.append(v)
        one.append([place[v] for v, _ in made])
        cost.append([c for _, c in made])
    one, cost = np.array(one, np.int16), np.array(cost, np.int32)
    block, paid = one, cost
    for _ in range(BLOCK - 1):  # behind comes the block so far, in front one more symbol
        paid = paid[:, None, :] + cost[block].transpose(0, 2, 1)
        block = one[block].transpose(0, 2, 1)
        block, paid = block.reshape(len(vectors), -1), paid.reshape(len(vectors), -1)
    return vectors, one, cost, block, paid


_CODES = np.full(128, -1, np.int32)
_CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))


def repair_plan(symbols: str) -> tuple[int, str]:
    """(cost, plan): the cheapest edits of a whole conversation, of equal ones the least as text of K, R, D, I.

    Letters of a plan: K keeps and D deletes the row, x and y make it a user or an assistant turn, u and a insert one.
    The cost is found from the end to the front, a block by one look-up; only the vectors between blocks are kept.
    Then the blocks are taken in order: each is expanded backward from the vector behind it, and followed from
    the state reached by the first letter that is on a cheapest way.  Each letter leads to one state, so that choice is safe.
    """
    vectors, one, cost, block, paid = tables()
    codes = _CODES[np.frombuffer(symbols.encode(), np.uint8)]
    n, base = len(codes), len(SYMBOLS)
    lead = n % BLOCK  # the first symbols, fewer than a block, go one by one
    digits = codes[lead:].reshape(-1, BLOCK)
    blocks = (digits @ (base ** np.arange(BLOCK - 1, -1, -1))).tolist()
    behind, total, at = [0] * len(blocks), 0, 0
    for i in range(len(blocks) - 1, -1, -1):
        behind[i] = at
        total += int(paid[at, blocks[i]])
        at = int(block[at, blocks[i]])
    pieces = [(symbols[:lead], at)] if lead else []
    for c in codes[:lead][::-1].tolist():
        total += int(cost[at, c])
        at = int(one[at, c])
    total += vectors[at][START]
    pieces += [(symbols[lead + i * BLOCK : lead + (i + 1) * BLOCK], v) for i, v in enumerate(behind)]
    plan, state = [], START
    for piece, last in pieces:
        costs = [vectors[last]]
        for s in reversed(piece):
            costs.append(before(s, costs[-1]))
        costs.reverse()
        for i, s in enumerate(piece):
            state = _followed(plan, state, costs[i], costs[i + 1], s)
    while state not in ENDS:
        state = MADE[state]
        plan.append(PLAN[state][0])
    return total, "".join(plan)


def _followed(plan: list[str], state: int, here: tuple[int, ...], after: tuple[int, ...], symbol: str) -> int:
    """Adds the letters up to and with the one that takes the row; the state behind it."""
    must_go, late = symbol in "bd", TRUNCATED * symbol.isupper()
    while True:
        if DELETE + after[state] == here[state]:
            plan.append("D")
            return state
        made = MADE[state]
        if INSERT + here[made] == here[state]:
            plan.append(PLAN[made][0])
            state = made
            continue
        kept = READ[symbol.lower()].get(state) if not must_go else None
        if kept is not None and KEEP + late + after[kept] == here[state]:
            plan.append("K")
            return kept
        plan.append(PLAN[made][1])
        return made


@F.pandas_udf(T.StructType().add("cost", T.LongType()).add("plans", T.ArrayType(T.StringType())))
def planned(parts: pd.Series) -> pd.DataFrame:
    """The plan of a conversation, cut where its segments end; the last part has what is inserted at the end."""
    out = []
    for symbols in parts:
        cost, plan = repair_plan("".join(symbols))
        takes = np.flatnonzero(~np.isin(np.frombuffer(plan.encode(), np.uint8), np.frombuffer(b"ua", np.uint8))) + 1
        ends = np.cumsum([len(s) for s in symbols])
        cuts = [0, *[int(takes[e - 1]) for e in ends[:-1]], len(plan)]
        out.append((cost, [plan[a:b] for a, b in zip(cuts, cuts[1:])]))
    return pd.DataFrame(out, columns=["cost", "plans"])


def segments(turns: DataFrame) -> DataFrame:
    """Rows of a conversation in parts of SEGMENT turn numbers: __null, __conv, __seg, `rows`, `symbols`.

    `rows` are in order of turn (nulls first), role and text.  A row is a duplicate if its role and text were seen
    earlier in the whole conversation: the first turn of every repeated pair is found by a grouped minimum, which needs
    no order, and joined back.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select(
        F.col("conv_id").isNull().alias("__null"),
        F.coalesce(F.col("conv_id"), F.lit(0)).alias("__conv"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("__digest"),
    )
    turn = F.struct(F.col("turn").isNotNull().alias("is"), "turn")
    seen = rows.groupBy("__null", "__conv", "__digest").agg(F.min(turn).alias("__first"), F.count(F.lit(1)).alias("__n"))
    seen = seen.filter("__n > 1").drop("__n")
    rows = rows.join(seen, ["__null", "__conv", "__digest"], "left")
    later = F.coalesce(turn > F.col("__first"), F.lit(False))
    # Turns without a number stand before all others, in a part of their own.
    part = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))
    listed = rows.groupBy("__null", "__conv", part.alias("__seg")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", later.alias("later")))).alias("rows")
    )

    def symbol(r: Column, i: Column) -> Column:
        earlier = F.get("rows", i - 1)
        same = (i > 0) & earlier["turn"].eqNullSafe(r["turn"]) & (earlier["role"] == r["role"]) & (earlier["text"] == r["text"])
        initial = F.when(F.substring(r["role"], 1, 1).isin("s", "u", "a"), F.substring(r["role"], 1, 1)).otherwise("o")
        whole = r["text"].rlike(r"[.!?][\x20\x09-\x0D]*\z")
        fault = F.when(~r["text"].rlike(r"[^\x20\x09-\x0D]"), "b").when(r["later"] | same, "d").when(~whole, "t").otherwise("")
        return F.concat(initial, F.rpad(fault, 1, " "))

    return listed.withColumn("symbols", F.array_join(F.transform("rows", symbol), ""))


def repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, parts): what was found and done in each conversation, and its repaired turns part by part.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  parts: conv_id, part, `turns`, an
    array of (op, role, text) in order, of parts that rise by `part`.  A null role or text counts as one space, a
    null conv_id is a conversation, null turns come first, equal turns go by role and text, and repeated rows are
    duplicates.  An empty role counts as a role of its own that cannot stay.

    A part holds at most the rows of SEGMENT turn numbers, so a conversation with a large share of all rows is spread
    over many tasks with its texts.  Only its symbols meet, two characters a row, which is the size of the audit asked for.
    """
    found = segments(turns)
    keys = ["__null", "__conv"]
    number = lambda r: r["turn"]
    narrow = found.select(
        *keys,
        "__seg",
        "symbols",
        F.array_max(F.transform("rows", number)).alias("high"),
        F.array_min(F.transform("rows", number)).alias("low"),
        F.size(F.array_distinct(F.filter(F.transform("rows", number), lambda t: t.isNotNull()))).alias("distinct"),
    )
    whole = narrow.groupBy(*keys).agg(
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("distinct").alias("distinct"),
        F.array_sort(F.collect_list(F.struct("__seg", "symbols"))).alias("parts"),
    )
    whole = whole.withColumn("all", F.array_join(F.col("parts.symbols"), ""))
    initials = F.regexp_replace("all", "(.).", "$1")
    whole = whole.withColumn("initials", initials)

    def letters(s: Column) -> Column:
        """One letter a row: a capital if it is truncated, b or d if it must go."""
        s = F.regexp_replace(F.regexp_replace(s, ".([bd])", "$1"), "(.)t", "$1^")
        for letter in "suao":
            s = F.replace(s, F.lit(f"{letter}^"), F.lit(letter.upper()))
        return F.replace(s, F.lit(" "), F.lit(""))

    whole = whole.withColumn("codes", F.transform(F.col("parts.symbols"), letters))
    whole = whole.withColumn("p", planned("codes"))
    plan = F.array_join(F.col("p.plans"), "")
    tally = lambda fault: F.regexp_count("all", F.lit(f".{fault}")).cast("long")
    pairs = F.greatest(F.length("initials") - 1, F.lit(0)) - F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    conversations = whole.select(
        F.when(~F.col("__null"), F.col("__conv")).alias("conv_id"),
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long").alias("gaps"),
        tally("b").alias("blank"),
        tally("d").alias("duplicate"),
        tally("t").alias("truncated"),
        pairs.cast("long").alias("illegal"),
        F.col("p.cost").alias("cost"),
        F.translate(plan, "xyua", "RRII").alias("audit"),
    )
    plans = whole.select(*keys, F.explode(F.arrays_zip(F.col("parts.__seg").alias("seg"), F.col("p.plans").alias("plan"))).alias("z"))
    plans = plans.select(*keys, F.col("z.seg").alias("__seg"), F.col("z.plan").alias("plan"))
    done = found.join(plans, [*keys, "__seg"])

    def made(letters: Column) -> Column:
        """Inserted turns."""
        return F.transform(
            F.filter(F.split(letters, ""), lambda c: c != ""),
            lambda c: F.struct(F.lit("I").alias("op"), F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")),
        )

    def turn(step: Column, row: Column) -> Column:
        """What one row becomes, behind what is inserted before it."""
        last = F.right(step, F.lit(1))
        role = F.when(last == "x", "user").when(last == "y", "assistant").otherwise(row["role"])
        own = F.struct(F.when(last == "K", "K").otherwise("R").alias("op"), role.alias("role"), row["text"].alias("text"))
        kept = F.when(last == "D", F.array().cast("array<struct<op:string,role:string,text:string>>")).otherwise(F.array(own))
        return F.concat(made(F.substring(step, F.lit(1), F.length(step) - 1)), kept)

    steps = F.regexp_extract_all("plan", F.lit("([ua]*[KDxy])"), F.lit(1))
    stays = F.concat(F.flatten(F.zip_with(steps, F.col("rows"), turn)), made(F.regexp_extract("plan", "([ua]*)$", 1)))
    return conversations, done.select(F.when(~F.col("__null"), F.col("__conv")).alias("conv_id"), F.col("__seg").alias("part"), stays.alias("turns"))


def damaged(turns: DataFrame) -> DataFrame:
    """Seeded damage to test a repair: rows dropped, emptied, without their stops, repeated, or given to the user.

    The draw is crc32 of "conv_id:turn" modulo 20, a null being one space.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("__d", draw).filter("__d <> 0")
    text = F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("__d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("__d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("__c")).drop("__c")
