"""Fill-in-middle, conversation repair and personal data against plain Python."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import fill_middle, private_data, queries, turn_repair

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in middle -----------------------------------------------------------------------------------------------


def fim_by_hand(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "<P>", "x <M> y", "<", "<P", "M>", "é ünï 漢字 \U0001f600ab", "\n\n", "word " * 30_000, "ab" * 80_000, "1" * 70_000]
    texts += ["".join(rng.choice("ab <PSM>é\n1") for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "null id text"), (7, "again"), (7, "again")]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")))
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(map(str, ((i, *fim_by_hand(i, t), t or "") for i, t in rows)))
    assert sorted(map(str, map(tuple, got))) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_boundary_set():
    """Every container form, and sets that span several containers."""
    rng = np.random.default_rng(2)
    cases = [np.arange(200_000), np.arange(0, 300_000, 2), np.sort(rng.choice(400_000, 9_000, replace=False)), np.array([0]), np.array([65_535, 65_536])]
    cases.append(np.concatenate([np.arange(70_000), np.arange(70_001, 140_000, 7), np.arange(200_000, 265_000, 3)]))
    forms = set()
    for values in cases:
        found = fill_middle.BoundarySet(values)
        forms |= {type(c).__name__ for c in found.containers}
        assert found.size == len(values)
        assert [found.select(int(r)) for r in range(0, len(values), 97)] == values[::97].tolist()
        assert found.select(len(values) - 1) == values[-1]
    assert forms == {"ArrayContainer", "BitmapContainer", "RunContainer"}
    text = "ab c,dé\n  Zz9"
    assert np.diff(fill_middle.boundaries(text)).tolist() == [len(t) for t in re.findall("[A-Za-z]+|[^A-Za-z]", text)]


# --- conversation repair ------------------------------------------------------------------------------------------


def cheapest(symbols):
    """(cost, audit) by a forward search that keeps the least (cost, audit) of every state."""
    r = turn_repair

    def opened(ways):
        ways = dict(ways)
        for _ in range(4):
            for q, (c, a) in list(ways.items()):
                ways[r.MADE[q]] = min(ways.get(r.MADE[q], (c + 3, "")), (c + 2, a + "I"))
        return ways

    ways = {r.START: (0, "")}
    for s in symbols:
        following = {}
        for q, (c, a) in opened(ways).items():
            options = [(q, (c + 3, a + "D"))]
            if s not in "bd":
                options.append((r.MADE[q], (c + 2 + s.isupper(), a + "R")))
                if q in r.READ[s.lower()]:
                    options.append((r.READ[s.lower()][q], (c + s.isupper(), a + "K")))
            for to, way in options:
                following[to] = min(following.get(to, way), way)
        ways = following
    return min(way for q, way in opened(ways).items() if q in r.ENDS)


def test_repair_plan():
    rng = random.Random(3)
    cases = ["".join(s) for n in range(4) for s in itertools.product(turn_repair.SYMBOLS, repeat=n)]
    cases += ["".join(rng.choice(turn_repair.SYMBOLS) for _ in range(rng.randrange(50))) for _ in range(400)]
    for symbols in cases:
        cost, plan = turn_repair.repair_plan(symbols)
        assert (cost, plan.translate(str.maketrans("xyua", "RRII"))) == cheapest(symbols)
        assert re.fullmatch("(s?(ua)+)?", "".join("" if p == "D" else "ua"["ay".find(p) >= 0] if p in "uaxy" else symbols_kept(symbols, plan, i) for i, p in enumerate(plan)))


def symbols_kept(symbols, plan, at):
    return symbols[sum(p in "KDxy" for p in plan[:at])].lower()


def repaired_by_hand(rows):
    """The contract's row of one conversation from its rows after damage, already in order."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", sha("")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults, initials = set(), [], []
    for _, role, text in rows:
        body = text.strip(" \t\n\r\v\f")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        initials.append(role[0] if role[:1] in ("s", "u", "a") and role else "o")
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    symbols = "".join(f if f in ("b", "d") else i.upper() if f else i for i, f in zip(initials, faults))
    cost, audit = cheapest(symbols)
    out, at = [], 0
    lead = 0
    for op in audit:
        if op == "I":
            out.append(("?", ""))
            continue
        _, role, text = rows[at]
        if op == "K":
            lead |= not out and initials[at] == "s"
            out.append((role, text))
        elif op == "R":
            out.append(("?", text))
        at += 1
    said = [(("user", "assistant")[(i - lead) % 2] if role == "?" else role) + ":" + text for i, (role, text) in enumerate(out)]
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha("\n".join(said))


def hurt(rows):
    for conv, turn, role, text in rows:
        draw = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        for _ in range((draw != 0) + (draw == 3)):
            yield conv, turn, role, text


def test_turn_repair(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "umpire"])
            rows.append((conv, rng.choice([turn, turn * 7, None]), role, rng.choice(["a.", "b", " \n", None, "", "Yes! ", "long " * 40 + "end?"])))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t % 1500}.") for t in range(4000)]  # several segments, repeats across them
    rows += [(501, None, "user", "same.")] * 30 + [(502, -5, "user", "x."), (502, 3_000_000_000, "assistant", "y.")]
    df = spark.createDataFrame(rows, TURNS).withColumn("extra", F.lit(1)).withColumn("rows", F.lit("clash"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    after = list(hurt(rows))
    for conv in got:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[conv] == repaired_by_hand(mine), conv
    none = spark.createDataFrame([], TURNS)
    assert [df.count() for df in turn_repair.repaired(none)] == [0, 0]


# --- personal data ------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        check = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and check % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_by_hand(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if counts(k, m.group())]


def test_plain_identifiers():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1@.-+ %9_0(é") for _ in range(rng.randrange(40))) for _ in range(20_000)]
    texts += ["4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (415) 555-0199 001.002.003.255 1.2.3.256 1.2.3.4.5.6.7.8", "a@b a@b.c@d.e x@y.z."]
    for text in texts:
        assert [s[:3] for s in private_data.find_private(text) if s[3]] == plain_by_hand(text), text
    assert private_data.find_private(None) == private_data.find_private("") == []


DISGUISED = [
    ("john dot smith at example dot com", "email", "john.smith@example.com"),
    ("john [at] example [dot] com", "email", "john@example.com"),
    ("john(at)example.com", "email", "john@example.com"),
    ("john_at_example_dot_org", "email", "john@example.org"),
    ("jоhn@exаmple.com", "email", "john@example.com"),  # Cyrillic letters
    ("ｊｏｈｎ＠example．com", "email", "john@example.com"),
    ("jo​hn@example.com", "email", "john@example.com"),
    ("plus one four one five five five five zero one nine nine", "phone", "+14155550199"),
    ("+1 four one five 555 oh one nine nine", "phone", "+14155550199"),
    ("one nine two dot one six eight dot one dot one", "ip", "192.168.1.1"),
    ("192[.]168[.]1[.]1", "ip", "192.168.1.1"),
    ("192 dot 168 dot 1 dot 1", "ip", "192.168.1.1"),
    ("١٩٢.١٦٨.١.١", "ip", "192.168.1.1"),
    ("four nine three four one nine nine nine zero four four two five four eight eight", "card", "4934199904425488"),
    ("4934 1999 O442 5488", "card", "4934 1999 0442 5488"),
    ("4934 1999 0442 5488", "card", "4934 1999 0442 5488"),
    ("vier neun drei vier 1999 0442 5488", "card", "49341999 0442 5488"),
]


@pytest.mark.parametrize("text, kind, value", DISGUISED)
def test_disguised_identifiers(text, kind, value):
    """The span is that of the source, wherever the text stands."""
    for before, after in (("", ""), ("Élan 漢字 — write to ", ", they said."), ("x\n", "\ny")):
        spans = [s for s in private_data.find_private(before + text + after) if not s[3]]
        assert (kind, len(before), len(before) + len(text), False, value) in spans


def test_no_false_identifiers(spark, sf):
    for text in [
        "we met at the dot product at home", "look at me at noon dot", "one two three four five", "call at example.com", "at the point of no return",
        "Ünïcödé été — naïve", "price @ 3.50", "zero one", "токен е55 а в", "seven eight nine ten, at last",
    ]:
        assert private_data.find_private(text) == [], text
    rows = queries.table(spark, sf, "documents").collect()
    assert not [s for r in rows for s in private_data.find_private(r.text) if not s[3]]


def test_private_data_query(spark, sf, tmp_path):
    texts = [None, "", *(t for t, _, _ in DISGUISED), "a@b.co " * 30_000, "9" * 200_000, "one " * 50_000, "john at a.b@example dot com"]
    df = spark.createDataFrame([*enumerate(texts), (None, "x@y.zz"), (3, texts[3])], DOCS).withColumn("found", F.lit("clash"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    by_id = dict(enumerate(texts))
    got = queries.op13(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = by_id.get(r.doc_id, "x@y.zz") or ""
        base = plain_by_hand(text) if "9999" not in text else []
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in PATTERNS]
        found = [s[:3] for s in private_data.find_private(text)]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in found) and set(base) <= set(found)
    empty = spark.createDataFrame([], DOCS)
    assert private_data.private_spans(empty, ["doc_id"]).count() == 0
    rows = private_data.private_spans(spark.createDataFrame([(1, "to jоhn@example.com or +1 415 555 0199é")], DOCS), ["doc_id", "text"])
    assert rows.select(private_data.masked(F.col("text"), F.col("found"))).first()[0] == "to [email] or [phone]é"
