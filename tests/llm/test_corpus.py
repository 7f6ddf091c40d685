"""Line and near duplicates, classifiers, mixing and the pipeline against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trajecta.llm import chat_format, exact_dedup, language_id, license_scan, line_dedup, mixing, order_minhash, queries
from trajecta.llm import sentencepiece_bpe, simhash, toxicity
from trajecta.llm.common import components, id_remainder

DOCS = "doc_id long, text string"


def classes_by_links(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    rng.shuffle(links)
    df = spark.createDataFrame([(b, a) for a, b in links] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    want = classes_by_links({n for pair in links for n in pair}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(df.limit(0), "a", "b").count() == 0


# --- lines --------------------------------------------------------------------------------------------------------


def shingles(line, k=line_dedup.SHINGLE):
    return {line[i : i + k] for i in range(len(line) - k + 1)} if len(line) >= k else {line}


def line_links(lines, threshold=0.8):
    sets = [shingles(x) for x in lines]
    for i, j in combinations(range(len(lines)), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b):
            yield lines[i], lines[j]


def test_line_classes_brute_force(spark, sf):
    """Recall of links against all pairs of the distinct lines, and no link that is not one."""
    docs = queries.table(spark, sf, "documents")
    first = {}
    for r in sorted(docs.collect()):
        for n, line in enumerate((r.text or "").split("\n")):
            if line.strip():
                first.setdefault(line, (r.doc_id, n))
    rows = line_dedup.line_classes(docs).collect()
    assert {(r.doc_id, r.line_no) for r in rows} == set(first.values())
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in rows}
    links = [(first[a], first[b]) for a, b in line_links(sorted(first, key=first.get))]
    want = classes_by_links(first.values(), links)
    assert all(want[n] == want[c] for n, c in got.items())
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links) and len(links) > 10
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc_id, r.class_line_no)) for r in rows)


def test_line_variants_and_output(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions {} beside the old stone bridge at dawn"
    variants = [base.format(f"{i:02d}") for i in range(60)]
    texts = ["\n".join(variants[:30]), "\n".join([*variants[30:], "", "short", "short"]), None, "", "日本語の長い行が続きます日本語の長い行が続きます。"]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in enumerate(texts)], DOCS + ", line string, line_id string")
    rows = line_dedup.line_classes(df).collect()
    assert {(r.class_doc_id, r.class_line_no) for r in rows} == {(0, 0), (1, 31), (4, 0)} and len(rows) == 62
    out = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(df).collect()}
    assert out == {0: variants[0], 1: "\nshort", 2: None, 3: "", 4: texts[4]}


def test_band_recall_by_kind_of_line(spark):
    """Pairs with a Jaccard index of at least 0.8 share a band, whatever the separators, lengths and place of the edit."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    kinds = {"solid": [], "long words": [], "five words": [], "around the bound": []}
    while min(map(len, kinds.values())) < 300:
        solid, five = word(120), [word(rng.randrange(8, 13)) for _ in range(5)]
        at, wide = rng.randrange(10), [word(rng.randrange(30, 60)) for _ in range(4)]
        flip = rng.randrange(150)
        made = {
            "solid": (solid, solid[:at] + "0" + solid[at + 1 :]),
            "long words": (" ".join(wide), " ".join(wide)[:flip] + "0" + " ".join(wide)[flip + 1 :]),
            "five words": (" ".join(five), " ".join([*five, word(rng.randrange(3, 9))])),
            "around the bound": ((line := word(rng.randrange(60, 72))), line + word(rng.randrange(1, 14))),
        }
        for kind, (a, b) in made.items():
            if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
                kinds[kind].append((kind, a, b))
    rows = [r for found in kinds.values() for r in found[:300]]
    df = spark.createDataFrame(rows, "kind string, a string, b string")
    for shape, distinct in [(line_dedup.COARSE, False), (line_dedup.FINE, True)]:
        signed = [line_dedup.with_bands(df, c, shape, distinct).withColumnRenamed("bands", f"of_{c}").drop("n") for c in "ab"]
        both = signed[0].join(signed[1], ["kind", "a", "b"])
        got = Counter(r.kind for r in both.filter(F.arrays_overlap("of_a", "of_b")).collect())
        assert all(got[kind] >= 0.99 * 300 for kind in kinds), (shape, got)


def test_links_in_open_bands(spark):
    """Lines that share a long passage meet in every band; only those whose other halves are alike are linked."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, lines = text(160), []
    for n in range(90):
        own = text(120)
        lines += [common + own, common + own[:60] + rng.choice("xyz") + own[61:]]
    order = rng.sample(range(len(lines)), len(lines))
    df = spark.createDataFrame([(i, lines[j]) for i, j in enumerate(order)], "line_id long, line string")
    pairs = {tuple(sorted((order.index(2 * i), order.index(2 * i + 1)))) for i in range(90)}
    for shape in [(20, 3), line_dedup.FINE]:
        got = classes_by_links(range(len(lines)), [(r.a, r.b) for r in line_dedup.line_links(df, 0.8, shape).collect()])
        assert all(got[a] == got[b] for a, b in pairs) and len(set(got.values())) == 90
    placed = spark.createDataFrame([(i, i // 3) for i in range(len(lines))], "line_id long, class long")
    sized = line_dedup.with_bands(df, "line", (2, 2)).drop("bands")
    met = {(r.a, r.b) for r in line_dedup.across_classes(placed, sized, 0.8).collect()}
    assert {(a, b) for a, b in pairs if a // 3 != b // 3} <= met and len(met) < 3 * len(pairs)


# --- SimHash ------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def test_simhash_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    prints = {i: plain_simhash(t) for i, t in docs.items()}
    links = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = classes_by_links(prints, links)
    rows = queries.op8(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_covering_code_finds_every_pair(spark):
    """All pairs at distance 1 and 2 of fingerprints with flips in every position, none at distance 3."""
    tables = simhash.covering_table(2)
    assert (np.diff(tables[0][0]) == 1).all()
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 12, dtype=np.int64)
    values = set(base.tolist())
    for b in base.tolist():
        for i, j in [(rng.integers(64), rng.integers(64)) for _ in range(40)] + [(k, k) for k in range(64)]:
            flipped = (b ^ (1 << int(i))) if i == j else b ^ (1 << int(i)) ^ (1 << int(j))
            values.add((flipped & (2**64 - 1)) - (1 << 64) if flipped & (1 << 63) else flipped & (2**64 - 1))
    values = sorted(values)
    df = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "fp long, rep long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in simhash.links(df).collect())
    bits = [v & (2**64 - 1) for v in values]
    assert got == [(i, j) for i, j in combinations(range(len(values)), 2) if (bits[i] ^ bits[j]).bit_count() <= 2]


# --- classifiers --------------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r.doc_id: r for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op2(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_texts(spark):
    learn = queries.table(spark, SF, "documents")
    model = language_id.fit(learn)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (None, "и"), (2**60 + 1, "the thing and that of the")], DOCS)
    rows = {r.doc_id: r for r in language_id.classify(df, model, ["doc_id"]).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[None].lang_pred != "und" and rows[2**60 + 1].lang_pred == "en"
    nothing = language_id.fit(learn.limit(0))
    assert nothing is None and {r.lang_pred for r in language_id.classify(df, nothing, ["doc_id"]).collect()} == {"und"}


def test_language_weights_equal_kernel_form():
    """The multiplied-out weights give the regression values of the kernel written out."""
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(np.arange(c * 20, c * 20 + 60), 25, replace=False)).astype(np.int32) for c in (0, 1, 2) for _ in range(12)]
    langs = np.repeat(["a", "b", "c"], 12)
    landmarks = [0, 1, 2, 12, 13, 14, 24, 25, 26]
    vocabulary, projection = language_id.landmark_map([sets[i] for i in landmarks])
    weights = language_id.ridge(np.array([language_id.features(s, vocabulary, projection) for s in sets]), langs, ["a", "b", "c"])
    weights = np.vstack([projection @ weights[:-1], weights[-1:]])
    k = lambda x, y: len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y))
    km = np.array([[k(sets[i], sets[j]) for j in landmarks] for i in landmarks])
    kn = np.array([[k(s, sets[j]) for j in landmarks] for s in sets])
    values, vectors = np.linalg.eigh(km)
    features = np.hstack([kn @ vectors / np.sqrt(values), np.ones((36, 1))])
    y = np.where(langs[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    ridge = language_id.RIDGE * 36 * np.diag([1] * 9 + [0])
    plain = features @ np.linalg.solve(features.T @ features + ridge, features.T @ y)
    ours = [weights[:-1][language_id.known(s, vocabulary)].sum(0) / np.sqrt(len(s)) + weights[-1] for s in sets]
    assert np.allclose(plain, ours)


SCRIPTS = {"el": (0x3B1, 24), "ru": (0x430, 32), "ar": (0x627, 30), "th": (0xE01, 40), "ko": (0xAC00, 900), "hi": (0x904, 60), "zh": (0x4E00, 800), "en": (0x61, 26)}


def test_language_scripts_and_many_labels(spark):
    """Eight scripts and 70 Latin languages: no letter and no label is left out."""
    rng = random.Random(12)
    rows = []
    words = {name: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randrange(2, 5))) for _ in range(60)] for name, (a, n) in SCRIPTS.items()}
    words |= {f"l{i}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 6))) for _ in range(40)] for i in range(70)}
    for name, known in words.items():
        rows += [(len(rows) + i, ("" if name in ("zh", "th") else " ").join(rng.choices(known, k=60)), name) for i in range(16)]
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language_id.fit(df.filter(id_remainder("doc_id", 4) != 2))
    assert set(model["names"]) == set(words)
    truth = {r[0]: r[2] for r in rows}
    held = language_id.classify(df.filter(id_remainder("doc_id", 4) == 2), model, ["doc_id"]).collect()
    by_kind = defaultdict(list)
    for r in held:
        by_kind[truth[r.doc_id] if truth[r.doc_id] in SCRIPTS else "latin"].append(r.lang_pred == truth[r.doc_id])
    assert all(sum(v) >= 0.95 * len(v) for v in by_kind.values()) and len(by_kind) == 9, {k: (sum(v), len(v)) for k, v in by_kind.items()}
    assert language_id.gram_codes("é1é", language_id.Letters()).tolist() == sorted({234, 1, 234 << 21 | 1, 1 << 21 | 234, (234 << 21 | 1) << 21 | 234})


def test_toxicity_held_out(spark):
    """Of the held-out rows few clean ones are marked and most toxic ones are (some say nothing toxic any more)."""
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").collect()}
    rows = queries.op9(spark, folder).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    toxic = [r.predicted for r in held if truth[r.doc_id]]
    clean = [r.predicted for r in held if not truth[r.doc_id]]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean) and len(toxic) > 50


def test_toxicity_copies_count_once():
    rng = np.random.default_rng(6)
    texts = [np.unique(rng.integers(0, 1 << 20, 60)).astype(np.int32) for _ in range(30)]
    copies = [np.unique(np.r_[texts[0][:-3], rng.integers(0, 1 << 20, 3)]).astype(np.int32) for _ in range(9)]
    share = toxicity.copy_shares(texts + copies + [np.zeros(0, np.int32)])
    assert np.allclose(share[[0, *range(30, 39)]], 0.1) and np.allclose(share[[*range(1, 30), 39]], 1)
    label = np.array([1.0] + [0.0] * 29 + [1.0] * 9 + [0.0])
    assert not len(toxicity.screened(texts + copies + [np.zeros(0, np.int32)], label, share))


def test_machine_learns_pairs():
    """Terms that matter only together: no additive weights can tell these rows apart."""
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 50, np.float32)
    y = np.array([1, 0, 0, 1] * 50, float)
    bias, linear, factors = toxicity.train(x, y, np.ones(200))
    assert ((toxicity.machine(x, bias, linear, factors) > 0) == (y == 1)).all()
    brute = [bias + linear @ r + sum(factors[i] @ factors[j] * r[i] * r[j] for i, j in combinations(range(2), 2)) for r in x[:4]]
    assert np.allclose(brute, toxicity.machine(x[:4], bias, linear, factors), atol=1e-6)


def test_toxicity_of_pairs_among_other_terms(spark):
    """Toxic texts hold both terms or neither, clean ones just one; every term is as frequent in both classes."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        first, second = i % 2, i // 2 % 2
        words = [f"w{rng.randrange(400)}" for _ in range(30)] + ["insult"] * first + ["group"] * second
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(first == second)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.filter("doc_id % 5 <> 0"))
    said = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i, _ in rows if i % 5 == 0]
    assert sum(said[i] == bool(labels[i][1]) for i in held) >= 0.95 * len(held)


def test_pair_screen_brute_force():
    """What a pair adds to the likelihood ratio, counted cell by cell."""
    rng = np.random.default_rng(8)
    n = 400
    a, b, c = (rng.random(n) < 0.5 for _ in range(3))
    toxic = np.where(rng.random(n) < 0.9, a == b, a != b).astype(float)
    sets = [np.array([t for t, on in ((3, a[i]), (9, b[i]), (20, c[i])) if on], np.int32) for i in range(n)]
    share = np.ones(n)

    def ratio(cells):
        base, total = toxic.mean(), 0.0
        for cell in cells:
            m, t = cell.sum(), toxic[cell].sum()
            total += sum(2 * x * np.log(x / (m * q)) for x, q in ((t, base), (m - t, 1 - base)) if x)
        return total

    level = 2 * np.log(3 / toxicity.CHANCE) + 2
    want = set()
    for (i, x), (j, y) in combinations([(3, a), (9, b), (20, c)], 2):
        added = ratio([x & y, x & ~y, ~x & y, ~x & ~y]) - ratio([x, ~x]) - ratio([y, ~y])
        want |= {i, j} if added >= level else set()
    assert set(toxicity.screened_pairs(sets, toxic, share).tolist()) == want == {3, 9}
    assert not len(toxicity.screened_pairs([], toxic[:0], share[:0])) and not len(toxicity.screened_pairs(sets, np.zeros(n), share))


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], DOCS)
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model is None and [r.score for r in toxicity.score(df, model, ["doc_id"]).collect()] == [0.0, 0.0]
    model = toxicity.fit(df, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, toxic int"))
    assert len(toxicity.score(df, model, ["doc_id"]).collect()) == 2


# --- mixing -------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    weights, total = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}, sum(sizes.values())
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[s] for s in free) if free else 0
        above = {s: 3.0 * sizes[s] for s in free if level * weights[s] > 3.0 * sizes[s]}
        if not above:
            return fixed | {s: level * weights[s] for s in free}
        fixed |= above


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "b", "b", "Z", "é", None]), " ".join(["w"] * rng.choice([0, 1, 5, 40]))) for i in range(800)]
    rows += [(900, "tiny", "one two"), (901, "none", ""), (902, "none", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, size string")
    got = mixing.mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert mixed == Counter({r.doc_id: r.repeats for r in got if r.repeats})


def test_mixing_leaves_empty_documents_at_the_cap(spark):
    """Where a source is taken as often as it may be, a document of no words is not taken once more."""
    rows = [(i, "w " * 50, "big") for i in range(40)] + [(100 + i, "" if i < 30 else "w", "small") for i in range(40)]
    df = spark.createDataFrame(rows, DOCS + ", source string")
    made = mixing.mix(df, weights=(1, 9)).collect()
    assert max(r.repeats for r in made) <= 3 and all(r.repeats == 3 for r in made if r.source == "small")
    assert max(Counter(r.doc_id for r in mixing.mixed_documents(df, weights=(1, 9)).collect()).values()) <= 3


# --- everything ---------------------------------------------------------------------------------------------------

OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "line_classes": line_dedup.line_classes,
    "licenses": license_scan.scan_licenses,
    "fingerprints": order_minhash.fingerprints,
    "near_duplicates": simhash.near_duplicates,
    "encode": sentencepiece_bpe.encode_texts,
    "mix": mixing.mix,
    "language": lambda d: language_id.identify(d, d, ["doc_id"]),
    "toxicity": lambda d: toxicity.score(d, None, ["doc_id"]),
    "chat": lambda d: chat_format.format_conversations(d.withColumnRenamed("doc_id", "conv_id")),
    "plan": lambda d: mixing.mixing_plan(d.select("doc_id", "source", F.lit(1).alias("size"))),
}
CLASHES = "size string, key string, rep string, component_id string, target string, lang_pred string, fp string, role string, turn int"


def odd_documents(spark):
    texts = [None, "", " \n\t ", "a", "a", "Aa bb. " * 30_000, "é" * 50_000, "日本\n語", "<turn>### \\", "1", "a\u0000b"]
    rows = [(i if i != 3 else None, t, ["en", None, "de"][i % 3], ["s", None][i % 2], 1, *"abcdefgh", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:5] + [(2**62, None, None, None, None, *[None] * 9)], f"{DOCS}, lang string, source string, n_chars long, {CLASHES}")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    df = odd_documents(spark)
    rows = OPERATORS[name](df).collect()
    if name not in ("line_classes", "chat", "plan"):
        assert len(rows) == 14
    assert OPERATORS[name](df.limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_in_stages(spark, stage):
    name, fn = corpus_pipeline.STAGES[stage]
    df = odd_documents(spark)
    out = fn(spark, df, None)
    assert name == "sentencepiece" or out.columns == df.columns
    out.collect()
    assert fn(spark, df.limit(0), None).collect() == []


def test_stages_decide(spark, sf):
    """Texts in no learned language go and clean ones stay; of two texts under one id only the near copy goes."""
    rng = random.Random(3)
    docs = queries.table(spark, sf, "documents")
    letters = lambda a, n: "".join(chr(a + rng.randrange(n)) for _ in range(5))
    odd = [" ".join(letters(0x61, 26) for _ in range(150)) for _ in range(10)] + [" ".join(letters(0x430, 32) for _ in range(150)) for _ in range(10)]
    row = docs.first()
    planted = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate([*odd, "12 34", ""])], docs.schema)
    kept = corpus_pipeline.by_language(spark, docs.unionByName(planted), sf)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}
    base = " ".join(f"word{i}" for i in range(400))
    texts = [(1, base), (2, base + " x"), (2, row.text), (3, base + " y"), (None, base)]
    some = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], docs.schema)
    left = corpus_pipeline.without_near_copies(spark, some, sf).collect()
    assert sorted((r.doc_id or 0, r.text[:8]) for r in left) == sorted([(0, base[:8]), (1, base[:8]), (2, row.text[:8])])


def test_pipeline_brute_force(spark, sf):
    docs = {r.doc_id: r for r in queries.table(spark, sf, "documents").collect()}
    wanted = sorted(docs)
    model = language_id.fit(queries.table(spark, sf, "documents").filter(id_remainder("doc_id", 4) != 2))
    said = {r.doc_id: r for r in language_id.classify(queries.table(spark, sf, "documents"), model, ["doc_id"], grams="g").collect()}
    floor = language_id.score_without_evidence(model) + corpus_pipeline.MARGIN
    kept = [i for i in wanted if said[i].lang_pred != "und" and not (said[i].g >= corpus_pipeline.EVIDENCE and said[i].score < floor)]
    assert {i for i in wanted if said[i].lang_pred == "und"} == {i for i in wanted if not any(c.isalpha() for c in docs[i].text or "")}
    last = {docs[i].text or "": i for i in kept}
    kept = sorted(last.values())
    prints = {i: plain_simhash(docs[i].text) for i in kept}
    near = classes_by_links(kept, [(a, b) for a, b in combinations(kept, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    kept = sorted(set(near.values()))
    sizes = Counter()
    for i in kept:
        sizes[docs[i].source] += len((docs[i].text or "").split())
    want = plain_targets(sizes)
    rows = corpus_pipeline.run(spark, sf).collect()
    times, taken = Counter(r.doc_id for r in rows), Counter()
    assert set(times) <= set(kept) and max(times.values()) <= 3
    for i, n in times.items():
        taken[docs[i].source] += n * len(docs[i].text.split())
    most = max(len((docs[i].text or "").split()) for i in kept)
    assert all(abs(taken[s] - want[s]) <= most / 2 + 1 for s in sizes)
    assert all(r.lossless for r in rows)
