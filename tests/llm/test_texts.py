"""Fingerprints, licences, chat formatting, encoding and exact duplicates against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trajecta.llm import chat_format, exact_dedup, license_scan, order_minhash, queries, sentencepiece_bpe

DOCS = "doc_id long, text string"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], DOCS)


# --- exact duplicates -----------------------------------------------------------------------------------------


def test_exact_dedup_brute_force(spark):
    rng = random.Random(1)
    texts = [rng.choice(["a" * 70 + x for x in "pqr"] + ["", None, "b", "é", "longer text"]) for _ in range(200)]
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(texts)
    for ids in groups.values():
        for i in ids:
            assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(ids), len(ids), i == max(ids))


def test_exact_dedup_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "z"), (2, "b")], DOCS)
    rows = exact_dedup.exact_dedup(df, with_text=True).collect()
    assert sorted((r.text, r.kept) for r in rows) == [("a", False), ("a", False), ("a", True), ("b", True), ("z", True)]
    assert {r.group_size for r in rows if r.text == "a"} == {3}


# --- order MinHash ----------------------------------------------------------------------------------------------


def plain_order_minhash(text, k=5, size=2, slots=64):
    full, base, step = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    seen, points = {}, []
    for pos in range(max(1, len(text) - k + 1)):
        h = 0
        for c in text[pos : pos + k]:
            h = (h * base + ord(c) + 1) & full
        occurrence = seen[h] = seen.get(h, -1) + 1
        points.append((mix((mix(h) + occurrence * step) & full), pos))
    ranked, out = sorted(points), []
    for b in range(slots):
        start = next((i for i, p in enumerate(ranked) if p[0] >= (b << 64) // slots), len(ranked))
        chosen = sorted((ranked[(start + t) % len(ranked)] for t in range(size)), key=lambda p: p[1])
        h = 0
        for key, _ in chosen:
            h = mix((h * base + key) & full)
        out.append(h & 0xFFFF)
    return out


def test_order_minhash_brute_force(spark):
    rng = random.Random(2)
    texts = ["", "one", "one two", " lead  and\ttrail \n", "x " * 90, "a b a b a b a b c"]
    texts += [" ".join(rng.choice(["to", "be", "or", "not", "so"]) for _ in range(n)) for n in (5, 17, 120, 400)]
    texts += ["abcde", "abcdef", "\U0001d465\U0001d466é日本語" * 9, "\U0001d465\U0001d466\U0001d467a", "line\nbreaks\n\n" * 30]
    got = docs_of(spark, texts).select("doc_id", order_minhash.order_minhash(F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert [list(r.s) for r in got] == [plain_order_minhash(t) for t in texts]


def test_order_minhash_sees_order(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[100:] + words[:100]), " ".join(words[:190]), " ".join(f"v{i}" for i in range(200))]
    sig = [r.s for r in docs_of(spark, texts).select("doc_id", order_minhash.order_minhash(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    like = [sum(a == b for a, b in zip(sig[0], s)) / 64 for s in sig]
    assert like[0] == 1 and like[2] > 0.7 and like[2] > like[1] > like[3] == 0


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这为之大来以个中上们", "word "])
def test_order_minhash_falls_with_the_share_edited(spark, alphabet):
    """Texts without white space too: the more of the text is replaced, the less alike."""
    rng = random.Random(7)
    draw = (lambda n: "".join(f"{rng.randrange(10**6)} " for _ in range(n // 7))) if alphabet == "word " else lambda n: "".join(rng.choices(alphabet, k=n))
    shares, likes = [0.0, 0.05, 0.2, 0.5, 1.0], []
    pairs = []
    for share in shares:
        for _ in range(12):
            text = draw(2100)
            keep = len(text) - int(len(text) * share)
            pairs.append((text, text[:keep] + draw(2100)[: len(text) - keep]))
    sig = order_minhash.order_minhash
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.s for r in rows.select("i", order_minhash.likeness(sig(F.col("a")), sig(F.col("b"))).alias("s")).collect()}
    for at in range(len(shares)):
        likes.append(sum(got[at * 12 + j] for j in range(12)) / 12)
    assert likes[0] == 1 and likes == sorted(likes, reverse=True) and likes[1] > 0.7 and likes[3] > 0.05 and likes[4] < 0.03
    assert all(got[3 * 12 + j] > 0 for j in range(12))  # half unchanged


def test_order_minhash_small_edits(spark):
    """A changed character in every third word leaves a likeness."""
    words = [f"word{i * 37 % 1009}" for i in range(400)]
    near = [w[:-1] + "x" if i % 3 == 0 else w for i, w in enumerate(words)]
    sig = [r.s for r in docs_of(spark, [" ".join(words), " ".join(near)]).select("doc_id", order_minhash.order_minhash(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert 0.1 < sum(a == b for a, b in zip(*sig)) / 64 < 0.9


@pytest.mark.parametrize("slice_rows", [1, 7, 20_000])
def test_next_document(spark, slice_rows):
    ids = random.Random(3).sample(range(10**12), 150)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], DOCS)
    got = {r.doc_id: r.next_text for r in order_minhash.with_next(df, "doc_id", ["text"], slice_rows).collect()}
    ordered = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(ordered, ordered[1:] + ordered[:1])}


def test_next_document_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "n"), (5, "b"), (5, "a"), (9, None)], DOCS)
    got = sorted((str(r.doc_id), str(r.text), str(r.next_text)) for r in order_minhash.with_next(df, "doc_id", ["text"]).collect())
    assert got == [("5", "a", "b"), ("5", "b", "None"), ("9", "None", "n"), ("None", "n", "a")]


def test_fingerprint_query_edits(spark, sf):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    ids = sorted(docs)
    rows = queries.op4(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text, following = docs[r.doc_id], docs[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:04x}" for x in plain_order_minhash(text))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in rows) > 0.8 * len(rows)


# --- licences ---------------------------------------------------------------------------------------------------


def scan(spark, texts):
    return [(r.licenses, r.unmatched) for r in license_scan.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()]


def test_license_rules(spark):
    bsd = [license_scan.SENTENCES[k][0] for k in ("bsd_intro", "bsd_source", "bsd_binary", "bsd_names")]
    wrapped = "prose\n\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above copyright notice\n * and this permission notice appear in all copies.\n"
    texts = [
        "Prose.\nLicensed under the Apache License, Version 2.0.\nMore. Released under the MIT License.",
        ". ".join(bsd) + ".",
        ". ".join(bsd[:3]) + ".",
        ". ".join(reversed(bsd[:3])) + ".",
        wrapped,
        "the mit license is popular",
        None,
        "",
    ]
    assert scan(spark, texts) == [
        ("Apache-2.0|MIT", 0),
        ("BSD-3-Clause", 0),
        ("BSD-2-Clause", 0),
        ("", 3),
        ("ISC", 0),
        ("", 0),
        ("", 0),
        ("", 0),
    ]


PUBLISHED = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
}


def test_published_headers(spark):
    """The headers as published, plain and in comments; all their known sentences are used."""
    marks = ["", " * ", "# ", "// ", ";; "]
    texts = [(name, "\n".join(["Copyright 2020 The Authors", "", *h.split("\n")]).replace("\n", f"\n{m}")) for name, h in PUBLISHED.items() for m in marks]
    found = scan(spark, [t for _, t in texts])
    assert found == [(name, 0) for name, _ in texts]


def test_short_license_forms(spark):
    texts = [
        "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;",
        "/* SPDX-License-Identifier: BSD-3-Clause */\n#include <a.h>",
        "# SPDX-License-Identifier: MIT\n\nimport os",
        "This project is licensed under the MIT License.",
        "Copyright 2020 Foo\nLicensed under the Apache License, Version 2.0\nSee LICENSE.",
        "This file is licensed under the Apache\nLicense, Version 2.0.",
    ]
    assert [x for x, _ in scan(spark, texts)] == ["GPL-2.0-or-later", "BSD-3-Clause", "MIT", "MIT", "Apache-2.0", "Apache-2.0"]


# --- chat -------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "system", "be\\1 kind"), (1, 1, "user", "a <b> # \\ \\0 \\2 </turn>\n<turn>### User: x"), (1, 2, "assistant", "ok: </turn>"),
        (1, 3, "user", ""), (1, 4, "assistant", None), (2, 0, "assistant", "first"), (2, 1, "odd: #role", "t"), (3, None, None, "n"),
        (4, 0, "user", "é\n\n"), (4, 1, "user", "again"), (None, 0, "user", "u"), (None, 1, "assistant", "v"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_conversations(df)
    rows = {r.conv_id: r for r in made.select("*", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("segments")).alias("l")).collect()}
    for conv in (1, 2, 3, 4, None):
        wanted = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        assert [tuple(t) for t in rows[conv].t] == wanted
        assert rows[conv].l == "".join(t for r, t in wanted if r == "assistant")
        assert rows[conv].formatted == "".join(s.text for s in rows[conv].segments)
        assert rows[conv].formatted.count("</turn>") == len(wanted)
    assert {c: (r.valid, r.first_wrong) for c, r in rows.items()} == {1: (True, None), 2: (False, 0), 3: (False, 0), 4: (False, 1), None: (True, None)}


# --- encoding ---------------------------------------------------------------------------------------------------

ODD = ["", " ", "   ", "a  b", " lead", "trail ", "tabs\tand\nlines\r\n", "▁mark ▁▁ marks▁", "日本語 テキスト", "emoji 😀👩‍👩‍👧 x", "\x00\x01", "<s> </s> <unk> <0x0A>", "word" * 500]


def texts_of(spark, sf):
    return [r.text for r in queries.table(spark, sf, "documents").collect()]


def test_no_dropout_equals_library(spark, sf):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    encoder = sentencepiece_bpe.Encoder(dropout=0.0)
    for text in texts_of(spark, sf) + [t for t in ODD if "▁" not in t]:
        assert encoder.encode(text).tolist() == sp.encode(text)


def test_dropout_is_lossless_seeded_and_varied(spark, sf):
    a, b, c = (sentencepiece_bpe.Encoder(seed=s) for s in (1, 1, 2))
    changed = 0
    for key, text in enumerate(texts_of(spark, sf) + ODD):
        ids = a.encode(text, key)
        assert ids.tolist() == b.encode(text, key).tolist() and a.decode(ids) == text
        changed += ids.tolist() != c.encode(text, key).tolist()
    assert changed > 150
    plain = sentencepiece_bpe.Encoder(dropout=0.0)
    text = " ".join(texts_of(spark, sf)[:20])
    assert len(a.encode(text)) > 1.02 * len(plain.encode(text))
    bare = sentencepiece_bpe.Encoder(dropout=1.0)
    assert bare.encode("abc").tolist() == [bare.pieces.ids[x] for x in "▁abc"]


def test_encode_texts(spark):
    df = docs_of(spark, [*ODD, None]).withColumn("ids", F.lit("clash"))
    rows = df.transform(sentencepiece_bpe.encode_texts).collect()
    assert len(rows) == len(ODD) + 1 and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)


def test_dropout_draws_anew_at_every_place():
    """Many segmentations of one word, each as the agenda with its own draws gives it, and the dropout met."""
    encoder = sentencepiece_bpe.Encoder(seed=3)
    found = {tuple(encoder.encode(f"{'a ' * n}internationalization", key).tolist()[n:]) for n in (0, 7) for key in range(100)}
    assert len(found) > 20
    text = " ".join(["internationalization"] * 100)
    one = encoder.encode(text, 5).tolist()
    keys = encoder.word_keys(5, 100).tolist()
    assert one == [i for k in keys for i in sentencepiece_bpe.merged("▁internationalization", encoder.pieces, encoder.limit, k)]
    assert encoder.encode(text, 5).tolist() == one != encoder.encode(text, 6).tolist()
    draws = [sentencepiece_bpe.skipped(k, a, b, encoder.limit) for k in keys for a in range(20) for b in range(a + 2, 21)]
    assert 0.09 < sum(draws) / len(draws) < 0.11
    long = "ab" * 300
    assert long not in encoder.memory and encoder.decode(encoder.encode(long)) == long and SPACED + long not in encoder.memory


def test_words_of_a_batch_are_merged_side_by_side(monkeypatch):
    """No word of usual length goes through the agenda for one word, which was most of the time; the results are its."""
    encoder, one_by_one = sentencepiece_bpe.Encoder(seed=3), sentencepiece_bpe.merged
    rng = random.Random(4)
    texts = ["", "a", *["".join(rng.choices("abe thingor\né😀", k=rng.randrange(1, 300))) for _ in range(40)], "ti" * 60]
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in texts]
    want = []
    for text, key in zip(texts, keys):
        words = re.findall("▁*[^▁]+|▁+", (" " + text).replace(" ", "▁")) if text else []
        drawn = zip(words, encoder.word_keys(key, len(words)).tolist())
        want.append([i for w, k in drawn for i in one_by_one(w, encoder.pieces, encoder.limit, k)])
    for name in ("merged", "_short", "_long"):
        monkeypatch.setattr(sentencepiece_bpe, name, None)
    got = [encoder.encode(t, k) for t, k in zip(texts, keys)]
    assert [g.tolist() for g in got] == want
    ids, lengths = encoder.encode_all(texts, keys)
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == [len(w) for w in want]
    assert [t.decode() for t in encoder.decode_all(ids, lengths)] == texts


SPACED = sentencepiece_bpe.SPACE
