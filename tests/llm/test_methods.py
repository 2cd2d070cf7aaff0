"""The methods of the training-data operators: planted cases, brute force, long texts."""

import collections
import hashlib
import math
import os
import random
import re
import string
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from linetrace.llm import decontaminate, html_text, license_rules, license_scan, mixing, preferences, quality_rules, secret_scan, token_counts

DATA = "/root/testdata/sf0.01"
DOC = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


# --- 1 mixing
def test_mixture_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 9)), "abbbbbbcc"[rng.randrange(9)]) for i in range(300)] + [(7, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(str(r.doc_id), r.source, r.epoch, r.block) for r in mixing.mix(docs, entropy=0.97, passes=2.0, budget=3000, block_tokens=300).collect()]
    hashes = {(str(r.doc_id), r.source or ""): (r.h, r.h >> (64 - mixing.BUCKET_BITS) & ((1 << mixing.BUCKET_BITS) - 1)) for r in docs.select("doc_id", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h")).collect()}
    size = {(str(i), s or ""): len(t.split()) for i, t, s in rows}
    total = collections.Counter()
    for (_, s), n in size.items():
        total[s] += n
    share = {s: n / sum(total.values()) for s, n in total.items()}

    def weights(t):
        z = sum(p**t for p in share.values())
        return {s: p**t / z for s, p in share.items()}

    grid = [k / 200_000 for k in range(200_001)]
    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    low, high = 0, len(grid) - 1
    while low < high:  # the least exponent on the grid that meets the entropy
        mid = (low + high) // 2
        low, high = (low, mid) if entropy(weights(grid[mid])) <= 0.97 * math.log(len(share)) else (mid + 1, high)
    t = grid[low]
    while max(weights(t)[s] * 3000 / total[s] for s in share) > 2.0 and t < 1:
        t += 1 / 200_000
    for s, w in weights(t).items():
        target = round(w * 3000)
        used = sum(size[i, s] for i, source, _, _ in got if source == s)
        assert abs(used - target) <= 9 + 3, (s, used, target)
        # A prefix of the source's order, after whole passes.
        order = sorted((k for k in size if k[1] == s), key=lambda k: (hashes[k][1], hashes[k][0]))
        uses = collections.Counter(i for i, source, _, _ in got if source == s)
        counts = [uses[k[0]] for k in order]
        assert counts == sorted(counts, reverse=True) and max(counts) - min(counts) <= 1
    blocks = collections.Counter()
    for i, s, _, b in got:
        blocks[b, s] += size[i, s]
    assert {b for b, _ in blocks} == set(range(10))
    assert all(abs(blocks[b, "b"] - sum(blocks[x, "b"] for x in range(10)) / 10) <= 16 for b in range(10))


# --- 2 licences
MIT = """MIT License

Copyright (c) 2024 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
LGPL = """/*
 * libfoo is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 */"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of Example Corp. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
LICENSED = [
    (MIT, ["MIT"]),
    (APACHE, ["Apache-2.0"]),
    (LGPL, ["LGPL-2.1"]),
    (BSD, ["BSD-2-Clause"]),
    (BSD + BSD_NAMES, ["BSD-3-Clause"]),
    ("// SPDX-License-Identifier: MIT", ["MIT"]),
    ("/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) */\nint x;", ["BSD-2-Clause", "GPL-2.0"]),
    ("x\n<!-- SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception -->", ["Apache-2.0"]),
    ("This software is released under the MIT License.", ["MIT"]),
    ("This file is licensed under the Apache License, Version 2.0. See LICENSE.", ["Apache-2.0"]),
    ("The text is distributed under the terms of the GNU General Public License,\nversion 3, since 2020.", ["GPL-3.0"]),
    ("All photos are available under CC BY-SA 4.0!", ["CC-BY-SA-4.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not\ndistributed", ["MPL-2.0"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software", ["Unlicense"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("The MIT campus opened. All rights reserved. A licence to fish is not granted under the lake.", []),
    ("The work is licensed. Under the MIT License it is not.", []),
    ("permission is hereby\n\ngranted, free of charge", []),
]


def test_licences_as_published(spark):
    assert len(license_rules.NAMES) >= 30
    got = {r.doc_id: list(r.licenses) for r in license_scan.scan(docs_of(spark, [t for t, _ in LICENSED])).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LICENSED)}
    hints = re.compile(license_scan.HINTS)
    assert all(hints.search(s) for s in license_rules.SENTENCES) and hints.search("spdx-license-identifier")


def test_licences_in_long_texts(spark):
    began = time.time()
    texts = ["\n" * 300_000 + MIT, "." * 300_000 + "x warrant", "licen " * 100_000 + "Released under the ISC License.", ("word " * 60_000) + "copyright"]
    got = {r.doc_id: list(r.licenses) for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert got == {0: ["MIT"], 1: [], 2: ["ISC"], 3: []} and time.time() - began < 60


# --- 4 quality rules
def labelled(spark, strata):
    """Texts of 60 different words, bad ones with symbols; strata: name to (good, bad, false alarms)."""
    rows, labels, i = [], [], 0
    for lang, (good, bad, loud) in strata.items():
        for k in range(good + bad):
            noisy = k >= good or k < loud
            rows.append((i, " ".join(f"word{i}x{j}{'##' if noisy else ''}" for j in range(60)), lang))
            labels.append((i, int(k < good)))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_small_strata_are_pooled_and_large_ones_decide_alone(spark):
    docs, labels = labelled(spark, {"big": (400, 20, 0), "small": (12, 8, 0), "loud": (200, 0, 60)})
    kept = {(r.lang, r.quality): r.kept for r in quality_rules.judge(docs, labels).join(docs, "doc_id").join(labels, "doc_id").groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert kept["big", 1] == 1.0 and kept["big", 0] == 0.0
    # 60 of 612 good texts of the pool would go, which its bound does not allow, so nothing acts there.
    assert kept["small", 0] == kept["small", 1] == kept["loud", 1] == 1.0
    docs, labels = labelled(spark, {"big": (400, 20, 0), "small": (12, 8, 0)})
    kept = {(r.lang, r.quality): r.kept for r in quality_rules.judge(docs, labels).join(docs, "doc_id").join(labels, "doc_id").groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert kept["small", 0] == 0.0 and kept["small", 1] == 1.0
    twice = quality_rules.judge(docs, labels.unionByName(labels))
    assert twice.filter("kept").count() == 412


def test_the_bound_on_false_rejections_holds():
    """A step whose true rate is just above alpha is admitted no more often than its share of delta."""
    rng, n, alpha, delta, strata = random.Random(1), 300, 0.05, 0.05, 4

    def tail(k):
        return sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1))

    admits = [tail(k) <= delta / (strata + 1) for k in range(40)]
    runs = 4000
    wrong = sum(admits[sum(rng.random() < alpha + 0.001 for _ in range(n))] for _ in range(runs) if True)
    assert wrong / runs <= delta / (strata + 1) + 0.005


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_the_rules_act_on_small_tables(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    r = quality_rules.judge(read("documents"), read("labels")).agg(F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("by_rule"), F.count_if("kept").alias("kept")).first()
    assert r.by_rule > 10 and r.kept > 600


# --- 5 token counts
def test_long_runs_are_counted_in_linear_time():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, vocabulary = Tokenizer.from_file(path), token_counts.Vocabulary(path)
    rng = random.Random(9)
    for letters in ("漢字語日本国人大", "etaoinshrdlu", "'s漢", "한국ᄀ각", "?!'#"):
        text = "".join(rng.choice(letters) for _ in range(40_000))
        began = time.time()
        deltas = vocabulary.deltas(text)
        assert time.time() - began < 20
        running = 0
        cuts = set(rng.sample(range(300), 40)) | {len(text) - 1, 777}
        for i, d in enumerate(deltas):
            running += d - 128
            if i in cuts:
                assert running == len(library.encode(text[: i + 1], add_special_tokens=False).ids), (letters, i)
    assert max(map(len, vocabulary.heads)) <= 4 * token_counts.SHORT


# --- 6 decontamination
def nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_contamination_against_brute_force(spark):
    rng = random.Random(12)
    words = ["ash", "birch", "cedar", "oak", "pine", "elm", "yew", "fir"]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9, 14]))) for _ in range(12)]

    def edited(text, k):
        for _ in range(k):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "q", text[at] + "q"]) + text[at + 1 :]
        return text

    texts = []
    for item in items * 6:
        k = decontaminate.budget(item, decontaminate.ERRORS)
        texts.append(" ".join(rng.choice(words) for _ in range(6)) + f" {edited(item, rng.randrange(k + 3))}, " + " ".join(rng.choice(words) for _ in range(6)))
    texts += ["", "  ", items[0].replace(" ", "\n"), "x" * 200_000 + " " + max(items, key=len)]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        norm = decontaminate.normal(t)
        if len(norm) > 10_000:
            want[i] = None
            continue
        want[i] = [j for j, item in enumerate(items) if (f" {item} " in f" {norm} " if len(item) < decontaminate.SHORT else nearest(item, norm) <= decontaminate.budget(item, decontaminate.ERRORS))]
    for block_bytes in (1 << 20, 200):
        got = {r.doc_id: list(r.item_ids) for r in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()}
        assert max(range(len(items)), key=lambda j: len(items[j])) in got[len(texts) - 1]
        assert {i: v for i, v in got.items() if want[i] is not None} == {i: v for i, v in want.items() if v is not None}
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert clean == {i for i, v in got.items() if not v}


def test_one_edit_too_many_is_clean(spark):
    item = "the quick brown fox jumps over the lazy dog while seven green birds watch"
    k = decontaminate.budget(item, decontaminate.ERRORS)
    hit, miss = list(item), list(item)
    for n, text in ((k, hit), (k + 1, miss)):
        for at in range(n):
            text[5 + 12 * at] = "9"
    got = {r.doc_id: r.contaminated for r in decontaminate.contamination(docs_of(spark, ["".join(hit), "".join(miss)]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: True, 1: False}


# --- 7 preferences
def test_replies_are_grafted_onto_their_prompts(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "mine"), (0, 4, "user", "bye"),
        (1, 0, "system", "be"), (1, 1, "assistant", "theirs"), (2, 0, "user", "only"), (3, 0, "assistant", "x"), (5, 0, "user", None), (None, 0, "assistant", "n"),
    ]
    clash = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, pair_id int, chosen string")
    got = {r.pair_id: r for r in preferences.pairs(preferences.grafted(clash)).collect()}
    prompt = "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore\n"
    assert (got[0].prompt, got[0].chosen, got[0].rejected, got[0].n_prompt_turns, got[0].rejected_id, got[0].status) == (prompt, "<|assistant|>\nmine\n", "<|assistant|>\ntheirs\n", 3, 1, "pair")
    a, b = map(int, got[0].chosen_mask.split(":"))
    assert got[0].chosen[a:b] == "mine\n"
    assert got[1].rejected == "<|assistant|>\nmine\n" and got[3].status == "unpaired" and set(got) == {0, 1, 3}
    assert preferences.pairs(preferences.grafted(clash.limit(0))).count() == 0


# --- 8 secrets
def test_base_spans_against_plain_expressions(spark):
    rng = random.Random(4)
    bits = ["password", "token=", "secret: ", "API_KEY='", "\"abcdef123", "AKIA", "Q7ZXC12345678901", "0123456789abcdef01234567", "é ", "\n", "=", "x" * 7, " ", "apikey\" = \"zz9/"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    kinds = [("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)]
    for r in secret_scan.scan(docs_of(spark, texts)).collect():
        found = []
        for rank, (kind, pattern, least) in enumerate(kinds):
            for m in re.finditer(pattern, texts[r.doc_id]):
                if len(m[1] if kind == "assign" else m[0]) >= least:
                    found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        said = ",".join(x[2] for x in sorted(found))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if not x.startswith("random")] == said.split(",")


def test_planted_keys_are_found_and_names_are_not(spark):
    rng = random.Random(8)
    letters, digits = string.ascii_letters, string.digits
    alphabets = {"64": letters + digits + "+/", "62": letters + digits, "url": letters + digits + "-_", "36": string.ascii_lowercase + digits, "32": string.ascii_uppercase + "234567", "16": "0123456789ABCDEF"}
    joins = ["see {} here", "AUTH={}", "https://a.example/x?sig={}&b=1", "keys_dir/{}", "key: {}.", "id-{}"]
    keys = [("".join(rng.choice(a) for _ in range(n)), name, n) for name, a in alphabets.items() for n in (32, 40, 64) for _ in range(12)]
    names = ["CamelCaseIdentifierNumber", "HttpServletRequestWrapperFactoryBean2", "vaccination2021campaign", "ISBN9783161484100EDITION", "xyxyxyxyxyxyxyxyxyxy12", "Donaudampfschifffahrtsgesellschaft0A"]
    plain = [f"the {rng.choice(names)}{rng.randrange(99)}Of{rng.choice(names)} says" for _ in range(120)] + ["2023-01-02-report_final_version2", "a" * 400 + "1Z", "1234567890" * 5]
    texts = [rng.choice(joins).format(k) for k, _, _ in keys] + plain
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs_of(spark, texts)).collect()}
    hit = collections.Counter()
    for i, (_, name, n) in enumerate(keys):
        hit[n] += bool(got[i])
        hit[name] += bool(got[i])
    assert hit[64] >= 0.95 * 72 and hit[40] >= 0.85 * 72 and hit[32] >= 0.75 * 72, hit
    false = sum(bool(got[len(keys) + j]) for j in range(len(plain)))
    assert false <= 0.03 * len(keys), [plain[j] for j in range(len(plain)) if got[len(keys) + j]]
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs_of(spark, texts)).collect()}
    assert all((keys[i][0] in clean[i]) == (not got[i]) for i in range(len(keys)))


# --- 9 main text
def site(host, k, article=True, boiler="div", rng=random.Random(3)):
    own = " ".join(rng.choice(string.ascii_lowercase) * rng.randrange(2, 9) for _ in range(40))
    # No tag or class tells these from content.
    first = f"<{boiler}>All about {host} since 1999 and what you may find in these rooms</{boiler}>"
    last = f"<{boiler}><p>Write to the desk of {host}, open on Mondays.</p><p>We ship to all places that boats can reach.</p></{boiler}>"
    inner = f"<h2>Story {k} {own[:9]}</h2><p>{own}</p><p>{own[::-1]}</p>"
    body = f"<article>{inner}</article>" if article else f"<div>{inner}</div>"
    return f"<html><head><title>x</title></head><body>{first}{body}{last}</body></html>", " ".join(f"Story {k} {own[:9]} {own} {own[::-1]}".split())


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("article", [True, False])
def test_unmarked_boilerplate_goes_by_the_style_tree(spark, article, monkeypatch):
    rows, want = [], {}
    for h in range(3):
        for k in range(10):
            page, text = site(f"h{h}.example", k, article)
            rows.append((100 * h + k, f"http://h{h}.example/{k}", page))
            want[100 * h + k] = text
    got = {r.page_id: r.text for r in html_text.extract(pages_of(spark, rows)).collect()}
    assert got == want
    joined = {r.page_id: r.text for r in html_text.extract(pages_of(spark, rows), small_bytes=0).collect()}
    assert joined == want
    monkeypatch.setattr(html_text, "NOISE", frozenset())
    assert all(html_text.main_text(page).count("desk") == (0 if article else 1) for _, _, page in rows)  # without the tree


def test_boilerplate_inside_articles_goes_and_copies_stay(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    rows = []
    for k in range(12):
        own = " ".join(word() for _ in range(30))
        rows.append((k, f"http://a.example/{k}", f"<body><article><p>{own}</p><div>You have read all of this page, thank you.</div></article></body>"))
    same = " ".join(word() for _ in range(50))
    rows += [(100 + k, f"http://b.example/{k}", f"<body><nav>{word()}</nav><article><p>{same}</p></article></body>") for k in range(30)]
    rows += [(200, None, None), (201, "", ""), (202, "x", "<p>a<p>b &amp;  c"), (202, "x", "<p>a<p>b &amp;  c")]
    got = collections.defaultdict(list)
    for r in html_text.extract(pages_of(spark, rows)).collect():
        got[r.page_id].append(r.text)
    assert all("thank you" not in got[k][0] and len(got[k][0].split()) == 30 for k in range(12))
    assert all(got[100 + k] == [same] for k in range(30))
    assert got[200] == [""] and got[201] == [""] and got[202] == ["a b & c"] * 2


def test_a_teaser_article_does_not_hide_the_text():
    text = " ".join(f"word{i}" for i in range(200))
    page = f"<body><article><p>Read more</p></article><div><p>{text}</p></div></body>"
    assert text in html_text.main_text(page)
    assert html_text.main_text(f"<body><article><p>{text}</p></article><div><p>See also this</p></div></body>") == text
    assert html_text.main_text(f"<body><div class='page-with-sidebar'><p>{text}</p></div></body>") == text
    assert html_text.main_text(f"<body><div><p>{text}</p></div><div class='sidebar'><p>other words</p></div></body>") == text


def test_the_style_tree_against_brute_force(spark):
    rows = []
    for k in range(9):
        page, _ = site("h.example", k % 7, article=k % 2 == 0, rng=random.Random(k % 7))
        rows.append((k, "http://h.example/", page))
    got = {r.path: (r.shape, r.content) for r in html_text.style_tree(pages_of(spark, rows)).collect()}
    seen = collections.defaultdict(set)
    for _, _, source in rows:
        page = html_text.Page(source)
        main = page.own_text()
        for kind, values in enumerate(page.nodes()):
            for path, value in values.items():
                seen[path, kind].add((main, value))
    want = {}
    for (path, kind), pairs in seen.items():
        counts = collections.Counter(v for _, v in pairs).values()
        m = sum(counts)
        entropy = -sum(c / m * math.log(c / m) for c in counts) / math.log(m) if m > 1 else 1.0
        imp = 1 - (1 - entropy) * m / (m + html_text.PRIOR_PAGES) if m > 1 else 1.0
        if imp <= html_text.WHOLE:
            want.setdefault(path, [1.0, 1.0])[kind] = imp
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    assert set(got) == {signed(p) for p in want}
    assert all(abs(got[signed(p)][k] - v[k]) < 1e-5 for p, v in want.items() for k in (0, 1))


def test_deep_and_broken_pages():
    began = time.time()
    assert html_text.main_text("<div>" * 50_000 + "deep text") == "deep text"
    assert html_text.main_text("<b>" * 50_000 + "<br>x" * 20_000).startswith("x x")
    assert html_text.main_text("<p>a</div></p></x><!-- c") == "a"
    assert time.time() - began < 30


def test_wrapped_and_commented_licences_have_one_form(spark):
    grant = max(license_rules.SENTENCES, key=len)
    texts = ["\n".join(lead + line for line in textwrap.wrap(grant, width)) for lead in ("", " * ", "# ", "// ", "; ") for width in (30, 72)]
    assert all(list(r.sentence_ids) == ["mit_grant"] for r in license_scan.scan(docs_of(spark, texts)).collect())
