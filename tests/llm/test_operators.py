"""Each operator against plain Python on a small table with null, empty, short,
long, equal and near-equal texts, clashing columns, repeated rows and no rows."""

import hashlib
import math
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wearcast.llm import (
    bpe_codec,
    decontam,
    license_scan,
    minhash,
    quality_gbt,
    secret_scan,
    spotsigs,
    suffix_dedup,
    token_count,
    url_filter,
)
from wearcast.llm.common import Scratch

from . import brute

RANKS, JSON50 = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) if cols else sorted(map(tuple, df.collect()), key=repr)


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


# ------------------------------------------------------------ 1 licences --
def test_license_rules(spark, docs, empty, odd):
    found = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (found[411].identifiers, found[411].licenses, found[411].unmatched) == ("mit-ref,all-rights", "MIT,Proprietary", "")
    assert all(r.n_sentences == 0 and r.licenses == "" for d, r in found.items() if d != 411)
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(odd).count() == 8


def test_license_order(spark):
    mit = [license_scan.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-asis")]
    texts = ["\n".join(mit), "\n".join(mit[:2]), mit[1], " ".join(["LICENSED under the  apache license, version 2.0!", "nothing.", mit[2]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.licenses, r.unmatched) for r in license_scan.scan(df).orderBy("doc_id").collect()] == [
        ("MIT", ""), ("MIT", ""), ("", "mit-notice"), ("Apache-2.0", "mit-asis")]


def test_license_wrapped(spark):
    """Licence texts as they stand in files: wrapped, indented, in comments; expected values written out."""
    import textwrap

    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
           "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
           "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
           "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
           "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n"
           "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE.")
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
              "    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\n"
              "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
           "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
           "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.")
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n"
           "(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY.\n\n"
           "You should have received a copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>.")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one."
    want = {"MIT": (mit, "mit-grant,mit-notice,mit-asis"), "Apache-2.0": (apache, "apache2-ref,apache2-compliance,apache2-copy,apache2-asis"),
            "BSD-2-Clause": (bsd, "bsd-grant,bsd-source,bsd-binary"), "GPL-3.0-or-later": (gpl, "gpl-free,gpl-warranty,gpl-copy"), "MPL-2.0": (mpl, "mpl2-ref")}
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: textwrap.indent(t, " * ", lambda _: True), lambda t: textwrap.indent(t, "# ", lambda _: True),
              lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))]
    rows = [(name, shape(text), ids) for name, (text, ids) in want.items() for shape in shapes]
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    out = license_scan.scan(df).orderBy("doc_id").collect()
    assert [(r.licenses, r.identifiers, r.unmatched) for r in out] == [(name, ids, "") for name, _, ids in rows]
    apart = spark.createDataFrame([(1, "All rights\n\nreserved."), (2, "All. Rights reserved."), (3, "MIT License\nCopyright X\nAll rights reserved.")], "doc_id long, text string")
    assert [r.identifiers for r in license_scan.scan(apart).orderBy("doc_id").collect()] == ["", "", "mit-ref,all-rights"]


# -------------------------------------------------------- 2 suffix dedup --
@pytest.mark.parametrize("batches,group", [(1, 20_000), (3, 20_000), (4, 1)])
def test_repeats(docs, rows, batches, group):
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, batches=batches, bits=12 if batches == 1 else 20, group=group))
    same(got(out), brute.repeats(rows, suffix_dedup.WINDOW))


def test_repeats_odd_rows(odd, empty):
    same(got(suffix_dedup.digest(suffix_dedup.remove_repeats(odd))), brute.repeats([tuple(r) for r in odd.collect()], suffix_dedup.WINDOW))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_index_levels(spark, docs):
    index = suffix_dedup.SuffixIndex(Scratch(spark, "test"))
    ready = suffix_dedup.prepared(docs)
    for b in range(3):
        index.add(ready.where(f"pmod(doc_id, 3) = {b}"))
    assert sorted(index.levels) == [0, 1]
    assert {r.gram for r in index.matches(ready.where("doc_id = 205")).collect()} <= {r.gram for r in index.repeated().collect()}


# ------------------------------------------------------------- 3 minhash --
@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80), (3, 60)])
def test_near_duplicates(docs, rows, width, percent):
    out = minhash.near_duplicates(docs, width, percent)
    want = brute.groups(rows, width, percent)
    same(got(out, "doc_id", "n_shingles", "component_id", "kept"), [(d, n, c, d == c) for d, (n, c) in want.items()])


def test_near_duplicates_odd_rows(odd, empty):
    out = got(minhash.near_duplicates(odd, 3, 85), "doc_id", "component_id", "kept")
    assert out == sorted([(None, 5, False), (None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True)], key=repr)
    assert minhash.near_duplicates(empty).count() == 0


# ------------------------------------------------------------ 4 spotsigs --
@pytest.mark.parametrize("per_range", [7, 2000])
def test_spotsigs(docs, rows, per_range, monkeypatch):
    monkeypatch.setattr(spotsigs.with_next, "__defaults__", (per_range,))
    found = {r.doc_id: r for r in spotsigs.compare(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half, r = len(t) // 2, found[d]
        edited = t[:len(t) - half] + n[:half]
        a = brute.signatures(t)
        assert (r.n_chars, r.edited_sha256, len(r.fingerprint)) == (len(t), brute.sha(edited), 8 * len(a))
        assert r.near_edited == pytest.approx(brute.jaccard(a, brute.signatures(edited)))
        assert r.near_next == pytest.approx(brute.jaccard(a, brute.signatures(n)))


def test_spotsigs_odd_rows(spark, odd, empty):
    assert spotsigs.compare(odd).count() == 8 and spotsigs.compare(empty).count() == 0
    one = spotsigs.compare(spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0


def test_spotsigs_pairs(spark, docs, rows):
    sets = docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("signature"))
    plain = {d: frozenset(brute.signatures(t)) for d, t in rows}
    first = {}
    for d, s in sorted(plain.items()):
        first.setdefault(s, d)
    ids = [d for s, d in first.items() if s]
    for percent in (50, 80):
        want = {(a, b) for a in ids for b in ids if a < b and brute.jaccard(plain[a], plain[b]) >= percent / 100}
        assert {(r.a, r.b) for r in spotsigs.near_duplicates(sets, percent).collect()} == want


def test_spotsigs_without_common_words(spark):
    """One changed word in other scripts, code and lists moves only the signatures near it,
    also where some common words stand among them."""
    rnd = random.Random(8)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(6))
    kinds = {"cyrillic": lambda i: word("абвгдежзиклмнопрст"), "code": lambda i: f"{word('abcdefgh')}_{i} = {word('xyzuvw')}[{i}];",
             "list": lambda i: word("0123456789"), "mixed": lambda i: "the" if i % 41 == 40 else word("bcdfgh")}
    rows = []
    for n, (_, make) in enumerate(sorted(kinds.items())):
        words = [make(i) for i in range(200)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words[:90], make(0), *words[91:]]))]
    sets = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", spotsigs.signatures(F.col("text")).alias("signature"))
    size = {r.doc_id: len(r.signature) for r in sets.collect()}
    assert size == {d: len(brute.signatures(t)) for d, t in rows} and min(size.values()) > 20
    pair = sets.alias("x").join(sets.alias("y"), F.expr("y.doc_id = x.doc_id + 1 and x.doc_id % 2 = 0"))
    for r in pair.select("x.doc_id", spotsigs.likeness(F.col("x.signature"), F.col("y.signature")).alias("likeness")).collect():
        plain = [brute.signatures(rows[r.doc_id + i][1]) for i in (0, 1)]
        assert r.likeness == pytest.approx(brute.jaccard(*plain)) and r.likeness > 0.8


# ----------------------------------------------------------- 5, 8 tokens --
def test_bpe_round_trip(docs, rows, odd, empty):
    ref = Tokenizer.from_file(WORD)
    want = []
    for d, t in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     brute.sha(ref.decode(ids, skip_special_tokens=False))))
    same(got(bpe_codec.round_trip_digests(docs, WORD)), want)
    encoded = bpe_codec.encode(docs, WORD)
    assert {r.doc_id: brute.sha(r.text) for r in bpe_codec.decode(encoded, WORD).collect()} == {w[0]: w[3] for w in want}
    assert bpe_codec.encode(odd, WORD).count() == 8 and bpe_codec.encode(empty, WORD).count() == 0


def test_token_counts(docs, rows, odd, empty):
    ref = Tokenizer.from_file(JSON50)
    want = [(d, len((t or "").encode()), len(ref.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    specials = token_count.json_specials(JSON50)
    for chunk, overlap in ((32 << 10, 512), (64, 8), (700, 64)):
        same(got(token_count.count_tokens(docs, RANKS, chunk, overlap, specials), "doc_id", "n_bytes", "n_tokens"), want)
    assert token_count.count_tokens(odd, RANKS).count() == 8 and token_count.count_tokens(empty, RANKS).count() == 0


# ---------------------------------------------------------- 6 url filter --
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_url_filter(spark):
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "notexample.com", "example.net", "x.net", "org", "", "example.com:80", "example.com.", "é.com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x?q=/fr/", "/EN/", "/es/1#a", "/fr", "/fr/é", "?x", "#y")]
    rows = list(enumerate([*urls, *urls[:9], None, "", "no scheme", "a://b://c/en/", "://"]))
    pages = spark.createDataFrame([(i, u, None, None, None) for i, u in rows], "page_id long, url string, key string, chain int, host string")
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block"), ("", "/", "block"), ("org", None, None)], "host string, path string, verdict string")
    for ranges, salts in ((64, 8), (3, 1), (1, 2)):
        same(got(url_filter.judge(pages, rules, ranges, salts)), brute.judged(rows, RULES))
    same(got(url_filter.judge(pages, rules.limit(0))), [(*r[:3], None, "allow") for r in brute.judged(rows, [])])
    assert url_filter.judge(pages.limit(0), rules).count() == 0


# ------------------------------------------------------------- 7 quality --
def test_quality(spark, empty, odd):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 40)) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["ALPHA!!", "###", "|", "$$$"], 40)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad, None, ""])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(0, 1), (None, 1), (4, None), (7, 0)], "doc_id long, quality int")
    model = quality_gbt.train(docs, labels)
    out = {r.doc_id: r for r in quality_gbt.score(docs, model).collect()}
    held = [r for d, r in out.items() if r.held_out and d < 300]
    assert len(held) > 40 and all(r.predicted == int(r.doc_id < 150) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values()) and len(out) == 302
    again = {r.doc_id: r.score for r in quality_gbt.score(docs.repartition(9), quality_gbt.train(docs.repartition(3), labels)).collect()}
    assert again == {d: r.score for d, r in out.items()}
    none = quality_gbt.train(docs, labels.limit(0))
    assert {r.score for r in quality_gbt.score(docs, none).collect()} == {0.5}
    assert quality_gbt.score(empty, model).count() == 0 and quality_gbt.score(odd, model).count() == 8


def test_flattened_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    m = quality_gbt.fit(x, y, trees=9, depth=3)

    def walk(row):
        s = m.bias
        for t in range(9):
            i = 0
            for _ in range(3):
                f = m.feature[t, i]
                i = 2 * i + 1 + int(f >= 0 and row[f] > m.threshold[t, i])
            s += m.value[t, i - 7]
        return 1 / (1 + np.exp(-s))

    assert np.allclose(m.score(x), [walk(r) for r in x])
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


# ------------------------------------------------------------- 9 secrets --
def test_secret_base_spans(docs, rows, odd, empty):
    model = secret_scan.train(docs)
    out = {r.doc_id: r for r in secret_scan.digest(docs, model).collect()}
    for d, t in rows:
        base = brute.secrets(t)
        assert out[d].base_sha256 == brute.sha(base)
        assert set(filter(None, base.split(","))) <= set(out[d].spans.split(","))
    assert secret_scan.digest(odd, model).count() == 8
    assert secret_scan.digest(empty, secret_scan.train(empty)).count() == 0


def test_secret_models_and_redaction(spark):
    rng = np.random.default_rng(4)
    key = lambda n: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"), n))
    names = ["configuration_loader_v2", "AbstractSingletonProxyFactory2", "thheanderstionthing", "connection_timeout_ms"]
    texts = [f"the {names[i % 4]}{i % 7} token={key(24)} end" for i in range(200)]
    hidden = [key(32) for _ in range(30)]
    texts += [f"see {names[i % 4]} and {h} é here" for i, h in enumerate(hidden)]
    docs = spark.createDataFrame([(i, t, "b", "s") for i, t in enumerate(texts)], "doc_id long, text string, base string, spans string")
    model = secret_scan.train(docs)
    clean = {r.doc_id: r for r in secret_scan.redact(docs, model).collect()}
    caught = sum(h not in clean[200 + i].text for i, h in enumerate(hidden))
    assert caught >= 27 and all(r.base == "b" and r.spans == "s" for r in clean.values())
    assert all(names[i % 4] in clean[i].text for i in range(230))
    assert all("[secret] end" in clean[i].text for i in range(200))


def plain_markov(text, model):
    """(start, end) of the tokens that the model takes for random, by plain Python."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=\-]|[^\x00-\x7F])[A-Za-z0-9+/_=\-]{8,}(?![A-Za-z0-9+/_=\-]|[^\x00-\x7F])", text):
        v = m[0]
        if len(v) < 16 and re.fullmatch("[A-Za-z][a-z]*", v):
            continue
        one = v.upper() == v or v.lower() == v
        w = "\x02" + (v.lower() if one else v) + "\x03"
        total = sum(model.ratios[128 * ord(a) + ord(b)] for a, b in zip(w, w[1:], strict=False))
        if one:
            total += max(0.0, sum(c.isalpha() for c in v) * math.log(2) - math.log(3))
        if total > model.thresholds[sum(len(v) >= n for n in secret_scan.LENGTHS[1:])]:
            out.append((m.start(), m.end()))
    return out


def test_secret_spans_of_the_models(spark):
    """Spans against plain Python; recall on unseen keys; few false spans."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secret_scan.train(docs)
    rng = np.random.default_rng(11)
    alphabets = {"base62": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567", "letters": string.ascii_letters}
    keys = [(k, n, "".join(rng.choice(list(a), n))) for k, a in alphabets.items() for n in (8, 12, 16, 20, 24, 32) for _ in range(100)]
    texts = [f"é see {w} é{w} {w}é ({w}), x" for _, _, w in keys] + ["HEITKEIT 555-0216 4713332104704538 2024-01-01 thatinganding", "é" * 9, "abcdefgh"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r[secret_scan.SPANS] if s.kind == 3] for r in secret_scan.scan(made, model).collect()}
    for i, t in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in brute.secrets(t).split(",") if x]
        assert found[i] == [s for s in plain_markov(t, model) if all(s[1] <= a or b <= s[0] for a, b in base)], t
    for k in alphabets:
        for n in (8, 12, 16, 20, 24, 32):
            hit = [len(found[i]) == 2 for i, (a, m, _) in enumerate(keys) if (a, m) == (k, n)]
            assert np.mean(hit) >= 0.9, (k, n)
    assert found[len(keys)] == []
    spans = secret_scan.scan(docs, model).select(F.explode(secret_scan.SPANS).alias("s")).where("s.kind = 3").count()
    assert spans <= 4      # 10 a million words


def test_secret_ratios_back_off():
    ratios = secret_scan.ratios_from({}, {128 * 2 + ord("t"): 50, 128 * ord("t") + ord("h"): 50, 128 * ord("h") + 3: 50})
    assert len(ratios) == 128 * 128 and all(math.isfinite(r) for r in ratios)
    at = lambda a, b: ratios[128 * ord(a) + ord(b)]
    assert at("t", "h") < 0 < at("t", "q") and at("5", "7") < 0 and at("5", "7") == at("0", "1")


def test_secret_in_a_long_text(spark):
    line = "those cattle rested there while several others kept running towards another meadow "
    docs = spark.createDataFrame([(1, line * 25_000 + "qT7xW9pL2zR8vK4m end"), (2, line), (3, line.upper() + line)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secret_scan.redact(docs, secret_scan.train(docs)).collect()}
    assert out == {1: line * 25_000 + "[secret] end", 2: line, 3: line.upper() + line}


# ------------------------------------------------------------ 10 decontam --
@pytest.mark.parametrize("query_bytes", [decontam.QUERY_BYTES, 300])
def test_decontamination(spark, docs, rows, odd, empty, query_bytes):
    texts = dict(rows)
    items = [(i, " ".join(texts[i].split()[3:3 + n])) for i, n in ((1, 14), (2, 10), (3, 9), (5, 30))]
    items += [(50, None), (51, "..."), (52, texts[1]), (53, "ONE"), (54, " ".join(texts[5].split()[8:25]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in [*items, items[0]]], "item_id long, text string, n_words int")
    out = decontam.digest(decontam.find_contamination(docs, bench, query_bytes=query_bytes))
    same(got(out), brute.contamination(rows, items))
    assert decontam.find_contamination(odd, bench).count() == 8
    assert decontam.find_contamination(empty, bench).count() == 0
    assert {r.contaminated for r in decontam.digest(decontam.find_contamination(docs, bench.limit(0))).collect()} == {False}


def test_decontamination_repeated_rows_in_parts(spark, odd):
    """Equal blocks (one a partition) and several parts of the test set: every row comes back for itself."""
    text = " ".join(f"word{i}" for i in range(80))
    bench = spark.createDataFrame([(1, text), (2, " ".join(text.split()[20:40])), (3, "other words " * 20)], "item_id long, text string")
    twice = odd.repartition(1).union(odd.repartition(1)).union(odd.where("doc_id is null and text = ''"))
    one, parts = (got(decontam.digest(decontam.find_contamination(twice, bench, query_bytes=n))) for n in (decontam.QUERY_BYTES, 300))
    assert len(one) == 17 and parts == one
    same(one, brute.contamination([tuple(r) for r in twice.collect()], [tuple(r) for r in bench.collect()]))


def test_proximity_at_borders(spark):
    docs = spark.createDataFrame([(1, "xx aa yy"), (2, "aa bb dd cc"), (3, "aa bb cc xx"), (4, "dd xx yy zz"), (5, "yy zz aa"), (6, "bb cc dd xx")], "doc_id long, text string")
    item = spark.createDataFrame([(9, "aa bb cc dd")], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.find_contamination(docs.repartition(1).sortWithinPartitions("doc_id"), item, slop=1).collect()}
    # a term displaced inside the document counts, the neighbouring document's does not
    assert {d for d, r in found.items() if r["items"]} == {2}
    assert all(0 <= a < b <= r.n_words for r in found.values() for a, b in zip(r.starts, r.ends, strict=True))
    # the window beside the rarest term begins before the text, or ends behind it
    more = spark.createDataFrame([(1, "bb aa"), (2, "aa bb"), (3, "bb")], "doc_id long, text string").repartition(1)
    pair = spark.createDataFrame([(9, "aa bb")], "item_id long, text string")
    assert {r.doc_id for r in decontam.find_contamination(more, pair, slop=2).collect() if r["items"]} == {1, 2}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zero aa bb cc dd end"), (2, "aa bb x cc dd"), (3, "aa x y cc bb dd"), (4, "dd cc")], "doc_id long, text string")
    item = spark.createDataFrame([(9, "aa bb cc dd")], "item_id long, text string")
    hit = lambda slop: {r.doc_id for r in decontam.find_contamination(docs, item, slop=slop).collect() if r["items"]}
    assert hit(0) == {1} and hit(1) == {1, 2} and 4 not in hit(2)
