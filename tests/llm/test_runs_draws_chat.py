"""Periodic runs, importance resampling and chat formatting against plain Python."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearcast.llm import chat_format, importance, periodic_runs, queries

from . import brute


# --------------------------------------------------- 11 periodic runs -----
def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], brute.sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)),
            brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def made_words(rnd):
    n, k = rnd.randint(0, rnd.choice([9, 40, 150])), rnd.choice([1, 2, 3, 40])
    w = [rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randint(0, 4)):
        if n > 5:
            a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 5))
            for i in range(a + p, rnd.randint(a, n)):
                w[i] = w[i - p]
    return w


def test_runs_of_numbers():
    rnd, n = random.Random(2), 0
    for _ in range(1500):
        w = made_words(rnd)
        found = [tuple(r) for r in periodic_runs.runs_of(np.array([*w, 999], dtype=np.int64), len(w)).tolist()]
        assert found == plain_runs(w)
        n += len(found)
    assert n > 500


def test_occurrences_are_exact():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(1, 3, 400), np.zeros(200, dtype=np.int64)]).astype(np.int64)
    for size in (1, 2, 4, 8, 32):
        at = np.arange(0, 400, size)
        k, d = periodic_runs.occurrences(x, at, size)
        want = {(j, e) for j, i in enumerate(at) for e in range(size, 2 * size) if (x[i:i + size] == x[i + e:i + e + size]).all()}
        assert set(zip(k.tolist(), d.tolist(), strict=True)) == want


def test_hash_clash_is_mended():
    w = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3, 4])
    assert periodic_runs._exact(w, 0, 13, 3, 3) == (0, 12) and periodic_runs._exact(w, 0, 12, 3, 3) == (0, 12)


@pytest.fixture(scope="module")
def periodic(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"é{x}" for x in made_words(rnd))) for i in range(150)]
    rows += [(200, "a " * 5000), (201, None), (202, ""), (203, " \n"), (204, ("ab c x y " * 9)), (205, "x" * 3_000_000), (206, "a b " * 300 + "c " * 7 + "d")]
    rows += [(300 + i, " ".join(f"w{rnd.randrange(500)}" for _ in range(3000))) for i in range(12)]
    return rows, spark.createDataFrame([(d, t, 1, [2]) for d, t in rows], "doc_id long, text string, n_words int, runs array<int>").repartition(4)


def test_periodic_runs(periodic):
    rows, docs = periodic
    out = periodic_runs.digest(periodic_runs.find_runs(docs, edit=queries.with_planted_period)).collect()
    assert sorted(map(tuple, out)) == sorted(plain_digest(d, t) for d, t in rows)
    found = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in found[200].runs] == [(0, 5000, 1)] and found[200].collapsed == "a"
    assert found[206].collapsed == "a b c d" and found[205].n_words == 1 and found[201].runs == []


def test_periodic_runs_odd_rows(odd, empty):
    out = periodic_runs.find_runs(odd).collect()
    assert len(out) == 8 and all(r.runs == [] for r in out) and periodic_runs.find_runs(empty).count() == 0
    assert periodic_runs.digest(periodic_runs.find_runs(odd, edit=queries.with_planted_period)).where("doc_id is null").count() == 3


# ------------------------------------------------- 12 importance draws ----
def test_crc_of_spans():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    lengths = np.array([1, 2, 63, 64, 65, 127, 128, 129, 1000, 70_000, *rng.integers(1, 200, 400)])
    starts = rng.integers(0, len(data) - lengths)
    got = importance.crc32_spans(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]
    assert len(importance.crc32_spans(data, starts[:0], lengths[:0])) == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_draw(rows, target, percent=10, least=20, buckets=10_000, runs=1, seed=2024):
    def count(words):
        return [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(words) - k + 1)]
    feats = [(d, len(plain_words(t)), count(plain_words(t))) for d, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for held, counts in ((s, [b for _, _, f in feats for b in f]), (t, [b for x in target for b in count(plain_words(x))])):
        for b in counts:
            held[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in feats:
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted((d, n, w, sc, rank.get(d)) for d, n, w, sc, _ in out)


@pytest.mark.parametrize("percent,least,runs,buckets", [(10, 20, 1, 10_000), (50, 3, 3, 97), (100, 0, 2, 10_000)])
def test_importance(spark, docs, rows, percent, least, runs, buckets):
    more = [(900, "lang" + "é" * 500 + " B2 x_Y"), (901, "漢字" * 4000), (902, "A1-b2 " * 30)]
    target = [rows[3][1], rows[5][1].upper(), None, "", "one B2"]
    every = docs.select("doc_id", "text", "n_chars").unionByName(spark.createDataFrame([(*r, 0) for r in more], "doc_id long, text string, n_chars long"))
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(target)], "item_id long, text string, n int")
    out = importance.resample(every, bench, percent, least, buckets, runs)
    assert sorted(map(tuple, importance.digest(out).collect()), key=lambda r: r[0]) == plain_draw([*rows, *more], target, percent, least, buckets, runs)


def test_importance_odd_rows(spark, docs, odd, empty):
    bench = spark.createDataFrame([(1, "word1 word2")], "item_id long, text string")
    out = importance.resample(odd, bench, 100, 1).collect()
    assert len(out) == 8 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3, 4]
    assert [r["rank"] for r in out if r.n_words == 0] == [None] * 4
    assert importance.resample(empty, bench).count() == 0
    assert importance.resample(docs, bench.limit(0)).where("rank is not null").count() == 7


def test_equal_scores_span_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("w " * 25).alias("text"))
        out = importance.resample(hot, hot.limit(0).select(F.col("doc_id").alias("item_id"), "text"), 50)
        assert sorted(r["rank"] for r in out.where("rank is not null").collect()) == list(range(1, 1501))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# --------------------------------------------------- 13 chat formatting ---
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<|turn|>x<|says|>", "<|end|>", "<<SYS>>a<</SYS>>", "<", "<|", "[", "[/INST", "é漢🙂 <s>", "", None,
         "<|part|>", "a\\<|image|>", "<<s>", "\n\t", "$1 $0", "<\\s>"]


def messages(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, piece string")
    return df.select("*", chat_format.text_part(df.text).alias("parts"))


def test_chat_round_trip(spark):
    rnd, rows = random.Random(3), []
    for c in range(60):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", "assi<|says|>stant", "\\", None]), "".join(rnd.choice(NASTY) or "" for _ in range(rnd.randint(0, 3))) or rnd.choice(NASTY), "x", "y"))
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(messages(spark, rnd.sample(rows, len(rows))))).collect()}
    digests = {r.conv_id: r for r in chat_format.digest(chat_format.read_back(chat_format.format_chat(messages(spark, rows)))).collect()}
    control = re.compile(r"</?s>|<</?SYS>>|\[/?INST\]|<\|(?!turn\|>|says\|>|end\|>)")
    for c in range(60):
        told = [(r or "", x or "") for d, _, r, x, *_ in rows if d == c]
        r = out[c]
        assert [tuple(x) for x in r.said] == told and r.learned == [x for role, x in told if role == "assistant"]
        assert not control.search(r.formatted) and r.formatted.count("<|turn|>") == len(told) == r.formatted.count("<|end|>")
        masked = [r.formatted[t.loss_start:t.loss_end] for t in r.turns if t.loss_start >= 0]
        assert [re.sub(r"\\(\\?)", r"\1", m) for m in masked] == r.learned and r.turns[-1].end == len(r.formatted)
        loss = "".join(r.learned)
        assert tuple(digests[c])[1:] == (len(told), brute.sha("".join(f"{a}\n{b}\n" for a, b in told)), len(loss), brute.sha(loss), len(r.formatted))


def test_chat_parts(spark):
    part = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int,extra:int>>"
    p = lambda kind, text=None, ref=None, w=None, h=None, s=None, n=None: (kind, text, ref, w, h, s, n, 0)
    rows = [(1, 0, "user", [p("text", "see"), p("image", ref="a.png", w=29, h=14), p("text", "and [INST]"), p("audio", ref="b.wav", s=2.5)]),
            (1, 1, "assistant", [p("document", ref="c.pdf", n=3), None, p("text", "done"), p("video", ref="d"), p(None, "plain")]),
            (1, 2, "user", None), (2, 0, "assistant", []), (2, 1, "user", [p("image")])]
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {part}"))).collect()}
    assert out[1].formatted == ("<|turn|>user<|says|>see<|part|><|image|><|part|>and [\\INST]<|part|><|audio|><|end|>"
                                "<|turn|>assistant<|says|><|document|><|part|>done<|part|><|attachment|><|part|>plain<|end|><|turn|>user<|says|><|end|>")
    assert [tuple(a) for a in out[1].attachments] == [(0, 1, "image", "a.png", 3), (0, 3, "audio", "b.wav", 63), (1, 0, "document", "c.pdf", 1536), (1, 2, "video", "d", 1)]
    assert out[2].formatted == "<|turn|>assistant<|says|><|end|><|turn|>user<|says|><|image|><|end|>" and out[2].learned == [""]
    assert [tuple(a) for a in out[2].attachments] == [(1, 0, "image", None, 1)]


def test_chat_odd_rows(spark):
    rows = [(None, 1, "user", "a", "", ""), (None, 1, "user", "a", "", ""), (4, 2, "assistant", "b", "", ""), (4, 2, "assistant", "b", "", ""),
            (4, None, None, None, "", ""), (4, 2, "assistant", "a", "", ""), (5, 0, "assistant", "z[" * 300_000, "", "")]
    out = sorted((r.conv_id or 0, [tuple(s) for s in r.said]) for r in chat_format.read_back(chat_format.format_chat(messages(spark, rows))).collect())
    assert out[:3] == [(0, [("user", "a")]), (0, [("user", "a")]), (4, [("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")])]
    assert out[3] == (5, [("assistant", "z[" * 300_000)])
    assert chat_format.format_chat(messages(spark, rows).limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    df = queries.op13_chat_format(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
