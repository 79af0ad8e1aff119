"""The pipeline's stages: each on what its predecessor kept."""

import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, at = {}, docs
    for name, stage in P.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns, name
        kept[name] = {r.doc_id: r for r in at.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept["quality"] for d in good) >= 0.97 * len(good)
    assert sum(d in kept["quality"] for d, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())
    groups = brute.groups([(d, r.text) for d, r in kept["quality"].items()], 5, 80)
    assert set(kept["near_dedup"]) == {d for d, (_, c) in groups.items() if c == d}
    rows = [(d, r.text) for d, r in kept["near_dedup"].items()]
    assert set(kept["decontaminate"]) == {r[0] for r in brute.contamination(rows, items) if not r[5]}
    assert set(kept["secrets"]) == set(kept["decontaminate"])
    for d, r in kept["secrets"].items():
        assert brute.secrets(r.text) == "" and r.n_chars == len(r.text)
        if not brute.secrets(first[d]):
            assert r.text == first[d] or re.search(r"\S{16,}", first[d])
    final = P.STAGES[-1][1](spark, at, SF)
    assert final.columns == ["doc_id", "n_tokens", "ids"] and final.count() == len(kept["secrets"])
    assert final.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_rows_without_ids_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, "x"), (3, text, "y"), (None, None, "z"), (4, text + " more words", "w")], "doc_id long, text string, lang string")
    out = P.near_dedup(spark, docs, SF)
    assert sorted(r.lang for r in out.collect()) == ["y", "z"]
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
