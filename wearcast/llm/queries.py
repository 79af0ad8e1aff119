"""One query per operator: the operator over its whole table, and the digest
columns of its contract."""

from __future__ import annotations

import zlib

import public_tokenizers

from . import (
    bpe_codec,
    chat_format,
    decontam,
    importance,
    license_scan,
    minhash,
    periodic_runs,
    quality_gbt,
    secret_scan,
    spotsigs,
    suffix_dedup,
    token_count,
    url_filter,
)
from .common import table

TOKEN_LIMIT = 1024


def op1_license_scan(spark, sf):
    return license_scan.scan(table(spark, sf, "documents"))


def op2_suffix_dedup(spark, sf):
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf, "documents")))


def op3_minhash(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), width=3, percent=85)


def op4_spotsigs(spark, sf):
    return spotsigs.compare(table(spark, sf, "documents"))


def op5_bpe_codec(spark, sf):
    return bpe_codec.round_trip_digests(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf, "pages"), rules)


def op7_quality_gbt(spark, sf):
    docs = table(spark, sf, "documents")
    return quality_gbt.score(docs, quality_gbt.train(docs, table(spark, sf, "labels")))


def op8_token_count(spark, sf):
    counts = token_count.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                      specials=token_count.json_specials(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.select("doc_id", "n_bytes", "n_tokens", (counts.n_tokens > TOKEN_LIMIT).alias("over_limit"))


def op9_secret_scan(spark, sf):
    docs = table(spark, sf, "documents")
    return secret_scan.digest(docs, secret_scan.train(docs))


def op10_decontam(spark, sf):
    return decontam.digest(decontam.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op11's contract: of one doc_id in ten the last words repeat with a period."""
    number = zlib.crc32(str(doc_id).encode()) if doc_id is not None and words else 1
    if number % 10:
        return words
    g, n = number // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op11_periodic_runs(spark, sf):
    return periodic_runs.digest(periodic_runs.find_runs(table(spark, sf, "documents"), edit=with_planted_period))


def op12_importance(spark, sf):
    return importance.digest(importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


PLANTED_CHAT = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark, sf):
    told = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    told = told.unionByName(spark.sql(f"VALUES {chat_format.sql_rows(PLANTED_CHAT)} AS v(conv_id, turn, role, text)"))
    messages = told.select("conv_id", "turn", "role", chat_format.text_part(told.text).alias("parts"))
    return chat_format.digest(chat_format.read_back(chat_format.format_chat(messages)))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash": op3_minhash,
    "op4_spotsigs": op4_spotsigs,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_url_filter": op6_url_filter,
    "op7_quality_gbt": op7_quality_gbt,
    "op8_token_count": op8_token_count,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontam": op10_decontam,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance": op12_importance,
    "op13_chat_format": op13_chat_format,
}

ORACLE: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op6_url_filter": url_filter.oracle_sql(URL_RULES),
    "op13_chat_format": chat_format.oracle_sql(PLANTED_CHAT),
}
