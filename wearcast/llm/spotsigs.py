"""Document fingerprints: SpotSigs, DataFrame operations only.

A signature is a chain of CHAIN content words behind a common-word anchor,
further anchors skipped.  Where no common word stands among the GAP words before a
content word (or since the start of the text), as in other languages, code and
lists, the word is an anchor itself if its hash is divisible by SHARE; this depends
on those words alone, so an edit moves only the signatures near it.  A text's
fingerprint is the set of its signatures as
sorted 32-bit hashes in hexadecimal, 8 digits each; two fingerprints are
compared by Jaccard likeness.  A text with words but without signatures has
its whole row of words as its one signature; without words the set is empty,
and two empty sets have likeness 1.

`near_duplicates` finds all pairs of fingerprints with likeness of at least a
threshold: equal fingerprints fold into one, sets are partitioned by length
(partners of one partition can only be in the same or the next), candidates
share a signature among their rarest ones, and the lengths and the places of
the shared signatures prune before the full sets are compared.

`with_next` gives each document the text of the next one in descending doc_id,
the first one to the last.  Rows go to ranges of doc_id of about RANGE_ROWS
rows, one shuffle of the texts; the first text of each range is handed to the
range before it.  Which range follows is found on range numbers alone.

Null texts are empty.  Rows of equal doc_id follow by a hash of the text; rows
without doc_id come last, by a hash of the text.  A single row is its own next
document.  Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: common words of English, German, French and Spanish
ANCHORS = ["the", "a", "of", "and", "to", "in", "is", "that", "der", "die", "und", "das", "ist", "zu", "den", "mit",
           "le", "la", "les", "de", "et", "des", "un", "que", "el", "los", "y", "en"]
CHAIN = 2
GAP, SHARE = 16, 4
RANGE_ROWS, MAX_RANGES, NULL_RANGES = 2000, 65536, 64


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda would evaluate a column
    expression from outside anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, gap: int = GAP, share: int = SHARE) -> Column:
    """Sorted distinct 32-bit signature hashes (long) of a text."""
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    none = F.array().cast("array<bigint>")

    def chains(ws, at, n):
        # content word k, at place at[k], starts a chain where a common word stands right before it,
        # or where the content word before it is an anchor of its own: at place i, with content
        # words alone before it, the one min(c, gap) before stands min(c, gap) places before i
        def alone(c):
            far = F.least(c, F.lit(gap))
            return (F.get(at, c - far) == F.get(at, c) - far) & ((c >= gap) | (F.get(at, c) == c))

        def start(k):
            behind = F.get(at, k) - F.when(k > 0, F.get(at, k - 1)).otherwise(-1) > 1
            return behind | ((k > 0) & (F.pmod(F.xxhash64(F.get(ws, k - 1)), F.lit(share)) == 0) & alone(k - 1))
        hashes = F.transform(ws, lambda w, k: F.when((k + chain <= n) & start(k), low(F.xxhash64(w, *[F.get(ws, k + c) for c in range(1, chain)]))))
        return F.array_compact(hashes)

    def of_words(words):
        placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~x["w"].isin(anchors))
        # a struct's field of an array is a copy of the array: taken once, not once a word
        found = _let(placed, lambda content: _let(content["w"], lambda ws: _let(content["i"], lambda at: _let(F.size(ws), lambda n: chains(ws, at, n)))))
        return _let(F.array_sort(F.array_distinct(found)), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(low(F.xxhash64(words)))))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return _let(words, lambda ws: F.when(F.size(ws) > 0, of_words(ws)).otherwise(none))


def fingerprint(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def near_duplicates(sets: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b, likeness): pairs a < b of classes of sets(doc_id, signature) whose
    likeness is at least percent / 100; a class is the least doc_id of equal sets."""
    t = percent / 100
    one = sets.where("size(signature) > 0").groupBy("signature").agg(F.min("doc_id").alias("doc_id"))
    step = math.log(1 / t)
    one = one.withColumn("n", F.size("signature")).withColumn("part", F.floor(F.log("n") / step).cast("int"))
    each = one.select("doc_id", "n", "part", F.explode("signature").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    place = Window.partitionBy("doc_id").orderBy("df", "s")
    # signatures that stand once are the rarest; they only move the others back
    shared = each.join(often, "s").withColumn("k", F.row_number().over(place)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    prefix = shared.withColumn("k", F.col("k") + F.col("n") - F.col("m")).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * t) + 1)
    left = prefix.select("s", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("pa"), F.col("doc_id").alias("a"),
                         F.col("n").alias("na"), F.col("k").alias("ka"))
    right = prefix.select("s", "part", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    most = F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) + F.least("ka", "kb")
    fits = (F.col("na") >= t * F.col("nb")) & (F.col("nb") >= t * F.col("na")) & (most >= F.col("na") + F.col("nb") - most - (1 - t) * (F.col("na") + F.col("nb")) - 1)
    pairs = left.join(right, ["s", "part"]).where((F.col("a") != F.col("b")) & ((F.col("pa") != F.col("part")) | (F.col("a") < F.col("b")))) \
        .where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda x, s: one.select(F.col("doc_id").alias(x), F.col("signature").alias(s))
    return pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b") \
        .select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= t)


def _ranges(docs: DataFrame, rows: int) -> Column:
    """Number of the range of a row's doc_id, ascending; below 0 without doc_id."""
    n, = docs.agg(F.count("doc_id")).first()
    k = min(MAX_RANGES, math.ceil(n / rows))
    null = -1 - F.pmod(F.xxhash64("text"), F.lit(NULL_RANGES)).cast("int")
    if k < 2:
        return F.when(F.col("doc_id").isNull(), null).otherwise(F.lit(0))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k)).first()[0]
    cuts = sorted(set(cuts))
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + wide] for i in range(0, len(cuts), wide)]
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("doc_id")))
    g = below(F.lit([x[0] for x in groups]))
    inside = below(F.element_at(F.array(*[F.lit(x) for x in groups]), F.greatest(g, F.lit(1))))
    return F.when(F.col("doc_id").isNull(), null).when(g == 0, 0).otherwise((g - 1) * wide + inside)


def with_next(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, next): the text of the next document in descending doc_id."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = plain.withColumn("range", _ranges(plain, rows))
    # first text of each range; the table of range numbers and ids has at most MAX_RANGES + NULL_RANGES rows
    tops = keyed.groupBy("range").agg(F.max("doc_id").alias("top")).withColumnRenamed("range", "at")
    first = keyed.join(F.broadcast(tops), (F.col("range") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = first.groupBy("range").agg(F.max_by("text", F.xxhash64("text")).alias("head"))
    down = Window.orderBy(F.col("at").desc())
    follows = tops.select("at", F.coalesce(F.lead("at").over(down), F.max("at").over(Window.partitionBy())).alias("next_at"))
    handed = follows.join(heads, F.col("next_at") == F.col("range")).select(F.col("at").alias("range"), "head")
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
    led = keyed.withColumn("next", F.lead("text").over(order))
    return led.join(handed, "range", "left").select("doc_id", "text", F.coalesce("next", "head").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) characters replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs(doc_id, text)."""
    pairs = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next")))
    sig = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("other"), signatures(F.col("next")).alias("following"))
    return sig.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
                      fingerprint(F.col("other")).alias("edited_fingerprint"),
                      likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
