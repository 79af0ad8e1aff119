"""URL filters: sort-merge range join of reversed-host keys, DataFrame operations only.

The key of a host is its labels in reverse, each followed by a full stop:
www.example.com gives com.example.www.  A rule's host and all its subdomains are
then exactly the keys that start with the rule's key: the interval from that
key to the same key with its last stop raised to the next character.  Such
intervals nest or are apart.

Rules of one host form one entry; its chain holds the rules of the host and of
its ancestors.  Interval starts (which put the entry on top of the stack) and
ends (which bring its parent back) are sorted together with the page keys, and
a running last value gives each page the entry on top of the stack.  The chain
is the stack below it; the longest rule whose path starts the page's path wins.

The sweep is cut into key ranges by sampled page keys, and each range
into SALTS parts by page, so that neither a frequent host nor a frequent domain
meets in one task; the stack at the start of a range comes from a summary of
the ranges before it (RANGES rows).

A null url, or one without ://, has an empty host and path and fits no rule.
Where no rule fits, the verdict is the method's: allow.  Rules with a null or
empty host or a null verdict are left out; a null path is empty.  Of rules that
are equal in host and path the least verdict holds.  Repeated rows are judged
each for itself; empty tables give empty results (no rules: allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, SALTS = 64, 8
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def entries(rules: DataFrame) -> DataFrame:
    """(key, parent, chain): one row per rule host; chain has the rules (path,
    rule, verdict) of the host and its ancestors, parent is null at the top."""
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict") \
                 .where("host <> '' and verdict is not null")
    one = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = one.groupBy(host_key(F.col("host")).alias("key")).agg(F.collect_list(F.struct(
        (F.length("host") + F.length("path")).alias("size"), "path", F.concat("host", "path").alias("rule"), "verdict")).alias("rules"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    up = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                                 lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("above"))
    found = up.join(own.select(F.col("key").alias("above"), "rules"), "above")
    return found.groupBy("key").agg(F.max(F.when(F.col("above") < F.col("key"), F.col("above"))).alias("parent"),
                                    F.flatten(F.collect_list("rules")).alias("chain"))


def judge(pages: DataFrame, rules: DataFrame, ranges: int = RANGES, salts: int = SALTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url)."""
    spark = pages.sparkSession
    urls = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = urls.withColumn("key", host_key(F.col("host")))
    tops = entries(rules)
    borders = _borders(keyed, ranges)
    number = F.size(F.filter(F.lit(borders) if borders else F.array().cast("array<string>"), lambda b: b <= F.col("key")))

    open_ = tops.select("key", F.lit(1).alias("kind"), F.col("key").alias("top"), "chain")
    close = tops.select(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), F.lit(0).alias("kind"), "parent")
    close = close.join(tops.select(F.col("key").alias("parent"), "chain"), "parent", "left") \
                 .select("key", "kind", F.col("parent").alias("top"), "chain")
    empty = F.array().cast(tops.schema["chain"].dataType)
    events = open_.union(close).select("key", "kind", F.coalesce("chain", empty).alias("chain")).withColumn("range", number)
    # the stack at the start of each range: the last event of the ranges before it
    depth = F.length("key")
    last = events.groupBy("range").agg(F.max_by("chain", F.struct("key", "kind", depth)).alias("chain"))
    all_ranges = spark.range(len(borders) + 1).select(F.col("id").cast("int").alias("range"))
    carried = all_ranges.join(last, "range", "left").select("range", F.last("chain", True).over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("chain")).where("chain is not null")
    marks = events.select("range", "key", "kind", "chain").union(carried.select("range", F.lit("").alias("key"), F.lit(-1).alias("kind"), "chain"))
    salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    null = F.lit(None)
    both = salted.select("range", "salt", "key", "kind", "chain", null.cast(keyed.schema["page_id"].dataType).alias("page_id"),
                         null.cast("string").alias("host"), null.cast("string").alias("path")) \
        .union(keyed.select(number.alias("range"), F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int").alias("salt"), "key",
                            F.lit(2).alias("kind"), F.lit(None).cast(tops.schema["chain"].dataType).alias("chain"), "page_id", "host", "path"))
    # at one key: ends, then starts, then pages
    sweep = Window.partitionBy("range", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("stack", F.last("chain", True).over(sweep)).where("kind = 2")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)
    return swept.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))


def oracle_sql(rules: list[tuple[str, str, str]]) -> str:
    """The result of `judge` for these rules in DuckDB SQL over `pages` (page_id unique)."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(h, p, v) AS (VALUES {values})
SELECT page_id, host, path, arg_max(h || p, length(h) + length(p)) AS rule,
       coalesce(arg_max(v, length(h) + length(p)), '{DEFAULT}') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path"""


def _borders(keyed: DataFrame, ranges: int, each: int = 16) -> list[str]:
    """Fewer than `ranges` keys that cut the pages into like shares, from the
    ranges * each rows with the least hash; they place rows, no result depends on them."""
    rows = keyed.where("host <> ''").orderBy(F.xxhash64("page_id", "host", "path")).limit(ranges * each).select("key").collect()
    keys = sorted(r.key for r in rows)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
