"""MinHash near-dedup: one-permutation hashing with optimal densification,
banded buckets and star-shaped candidate edges.

1. One pass over the texts gives, for each row, the size and a 128-bit digest
   of its shingle set and one key per band.  Rows with equal sets fold into
   one node (the least doc_id of the set), whatever their number.
2. Nodes that share a band key form a bucket.  Its least node is the hub and
   is paired with every other member: n - 1 pairs, not n * n / 2.
3. Pairs are confirmed on the full sets, which are made again from the texts
   of the nodes in question only.
4. Confirmed links give components.  A bucket whose members are not yet in one
   component gets more hubs (about HUB_GROWTH, then HUB_GROWTH^2, ..., drawn by
   a hash), each against its members in other components, until the bucket is
   one component or all its members have been hubs.  So the star shape loses no
   link between members of a bucket that could join two components.  Here a
   pair becomes a candidate only if its odd sketches allow the threshold: they
   bound the symmetric difference from below, so no link is lost by them, and
   members that are merely alike make few pairs.

The number of bands follows from the threshold so that a pair at the threshold
shares no bucket with probability below `miss`.

Null or empty texts have no shingles and are linked with nothing.  Rows that
share a doc_id are one document.  A row without doc_id takes part through its
text; its component is the least id of the documents it is linked with, null
if there is none.  Other columns of the input are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, record, texts, utf8
from .components import components
from .shingles import ODD_WORDS, OnePermutation, odd_sketch, shingle_sets

ROWS = 8
MISS = 1e-6
HUB_GROWTH = 16     # hubs of an unsettled bucket, per round
NAMELESS = 1 << 62  # nodes of rows without doc_id come above all ids


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, odd) of every row; null from digest on without shingles."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                     ("keys", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def step(batch, hasher):
        sets = shingle_sets(texts(batch), width)
        some = [s for s in sets if len(s)]
        keys = iter(hasher.band_keys(some) if some else ())
        return record(out, batch.column("doc_id"), [len(s) for s in sets],
                      [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                      [next(keys) if len(s) else None for s in sets], [odd_sketch(s) if len(s) else None for s in sets])

    return map_batches(utf8(docs), step, "doc_id long, n_shingles long, digest binary, keys array<long>, odd array<long>",
                       start=lambda: OnePermutation(bands, rows))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of documents with ids; rows without one are named by their set."""
    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def step(batch):
        sets = shingle_sets(texts(batch), width)
        return record(out, batch.column("doc_id"), [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.view(np.int64) for s in sets])

    made = map_batches(utf8(docs), step, "doc_id long, digest binary, shingles array<long>")
    return made.select(_node(F.col("doc_id"), F.col("digest")).alias("node"), "shingles")


def _node(doc_id, digest):
    return F.coalesce(doc_id, F.lit(NAMELESS) + F.xxhash64(digest).bitwiseAND(F.lit((1 << 61) - 1)))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    na, nb = F.size("sa"), F.size("sb")
    inter = F.size(F.array_intersect("sa", "sb"))
    # sets whose sizes are too far apart cannot pass and are not intersected
    fits = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return both.where(fits).where(100 * inter >= percent * (na + nb - inter)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS,
                    miss: float = MISS, trace: list | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sigs = scratch.save(signatures(docs, width, bands_for(percent, rows, miss), rows), "signatures")
    some = sigs.where("n_shingles > 0")
    nodes = scratch.save(some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
                         .select("digest", _node(F.col("doc_id"), F.col("digest")).alias("node")), "nodes")
    keyed = some.select("digest", "keys", "odd", "n_shingles", _node(F.col("doc_id"), F.col("digest")).alias("node"))
    first = keyed.join(nodes, ["digest", "node"], "left_semi").dropDuplicates(["digest", "node"])
    members = first.select("node", F.explode("keys").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    shared = scratch.save(members.join(hubs.select("bucket", "hub"), "bucket"), "buckets")

    pairs = scratch.save(shared.where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs-0")
    asked = shared.select("node").distinct()
    named = utf8(docs).select(F.col("doc_id").alias("node"), "text").join(asked, "node", "left_semi").select(F.col("node").alias("doc_id"), "text")
    sets = scratch.save(full_sets(named.union(utf8(docs).where("doc_id is null")), width), "sets")
    links = scratch.save(confirm(pairs, sets, percent), "links-0")
    found = components(links, scratch, "components-0")

    # buckets that are not one component yet: more hubs, until all members have been hubs
    label = F.coalesce("label", "node")
    tested, open_, hubs_each, k = pairs, shared.select("bucket", "node"), 1, 0
    sketches = first.select("node", "n_shingles", "odd")
    while True:
        placed = open_.join(found, "node", "left").withColumn("label", label)
        mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")) \
            .where((F.col("lo") < F.col("hi")) & (F.col("size") > (2 if k == 0 else hubs_each)))
        k, hubs_each = k + 1, hubs_each * HUB_GROWTH
        rest = scratch.save(placed.join(mixed.select("bucket", "size"), "bucket").join(sketches, "node") if k == 1 else
                            placed.join(mixed.select("bucket", F.col("size").alias("_")), "bucket").drop("_"), f"open-{k}")
        if rest.isEmpty():
            break
        draw = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30))
        hubs = rest.where(draw * F.col("size") < (1 << 30) * hubs_each).select(
            F.col("bucket").alias("at"), F.col("node").alias("hub"), F.col("label").alias("hub_label"), F.col("n_shingles").alias("hub_n"), F.col("odd").alias("hub_odd"))
        apart = sum((F.bit_count(F.get("odd", i).bitwiseXOR(F.get("hub_odd", i))) for i in range(ODD_WORDS)), F.lit(0))
        may = (100 + percent) * apart <= (100 - percent) * (F.col("n_shingles") + F.col("hub_n"))
        more = rest.join(hubs, (F.col("bucket") == F.col("at")) & (F.col("label") != F.col("hub_label")) & may) \
            .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(more, f"pairs-{k}")
        tested, open_ = tested.union(pairs), rest.drop("label")
        if trace is not None:
            trace.append((k, rest.count(), pairs.count()))
        # new links join components: their labels are the nodes of a small graph
        new = confirm(pairs, sets, percent)
        for x in ("a", "b"):
            new = new.join(found.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
        new = scratch.save(new.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b"), f"links-{k}")
        if not new.isEmpty():
            joined = components(new, scratch, f"joined-{k}").select(F.col("node").alias("label"), F.col("label").alias("to"))
            every = found.select("node", "label").union(shared.select("node", F.col("node").alias("label")).distinct().join(found, "node", "left_anti"))
            found = scratch.save(every.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"found-{k}")

    where = nodes.join(found, "node", "left").select("digest", F.coalesce("label", "node").alias("component"))
    placed = sigs.join(where, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("component") < F.lit(NAMELESS), F.col("component"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.expr("doc_id <=> component_id"))
