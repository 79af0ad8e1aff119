"""Random forests of regression trees, grown tree by tree in Spark tasks (ML-5..7).

The training rows are binned once: at most BINS - 1 thresholds a feature, from
quantiles over all rows (one aggregate).  Trees are grown on the binned rows of a
bounded sample: all rows up to SAMPLE_ROWS, beyond that a share drawn by a hash of
their keys, so what is broadcast is at most SAMPLE_ROWS * (features + 8 * (targets + 1))
bytes.  Each tree draws its bootstrap from its number and grows level by level: per
level and candidate feature one histogram over all open nodes.  Trees of all targets
are grown in one job, both targets of a tree on the same draws.

The result is a Spark ML RandomForestRegressionModel (written in its public storage
format and loaded), so scoring, saving and importances are Spark's own.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BINS = 32
SAMPLE_ROWS = 1_000_000

NODE = "target int, tree int, id int, prediction double, impurity double, stats array<double>, n long, gain double, left int, right int, feature int, threshold double"
NODE_ARROW = pa.schema([("target", pa.int32()), ("tree", pa.int32()), ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
                        ("stats", pa.list_(pa.float64())), ("n", pa.int64()), ("gain", pa.float64()), ("left", pa.int32()), ("right", pa.int32()),
                        ("feature", pa.int32()), ("threshold", pa.float64())])


def thresholds(train: DataFrame, feats: list[str]) -> list[np.ndarray]:
    """Sorted distinct thresholds of each feature; a row is in bin k if it is above k of them.
    They stand a little above the quantiles, which are values of rows: a value whose sums were
    taken in another order (the stream's) falls on the same side."""
    cuts = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = train.agg(*[F.percentile_approx(F.col(f).cast("double"), cuts, 10_000).alias(f) for f in feats]).first()
    found = [np.unique(np.array([v for v in (row[f] or []) if np.isfinite(v)], dtype=float)) for f in feats]
    return [v + 1e-9 * np.maximum(1.0, np.abs(v)) for v in found]


def binned_sample(train: DataFrame, feats: list[str], targets: list[str], keys: list[str], cuts: list[np.ndarray], seed: int,
                  most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins: feature by row, targets: target by row, weights) in an order that does not
    depend on partitions."""
    n = train.count()
    key = F.xxhash64(F.lit(seed), *keys)
    rows = train.select(key.alias("_key"), *[F.col(t).cast("double").alias(f"_t{i}") for i, t in enumerate(targets)], F.col("weight").cast("double").alias("_w"),
                        *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, f in enumerate(feats)])
    if n > most:
        rows = rows.where(F.pmod(F.col("_key"), F.lit(1 << 31)) < int(most / n * (1 << 31)))
    names = ["_key", *[f"_t{i}" for i in range(len(targets))], "_w"]

    def run(batches):
        for b in batches:
            held = np.stack([np.searchsorted(c, b.column(f"_f{i}").to_numpy(zero_copy_only=False)).astype(np.uint8) for i, c in enumerate(cuts)], axis=1)
            packed = pa.array([r.tobytes() for r in held], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], packed], names=[*names, "_b"])
    schema = "_key long, " + ", ".join(f"_t{i} double" for i in range(len(targets))) + ", _w double, _b binary"
    t = rows.mapInArrow(run, schema).toArrow()
    y = np.stack([t.column(f"_t{i}").to_numpy() for i in range(len(targets))])
    w = t.column("_w").to_numpy()
    bins = np.frombuffer(b"".join(t.column("_b").to_pylist()), dtype=np.uint8).reshape(-1, len(feats))
    order = np.lexsort((w, *y[::-1], t.column("_key").to_numpy()))
    return np.ascontiguousarray(bins[order].T), y[:, order], w[order]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, depth: int, min_split: int, min_leaf: int, tried: int) -> list[tuple]:
    """Nodes (id, prediction, impurity, stats, rows, gain, left, right, feature, bin) of one
    tree, level by level; rows whose bin of `feature` is at most `bin` go left."""
    n_features, width = len(bins), int(bins.max(initial=0)) + 1
    rows, at, ids, nodes, level = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), np.array([0]), [], 0
    while len(ids):
        m, wr, yr = len(ids), w[rows], y[rows]
        count, sw = np.bincount(at, minlength=m), np.bincount(at, wr, m)
        sy, syy = np.bincount(at, wr * yr, m), np.bincount(at, wr * yr * yr, m)
        impurity = np.maximum(syy / sw - (sy / sw) ** 2, 0.0)
        gain, feature, cut = np.full(m, -1.0), np.full(m, -1), np.zeros(m, dtype=np.int64)
        # nodes that are pure or too small stay as they are, and their rows are left out
        tries = (count >= max(min_split, 2 * min_leaf)) & (impurity > 1e-12) & (level < depth)
        if tries.any():
            inside = tries[at]
            rows, at = rows[inside], (np.cumsum(tries) - 1)[at[inside]]
            wr, wy = wr[inside], wr[inside] * yr[inside]
            k, tries_at = int(tries.sum()), np.flatnonzero(tries)
            all_n, all_w, all_y = count[tries][:, None], sw[tries][:, None], sy[tries][:, None]
            top, top_f, top_cut = np.zeros(k), np.full(k, -1), np.zeros(k, dtype=np.int64)
            before = (all_y * all_y / all_w)[:, 0]
            some = rng.random((k, n_features)).argpartition(tried - 1, axis=1)[:, :tried]
            base = at * width
            for f in some.T:
                key = base + bins[f[at], rows]
                c = np.bincount(key, minlength=k * width).reshape(k, width).cumsum(axis=1)
                a = np.bincount(key, wr, k * width).reshape(k, width).cumsum(axis=1)
                b = np.bincount(key, wy, k * width).reshape(k, width).cumsum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    made = b * b / a + (all_y - b) ** 2 / (all_w - a)
                made[(c < min_leaf) | (all_n - c < min_leaf)] = -np.inf
                best = made.argmax(axis=1)
                found = made[np.arange(k), best] - before
                more = found > top
                top[more], top_f[more], top_cut[more] = found[more], f[more], best[more]
            gain[tries_at], feature[tries_at], cut[tries_at] = top / all_w[:, 0], top_f, top_cut
            split = (feature >= 0) & (gain > 1e-12 * impurity)
            at = tries_at[at]
        else:
            split, rows, at = np.zeros(m, dtype=bool), rows[:0], at[:0]
        first = ids[-1] + 1 + 2 * (np.cumsum(split) - 1)
        for i in range(m):
            s = bool(split[i])
            nodes.append((int(ids[i]), sy[i] / sw[i], impurity[i], [sw[i], sy[i], syy[i]], int(count[i]), gain[i] if s else -1.0,
                          int(first[i]) if s else -1, int(first[i]) + 1 if s else -1, int(feature[i]) if s else -1, int(cut[i])))
        keep = split[at]
        rows, at = rows[keep], at[keep]
        right = bins[feature[at], rows] > cut[at]
        at = 2 * (np.cumsum(split) - 1)[at] + right
        ids = ids[-1] + 1 + np.arange(2 * int(split.sum()))
        level += 1
    return nodes


def _as_model(spark: SparkSession, nodes: DataFrame, n_features: int, label: str, params: dict, features_col: str):
    """A RandomForestRegressionModel of the nodes (tree, id, ...)."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor

    # a stump fitted on two rows gives the metadata that belongs to this Spark version
    two = spark.createDataFrame([(Vectors.dense([v] * n_features), v, 1.0) for v in (0.0, 1.0)], [features_col, label, "weight"])
    stump = RandomForestRegressor(featuresCol=features_col, labelCol=label, weightCol="weight", numTrees=1, maxDepth=1, seed=params["random_state"]).fit(two)
    at = f"{checkpoint_dir(spark)}/forests/{uuid.uuid4().hex}"
    stump.write().overwrite().save(f"{at}/stump")
    meta = json.loads(spark.read.text(f"{at}/stump/metadata").first()[0])
    told = {"maxDepth": params["max_depth"], "minInstancesPerNode": params["min_samples_leaf"], "maxBins": BINS}
    meta["paramMap"].update({**told, "numTrees": params["n_estimators"], "featureSubsetStrategy": "sqrt"})
    meta["numTrees"], meta["numFeatures"] = params["n_estimators"], n_features
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{at}/forest/metadata")
    tree = json.loads(spark.read.parquet(f"{at}/stump/treesMetadata").first()["_2"])
    tree["paramMap"].update(told)
    spark.createDataFrame([(i, json.dumps({**tree, "uid": f"{tree['uid']}_{i}"}), 1.0) for i in range(params["n_estimators"])], "_1 int, _2 string, _3 double") \
        .coalesce(1).write.parquet(f"{at}/forest/treesMetadata")
    inner = F.col("feature") >= 0
    cut = F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>"))
    nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), "gain", F.col("left").alias("leftChild"),
        F.col("right").alias("rightChild"), F.struct(F.col("feature").alias("featureIndex"), cut.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split")
    ).alias("nodeData")).write.parquet(f"{at}/forest/data")
    return RandomForestRegressionModel.load(f"{at}/forest")


def fit(train: DataFrame, feats: list[str], targets: list[str], params: dict, keys: list[str], features_col: str = "_raw", most: int = SAMPLE_ROWS) -> list:
    """One forest per target from train(feats, targets, weight, keys)."""
    spark = train.sparkSession
    cuts = thresholds(train, feats)
    bins, y, w = binned_sample(train, feats, targets, keys, cuts, params["random_state"], most)
    if not len(w):
        raise ValueError("no rows to train on")
    shared = spark.sparkContext.broadcast((bins, y, w, cuts))
    n_trees, tried = params["n_estimators"], max(1, int(len(feats) ** 0.5))

    def run(batches):
        b_, y_, w_, cuts_ = shared.value
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                rng = np.random.default_rng([params["random_state"], tree])
                times = np.bincount(rng.integers(0, len(w_), len(w_)), minlength=len(w_))
                drawn = np.flatnonzero(times)
                mine, weight = b_[:, drawn], w_[drawn] * times[drawn]
                for k in range(len(y_)):
                    got = grow(mine, y_[k, drawn], weight, np.random.default_rng([params["random_state"], tree, 1]),
                               params["max_depth"], params.get("min_samples_split", 2), params["min_samples_leaf"], tried)
                    cols = list(zip(*got, strict=True))
                    cut = [float(cuts_[f][c]) if f >= 0 else 0.0 for f, c in zip(cols[8], cols[9], strict=True)]
                    held = [[k] * len(got), [tree] * len(got), *cols[:9], cut]
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(held, NODE_ARROW, strict=True)], schema=NODE_ARROW)
    tasks = min(n_trees, 4 * spark.sparkContext.defaultParallelism)
    path = f"{checkpoint_dir(spark)}/forests/nodes-{uuid.uuid4().hex}"
    spark.range(0, n_trees, 1, tasks).mapInArrow(run, NODE).write.parquet(path)
    shared.unpersist()
    nodes = spark.read.parquet(path)
    return [_as_model(spark, nodes.where(F.col("target") == k), len(feats), t, params, features_col) for k, t in enumerate(targets)]
