"""Training pipeline end to end on the small table (tiny forests)."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wearcast.operators import forest
from wearcast.plans import queries as Q
from wearcast.plans import training as TR

from .conftest import SF_SMALL


def test_train_save_load_score(spark, tmp_path):
    feats = Q.features(spark, SF_SMALL)
    path = str(tmp_path / "models")
    m = TR.train_and_score(feats, spark, params={"n_estimators": 5, "max_depth": 4, "cv_n_estimators": 10},
                           model_path=path)
    got = {r.name: r.value for r in m.collect()}
    assert got["n_features"] == 40 and got["n_total"] == feats.count()
    assert got["n_train"] >= got["n_total"] * 0.8 - 4   # upsampled train >= holdout cut
    assert 0 <= got["health_test_mae"] and "health_cv_mae_mean" in got
    loaded = TR.load_models(path)
    assert loaded is not None and len(loaded[2]["features"]) == 40
    h, r, _ = loaded
    pred = TR.predict_pair(feats.limit(50), h, r)
    assert pred.where("ml_health_pred IS NULL").count() == 0
    assert TR.load_models(str(tmp_path / "absent")) is None


def test_registered_query_trains_the_shipped_model(spark, monkeypatch):
    from wearcast.config import MODEL_PARAMS

    seen, fit = [], TR.fit_pair

    def small(train, feats, params):
        seen.append(dict(params))
        return fit(train, feats, {**params, "n_estimators": 2, "max_depth": 2})
    monkeypatch.setattr(TR, "fit_pair", small)
    Q.train_score(spark, SF_SMALL)
    full, fold = dict(MODEL_PARAMS), {**MODEL_PARAMS, "n_estimators": MODEL_PARAMS["cv_n_estimators"]}
    assert seen == [full, *[fold] * MODEL_PARAMS["cv_folds"], full]


def plain_tree(bins, y, w, depth, min_split, min_leaf):
    """Sum of squares gained by the best split of each node, by plain search (all features tried)."""
    def best(rows):
        out = (0.0, None, None)
        sse = lambda r: (w[r] * (y[r] - np.average(y[r], weights=w[r])) ** 2).sum()
        for f in range(len(bins)):
            for b in range(int(bins.max()) + 1):
                left, right = rows[bins[f][rows] <= b], rows[bins[f][rows] > b]
                if len(left) >= min_leaf and len(right) >= min_leaf:
                    gain = sse(rows) - sse(left) - sse(right)
                    if gain > out[0] + 1e-9:
                        out = (gain, f, b)
        return out

    def walk(rows, d):
        gain, f, b = best(rows) if d < depth and len(rows) >= min_split else (0.0, None, None)
        mean = np.average(y[rows], weights=w[rows])
        if f is None:
            return [(d, len(rows), round(mean, 9), None)]
        return [(d, len(rows), round(mean, 9), round(gain, 6)), *walk(rows[bins[f][rows] <= b], d + 1), *walk(rows[bins[f][rows] > b], d + 1)]
    return walk(np.arange(len(y)), 0)


def test_trees_match_a_plain_search():
    rng = np.random.default_rng(5)
    for depth, min_split, min_leaf in ((3, 10, 5), (4, 2, 1), (2, 30, 3)):
        bins = rng.integers(0, 6, (4, 80)).astype(np.uint8)
        y, w = rng.normal(size=80) + bins[1], rng.random(80) + 0.5
        nodes = {n[0]: n for n in forest.grow(bins, y, w, rng, depth, min_split, min_leaf, 4)}

        def walk(i, d):
            _, mean, _, stats, n, gain, left, right, _, _ = nodes[i]
            if left < 0:
                return [(d, n, round(mean, 9), None)]
            return [(d, n, round(mean, 9), round(gain * stats[0], 6)), *walk(left, d + 1), *walk(right, d + 1)]
        assert walk(0, 0) == plain_tree(bins, y, w, depth, min_split, min_leaf)
        assert all(nodes[i][6] > i for i in nodes if nodes[i][6] >= 0)


def test_forest_is_a_spark_model(spark):
    """Predictions of the loaded Spark model against a walk, quality on unseen rows, same
    result for other partitions, bounded sample, missing values."""
    rng = np.random.default_rng(6)
    x = rng.random((3000, 4))
    rows = [(i, *map(float, r), float(10 * r[0] + 5 * (r[1] > 0.5)), float(r[2]), 1.0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "mi long, a double, b double, c double, d double, y double, z double, weight double")
    df = df.withColumn("d", F.when(F.col("mi") % 7 > 0, F.col("d")))
    params = {"n_estimators": 12, "max_depth": 7, "min_samples_split": 10, "min_samples_leaf": 5, "random_state": 3}
    fit = lambda d, **k: forest.fit(d, ["a", "b", "c", "d"], ["y", "z"], params, ["mi"], **k)
    asm = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="_raw", handleInvalid="keep")
    train, test = df.where("mi < 2400"), asm.transform(df.where("mi >= 2400"))
    y, z = fit(train)
    got = [r.prediction for r in y.transform(test).orderBy("mi").collect()]
    again = [r.prediction for r in fit(train.repartition(7))[0].transform(test).orderBy("mi").collect()]
    assert got == again and y.getNumTrees == 12 and y.totalNumNodes > 200
    want = x[2400:, 0] * 10 + 5 * (x[2400:, 1] > 0.5)
    assert 1 - ((np.array(got) - want) ** 2).sum() / ((want - want.mean()) ** 2).sum() > 0.85
    assert y.featureImportances.toArray()[:2].sum() > 0.9 and z.featureImportances.toArray()[2] > 0.8
    few = fit(train, most=500)[0]
    assert few.trees[0].numNodes < y.trees[0].numNodes
    with pytest.raises(ValueError, match="no rows"):
        fit(train.limit(0))
