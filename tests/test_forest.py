import itertools

import pytest

from pairwright.operators.features import FEATURE_NAMES
from pairwright.operators import forest as forest_module
from pairwright.operators.forest import (
    PARAM_GRID,
    feature_importances,
    forest_settings,
    predict_matches,
    train_matcher,
    tune_forest,
)
from pairwright.plans import forest_queries


def _goods(spark):
    names = ["sony dvd player", "apple ipad tablet", "lg monitor wide", "bosch drill kit"]
    rows = [(str(i), f"{names[i % 4]} {i // 4}", names[i % 4], str(10 + i % 4)) for i in range(24)]
    return spark.createDataFrame(rows, "id string, name string, description string, price string")


def _pairs(spark):
    rows = [(str(i), str(j), int(i % 4 == j % 4)) for i in range(12) for j in range(12, 24)]
    return spark.createDataFrame(rows, "ltable_id string, rtable_id string, label int")


def test_train_predict_and_tune(spark):
    goods, pairs = _goods(spark), _pairs(spark)
    train, valid = pairs.filter("ltable_id < '5'"), pairs.filter("ltable_id >= '5'")
    matcher = train_matcher(train, valid, goods, goods, {"n_estimators": 5, "max_depth": 5})
    candidates = pairs.withColumnsRenamed({"ltable_id": "source_id", "rtable_id": "target_id"})
    rows = predict_matches(matcher, candidates.drop("label"), goods, goods).collect()
    truth = {(r["source_id"], r["target_id"]): r["label"] for r in candidates.collect()}
    assert len(rows) == len(truth)
    assert all(0.0 <= r["confidence"] <= 1.0 and r["parse_error"] is False for r in rows)
    right = sum((r["verdict"] == "MATCH") == truth[(r["source_id"], r["target_id"])] for r in rows)
    assert right / len(rows) > 0.95
    assert predict_matches(matcher, candidates.drop("label"), goods, goods, 3).count() == 3
    ranked = feature_importances(matcher)
    assert [r[0] for r in ranked] == list(range(1, 15)) and {r[1] for r in ranked} == set(FEATURE_NAMES)
    grid = {"n_estimators": [3], "max_depth": [3, 5], "class_weight": ["balanced", None]}
    tuned = tune_forest(train, valid, goods, goods, grid)
    assert set(tuned) == {"best_params", "valid_f1", "best_threshold", "threshold_f1"} and tuned["valid_f1"] > 0.9


def test_registered_forest_trains_with_the_default_parameters(spark, monkeypatch):
    asked = []

    def fit(rows, params=None, seed=None):
        asked.append(params)
        raise StopIteration

    monkeypatch.setattr("pairwright.operators.forest.fit_forest", fit)
    with pytest.raises(StopIteration):
        forest_queries.forest_metrics(spark, "/root/testdata/sf0.001")
    assert asked == [None]


def test_no_forest_of_the_grid_is_fitted_twice(spark, monkeypatch):
    fits = []
    fit = forest_module.fit_forest

    def counted(rows, params=None, seed=0):
        fits.append(params)
        return fit(rows, params, seed)

    monkeypatch.setattr("pairwright.operators.forest.fit_forest", counted)
    goods, pairs = _goods(spark), _pairs(spark)
    grid = {"n_estimators": [2], "max_depth": [None, 30, 3], "class_weight": ["balanced", "balanced_subsample", None]}
    tuned = tune_forest(pairs.filter("ltable_id < '5'"), pairs.filter("ltable_id >= '5'"), goods, goods, grid)
    assert len(fits) == 4 and tuned["best_params"] in fits
    every = [dict(zip(PARAM_GRID, values)) for values in itertools.product(*PARAM_GRID.values())]
    distinct = {(*settings.values(), weighted) for settings, weighted in map(forest_settings, every)}
    assert len(every) == 540 and len(distinct) == 270


def test_rows_keep_their_nodes_and_the_trees_stay_the_same(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    numbers = spark.range(400, numPartitions=3).select(
        F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(89)).cast("double").alias("y"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)).cast("int").alias("label"),
    )
    rows = VectorAssembler(inputCols=["x", "y"], outputCol="vector").transform(numbers)
    params = {"n_estimators": 3, "class_weight": None}
    model = forest_module.fit_forest(rows, params)
    settings, _ = forest_module.forest_settings(params)
    plain = RandomForestClassifier(featuresCol="vector", labelCol="label", maxMemoryInMB=512, seed=forest_module.DEFAULT_SEED, **settings).fit(rows)
    assert model.getCacheNodeIds()
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]
