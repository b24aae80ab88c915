"""Random-forest matching on the pair features, with Spark ML.

Spark's trees are binned and depth-limited, so a forest trained here is not
tree-for-tree the one another library grows; compare by F1, not by value.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.features import FEATURE_NAMES, pair_features
from pairwright.operators.lookup import (
    attach_labels,
    label_lookup,
    rename_pair_keys,
    take_pairs,
)
from pairwright.operators.metrics import KEYS, confusion_counts, with_rates
from pairwright.operators.thresholds import DEFAULT_THRESHOLD, best_threshold
from pairwright.session import checkpointed

# Default parameters, tuning grid, evaluation seeds, tuning seed.
DEFAULT_PARAMS = {
    "n_estimators": 50,
    "max_depth": None,
    "min_samples_split": 2,
    "max_features": "sqrt",
    "class_weight": "balanced",
}
PARAM_GRID = {
    "n_estimators": [10, 50, 100, 150, 200],
    "max_depth": [None, 10, 20, 30],
    "min_samples_split": [2, 5, 10],
    "max_features": ["sqrt", "log2", None],
    "class_weight": ["balanced", "balanced_subsample", None],
}
SEEDS = (2, 31, 76, 90, 101)
DEFAULT_SEED = 77

# The deepest tree Spark grows stands for unlimited depth.
_MAX_DEPTH = 30


@dataclass(frozen=True)
class Matcher:
    """A fitted forest and the probability from which it says MATCH."""

    model: RandomForestClassificationModel
    threshold: float


def assembled(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="vector").transform(features)


def training_rows(labeled: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Features and labels of labeled pairs; pairs without products drop out."""
    keyed = rename_pair_keys(labeled).select(
        *[F.col(k).cast("string").alias(k) for k in KEYS],
        *[c for c in ("split",) if c in labeled.columns],
    )
    # A pair labeled in both splits takes the later split's label.
    later = F.col("split") == "valid" if "split" in labeled.columns else F.lit(True)
    return attach_labels(pair_features(keyed, sources, targets), label_lookup(labeled, later))


def balanced_weights(rows: DataFrame) -> DataFrame:
    """Weight each class by n / (2 n_class); the two counts come from one aggregate."""
    counts = {row["label"]: row["n"] for row in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, total / (len(counts) * n)).otherwise(weight)
    return rows.withColumn("class_weight", weight)


def forest_settings(params: dict | None = None) -> tuple[dict, bool]:
    """What Spark is asked for, and whether classes are weighted.

    Parameters that Spark cannot tell apart give equal settings.
    """
    params = {**DEFAULT_PARAMS, **(params or {})}
    settings = {
        "numTrees": params["n_estimators"],
        "maxDepth": min(params["max_depth"] or _MAX_DEPTH, _MAX_DEPTH),
        # A split of k rows needs k/2 on each side at best; the nearest setting Spark has.
        "minInstancesPerNode": max(1, params["min_samples_split"] // 2),
        "featureSubsetStrategy": {"sqrt": "sqrt", "log2": "log2", None: "all"}[params["max_features"]],
    }
    return settings, params["class_weight"] is not None


def fit_forest(rows: DataFrame, params: dict | None = None, seed: int = DEFAULT_SEED) -> RandomForestClassificationModel:
    """Fit on assembled feature rows with a ``label`` column."""
    settings, weighted = forest_settings(params)
    # A row keeps the node it has reached in each tree; without, every level of the trees
    # would walk all rows down from the roots again, with the trees sent to all tasks.
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", maxMemoryInMB=512, cacheNodeIds=True, seed=seed, **settings
    )
    if not weighted:
        return forest.fit(rows)
    return forest.setWeightCol("class_weight").fit(balanced_weights(rows))


def match_probability(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """Add ``score``, the probability of class 1 (0 when it was never seen)."""
    if model.numClasses < 2:
        return rows.withColumn("score", F.lit(0.0))
    scored = model.transform(rows)
    return scored.withColumn("score", F.element_at(vector_to_array("probability"), 2)).drop(
        "probability", "rawPrediction", "prediction"
    )


def train_matcher(
    train: DataFrame,
    valid: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    params: dict | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    seed: int = DEFAULT_SEED,
) -> Matcher:
    """Fit on train and valid; a threshold of exactly 0.5 is tuned on valid."""
    splits = train.withColumn("split", F.lit("train")).unionByName(
        valid.withColumn("split", F.lit("valid"))
    )
    # Featurized once and reused by both fits and the sweep.
    rows = checkpointed(assembled(training_rows(splits, sources, targets)))
    if rows.isEmpty():
        raise RuntimeError("no features could be generated for the training pairs")
    model = fit_forest(rows, params, seed)
    if threshold == DEFAULT_THRESHOLD:
        only_train, only_valid = rows.filter("split = 'train'"), rows.filter("split = 'valid'")
        if not only_train.isEmpty() and not only_valid.isEmpty():
            trial = fit_forest(only_train, params, seed)
            if trial.numClasses > 1:
                threshold, _ = best_threshold(match_probability(trial, only_valid))
    return Matcher(model, threshold)


def predict_matches(
    matcher: Matcher,
    candidates: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    max_pairs: int | None = None,
) -> DataFrame:
    """Verdict and confidence of every candidate with both products."""
    pairs = take_pairs(candidates, max_pairs, KEYS).select(*KEYS)
    scored = match_probability(matcher.model, assembled(pair_features(pairs, sources, targets)))
    return scored.select(
        *KEYS,
        F.when(F.col("score") >= matcher.threshold, "MATCH").otherwise("NO MATCH").alias("verdict"),
        F.col("score").alias("confidence"),
        F.lit(False).alias("parse_error"),
    )


def feature_importances(matcher: Matcher) -> list[tuple[int, str, float]]:
    """Rank, feature and importance, most important first."""
    ranked = sorted(
        zip(FEATURE_NAMES, matcher.model.featureImportances.toArray()), key=lambda item: -item[1]
    )
    return [(rank, name, float(value)) for rank, (name, value) in enumerate(ranked, 1)]


def tune_forest(
    train: DataFrame,
    valid: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    grid: dict | None = None,
    seed: int = DEFAULT_SEED,
) -> dict:
    """Grid search on a fixed train/valid split by F1, then the best threshold.

    The first of equally good parameters wins. Each forest that Spark can tell apart is
    fitted once, and the best one is kept for its threshold.
    """
    grid = grid or PARAM_GRID
    fold = {
        name: checkpointed(assembled(training_rows(split, sources, targets)))
        for name, split in (("train", train), ("valid", valid))
    }
    for name, rows in fold.items():
        if rows.isEmpty():
            raise RuntimeError(f"no {name} pairs could have features extracted")
    best: tuple[float, dict, RandomForestClassificationModel] | None = None
    fitted = set()
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        settings, weighted = forest_settings(params)
        asked = (*settings.values(), weighted)
        if asked in fitted:  # as good as an earlier one, which won the tie
            continue
        fitted.add(asked)
        model = fit_forest(fold["train"], params, seed)
        scored = match_probability(model, fold["valid"])
        counts = scored.agg(*confusion_counts(F.col("score") > 0.5, F.col("label") == 1))
        f1 = with_rates(counts).first()["f1"]
        if best is None or f1 > best[0]:
            best = (f1, params, model)
    valid_f1, params, model = best
    scored = match_probability(model, fold["valid"])
    threshold, threshold_f1 = best_threshold(scored)
    return {
        "best_params": params,
        "valid_f1": round(valid_f1, 4),
        "best_threshold": round(threshold, 4),
        "threshold_f1": round(threshold_f1, 4),
    }
