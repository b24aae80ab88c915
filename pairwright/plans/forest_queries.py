"""Queries over the random-forest matcher; rows only, as forests have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.operators.forest import predict_matches, train_matcher
from pairwright.operators.lookup import ground_truth, pair_candidates
from pairwright.operators.metrics import match_metrics
from pairwright.plans import standins as B
from pairwright.plans.registry import registered


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = B.products(spark, sf_dir)
    labeled = B.labeled_pairs(spark, sf_dir)
    train, valid, test = (
        labeled.filter(f"split = '{name}'").drop("split") for name in ("train", "valid", "test")
    )
    matcher = train_matcher(train, valid, goods, goods)
    return predict_matches(matcher, pair_candidates(test), goods, goods)


@registered()
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir)


@registered()
def forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = ground_truth(B.labeled_pairs(spark, sf_dir).filter("split = 'test'"))
    return match_metrics(_predictions(spark, sf_dir), truth)
