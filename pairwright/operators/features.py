"""The fourteen pair features, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import alignment as A
from pairwright.functions import similarity as S
from pairwright.operators.lookup import attach_products, spread

# Feature names, in feature-vector order.
FEATURE_NAMES = (
    "name_jaccard_qgm3",
    "name_cosine_tokens",
    "name_jaccard_tokens",
    "name_monge_elkan",
    "name_lev_dist",
    "name_lev_sim",
    "name_needleman_wunsch",
    "name_smith_waterman",
    "desc_jaccard_qgm3",
    "desc_cosine_tfidf",
    "price_exact_match",
    "price_abs_norm",
    "price_lev_dist",
    "price_lev_sim",
)


def feature_columns() -> list[Column]:
    """Feature expressions over ``source_*`` and ``target_*`` product fields."""
    names = F.col("source_name"), F.col("target_name")
    descriptions = F.col("source_description"), F.col("target_description")
    prices = F.col("source_price"), F.col("target_price")
    by_name = {
        "name_jaccard_qgm3": S.jaccard_qgrams(*names),
        "name_cosine_tokens": S.cosine_tokens(*names),
        "name_jaccard_tokens": S.jaccard_tokens(*names),
        "name_monge_elkan": A.monge_elkan(*names),
        "name_lev_dist": S.lev_dist(*names),
        "name_lev_sim": S.lev_sim(*names),
        "name_needleman_wunsch": A.needleman_wunsch(*names),
        "name_smith_waterman": A.smith_waterman(*names),
        "desc_jaccard_qgm3": S.jaccard_qgrams(*descriptions),
        "desc_cosine_tfidf": S.cosine_tfidf(*descriptions),
        "price_exact_match": S.price_exact_match(*prices),
        "price_abs_norm": S.abs_norm(*prices),
        "price_lev_dist": S.price_lev_dist(*prices),
        "price_lev_sim": S.price_lev_sim(*prices),
    }
    return [by_name[name].alias(name) for name in FEATURE_NAMES]


def pair_features(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pair keys, any label carried by ``pairs``, and the fourteen features."""
    kept = [F.col(c) for c in pairs.columns]
    joined = attach_products(pairs, sources, targets)
    return spread(joined, "source_id", "target_id").select(*kept, *feature_columns())


def feature_summary(features: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and population deviation of every feature."""
    long = features.unpivot([], list(FEATURE_NAMES), "feature", "value")
    return long.groupBy("feature").agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
        F.stddev_pop("value").alias("std_value"),
    )


def sample_rows(features: DataFrame, rows: int = 5, seed: int = 0) -> DataFrame:
    """A few random feature rows, for looking at."""
    return features.orderBy(F.rand(seed)).limit(rows)
