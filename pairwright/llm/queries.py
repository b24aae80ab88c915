"""The registered queries of this subpackage, with SQL where SQL can say them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import (
    ann, bpe, lm, near_dedup, packing, phrases, pii, quality, repair, secrets, sharding, token_counts, toxicity,
)
from pairwright.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(query: Query, oracle: str | None = None) -> None:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    QUERIES[query.__name__] = run
    if oracle is not None:
        ORACLES[query.__name__] = oracle


_register(lm.op1_lm_scoring)
_register(packing.op2_best_fit_packing)
_register(toxicity.op4_toxicity)
_register(token_counts.op5_token_counts)
_register(pii.op3_personal_data)
_register(bpe.op9_byte_bpe)
_register(near_dedup.op6_minhash_dedup)
_register(sharding.op7_sharding)
_register(quality.op8_quality_rules, quality.ORACLE)
_register(ann.op10_forest_neighbours)
_register(phrases.op11_phrase_collocations, phrases.ORACLE)
_register(repair.op12_conversation_repair, repair.ORACLE)
_register(secrets.op13_secret_scan)
