"""Named queries, each with the DuckDB text that computes the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwright.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with an oracle where SQL can say it."""

    def keep(query: Query) -> Query:
        @functools.wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        QUERIES[query.__name__] = run
        if oracle is not None:
            ORACLES[query.__name__] = oracle
        return query

    return keep
