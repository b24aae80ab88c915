"""Names for SQL: the Arrow UDFs, callable from ``spark.sql`` once registered."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pairwright.functions import alignment

FUNCTIONS = {
    "needleman_wunsch": alignment.needleman_wunsch,
    "smith_waterman": alignment.smith_waterman,
    "jaro_winkler": alignment.jaro_winkler,
    "monge_elkan": alignment.monge_elkan,
    "edit_distance_ratio": alignment.tool_edit_distance,
}


def register_functions(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
