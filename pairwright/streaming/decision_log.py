"""A decision cache as a stream: new cache files extend the running confusion counts.

The batch readers rescan a cache; while a matcher is still writing it, this
query follows along. State is one row per pipeline run, and the keys already
seen; labels are a static side of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.metrics import KEYS, confusion_counts, is_match
from pairwright.sources.cache import lenient_records


def follow_documents(spark: SparkSession, directory: str) -> DataFrame:
    """``file, body`` of JSON files as they appear in a directory."""
    texts = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json")
    return texts.load(directory).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))


def running_confusion(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Confusion counts so far; a pair that is written twice counts once."""
    decided = lenient_records(documents).dropDuplicates(KEYS)
    joined = decided.join(labels.select(*KEYS, "label"), KEYS)
    return joined.groupBy().agg(*confusion_counts(is_match(F.col("verdict")), F.col("label") == 1))
