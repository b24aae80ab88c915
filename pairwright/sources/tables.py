"""Product tables, labeled pairs, candidates and tuned parameters on storage."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairwright.operators.lookup import input_position
from pairwright.session import checkpointed

# File names of a dataset directory.
DATASET_FILES = {
    "sources": "tableA.csv",
    "targets": "tableB.csv",
    "train": "train.csv",
    "valid": "valid.csv",
    "test": "test.csv",
}

_PRODUCT = ("id", "name", "description", "price")
_PAIR = {"ltable_id": "string", "rtable_id": "string", "label": "int"}
_QUOTING = {"quote": '"', "escape": '"'}
_CANDIDATE = "source_id string, target_id string, similarity_score double"


@dataclass(frozen=True)
class Dataset:
    """Two product tables and three labeled splits."""

    sources: DataFrame
    targets: DataFrame
    train: DataFrame
    valid: DataFrame
    test: DataFrame


def _csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV without line breaks in fields, by header name, with the ``position`` of each row in the input."""
    raw = spark.read.csv(path, header=True, **_QUOTING)
    typed = [F.col(name).cast(kind).alias(name) for name, kind in columns.items()]
    return raw.select(*typed, input_position().alias("position"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text``: the records of CSV files, whose quoted fields may hold line breaks.

    Files are split like any text. A line starts a record when an even number of quotes
    comes before it in its file: tasks count quotes within a block, and sums over the blocks
    (a row for each split of the input) say with which parity and number each block begins,
    so a record may run over any number of blocks. Quotes must be paired, as RFC 4180 has
    it; a file where they are not raises. Records count from 1, which is the header.
    """
    at = F.col("position")
    lines = spark.read.text(path, lineSep="\n").select("value", input_position().alias("position"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.select(at["file"].alias("file"), at["block"].alias("block"), at["row"].alias("row"), "value", quotes.alias("quotes"))
    inside = Window.partitionBy("file", "block").orderBy("row")
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    # Starts so far in the block: ``even`` if it begins outside a quoted field, ``odd`` if inside one.
    lines = lines.withColumn("before", before)
    starts = {name: F.sum((F.col("before") == parity).cast("long")).over(inside) for parity, name in enumerate(("even", "odd"))}
    lines = checkpointed(lines.withColumns(starts).drop("before"))
    blocks = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("held"), F.max("even").alias("evens"), F.max("odd").alias("odds")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("held").over(earlier), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("inside"), F.col("odds")).otherwise(F.col("evens"))
    blocks = checkpointed(blocks.withColumn("first", F.coalesce(F.sum(begun).over(earlier), F.lit(0))).drop("evens", "odds"))
    unpaired = blocks.groupBy("file").agg(F.sum("held").alias("held")).filter("held % 2 = 1").first()
    if unpaired is not None:
        raise ValueError(f"{unpaired['file']}: quotes are not paired")
    here = F.col("first") + F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    whole = lines.join(blocks, ["file", "block"]).groupBy("file", here.alias("record")).agg(parts.alias("parts"))
    text = F.array_join(F.col("parts.value"), "\n")
    return whole.select("file", "record", F.regexp_replace(text, "\\r$", "").alias("text"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Products as strings: missing texts are empty, a missing price is ``nan``.

    Numeric prices are rendered as the number they are, as in ``199.0``;
    ``price_num`` keeps the number, null where there is none. Fields may hold line breaks
    and large files are read by many tasks all the same; blank lines are no rows.
    """
    header = ", ".join(f"`{name.replace('`', '``')}` string" for name in spark.read.csv(path, header=True, **_QUOTING).columns)
    records = csv_records(spark, path).filter("record > 1 AND text <> ''")
    raw = records.select(F.from_csv("text", F.lit(header), {**_QUOTING, "maxCharsPerColumn": "-1"}).alias("r")).select(
        *[F.col(f"r.{name}") for name in _PRODUCT]
    )
    number = F.col("price").try_cast("double")
    return raw.select(
        "id",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(number.cast("string"), "price", F.lit("nan")).alias("price"),
        F.when(~F.isnan(number), number).alias("price_num"),
    )


def read_pairs(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """Labeled pairs, on request with their place in the input; ids hold no line breaks, so files are split."""
    pairs = _csv(spark, path, _PAIR)
    return pairs if position else pairs.drop("position")


def load_dataset(spark: SparkSession, directory: str) -> Dataset:
    """The five tables of a dataset directory, pairs with their ``position``; missing files raise when read."""
    at = {name: f"{directory.rstrip('/')}/{file}" for name, file in DATASET_FILES.items()}
    return Dataset(
        sources=read_products(spark, at["sources"]),
        targets=read_products(spark, at["targets"]),
        train=read_pairs(spark, at["train"], position=True),
        valid=read_pairs(spark, at["valid"], position=True),
        test=read_pairs(spark, at["test"], position=True),
    )


def save_candidates(candidates: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write candidates in parallel, as parquet or as CSV with a header."""
    writer = candidates.write.mode("overwrite")
    if file_format == "csv":
        writer.csv(path, header=True)
    else:
        writer.parquet(path)


def load_candidates(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    if file_format == "csv":
        return spark.read.csv(path, header=True, schema=_CANDIDATE)
    return spark.read.schema(_CANDIDATE).parquet(path)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """One small document, written by a task to wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n\n")


def save_parameters(spark: SparkSession, result: dict, path: str) -> None:
    """Tuned parameters as one small JSON document on shared storage."""
    save_text(spark, json.dumps(result, indent=2, default=str), path)


def load_parameters(spark: SparkSession, path: str) -> tuple[dict | None, float]:
    """Tuned parameters and threshold, ``(None, 0.5)`` when there are none.

    Only a missing path counts as none; whatever else goes wrong is raised.
    """
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, 0.5
    found = json.loads(rows[0]["value"])
    return found["best_params"], float(found.get("best_threshold", 0.5))
