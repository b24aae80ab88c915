"""Joins between pairs, products and labels, one function per miss behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRODUCT_FIELDS = ("name", "description", "price")


def rename_pair_keys(pairs: DataFrame) -> DataFrame:
    """``ltable_id, rtable_id`` become ``source_id, target_id``."""
    return pairs.withColumnsRenamed({"ltable_id": "source_id", "rtable_id": "target_id"})


def pair_candidates(labeled: DataFrame) -> DataFrame:
    """Labeled pairs without their label, ids as strings; where they stood stays with them."""
    return labeled.select(
        F.col("ltable_id").cast("string").alias("source_id"),
        F.col("rtable_id").cast("string").alias("target_id"),
        *[c for c in ("position",) if c in labeled.columns],
    )


def last_row_wins(table: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last by ``order``. The maximum combines map-side."""
    values = [c for c in table.columns if c not in keys]
    picked = F.max_by(F.struct(*values), order).alias("row")
    return table.groupBy(*keys).agg(picked).select(*keys, "row.*")


def product_lookup(products: DataFrame, order: Column | None = None) -> DataFrame:
    """Products keyed by string id. Without an order the ids must be unique."""
    typed = products.select(
        F.col("id").cast("string").alias("id"),
        *[F.col(f).cast("string").alias(f) for f in PRODUCT_FIELDS],
        *([order.alias("_order")] if order is not None else []),
    )
    if order is None:
        return typed
    return last_row_wins(typed, ["id"], F.col("_order")).select("id", *PRODUCT_FIELDS)


def label_lookup(labeled: DataFrame, order: Column | None = None) -> DataFrame:
    """Labels keyed by pair; with an order, the last duplicate wins."""
    typed = labeled.select(
        F.col("ltable_id").cast("string").alias("source_id"),
        F.col("rtable_id").cast("string").alias("target_id"),
        F.col("label").cast("int").alias("label"),
        *([order.alias("_order")] if order is not None else []),
    )
    if order is None:
        return typed
    return last_row_wins(typed, ["source_id", "target_id"], F.col("_order")).select(
        "source_id", "target_id", "label"
    )


def ground_truth(labeled: DataFrame) -> DataFrame:
    """Distinct pair keys whose label is 1."""
    return pair_candidates(labeled.filter(F.col("label") == 1)).select("source_id", "target_id").distinct()


def spread(pairs: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows evenly before per-row work that costs more than a shuffle.

    Hashing the whole pair keeps a hot source or target from landing in one
    partition, and the explicit count keeps adaptive execution from merging the
    partitions of a table that is small in bytes but expensive per row.
    """
    count = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(count, *keys)


def _side(products: DataFrame, side: str, flag: bool = False) -> DataFrame:
    return products.select(
        F.col("id").alias(f"{side}_id"),
        *[F.col(f).alias(f"{side}_{f}") for f in PRODUCT_FIELDS],
        *([F.lit(True).alias(f"{side}_found")] if flag else []),
    )


def attach_products(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Both products next to each pair; pairs missing either one are dropped.

    Two plain equi-joins: the planner broadcasts a product table whose measured
    size is below the session's threshold, and adaptive execution splits a hot
    product's partition otherwise.
    """
    return pairs.join(_side(sources, "source"), "source_id").join(
        _side(targets, "target"), "target_id"
    )


def attach_products_or_flag(
    pairs: DataFrame, sources: DataFrame, targets: DataFrame
) -> DataFrame:
    """Keep every pair; ``missing_product`` marks those without both products."""
    joined = pairs.join(_side(sources, "source", True), "source_id", "left").join(
        _side(targets, "target", True), "target_id", "left"
    )
    missing = F.col("source_found").isNull() | F.col("target_found").isNull()
    return joined.withColumn("missing_product", missing).drop("source_found", "target_found")


def attach_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each row's pair, 0 where the pair is unlabeled."""
    return rows.join(labels, ["source_id", "target_id"], "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )


def input_position() -> Column:
    """File, block and number of a row, to be selected right from a scan of files.

    A task reads the rows of a block one after another, so within a block the numbers
    follow each other without a gap.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def first_in_input(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in the order of files and of lines in them.

    ``rows`` are all rows of a scan with their ``position``. Nothing is sorted: rows are
    counted by block, sums over the blocks (a row for each split of the input, the only
    thing one task sees whole) say how many each block gives, and the scan is filtered.
    """
    at = F.col("position")
    blocks = rows.groupBy(at["file"].alias("_file"), at["block"].alias("_block")).agg(
        F.count("*").alias("_held"), F.min(at["row"]).alias("_from")
    )
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    giving = blocks.withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0))).filter(F.col("_before") < n)
    met = rows.join(giving, (at["file"] == F.col("_file")) & (at["block"] == F.col("_block")))
    return met.filter(at["row"] - F.col("_from") < n - F.col("_before")).select(*rows.columns)


def take_pairs(pairs: DataFrame, max_pairs: int | None, order: list[str]) -> DataFrame:
    """First ``max_pairs`` pairs; ``None`` and 0 mean all of them.

    Pairs that know their position in the input are taken in that order, others by ``order``.
    """
    if not max_pairs:
        return pairs
    if "position" in pairs.columns:
        return first_in_input(pairs, max_pairs)
    return pairs.orderBy(*order).limit(max_pairs)


def except_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(*keys), keys, "left_anti")
