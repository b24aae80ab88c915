"""Sharding: proportional stratified interleaving of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import stored, table, text_of

SHARDS = 24
SEED = 11
#: Rows that one window partition ranks, on average and at any size of the input.
BIN_ROWS = 2048

_UNIT = float(1 << 52)


def _fraction(*columns: Column | str) -> Column:
    """A fraction in [0, 1) that the columns' hash decides."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") / _UNIT


def _offsets(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and bin, how many rows of the key the bins before it hold."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))


def interleaved_shards(
    docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, source: str = "source",
    identity: tuple[str, ...] = ("doc_id",), bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: every shard has the mixture of the whole.

    The rows of a source are shuffled by a seeded hash and ranked; rank r of n stands at
    (r - u) / n, u a hash of the source, so that sources of one row spread as well. All
    rows in the order of these fractions are cut into ``shards`` runs whose row counts
    differ by one at most. A source's rows are evenly spaced in that order, so each shard has
    its share of it, give or take a row or two; where thousands of sources have a row
    or two each, those fall by chance and move the cuts by the square root of their number.

    Neither rank needs a source or all rows in one task: the shuffle hash, and later the
    fraction, falls into bins of about ``bin_rows`` rows; a row's rank is the count of the
    bins before plus its place in its own. Only counts by bin are summed up.

    A null source is a source. Rows that agree in source and ``identity`` are equal but
    for their other columns, which break the tie; equal rows change places freely. An
    empty table gives an empty one; shards may be empty when there are fewer rows.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    kept = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = stored(
        docs.select(
            kept.alias("row"),
            F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("src"),
            F.xxhash64(F.lit(seed), *identity).alias("h"),
            _fraction(F.lit(seed + 1), *identity).alias("shuffled"),
        ),
        "shard-rows",
    )
    total = rows.count()
    bins = max(1, round(total / bin_rows))
    sized = rows.groupBy("src").agg(F.count("*").alias("n"))
    binned = rows.withColumn("bin", F.floor(F.col("shuffled") * bins))
    inner = Window.partitionBy("src", "bin").orderBy("shuffled", "h", "row")
    ahead = _offsets(binned, ["src"])
    ranked = (
        binned.withColumn("place", F.row_number().over(inner))
        .join(ahead, ["src", "bin"])
        .join(sized, "src")
        .select(
            "row", "src", "h", "shuffled",
            (
                (F.col("ahead") + F.col("place") - _fraction(F.lit(seed + 2), "src")) / F.col("n")
            ).alias("fraction"),
        )
    )
    placed = stored(
        ranked.withColumn("bin", F.least(F.floor(F.col("fraction") * bins), F.lit(bins - 1))),
        "shard-fractions",
    )
    whole = Window.partitionBy("bin").orderBy("fraction", "src", "shuffled", "h", "row")
    position = F.col("ahead") + F.col("place") - 1
    # the first position of shard s is ceil(s * total / shards)
    shard = F.expr(f"(position * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("place", F.row_number().over(whole))
        .join(_offsets(placed.withColumn("all", F.lit(1)), ["all"]).drop("all"), "bin")
        .withColumn("position", position)
        .withColumn("shard", shard)
        .withColumn("slot", F.col("position") - first)
        .select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "source",
    )
    return interleaved_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
