"""Inputs for the operators, derived from the given tables by Spark.

The product benchmark itself is not available here, so each operator input is
bound to a whole table that has its shape:

* products: ``part`` with the text of the equally numbered document as
  description;
* pairs: every part with its successor (the last one has none, which exercises
  the missing-product rules), labeled 1 when both parts have the same type;
* two shops for blocking: parts by size, up to 25 and above;
* labeled decision keys: every (part, supplier) of ``lineitem``, labeled 1 when
  a quantity of 46 or more was ever ordered;
* decisions: two pipelines times five runs over those keys, where hashes of the
  ids decide which verdicts are wrong, so that both engines derive the same rows;
* a bootstrap that SQL can follow: the same decisions over (supplier, return flag);
* explained pairs: the successors with model words in the names, two price levels and
  a reasoning by part key, so that every rule of the error taxonomies applies somewhere;
* text pairs: every document with its successor, whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.mixing import MASK, mixed, mixed_sql
from pairwright.operators.lookup import attach_products, spread

RUNS = 5
#: Lines of a partition of decision keys, about: what a task holds does not grow with the table.
LINES_A_PART = 400_000
#: Factors of the sums that are hashed to decide what goes wrong.
_P, _S, _RUN, _PIPELINE, _WHAT = 2654435761, 2246822519, 3266489917, 668265263, 374761393
PIPELINES = ("single_llm", "multi_agent")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _names_and_prices() -> list[Column]:
    price = F.when(F.col("p_size") == 50, "nan").otherwise(F.col("p_retailprice").cast("string"))
    return [F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("name"), price.alias("price")]


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("p_partkey"), F.col("text")
    )
    name, price = _names_and_prices()
    return part.join(texts, "p_partkey", "left").select(
        F.col("p_partkey").cast("string").alias("id"), name, F.coalesce("text", F.lit("")).alias("description"), price
    )


def named_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without the long description, for name-only operators."""
    name, price = _names_and_prices()
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), name, F.lit("").alias("description"), price
    )


def successor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("source_id"),
        (F.col("p_partkey") + 1).cast("string").alias("target_id"),
    )


def labeled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successor pairs with label and split (train, valid, test by part size)."""
    part = table(spark, sf_dir, "part")
    following = part.select(
        (F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("next_type")
    )
    return part.join(following, "p_partkey", "left").select(
        F.col("p_partkey").cast("string").alias("ltable_id"),
        (F.col("p_partkey") + 1).cast("string").alias("rtable_id"),
        F.coalesce((F.col("p_type") == F.col("next_type")).cast("int"), F.lit(0)).alias("label"),
        F.when(F.col("p_size") <= 30, "train")
        .when(F.col("p_size") <= 40, "valid")
        .otherwise("test")
        .alias("split"),
    )


#: What is said of a pair, by part key: a hint of every kind, and one that hints at nothing.
REASONS = (
    "the colour is another", "another version of it", "compact against full size", "one is an adapter",
    "one is expensive", "the price is far off", "a different brand", "another identifier", "a sparse listing",
    "unlike in every way", "cost in $ differs",
)


def explained_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successor pairs with their products and a reasoning."""
    goods = products(spark, sf_dir)
    key = F.col("id").cast("bigint")
    series, place = (100 + F.floor(key / 8)).cast("string"), key % 8
    model = (
        F.when(place.isin(0, 6, 7), F.concat(F.lit("TX-"), series, F.lit("A")))
        .when(place == 1, F.concat(F.lit("TX-"), series, F.lit("B")))
        .when(place == 2, F.concat(F.lit("QR"), series))
        .when(place == 3, F.concat(F.lit("QR-"), series))
        .when(place == 5, "oem")
    )
    dear = F.when(F.col("price") == "nan", "nan").otherwise((F.col("price").cast("double") * 2).cast("string"))
    goods = goods.withColumns(
        {"name": F.concat_ws(" ", "name", model), "price": F.when(key % 3 == 0, dear).otherwise(F.col("price"))}
    )
    joined = spread(attach_products(successor_pairs(spark, sf_dir), goods, goods), "source_id", "target_id")
    said = F.array(*map(F.lit, REASONS))
    turn = (F.col("source_id").cast("bigint") * 7 % len(REASONS)).cast("int")
    return joined.withColumn("reasoning", F.get(said, turn))


def shop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.concat_ws(" ", "p_brand", "p_name").alias("name"),
        F.when(F.col("p_size") <= 25, "source").otherwise("target").alias("shop"),
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    following = docs.select(
        (F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b")
    )
    pairs = docs.select("doc_id", F.col("text").alias("text_a")).join(following, "doc_id")
    return spread(pairs, "doc_id")


def key_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the decision keys, by the rows that the files of the table state."""
    lines = table(spark, sf_dir, "lineitem").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // LINES_A_PART))


def decision_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled (part, supplier) keys with integer key columns kept.

    They lie by their string keys, which decisions and labels are grouped and joined by, so
    that these need no further shuffle.
    """
    lines = table(spark, sf_dir, "lineitem")
    named = lines.select(
        F.col("l_partkey").cast("string").alias("source_id"), F.col("l_suppkey").cast("string").alias("target_id"), "l_quantity"
    )
    return (
        named.repartition(key_parts(spark, sf_dir), "source_id", "target_id")
        .groupBy("source_id", "target_id")
        .agg((F.max("l_quantity") >= 46).cast("int").alias("label"))
        .withColumns({"p": F.col("source_id").cast("bigint"), "s": F.col("target_id").cast("bigint")})
    )


def supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled (supplier, return flag) keys, few enough to follow a bootstrap in SQL.

    Suppliers meet all flags and most labels are 1, as F1 is undefined for a draw without any.
    """
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("p"), F.ascii("l_returnflag").cast("bigint").alias("s"))
        .agg((F.sum("l_orderkey") % 10 < 8).cast("int").alias("label"))
    )


def _keyed(keys: DataFrame) -> list[Column]:
    """The string keys, made where ``keys`` hold the integers alone."""
    names = {"source_id": "p", "target_id": "s"}
    return [F.col(n) if n in keys.columns else F.col(k).cast("string").alias(n) for n, k in names.items()]


def key_labels(keys: DataFrame) -> DataFrame:
    return keys.select(*_keyed(keys), "label")


def decision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_labels(decision_keys(spark, sf_dir))


def _chance(what: int) -> Column:
    """0 to 999 from key, pipeline and run, on its own for each thing it decides."""
    sums = F.col("key_sum") + F.col("run") * _RUN + F.col("pipeline_no") * _PIPELINE
    return mixed((sums + what * _WHAT).bitwiseAND(F.lit(MASK))) % 1000


def _verdict(wrong: Column) -> Column:
    says_match = (F.col("label") == 1) != wrong
    return F.when(says_match, "MATCH").otherwise("NO MATCH")


def _each(values: Sequence[int]) -> Column:
    """A row for each value; a single one needs no rows made and dropped."""
    return F.explode(F.array(*map(F.lit, values))) if len(values) > 1 else F.lit(values[0])


def key_decisions(keys: DataFrame, pipelines: Sequence[int] = (0, 1), runs: Sequence[int] = range(RUNS)) -> DataFrame:
    """One row per key, pipeline and run, agents filled for the second pipeline.

    Pipelines, runs and agents err on their own, so that every combination occurs. What
    depends on the key alone is computed before a key becomes ten rows, or as many as
    ``pipelines`` and ``runs`` name.
    """
    of_key = keys.select(
        *_keyed(keys), "label",
        (F.col("p") * _P + F.col("s") * _S).alias("key_sum"), (F.col("p") * 31 + F.col("s") * 17).alias("key_cents"),
    )
    rows = of_key.withColumn("pipeline_no", _each(pipelines)).withColumn("run", _each(runs))
    rows = rows.withColumns({f"h{what}": _chance(what) for what in range(4)})
    wrong = F.col("h0") < F.when(F.col("label") == 1, 40 + F.col("pipeline_no") * 60).otherwise(8)
    syn_wrong = F.col("h1") < F.when(F.col("label") == 1, 90).otherwise(9)
    sem_wrong = F.col("h2") < F.when(F.col("label") == 1, 160).otherwise(12)
    multi = F.col("pipeline_no") == 1
    cents = F.col("key_cents") + F.col("run") * 7 + F.col("pipeline_no") * 3
    return rows.select(
        F.when(multi, PIPELINES[1]).otherwise(PIPELINES[0]).alias("pipeline"),
        F.col("run"),
        F.col("source_id"),
        F.col("target_id"),
        F.col("label"),
        _verdict(wrong).alias("verdict"),
        ((cents % 51 + 50) / F.lit(100.0)).alias("confidence"),
        (F.col("h3") == 999).alias("parse_error"),
        ((500 + cents % 300) * F.when(multi, 8).otherwise(1)).cast("bigint").alias("tokens"),
        F.when(multi, _verdict(syn_wrong)).alias("syn_verdict"),
        F.when(multi, ((cents * 3) % 51 + 50) / F.lit(100.0)).alias("syn_confidence"),
        F.when(multi, _verdict(sem_wrong)).alias("sem_verdict"),
        F.when(multi, ((cents * 7) % 51 + 50) / F.lit(100.0)).alias("sem_confidence"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_decisions(decision_keys(spark, sf_dir))


# The same inputs as DuckDB common table expressions, for the oracles.

PRODUCTS_SQL = """
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id,
         p_brand || ' ' || p_name || ' ' || p_type AS name,
         coalesce(text, '') AS description,
         CASE WHEN p_size = 50 THEN 'nan' ELSE CAST(p_retailprice AS VARCHAR) END AS price
  FROM part LEFT JOIN documents ON doc_id = p_partkey)
"""

LABELED_SQL = """
labeled AS (
  SELECT CAST(a.p_partkey AS VARCHAR) AS ltable_id,
         CAST(a.p_partkey + 1 AS VARCHAR) AS rtable_id,
         coalesce(CAST(a.p_type = b.p_type AS INT), 0) AS label,
         CASE WHEN a.p_size <= 30 THEN 'train' WHEN a.p_size <= 40 THEN 'valid' ELSE 'test' END AS split
  FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1)
"""

PAIRED_SQL = (
    PRODUCTS_SQL
    + """,
paired AS MATERIALIZED (
  SELECT s.id AS source_id, t.id AS target_id,
         s.name AS source_name, t.name AS target_name,
         s.description AS source_description, t.description AS target_description,
         s.price AS source_price, t.price AS target_price
  FROM products s JOIN products t ON CAST(t.id AS BIGINT) = CAST(s.id AS BIGINT) + 1)
"""
)

def _explained_sql(side: str) -> str:
    key, series = f"{side}_key", f"(100 + {side}_key // 8)"
    return f"""
  {side}_name || coalesce(' ' || CASE WHEN {key} % 8 IN (0, 6, 7) THEN 'TX-' || {series} || 'A' WHEN {key} % 8 = 1 THEN 'TX-' || {series} || 'B'
    WHEN {key} % 8 = 2 THEN 'QR' || {series} WHEN {key} % 8 = 3 THEN 'QR-' || {series} WHEN {key} % 8 = 5 THEN 'oem' END, '') AS {side}_name,
  CASE WHEN {side}_price <> 'nan' THEN CAST({side}_price AS DOUBLE) * CASE WHEN {key} % 3 = 0 THEN 2 ELSE 1 END END AS {side}_number,
  {side}_description"""


EXPLAINED_SQL = (
    PAIRED_SQL
    + f""",
explained AS (
  SELECT source_id, target_id, {_explained_sql("source")}, {_explained_sql("target")},
         ({list(REASONS)})[source_key * 7 % {len(REASONS)} + 1] AS reasoning
  FROM (SELECT *, CAST(source_id AS BIGINT) AS source_key, CAST(target_id AS BIGINT) AS target_key FROM paired))
"""
)

TEXT_PAIRS_SQL = """
text_pairs AS (
  SELECT a.doc_id, a.text AS text_a, b.text AS text_b
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
"""

DECISION_KEYS_SQL = """
decision_keys AS (
  SELECT l_partkey AS p, l_suppkey AS s, CAST(max(l_quantity) >= 46 AS INT) AS label
  FROM lineitem GROUP BY 1, 2)
"""

SUPPLIER_KEYS_SQL = """
decision_keys AS (
  SELECT l_suppkey AS p, CAST(ascii(l_returnflag) AS BIGINT) AS s, CAST(sum(l_orderkey) % 10 < 8 AS INT) AS label
  FROM lineitem GROUP BY 1, 2)
"""

_CHANCES_SQL = ", ".join(f"{mixed_sql(f'x{what}')} % 1000 AS h{what}" for what in range(4))
_SUMS_SQL = ", ".join(f"(sums + {what * _WHAT}) & {MASK} AS x{what}" for what in range(4))
_OF_KEYS_SQL = f""",
salted AS (
  SELECT *, {_CHANCES_SQL} FROM (SELECT *, {_SUMS_SQL} FROM (
    SELECT k.*, pipeline_no, run, p * {_P} + s * {_S} + run * {_RUN} + pipeline_no * {_PIPELINE} AS sums,
           (p * 31 + s * 17 + run * 7 + pipeline_no * 3) AS cents
    FROM decision_keys k, (SELECT unnest(range(2)) AS pipeline_no), (SELECT unnest(range(5)) AS run)))),
decisions AS (
  SELECT CASE WHEN pipeline_no = 1 THEN 'multi_agent' ELSE 'single_llm' END AS pipeline,
         CAST(run AS INT) AS run, CAST(p AS VARCHAR) AS source_id, CAST(s AS VARCHAR) AS target_id, label,
         CASE WHEN (label = 1) <> (h0 < CASE WHEN label = 1 THEN 40 + 60 * pipeline_no ELSE 8 END)
              THEN 'MATCH' ELSE 'NO MATCH' END AS verdict,
         (cents % 51 + 50) / 100.0::DOUBLE AS confidence,
         h3 = 999 AS parse_error,
         CAST((500 + cents % 300) * CASE WHEN pipeline_no = 1 THEN 8 ELSE 1 END AS BIGINT) AS tokens,
         CASE WHEN pipeline_no = 1 THEN
           CASE WHEN (label = 1) <> (h1 < CASE WHEN label = 1 THEN 90 ELSE 9 END)
                THEN 'MATCH' ELSE 'NO MATCH' END END AS syn_verdict,
         CASE WHEN pipeline_no = 1 THEN (cents * 3 % 51 + 50) / 100.0::DOUBLE END AS syn_confidence,
         CASE WHEN pipeline_no = 1 THEN
           CASE WHEN (label = 1) <> (h2 < CASE WHEN label = 1 THEN 160 ELSE 12 END)
                THEN 'MATCH' ELSE 'NO MATCH' END END AS sem_verdict,
         CASE WHEN pipeline_no = 1 THEN (cents * 7 % 51 + 50) / 100.0::DOUBLE END AS sem_confidence
  FROM salted)
"""
DECISIONS_SQL = DECISION_KEYS_SQL + _OF_KEYS_SQL
SUPPLIER_DECISIONS_SQL = SUPPLIER_KEYS_SQL + _OF_KEYS_SQL
