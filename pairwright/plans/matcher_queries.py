"""Queries over the model matchers: prompts, replay of kept decisions, the offline client."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.matchers.clients import WordOverlapClient
from pairwright.matchers.pipelines import FIELDS, agent_answers, match_with_replay, single_answers
from pairwright.matchers.prompts import pair_prompt
from pairwright.operators.lookup import attach_products, input_position, take_pairs
from pairwright.operators.metrics import KEYS
from pairwright.plans import standins as B
from pairwright.plans.registry import registered
from pairwright.session import bucketed, scratch_path

#: Confidence from which the earlier run's decisions are kept in the replay, and the pairs of a short run.
SURE, FIRST = 0.75, 1000

_OVERLAP_SQL = "WITH " + B.PAIRED_SQL + """,
sets AS (
  SELECT source_id, target_id, list_distinct(string_split(lower(source_name), ' ')) AS a,
         list_distinct(string_split(lower(target_name), ' ')) AS b FROM paired),
scores AS (
  SELECT source_id, target_id, len(list_intersect(a, b)) AS k,
         len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS j FROM sets),
answers AS (
  SELECT source_id, target_id, CASE WHEN j >= 0.5 THEN 'MATCH' ELSE 'NO MATCH' END AS verdict,
         round(greatest(j, 1 - j), 6) AS confidence, k || ' shared words' AS reasoning FROM scores)
"""


@registered(_OVERLAP_SQL + "SELECT *, false AS parse_error FROM answers")
def single_call_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.named_products(spark, sf_dir)
    decided = single_answers(B.successor_pairs(spark, sf_dir), names, names, WordOverlapClient)
    return decided.select(
        "source_id", "target_id", "verdict", F.round("confidence", 6).alias("confidence"), "reasoning", "parse_error"
    )


@registered(
    _OVERLAP_SQL + """
SELECT source_id, target_id, verdict, confidence, CAST(verdict = 'MATCH' AS INT) AS prediction, verdict AS syn_verdict, false AS parse_error FROM answers
UNION ALL
SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR), 'NO MATCH', 0.0::DOUBLE, 0, NULL, true
FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = a.p_partkey + 1)
"""
)
def agent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.named_products(spark, sf_dir)
    decided = agent_answers(B.successor_pairs(spark, sf_dir), names, names, WordOverlapClient)
    return decided.select(
        "source_id",
        "target_id",
        "verdict",
        F.round("confidence", 6).alias("confidence"),
        "prediction",
        F.col("syntactic.verdict").alias("syn_verdict"),
        "parse_error",
    )


@registered(
    "WITH " + B.PAIRED_SQL + """
SELECT source_id, target_id, md5(
  'Product A:' || chr(10) || '  Name: ' || source_name || chr(10) || '  Description: ' || source_description || chr(10)
  || '  Price: ' || CASE WHEN source_price = 'nan' THEN 'N/A' ELSE source_price END || chr(10) || chr(10)
  || 'Product B:' || chr(10) || '  Name: ' || target_name || chr(10) || '  Description: ' || target_description || chr(10)
  || '  Price: ' || CASE WHEN target_price = 'nan' THEN 'N/A' ELSE target_price END || chr(10) || chr(10)
  || 'Are Product A and Product B the same product?') AS prompt_md5
FROM paired
"""
)
def pair_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = B.products(spark, sf_dir)
    joined = attach_products(B.successor_pairs(spark, sf_dir), goods, goods)
    return joined.select("source_id", "target_id", F.md5(pair_prompt(True)).alias("prompt_md5"))


@registered(
    "WITH " + B.DECISIONS_SQL + f""",
runs AS (SELECT * FROM decisions WHERE pipeline = 'single_llm'),
sure AS (SELECT source_id, target_id FROM runs WHERE run = 0 AND confidence >= {SURE})
SELECT source_id, target_id, run, verdict, confidence, parse_error, tokens
FROM runs LEFT JOIN sure s USING (source_id, target_id)
WHERE run = CASE WHEN s.source_id IS NULL THEN 1 ELSE 0 END
"""
)
def replayed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure decisions of run 0 are kept, run 1 answers what is missing, run 2 is never asked.

    The keys are met six times: they are made once and lie in buckets. A run answers for
    the misses alone.
    """
    every = bucketed(B.decision_labels(spark, sf_dir), B.key_parts(spark, sf_dir), *KEYS)
    path = scratch_path(spark)

    def decided(run: int, keys: DataFrame) -> DataFrame:
        numbered = keys.withColumns({"p": F.col("source_id").cast("bigint"), "s": F.col("target_id").cast("bigint")})
        return B.key_decisions(numbered, [B.PIPELINES.index("single_llm")], [run]).withColumn("reasoning", F.col("run").cast("string"))

    def answered(run: int, pairs: DataFrame) -> DataFrame:
        def look_up(misses: DataFrame, *_: object) -> DataFrame:
            found = decided(run, every.join(misses, KEYS, "left_semi"))
            return found.select(
                *[(F.col(n) if n in found.columns else F.lit(None)).cast(kind).alias(n) for n, kind in FIELDS.items()]
            )

        return match_with_replay(look_up, pairs, None, None, None, path)

    answered(0, decided(0, every).filter(F.col("confidence") >= SURE))
    answered(1, every)
    return answered(2, every).select(
        *KEYS, F.col("reasoning").cast("int").alias("run"), "verdict", "confidence", "parse_error", "tokens"
    )


@registered(
    "SELECT CAST(l_orderkey AS VARCHAR) AS source_id, CAST(l_partkey AS VARCHAR) AS target_id, "
    f"CAST(l_linenumber AS INT) AS line FROM lineitem LIMIT {FIRST}"
)
def first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a short run: those a sequential reader of the table meets first."""
    rows = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ltable_id"), F.col("l_partkey").alias("rtable_id"), "l_linenumber",
        input_position().alias("position"),
    )
    return take_pairs(rows, FIRST, ["ltable_id", "rtable_id"]).select(
        F.col("ltable_id").cast("string").alias("source_id"), F.col("rtable_id").cast("string").alias("target_id"),
        F.col("l_linenumber").cast("int").alias("line"),
    )
