"""Matching pairs by asking a model, with decisions kept and replayed.

A task sends one prompt a row and returns the raw reply; prompts, the reading of
replies and what follows from them are Column expressions. Only pairs without a kept
decision are asked about. Their answers are written to the decision table before
anything reads them, so no model call is repeated by a second action, a recomputed
partition of a later stage, or a later run.

The table grows by batches, folders that Spark commits as a whole. A batch is named by
its number and a digest of the keys it answers, so a driver that repeats a batch replaces
it instead of doubling it. Two drivers that ask for the same keys at once make two
batches; readers keep the decision of the first of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.verdict import parse_verdict
from pairwright.matchers import prompts as P
from pairwright.matchers.clients import ChatClient
from pairwright.operators.decisions import consensus_fallback
from pairwright.operators.lookup import (
    attach_products,
    attach_products_or_flag,
    except_keys,
    spread,
    take_pairs,
)
from pairwright.operators.metrics import KEYS
from pairwright.session import checkpointed

ClientFactory = Callable[[], ChatClient]

_AGENT = "struct<verdict:string,confidence:double,reasoning:string,parse_error:boolean>"
FIELDS = {
    "source_id": "string",
    "target_id": "string",
    "verdict": "string",
    "confidence": "double",
    "reasoning": "string",
    "parse_error": "boolean",
    "prediction": "int",
    "syntactic": _AGENT,
    "semantic": _AGENT,
    "tokens": "bigint",
}


def _asked(rows: DataFrame, factory: ClientFactory, instructions: str, question: Column, name: str) -> DataFrame:
    """``rows`` with what the model replied to each question, read, as ``name`` and its tokens."""
    prompted = rows.withColumn("_question", question)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    schema = ", ".join([*kept, "_reply string", f"{name}_tokens bigint"])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        system = {"role": "system", "content": instructions}
        for frame in frames:
            said = [client.complete([system, {"role": "user", "content": q}]) for q in frame.pop("_question")]
            yield frame.assign(_reply=[r.content for r in said], **{f"{name}_tokens": [r.tokens for r in said]})

    replied = prompted.mapInPandas(ask, schema)
    return replied.withColumn(name, parse_verdict(F.col("_reply"))).drop("_reply")


def single_answers(pairs: DataFrame, sources: DataFrame, targets: DataFrame, factory: ClientFactory) -> DataFrame:
    """One call per pair; pairs without both products are dropped."""
    known = spread(attach_products(pairs.select(*KEYS), sources, targets), *KEYS)
    rows = known.select(*KEYS, P.pair_prompt(True).alias("question"))
    asked = _asked(rows, factory, P.SINGLE_INSTRUCTIONS, F.col("question"), "answer")
    return _decided(asked, {"tokens": F.col("answer_tokens")}, "answer")


def _decided(asked: DataFrame, more: dict[str, Column], final: str) -> DataFrame:
    """The fields of a decision: keys, the final answer's, and ``more``."""
    of_final = {n: F.col(f"{final}.{n}") for n in ("verdict", "confidence", "reasoning", "parse_error")}
    held = {n: F.col(n) for n in KEYS} | of_final | more
    return asked.select(*[held.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in FIELDS.items()])


def _review(agents: tuple[str, ...]) -> Column:
    fields = [F.col(f"{a}.{n}").cast("string") for a in agents for n in ("verdict", "confidence", "reasoning")]
    return F.format_string(P.REVIEW_LAYOUT, F.col("question"), *fields)


def agent_answers(pairs: DataFrame, sources: DataFrame, targets: DataFrame, factory: ClientFactory) -> DataFrame:
    """Two agents and an orchestrator per pair; a missing product is an unreadable NO MATCH.

    Each agent gets what its tools measure with the question, as Spark computes it.
    Where the orchestrator's reply can't be read, the agents' consensus stands in.
    """
    flagged = attach_products_or_flag(pairs.select(*KEYS), sources, targets)
    known = spread(flagged.filter(~F.col("missing_product")), *KEYS)
    rows = known.select(
        *KEYS,
        P.pair_prompt(False).alias("question"),
        P.syntactic_results().alias("measured"),
        P.semantic_results().alias("priced"),
    )
    rows = _asked(rows, factory, P.SYNTACTIC_INSTRUCTIONS, F.concat("question", "measured"), "syntactic").drop("measured")
    rows = _asked(rows, factory, P.SEMANTIC_INSTRUCTIONS, F.concat("question", "priced"), "semantic").drop("priced")
    rows = _asked(rows, factory, P.ORCHESTRATOR_INSTRUCTIONS, _review(("syntactic", "semantic")), "final")
    named = rows.withColumns(
        {f"{short}_{n}": F.col(f"{agent}.{n}") for short, agent in (("syn", "syntactic"), ("sem", "semantic")) for n in ("verdict", "confidence")}
    ).withColumns(consensus_fallback())
    lost = F.col("final.parse_error")
    verdict = F.when(lost, F.col("fallback_verdict")).otherwise(F.col("final.verdict"))
    asked = _decided(
        named,
        {
            "verdict": verdict,
            "confidence": F.when(lost, F.col("fallback_confidence")).otherwise(F.col("final.confidence")),
            "reasoning": F.when(lost, F.lit("consensus of the agents")).otherwise(F.col("final.reasoning")),
            "parse_error": F.col("syntactic.parse_error") | F.col("semantic.parse_error"),
            "prediction": (verdict == "MATCH").cast("int"),
            "syntactic": F.col("syntactic"),
            "semantic": F.col("semantic"),
            "tokens": F.col("syntactic_tokens") + F.col("semantic_tokens") + F.col("final_tokens"),
        },
        "final",
    )
    fixed = {
        "verdict": F.lit("NO MATCH"),
        "confidence": F.lit(0.0),
        "reasoning": F.lit("missing product data"),
        "parse_error": F.lit(True),
        "prediction": F.lit(0),
        "tokens": F.lit(0),
    }
    absent = flagged.filter("missing_product").select(
        *[
            (F.col(name) if name in KEYS else fixed.get(name, F.lit(None))).cast(kind).alias(name)
            for name, kind in FIELDS.items()
        ]
    )
    return asked.unionByName(absent)


def _written(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """These columns and the batch of all rows of all batches, empty where none was written yet."""
    columns = columns | {"batch": "string"}
    try:
        return spark.read.schema(", ".join(f"{name} {kind}" for name, kind in columns.items())).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # A limit of 0 tells the planner that there is nothing to join with.
        return spark.range(1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]).limit(0)


def kept_decisions(spark: SparkSession, path: str, of: dict[str, str] | None = None) -> DataFrame:
    """The decision table, one decision a key, empty where none was written yet.

    ``of`` names and types the folders above the batches, as ``{"run": "int"}`` for a
    table of runs; they are part of the key. Rows are sorted once, behind the shuffle, in
    an order that joins by the key go on with.
    """
    key = [*(of or {}), *KEYS]
    sooner = Window.partitionBy(*key).orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = _written(spark, path, FIELDS | (of or {})).withColumn("_place", F.count(F.lit(1)).over(sooner))
    return numbered.filter("_place = 1").select(*key, *[name for name in FIELDS if name not in KEYS])


def _next_batch(spark: SparkSession, path: str, misses: DataFrame) -> str:
    """A number after those of all batches that hold a decision, and a digest of the keys.

    The digest is of the count and of two sums of 64 bits a key, whatever their order.
    """
    last = _written(spark, path, {}).agg(F.max("batch")).first()[0]
    hashed = [F.xxhash64(F.lit(salt), KEYS[0], F.lit("|"), KEYS[1]) for salt in range(2)]
    sums = [F.sum(h.cast("decimal(20,0)")).cast("string") for h in hashed]
    digest = misses.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256)).first()[0]
    return f"{int(last.split('-')[0]) + 1 if last else 0:09d}-{digest[:16]}"


def match_with_replay(
    answers: Callable[[DataFrame, DataFrame, DataFrame, ClientFactory], DataFrame],
    pairs: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    factory: ClientFactory,
    path: str,
    max_pairs: int | None = None,
) -> DataFrame:
    """Decisions of all pairs: kept ones are replayed, the others asked and appended."""
    spark = pairs.sparkSession
    wanted = take_pairs(pairs, max_pairs, KEYS).select(*KEYS)
    # Keys alone are read: the planner takes them for as large as the files, and does not broadcast a long table.
    known = _written(spark, path, {name: FIELDS[name] for name in KEYS})
    misses = checkpointed(except_keys(wanted, known, KEYS).distinct())
    if not misses.isEmpty():
        batch = f"{path}/batch={_next_batch(spark, path, misses)}"
        answers(misses, sources, targets, factory).write.mode("overwrite").parquet(batch)
    return wanted.join(kept_decisions(spark, path), KEYS)
