"""Ensembles, agent arbitration and disagreement between two pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.similarity import DECIMAL
from pairwright.operators.metrics import (
    KEYS,
    confusion_counts,
    count_if,
    is_match,
    ratio,
    with_rates,
)

# Fixed value: confidence from which an agreement counts as confident.
HIGH_CONFIDENCE = 0.9


def side_by_side(single: DataFrame, multi: DataFrame, labels: DataFrame) -> DataFrame:
    """Labeled pairs decided by both pipelines, one row each."""
    fields = [c for c in ("verdict", "confidence", "reasoning", "tokens") if c in single.columns]
    left = single.select(*KEYS, *[F.col(c).alias(f"single_{c}") for c in fields])
    right = multi.select(*KEYS, *[F.col(c).alias(f"multi_{c}") for c in fields])
    return labels.select(*KEYS, "label").join(left, KEYS).join(right, KEYS)


def _scored_policies(rows: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """Confusion and harmonic F1 of several 0/1 policies in one aggregation."""
    long = rows.select((F.col("label") == 1).alias("actual"), *[c.alias(n) for n, c in policies.items()])
    stacked = long.unpivot(["actual"], list(policies), "policy", "predicted")
    counts = stacked.groupBy("policy").agg(*confusion_counts(F.col("predicted"), F.col("actual")))
    return with_rates(counts, harmonic=True).select(
        "policy", "tp", "fp", "fn", "tn", "precision", "recall", "f1"
    )


def ensemble_policies(both: DataFrame) -> DataFrame:
    """Each pipeline alone, their union, intersection and confident agreement."""
    s, m = is_match(F.col("single_verdict")), is_match(F.col("multi_verdict"))
    sure = (F.col("single_confidence") >= HIGH_CONFIDENCE) & (F.col("multi_confidence") >= HIGH_CONFIDENCE)
    return _scored_policies(
        both,
        {"single": s, "multi": m, "union": s | m, "intersection": s & m, "high_conf_agree": s & m & sure},
    )


def agent_counterfactual(agents: DataFrame) -> DataFrame:
    """Each agent alone against the orchestrated verdict."""
    return _scored_policies(
        agents,
        {
            "syntactic_only": is_match(F.coalesce("syn_verdict", F.lit("NO MATCH"))),
            "semantic_only": is_match(F.coalesce("sem_verdict", F.lit("NO MATCH"))),
            "orchestrated": is_match(F.col("verdict")),
        },
    )


def consensus_fallback() -> dict[str, Column]:
    """Verdict and confidence when the orchestrator's own answer is unreadable."""
    agree = F.col("syn_verdict") == F.col("sem_verdict")
    syntactic_wins = F.col("syn_confidence") >= F.col("sem_confidence")
    return {
        "fallback_verdict": F.when(agree | syntactic_wins, F.col("syn_verdict")).otherwise(F.col("sem_verdict")),
        "fallback_confidence": F.when(agree, (F.col("syn_confidence") + F.col("sem_confidence")) / 2.0)
        .when(syntactic_wins, F.col("syn_confidence"))
        .otherwise(F.col("sem_confidence")),
    }


def override_pattern() -> Column:
    """How the final verdict relates to the two agents' verdicts."""
    syn, sem, final = (is_match(F.col(c)) for c in ("syn_verdict", "sem_verdict", "verdict"))
    absent = F.col("syn_verdict").isNull() | F.col("sem_verdict").isNull()
    # Pattern labels.
    return (
        F.when(absent, "n/a")
        .when(syn & sem & final, "both-match → MATCH (consensus)")
        .when(syn & sem, "both-match → NO MATCH (override)")
        .when(~syn & ~sem & ~final, "both-no-match → NO MATCH (consensus)")
        .when(~syn & ~sem, "both-no-match → MATCH (override)")
        .when(syn & final, "split (syn=match, sem=no) → MATCH (sided with syntactic)")
        .when(syn, "split (syn=match, sem=no) → NO MATCH (sided with semantic)")
        .when(final, "split (syn=no, sem=match) → MATCH (sided with semantic)")
        .otherwise("split (syn=no, sem=match) → NO MATCH (sided with syntactic)")
    )


def _agent_columns(agents: DataFrame) -> DataFrame:
    return agents.select(
        *[c for c in ("run",) if c in agents.columns],
        (F.col("label") == 1).alias("actual"),
        is_match(F.coalesce("syn_verdict", F.lit("NO MATCH"))).alias("syn"),
        is_match(F.coalesce("sem_verdict", F.lit("NO MATCH"))).alias("sem"),
        is_match(F.col("verdict")).alias("final"),
        (F.col("syn_verdict").isNotNull() & F.col("sem_verdict").isNotNull()).alias("has_agents"),
    )


def arbitration(agents: DataFrame) -> DataFrame:
    """What the orchestrator did on agreement and disagreement, as one row."""
    actual, syn, sem, final = (F.col(c) for c in ("actual", "syn", "sem", "final"))
    agree, right, missed = syn == sem, final == actual, ~final & actual
    return _agent_columns(agents).agg(
        F.count("*").alias("total_decisions"),
        count_if(agree).alias("agents_agree"),
        count_if(~agree).alias("agents_disagree"),
        count_if(agree & (final != syn)).alias("overrides_of_consensus"),
        count_if(agree & (final != syn) & right).alias("overrides_correct"),
        count_if(~agree & right).alias("orchestrator_correct_on_disagreements"),
        count_if(~agree & (syn == actual)).alias("follow_syntactic_correct_on_disagreements"),
        count_if(missed).alias("multi_agent_false_negatives"),
        count_if(missed & ~agree).alias("false_negatives_in_disagreements"),
    )


def agent_f1_by_run(agents: DataFrame) -> DataFrame:
    """Harmonic F1 of each agent alone, per run."""
    long = _agent_columns(agents).unpivot(["run", "actual"], ["syn", "sem"], "agent", "predicted")
    counts = long.groupBy("run", "agent").agg(*confusion_counts(F.col("predicted"), F.col("actual")))
    return with_rates(counts, harmonic=True).select("run", "agent", "f1")


def agent_analysis(agents: DataFrame) -> DataFrame:
    """Per-agent confusion, agreement and unique contributions, where both agents spoke."""
    actual, syn, sem, final = (F.col(c) for c in ("actual", "syn", "sem", "final"))
    agree = syn == sem
    cells = []
    for name, says in (("syn", syn), ("sem", sem)):
        cells += [c.alias(f"{name}_{cell}") for c, cell in zip(confusion_counts(says, actual), ("tp", "fp", "fn", "tn"))]
    return _agent_columns(agents).filter("has_agents").agg(
        F.count("*").alias("total_with_agents"),
        count_if(agree).alias("agreed"),
        count_if(~agree).alias("disagreed"),
        count_if(~agree & (syn == actual)).alias("syn_correct_on_disagree"),
        count_if(~agree & (sem == actual)).alias("sem_correct_on_disagree"),
        count_if(agree & (final != syn)).alias("override_count"),
        count_if(agree & (final != syn) & (final == actual)).alias("override_correct"),
        *cells,
        count_if(syn & ~sem & actual).alias("syn_unique_tp"),
        count_if(sem & ~syn & actual).alias("sem_unique_tp"),
        count_if(~syn & sem & ~actual).alias("syn_unique_tn"),
        count_if(~sem & syn & ~actual).alias("sem_unique_tn"),
    )


def disagreements(both: DataFrame) -> DataFrame:
    """Rows on which the pipelines differ, with who was right."""
    s, m, actual = is_match(F.col("single_verdict")), is_match(F.col("multi_verdict")), F.col("label") == 1
    who = F.when(s == actual, "Single").when(m == actual, "Multi").otherwise("Neither")
    return both.filter(s != m).withColumn("correct", who)


def disagreement_wins(both: DataFrame) -> DataFrame:
    """Wins of each pipeline on matches and on non-matches, as one row."""
    who, match = F.col("correct"), F.col("label") == 1
    return disagreements(both).agg(
        F.count("*").alias("disagreements"),
        count_if((who == "Single") & match).alias("single_better_on_match"),
        count_if((who == "Single") & ~match).alias("single_better_on_nomatch"),
        count_if((who == "Multi") & match).alias("multi_better_on_match"),
        count_if((who == "Multi") & ~match).alias("multi_better_on_nomatch"),
    )


def lenient_confidence(value: Column) -> Column:
    """Confidence as a number, 0 where it is missing or not spelled as a decimal number."""
    text = F.trim(value.cast("string"))
    return F.coalesce(F.when(text.rlike(DECIMAL), text.try_cast("double")), F.lit(0.0))


def calibration(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean confidence overall, when correct and when wrong, and their gap."""
    right = is_match(F.col("verdict")) == (F.col("label") == 1)
    conf = lenient_confidence(F.col("confidence"))
    zero = F.lit(0.0)
    means = rows.groupBy(*by).agg(
        F.coalesce(F.avg(conf), zero).alias("avg_all"),
        F.coalesce(F.avg(F.when(right, conf)), zero).alias("avg_correct"),
        F.coalesce(F.avg(F.when(~right, conf)), zero).alias("avg_incorrect"),
    )
    return means.withColumn("calibration_gap", F.abs(F.col("avg_correct") - F.col("avg_incorrect")))


def head_to_head(single: DataFrame, multi: DataFrame) -> DataFrame:
    """Which pipeline is better per metric; counts of errors are better when lower.

    Both inputs are one-row confusion frames with rates.
    """
    higher = ("precision", "recall", "f1")
    metrics = (*higher, "fp", "fn")

    def long(frame: DataFrame, name: str) -> DataFrame:
        numbers = frame.select(*[F.col(m).cast("double").alias(m) for m in metrics])
        return numbers.unpivot([], list(metrics), "metric", name)

    s, m = F.col("single"), F.col("multi")
    better = F.when(F.col("metric").isin(*higher), s > m).otherwise(s < m)
    return (
        long(single, "single")
        .join(long(multi, "multi"), "metric")
        .withColumn("advantage", F.when(s == m, "Tied").when(better, "Single").otherwise("Multi"))
    )


def percentage_by(rows: DataFrame, category: str) -> DataFrame:
    """Rows and percent of all rows per category."""
    counts = rows.groupBy(category).agg(F.count("*").alias("rows"))
    total = counts.agg(F.collect_list(F.struct(category, "rows")).alias("cats"), F.sum("rows").alias("total"))
    return total.select(F.explode("cats").alias("c"), "total").select(
        F.col(f"c.{category}").alias(category),
        F.col("c.rows").alias("rows"),
        (100.0 * ratio(F.col("c.rows"), F.col("total"))).alias("percent"),
    )
