"""Queries over metrics, run agreement, ensembles, sweeps and arbitration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import similarity as S
from pairwright.operators import agreement as G
from pairwright.operators import decisions as D
from pairwright.operators import metrics as M
from pairwright.operators import thresholds as T
from pairwright.operators.lookup import (
    attach_labels,
    attach_products,
    attach_products_or_flag,
    ground_truth,
    label_lookup,
    pair_candidates,
)
from pairwright.plans import standins as B
from pairwright.plans.registry import registered

_RATES = """
round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
"""

_CELLS = """
CAST(count(*) FILTER (pred AND truth) AS BIGINT) AS tp, CAST(count(*) FILTER (pred AND NOT truth) AS BIGINT) AS fp,
CAST(count(*) FILTER (NOT pred AND truth) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT pred AND NOT truth) AS BIGINT) AS tn
"""


def _rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})


def _single(spark: SparkSession, sf_dir: str, run: int | None = None) -> DataFrame:
    rows = B.decisions(spark, sf_dir).filter(F.col("pipeline") == "single_llm")
    return rows if run is None else rows.filter(F.col("run") == run)


def _multi(spark: SparkSession, sf_dir: str, run: int | None = None) -> DataFrame:
    rows = B.decisions(spark, sf_dir).filter(F.col("pipeline") == "multi_agent")
    return rows if run is None else rows.filter(F.col("run") == run)


def _metric_columns(frame: DataFrame) -> DataFrame:
    return frame.select(
        *[
            F.col(c).cast("bigint").alias(c)
            for c in (
                "tp", "fp", "fn", "total_pairs", "predicted_matches", "parse_errors",
                "gt_in_candidates", "total_tokens",
            )
        ],
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "tokens_per_pair")],
    )


@registered(
    "WITH " + B.PAIRED_SQL + "," + B.LABELED_SQL + """,
split_words AS (
  SELECT source_id, target_id,
         list_distinct(string_split(lower(source_name), ' ')) AS a, list_distinct(string_split(lower(target_name), ' ')) AS b
  FROM paired),
preds AS (
  SELECT source_id, target_id,
         len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.2 AS pred FROM split_words),
flags AS (
  SELECT pred, coalesce(label, 0) = 1 AS truth FROM preds LEFT JOIN labeled ON ltable_id = source_id AND rtable_id = target_id),
cells AS (SELECT """ + _CELLS + """ FROM flags)
SELECT tp, fp, fn, tp + fp + fn + tn AS total_pairs, tp + fp AS predicted_matches, CAST(0 AS BIGINT) AS parse_errors,
       tp + fn AS gt_in_candidates, CAST(0 AS BIGINT) AS total_tokens, """ + _RATES + """,
       0.0::DOUBLE AS tokens_per_pair FROM cells
"""
)
def threshold_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name Jaccard of 0.2 or more as a matcher, scored against the labels."""
    names = B.named_products(spark, sf_dir)
    labeled = B.labeled_pairs(spark, sf_dir)
    joined = attach_products(pair_candidates(labeled), names, names)
    score = S.jaccard_tokens(F.col("source_name"), F.col("target_name"))
    predictions = joined.select(
        "source_id", "target_id", F.when(score >= 0.2, "MATCH").otherwise("NO MATCH").alias("verdict")
    )
    return _metric_columns(M.match_metrics(predictions, ground_truth(labeled)))


@registered(
    "WITH " + B.DECISIONS_SQL + """,
flags AS (
  SELECT verdict = 'MATCH' AS pred, label = 1 AS truth, tokens, parse_error FROM decisions
  WHERE pipeline = 'multi_agent' AND run = 0),
cells AS (
  SELECT """ + _CELLS + """, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) FILTER (parse_error) AS parse_errors FROM flags)
SELECT tp, fp, fn, tp + fp + fn + tn AS total_pairs, tp + fp AS predicted_matches, parse_errors,
       tp + fn AS gt_in_candidates, total_tokens, """ + _RATES + """,
       round(total_tokens / (tp + fp + fn + tn), 6) AS tokens_per_pair FROM cells
"""
)
def match_metrics_one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = B.decision_labels(spark, sf_dir).filter("label = 1").select("source_id", "target_id")
    return _metric_columns(M.match_metrics(_multi(spark, sf_dir, 0), truth, F.col("tokens")))


@registered(
    "WITH cells AS (SELECT " + _CELLS + " FROM (SELECT toxic = 1 AS pred, quality = 1 AS truth FROM labels)) "
    "SELECT tp, fp, fn, tn, tp + fp + fn + tn AS n, " + _RATES
    + ", round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM cells"
)
def confusion_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "labels")
    counts = rows.agg(*M.confusion_counts(F.col("toxic") == 1, F.col("quality") == 1))
    return _rounded(M.with_rates(counts), "precision", "recall", "f1", "accuracy")


@registered(
    "WITH flags AS (SELECT toxic = 1 AS pred, quality = 1 AS truth FROM labels) "
    "SELECT CASE WHEN pred AND truth THEN 'tp' WHEN pred THEN 'fp' WHEN truth THEN 'fn' ELSE 'tn' END AS bucket, "
    "count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM flags GROUP BY 1"
)
def outcome_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "labels").select(
        M.outcome(F.col("toxic") == 1, F.col("quality") == 1).alias("bucket")
    )
    return _rounded(D.percentage_by(rows, "bucket"), "percent")


_RUNS_SQL = "WITH " + B.DECISIONS_SQL + """,
cells AS (
  SELECT pipeline, run, """ + _CELLS + """
  FROM (SELECT pipeline, run, verdict = 'MATCH' AS pred, label = 1 AS truth FROM decisions) GROUP BY 1, 2),
runs AS (
  SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * tp / (2 * tp + fp + fn) AS f FROM cells)
"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pair_patterns(B.decisions(spark, sf_dir), B.decision_labels(spark, sf_dir))


def _pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pattern_counts(_patterns(spark, sf_dir))


@registered(
    _RUNS_SQL + "SELECT pipeline, run, tp, fp, fn, tn, tp + fp + fn + tn AS n, " + _RATES
    + ", round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM runs"
)
def confusion_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = G.confusion_by_run(_pattern_counts(spark, sf_dir))
    return _rounded(runs, "precision", "recall", "f1", "accuracy")


# A cache of three runs against one of five, where one run lacks a seventh of the pairs.
_HOLES = (
    "NOT (pipeline = 'single_llm' AND run >= 3) AND NOT (run = 1 AND CAST(source_id AS BIGINT) % 7 = 0)"
)


def _uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.decisions(spark, sf_dir).filter(_HOLES)


@registered(
    _RUNS_SQL.replace("FROM decisions)", f"FROM decisions WHERE {_HOLES})")
    + "SELECT pipeline, run, tp, fp, fn, tn, tp + fp + fn + tn AS n, " + _RATES
    + ", round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM runs"
)
def confusion_of_uneven_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = G.pair_patterns(_uneven(spark, sf_dir), B.decision_labels(spark, sf_dir))
    return _rounded(G.confusion_by_run(G.pattern_counts(patterns)), "precision", "recall", "f1", "accuracy")


@registered(
    "WITH " + B.DECISIONS_SQL + f""",
held AS (SELECT pipeline, run, count(*) AS decided FROM decisions WHERE {_HOLES} GROUP BY 1, 2),
size AS (SELECT count(DISTINCT (source_id, target_id)) AS labeled FROM decisions)
SELECT pipeline, run, labeled - decided AS missing, CAST(0 AS BIGINT) AS unlabeled FROM held, size
"""
)
def run_key_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.key_gaps(_uneven(spark, sf_dir), B.decision_labels(spark, sf_dir))


# Runs with every fault: missing and repeated keys, odd verdicts and token counts; labels lack a part of the keys.
_ODD_SQL = """CASE WHEN confidence = 0.5 THEN 'MAYBE' ELSE verdict END"""
_UNLABELED = "CAST(source_id AS BIGINT) % 7 = 3"


@registered(
    "WITH " + B.DECISIONS_SQL + f""",
flawed AS (
  SELECT pipeline, run, source_id, target_id, {_ODD_SQL} AS verdict,
         CASE WHEN confidence = 1.0 THEN -1 ELSE tokens END AS tokens, unnest(range(CASE WHEN parse_error THEN 2 ELSE 1 END))
  FROM decisions WHERE {_HOLES}),
known AS (SELECT DISTINCT source_id, target_id FROM decisions WHERE NOT {_UNLABELED}),
held AS (
  SELECT pipeline, run, source_id, target_id, count(*) AS n, max(verdict = 'MAYBE') AS odd, max(tokens < 0) AS negative
  FROM flawed GROUP BY ALL),
joined AS (SELECT h.*, k.source_id IS NOT NULL AS met FROM held h LEFT JOIN known k USING (source_id, target_id)),
counted AS (
  SELECT pipeline, run, (SELECT count(*) FROM known) - count(*) FILTER (met) AS "missing key",
         count(*) FILTER (NOT met) AS "unlabeled key", count(*) FILTER (n > 1) AS "repeated key",
         count(*) FILTER (odd) AS "malformed verdict", count(*) FILTER (negative) AS "malformed tokens"
  FROM joined GROUP BY 1, 2)
SELECT pipeline, run, rule, CAST(keys AS BIGINT) AS keys
FROM (UNPIVOT counted ON COLUMNS(* EXCLUDE (pipeline, run)) INTO NAME rule VALUE keys) WHERE keys > 0
"""
)
def run_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = F.when(F.col("parse_error"), F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    flawed = _uneven(spark, sf_dir).select(
        "pipeline", "run", *M.KEYS, F.expr(_ODD_SQL).alias("verdict"),
        F.when(F.col("confidence") == 1.0, F.lit(-1)).otherwise(F.col("tokens")).alias("tokens"),
        F.explode(copies).alias("copy"),
    )
    return G.run_violations(flawed, B.decision_labels(spark, sf_dir).filter(f"NOT {_UNLABELED}"))


@registered(
    _RUNS_SQL + "SELECT pipeline, count(*) AS n, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS sample_sd FROM runs GROUP BY 1"
)
def f1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = G.confusion_by_run(_pattern_counts(spark, sf_dir))
    return _rounded(M.summarize_runs(runs, ["pipeline"], "f1"), "mean", "sample_sd")


@registered(
    _RUNS_SQL + """
SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
FROM (UNPIVOT (SELECT p AS precision, r AS recall, f AS f1 FROM runs WHERE pipeline = 'single_llm')
      ON precision, recall, f1 INTO NAME metric VALUE v) GROUP BY 1
"""
)
def run_mean_and_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = G.confusion_by_run(_pattern_counts(spark, sf_dir)).filter("pipeline = 'single_llm'")
    return _rounded(M.run_mean_and_spread(runs, ("precision", "recall", "f1")), "mean", "std")


_PAIRINGS_SQL = "WITH " + B.DECISIONS_SQL + """,
joined AS (
  SELECT a.run AS single_run, b.run AS multi_run, a.verdict = 'MATCH' AS s, b.verdict = 'MATCH' AS m, a.label = 1 AS t
  FROM decisions a JOIN decisions b USING (source_id, target_id)
  WHERE a.pipeline = 'single_llm' AND b.pipeline = 'multi_agent'),
cells AS (
  SELECT single_run, multi_run, count(*) AS n, count(*) FILTER (s = m) AS agreements,
         avg(CAST(s AS INT)) AS ps, avg(CAST(m AS INT)) AS pm,
         count(*) FILTER ((s = t) AND (m <> t)) AS b, count(*) FILTER ((m = t) AND (s <> t)) AS c,
         count(*) FILTER ((s = t) AND (m = t)) AS both_ok, count(*) FILTER ((s <> t) AND (m <> t)) AS none_ok
  FROM joined GROUP BY 1, 2),
pairings AS (
  SELECT *, agreements / n AS rate,
         (agreements / n - (ps * pm + (1 - ps) * (1 - pm))) / (1 - (ps * pm + (1 - ps) * (1 - pm))) AS kappa FROM cells)
"""


_UNEVEN_PAIRINGS_SQL = _PAIRINGS_SQL.replace(
    "FROM decisions a JOIN decisions b",
    f"FROM (SELECT * FROM decisions WHERE {_HOLES}) a JOIN (SELECT * FROM decisions WHERE {_HOLES}) b",
)


@registered(
    _UNEVEN_PAIRINGS_SQL + """
SELECT single_run, multi_run, n, agreements, round(rate, 6) AS agreement_rate, round(kappa, 6) AS cohen_kappa,
       b AS b_single_only_correct, c AS c_multi_only_correct, both_ok AS both_correct, none_ok AS neither_correct, b + c AS discordant
FROM pairings
"""
)
def pairings_of_uneven_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = G.pair_patterns(_uneven(spark, sf_dir), B.decision_labels(spark, sf_dir))
    return _rounded(G.run_pairings(G.pattern_counts(patterns)), "agreement_rate", "cohen_kappa")


@registered(
    _PAIRINGS_SQL + """
SELECT single_run, multi_run, n, agreements, round(rate, 6) AS agreement_rate, round(kappa, 6) AS cohen_kappa,
       b AS b_single_only_correct, c AS c_multi_only_correct, both_ok AS both_correct, none_ok AS neither_correct, b + c AS discordant
FROM pairings
"""
)
def run_pairing_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairings = G.run_pairings(_pattern_counts(spark, sf_dir))
    return _rounded(pairings, "agreement_rate", "cohen_kappa")


_SUMMARY_DOUBLES = (
    "agreement_mean", "agreement_sd", "agreement_min", "agreement_max",
    "kappa_mean", "kappa_sd", "kappa_min", "kappa_max", "micro_agreement_rate",
)


@registered(
    _PAIRINGS_SQL + """
SELECT count(*) AS n_pairings, round(avg(rate), 6) AS agreement_mean, round(stddev_samp(rate), 6) AS agreement_sd,
       round(min(rate), 6) AS agreement_min, round(max(rate), 6) AS agreement_max, round(avg(kappa), 6) AS kappa_mean,
       round(stddev_samp(kappa), 6) AS kappa_sd, round(min(kappa), 6) AS kappa_min, round(max(kappa), 6) AS kappa_max,
       CAST(sum(n) AS BIGINT) AS decisions, CAST(sum(agreements) AS BIGINT) AS agreements,
       round(sum(agreements) / sum(n), 6) AS micro_agreement_rate
FROM pairings
"""
)
def run_pairing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = G.pairing_summary(G.run_pairings(_pattern_counts(spark, sf_dir)))
    return _rounded(summary, *_SUMMARY_DOUBLES)


@registered(
    _PAIRINGS_SQL + """
SELECT CAST(s AS INT) AS single, count(*) FILTER (NOT m) AS multi_no_match, count(*) FILTER (m) AS multi_match
FROM joined WHERE single_run = 0 AND multi_run = 0 GROUP BY 1
"""
)
def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.agreement_matrix(_pattern_counts(spark, sf_dir))


@registered(
    "WITH " + B.DECISION_KEYS_SQL + """,
ps AS (SELECT p, count(*) AS m FROM decision_keys GROUP BY 1), ss AS (SELECT s, count(*) AS m FROM decision_keys GROUP BY 1)
SELECT (SELECT count(*) FROM decision_keys) AS n_pairs, (SELECT count(*) FROM ps) AS unique_sources,
       (SELECT max(m) FROM ps) AS max_source_multiplicity,
       round((SELECT sum(m) FILTER (m > 1) / sum(m) FROM ps), 6) AS share_pairs_sharing_a_source,
       (SELECT count(*) FROM ss) AS unique_targets, (SELECT max(m) FROM ss) AS max_target_multiplicity,
       round((SELECT sum(m) FILTER (m > 1) / sum(m) FROM ss), 6) AS share_pairs_sharing_a_target
"""
)
def entity_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    structure = G.entity_multiplicity(B.decision_labels(spark, sf_dir))
    return _rounded(structure, "share_pairs_sharing_a_source", "share_pairs_sharing_a_target")


@registered(
    "WITH " + B.DECISIONS_SQL + """
SELECT pipeline, run, count(*) AS n_records, count(*) FILTER (parse_error) AS parse_errors,
       CAST(sum(tokens) AS BIGINT) AS tokens_total, round(avg(tokens), 6) AS tokens_per_pair FROM decisions GROUP BY 1, 2
"""
)
def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(G.run_costs(B.decisions(spark, sf_dir)), "tokens_per_pair")


@registered(
    "WITH " + B.DECISIONS_SQL + """
SELECT CAST(sum(tokens) FILTER (pipeline = 'single_llm') AS BIGINT) AS single_tokens,
       CAST(sum(tokens) FILTER (pipeline = 'multi_agent') AS BIGINT) AS multi_tokens,
       round(sum(tokens) FILTER (pipeline = 'multi_agent') / sum(tokens) FILTER (pipeline = 'single_llm'), 6) AS token_ratio
FROM decisions
"""
)
def token_cost_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(G.token_ratio(G.run_costs(B.decisions(spark, sf_dir))), "token_ratio")


_BOTH_SQL = "WITH " + B.DECISIONS_SQL + """,
both_runs AS (
  SELECT a.label = 1 AS truth, a.verdict = 'MATCH' AS s, b.verdict = 'MATCH' AS m,
         a.confidence AS sc, b.confidence AS mc
  FROM decisions a JOIN decisions b USING (source_id, target_id, run)
  WHERE a.pipeline = 'single_llm' AND b.pipeline = 'multi_agent' AND run = 0)
"""


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = B.decision_labels(spark, sf_dir)
    return D.side_by_side(_single(spark, sf_dir, 0), _multi(spark, sf_dir, 0), labels)


@registered(
    _BOTH_SQL + """,
policies AS (
  SELECT truth, unnest(['single', 'multi', 'union', 'intersection', 'high_conf_agree']) AS policy,
         unnest([s, m, s OR m, s AND m, s AND m AND sc >= 0.9 AND mc >= 0.9]) AS pred FROM both_runs),
cells AS (SELECT policy, """ + _CELLS + " FROM policies GROUP BY 1) SELECT policy, tp, fp, fn, tn, " + _RATES + " FROM cells"
)
def ensemble_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.ensemble_policies(_both(spark, sf_dir)), "precision", "recall", "f1")


_AGENT_CTE = "WITH " + B.DECISIONS_SQL + """,
agents AS (
  SELECT run, label = 1 AS truth, verdict = 'MATCH' AS final, syn_verdict = 'MATCH' AS syn, sem_verdict = 'MATCH' AS sem,
         syn_verdict, sem_verdict, syn_confidence, sem_confidence, verdict, source_id, target_id
  FROM decisions WHERE pipeline = 'multi_agent')
"""


@registered(
    _AGENT_CTE + """,
policies AS (
  SELECT truth, unnest(['syntactic_only', 'semantic_only', 'orchestrated']) AS policy, unnest([syn, sem, final]) AS pred
  FROM agents WHERE run = 0),
cells AS (SELECT policy, """ + _CELLS + " FROM policies GROUP BY 1) SELECT policy, tp, fp, fn, tn, " + _RATES + " FROM cells"
)
def agent_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.agent_counterfactual(_multi(spark, sf_dir, 0)), "precision", "recall", "f1")


@registered(
    _AGENT_CTE + """
SELECT count(*) AS total_decisions, count(*) FILTER (syn = sem) AS agents_agree, count(*) FILTER (syn <> sem) AS agents_disagree,
       count(*) FILTER (syn = sem AND final <> syn) AS overrides_of_consensus,
       count(*) FILTER (syn = sem AND final <> syn AND final = truth) AS overrides_correct,
       count(*) FILTER (syn <> sem AND final = truth) AS orchestrator_correct_on_disagreements,
       count(*) FILTER (syn <> sem AND syn = truth) AS follow_syntactic_correct_on_disagreements,
       count(*) FILTER (NOT final AND truth) AS multi_agent_false_negatives,
       count(*) FILTER (NOT final AND truth AND syn <> sem) AS false_negatives_in_disagreements
FROM agents
"""
)
def arbitration_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arbitration(_multi(spark, sf_dir))


@registered(
    _AGENT_CTE + """,
long AS (SELECT run, truth, unnest(['syn', 'sem']) AS agent, unnest([syn, sem]) AS pred FROM agents),
cells AS (SELECT run, agent, """ + _CELLS + """ FROM long GROUP BY 1, 2)
SELECT run, agent, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM cells
"""
)
def agent_f1_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.agent_f1_by_run(_multi(spark, sf_dir)), "f1")


@registered(
    _AGENT_CTE + """
SELECT count(*) AS total_with_agents, count(*) FILTER (syn = sem) AS agreed, count(*) FILTER (syn <> sem) AS disagreed,
       count(*) FILTER (syn <> sem AND syn = truth) AS syn_correct_on_disagree,
       count(*) FILTER (syn <> sem AND sem = truth) AS sem_correct_on_disagree,
       count(*) FILTER (syn = sem AND final <> syn) AS override_count,
       count(*) FILTER (syn = sem AND final <> syn AND final = truth) AS override_correct,
       count(*) FILTER (syn AND truth) AS syn_tp, count(*) FILTER (syn AND NOT truth) AS syn_fp,
       count(*) FILTER (NOT syn AND truth) AS syn_fn, count(*) FILTER (NOT syn AND NOT truth) AS syn_tn,
       count(*) FILTER (sem AND truth) AS sem_tp, count(*) FILTER (sem AND NOT truth) AS sem_fp,
       count(*) FILTER (NOT sem AND truth) AS sem_fn, count(*) FILTER (NOT sem AND NOT truth) AS sem_tn,
       count(*) FILTER (syn AND NOT sem AND truth) AS syn_unique_tp, count(*) FILTER (sem AND NOT syn AND truth) AS sem_unique_tp,
       count(*) FILTER (NOT syn AND sem AND NOT truth) AS syn_unique_tn, count(*) FILTER (NOT sem AND syn AND NOT truth) AS sem_unique_tn
FROM agents
"""
)
def agent_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.agent_analysis(_multi(spark, sf_dir))


@registered(
    _AGENT_CTE + """
SELECT CASE WHEN syn AND sem THEN CASE WHEN final THEN 'both-match → MATCH (consensus)' ELSE 'both-match → NO MATCH (override)' END
            WHEN NOT syn AND NOT sem THEN CASE WHEN final THEN 'both-no-match → MATCH (override)' ELSE 'both-no-match → NO MATCH (consensus)' END
            WHEN syn THEN CASE WHEN final THEN 'split (syn=match, sem=no) → MATCH (sided with syntactic)'
                               ELSE 'split (syn=match, sem=no) → NO MATCH (sided with semantic)' END
            ELSE CASE WHEN final THEN 'split (syn=no, sem=match) → MATCH (sided with semantic)'
                      ELSE 'split (syn=no, sem=match) → NO MATCH (sided with syntactic)' END END AS pattern,
       count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent
FROM agents WHERE final <> truth GROUP BY 1
"""
)
def override_patterns_of_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _multi(spark, sf_dir).filter(M.is_match(F.col("verdict")) != (F.col("label") == 1))
    patterns = D.percentage_by(rows.select(D.override_pattern().alias("pattern")), "pattern")
    return _rounded(patterns, "percent")


@registered(
    _AGENT_CTE + """
SELECT run, source_id, target_id,
       CASE WHEN syn = sem OR syn_confidence >= sem_confidence THEN syn_verdict ELSE sem_verdict END AS fallback_verdict,
       round(CASE WHEN syn = sem THEN (syn_confidence + sem_confidence) / 2
                  ELSE greatest(syn_confidence, sem_confidence) END, 6) AS fallback_confidence
FROM agents
"""
)
def consensus_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _multi(spark, sf_dir).withColumns(D.consensus_fallback())
    return _rounded(
        rows.select("run", "source_id", "target_id", "fallback_verdict", "fallback_confidence"),
        "fallback_confidence",
    )


@registered(
    _BOTH_SQL + """
SELECT count(*) AS disagreements, count(*) FILTER (s = truth AND truth) AS single_better_on_match,
       count(*) FILTER (s = truth AND NOT truth) AS single_better_on_nomatch,
       count(*) FILTER (m = truth AND truth) AS multi_better_on_match,
       count(*) FILTER (m = truth AND NOT truth) AS multi_better_on_nomatch
FROM both_runs WHERE s <> m
"""
)
def disagreement_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.disagreement_wins(_both(spark, sf_dir))


@registered(
    "WITH " + B.DECISIONS_SQL + """,
means AS (
  SELECT pipeline, avg(confidence) AS a, avg(confidence) FILTER ((verdict = 'MATCH') = (label = 1)) AS c,
         avg(confidence) FILTER ((verdict = 'MATCH') <> (label = 1)) AS i FROM decisions WHERE run = 0 GROUP BY 1)
SELECT pipeline, round(a, 6) AS avg_all, round(c, 6) AS avg_correct, round(i, 6) AS avg_incorrect, round(abs(c - i), 6) AS calibration_gap
FROM means
"""
)
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.decisions(spark, sf_dir).filter("run = 0")
    gaps = D.calibration(rows, ["pipeline"])
    return _rounded(gaps, "avg_all", "avg_correct", "avg_incorrect", "calibration_gap")


@registered(
    _RUNS_SQL + """,
metric_rows AS (
  SELECT pipeline, unnest(['precision', 'recall', 'f1', 'fp', 'fn']) AS metric,
         unnest([p, r, f, CAST(fp AS DOUBLE), CAST(fn AS DOUBLE)]) AS v FROM runs WHERE run = 0)
SELECT metric, round(a.v, 6) AS single, round(b.v, 6) AS multi,
       CASE WHEN a.v = b.v THEN 'Tied' WHEN (a.v > b.v) = (metric NOT IN ('fp', 'fn')) THEN 'Single' ELSE 'Multi' END AS advantage
FROM metric_rows a JOIN metric_rows b USING (metric) WHERE a.pipeline = 'single_llm' AND b.pipeline = 'multi_agent'
"""
)
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = G.confusion_by_run(_pattern_counts(spark, sf_dir)).filter("run = 0")
    single, multi = (runs.filter(F.col("pipeline") == p) for p in B.PIPELINES)
    return _rounded(D.head_to_head(single, multi), "single", "multi")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = T.match_score(F.col("verdict"), F.col("confidence"))
    return B.decisions(spark, sf_dir).filter("run = 0").select("pipeline", "label", score.alias("score"))


_SWEEP_SQL = "WITH " + B.DECISIONS_SQL + """,
scored AS (
  SELECT pipeline, label = 1 AS truth, CASE WHEN verdict = 'MATCH' THEN confidence ELSE 1.0::DOUBLE - confidence END AS score
  FROM decisions WHERE run = 0),
sweep AS (
  SELECT pipeline, CAST(i AS INT) AS position, {tau} AS threshold,
         count(*) FILTER (score >= {tau} AND truth) AS tp, count(*) FILTER (score >= {tau} AND NOT truth) AS fp,
         count(*) FILTER (score < {tau} AND truth) AS fn
  FROM scored, (SELECT unnest(range({n})) AS i) GROUP BY 1, i)
"""
_CURVE_SQL = _SWEEP_SQL.format(tau="(0.0::DOUBLE + i * 0.01::DOUBLE)", n=101)
_TUNE_SQL = _SWEEP_SQL.format(tau="(0.05::DOUBLE + i * 0.05::DOUBLE)", n=19)


@registered(
    _CURVE_SQL + "SELECT pipeline, position, round(threshold, 6) AS threshold, tp, fp, fn, " + _RATES + " FROM sweep"
)
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = T.threshold_sweep(_scored(spark, sf_dir), T.CURVE_GRID, ["pipeline"])
    return _rounded(sweep, "threshold", "precision", "recall", "f1")


_BEST_SQL = """
, rated AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM sweep)
SELECT pipeline, round(arg_max(threshold, (round(f, 12), -position)), 6) AS threshold, round(max(f), 6) AS f1 FROM rated GROUP BY 1
"""


@registered(_CURVE_SQL + _BEST_SQL)
def best_confidence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = T.first_best(T.threshold_sweep(_scored(spark, sf_dir), T.CURVE_GRID, ["pipeline"]), ["pipeline"])
    return _rounded(best.select("pipeline", "threshold", "f1"), "threshold", "f1")


@registered(_TUNE_SQL + _BEST_SQL)
def tuned_probability_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = T.first_best(T.threshold_sweep(_scored(spark, sf_dir), T.TUNING_GRID, ["pipeline"]), ["pipeline"])
    return _rounded(best.select("pipeline", "threshold", "f1"), "threshold", "f1")


@registered(
    "WITH " + B.PRODUCTS_SQL + "," + B.LABELED_SQL + """
SELECT ltable_id AS source_id, rtable_id AS target_id, s.id IS NULL OR t.id IS NULL AS missing_product, label
FROM labeled LEFT JOIN products s ON s.id = ltable_id LEFT JOIN products t ON t.id = rtable_id
"""
)
def pairs_with_missing_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.named_products(spark, sf_dir)
    labeled = B.labeled_pairs(spark, sf_dir)
    flagged = attach_products_or_flag(pair_candidates(labeled), names, names)
    return attach_labels(flagged, label_lookup(labeled)).select(
        "source_id", "target_id", "missing_product", "label"
    )


@registered(
    "WITH " + B.DECISIONS_SQL + """
SELECT source_id, target_id, CASE WHEN (a.verdict = 'MATCH') = (a.label = 1) THEN 'Single' ELSE 'Multi' END AS correct
FROM decisions a JOIN decisions b USING (source_id, target_id, run)
WHERE run = 0 AND a.pipeline = 'single_llm' AND b.pipeline = 'multi_agent' AND a.verdict <> b.verdict
"""
)
def disagreement_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.disagreements(_both(spark, sf_dir)).select("source_id", "target_id", "correct")
