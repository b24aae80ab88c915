"""Whole pipelines over a dataset: blocking, forest, model matchers, evaluation."""

from __future__ import annotations

import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.matchers.pipelines import (
    ClientFactory,
    agent_answers,
    kept_decisions,
    match_with_replay,
    single_answers,
)
from pairwright.operators import blocking as K
from pairwright.operators.agreement import PIPELINES
from pairwright.operators.features import (
    FEATURE_NAMES,
    feature_summary,
    pair_features,
    sample_rows,
)
from pairwright.operators.forest import (
    DEFAULT_SEED,
    SEEDS,
    feature_importances,
    predict_matches,
    train_matcher,
    tune_forest,
)
from pairwright.operators.lookup import ground_truth, label_lookup, pair_candidates
from pairwright.operators.metrics import RUN_METRICS, match_metrics, run_mean_and_spread
from pairwright.session import checkpointed
from pairwright.sources import reports as R
from pairwright.sources.tables import Dataset, load_parameters, save_candidates, save_parameters, save_text

# Fixed value: the most evaluation runs.
MAX_RUNS = 5


def run_blocking(data: Dataset, path: str, threshold: float = K.DEFAULT_THRESHOLD) -> dict:
    """Block, save the candidates, and report count, range, mean and recall."""
    names = checkpointed(K.similar_names(data.sources, data.targets, threshold))
    labeled = data.train.unionByName(data.valid).unionByName(data.test)
    summary = K.blocking_summary(names).first().asDict()
    recall = K.blocking_recall(names, data.sources, data.targets, ground_truth(labeled)).first().asDict()
    save_candidates(K.candidate_pairs(data.sources, data.targets, threshold), path)
    return {**summary, **recall}


def _scored(predictions: DataFrame, data: Dataset, started: float) -> dict:
    """Metrics of one finished run; writing the predictions is what is timed."""
    kept = checkpointed(predictions)
    elapsed = time.perf_counter() - started
    tokens = kept.tokens if "tokens" in kept.columns else 0
    return match_metrics(kept, ground_truth(data.test), tokens, elapsed).first().asDict()


def run_forest(
    data: Dataset,
    parameters: str | None = None,
    max_pairs: int | None = None,
    seed: int = DEFAULT_SEED,
    debug: bool = False,
) -> dict:
    started = time.perf_counter()
    spark = data.test.sparkSession
    params, threshold = load_parameters(spark, parameters) if parameters else (None, 0.5)
    matcher = train_matcher(data.train, data.valid, data.sources, data.targets, params, threshold, seed)
    if debug:
        features = pair_features(pair_candidates(data.test), data.sources, data.targets)
        feature_summary(features).show(len(FEATURE_NAMES), False)
        sample_rows(features).show(truncate=False, vertical=True)
        for rank, name, value in feature_importances(matcher):
            print(f"{rank:2d}. {name:<25s} {value:.4f}")
    predictions = predict_matches(matcher, pair_candidates(data.test), data.sources, data.targets, max_pairs)
    return _scored(predictions, data, started)


def run_tuning(data: Dataset, parameters: str, grid: dict | None = None) -> dict:
    result = tune_forest(data.train, data.valid, data.sources, data.targets, grid)
    save_parameters(data.train.sparkSession, result, parameters)
    return result


def run_model(
    data: Dataset, agents: bool, factory: ClientFactory, kept: str, max_pairs: int | None = None
) -> dict:
    """One run of a model matcher with its own table of kept decisions."""
    started = time.perf_counter()
    answers = agent_answers if agents else single_answers
    pairs = pair_candidates(data.test)
    decided = match_with_replay(answers, pairs, data.sources, data.targets, factory, kept, max_pairs)
    return _scored(decided, data, started)


def kept_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The kept decisions of both model matchers over all runs, agents side by side."""
    frames = [
        kept_decisions(spark, f"{folder}/{name}", {"run": "int"}).withColumn("pipeline", F.lit(name)) for name in PIPELINES
    ]
    agents = [
        F.col(f"{agent}.{field}").alias(f"{agent[:3]}_{field}")
        for agent in ("syntactic", "semantic") for field in ("verdict", "confidence")
    ]
    return frames[0].unionByName(frames[1]).select("*", *agents).drop("syntactic", "semantic")


def run_reports(data: Dataset, folder: str, out: str) -> dict:
    """Statistics and reports of the kept runs, each a small document below ``out``.

    Keys are checked first: nothing is written from runs that don't fit the test split.
    The errors themselves are written by executors, as CSV.
    """
    spark = data.test.sparkSession
    decisions, labels = checkpointed(kept_runs(spark, folder)), label_lookup(data.test)
    payload = R.statistics_payload(decisions, labels)
    R.save_json(spark, payload, f"{out}/canonical_statistics")
    written = {"statistics": R.statistics_report(payload)}
    labeled = decisions.join(labels, ["source_id", "target_id"])
    single, multi = (decisions.filter(F.col("pipeline") == name) for name in PIPELINES)
    written["arbitration"] = R.arbitration_report(labeled.filter(F.col("pipeline") == PIPELINES[1]))
    first = [rows.filter("run = 0") for rows in (single, multi)]
    written["supplementary"] = R.supplementary_report(*first, labels)
    for name in PIPELINES:
        mine = labeled.filter((F.col("pipeline") == name) & (F.col("run") == 0))
        written[f"errors_{name}"] = R.error_report(mine, data.sources, data.targets, f"{out}/errors_{name}_listing")
    for name, text in written.items():
        save_text(spark, text, f"{out}/{name}_report")
    return {name: f"{out}/{name}_report" for name in written}


def run_evaluation(
    data: Dataset, factory: ClientFactory, folder: str, runs: int = MAX_RUNS, parameters: str | None = None
) -> dict:
    """Every pipeline ``runs`` times, with mean and population deviation."""
    if not 1 <= runs <= MAX_RUNS:
        raise ValueError(f"runs must be between 1 and {MAX_RUNS}, got {runs}")
    spark: SparkSession = data.test.sparkSession
    results = {
        "random_forest": [run_forest(data, parameters, seed=seed) for seed in SEEDS[:runs]],
        "single_llm": [run_model(data, False, factory, f"{folder}/single_llm/run={i}") for i in range(runs)],
        "multi_agent": [run_model(data, True, factory, f"{folder}/multi_agent/run={i}") for i in range(runs)],
    }
    summary = {}
    for name, rows in results.items():
        frame = spark.createDataFrame([{m: float(r[m]) for m in RUN_METRICS} for r in rows])
        spread = run_mean_and_spread(frame, RUN_METRICS).collect()
        summary[name] = {
            "runs": rows,
            "mean": {r["metric"]: r["mean"] for r in spread},
            "std": {r["metric"]: r["std"] for r in spread},
        }
    return {
        "evaluation_date": str(date.today()),
        "num_runs": runs,
        "num_test_pairs": data.test.count(),
        "ground_truth_matches": ground_truth(data.test).count(),
        "pipelines": summary,
    }
