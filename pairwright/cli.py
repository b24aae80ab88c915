"""``python -m pairwright.cli PIPELINE --data DIR --out DIR``; run it with spark-submit."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from pairwright import evaluation as E
from pairwright.matchers.clients import ServiceClient, WordOverlapClient
from pairwright.session import ship_package
from pairwright.sources.reports import evaluation_report, save_json
from pairwright.sources.tables import load_dataset, save_text

PIPELINES = ("blocking", "single-llm", "multi-agent", "magellan", "magellan-tune", "evaluate-all", "reports")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Record linkage pipelines")
    p.add_argument("pipeline", choices=PIPELINES)
    p.add_argument("--data", required=True, help="folder with the two product tables and three splits")
    p.add_argument("--out", required=True, help="shared folder for candidates, decisions and reports")
    p.add_argument("--max-pairs", type=int, default=None, help="decide only the first pairs; 0 means all")
    p.add_argument("--runs", type=int, default=E.MAX_RUNS, choices=range(1, E.MAX_RUNS + 1))
    p.add_argument("--offline", action="store_true", help="answer from word overlap instead of a service")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--debug", action="store_true")
    return p


def run(arguments: list[str] | None = None) -> dict:
    args = parser().parse_args(arguments)
    if args.debug or args.verbose:
        logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO)
    spark = SparkSession.builder.appName("pairwright").getOrCreate()
    ship_package(spark)
    data = load_dataset(spark, args.data)
    factory = WordOverlapClient if args.offline else ServiceClient
    parameters = f"{args.out}/best_params"
    if args.pipeline == "blocking":
        return E.run_blocking(data, f"{args.out}/candidate_pairs")
    if args.pipeline == "magellan":
        return E.run_forest(data, parameters, args.max_pairs, debug=args.debug)
    if args.pipeline == "magellan-tune":
        return E.run_tuning(data, parameters)
    if args.pipeline == "evaluate-all":
        results = E.run_evaluation(data, factory, f"{args.out}/decisions", args.runs, parameters)
        save_json(spark, results, f"{args.out}/evaluation_results")
        save_text(spark, evaluation_report(results), f"{args.out}/preliminary_results")
        return results
    if args.pipeline == "reports":
        return E.run_reports(data, f"{args.out}/decisions", f"{args.out}/reports")
    agents = args.pipeline == "multi-agent"
    kept = f"{args.out}/decisions/{args.pipeline.replace('-', '_')}"
    return E.run_model(data, agents, factory, kept, args.max_pairs)


if __name__ == "__main__":
    for name, value in run().items():
        print(f"{name}: {value}")
