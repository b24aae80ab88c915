"""Markdown and JSON reports, rendered from small result tables.

Every figure comes out of a result DataFrame; only finished aggregates, and the
error rows a report is asked to list, reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.verdict import dollars, shortened
from pairwright.operators import agreement as G
from pairwright.operators import decisions as D
from pairwright.operators import metrics as M
from pairwright.operators.lookup import PRODUCT_FIELDS
from pairwright.operators.taxonomy import with_error_categories
from pairwright.sources.cache import CacheValidationError
from pairwright.sources.tables import save_text


def canonical_json(payload: object) -> str:
    """Sorted keys and a final newline, so that equal results are equal bytes."""
    return json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n"


def save_json(spark: SparkSession, payload: object, path: str) -> None:
    """Canonical JSON on shared storage, written by a task."""
    save_text(spark, canonical_json(payload), path)


def spread_cell(mean: float, std: float, digits: int = 4) -> str:
    return f"{mean:.{digits}f} +/- {std:.{digits}f}"


def whole_cell(mean: float, std: float) -> str:
    """Truncated, not rounded, with thousands separators."""
    return f"{int(mean):,} +/- {int(std):,}"


def markdown_table(headers: Sequence[str], rows: Iterable[Sequence[object]]) -> list[str]:
    lines = ["| " + " | ".join(headers) + " |", "|" + "|".join("---" for _ in headers) + "|"]
    return lines + ["| " + " | ".join(str(cell) for cell in row) + " |" for row in rows]


# Rows of the evaluation table, with their cell formats.
_EVALUATION_ROWS = (
    ("precision", "Precision", 4),
    ("recall", "Recall", 4),
    ("f1", "F1", 4),
    ("total_runtime", "Runtime (s)", 2),
    ("total_tokens", "Total tokens", None),
    ("tokens_per_pair", "Tokens/pair", 2),
    ("parse_errors", "Parse errors", None),
)


def evaluation_report(results: dict) -> str:
    """Comparison of pipelines from their mean and std per metric."""
    pipelines = results["pipelines"]
    body = []
    for key, label, digits in _EVALUATION_ROWS:
        cells = []
        for p in pipelines.values():
            mean, std = p["mean"][key], p["std"][key]
            cells.append(whole_cell(mean, std) if digits is None else spread_cell(mean, std, digits))
        body.append([label, *cells])
    summary = [
        ["Test pairs evaluated", f"{results['num_test_pairs']:,}"],
        ["Ground truth matches", results["ground_truth_matches"]],
        ["Evaluation date", results["evaluation_date"]],
        ["Runs per pipeline", results["num_runs"]],
    ]
    return "\n".join(
        ["# Evaluation", "", "## Dataset Summary", *markdown_table(("Metric", "Value"), summary)]
        + ["", "## Pipeline Comparison", *markdown_table(("Metric", *pipelines), body), ""]
    )


def describe_products(rows: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Left-join product fields for listing; unknown products read ``?``."""
    for side, goods in (("source", sources), ("target", targets)):
        fields = [F.col(f).alias(f"{side}_{f}") for f in PRODUCT_FIELDS]
        rows = rows.join(goods.select(F.col("id").alias(f"{side}_id"), *fields), f"{side}_id", "left")
    fill = {f"{side}_{f}": "?" if f == "name" else "" for side in ("source", "target") for f in ("name", "description")}
    return rows.fillna(fill)


def error_listing(
    decided: DataFrame, sources: DataFrame, targets: DataFrame, runs: tuple[str, ...] = ()
) -> DataFrame:
    """Every wrongly decided pair with its category and its whole names, ready to be written.

    ``decided`` has the pair keys, verdict, confidence, reasoning and label, and the columns
    ``runs`` where it holds several runs.
    """
    matched, actual = M.is_match(F.col("verdict")), F.col("label") == 1
    errors = describe_products(decided.filter(matched != actual), sources, targets)
    errors = with_error_categories(errors.withColumn("reasoning", F.coalesce("reasoning", F.lit(""))))
    return errors.select(
        *runs,
        F.when(matched, "False Positives").otherwise("False Negatives").alias("kind"),
        F.when(matched, F.col("fp_category")).otherwise(F.col("fn_category")).alias("category"),
        *M.KEYS,
        "source_name",
        "target_name",
        dollars(F.nullif("source_price", F.lit("nan"))).alias("source_price"),
        dollars(F.nullif("target_price", F.lit("nan"))).alias("target_price"),
        F.coalesce(F.col("confidence").cast("string"), F.lit("?")).alias("confidence"),
        shortened(F.col("reasoning")).alias("reasoning"),
    )


def error_report(
    decided: DataFrame, sources: DataFrame, targets: DataFrame, listing_path: str | None = None
) -> str:
    """Counts and error categories of one labeled run.

    The errors themselves can be any number, so executors write them to
    ``listing_path`` as CSV and the report only names the place.
    """
    matched, actual = M.is_match(F.col("verdict")), F.col("label") == 1
    totals = M.with_rates(decided.agg(*M.confusion_counts(matched, actual)), harmonic=True).first()
    lines = ["# Error Analysis", "", "## Summary"]
    lines += markdown_table(("Metric", "Count"), [(c.upper(), totals[c]) for c in ("tp", "fp", "fn", "tn", "n")])
    lines += [f"- {c.capitalize()}: {totals[c]:.4f}" for c in ("precision", "recall", "f1")]
    listed = error_listing(decided, sources, targets)
    if listing_path is not None:
        listed.write.mode("overwrite").csv(listing_path, header=True)
        lines.append(f"- Every error: {listing_path}")
    counts = listed.groupBy("kind", "category").agg(F.count("*").alias("rows")).collect()
    for name in ("False Positives", "False Negatives"):
        mine = sorted((-r["rows"], r["category"]) for r in counts if r["kind"] == name)
        total = -sum(n for n, _ in mine)
        lines += ["", f"## {name} ({total})", ""]
        cells = [(category, -n, f"{-100 * n / total:.1f}%") for n, category in mine]
        lines += markdown_table(("Category", "Count", "%"), cells) if cells else ["None"]
    return "\n".join(lines) + "\n"


def arbitration_report(agents: DataFrame) -> str:
    """What the orchestrator did, and each agent's F1 over the runs."""
    row = D.arbitration(agents).first().asDict()
    f1 = M.summarize_runs(D.agent_f1_by_run(agents), ["agent"], "f1").orderBy("agent").collect()
    lines = ["# Arbitration", "", *markdown_table(("Measure", "Count"), row.items()), ""]
    lines += markdown_table(("Agent", "F1"), [(r["agent"], spread_cell(r["mean"], r["sample_sd"])) for r in f1])
    return "\n".join(lines) + "\n"


def supplementary_report(single: DataFrame, multi: DataFrame, labels: DataFrame) -> str:
    """Combinations of the pipelines, agents alone, calibration and disagreements of one run of each."""
    both = D.side_by_side(single, multi, labels)
    agents = multi.join(labels.select(*M.KEYS, "label"), M.KEYS)
    rates = ("tp", "fp", "fn", "tn", "precision", "recall", "f1")

    def policies(frame: DataFrame) -> list[str]:
        rows = [
            [r["policy"], *(f"{r[c]:.4f}" if isinstance(r[c], float) else r[c] for c in rates)]
            for r in frame.orderBy("policy").collect()
        ]
        return markdown_table(("Policy", *(c.upper() if len(c) == 2 else c.capitalize() for c in rates)), rows)

    means = ("avg_all", "avg_correct", "avg_incorrect", "calibration_gap")
    calibrated = []
    for name, rows in (("Single", single), ("Multi", multi)):
        row = D.calibration(rows.join(labels.select(*M.KEYS, "label"), M.KEYS), []).first()
        calibrated.append([name, *(f"{row[c]:.4f}" for c in means)])
    patterns = D.percentage_by(multi.select(D.override_pattern().alias("pattern")), "pattern")
    parts = sorted((-r["rows"], r["pattern"], f"{r['percent']:.1f}%") for r in patterns.collect())
    wins = D.disagreement_wins(both).first().asDict()
    lines = ["# Supplementary Analysis", "", "## Ensembles", *policies(D.ensemble_policies(both))]
    lines += ["", "## Agents alone", *policies(D.agent_counterfactual(agents))]
    lines += ["", "## Calibration", *markdown_table(("Pipeline", "All", "Correct", "Wrong", "Gap"), calibrated)]
    lines += ["", "## Overrides", *markdown_table(("Pattern", "Pairs", "%"), [(p, -n, share) for n, p, share in parts])]
    lines += ["", "## Disagreements", *markdown_table(("Measure", "Pairs"), wins.items())]
    return "\n".join(lines) + "\n"


def checked_runs(decisions: DataFrame, labels: DataFrame) -> None:
    """Raise with every broken rule of every run before anything is computed from them."""
    found = G.run_violations(decisions, labels).orderBy("pipeline", "run", "rule").collect()
    if found:
        listed = "; ".join(f"{r['pipeline']} run {r['run']}: {r['keys']} x {r['rule']}" for r in found)
        raise CacheValidationError(f"decisions and labels do not fit; {listed}")


def statistics_payload(decisions: DataFrame, labels: DataFrame) -> dict:
    """Every run-level statistic, as nested plain values, of decisions that break no rule."""
    from pairwright.operators.inference import bootstrap_effects, bootstrap_range, permutation_test
    from pairwright.session import checkpointed
    from pairwright.sources.cache import decision_line, label_line, multiset_digest

    checked_runs(decisions, labels)
    patterns = checkpointed(G.pair_patterns(decisions, labels))
    counts = G.pattern_counts(patterns)
    runs = checkpointed(G.confusion_by_run(counts))
    ordered = [r.asDict() for r in runs.orderBy("pipeline", "run").collect()]
    summaries = {
        metric: {r["pipeline"]: r.asDict() for r in M.summarize_runs(runs, ["pipeline"], metric).collect()}
        for metric in ("precision", "recall", "f1")
    }
    pairings = G.run_pairings(counts)
    return {
        "per_run": ordered,
        "aggregates": summaries,
        "costs": [r.asDict() for r in G.run_costs(decisions).orderBy("pipeline", "run").collect()],
        "agreement": G.pairing_summary(pairings).first().asDict(),
        "all_pairings": [r.asDict() for r in pairings.orderBy("single_run", "multi_run").collect()],
        "record_structure": G.entity_multiplicity(labels).first().asDict(),
        "permutation_test": permutation_test(runs).first().asDict(),
        "bootstrap": bootstrap_range(bootstrap_effects(patterns)).first().asDict(),
        "key_label_digest": multiset_digest(labels, label_line()).first()["digest"],
        "decision_digests": [
            r.asDict() for r in multiset_digest(decisions, decision_line(), ["pipeline", "run"]).orderBy("pipeline", "run").collect()
        ],
    }


def statistics_report(payload: dict) -> str:
    """Markdown rendered from the payload alone."""
    cells = ("tp", "fp", "fn", "tn")
    runs = [[r["pipeline"], r["run"], *(r[c] for c in cells), f"{r['f1']:.4f}"] for r in payload["per_run"]]
    lines = ["# Statistics", "", *markdown_table(("Pipeline", "Run", *(c.upper() for c in cells), "F1"), runs), ""]
    aggregates = [
        [metric, pipeline, spread_cell(s["mean"], s["sample_sd"])]
        for metric, by in payload["aggregates"].items()
        for pipeline, s in sorted(by.items())
    ]
    lines += [*markdown_table(("Metric", "Pipeline", "Mean +/- SD"), aggregates), ""]
    for section in ("agreement", "permutation_test", "bootstrap", "record_structure"):
        lines += [f"## {section.replace('_', ' ').capitalize()}", *markdown_table(("Quantity", "Value"), payload[section].items()), ""]
    return "\n".join(lines)
