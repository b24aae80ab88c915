"""Match metrics, confusion counts and their summaries over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["source_id", "target_id"]

# The metrics that are averaged over runs.
RUN_METRICS = (
    "precision",
    "recall",
    "f1",
    "total_runtime",
    "runtime_per_pair",
    "total_tokens",
    "tokens_per_pair",
    "parse_errors",
)


def is_match(verdict: Column) -> Column:
    """Whether a verdict says MATCH in any case; null verdicts do not."""
    return F.coalesce(F.upper(verdict) == "MATCH", F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))


def confusion_counts(predicted: Column, actual: Column) -> list[Column]:
    return [
        count_if(predicted & actual).alias("tp"),
        count_if(predicted & ~actual).alias("fp"),
        count_if(~predicted & actual).alias("fn"),
        count_if(~predicted & ~actual).alias("tn"),
    ]


def with_rates(counts: DataFrame, harmonic: bool = False) -> DataFrame:
    """Add n, precision, recall, f1 and accuracy to confusion counts.

    The two F1 forms agree up to the last place; ``harmonic`` picks
    2PR/(P+R) over 2tp/(2tp+fp+fn).
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = counts.withColumns(
        {"n": tp + fp + fn + tn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}
    )
    p, r = F.col("precision"), F.col("recall")
    f1 = ratio(2.0 * p * r, p + r) if harmonic else ratio(2 * tp, 2 * tp + fp + fn)
    return rated.withColumns({"f1": f1, "accuracy": ratio(tp + tn, F.col("n"))})


def match_metrics(
    predictions: DataFrame,
    truth: DataFrame,
    total_tokens: Column | int = 0,
    elapsed_seconds: float = 0.0,
) -> DataFrame:
    """The fourteen metrics of one prediction set, as one row.

    Duplicate predictions of a pair each count as a row but the pair counts
    once towards the reachable truth, so the predictions are first reduced to
    one row per pair: that is the only shuffle of any size.
    """
    parse_error = F.col("parse_error") if "parse_error" in predictions.columns else F.lit(False)
    tokens = total_tokens if isinstance(total_tokens, Column) else F.lit(total_tokens)
    per_pair = predictions.groupBy(*KEYS).agg(
        F.count("*").alias("rows"),
        count_if(is_match(F.col("verdict"))).alias("matches"),
        count_if(F.coalesce(parse_error, F.lit(False))).alias("errors"),
        F.sum(tokens).alias("row_tokens") if isinstance(total_tokens, Column) else F.lit(0).alias("row_tokens"),
    )
    known = truth.select(*KEYS, F.lit(True).alias("is_true"))
    joined = per_pair.join(known, KEYS, "left").withColumn(
        "is_true", F.coalesce("is_true", F.lit(False))
    )
    zero = F.lit(0).cast("bigint")
    totals = joined.agg(
        F.coalesce(F.sum(F.when(F.col("is_true"), F.col("matches"))), zero).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("is_true"), F.col("matches"))), zero).alias("fp"),
        count_if(F.col("is_true")).alias("gt_in_candidates"),
        F.coalesce(F.sum("rows"), zero).alias("total_pairs"),
        F.coalesce(F.sum("errors"), zero).alias("parse_errors"),
        F.coalesce(F.sum("row_tokens"), zero).cast("bigint").alias("row_tokens"),
    )
    spent = F.col("row_tokens") if isinstance(total_tokens, Column) else tokens.cast("bigint")
    counts = totals.withColumns(
        {
            "fn": F.col("gt_in_candidates") - F.col("tp"),
            "predicted_matches": F.col("tp") + F.col("fp"),
            "total_tokens": spent,
            "total_runtime": F.lit(float(elapsed_seconds)),
        }
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rates = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumns(
        {
            "f1": ratio(2.0 * p * r, p + r),
            "tokens_per_pair": ratio(F.col("total_tokens"), F.col("total_pairs")),
            "runtime_per_pair": ratio(F.col("total_runtime"), F.col("total_pairs")),
        }
    ).drop("row_tokens")


def outcome(predicted: Column, actual: Column) -> Column:
    """The confusion bucket of one row."""
    return (
        F.when(predicted & actual, "tp")
        .when(predicted & ~actual, "fp")
        .when(~predicted & actual, "fn")
        .otherwise("tn")
    )


def run_confusions(decisions: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Confusion and rates per group (for example pipeline and run)."""
    joined = decisions.join(labels.select(*KEYS, "label"), KEYS)
    matched, actual = is_match(F.col("verdict")), F.col("label") == 1
    return with_rates(joined.groupBy(*by).agg(*confusion_counts(matched, actual)))


def run_mean_and_spread(runs: DataFrame, metrics: list[str] | tuple[str, ...]) -> DataFrame:
    """Mean and population deviation of each metric over runs."""
    long = runs.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [], list(metrics), "metric", "value"
    )
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def summarize_runs(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation per group; fewer than two values is an error."""
    few = F.raise_error(F.lit("sample standard deviation needs at least two observations"))
    return values.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.when(F.count(value) < 2, few.cast("double")).otherwise(F.stddev_samp(value)).alias("sample_sd"),
    )
