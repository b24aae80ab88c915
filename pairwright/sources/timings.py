"""Wall-clock evidence: durations read from timing logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.metrics import summarize_runs

# Line prefixes, the configuration each stands for, and the
# duration that ends a line, possibly after an earlier figure and an arrow.
PREFIXES = {
    "- Magellan run": "magellan_rf",
    "- Single LLM run": "single_llm",
    "- Multi-Agent run": "multi_agent",
}
DURATION = r"in\s+(?:[0-9.]+s\s*->\s*)?([0-9.]+)s\s*$"


def _configuration(line: Column) -> Column:
    rule = None
    for prefix, name in PREFIXES.items():
        test = line.startswith(prefix)
        rule = F.when(test, name) if rule is None else rule.when(test, name)
    return rule


def parse_timing_lines(lines: DataFrame) -> DataFrame:
    """Configuration and seconds of every timing line of ``value``; others are skipped.

    A timing line without a readable duration is an error.
    """
    line = F.trim(F.col("value"))
    named = lines.withColumn("name", _configuration(line)).filter("name IS NOT NULL")
    seconds = F.regexp_extract(line, DURATION, 1).try_cast("double")
    bad = F.raise_error(F.concat(F.lit("timing log line has no parseable duration: "), line))
    return named.withColumn("seconds", F.coalesce(seconds, bad.cast("double"))).drop("value")


def runtime_summary(timings: DataFrame) -> DataFrame:
    """Samples, mean and sample deviation per configuration."""
    return summarize_runs(timings, ["name"], "seconds")


def runtime_ratio(timings: DataFrame) -> DataFrame:
    """Mean of the multi-agent runs over the mean of the single-model runs."""

    def mean(name: str) -> Column:
        return F.avg(F.when(F.col("name") == name, F.col("seconds")))

    missing = F.raise_error(F.lit("the runtime ratio needs both 'multi_agent' and 'single_llm'"))
    quotient = F.try_divide(mean("multi_agent"), mean("single_llm"))
    return timings.agg(F.coalesce(quotient, missing.cast("double")).alias("ratio"))
