"""Threshold sweeps in one pass: a histogram of scores, then running totals.

Comparing every row with every threshold would multiply the rows by the length
of the grid. A score passes exactly the thresholds up to one grid position, so
the rows are counted per position and label, and the few counts are summed from
the top of the grid downwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.operators.metrics import ratio


@dataclass(frozen=True)
class Grid:
    """Thresholds ``start + i * step``, as exact doubles."""

    start: float
    step: float
    count: int

    def values(self) -> list[float]:
        return [self.start + i * self.step for i in range(self.count)]


# The curve over confidences and the sweep over probabilities.
CURVE_GRID = Grid(0.0, 0.01, 101)
TUNING_GRID = Grid(0.05, 0.05, 19)
DEFAULT_THRESHOLD = 0.5


def match_score(verdict: Column, confidence: Column) -> Column:
    """Confidence in MATCH: the confidence itself, or what it leaves over."""
    return F.when(F.upper(verdict) == "MATCH", confidence).otherwise(1.0 - confidence)


def grid_position(score: Column, grid: Grid) -> Column:
    """Index of the highest threshold not above the score, -1 below all of them."""
    guess = F.floor((score - grid.start) / grid.step).cast("int")
    clamped = F.greatest(F.lit(-1), F.least(F.lit(grid.count - 1), guess))

    def at(index: Column) -> Column:
        return F.lit(grid.start) + index * F.lit(grid.step)

    up = (clamped < grid.count - 1) & (at(clamped + 1) <= score)
    down = (clamped >= 0) & (at(clamped) > score)
    return F.when(up, clamped + 1).when(down, clamped - 1).otherwise(clamped)


def threshold_sweep(scored: DataFrame, grid: Grid, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 at every threshold of the grid.

    ``scored`` has ``score`` and ``label`` (and the columns in ``by``).
    """
    by = by or []
    positive = (F.col("label") == 1).cast("bigint")
    counts = (
        scored.select(*by, grid_position(F.col("score"), grid).alias("position"), positive.alias("pos"))
        .groupBy(*by, "position")
        .agg(F.sum("pos").alias("pos"), F.count("*").alias("rows"))
    )
    # One array of (position, counts) per group, at most grid-many entries long.
    folded = counts.groupBy(*by).agg(
        F.collect_list(F.struct("position", "pos", "rows")).alias("bins"),
        F.sum("pos").alias("positives"),
    )
    tau = F.posexplode(F.array(*[F.lit(v) for v in grid.values()]))
    swept = folded.select(*by, "bins", "positives", tau.alias("position", "threshold"))

    def passed(field: str) -> Column:
        return F.aggregate(
            "bins",
            F.lit(0).cast("bigint"),
            lambda acc, b: acc + F.when(b["position"] >= F.col("position"), b[field]).otherwise(0),
        )

    tp = F.col("tp")
    cells = swept.select(
        *by,
        "position",
        "threshold",
        passed("pos").alias("tp"),
        passed("rows").alias("predicted"),
        "positives",
    ).select(*by, "position", "threshold", tp, (F.col("predicted") - tp).alias("fp"), (F.col("positives") - tp).alias("fn"))
    rates = cells.withColumns(
        {"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))}
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", ratio(2.0 * p * r, p + r))


def first_best(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The lowest threshold with the largest F1, per group."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(F.desc("f1"), "position") if by else None
    if order is None:
        return sweep.orderBy(F.desc("f1"), "position").limit(1)
    return sweep.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def best_threshold(scored: DataFrame, grid: Grid = TUNING_GRID) -> tuple[float, float]:
    """Threshold and F1 of the best sweep point; (0.5, 0.0) when none is positive."""
    best = first_best(threshold_sweep(scored, grid)).first()
    if best is None or best["f1"] <= 0.0:
        return DEFAULT_THRESHOLD, 0.0
    return float(best["threshold"]), float(best["f1"])
