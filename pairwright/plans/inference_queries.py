"""Queries over the permutation test and the entity bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.mixing import MASK, mixed_sql
from pairwright.operators import agreement as G
from pairwright.operators import inference as I
from pairwright.plans import standins as B
from pairwright.plans.registry import registered

# Replicates of the registered bootstrap: those of the operator.
REPLICATES = I.BOOTSTRAP_REPLICATES

_F1_SQL = "WITH RECURSIVE " + B.DECISIONS_SQL + """,
runs AS (
  SELECT pipeline, run,
         2 * count(*) FILTER (verdict = 'MATCH' AND label = 1)
         / (2 * count(*) FILTER (verdict = 'MATCH' AND label = 1) + count(*) FILTER ((verdict = 'MATCH') <> (label = 1)))::DOUBLE AS f
  FROM decisions GROUP BY 1, 2),
pooled AS (
  SELECT list(f ORDER BY pipeline DESC, run) AS v FROM runs),
splits AS (
  SELECT m, [v[i + 1] FOR i IN range(10) IF (m >> i) & 1 = 1] AS a, [v[i + 1] FOR i IN range(10) IF (m >> i) & 1 = 0] AS b
  FROM pooled, (SELECT unnest(range(1024)) AS m) WHERE bit_count(m) = 5),
means AS (SELECT m, a, b, list_reduce(a, lambda x, y: x + y) / 5 AS ma, list_reduce(b, lambda x, y: x + y) / 5 AS mb FROM splits),
stats AS (
  SELECT m, ma - mb AS gap, (ma - mb) / sqrt(
    list_sum(list_transform(a, lambda x: (x - ma) ** 2)) / 20 + list_sum(list_transform(b, lambda x: (x - mb) ** 2)) / 20) AS t
  FROM means)
SELECT round(o.t, 6) AS statistic, round(o.gap, 9) AS delta, count(*) AS total_allocations,
       count(*) FILTER (abs(s.t) >= abs(o.t) - 1e-9) AS extreme_allocations,
       round(count(*) FILTER (abs(s.t) >= abs(o.t) - 1e-9) / count(*), 6) AS p_value
FROM stats s, (SELECT t, gap FROM stats WHERE m = 31) o GROUP BY o.t, o.gap
"""


@registered(_F1_SQL)
def exact_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = G.pair_patterns(B.decisions(spark, sf_dir), B.decision_labels(spark, sf_dir))
    result = I.permutation_test(G.confusion_by_run(G.pattern_counts(patterns)))
    return result.select(
        F.round("statistic", 6).alias("statistic"),
        F.round("delta", 9).alias("delta"),
        "total_allocations",
        "extreme_allocations",
        F.round("p_value", 6).alias("p_value"),
    )




def _draws_sql(kind: str, replicate: str, draw: str, size: str, rows: str) -> str:
    """SQL of ``inference._draw`` over rows that name replicate, draw and size."""
    first = "SELECT *, {} AS h1 FROM ({})".format(mixed_sql("x"), (
        f"SELECT *, xor({mixed_sql('k')}, {mixed_sql('j')}) AS x FROM "
        f"(SELECT *, xor({replicate}, {I.stream_seed(kind, I.BOOTSTRAP_SEED)}) AS k, {draw} AS j FROM {rows})"
    ))
    second = f"SELECT *, (h1 + {0x9E3779B9}) & {MASK} AS y FROM ({first})"
    return f"(SELECT *, ((h1 << 31) + ({mixed_sql('y')} >> 1)) % {size} AS drawn FROM ({second}))"


def _counts_sql(kind: str, ids: str) -> str:
    rows = (
        f"(SELECT b, d, n FROM (SELECT unnest(range({REPLICATES})) AS b), "
        f"(SELECT n, unnest(range(n)) AS d FROM (SELECT count(DISTINCT {ids}) AS n FROM patterns)))"
    )
    return f"(SELECT b, drawn AS slot, count(*) AS c FROM {_draws_sql(kind, 'b', 'd', 'n', rows)} GROUP BY 1, 2)"


_PICKS_SQL = " UNION ALL ".join(
    f"SELECT b, '{p}' AS pipeline, pick AS k, drawn AS run FROM "
    + _draws_sql(p, "b", "pick", "5", f"(SELECT b, pick FROM (SELECT unnest(range({REPLICATES})) AS b), (SELECT unnest(range(5)) AS pick))")
    for p in G.PIPELINES
)
_BOOTSTRAP_SQL = "WITH " + B.SUPPLIER_DECISIONS_SQL + f""",
patterns AS (
  SELECT source_id, target_id, any_value(label) AS label,
         sum(CASE WHEN pipeline = 'single_llm' AND verdict = 'MATCH' THEN 1 << run ELSE 0 END)::BIGINT AS sm,
         sum(CASE WHEN pipeline = 'multi_agent' AND verdict = 'MATCH' THEN 1 << run ELSE 0 END)::BIGINT AS mm
  FROM decisions GROUP BY 1, 2),
slotted AS (
  SELECT dense_rank() OVER (ORDER BY source_id) - 1 AS ss, dense_rank() OVER (ORDER BY target_id) - 1 AS ts, label, sm, mm
  FROM patterns),
sd AS {_counts_sql("source", "source_id")},
td AS {_counts_sql("target", "target_id")},
weights AS (
  SELECT sd.b, label, sm, mm, sum(sd.c * td.c) AS w
  FROM slotted JOIN sd ON sd.slot = ss JOIN td ON td.slot = ts AND td.b = sd.b GROUP BY 1, 2, 3, 4),
picks AS ({_PICKS_SQL}),
cells AS (
  SELECT b, pipeline, k,
         sum(CASE WHEN says AND label = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN says <> (label = 1) THEN w ELSE 0 END) AS wrong
  FROM (SELECT *, (CASE WHEN pipeline = 'single_llm' THEN sm ELSE mm END >> run) & 1 = 1 AS says FROM picks JOIN weights USING (b))
  GROUP BY 1, 2, 3),
effects AS (
  SELECT b AS replicate, avg(2 * tp / (2 * tp + wrong)) FILTER (pipeline = 'single_llm') AS single_f1,
         avg(2 * tp / (2 * tp + wrong)) FILTER (pipeline = 'multi_agent') AS multi_f1
  FROM cells GROUP BY 1)
"""


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = B.supplier_keys(spark, sf_dir)
    return I.bootstrap_effects(G.pair_patterns(B.key_decisions(keys), B.key_labels(keys)), REPLICATES)


@registered(
    _BOOTSTRAP_SQL
    + "SELECT replicate, round(single_f1, 6) AS single_f1, round(multi_f1, 6) AS multi_f1, round(single_f1 - multi_f1, 6) AS effect FROM effects"
)
def entity_bootstrap_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("single_f1", "multi_f1", "effect")]
    return _effects(spark, sf_dir).select("replicate", *rounded)


@registered(
    _BOOTSTRAP_SQL + """
, d AS (SELECT single_f1 - multi_f1 AS e FROM effects)
SELECT count(*) AS replicates, round(avg(e), 6) AS mean_effect, round(quantile_cont(e, 0.025), 6) AS range_lower,
       round(quantile_cont(e, 0.975), 6) AS range_upper, quantile_cont(e, 0.025) <= 0 AND quantile_cont(e, 0.975) >= 0 AS includes_zero
FROM d
"""
)
def entity_bootstrap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = I.bootstrap_range(_effects(spark, sf_dir))
    return summary.withColumns(
        {c: F.round(c, 6) for c in ("mean_effect", "range_lower", "range_upper")}
    )


@registered(
    "SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS slot FROM (SELECT DISTINCT c_name FROM customer)"
)
def entity_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dense_slots(B.table(spark, sf_dir, "customer"), "c_name", "slot")
