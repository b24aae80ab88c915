"""Statistics over repeated runs of two pipelines on the same labeled pairs.

All of them depend on a pair only through its label and through which runs said
MATCH. One shuffle on the pair key folds the decisions into that pattern; the
counts per pattern (at most 2 x 32 x 32 rows for five runs each) then answer
confusion, agreement, kappa and discordance for all run pairings without
touching the decisions again. Which runs exist is read from the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.metrics import KEYS, count_if, is_match, ratio, with_rates

# The two pipelines, and the runs of a table that doesn't say which it has.
PIPELINES = ("single_llm", "multi_agent")
RUNS = (0, 1, 2, 3, 4)
#: Runs are bits of a 64-bit number.
LAST_RUN = 62


def pair_patterns(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Label, and per pipeline which runs decided on the pair and which said MATCH.

    Which runs there are is what the decisions hold: a run without a decision on a pair
    says nothing about it, and a labeled pair without any decision stays, with no run.
    ``key_gaps`` counts such holes.
    """
    allowed = F.col("run").between(0, LAST_RUN)
    message = F.concat(F.lit(f"runs must be 0 to {LAST_RUN}, got "), F.col("run").cast("string"))
    run = F.when(allowed, F.col("run").cast("int")).otherwise(F.raise_error(message).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), run)

    def mask(pipeline: str, condition: Column) -> Column:
        return F.bit_or(F.when((F.col("pipeline") == pipeline) & condition, bit))

    yes, every = is_match(F.col("verdict")), F.lit(True)
    names = ("single_mask", "multi_mask", "single_seen", "multi_seen")
    folded = decisions.groupBy(*KEYS).agg(
        mask(PIPELINES[0], yes).alias(names[0]), mask(PIPELINES[1], yes).alias(names[1]),
        mask(PIPELINES[0], every).alias(names[2]), mask(PIPELINES[1], every).alias(names[3]),
    )
    joined = labels.select(*KEYS, "label").join(folded, KEYS, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in names})


def key_gaps(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per pipeline and run: labeled pairs without a decision, decisions without a label.

    Decisions are placed by pair once, which serves the distinct keys of every run and the
    join with the labels.
    """
    held = decisions.select("pipeline", "run", *KEYS).repartition(*KEYS).distinct()
    known = labels.select(*KEYS).distinct()
    whole = F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
    runs = (
        held.join(known.withColumn("known", F.lit(True)), KEYS, "left").groupBy("pipeline", "run")
        .agg(count_if(whole).alias("decided"), F.count("known").alias("met"))
    )
    size = known.agg(F.count("*").alias("labeled"))
    return runs.join(size).select(
        "pipeline", "run", (F.col("labeled") - F.col("met")).alias("missing"),
        (F.col("decided") - F.col("met")).alias("unlabeled"),
    )


#: What can be wrong with the rows of a run, in the order it is reported.
RULES = ("missing key", "unlabeled key", "repeated key", "malformed verdict", "malformed tokens")


def run_violations(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """``pipeline, run, rule, keys``: how many keys of a run break a rule, rules kept left out.

    Repeated labels are a row of pipeline ``labels`` without a run. Decisions are counted
    by run and key first, so that nothing is gathered and repeated rows meet once. They are
    placed by key alone, which serves the join with the labels as well.
    """
    bad_verdict = ~F.coalesce(F.col("verdict").isin("MATCH", "NO MATCH"), F.lit(False))
    bad_tokens = ~F.coalesce(F.col("tokens") >= 0, F.lit(False))
    checked = decisions.select("pipeline", "run", *KEYS, bad_verdict.alias("bad_verdict"), bad_tokens.alias("bad_tokens"))
    held = checked.repartition(*KEYS).groupBy("pipeline", "run", *KEYS).agg(
        F.count("*").alias("rows"), F.max("bad_verdict").alias("bad_verdict"), F.max("bad_tokens").alias("bad_tokens")
    )
    known = labels.groupBy(*KEYS).agg(F.count("*").alias("labels"))
    size = known.agg(F.count("*").alias("labeled"), count_if(F.col("labels") > 1).alias("keys"))
    per_run = (
        held.join(known, KEYS, "left").groupBy("pipeline", "run")
        .agg(
            count_if(F.col("labels").isNotNull()).alias("met"),
            count_if(F.col("labels").isNull()).alias(RULES[1]),
            count_if(F.col("rows") > 1).alias(RULES[2]),
            count_if(F.col("bad_verdict")).alias(RULES[3]),
            count_if(F.col("bad_tokens")).alias(RULES[4]),
        )
        .join(size.select("labeled"))
        .withColumn(RULES[0], F.col("labeled") - F.col("met"))
    )
    of_runs = per_run.unpivot(["pipeline", "run"], list(RULES), "rule", "keys")
    of_labels = size.select(
        F.lit("labels").alias("pipeline"), F.lit(None).cast(decisions.schema["run"].dataType).alias("run"),
        F.lit("repeated label").alias("rule"), "keys",
    )
    return of_runs.unionByName(of_labels).filter("keys > 0")


def pattern_counts(patterns: DataFrame) -> DataFrame:
    seen = [c for c in ("single_seen", "multi_seen") if c in patterns.columns]
    return patterns.groupBy("label", "single_mask", "multi_mask", *seen).agg(F.count("*").alias("pairs"))


def _runs(counts: DataFrame, seen: str) -> Column:
    """The runs of a pipeline that a pattern's pairs have decisions of."""
    if seen not in counts.columns:
        return F.array(*[F.lit(r) for r in RUNS])
    every = F.sequence(F.lit(0), F.lit(LAST_RUN))
    return F.filter(every, lambda r: F.call_function("getbit", F.col(seen), r) == 1)


def _says(mask: str, run: str) -> Column:
    return F.expr(f"getbit({mask}, {run}) = 1")


def _weight(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("pairs")).otherwise(0))


def _per_run(counts: DataFrame) -> DataFrame:
    """One row per pattern, pipeline and run of it, with what that run said."""
    def rows(pipeline: str, mask: str, seen: str) -> Column:
        return F.transform(
            _runs(counts, seen),
            lambda r: F.struct(
                F.lit(pipeline).alias("pipeline"), r.alias("run"),
                (F.call_function("getbit", F.col(mask), r) == 1).alias("says"),
            ),
        )

    both = F.concat(
        rows(PIPELINES[0], "single_mask", "single_seen"), rows(PIPELINES[1], "multi_mask", "multi_seen")
    )
    return counts.select("label", "pairs", F.explode(both).alias("d")).select("label", "pairs", "d.*")


def confusion_by_run(counts: DataFrame) -> DataFrame:
    says, actual = F.col("says"), F.col("label") == 1
    cells = _per_run(counts).groupBy("pipeline", "run").agg(
        _weight(says & actual).alias("tp"),
        _weight(says & ~actual).alias("fp"),
        _weight(~says & actual).alias("fn"),
        _weight(~says & ~actual).alias("tn"),
    )
    return with_rates(cells)


def kappa(observed: Column, left_rate: Column, right_rate: Column) -> Column:
    """Cohen's kappa; with certain agreement by chance, 1 if observed and else 0."""
    expected = left_rate * right_rate + (1.0 - left_rate) * (1.0 - right_rate)
    chance_only = F.when(observed == 1.0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(expected == 1.0, chance_only).otherwise(
        F.try_divide(observed - expected, 1.0 - expected)
    )


def run_pairings(counts: DataFrame) -> DataFrame:
    """Agreement, kappa and discordance cells of all pairings of a run of each pipeline.

    A pairing counts the pairs that both of its runs decided on.
    """
    crossed = counts.withColumn("single_run", F.explode(_runs(counts, "single_seen"))).withColumn(
        "multi_run", F.explode(_runs(counts, "multi_seen"))
    )
    single, multi = _says("single_mask", "single_run"), _says("multi_mask", "multi_run")
    actual = F.col("label") == 1
    left_ok, right_ok = single == actual, multi == actual
    cells = crossed.groupBy("single_run", "multi_run").agg(
        F.sum("pairs").alias("n"),
        _weight(single == multi).alias("agreements"),
        _weight(single).alias("single_yes"),
        _weight(multi).alias("multi_yes"),
        _weight(left_ok & ~right_ok).alias("b_single_only_correct"),
        _weight(right_ok & ~left_ok).alias("c_multi_only_correct"),
        _weight(left_ok & right_ok).alias("both_correct"),
        _weight(~left_ok & ~right_ok).alias("neither_correct"),
    )
    rate = ratio(F.col("agreements"), F.col("n"))
    return cells.select(
        "single_run",
        "multi_run",
        "n",
        "agreements",
        rate.alias("agreement_rate"),
        kappa(rate, ratio(F.col("single_yes"), F.col("n")), ratio(F.col("multi_yes"), F.col("n"))).alias("cohen_kappa"),
        "b_single_only_correct",
        "c_multi_only_correct",
        "both_correct",
        "neither_correct",
        (F.col("b_single_only_correct") + F.col("c_multi_only_correct")).alias("discordant"),
    )


def pairing_summary(pairings: DataFrame) -> DataFrame:
    """Mean, sample deviation and range over the pairings, and the micro-average."""
    return pairings.agg(
        F.count("*").alias("n_pairings"),
        F.avg("agreement_rate").alias("agreement_mean"),
        F.stddev_samp("agreement_rate").alias("agreement_sd"),
        F.min("agreement_rate").alias("agreement_min"),
        F.max("agreement_rate").alias("agreement_max"),
        F.avg("cohen_kappa").alias("kappa_mean"),
        F.stddev_samp("cohen_kappa").alias("kappa_sd"),
        F.min("cohen_kappa").alias("kappa_min"),
        F.max("cohen_kappa").alias("kappa_max"),
        F.sum("n").alias("decisions"),
        F.sum("agreements").alias("agreements"),
        ratio(F.sum("agreements"), F.sum("n")).alias("micro_agreement_rate"),
    )


def agreement_matrix(counts: DataFrame, single_run: int = 0, multi_run: int = 0) -> DataFrame:
    """The 2 x 2 table of one run pairing, one row per verdict of the first pipeline."""
    runs = counts.withColumns({"single_run": F.lit(single_run), "multi_run": F.lit(multi_run)})
    if "single_seen" in counts.columns:
        runs = runs.where(_says("single_seen", "single_run") & _says("multi_seen", "multi_run"))
    multi = _says("multi_mask", "multi_run")
    return runs.groupBy(_says("single_mask", "single_run").cast("int").alias("single")).agg(
        _weight(~multi).alias("multi_no_match"), _weight(multi).alias("multi_match")
    )


def entity_multiplicity(pairs: DataFrame) -> DataFrame:
    """How often entities recur among the pairs.

    Counted per entity rather than by a window over its pairs, so that an
    entity holding a third of all pairs is a single combined count.
    """

    def side(name: str) -> DataFrame:
        per_entity = pairs.groupBy(f"{name}_id").agg(F.count("*").alias("m"))
        shared = F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0))
        return per_entity.agg(
            F.count("*").alias(f"unique_{name}s"),
            F.max("m").alias(f"max_{name}_multiplicity"),
            ratio(shared, F.sum("m")).alias(f"share_pairs_sharing_a_{name}"),
            F.coalesce(F.sum("m"), F.lit(0)).alias("n_pairs"),
        )

    # both sides count the same pairs, none included
    return side("source").join(side("target"), "n_pairs")


def run_costs(decisions: DataFrame) -> DataFrame:
    """Tokens and parse errors per pipeline and run."""
    return decisions.groupBy("pipeline", "run").agg(
        F.count("*").alias("n_records"),
        count_if(F.col("parse_error")).alias("parse_errors"),
        F.sum("tokens").alias("tokens_total"),
        ratio(F.sum("tokens"), F.count("*")).alias("tokens_per_pair"),
    )


def token_ratio(costs: DataFrame) -> DataFrame:
    """Tokens of the second pipeline over tokens of the first, over all runs."""

    def total(pipeline: str) -> Column:
        return F.sum(F.when(F.col("pipeline") == pipeline, F.col("tokens_total")).otherwise(0))

    return costs.agg(
        total(PIPELINES[0]).alias("single_tokens"),
        total(PIPELINES[1]).alias("multi_tokens"),
        ratio(total(PIPELINES[1]), total(PIPELINES[0])).alias("token_ratio"),
    )
