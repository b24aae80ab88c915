import math
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import agreement as G
from pairwright.operators import decisions as D
from pairwright.operators import inference as I
from pairwright.operators import metrics as M
from pairwright.operators import thresholds as T
from pairwright.plans import inference_queries

# Published per-run F1 values of the two configurations.
SINGLE_F1 = (0.9061784897025172, 0.9041095890410958, 0.9016018306636155, 0.9103448275862068, 0.9103448275862068)
MULTI_F1 = (0.9056603773584906, 0.8962264150943396, 0.8962264150943396, 0.8942307692307693, 0.8941176470588236)


def _runs(spark, left, right):
    rows = [("single_llm", i, v) for i, v in enumerate(left)] + [("multi_agent", i, v) for i, v in enumerate(right)]
    return spark.createDataFrame(rows, "pipeline string, run int, f1 double")


def test_permutation_reproduces_published_values(spark):
    row = I.permutation_test(_runs(spark, SINGLE_F1, MULTI_F1)).first()
    assert (row["total_allocations"], row["extreme_allocations"]) == (252, 6)
    assert row["p_value"] == 6 / 252
    assert row["statistic"] == pytest.approx(3.3555, abs=5e-5)
    assert row["delta"] == pytest.approx(0.009223588148576045, abs=1e-15)


def test_permutation_is_symmetric_and_order_free(spark):
    swapped = I.permutation_test(_runs(spark, MULTI_F1, SINGLE_F1)).first()
    assert swapped["extreme_allocations"] == 6 and swapped["statistic"] == pytest.approx(-3.35545, abs=1e-4)
    shuffled = I.permutation_test(_runs(spark, SINGLE_F1[::-1], MULTI_F1[2:] + MULTI_F1[:2])).first()
    assert shuffled["extreme_allocations"] == 6


def test_permutation_of_identical_groups(spark):
    row = I.permutation_test(_runs(spark, SINGLE_F1, SINGLE_F1)).first()
    assert row["p_value"] == 1.0 and row["statistic"] == 0.0


def test_permutation_rejects_other_shapes(spark):
    with pytest.raises(Exception, match="expected 5 observations"):
        I.permutation_test(_runs(spark, SINGLE_F1[:4], MULTI_F1)).collect()


PUBLISHED = [
    ("single_llm", 0, 198, 33, 8, 1677, 0.9061784897025172),
    ("multi_agent", 0, 192, 26, 14, 1684, 0.9056603773584906),
    ("multi_agent", 3, 186, 24, 20, 1686, 0.8942307692307693),
]


@pytest.mark.parametrize("pipeline, run, tp, fp, fn, tn, f1", PUBLISHED)
def test_f1_of_published_counts(spark, pipeline, run, tp, fp, fn, tn, f1):
    counts = spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")
    row = M.with_rates(counts).first()
    assert row["f1"] == pytest.approx(f1, abs=1e-15) and row["n"] == 1916


def test_kappa_of_published_matrix(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1679), (0, 0, 1, 6), (0, 1, 0, 19), (0, 1, 1, 212)], "label int, single_mask int, multi_mask int, pairs long")
    pairing = G.run_pairings(rows).filter("single_run = 0 AND multi_run = 0").first()
    assert pairing["agreements"] == 1891
    assert pairing["cohen_kappa"] == pytest.approx(0.9369, abs=5e-5)
    matrix = {r["single"]: (r["multi_no_match"], r["multi_match"]) for r in G.agreement_matrix(rows).collect()}
    assert matrix == {0: (1679, 6), 1: (19, 212)}


def test_kappa_when_chance_is_certain(spark):
    row = spark.range(1).select(
        G.kappa(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("same"),
        G.kappa(F.lit(0.5), F.lit(1.0), F.lit(1.0)).alias("other"),
    ).first()
    assert (row["same"], row["other"]) == (1.0, 0.0)


def _predictions(spark, rows):
    return spark.createDataFrame(rows, "source_id string, target_id string, verdict string, parse_error boolean")


def test_match_metrics_with_duplicates_and_unknown_truth(spark):
    predictions = _predictions(
        spark,
        [("a", "x", "MATCH", False), ("a", "x", "match", False), ("b", "y", "NO MATCH", True), ("c", "z", "MATCH", False), ("d", "w", None, None)],
    )
    truth = spark.createDataFrame([("a", "x"), ("b", "y"), ("q", "q")], "source_id string, target_id string")
    row = M.match_metrics(predictions, truth, total_tokens=100, elapsed_seconds=10.0).first()
    assert (row["tp"], row["fp"], row["fn"], row["gt_in_candidates"]) == (2, 1, 0, 2)
    assert (row["total_pairs"], row["predicted_matches"], row["parse_errors"]) == (5, 3, 1)
    assert (row["tokens_per_pair"], row["runtime_per_pair"], row["total_tokens"]) == (20.0, 2.0, 100)


def test_match_metrics_of_nothing(spark):
    empty = _predictions(spark, [])
    truth = spark.createDataFrame([("a", "x")], "source_id string, target_id string")
    row = M.match_metrics(empty, truth).first()
    assert (row["tp"], row["fn"], row["precision"], row["f1"], row["tokens_per_pair"]) == (0, 0, 0.0, 0.0, 0.0)


def test_sample_deviation_needs_two_values(spark):
    values = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "g string, v double")
    assert M.summarize_runs(values, ["g"], "v").first()["sample_sd"] == 1.0
    with pytest.raises(Exception, match="at least two"):
        M.summarize_runs(values.limit(1), ["g"], "v").collect()


def _brute_sweep(rows, grid):
    out = []
    for tau in grid.values():
        tp = sum(1 for s, y in rows if s >= tau and y == 1)
        fp = sum(1 for s, y in rows if s >= tau and y == 0)
        fn = sum(1 for s, y in rows if s < tau and y == 1)
        out.append((tp, fp, fn))
    return out


@pytest.mark.parametrize("grid", [T.CURVE_GRID, T.TUNING_GRID])
def test_sweep_equals_comparing_every_threshold(spark, grid):
    scores = [v for v in grid.values()] + [v + 1e-9 for v in grid.values()] + [v - 1e-9 for v in grid.values()]
    scores += [i / 100 for i in range(101)] + [-0.5, 1.5, 0.0, 1.0]
    rows = [(float(s), i % 2) for i, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "score double, label int")
    got = T.threshold_sweep(frame, grid).orderBy("position").collect()
    assert [(r["tp"], r["fp"], r["fn"]) for r in got] == _brute_sweep(rows, grid)
    assert [r["threshold"] for r in got] == grid.values()


def test_best_threshold(spark):
    def best(rows):
        return T.best_threshold(spark.createDataFrame(rows, "label int, score double"))

    tau, f1 = best([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)])
    assert f1 == 1.0 and 0.2 < tau <= 0.8
    assert best([(0, 0.3), (0, 0.5)]) == (0.5, 0.0)


def test_bootstrap_effect_equals_scalar_computation(spark):
    pairs = [(0, 0, 1, 1, 1), (0, 1, 0, 2, 0), (1, 0, 1, 0, 3), (1, 1, 0, 0, 0), (2, 1, 1, 3, 2)]
    slotted = spark.createDataFrame(pairs, "source_slot long, target_slot long, label int, single_mask int, multi_mask int")
    sources, targets, picks = {0: 2, 2: 1}, {0: 1, 1: 2}, {"single_llm": [0, 1], "multi_agent": [1, 1]}
    s = spark.createDataFrame([(0, k, v) for k, v in sources.items()], "replicate long, source_slot long, source_count long")
    t = spark.createDataFrame([(0, k, v) for k, v in targets.items()], "replicate long, target_slot long, target_count long")
    r = spark.createDataFrame([(0, p, i, run) for p, runs in picks.items() for i, run in enumerate(runs)], "replicate long, pipeline string, pick int, run int")
    row = I.draw_effects(slotted, s, t, r).first()

    def f1(mask_at, run):
        tp = wrong = 0
        for pair in pairs:
            w = sources.get(pair[0], 0) * targets.get(pair[1], 0)
            says, actual = bool(pair[mask_at] >> run & 1), pair[2] == 1
            tp += w * (says and actual)
            wrong += w * (says != actual)
        return 2 * tp / (2 * tp + wrong)

    expected = sum(f1(3, x) for x in picks["single_llm"]) / 2 - sum(f1(4, x) for x in picks["multi_agent"]) / 2
    assert row["effect"] == pytest.approx(expected)


def _graph(spark, n=40):
    rows = []
    for i in range(n):
        rows += [(f"s{i:03d}", f"t{i:03d}", 1, 31 if i else 29, 31), (f"s{i:03d}", f"t{(i + 1) % n:03d}", 0, 0, 0)]
    return spark.createDataFrame(rows, "source_id string, target_id string, label int, single_mask int, multi_mask int")


def test_bootstrap_is_deterministic_and_partition_free(spark):
    first = I.bootstrap_effects(_graph(spark), 20).orderBy("replicate").collect()
    again = I.bootstrap_effects(_graph(spark).repartition(7), 20).orderBy("replicate").collect()
    other = I.bootstrap_effects(_graph(spark), 20, seed=1).orderBy("replicate").collect()
    assert first == again and first != other and len(first) == 20
    mirrored = _graph(spark).withColumn("single_mask", F.col("multi_mask"))
    assert all(math.isclose(r["effect"], 0.0, abs_tol=1e-12) for r in I.bootstrap_effects(mirrored, 5).collect())


def test_bootstrap_in_chunks_equals_the_draws_one_by_one(spark):
    pairs = _graph(spark).withColumn("multi_mask", F.when(F.col("label") == 1, 27).otherwise(4))
    ids = {kind: I.dense_slots(pairs, f"{kind}_id", f"{kind}_slot") for kind in ("source", "target")}
    slotted = pairs.join(ids["source"], "source_id").join(ids["target"], "target_id")
    draws = [I.entity_draws(spark, kind, 40, 13, I.BOOTSTRAP_SEED) for kind in ("source", "target")]
    wanted = I.draw_effects(slotted, *draws, I.run_draws(spark, 13, I.BOOTSTRAP_SEED)).orderBy("replicate").collect()
    got = I.bootstrap_effects(pairs, 13, chunk=4).orderBy("replicate").collect()
    assert [r["replicate"] for r in got] == list(range(13))
    for mine, other in zip(got, wanted):
        assert list(mine) == pytest.approx([other[c] for c in got[0].asDict()])


def test_registered_bootstrap_draws_all_replicates():
    assert inference_queries.REPLICATES == I.BOOTSTRAP_REPLICATES == 50_000


def test_draws_add_up_to_the_entities(spark):
    sums = I.entity_draws(spark, "source", 37, 4, 9).groupBy("replicate").agg(F.sum("source_count").alias("n")).collect()
    assert [r["n"] for r in sums] == [37] * 4


def test_undefined_replicate_raises(spark):
    rows = [("a", "x", 0, 0, 0), ("b", "y", 0, 0, 0)]
    frame = spark.createDataFrame(rows, "source_id string, target_id string, label int, single_mask int, multi_mask int")
    with pytest.raises(Exception, match="weighted F1 is undefined"):
        I.bootstrap_effects(frame, 2).collect()


def test_dense_slots_are_sorted_and_dense(spark):
    ids = spark.createDataFrame([(f"{i:04d}",) for i in range(300)], "id string").repartition(5)
    rows = I.dense_slots(ids, "id", "slot").orderBy("id").collect()
    assert [r["slot"] for r in rows] == list(range(300))


def test_arbitration_hand_case(spark):
    rows = [("MATCH", "MATCH", "MATCH", 1), ("NO MATCH", "MATCH", "MATCH", 1), ("MATCH", "NO MATCH", "NO MATCH", 1), ("MATCH", "MATCH", "NO MATCH", 1)]
    agents = spark.createDataFrame(rows, "verdict string, syn_verdict string, sem_verdict string, label int")
    row = D.arbitration(agents).first()
    assert (row["agents_agree"], row["agents_disagree"], row["overrides_of_consensus"], row["overrides_correct"]) == (3, 1, 2, 1)


def test_fallback_prefers_syntactic_on_ties(spark):
    rows = [("MATCH", 0.6, "NO MATCH", 0.6), ("MATCH", 0.5, "NO MATCH", 0.9), ("MATCH", 0.5, "MATCH", 0.7)]
    frame = spark.createDataFrame(rows, "syn_verdict string, syn_confidence double, sem_verdict string, sem_confidence double")
    got = frame.withColumns(D.consensus_fallback()).collect()
    assert [(r["fallback_verdict"], r["fallback_confidence"]) for r in got] == [("MATCH", 0.6), ("NO MATCH", 0.9), ("MATCH", 0.6)]


def test_bootstrap_takes_its_runs_from_the_data(spark):
    rng = random.Random(2)
    keys = sorted({(f"s{rng.randrange(700):03d}", f"t{rng.randrange(30):02d}") for _ in range(1500)})
    label = {k: rng.randrange(2) for k in keys}
    rows = [
        (*k, p, run, "MATCH" if rng.random() < (0.8 if label[k] else 0.1) else "NO MATCH")
        for k in keys for p, runs in (("single_llm", (1, 4, 9)), ("multi_agent", (0, 62))) for run in runs
    ]
    schema = "source_id string, target_id string, pipeline string, run int, verdict string"
    labels = spark.createDataFrame([(*k, v) for k, v in label.items()], "source_id string, target_id string, label int")
    decisions = spark.createDataFrame(rows, schema)
    patterns = G.pair_patterns(decisions, labels)
    got = I.bootstrap_effects(patterns, 6, chunk=4).orderBy("replicate").collect()
    ids = {kind: I.dense_slots(patterns, f"{kind}_id", f"{kind}_slot") for kind in ("source", "target")}
    slotted = patterns.join(ids["source"], "source_id").join(ids["target"], "target_id")
    runs = I.known_runs(patterns)
    assert runs == {"single_llm": [1, 4, 9], "multi_agent": [0, 62]}
    draws = [I.entity_draws(spark, kind, ids[kind].count(), 6, I.BOOTSTRAP_SEED) for kind in ids]
    wanted = I.draw_effects(slotted, *draws, I.run_draws(spark, 6, I.BOOTSTRAP_SEED, runs)).orderBy("replicate").collect()
    for mine, other in zip(got, wanted, strict=True):
        assert list(mine) == pytest.approx([other[c] for c in got[0].asDict()])
    with pytest.raises(ValueError, match="lack a decision"):
        I.bootstrap_effects(G.pair_patterns(decisions.limit(len(rows) - 1), labels), 2)


def test_multiplicity_of_nothing_is_a_row(spark):
    row = G.entity_multiplicity(spark.createDataFrame([], "source_id string, target_id string")).first()
    assert (row["n_pairs"], row["unique_sources"], row["max_target_multiplicity"]) == (0, 0, None)


def test_bootstrap_counts_are_not_broadcast(spark):
    plan = I.bootstrap_effects(_graph(spark), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2


def test_key_gaps_place_the_decisions_once(spark):
    decisions = spark.createDataFrame(
        [("a", 0, "1", "1"), ("a", 0, "1", "1"), ("a", 0, "9", "9"), ("a", 0, None, "2"), ("a", 1, "1", "1"), ("a", 1, "2", "2"), ("b", 0, "9", "9")],
        "pipeline string, run int, source_id string, target_id string",
    )
    labels = spark.createDataFrame([("1", "1", 1), ("2", "2", 0)], "source_id string, target_id string, label int")
    gaps = G.key_gaps(decisions, labels)
    assert {tuple(r) for r in gaps.collect()} == {("a", 0, 1, 1), ("a", 1, 0, 0), ("b", 0, 2, 1)}
    plan = gaps._jdf.queryExecution().optimizedPlan().toString()
    assert sum("pipeline" in line for line in plan.splitlines() if "LocalRelation" in line or "LogicalRDD" in line) == 1
