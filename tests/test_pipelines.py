import json

import pytest

from pairwright import cli, evaluation
from pairwright.matchers.clients import WordOverlapClient
from pairwright.operators.lookup import label_lookup
from pairwright.plans import standins as B
from pairwright.sources import reports as R
from pairwright.sources.cache import CacheValidationError
from pairwright.sources.tables import load_dataset
from pairwright.streaming.decision_log import follow_documents, running_confusion

SF = "/root/testdata/sf0.001"


def _dataset(folder):
    kinds = ["sony dvd player", "apple ipad tablet", "lg wide monitor", "bosch drill kit"]
    for name, tag in (("tableA.csv", "a"), ("tableB.csv", "b")):
        rows = [f"{tag}{i},{kinds[i % 4]} {i // 4},\"{kinds[i % 4]}, boxed\",{10 + i % 4}" for i in range(16)]
        (folder / name).write_text("id,name,description,price\n" + "\n".join(rows) + "\n")
    pairs = [(f"a{i}", f"b{j}", int(i == j)) for i in range(16) for j in range(16) if (i + j) % 2 == 0]
    for name, keep in (("train.csv", 0), ("valid.csv", 1), ("test.csv", 2)):
        rows = [f"{a},{b},{y}" for n, (a, b, y) in enumerate(pairs) if (n // 3) % 3 == keep]
        (folder / name).write_text("ltable_id,rtable_id,label\n" + "\n".join(rows) + "\n")
    return str(folder)


def test_command_line_and_full_evaluation(spark, tmp_path):
    data_dir, out = _dataset(tmp_path), str(tmp_path / "out")
    blocked = cli.run(["blocking", "--data", data_dir, "--out", out])
    assert blocked["recall"] == 1.0 and blocked["n_pairs"] > 0
    single = cli.run(["single-llm", "--data", data_dir, "--out", out, "--offline", "--max-pairs", "5"])
    assert single["total_pairs"] == 5 and single["total_tokens"] > 0
    data = load_dataset(spark, data_dir)
    results = evaluation.run_evaluation(data, WordOverlapClient, out + "/eval", 1)
    assert set(results["pipelines"]) == {"random_forest", "single_llm", "multi_agent"}
    assert all(p["runs"][0]["total_pairs"] == results["num_test_pairs"] for p in results["pipelines"].values())
    text = R.evaluation_report(results)
    assert "| Precision |" in text and "+/-" in text


def test_reports_of_kept_runs(spark, tmp_path):
    data_dir, out = _dataset(tmp_path), str(tmp_path / "out")
    data = load_dataset(spark, data_dir)
    for run in range(5):
        for agents, name in ((False, "single_llm"), (True, "multi_agent")):
            evaluation.run_model(data, agents, WordOverlapClient, f"{out}/decisions/{name}/run={run}")
    written = cli.run(["reports", "--data", data_dir, "--out", out])
    assert set(written) == {"statistics", "arbitration", "supplementary", "errors_single_llm", "errors_multi_agent"}
    payload = json.loads(spark.read.text(f"{out}/reports/canonical_statistics", wholetext=True).first()[0])
    assert len(payload["per_run"]) == 10 and payload["agreement"]["n_pairings"] == 25
    text = spark.read.text(written["supplementary"], wholetext=True).first()[0]
    assert all(f"## {part}" in text for part in ("Ensembles", "Agents alone", "Calibration", "Overrides", "Disagreements"))
    # A run that lacks a pair stops the reports before anything is computed.
    runs = evaluation.kept_runs(spark, f"{out}/decisions")
    labels = label_lookup(data.test)
    lost = runs.filter("NOT (run = 3 AND source_id = 'a0')")
    with pytest.raises(CacheValidationError, match="run 3: .* missing key"):
        R.statistics_payload(lost, labels)
    with pytest.raises(CacheValidationError, match="repeated label"):
        R.checked_runs(runs, labels.unionByName(labels.limit(1)))
    empty = runs.limit(0)
    assert evaluation.R.G.run_violations(empty, labels.limit(0)).count() == 0


def test_registered_sql_functions(spark):
    from pairwright.functions.sql import register_functions

    register_functions(spark)
    row = spark.sql("SELECT needleman_wunsch('abc', 'abc') AS nw, smith_waterman('xabcy', 'abc') AS sw").first()
    assert (row["nw"], row["sw"]) == (3.0, 3.0)


def test_reports(spark, tmp_path):
    rows = B.decisions(spark, SF).cache()
    multi = rows.filter("pipeline = 'multi_agent'")
    assert "agents_disagree" in R.arbitration_report(multi)
    goods = B.named_products(spark, SF)
    one = multi.filter("run = 0").selectExpr("*", "'price differs' AS reasoning")
    report = R.error_report(one, goods, goods, str(tmp_path / "errors"))
    assert "## False Positives" in report and "sparse description" in report
    assert spark.read.csv(str(tmp_path / "errors"), header=True).count() == R.error_listing(one, goods, goods).count()


def test_canonical_json_is_stable_and_cells_truncate():
    assert R.canonical_json({"b": 1, "a": [1]}) == json.dumps({"a": [1], "b": 1}, indent=2) + "\n"
    assert R.whole_cell(1234.9, 0.9) == "1,234 +/- 0"
    assert R.spread_cell(0.5, 0.25) == "0.5000 +/- 0.2500"


def test_following_a_cache_counts_each_pair_once(spark, tmp_path):
    folder = tmp_path / "cache"
    folder.mkdir()
    for name, s, verdict in (("1.json", "1", "MATCH"), ("1b.json", "1", "MATCH"), ("2.json", "2", "NO MATCH")):
        body = {"prediction": {"source_id": s, "target_id": "9", "verdict": verdict}, "tokens": 1}
        (folder / name).write_text(json.dumps(body))
    labels = spark.createDataFrame([("1", "9", 1), ("2", "9", 1)], "source_id string, target_id string, label int")
    query = (
        running_confusion(follow_documents(spark, str(folder)), labels)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("running_confusion")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(60)
    row = spark.table("running_confusion").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 0, 1, 0)


def test_listed_errors_keep_whole_names(spark):
    name = "sony dvd player " * 10
    goods = spark.createDataFrame([("1", name, "", "5")], "id string, name string, description string, price string")
    rows = [("1", "1", "NO MATCH", 0.9, "", 1)]
    decided = spark.createDataFrame(rows, "source_id string, target_id string, verdict string, confidence double, reasoning string, label int")
    row = R.error_listing(decided, goods, goods).first()
    assert (row["source_name"], row["target_name"]) == (name, name)
