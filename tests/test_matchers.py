import json

import pytest
from pyspark.sql import functions as F

from pairwright.matchers import pipelines as P
from pairwright.matchers.clients import Reply, ServiceClient, WordOverlapClient


def _scripted(syntactic, semantic, final):
    """A client whose reply depends on the instructions it gets; local, so that it travels."""
    by = {P.P.SYNTACTIC_INSTRUCTIONS: syntactic, P.P.SEMANTIC_INSTRUCTIONS: semantic, P.P.ORCHESTRATOR_INSTRUCTIONS: final}
    reply_of = Reply

    class Scripted:
        def complete(self, messages):
            return reply_of(by[messages[0]["content"]], 1)

    return Scripted


def _verdict(verdict, confidence=0.9):
    return json.dumps({"verdict": verdict, "confidence": confidence, "reasoning": "r"})


def test_orchestrator_fallback_and_agent_errors(spark):
    goods = _goods(spark)
    pairs = spark.createDataFrame([("1", "2")], "source_id string, target_id string")

    def decided(*replies):
        return P.agent_answers(pairs, goods, goods, _scripted(*replies)).first()

    row = decided(_verdict("MATCH", 0.6), _verdict("NO MATCH", 0.6), "garbage")
    assert (row["verdict"], row["parse_error"], row["tokens"]) == ("MATCH", False, 3)
    row = decided("garbage", _verdict("NO MATCH"), _verdict("MATCH"))
    assert (row["prediction"], row["parse_error"]) == (1, True)


def test_agents_see_what_their_tools_measure(spark):
    pairs = spark.createDataFrame([("1", "2"), ("1", "3")], "source_id string, target_id string")
    reply_of, syntactic, semantic = Reply, P.P.SYNTACTIC_INSTRUCTIONS, P.P.SEMANTIC_INSTRUCTIONS
    answer = _verdict("MATCH")

    class Reading:
        def complete(self, messages):
            told, question = (m["content"] for m in messages)
            if told == syntactic:
                assert all(f"  {name}: " in question for name in ("Edit distance", "Jaccard similarity", "BM25 relevance"))
            elif told == semantic:
                assert "Price comparison: {" in question and "Edit distance" not in question
            else:
                assert "Tool results" not in question
            return reply_of(answer, 1)

    rows = P.agent_answers(pairs, _goods(spark), _goods(spark), lambda: Reading()).collect()
    assert [(r["verdict"], r["parse_error"]) for r in rows] == [("MATCH", False)] * 2


def test_service_client_needs_a_key(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError):
        ServiceClient()


def _goods(spark):
    rows = [("1", "sony dvd", "d", "3"), ("2", "sony dvd player", "d", "nan"), ("3", "lamp", "d", "5")]
    return spark.createDataFrame(rows, "id string, name string, description string, price string")


def test_repeated_and_concurrent_batches_do_not_double(spark, tmp_path):
    goods = _goods(spark)
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("1", "3")], "source_id string, target_id string")
    path = str(tmp_path / "decisions")
    assert P.match_with_replay(P.single_answers, pairs, goods, goods, WordOverlapClient, path).count() == 3
    first = P.kept_decisions(spark, path)
    assert first.count() == 2
    # Another driver answers one of the keys otherwise, and a lost one is answered twice in a batch.
    late = first.filter("target_id = '3'").selectExpr("* EXCEPT (verdict)", "'MATCH' AS verdict")
    late.unionByName(late.withColumn("target_id", F.lit("4"))).write.parquet(path + "/batch=000000001-other")
    kept = {r["target_id"]: r["verdict"] for r in P.kept_decisions(spark, path).collect()}
    assert kept == {"2": "MATCH", "3": "NO MATCH", "4": "MATCH"} and P.kept_decisions(spark, path).count() == 3
    # The folder of runs is read as one table.
    P.match_with_replay(P.single_answers, pairs, goods, goods, WordOverlapClient, str(tmp_path / "many" / "run=0"))
    P.match_with_replay(P.single_answers, pairs, goods, goods, WordOverlapClient, str(tmp_path / "many" / "run=1"))
    runs = P.kept_decisions(spark, str(tmp_path / "many"), {"run": "int"})
    assert runs.groupBy("run").count().orderBy("run").collect() == [(0, 2), (1, 2)]


def _refuse():
    raise AssertionError("a kept decision must not be asked again")


@pytest.mark.parametrize("answers, expected", [(P.single_answers, 2), (P.agent_answers, 3)])
def test_second_run_asks_nothing(spark, tmp_path, answers, expected):
    goods = _goods(spark)
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("1", "9")], "source_id string, target_id string")
    path = str(tmp_path / "decisions")
    first = P.match_with_replay(answers, pairs, goods, goods, WordOverlapClient, path)
    verdicts = {r["target_id"]: r["verdict"] for r in first.collect()}
    assert len(verdicts) == expected and verdicts["2"] == "MATCH" and verdicts["3"] == "NO MATCH"
    known = pairs.filter("target_id <> '9'")
    again = P.match_with_replay(answers, known, goods, goods, _refuse, path)
    assert again.count() == 2


def test_kept_decisions_are_sorted_once(spark, tmp_path):
    path = str(tmp_path / "decisions")
    goods = _goods(spark)
    pairs = spark.createDataFrame([("1", "2"), ("1", "3")], "source_id string, target_id string")
    P.match_with_replay(P.single_answers, pairs, goods, goods, WordOverlapClient, path)
    plan = P.kept_decisions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan
    assert P.kept_decisions(spark, str(tmp_path / "none")).isEmpty()


def test_batches_are_named_by_their_keys_in_any_order(spark, tmp_path):
    def name(*keys):
        pairs = spark.createDataFrame(list(keys), "source_id string, target_id string")
        return P._next_batch(spark, str(tmp_path / "none"), pairs)

    first = name(("1", "2"), ("3", "4"))
    assert first.startswith("000000000-") and len(first) == 26
    assert first == name(("3", "4"), ("1", "2"))
    assert len({first, name(("1", "2")), name(("1", "4"), ("3", "2")), name(("2", "1"), ("3", "4")), name(("12", ""), ("3", "4"))}) == 5


def test_replay_makes_its_keys_once(spark):
    from pairwright.plans.matcher_queries import replayed_decisions

    frame = replayed_decisions(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_partkey" not in plan
    # The keys lie in buckets: only the kept decisions are shuffled.
    assert plan.count("Exchange hashpartitioning(source_id") == 1
