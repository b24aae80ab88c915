import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from pairwright.functions.verdict import dollars, parse_verdict, shortened
from pairwright.operators.lookup import (
    attach_products,
    attach_products_or_flag,
    label_lookup,
    product_lookup,
    take_pairs,
)
from pairwright.operators.taxonomy import with_error_categories
from pairwright.sources import cache as C
from pairwright.sources import tables as S
from pairwright.sources import timings as W

REPLIES = [
    ('{"verdict": "MATCH", "confidence": 0.9, "reasoning": "same"}', ("MATCH", 0.9, "same", False)),
    ('```json\n{"verdict": "no match", "confidence": "0.25"}\n```', ("NO MATCH", 0.25, "", False)),
    ('Sure: {"verdict": " Match ", "confidence": 7} ok', ("MATCH", 1.0, "", False)),
    ('{"verdict": "MATCH", "confidence": -2}', ("MATCH", 0.0, "", False)),
    ('{"verdict": "MATCH", "confidence": "95%"}', ("MATCH", 0.0, "", False)),
    ('{"verdict": "MATCH", "confidence": true}', ("MATCH", 1.0, "", False)),
    ('{"verdict": "MATCH", "confidence": null, "reasoning": null}', ("MATCH", 0.0, "None", False)),
    ('{"confidence": 0.4}', ("NO MATCH", 0.4, "", False)),
    ('{"verdict": null}', ("NO MATCH", 0.0, "parse error", True)),
    ('{"verdict": "MAYBE", "confidence": 0.4}', ("NO MATCH", 0.0, "parse error", True)),
    ("not json at all", ("NO MATCH", 0.0, "parse error", True)),
    ("[1]", ("NO MATCH", 0.0, "parse error", True)),
    ("", ("NO MATCH", 0.0, "parse error", True)),
    ("  \n", ("NO MATCH", 0.0, "parse error", True)),
    (None, ("NO MATCH", 0.0, "parse error", True)),
]


def test_replies_in_tables(spark):
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    rows = frame.select("i", parse_verdict(F.col("reply")).alias("p")).orderBy("i").collect()
    for row, (reply, expected) in zip(rows, REPLIES):
        assert tuple(row["p"]) == expected, reply


def test_display_helpers(spark):
    frame = spark.createDataFrame([("a\nb" * 60, "12.5"), ("short\r", None), ("x", "call us")], "t string, p string")
    rows = frame.select(shortened(F.col("t"), 10).alias("t"), dollars(F.col("p")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("a ba ba ba" + "...", "$12.50"), ("short", "N/A"), ("x", "call us")]


def _write(directory, name, drop=(), tokens=100, **fields):
    prediction = {"source_id": "1", "target_id": "2", "verdict": "MATCH", "confidence": 0.9, "parse_error": False}
    prediction.update(fields)
    for field in drop:
        prediction.pop(field)
    body = {"prediction": prediction}
    if tokens is not None:
        body["tokens"] = tokens
    (directory / name).write_text(json.dumps(body))


@pytest.mark.parametrize(
    "change, needle",
    [
        ({"verdict": "MAYBE"}, "malformed verdict 'MAYBE'"),
        ({"verdict": "match"}, "malformed verdict"),
        ({"drop": ("source_id",)}, "missing source_id"),
        ({"drop": ("verdict",)}, "missing verdict"),
        ({"tokens": None}, "missing tokens"),
        ({"tokens": -1}, "malformed tokens"),
        ({"tokens": True}, "malformed tokens"),
        ({"tokens": 1.5}, "malformed tokens"),
        ({"confidence": "high"}, "malformed confidence"),
        ({"prediction": 0}, "mirror contradicts verdict"),
    ],
)
def test_defects_are_rejected_with_the_file(spark, tmp_path, change, needle):
    _write(tmp_path, "1_2.json", **change)
    with pytest.raises(C.CacheValidationError) as error:
        C.read_strict(spark, str(tmp_path))
    assert needle in str(error.value) and "1_2.json" in str(error.value)


def test_duplicates_bad_json_and_empty_directories(spark, tmp_path):
    for name in ("dup", "bad", "none", "list"):
        (tmp_path / name).mkdir()
    _write(tmp_path / "dup", "1_2.json")
    _write(tmp_path / "dup", "1_2_again.json")
    (tmp_path / "bad" / "broken.json").write_text("{not json")
    (tmp_path / "list" / "list.json").write_text('{"prediction": [1], "tokens": 1}')
    for name, needles in {
        "dup": ("duplicate key", "1_2.json", "1_2_again.json", "('1', '2')"),
        "bad": ("invalid json", "broken.json"),
        "none": ("no records",),
        "list": ("not an object",),
    }.items():
        with pytest.raises(C.CacheValidationError) as error:
            C.read_strict(spark, str(tmp_path / name))
        assert all(n in str(error.value) for n in needles)


def test_valid_records_and_key_check(spark, tmp_path):
    _write(tmp_path, "1_2.json", tokens=590)
    _write(tmp_path, "3_4.json", source_id="3", target_id="4", verdict="NO MATCH", confidence=None, prediction=0)
    records = C.read_strict(spark, str(tmp_path))
    rows = {(r["source_id"], r["target_id"]): r for r in records.collect()}
    assert rows[("1", "2")]["tokens"] == 590 and rows[("3", "4")]["confidence"] is None
    labels = spark.createDataFrame([("1", "2", 1), ("3", "4", 0)], "source_id string, target_id string, label int")
    C.validate_keys(records, labels)
    more = labels.union(spark.createDataFrame([("5", "6", 0)], labels.schema)).filter("source_id <> '1'")
    with pytest.raises(C.CacheValidationError, match="1 extra key.*1 missing key|1 missing key.*1 extra key"):
        C.validate_keys(records, more)
    with pytest.raises(C.CacheValidationError, match="duplicate key"):
        C.unique_labels(labels.union(labels))
    lenient = C.lenient_records(C.read_documents(spark, str(tmp_path))).orderBy("source_id").collect()
    assert [r["confidence"] for r in lenient] == [0.9, 0.0] and lenient[0]["sem_verdict"] == "NO MATCH"


def test_several_caches_are_checked_in_one_pass(spark):
    body = json.dumps({"prediction": {"source_id": "1", "target_id": "2", "verdict": "MATCH"}, "tokens": 3})
    rows = [("a", 0, "x.json", body), ("a", 1, "x.json", body), ("b", 0, "y.json", body), ("b", 0, "z.json", body), ("b", 1, "w.json", "{")]
    documents = spark.createDataFrame(rows, "pipeline string, run int, file string, body string")
    found = {tuple(r) for r in C.violations(documents, ("pipeline", "run")).collect()}
    assert found == {("b", 0, "y.json, z.json", "duplicate key", "('1', '2')"), ("b", 1, "w.json", "invalid json", "")}
    sound = C.strict_records(documents, ("pipeline", "run")).select("pipeline", "run", "file").collect()
    assert sorted(map(tuple, sound)) == [(*r[:3],) for r in rows[:4]]


def test_digest_does_not_depend_on_the_partitions(spark):
    labels = spark.createDataFrame([("b", "1", 0), ("a", "2", 1), ("a", "10", 0)], "source_id string, target_id string, label int")
    tree = C.multiset_digest(labels, C.label_line()).first()["digest"]
    assert tree == C.multiset_digest(labels.repartition(3), C.label_line()).first()["digest"]


def test_products_pairs_and_candidates(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,name,description,price\n1,"a ""b"", c","two\nlines",9.5\n2,x,,\n3,,y,$4\n')
    rows = S.read_products(spark, str(tmp_path / "p.csv")).orderBy("id").collect()
    assert tuple(rows[0]) == ("1", 'a "b", c', "two\nlines", "9.5", 9.5)
    assert tuple(rows[1]) == ("2", "x", "", "nan", None)
    assert tuple(rows[2]) == ("3", "", "y", "$4", None)
    (tmp_path / "q.csv").write_text("ltable_id,rtable_id,label\n1,2,1\n")
    assert tuple(S.read_pairs(spark, str(tmp_path / "q.csv")).first()) == ("1", "2", 1)
    pairs = spark.createDataFrame([("007", "8", 0.25)], "source_id string, target_id string, similarity_score double")
    for kind in ("parquet", "csv"):
        S.save_candidates(pairs, str(tmp_path / kind), kind)
        assert S.load_candidates(spark, str(tmp_path / kind), kind).collect() == pairs.collect()


def test_records_over_many_splits_are_those_of_a_sequential_reader(spark, tmp_path):
    rng = random.Random(7)
    marks = ['"', ",", "\n", "\r\n", "a", "", " b", "\n\n"]
    rows = {}
    for name, count in (("a.csv", 400), ("b.csv", 30), ("c.csv", 0)):
        mine = [(f"{name}{i}", *("x" + "".join(rng.choices(marks, k=rng.randint(0, 40))) + "y" for _ in range(2)), "1.5") for i in range(count)]
        with open(tmp_path / name, "w", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows([("id", "name", "description", "price"), *mine])
        rows.update({r[0]: r for r in mine})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        read = [tuple(r)[:4] for r in S.read_products(spark, str(tmp_path)).collect()]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(read) == len(rows) and {r[0]: r for r in read} == rows
    (tmp_path / "c.csv").write_text('id,name,description,price\n1,5" disk,,\n')
    with pytest.raises(ValueError, match="c.csv: quotes are not paired"):
        S.read_products(spark, str(tmp_path))


def test_parameters_round_trip(spark, tmp_path):
    assert S.load_parameters(spark, str(tmp_path / "absent")) == (None, 0.5)
    S.save_parameters(spark, {"best_params": {"max_depth": None}, "best_threshold": 0.35}, str(tmp_path / "p"))
    assert S.load_parameters(spark, str(tmp_path / "p")) == ({"max_depth": None}, 0.35)


def test_lookups_keep_the_last_row(spark):
    rows = [(1, "1", "old", "", "1"), (2, "1", "new", "", "2")]
    goods = spark.createDataFrame(rows, "no int, id string, name string, description string, price string")
    assert product_lookup(goods, F.col("no")).first()["name"] == "new"
    labels = spark.createDataFrame([(1, "a", "b", 0), (2, "a", "b", 1)], "no int, ltable_id string, rtable_id string, label int")
    assert label_lookup(labels, F.col("no")).first()["label"] == 1


def test_missing_products_and_limits(spark):
    goods = spark.createDataFrame([("1", "n", "d", "3")], "id string, name string, description string, price string")
    pairs = spark.createDataFrame([("1", "1"), ("1", "9")], "source_id string, target_id string")
    assert attach_products(pairs, goods, goods).count() == 1
    flags = {r["target_id"]: r["missing_product"] for r in attach_products_or_flag(pairs, goods, goods).collect()}
    assert flags == {"1": False, "9": True}
    keys = ["source_id", "target_id"]
    assert [take_pairs(pairs, n, keys).count() for n in (None, 0, 1)] == [2, 2, 1]


def test_timing_line_without_duration_raises(spark):
    lines = spark.createDataFrame([("- Magellan run 1/5 done",)], "value string")
    with pytest.raises(Exception, match="no parseable duration"):
        W.parse_timing_lines(lines).collect()


ERRORS = [
    (("tv black", "tv white", "", "", None, None, ""), "color variant"),
    (("slim desktop", "laptop", "", "", None, None, ""), "form factor"),
    (("camera", "camera case", "", "", None, None, ""), "accessory confusion"),
    (("dsc-w120 x", "dsc-w130 x", "", "", None, None, ""), "model variant"),
    (("tv w12 x", "tv w13 x", "", "", None, None, ""), "other"),
    (("sony w1200 x", "sony w1250 x", "", "", None, None, ""), "model variant"),
    (("lamp", "universal lamp", "", "", None, None, ""), "generic vs specific"),
    (("lamp", "lamp", "", "", None, None, "Different suffix"), "model variant"),
    (("lamp", "lamp", "", "", None, None, "hm"), "other"),
]
MISSES = [
    (("a", "b", "short", "long enough text", None, None, ""), "sparse description"),
    (("a", "b", "long enough text", "long enough text", "10", "20", "The price differs"), "price mismatch"),
    (("lg w-100 tv", "lg w100 tv", "long enough text", "long enough text", "10", "nan", "hm"), "model number format"),
    (("a b c d", "e f g a", "long enough text", "long enough text", None, None, "cheap"), "name mismatch"),
    (("a b", "a b", "long enough text", "long enough text", None, None, "too cheap"), "price mismatch"),
    (("a b", "a b", "long enough text", "long enough text", "nan", "nan", "hm"), "other"),
]


@pytest.mark.parametrize("column, cases", [("fp_category", ERRORS), ("fn_category", MISSES)])
def test_error_categories(spark, column, cases):
    schema = (
        "i int, source_name string, target_name string, source_description string, target_description string, "
        "source_price string, target_price string, reasoning string"
    )
    frame = spark.createDataFrame([(i, *values) for i, (values, _) in enumerate(cases)], schema)
    rows = with_error_categories(frame).orderBy("i").collect()
    assert [r[column] for r in rows] == [expected for _, expected in cases]


def test_first_pairs_are_those_of_a_sequential_reader(spark, tmp_path):
    lines = {"a.csv": 3000, "b.csv": 500}
    for name, n in lines.items():
        rows = "".join(f"{name[0]}{n - i},t{i},1\n" for i in range(n))
        (tmp_path / name).write_text("ltable_id,rtable_id,label\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        pairs = S.read_pairs(spark, str(tmp_path), position=True)
        assert pairs.rdd.getNumPartitions() > 4
        for n in (1, 2, 2999, 3001, 3400, 9999):
            taken = take_pairs(pairs, n, ["ltable_id"]).select("ltable_id").collect()
            expected = [f"a{3000 - i}" for i in range(3000)] + [f"b{500 - i}" for i in range(500)]
            assert sorted(r[0] for r in taken) == sorted(expected[:n])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unreadable_parameters_are_not_missing_ones(spark, tmp_path):
    (tmp_path / "p").write_text("{}")
    with pytest.raises(KeyError):
        S.load_parameters(spark, str(tmp_path / "p"))


def test_strict_reading_looks_fields_up_together(spark):
    bodies = [
        '{"prediction": {"source_id": "1", "target_id": "2", "verdict": "MATCH", "confidence": 0.25, "parse_error": true}, "tokens": 7}',
        '{"prediction": {"source_id": null, "target_id": 3, "verdict": "NO MATCH", "confidence": null, "prediction": false}, "tokens": 0}',
        '{"prediction": {"source_id": "1", "target_id": "2", "verdict": ["MATCH"]}, "tokens": 7}',
        '{"prediction": {"source_id": "1", "target_id": "2", "verdict": null}, "tokens": 7}',
        '{"prediction": {"source_id": "1", "target_id": "2", "verdict": "MATCH", "confidence": "0.5"}, "tokens": 7}',
        '{"prediction": {"source_id": "1", "target_id": "2", "verdict": "MATCH", "confidence": true}, "tokens": 7.5}',
        '{"prediction": [], "tokens": 7}', '{"prediction": null}', '[]', 'null', None,
        '{"prediction": {"source_id": "1", "target_id": "4", "verdict": "MATCH", "prediction": 0}, "tokens": 7}',
        '{"prediction": {"source_id": "1", "verdict": "MATCH"}, "tokens": 7}',
    ]
    documents = spark.createDataFrame([(f"{i:02}", b) for i, b in enumerate(bodies)], "file string, body string")
    records = C.strict_records(documents)
    assert [tuple(r) for r in records.orderBy("file").collect()] == [
        ("00", "1", "2", "MATCH", 0.25, True, 7), ("01", "None", "3", "NO MATCH", None, False, 0),
    ]
    found = {r["file"]: (r["rule"], r["value"]) for r in C.violations(documents).collect()}
    assert found == {
        "02": ("malformed verdict", '["MATCH"]'), "03": ("malformed verdict", ""), "04": ("malformed confidence", "MATCH"),
        "05": ("malformed tokens", "MATCH"), "06": ("prediction is not an object", ""), "07": ("prediction is not an object", ""),
        "08": ("missing prediction", ""), "09": ("missing prediction", ""), "10": ("invalid json", ""),
        "11": ("mirror contradicts verdict", "MATCH"), "12": ("missing target_id", "MATCH"),
    }
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("variant_get(") for line in plan.splitlines() if "Generate" in line) <= 5
    twice = C.violations(documents.union(documents)).groupBy("file", "rule").count()
    assert {(r["file"], r["rule"], r["count"]) for r in twice.collect()} == {
        (f, rule, 2) for f, (rule, _) in found.items()
    } | {("00, 00", "duplicate key", 1), ("01, 01", "duplicate key", 1)}
    plan = C.violations(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json(") <= 2


def test_digest_takes_in_every_bit_of_every_line(spark):
    import hashlib

    rows = [("a", 1, "x"), ("a", None, "y"), ("a", 1, "x"), ("b", 2, None), ("b", 2, "é"), ("a", 1, "z")]
    frame = spark.createDataFrame(rows, "p string, run int, line string").repartition(3)

    def expected(lines):
        hashes = [hashlib.sha256(x.encode()).hexdigest() if x is not None else "0" * 64 for x in lines]
        sums = [sum(int(h[8 * k : 8 * k + 8], 16) for h in hashes) for k in range(8)]
        return hashlib.sha256("|".join(map(str, [len(lines), *sums])).encode()).hexdigest()

    got = {(r["p"], r["run"]): r["digest"] for r in C.multiset_digest(frame, F.col("line"), ["p", "run"]).collect()}
    assert got == {k: expected([x for p, r, x in rows if (p, r) == k]) for k in {(p, r) for p, r, _ in rows}}
    assert C.multiset_digest(frame, F.col("line")).first()["digest"] == expected([x for *_, x in rows])
    assert C.multiset_digest(frame.filter("false"), F.col("line")).first()["digest"] == expected([])


def test_lenient_reading_does_not_interpret_what_makes_the_body(spark):
    made = spark.range(3).select(
        F.col("id").cast("string").alias("file"), F.concat(F.lit('{"tokens":'), F.col("id").cast("string"), F.lit("}")).alias("body")
    )
    read = C.lenient_records(made)
    assert sorted(r["tokens"] for r in read.collect()) == [0, 1, 2]
    plan = read._jdf.queryExecution().executedPlan().toString()
    parsing = [line for line in plan.splitlines() if "from_json(" in line]
    assert parsing and not any("concat(" in line for line in parsing)


def test_documents_of_decisions_are_what_to_json_writes(spark):
    from pairwright.plans.source_queries import agent_body
    from pairwright.plans.standins import key_decisions

    rows = key_decisions(spark.range(200).selectExpr("id * 7 AS p", "id % 9 AS s", "CAST(id % 2 AS INT) AS label"))
    agent = F.struct(F.col("syn_verdict").alias("verdict"), F.col("syn_confidence").alias("confidence"))
    prediction = F.struct("source_id", "target_id", "verdict", "confidence", "parse_error", agent.alias("syntactic"))
    wanted = F.to_json(F.struct(prediction.alias("prediction"), "tokens"))
    assert rows.count() == 2000 and rows.filter(~agent_body().eqNullSafe(wanted)).isEmpty()


def test_documents_as_they_are_kept_are_not_parsed(spark):
    kept = '{"prediction": {"source_id": "1", "target_id": "é 2", "verdict": "MATCH", "confidence": 0.97, "reasoning": "a \\"b\\": c,", "parse_error": true}, "tokens": 642}'
    tight = '{"prediction":{"source_id":"1","target_id":"2","verdict":"NO MATCH","confidence":null},"tokens":0}'
    sound = {
        kept: ("1", "é 2", "MATCH", 0.97, True, 642),
        tight: ("1", "2", "NO MATCH", None, False, 0),
        tight.replace('"2"', '""').replace("null", "12345678.25"): ("1", "", "NO MATCH", 12345678.25, False, 0),
        "\n " + json.dumps(json.loads(kept), indent=2) + "\t": ("1", "é 2", "MATCH", 0.97, True, 642),
        json.dumps(json.loads(kept), sort_keys=True): ("1", "é 2", "MATCH", 0.97, True, 642),
        tight.replace('"1"', '"\\u0041"').replace("null", "-0.0"): ("A", "2", "NO MATCH", 0.0, False, 0),
        kept.replace("c,", "\\n" * 5000): ("1", "é 2", "MATCH", 0.97, True, 642),
    }
    broken = {
        tight.replace('"tokens":0', '"tokens":0,"tokens":0'): "invalid json", tight.replace('"2"', '"2\t"'): "invalid json",
        tight.replace('"source_id"', '"target_id":"2","source_id"'): "invalid json", tight[:-1]: "invalid json",
        "\x1e\x1f1\x1f2\x1fMATCH\x1f\x1f\x1f3": "invalid json", "\x1e" + tight: "invalid json", tight.replace("null", "01"): "invalid json",
        tight.replace('"tokens":0', '"tokens":-1'): "malformed tokens", tight.replace('"tokens":0', '"tokens":9223372036854775808'): "malformed tokens",
        tight.replace("NO MATCH", "NO  MATCH"): "malformed verdict", tight.replace("}", ',"prediction":1}', 1): "mirror contradicts verdict",
    }
    documents = spark.createDataFrame([(f"{i:02}", b) for i, b in enumerate([*sound, *broken])], "file string, body string")
    records = C.strict_records(documents)
    assert [tuple(r)[1:] for r in records.orderBy("file").collect()] == list(sound.values())
    rules = {r["file"]: r["rule"] for r in C.violations(documents).filter("rule <> 'duplicate key'").collect()}
    assert [rules[f] for f in sorted(rules)] == list(broken.values())
    plan = records._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsing = [line for line in plan if "parseJson(" in line]
    assert len(parsing) == 1 and "CASE WHEN NOT plain" in parsing[0]


def test_cache_documents_are_joined_from_their_parts(spark, tmp_path):
    from pairwright.plans import source_queries as Q

    lines = [(p, s, q) for p in (None, *range(1, 60)) for s in (None, 3, 8) for q in (None, 50.0)]
    frame = spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint, l_quantity double")
    frame.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = Q._all_decisions(spark, str(tmp_path))
    defect = F.expr("(CAST(source_id AS BIGINT) * 7 + CAST(target_id AS BIGINT) * 13 + run * 3) % 100")
    prediction = F.struct(
        F.when(defect != 2, F.col("source_id")).alias("source_id"), "target_id",
        F.when(defect == 1, "MAYBE").otherwise(F.col("verdict")).alias("verdict"), F.when(defect == 5, "high").alias("_text"),
        F.when(defect != 5, F.col("confidence")).alias("confidence"), "parse_error",
        F.when(defect == 6, F.when(F.col("verdict") == "MATCH", 0).otherwise(1)).alias("prediction"),
    )
    tokens = F.when(defect == 4, -5).when(defect != 3, F.col("tokens")).alias("tokens")
    body = F.replace(F.to_json(F.struct(prediction.alias("prediction"), tokens)), F.lit('"_text"'), F.lit('"confidence"'))
    body = F.when(defect == 0, "{not json").otherwise(body)
    wanted = rows.select("pipeline", "run", body.alias("body"), F.when(defect == 7, 2).otherwise(1).alias("n")).collect()
    documents = Q._documents(spark, str(tmp_path))
    got = [(r["pipeline"], r["run"], r["body"]) for r in documents.collect()]
    assert sorted(got) == sorted((r["pipeline"], r["run"], r["body"]) for r in wanted for _ in range(r["n"]))
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert len({r["n"] for r in wanted}) == 2 and "json" not in plan.replace(".json", "").replace("{not json", "").lower()


def test_defects_are_shuffled_and_sorted_once(spark):
    sound = '{"prediction":{"source_id":"%s","target_id":"2","verdict":"MATCH"},"tokens":0}'
    rows = [(i % 2, f"{i:03}.json", sound % (i % 60)) for i in range(70)] + [(0, None, "{")] * 3 + [(None, "a", sound % 1), (None, "b", sound % 1)]
    documents = spark.createDataFrame(rows, "run int, file string, body string").repartition(5)
    found = C.violations(documents, ("run",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("- Sort [") == plan.count("- Sort [placed") == 1
    assert plan.index("- Sort [placed") < plan.index("Exchange hashpartitioning(placed")
    wanted = [(0, None, "invalid json", "")] * 3 + [(None, "a, b", "duplicate key", "('1', '2')")] + [
        (i % 2, f"{i:03}.json, {i + 60:03}.json", "duplicate key", f"('{i}', '2')") for i in range(10)
    ]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
    parted = C.violations(documents, ("run",), 7)
    assert ", 7), REPARTITION_BY_NUM" in parted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, map(tuple, parted.collect()))) == sorted(map(repr, wanted))
