import math
from collections import Counter

import pytest

from pairwright.operators import blocking as K


def _grams(name):
    text = name.lower()
    return Counter(text[i : i + n] for n in (2, 3) for i in range(len(text) - n + 1))


def _brute_force(sources, targets, threshold):
    names = [n for _, n in sources + targets]
    df = Counter(g for n in names for g in _grams(n))  # set semantics below
    df = Counter()
    for n in names:
        df.update(set(_grams(n)))

    def vector(name):
        raw = {g: c * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g, c in _grams(name).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {g: v / norm for g, v in raw.items()} if norm else {}

    out = {}
    for s, a in sources:
        va = vector(a)
        for t, b in targets:
            vb = vector(b)
            sim = sum(w * vb.get(g, 0.0) for g, w in va.items())
            if sim >= threshold:
                out[(s, t)] = sim
    return out


def _names():
    brands = ["sony", "samsung", "apple", "lg"]
    kinds = ["turntable pslx350h", "galaxy s21", "iphone 12 pro", "monitor 27inch", "turntable", "x", ""]
    rows = [f"{b} {k}" if k else "" for b in brands for k in kinds]
    return rows + ["sony turntable pslx350h"] * 6


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5, 0.9])
def test_equals_brute_force(spark, threshold):
    names = _names()
    sources = [(f"s{i}", n) for i, n in enumerate(names)]
    targets = [(f"t{i}", n) for i, n in enumerate(reversed(names)) if i % 3]
    expected = _brute_force(sources, targets, threshold)
    frames = [spark.createDataFrame(r, "id string, name string") for r in (sources, targets)]
    rows = K.candidate_pairs(*frames, threshold).collect()
    got = {(r["source_id"], r["target_id"]): r["similarity_score"] for r in rows}
    assert len(rows) == len(got)
    assert set(got) == set(expected)
    for key, value in expected.items():
        assert got[key] == pytest.approx(value)


def test_short_suffixes_and_salts_change_nothing(spark, monkeypatch):
    names = _names()
    sources = [(f"s{i}", n) for i, n in enumerate(names)]
    frames = [spark.createDataFrame(sources, "id string, name string")] * 2
    expected = _brute_force(sources, sources, 0.2)
    monkeypatch.setattr(K, "_SUFFIX_GRAMS", 3)
    monkeypatch.setattr(K, "_PRODUCTS_PER_SALT", 8)
    rows = K.candidate_pairs(*frames, 0.2).collect()
    assert {(r["source_id"], r["target_id"]) for r in rows} == set(expected)
    assert len(rows) == len(expected)


def test_summary_and_recall_without_expansion(spark):
    names = _names()
    left = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(names)], "id string, name string")
    right = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(names)], "id string, name string")
    similar = K.similar_names(left, right)
    summary = K.blocking_summary(similar).first()
    pairs = K.candidate_pairs(left, right)
    assert summary["n_pairs"] == pairs.count()
    truth = spark.createDataFrame([("s0", "t0"), ("s6", "t6")], "source_id string, target_id string")
    recall = K.blocking_recall(similar, left, right, truth).first()
    assert (recall["found"], recall["true_matches"]) == (1, 2)  # an empty name matches nothing


def test_classes_hold_every_pair_without_expanding_copies(spark):
    names = _names()
    left = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(names * 5)], "id string, name string")
    right = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(names * 5)], "id string, name string")
    rows = K.candidate_classes(left, right).collect()
    of = {side: {} for side in ("source", "target")}
    for row in rows:
        if row["kind"] != "pair":
            of[row["kind"]].setdefault(row["left_id"], []).append(row["right_id"])
    links = [row for row in rows if row["kind"] == "pair"]
    expanded = sorted(
        (s, t, round(link["similarity_score"], 9))
        for link in links for s in of["source"][link["left_id"]] for t in of["target"][link["right_id"]]
    )
    asked = K.candidate_pairs(left, right).collect()
    assert expanded == sorted((r["source_id"], r["target_id"], round(r["similarity_score"], 9)) for r in asked)
    distinct = len(set(names))
    assert len(rows) <= 2 * 5 * len(names) + distinct * distinct < len(expanded)


def test_query_gives_every_pair_of_ids(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    goods = ["tv black", "tv white", "lamp", "radio set", "tv black"]
    rows = [(i, f"Brand#{i % 2}", goods[i % 5], 10 if i % 3 else 30) for i in range(40)] + [(39, "Brand#1", "lamp", 30)]
    parts = spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_name string, p_size int")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    shops = [[(str(k), f"{b} {n}") for k, b, n, size in rows if (size <= 25) == first] for first in (True, False)]
    names = [[n for _, n in shop] for shop in shops]
    expected = _brute_force(*[[(n, n) for n in found] for found in names], 0.2)
    wanted = sorted(
        (s, t, round(expected[a, b], 6)) for s, a in shops[0] for t, b in shops[1] if (a, b) in expected
    )
    got = queries()["blocking_candidates"](spark, str(tmp_path))
    assert got.columns == ["source_id", "target_id", "similarity_score"]
    assert sorted(map(tuple, got.collect())) == wanted
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert sorted(duck.execute(oracle_sql()["blocking_candidates"]).fetchall()) == wanted


def test_zero_threshold_is_rejected(spark):
    frame = spark.createDataFrame([("a", "b")], "id string, name string")
    with pytest.raises(ValueError):
        K.similar_names(frame, frame, 0.0)
