"""Every registered query against its oracle, on the smallest tables."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    frame = queries()[name](spark, SF)
    if name in oracle_sql():
        assert compare(frame, duck, oracle_sql()[name]) == ""
    else:
        assert frame.count() > 0


def test_decisions_compute_key_columns_before_keys_become_rows(spark):
    from pairwright.plans import standins as B

    plan = B.decisions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generated = [i for i, line in enumerate(plan) if "Generate explode" in line]
    cast = [i for i, line in enumerate(plan) if "AS source_id" in line]
    assert min(cast) > max(generated)


@pytest.mark.parametrize("name", ["match_metrics_one_run", "described_errors"])
def test_decision_keys_have_partitions_for_the_rows_of_the_table(spark, monkeypatch, name):
    from pairwright.plans import standins as B

    lines = B.table(spark, SF, "lineitem").count()
    wanted = queries()[name](spark, SF).collect()
    monkeypatch.setattr(B, "LINES_A_PART", lines // 9)
    frame = queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    keyed = [line for line in plan if "Exchange hashpartitioning(source_id" in line and "target_id" in line]
    # Grouping and joining by the keys needs no exchange beyond that of the lines.
    assert keyed and all(", 10), REPARTITION_BY_NUM" in line for line in keyed)
    assert sorted(map(repr, frame.collect())) == sorted(map(repr, wanted))
