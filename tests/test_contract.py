"""Every registered query against its DuckDB twin, and the plans all of them must have."""

import pytest
from oracle_check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from workload.oracle import ORACLE
from workload.queries import REGISTRY

NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_names_match():
    assert set(ORACLE) == set(REGISTRY)
    assert set(oracle_sql()) <= set(queries()) and set(REGISTRY) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    assert differences(df, duck, oracle_sql()[name]) == []


def test_comparison_notices_a_changed_value(spark, sf_dir, duck):
    df = queries()["size_distribution"](spark, sf_dir)
    wrong = oracle_sql()["size_distribution"].replace("count(*) AS n", "count(*) + (hh_size = 3)::INT AS n")
    assert differences(df, duck, wrong)


@pytest.mark.parametrize("name", NAMES)
def test_no_all_pairs_join(spark, sf_dir, plan_text, name):
    plan = plan_text(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["hh_size", "pattern", "n", "p"]
    assert df.limit(1).count() == 1
