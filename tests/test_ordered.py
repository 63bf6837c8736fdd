"""Segmented running operators against a plain pass, with few segments."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.operators.ordered import block_labels, fill_down, in_segments, row_numbers, running_totals, value_before

SEGMENTS = st.sampled_from([1, 2, 5, None])
QUICK = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
tables = st.lists(
    st.tuples(
        st.integers(-2000, 2000), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 9))
    ),
    min_size=1,
    max_size=60,
    unique_by=lambda row: row[0],
)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k BIGINT, g STRING, v BIGINT")


def _expected(rows, by_group, step):
    state, out = {}, {}
    for k, g, v in sorted(rows):
        key = g if by_group else 0
        state[key] = step(state.get(key), v)
        out[k] = state[key]
    return out


@QUICK
@given(rows=tables, by_group=st.booleans(), segments=SEGMENTS)
def test_fill_down(spark, rows, by_group, segments):
    filled = fill_down(
        _frame(spark, rows), "k", "v", by=["g"] if by_group else [], segments=segments
    )
    expected = _expected(rows, by_group, lambda last, v: last if v is None else v)
    assert {r.k: r.v for r in filled.collect()} == expected
    assert filled.columns == ["k", "g", "v"]


@QUICK
@given(rows=tables, by_group=st.booleans(), segments=SEGMENTS)
def test_row_numbers(spark, rows, by_group, segments):
    numbered = row_numbers(
        _frame(spark, rows), "k", by=["g"] if by_group else [], segments=segments
    )
    assert {r.k: r.row_number for r in numbered.collect()} == _expected(
        rows, by_group, lambda n, _: (n or 0) + 1
    )


@QUICK
@given(rows=tables, segments=SEGMENTS)
def test_running_totals(spark, rows, segments):
    totals = running_totals(_frame(spark, rows), "k", ["v"], segments=segments)
    assert {r.k: r.run_v for r in totals.collect()} == _expected(
        rows, False, lambda s, v: (s or 0) + (v or 0)
    )


def test_full_range_of_keys(spark):
    keys = [-(2**63), -1, 0, 1, 2**20, 2**42, 2**63 - 1]
    numbered = row_numbers(spark.createDataFrame([(k,) for k in keys], "k BIGINT"), "k")
    assert [r.row_number for r in sorted(numbered.collect())] == [1, 2, 3, 4, 5, 6, 7]


def test_order_by_two_columns_with_ties_and_gaps(spark):
    rows = [(t, i, v) for i, (t, v) in enumerate([(3, 1), (1, None), (3, None), (None, 7), (1, 2), (None, None), (2, None)] * 5)]
    df = spark.createDataFrame(rows, "t INT, i BIGINT, v INT")
    expected, last = {}, None
    for t, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        last = expected[i] = last if v is None else v
    for segments in (1, 3, None):
        assert {r.i: r.v for r in fill_down(df, ("t", "i"), "v", segments=segments).collect()} == expected


def _rows_by_task(df, stage):
    """How many rows each task of a window over the rows holds."""
    return sorted(r[0] for r in df.groupBy(stage).count().select("count").collect())


def test_rows_are_spread_over_tasks(spark):
    """A table without groups, and one group of all rows with its keys far apart, are many tasks each."""
    for step in (1, 10**12):
        df = spark.range(10_000).select((F.col("id") * step).alias("k"), F.lit("a").alias("g"))
        for by in ([], ["g"]):
            held = _rows_by_task(in_segments(df, by, ["k"], 8), "_segment")
            assert len(held) == 8 and max(held) < 2 * 10_000 / 8
            numbered = row_numbers(df, "k", by, segments=8)
            assert numbered.where(F.col("row_number") != F.col("k") / step + 1).isEmpty()


def test_only_segment_totals_meet_in_one_task(spark, plan_text):
    df = spark.range(1000).withColumnRenamed("id", "k")
    plan = plan_text(row_numbers(df, "k"))
    lines = plan.splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line]
    # The totals of segments, and the bounded sample.
    assert below and all("HashAggregate(keys=[_segment" in x or "partial_collect_list" in x or "Limit" in x for x in below), below
    assert "hashpartitioning(_segment" in plan


@pytest.mark.parametrize("blocks, expected", [(None, [1, 1, 2, 2, 3, 3]), (2, [1, 1, 2, 2, 1, 1])])
def test_block_labels(spark, blocks, expected):
    df = spark.range(1, 7).withColumnRenamed("id", "n")
    labelled = block_labels(df, "n", 2, "block", blocks)
    assert [r.block for r in labelled.orderBy("n").collect()] == expected


def test_a_popular_leading_value_is_cut_by_the_next_column(spark):
    """Text keys, a third of the rows with one leading value and some without any."""
    name = F.when(F.col("id") % 3 == 0, "popular").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("n"), F.col("id") % 997))
    df = spark.range(30_000).select(name.alias("name"), F.concat(F.lit("id"), "id").alias("key"), "id")
    held = _rows_by_task(in_segments(df, [], ["name", "key"], 8), "_segment")
    assert len(held) == 8 and max(held) < 2 * 30_000 / 8
    rows = sorted(df.collect(), key=lambda r: (r.name is not None, r.name or "", r.key))
    expected = {r.id: i for i, r in enumerate(rows, 1)}
    assert {r.id: r.row_number for r in row_numbers(df, ("name", "key"), segments=8).collect()} == expected


def test_value_before(spark):
    df = spark.createDataFrame([(1, None), (3, 5), (4, None), (7, 2), (9, 1)], "k INT, v INT")
    for segments in (1, 3, None):
        assert {r.k: r.before for r in value_before(df, "k", "v", segments=segments).collect()} == {1: None, 3: None, 4: 5, 7: 5, 9: 2}


def test_sample_of_another_table(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("v", F.col("k") % 5)
    totals = running_totals(df, "k", ["v"], segments=6, sample=df.where("k % 3 = 0").select("k"))
    assert totals.where("run_v <> (k div 5) * 10 + (k % 5) * (k % 5 + 1) / 2").isEmpty()
