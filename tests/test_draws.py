import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.uniform import uniform
from tallyloom.operators import draws, relatives

DIST = "g STRING, code INT, n BIGINT"


def _rows(spark, n, groups=("a", "b")):
    g = F.element_at(F.array(*[F.lit(x) for x in groups]), (F.col("id") % len(groups) + 1).cast("int"))
    return spark.range(n).select("id", g.alias("g"))


def _conditional(spark, rows, dist, **options):
    df = spark.createDataFrame(dist, DIST)
    return draws.draw(rows, df, "code", "n", uniform("id", salt="t"), keys=["g"], **options)


def _reference(dist, key, u):
    weights = sorted((c, n) for g, c, n in dist if g == key and n > 0)
    at, upto = u * sum(n for _, n in weights), 0
    for code, n in weights:
        upto += n
        if at < upto:
            return code
    return None


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("cells", [1, 7, 64, 1000])
def test_agrees_with_the_plain_inverse(spark, small, cells):
    """Uneven weights, a zero weight, a key with one outcome, a key without any."""
    dist = [("a", 1, 3), ("a", 2, 0), ("a", 3, 997), ("a", 4, 10**9), ("b", 9, 5)]
    rows = _rows(spark, 600, ("a", "b", "none"))
    drawn = _conditional(spark, rows, dist, small=small, cells=cells).withColumn("u", uniform("id", salt="t"))
    got = drawn.collect()
    assert len(got) == 600
    assert all(r.code == _reference(dist, r.g, r.u) for r in got)
    assert {r.code for r in got if r.g == "none"} == {None}


def test_many_outcomes_without_a_key(spark):
    dist = spark.range(1, 2001).select(F.col("id").alias("code"), (F.col("id") % 7).alias("n"))
    rows = spark.range(3000)
    drawn = draws.draw(rows, dist, "code", "n", uniform("id", salt="t"))
    got = drawn.withColumn("u", uniform("id", salt="t")).collect()
    table = [("", code, code % 7) for code in range(1, 2001)]
    assert len(got) == 3000
    assert all(r.code == _reference(table, "", r.u) for r in got)


@pytest.mark.parametrize("small", [True, False])
def test_fractions_leave_no_gap_and_no_overlap(spark, small):
    """0.1, 0.2, 0.3, 0.4 added up in binary do not meet; and a missing key is a key."""
    shares = [(g, code, code / 10) for g in ("a", None) for code in (1, 2, 3, 4)]
    ends = draws.intervals(spark.createDataFrame(shares, "g STRING, code INT, p DOUBLE"), "code", "p", ["g"], small)
    for g in ("a", None):
        rows = sorted((r.lo, r.hi) for r in ends.collect() if r.g == g)
        assert [lo for lo, _ in rows[1:]] == [hi for _, hi in rows[:-1]] and len(rows) == 4
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(500)], "id BIGINT, g STRING")
    drawn = draws.draw(rows, spark.createDataFrame(shares, "g STRING, code INT, p DOUBLE"), "code", "p", uniform("id", salt="t"), keys=["g"], small=small)
    got = drawn.collect()
    assert len(got) == 500 and all(r.code in (1, 2, 3, 4) for r in got)


def test_general_path_uses_more_cells_than_tasks(spark, plan_text):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        dist = spark.createDataFrame([(1, 1), (2, 1)], "code INT, n BIGINT")
        plan = plan_text(draws.draw(spark.range(10), dist, "code", "n", uniform("id", salt="t")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "* 800.0" in plan or "* 800" in plan


def test_label_outcomes(spark):
    dist = spark.createDataFrame([("x", 1), ("y", 3)], "code STRING, n BIGINT")
    for small in (True, False):
        drawn = draws.draw(spark.range(400), dist, "code", "n", uniform("id", salt="t"), small=small)
        got = drawn.withColumn("u", uniform("id", salt="t")).collect()
        assert len(got) == 400 and all(r.code == ("x" if r.u < 0.25 else "y") for r in got)


def test_does_not_depend_on_partitioning(spark):
    dist = [("a", 1, 3), ("a", 2, 4), ("b", 3, 1)]
    rows = _rows(spark, 500)
    first = _conditional(spark, rows, dist).collect()
    second = _conditional(spark, rows.repartition(13), dist).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_shares_follow_the_weights(spark):
    n, weights = 20_000, {1: 1, 2: 2, 3: 7}
    counted = (
        spark.range(n)
        .select(draws.pick(weights, uniform("id", salt="law")).alias("c"))
        .groupBy("c")
        .count()
        .collect()
    )
    for r in counted:
        p = weights[r.c] / 10
        assert abs(r["count"] / n - p) < 4 * math.sqrt(p * (1 - p) / n)


def test_key_and_cell_make_an_equi_join(spark, plan_text):
    rows = _rows(spark, 10)
    hashed = plan_text(_conditional(spark, rows, [("a", 1, 1)], small=True))
    assert "BroadcastHashJoin [_cell" in hashed
    open_ended = plan_text(
        draws.draw(rows, spark.createDataFrame([(1, 1)], "code INT, n BIGINT"), "code", "n", uniform("id", salt="t"))
    )
    assert "NestedLoop" not in open_ended and "Cartesian" not in open_ended


@pytest.mark.parametrize("small", [True, False])
def test_replicates_report_fit_and_choose_the_first(spark, small):
    dist = spark.createDataFrame([(1, 5), (2, 3), (3, 2), (4, 0)], "code INT, n BIGINT")
    rows = spark.range(2000).withColumnRenamed("id", "k")
    fitted = draws.replicate_fit(rows, dist, "code", "n", "k", 6, 0.0002, "s", small=small).orderBy("replicate").collect()
    assert [r.replicate for r in fitted] == [1, 2, 3, 4, 5, 6]
    chosen = [r.replicate for r in fitted if r.chosen]
    fits = [r.replicate for r in fitted if r.ss <= 0.0002]
    assert chosen == fits[:1]
    none = draws.replicate_fit(rows, dist, "code", "n", "k", 2, -1.0, "s", small=small).collect()
    assert [r.chosen for r in none] == [False, False]


def test_relatives_stay_in_range(spark):
    heads = spark.range(4000).select("id", (F.col("id") % 7 + 3).cast("int").alias("head"))
    rows = heads.select(
        "head",
        relatives.partner_band(F.col("head"), "id").alias("partner"),
        relatives.child_band(F.col("head"), "id").alias("child"),
        relatives.parent_band(F.col("head"), "id").alias("parent"),
    ).collect()
    for r in rows:
        assert r.partner in (r.head, max(3, r.head - 1))
        assert 1 <= r.child <= max(1, r.head - 2)
        assert (r.parent is None) == (r.head == 9)
        assert r.parent is None or max(4, r.head + 1) <= r.parent <= 9
    moved = sum(r.partner != r.head for r in rows if r.head > 3)
    n = sum(r.head > 3 for r in rows)
    assert abs(moved / n - 0.25) < 4 * math.sqrt(0.25 * 0.75 / n)


def test_open_head_label_is_split(spark):
    df = spark.range(3000).select("id", F.lit("65+").alias("label"))
    codes = df.select(relatives.head_band(F.col("label"), "id").alias("c")).groupBy("c").count().collect()
    shares = {r.c: r["count"] / 3000 for r in codes}
    assert set(shares) == {7, 8, 9}
    assert abs(shares[8] - 124 / 335) < 0.04
