import pytest
from pyspark.sql import functions as F

from tallyloom.constants import HEAD_OPEN_SPLIT
from tallyloom.operators import distributions
from tallyloom.operators.aggregate import code_domain, crosstab, cube_margins, gap_filled, gaps, spread_of_group, with_share, zero_filled
from tallyloom.operators.checks import never_seen, unseen_codes
from tallyloom.operators.compare import fit_report, member_gap, squared_error, without_members

EPS = 1e-12


def test_joint_law_obeys_the_rule_and_sums_to_one(spark):
    child = spark.createDataFrame([("t", 0, 0.5), ("t", 1, 0.3), ("t", 2, 0.2)], "k STRING, child INT, p DOUBLE")
    elder = spark.createDataFrame([("t", 0, 0.6), ("t", 1, 0.4)], "k STRING, elder INT, p DOUBLE")
    rows = distributions.joint(child, elder, ["k"], F.col("child") + F.col("elder") < 2).collect()
    whole = 0.5 * 0.6 + 0.5 * 0.4 + 0.3 * 0.6
    assert {(r.child, r.elder) for r in rows} == {(0, 0), (0, 1), (1, 0)}
    assert abs(sum(r.p for r in rows) - 1) < EPS
    assert abs({(r.child, r.elder): r.p for r in rows}[1, 0] - 0.18 / whole) < EPS


def test_exclusion_renormalises_each_key(spark):
    dist = spark.createDataFrame([("a", 1, 0.5), ("a", 4, 0.5), ("b", 4, 1.0), ("c", 2, 1.0)], "k STRING, t INT, p DOUBLE")
    rows = distributions.exclude(dist, ["k"], F.col("t") == 4).collect()
    assert {(r.k, r.t, r.p) for r in rows} == {("a", 1, 1.0), ("c", 2, 1.0)}


def test_rebin_and_split(spark):
    dist = spark.createDataFrame([(1, 0.25), (2, 0.25), (3, 0.5)], "code INT, p DOUBLE")
    coarse = distributions.rebin(dist, [], "code", {1: 7, 2: 7, 3: 8}, "age")
    assert {(r.age, r.p) for r in coarse.collect()} == {(7, 0.5), (8, 0.5)}
    fine = {r.age: r.p for r in distributions.split(coarse, "age", {7: HEAD_OPEN_SPLIT}).where("p > 0").collect()}
    rows = distributions.split(coarse, "age", {7: HEAD_OPEN_SPLIT}).groupBy("age").agg(F.sum("p").alias("p")).collect()
    assert set(fine) == {7, 8, 9}
    assert abs({r.age: r.p for r in rows}[8] - (0.5 + 0.5 * 124 / 335)) < EPS


@pytest.mark.parametrize("how", [{"tiny": True}, {"small": True}, {}])
def test_guarded_share_of_an_all_zero_group(spark, how):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 3), ("b", 2, 1), (None, 1, 2)], "g STRING, c INT, n BIGINT")
    guarded = with_share(df, by=["g"], guarded=True, **how).collect()
    assert {(r.g, r.c): r.p for r in guarded} == {("a", 1): 0.0, ("a", 2): 0.0, ("b", 1): 0.75, ("b", 2): 0.25, (None, 1): 1.0}
    assert {r.p for r in with_share(df, by=["g"], **how).where("g = 'a'").collect()} == {None}


@pytest.mark.parametrize("tiny", [True, False])
def test_report_has_categories_of_either_side(spark, tiny):
    population = spark.createDataFrame([("x", 1, 3), ("x", 2, 1), ("y", 1, 4)], "g STRING, c INT, n BIGINT")
    sample = spark.createDataFrame([("x", 2, 1), ("x", 3, 1)], "g STRING, c INT, n BIGINT")
    report = fit_report(population, sample, "c", by=["g"], tiny=tiny)
    rows = {(r.g, r.c): (r.p_pop, r.p_sample, r["diff"]) for r in report.collect()}
    assert rows == {
        ("x", 1): (0.75, 0.0, -0.75),
        ("x", 2): (0.25, 0.5, 0.25),
        ("x", 3): (0.0, 0.5, 0.5),
        ("y", 1): (1.0, None, None),
    }
    errors = {r.g: r.ss for r in squared_error(report, ["g"]).collect()}
    assert errors == {"x": 0.5625 + 0.0625 + 0.25, "y": None}


@pytest.mark.parametrize("tiny", [True, False])
def test_unmatched_sides_of_a_plain_report(spark, tiny):
    left = spark.createDataFrame([(1, 1), (2, 3)], "c INT, n BIGINT")
    right = spark.createDataFrame([(2, 1), (None, 1)], "c INT, n BIGINT")
    rows = {r.c: (r.p_pop, r.p_sample) for r in fit_report(left, right, "c", tiny=tiny).collect()}
    assert rows == {1: (0.25, 0.0), 2: (0.75, 0.5), None: (0.0, 0.5)}


def test_crosstab_has_zero_cells_and_totals(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (3, 2), (3, 2)], "r INT, c INT")
    rows = {r.r: tuple(r)[1:] for r in crosstab(df, "r", "c", [0, 1, 2]).collect()}
    assert rows == {"1": (1, 0, 1, 0, 2), "3": (0, 0, 2, 0, 2), "Sum": (1, 0, 3, 0, 4)}
    weighted = crosstab(df, "r", "c", [0, 2], weight=F.lit(5), margins=False)
    assert {tuple(r) for r in weighted.collect()} == {(1, 5, 5, 0), (3, 0, 10, 0)}


def test_crosstab_rows_add_up_with_values_that_are_not_listed(spark):
    df = spark.createDataFrame([(1, 0), (1, 7), (1, None)], "r INT, c INT")
    rows = {r.r: tuple(r)[1:] for r in crosstab(df, "r", "c", [0, 1]).collect()}
    assert rows == {"1": (1, 0, 2, 3), "Sum": (1, 0, 2, 3)}


def test_domain_reaches_to_the_largest_value(spark):
    seen = spark.createDataFrame([(2, 4), (25, 2)], "c INT, n BIGINT")
    filled = zero_filled(seen, code_domain(seen, "c"), ["c"])
    assert {r.c: r.n for r in filled.collect()} == {c: {2: 4, 25: 2}.get(c, 0) for c in range(1, 26)}
    assert code_domain(seen.limit(0), "c").collect() == []


def test_zero_fill_and_coverage(spark):
    seen = spark.createDataFrame([(1, 4), (3, 2)], "c INT, n BIGINT")
    domain = spark.createDataFrame([(c,) for c in range(1, 5)], "c INT")
    assert {tuple(r) for r in zero_filled(seen, domain, ["c"]).collect()} == {(1, 4), (2, 0), (3, 2), (4, 0)}
    beyond = spark.createDataFrame([(9, 1), (None, 2)], "c INT, n BIGINT")
    kept = {tuple(r) for r in zero_filled(beyond, domain.where("c < 2"), ["c"]).collect()}
    assert kept == {(1, 0), (9, 1), (None, 2)}
    # Gaps in the middle are found, not only a missing top code.
    assert sorted(r.c for r in never_seen(domain, seen, ["c"]).collect()) == [2, 4]


def test_gaps_between_declared_and_counted(spark):
    declared = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "hid BIGINT, size BIGINT")
    members = spark.createDataFrame([(1,), (1,), (1,), (3,)], "hid BIGINT")
    rows = {r.hid: (r.n_members, r.n_missing) for r in member_gap(declared, members, "hid", "size").collect()}
    assert rows == {1: (3, -1), 2: (0, 1), 3: (1, 3)}
    assert [r.hid for r in without_members(declared.select("hid"), members, "hid").collect()] == [2]


def test_gaps_are_filled_within_groups(spark):
    seen = spark.createDataFrame([("a", 2, 5), ("a", 6, 1), ("b", 1, 2), ("a", -4, 9), (None, 3, 1)], "g STRING, c INT, n BIGINT")
    for segments, chunk in ((1, 2), (3, 65536), (None, 1)):
        filled = gap_filled(seen, "c", by=["g"], segments=segments, chunk=chunk)
        assert sorted(map(tuple, filled.where("g = 'a'").collect())) == [("a", -4, 9), ("a", 1, 0), ("a", 2, 5), ("a", 3, 0), ("a", 4, 0), ("a", 5, 0), ("a", 6, 1)]
        assert sorted(tuple(r)[1:] for r in filled.where("g IS NULL").collect()) == [(1, 0), (2, 0), (3, 1)]
        assert filled.where("g = 'b'").count() == 1
    assert dict(filled.dtypes) == dict(seen.dtypes)


def test_a_gap_of_a_hundred_million_codes(spark):
    """It is made in bounded pieces, by several tasks."""
    made = gaps(spark.createDataFrame([(3,), (10**8,)], "c BIGINT"), "c", segments=1)
    counted = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).collect()
    assert sum(r.n for r in counted) == 10**8 - 2 and len(counted) > 1
    assert sum(r.s for r in counted) == 10**8 * (10**8 - 1) // 2 - 3


def test_unseen_codes_reach_to_the_largest_of_all_groups(spark):
    seen = spark.createDataFrame([("a", 2), ("a", 2), ("b", 4), ("b", 1), (None, 5), ("c", -1)], "g STRING, c BIGINT")
    found = {(r.g, r.c) for r in unseen_codes(seen, "c", ["g"]).collect()}
    assert found == {("a", 1), ("a", 3), ("a", 4), ("a", 5), ("b", 2), ("b", 3), ("b", 5), (None, 1), (None, 2), (None, 3), (None, 4)}


def test_cube_has_every_margin_and_zero_cells(spark):
    df = spark.createDataFrame([("x", 1, 2), ("x", 1, 3), ("y", 2, 4), (None, 1, 1)], "a STRING, b INT, w INT")
    found = {(r.a, r.b, r.level): r.n for r in cube_margins(df, ["a", "b"], F.col("w")).collect()}
    cells = {("x", 1, 0): 5, ("x", 2, 0): 0, ("y", 1, 0): 0, ("y", 2, 0): 4, (None, 1, 0): 1, (None, 2, 0): 0}
    assert found == cells | {("x", None, 1): 5, ("y", None, 1): 4, (None, None, 1): 1, (None, 1, 2): 6, (None, 2, 2): 4, (None, None, 3): 10}
    assert {r.n for r in cube_margins(df.limit(0), ["a", "b"]).collect()} <= {0}


def test_variance_of_fractions_does_not_depend_on_the_order(spark):
    rows = [("a", 0.2), ("a", 0.9), ("b", 1.5), ("c", None), ("c", 2.0), ("c", 2.5)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    found = {r.g: (r.n, r.variance) for r in spread_of_group(df, ["g"], "v", digits=2).collect()}
    assert found["a"][0] == 2 and abs(found["a"][1] - 0.245) < 1e-15
    assert found["b"] == (1, None) and found["c"] == (2, 0.125)
    many = spark.range(20_000).select((F.col("id") % 7).alias("g"), (F.lit(1e9) + F.col("id") * 0.013).alias("v"))
    first = sorted(map(tuple, spread_of_group(many, ["g"], "v", digits=3).collect()))
    second = sorted(map(tuple, spread_of_group(many.repartition(11, "v"), ["g"], "v", digits=3).collect()))
    assert first == second
    values = [round(i * 13) for i in range(20_000) if i % 7 == 0]
    mean = sum(values) / len(values)
    expected = sum((x - mean) ** 2 for x in values) / (len(values) - 1) / 1e6
    assert abs(first[0][2] / expected - 1) < 1e-9
    with pytest.raises(TypeError, match="how many digits"):
        spread_of_group(df, ["g"], "v")


def test_marginal_of_a_joint_law_needs_no_pairs(spark, plan_text):
    first = spark.createDataFrame([("k", i, 0.1 * i) for i in range(1, 5)] + [(None, 1, 1.0), ("none", 9, 1.0)], "g STRING, a INT, p DOUBLE")
    second = spark.createDataFrame([("k", i, 0.25) for i in range(4)] + [(None, 0, 0.5), (None, 7, 0.5), ("none", 3, 1.0)], "g STRING, b INT, p DOUBLE")
    pairs = distributions.joint(first, second, ["g"], F.col("a") + F.col("b") <= 4)
    expected = {(r.g, r.a): r.p for r in pairs.groupBy("g", "a").agg(F.sum("p").alias("p")).collect()}
    marginal = distributions.joint_marginal(first, second, ["g"], "a", "b", F.lit(4))
    found = {(r.g, r.a): r.p for r in marginal.collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-12 for k in found)
    plan = plan_text(marginal)
    assert not [line for line in plan.splitlines() if "Join" in line and "b#" in line]
