from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import reshape
from tallyloom.operators.columns import all_but, column_span, drop_subtotals, starting_with
from tallyloom.operators.draws import draw_members
from tallyloom.plans import patterns

QUICK = settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
rosters = st.lists(st.tuples(st.integers(1, 8), st.integers(1, 9)), min_size=1, max_size=60)


def _roster(spark, rows):
    return reshape.count_matrix(spark.createDataFrame(rows, "hid BIGINT, age INT"), ["hid"], "age")


def _sorted(df):
    return sorted(map(tuple, df.collect()))


@QUICK
@given(rows=rosters, chunk=st.sampled_from([1, 2, 65536]))
def test_members_come_back_numbered_and_sorted(spark, rows, chunk):
    members = reshape.members(_roster(spark, rows), ["hid"], chunk=chunk)
    expected, seen = [], {}
    for hid, age in sorted(rows):
        seen[hid] = seen.get(hid, 0) + 1
        expected.append((hid, seen[hid], age))
    assert _sorted(members) == sorted(expected)


@QUICK
@given(rows=rosters)
def test_long_and_wide_are_inverse(spark, rows):
    matrix = _roster(spark, rows)
    long = reshape.to_long(matrix, ["hid"])
    assert long.agg(F.sum("value")).first()[0] == len(rows)
    assert _sorted(reshape.count_matrix(long, ["hid"], "age", weight="value")) == _sorted(matrix)


@QUICK
@given(rows=rosters)
def test_pattern_counts_add_up_to_entities(spark, rows):
    counted = patterns.pattern_counts(_roster(spark, rows))
    assert counted.agg(F.sum("n")).first()[0] == len({hid for hid, _ in rows})


def test_uncount_drops_weights_below_one(spark):
    df = spark.createDataFrame([("a", 0), ("b", 2), ("c", -1), ("d", None), ("e", 7)], "k STRING, w INT")
    for chunk in (65536, 3, 1):
        copies = reshape.uncount(df, "w", chunk=chunk).select("k", "copy")
        assert _sorted(copies) == [("b", 1), ("b", 2)] + [("e", i) for i in range(1, 8)]


def test_wide_members_keep_what_does_not_fit_visible(spark):
    matrix = _roster(spark, [(1, 4), (1, 1), (1, 1), (2, 9)])
    rows = {r.hid: r for r in reshape.members_wide(matrix, ["hid"], 2).collect()}
    assert tuple(rows[1]) == (1, 3, 1, 1, 2, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1)
    assert tuple(rows[2]) == (2, 1, 9, None, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0)


def test_wide_members_are_as_wide_as_the_largest_entity(spark):
    matrix = _roster(spark, [(1, 1 + i % 9) for i in range(25)] + [(2, 3)])
    wide = reshape.members_wide(matrix, ["hid"])
    rows = {r.hid: r for r in wide.collect()}
    assert "age_25" in wide.columns and "age_26" not in wide.columns
    assert [rows[1][f"age_{i + 1}"] for i in range(25)] == sorted(1 + i % 9 for i in range(25))
    assert rows[1].n_over == rows[2].n_over == 0


def test_members_without_a_known_code_are_counted(spark):
    matrix = _roster(spark, [(1, 1), (1, 10), (1, None), (2, 4)])
    sized = {r.hid: r for r in matrix.withColumn("n", reshape.member_total()).collect()}
    assert (sized[1].n, sized[1].b1, sized[1].b_other, sized[2].n) == (3, 1, 2, 1)
    assert sorted(map(str, map(tuple, reshape.to_long(matrix, ["hid"]).collect()))) == ["(1, 1, 1)", "(1, None, 2)", "(2, 4, 1)"]
    assert sorted(map(str, map(tuple, reshape.members(matrix, ["hid"]).collect()))) == [
        "(1, 1, 1)", "(1, 2, None)", "(1, 3, None)", "(2, 1, 4)",
    ]
    labels = {r.hh_size: r.pattern for r in patterns.labelled(patterns.pattern_counts(matrix)).collect()}
    assert labels == {1: "4{1}", 3: "1{1}+?{2}"}


def test_any_columns_to_long_and_to_members(spark):
    matrix = spark.createDataFrame([(1, 2, 0), (2, 0, 1)], "hid BIGINT, a_0_9 BIGINT, a_10_19 BIGINT")
    names = {"a_0_9": 1, "a_10_19": 2}
    assert _sorted(reshape.long_from_names(matrix, ["hid"], names)) == [(1, 1, 2), (2, 2, 1)]
    assert len(_sorted(reshape.long_from_names(matrix, ["hid"], names, positive=False))) == 4
    assert _sorted(reshape.members(matrix, ["hid"], names=names)) == [(1, 1, 1), (1, 2, 1), (2, 1, 2)]


def test_patterns_by_a_stored_size(spark):
    matrix = _roster(spark, [(1, 1), (1, 2), (2, 1), (3, 1)]).withColumn("stored", F.lit(4))
    rows = patterns.ranked_patterns(matrix, size_col="stored").collect()
    assert sorted((r.hh_size, r.pattern, r.n) for r in rows) == [(4, "1{1}", 2), (4, "1{1}+2{1}", 1)]


def test_huge_entity_stays_one_narrow_row(spark, plan_text):
    """An entity with a third of the rows: partial counts before the shuffle, nothing collected."""
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("hid"),
        (F.col("id") % 9 + 1).cast("int").alias("age"),
    )
    matrix = reshape.count_matrix(rows, ["hid"], "age")
    counted = patterns.labelled(patterns.pattern_counts(matrix))
    plan = plan_text(counted)
    assert "collect_list" not in plan and "partial_count" in plan
    big = counted.orderBy(F.desc("hh_size")).first()
    # Of ids 0..299999, the multiples of three carry codes 1, 4 and 7; id 7 itself has code 8.
    assert (big.hh_size, big.n) == (100_001, 1)
    assert big.pattern == "1{33334}+4{33333}+7{33333}+8{1}"


def test_empty_and_full_rosters(spark):
    columns = "hid BIGINT, " + ", ".join(f"b{c} BIGINT" for c in [*range(1, 10), "_other"])
    matrix = spark.createDataFrame([(1, *[0] * 10), (2, *[1] * 9, 0), (3, 0, 2, *[0] * 8)], columns)
    labels = {r.hh_size: r.pattern for r in patterns.labelled(patterns.pattern_counts(matrix)).collect()}
    assert labels == {9: "+".join(f"{c}{{1}}" for c in range(1, 10)), 2: "2{2}"}
    assert _sorted(reshape.to_long(matrix.where("hid = 1"), ["hid"])) == []


def test_ties_follow_the_sorted_members(spark):
    matrix = _roster(spark, [(1, 2), (1, 3), (2, 1), (2, 9), (3, 2), (3, 2)])
    ranked = patterns.top_patterns(matrix, 2)
    assert [(r["rank"], r.pattern) for r in ranked.orderBy("rank").collect()] == [
        (1, "1{1}+9{1}"),
        (2, "2{2}"),
    ]


def test_top_patterns_are_cut_before_the_shuffle(spark, plan_text):
    plan = plan_text(patterns.top_patterns(_roster(spark, [(1, 1)]), 3))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_text(patterns.most_frequent(_roster(spark, [(1, 1)]), 3))


def test_two_populations_are_kept_apart(spark):
    first = spark.createDataFrame([(1, 1), (1, 1), (2, 4)], "hid BIGINT, age INT")
    second = spark.createDataFrame([(1, 4), (2, 4)], "hid BIGINT, age INT")
    rows = patterns.compare_populations({"x": first, "y": second}, "hid", "age").collect()
    assert sorted((r.population, r.hh_size, r.pattern, r.n, r.p) for r in rows) == [
        ("x", 1, "4{1}", 1, 1.0),
        ("x", 2, "1{2}", 1, 1.0),
        ("y", 1, "4{1}", 2, 1.0),
    ]


def test_draws_per_row_add_up(spark):
    rows = spark.range(50).select(F.col("id").alias("hid"), (F.col("id") % 4).alias("k"))
    matrix = draw_members(rows, "hid", "k", {7: 1, 8: 2, 9: 2}, (7, 8, 9), "x")
    assert all(r.b7 + r.b8 + r.b9 == r.hid % 4 for r in matrix.collect())
    assert matrix.count() == sum(1 for i in range(50) if i % 4)


def test_column_choices(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "hid INT, a_0_9 INT, A_10_19 INT, z INT")
    assert starting_with(df, "a") == ["a_0_9", "A_10_19"]
    assert all_but(df, "hid", "z") == ["a_0_9", "A_10_19"]
    assert column_span(df, "a_0_9", "z") == ["a_0_9", "A_10_19", "z"]


def test_subtotals_and_missing_labels_are_dropped(spark):
    df = spark.createDataFrame(
        [("x", "1"), ("Sub-Total", "1"), ("x", "Sub-Total"), (None, "1")], "a STRING, b STRING"
    )
    assert [tuple(r) for r in drop_subtotals(df, ["a", "b"]).collect()] == [("x", "1")]


def test_unlike_codes_are_unlike_patterns(spark):
    """Codes 10 and 11 are codes like others, and members without one are told apart from them."""
    rows = [(1, 10), (1, 2), (2, 11), (2, 2), (3, 2), (3, None), (4, 11), (4, 2)]
    df = spark.createDataFrame(rows, "hid BIGINT, code INT")
    found = {r.pattern: (r.hh_size, r.n, r.p) for r in patterns.sparse_patterns(df, ["hid"], "code").collect()}
    assert found == {"2{1}+10{1}": (2, 1, 0.25), "2{1}+11{1}": (2, 2, 0.5), "2{1}+?{1}": (2, 1, 0.25)}


def test_text_codes_are_compared_by_code_and_not_by_label(spark):
    df = spark.createDataFrame([(1, "a{1}+b"), (2, "a"), (2, "b")], "hid BIGINT, code STRING")
    found = patterns.sparse_patterns(df, ["hid"], "code").collect()
    assert sorted((r.pattern, r.hh_size) for r in found) == [("a{1}+b{1}", 1), ("a{1}+b{1}", 2)]


def test_run_lengths_are_read_by_position(spark):
    rows = [(1, 7), (1, 3), (1, 7), (1, None), (2, 1000)]
    runs = reshape.run_lengths(spark.createDataFrame(rows, "hid BIGINT, code INT"), ["hid"], "code")
    at = {f"m{i}": reshape.member_at(F.col("runs"), F.lit(i)) for i in range(6)}
    found = {r.hid: tuple(r[c] for c in at) for r in runs.withColumns(at).collect()}
    assert found == {1: (None, 3, 7, 7, None, None), 2: (None, 1000, None, None, None, None)}
    assert {r.hid: r.hh_size for r in runs.collect()} == {1: 4, 2: 1}


def test_run_lengths_of_a_large_entity_stay_short(spark):
    df = spark.range(300_000).select(F.lit(1).alias("hid"), (F.col("id") % 3).alias("code"), F.lit(10**6).alias("w"))
    row = reshape.run_lengths(df, ["hid"], "code", weight="w").first()
    assert row.hh_size == 3 * 10**11 and len(row.runs) == 3
