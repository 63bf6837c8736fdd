"""Hand-made published sheets, and what the two published-sheet builders make of them."""

import pytest

from tallyloom import schemas
from tallyloom.constants import HEAD_LABELS
from tallyloom.plans import margins, patterns
from tallyloom.operators.reshape import count_matrix


def test_type_sheet(spark):
    dash = ["-"] * 4
    rows = [
        (1, "Male", "0 - 24", "5", "1", *dash),
        (2, None, "Sub-Total", "5", "1", *dash),
        (3, "Sub-Total", "0 - 24", "6", "3", *dash),
        (4, None, "65+", "-", "1", *dash),
        (5, None, "Sub-Total", "6", "4", *dash),
        (6, "Male", "0 - 24", "9", "9", *dash),
        (7, "Sub-Total", "0 - 24", "2", "-", *dash),
        (8, None, "65+", "-", "-", *dash),
        (9, None, "Sub-Total", "2", "-", *dash),
    ]
    margin = margins.type_margin(spark.createDataFrame(rows, schemas.TYPE_SHEET), heads=("0 - 24", "65+"))
    got = {(r.head_age, r.hh_size, r.hh_type): (r.n, r.p) for r in margin.collect()}
    assert len(got) == 2 * 2 * 6
    assert got["0 - 24", 1, 1] == (6, 0.75) and got["0 - 24", 1, 2] == (2, 0.25)
    assert got["65+", 2, 1] == (1, 1.0) and got["65+", 2, 2] == (0, 0.0)
    assert got["65+", 1, 1] == (0, 0.0)
    totals = {r.hh_type: (r.n, r.p) for r in margins.type_totals(margin).collect()}
    assert totals == {1: (10, 10 / 12), 2: (2, 2 / 12)}


def test_types_of_the_blocks_are_those_expected(spark):
    dash = ["-"] * 5
    rows = [(1, "Sub-Total", "0 - 24", "5", *dash), (2, None, "65+", "1", *dash), (3, None, "0 - 24", "7", *dash), (4, None, "65+", "2", *dash)]
    sheet, heads = spark.createDataFrame(rows, schemas.TYPE_SHEET), ("0 - 24", "65+")
    margin = margins.type_margin(sheet, heads, types=(1, 3))
    assert {(r.hh_type, r.n) for r in margin.where("hh_size = 1").collect()} == {(1, 5), (1, 1), (3, 7), (3, 2)}
    with pytest.raises(Exception, match="3 blocks are expected, the sheet has 2"):
        margins.type_margin(sheet, heads, types=(1, 2, 3)).collect()


def test_type_sheet_with_a_missing_row_is_an_error(spark):
    dash = ["-"] * 5
    rows = [(1, "Sub-Total", "0 - 24", "5", *dash), (2, None, "65+", "1", *dash), (3, None, "65+", "7", *dash)]
    margin = margins.type_margin(spark.createDataFrame(rows, schemas.TYPE_SHEET), heads=("0 - 24", "65+"))
    with pytest.raises(Exception, match="block 2 of the sheet is not complete"):
        margin.collect()


def test_cells_that_are_no_number_stay(spark):
    rows = [(1, "Couple (1)", "Sub-Total", "9", "9", "9", "9"), (2, None, "2", "1,234", "n.a.", "-", "1,234")]
    margin = margins.member_margin(spark.createDataFrame(rows, schemas.MEMBER_SHEET), "child")
    assert sorted(map(tuple, margin.collect())) == [(1, 2, 0, 0.5), (1, 2, 1, None), (1, 2, 3, 0.5)]


def test_member_sheet(spark):
    rows = [
        (1, "Couple (1)", "Sub-Total", "9", "9", "9", "9"),
        (2, None, "2", "3", "1", "-", "-"),
        (3, None, "6 and over", "-", "-", "-", "-"),
        (4, "Sub-Total", "Sub-Total", "9", "9", "9", "9"),
        (5, None, "2", "9", "9", "9", "9"),
        (6, "Other (6)", "Sub-Total", "9", "9", "9", "9"),
        (7, None, "6 and over", "1", "-", "-", "1"),
    ]
    margin = margins.member_margin(spark.createDataFrame(rows, schemas.MEMBER_SHEET), "child")
    assert sorted(map(tuple, margin.collect())) == [(1, 2, 0, 0.75), (1, 2, 1, 0.25), (6, 6, 0, 0.5), (6, 6, 3, 0.5)]
    assert margin.columns == ["hh_type", "hh_size", "child", "p"]


def test_head_sheet(spark):
    rows = [(label, *[i + size for size in range(1, 7)]) for i, label in enumerate(HEAD_LABELS)]
    margin = margins.head_margin(spark.createDataFrame(rows, schemas.HEAD_SHEET))
    got = {(r.hh_size, r.head_code): r for r in margin.collect()}
    assert len(got) == 60
    assert got[1, 10].head_age == "65+" and got[1, 10].p == 10 / 55
    assert abs(sum(r.p for (size, _), r in got.items() if size == 4) - 1) < 1e-12


def test_size_margin_and_stored_sizes(spark):
    sizes = spark.createDataFrame([(1, 3), (2, 1)], schemas.SIZE_COUNTS)
    assert {tuple(r) for r in margins.size_margin(sizes).collect()} == {(1, 0.75), (2, 0.25)}
    matrix = count_matrix(spark.createDataFrame([(1, 1), (2, 2), (2, 3)], "hid BIGINT, age INT"), ["hid"], "age")
    assert {tuple(r) for r in patterns.size_distribution(matrix).collect()} == {(1, 1, 0.5), (2, 1, 0.5)}
    assert patterns.single_member_bands(matrix).where("n > 0").collect()[0].asDict() == {"age": 1, "n": 1, "p": 1.0}


def test_pairs_of_five_year_codes(spark):
    counts = spark.createDataFrame([(1, 1), (2, 2), (17, 3), (18, 4)], "age5_code INT, n BIGINT")
    assert {tuple(r) for r in margins.band_pairs_margin(counts).collect()} == {(1, 3, 0.3), (9, 7, 0.7)}
