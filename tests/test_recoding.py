"""Codes from a table of labels."""

import pytest

from tallyloom.operators.recoding import recode_by_table, unmatched_labels


def test_codes_from_a_table(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, None, 0), (4, "zz", 0), (5, "zz", 0)], "id INT, label STRING, code INT")
    table = spark.createDataFrame([("a", 10), ("b", 20), ("b", 20), (None, 30)], "name STRING, code INT")
    found = recode_by_table(rows, "label", table, "name", "code", "code")
    assert found.columns == ["id", "label", "code"]
    assert {r.id: r.code for r in found.collect()} == {1: 10, 2: 20, 3: 30, 4: None, 5: None}
    assert [tuple(r) for r in unmatched_labels(found, "label", "code").collect()] == [("zz", 2)]


def test_a_label_with_two_codes_is_an_error(spark):
    table = spark.createDataFrame([("a", 10), ("a", 11), ("c", None), ("c", None)], "name STRING, code INT")
    rows = spark.createDataFrame([(1, "a"), (2, "c")], "id INT, label STRING")
    with pytest.raises(Exception, match="two codes for the label a"):
        recode_by_table(rows, "label", table, "name", "code", "code").collect()


def test_thousands_of_labels(spark):
    table = spark.range(5000).selectExpr("concat('label ', id) AS name", "id AS code")
    rows = spark.range(20_000).selectExpr("id", "concat('label ', if(id % 3 = 0, 7, id % 6000)) AS label")
    found = recode_by_table(rows, "label", table, "name", "code", "code")
    assert found.where("code <> if(id % 3 = 0, 7, id % 6000)").isEmpty()
    assert found.where("code IS NULL").count() == sum(1 for i in range(20_000) if i % 3 and i % 6000 >= 5000)
