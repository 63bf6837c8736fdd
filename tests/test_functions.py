import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from tallyloom.constants import HEAD_LABELS
from tallyloom.functions.numeric import clamp, open_top, squared_distance
from tallyloom.functions.text import band_label, bracket_digit, cell_count, coarser, recode, retype
from tallyloom.functions.uniform import normal, uniform


def _column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_bracketed_digit(spark):
    values = ["Couple (2)", "no brackets", "(3)", "two (1) of (4)", None]
    assert _column(spark, values, "STRING", bracket_digit) == ["2", "no brackets", "(3)", "4", None]


def test_cells(spark):
    values = ["-", "12", " 7 ", "n.a.", "", None]
    assert _column(spark, values, "STRING", cell_count) == [0, 12, 7, None, None, None]
    assert _column(spark, ["1.5", "x"], "STRING", lambda c: retype(c, "double")) == [1.5, None]


def test_separators_of_thousands_and_cells_that_are_no_number(spark):
    cells = ["1,234", "1,234,567", "1 234", " 12 ", "-", "n.a.", "1,23", None]
    assert _column(spark, cells, "STRING", cell_count) == [1234, 1234567, 1234, 12, 0, None, None, None]


def test_recode(spark):
    codes = {label: code for code, label in enumerate(HEAD_LABELS, start=1)}
    assert _column(spark, ["0 - 24", "65+", "?", None], "STRING", lambda c: recode(c, codes)) == [1, 10, None, None]
    kept = _column(spark, ["6 and over", "5"], "STRING", lambda c: recode(c, {"6 and over": "6"}, True))
    assert kept == ["6", "5"]


def test_codes_and_labels(spark):
    assert _column(spark, [1, 2, 3, 17, 18], "INT", coarser) == [1, 1, 2, 9, 9]
    assert _column(spark, [1, 2, 9], "INT", band_label) == ["0 - 9", "10 - 19", "80 - 89"]


def test_numbers(spark):
    assert _column(spark, [1, 5, 12], "INT", lambda c: clamp(c, 3, 9)) == [3, 5, 9]
    assert _column(spark, [2, 9], "BIGINT", lambda c: open_top(c, 6)) == [2, 6]
    assert _column(spark, [1.0], "DOUBLE", lambda c: squared_distance([c, c], [c - 1, c + 2])) == [5.0]


def test_uniform_is_the_documented_hash(spark):
    keys = [1, 2, -5, 10**12]
    drawn = _column(spark, keys, "BIGINT", lambda c: uniform(c, c + 1, salt="s", seed=3))
    for key, number in zip(keys, drawn):
        state = 42
        for part in (key, key + 1, zlib.crc32(b"s|3")):
            state = xxhash.xxh64(struct.pack("<q", part), seed=state).intdigest()
        assert number == (state >> 16) / 2**48


def test_largest_number_stays_below_any_total():
    largest = (2**48 - 1) / 2**48
    for total in (1, 3, 335, 2**31 - 1, 10**15 + 7, 2**53, 2**62 + 12345):
        assert largest * float(total) < float(total)


def test_normal_has_the_stated_moments(spark):
    n = 20_000
    df = spark.range(n).select(normal("id", mean=3.0, sd=2.0, salt="z").alias("x"))
    mean, sd = df.agg(F.avg("x"), F.stddev_samp("x")).first()
    assert abs(mean - 3) < 4 * 2 / n**0.5
    assert abs(sd - 2) < 4 * 2 / (2 * n) ** 0.5
