"""Declared schemas; nothing in this package infers types from data."""

from pyspark.sql import types as T

from .constants import BAND_CODES, OPEN_SIZE

TEXT, INT, BIGINT, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
SIZE_COLUMNS = tuple(str(size) for size in range(1, OPEN_SIZE + 1))
MEMBER_COLUMNS = ("0", "1", "2", "3")


def struct(columns: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CENSUS_COUNTS = struct({"size_label": TEXT, "age5": TEXT, "n": BIGINT})
AGE_COUNTS = struct({"age": INT, "n": BIGINT})
SIZE_COUNTS = struct({"hh_size": INT, "n": BIGINT})
HEAD_SHEET = struct({"head_age": TEXT} | dict.fromkeys(SIZE_COLUMNS, BIGINT))
TYPE_SHEET = struct({"ord": BIGINT, "sex": TEXT, "head_age": TEXT} | dict.fromkeys(SIZE_COLUMNS, TEXT))
MEMBER_SHEET = struct({"ord": BIGINT, "hh_type": TEXT, "hh_size": TEXT} | dict.fromkeys(MEMBER_COLUMNS, TEXT))
ROSTER_LONG = struct({"hid": BIGINT, "age": INT, "value": BIGINT})
ROSTER_WIDE = struct({"hid": BIGINT} | {f"b{code}": BIGINT for code in BAND_CODES} | {"b_other": BIGINT})
HOUSEHOLD_TYPE = struct({"hid": BIGINT, "hh_type": INT})
FIT_STEPS = struct({"hid": BIGINT, "ss": DOUBLE})
