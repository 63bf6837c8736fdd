"""Arithmetic helpers."""

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def clamp(column: Column, low, high) -> Column:
    """Limit to low..high; a bound may be a value or a column. The upper bound wins."""
    low, high = (side if isinstance(side, Column) else F.lit(side) for side in (low, high))
    return F.least(high, F.greatest(low, column))


def open_top(column: Column, top: int) -> Column:
    """Put everything from `top` on into one open class."""
    return F.least(column, F.lit(top).cast("bigint"))


def total(columns: Sequence[Column]) -> Column:
    """Row-wise sum, added from the left."""
    return reduce(add, columns)


def squared_distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Sum of squared differences of two equally long column lists, added from the left."""
    return total([(a - b) * (a - b) for a, b in zip(left, right, strict=True)])
