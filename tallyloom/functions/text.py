"""Cleaning of published-table text."""

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ..constants import BAND_YEARS, NIL_CELL


def recode(column: Column, codes: Mapping, keep_unmatched: bool = False) -> Column:
    """Replace labels by codes; a label without a code becomes NULL, or stays as it is."""
    table = F.create_map(*[F.lit(part) for pair in codes.items() for part in pair])
    found = F.try_element_at(table, column)
    return F.coalesce(found, column) if keep_unmatched else found


def bracket_digit(column: Column) -> Column:
    """`Couple (1)` gives `1`; text without a bracketed digit is unchanged."""
    return F.regexp_replace(column, r".+\((\d)\)", "$1")


def nil_as_zero(column: Column, nil: str = NIL_CELL) -> Column:
    """A dash stands for zero in published tables."""
    return F.when(column == nil, F.lit("0")).otherwise(column)


def retype(column: Column, kind: str) -> Column:
    """Text to the declared type; text that does not parse becomes NULL."""
    return F.trim(column).try_cast(kind)


def cell_count(column: Column) -> Column:
    """A published cell as a count: separators of thousands are dropped, and a cell that is no number is
    NULL. Callers keep such rows."""
    plain = F.regexp_replace(F.trim(nil_as_zero(column)), r"(?<=\d)[,  ](?=\d{3}(?:\D|$))", "")
    return retype(plain, "bigint")


def band_label(code: Column, years: int = BAND_YEARS) -> Column:
    """Band code 1.. to `0 - 9`, `10 - 19`, ..."""
    low = (code - 1) * years
    return F.concat_ws(" - ", low.cast("string"), (low + (years - 1)).cast("string"))


def coarser(code: Column, each: int = 2) -> Column:
    """Collapse `each` neighbouring codes into one (five-year codes 1..18 to bands 1..9)."""
    return F.ceil(code / F.lit(each)).cast("int")
