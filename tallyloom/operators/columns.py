"""Choosing columns and rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import SUBTOTAL_LABEL


def column_span(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from `first` to `last`, both included."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def starting_with(df: DataFrame, prefix: str) -> list[str]:
    """Column names with a prefix; case is ignored."""
    return [name for name in df.columns if name.lower().startswith(prefix.lower())]


def all_but(df: DataFrame, *names: str) -> list[str]:
    """Every column name except the given ones."""
    return [name for name in df.columns if name not in names]


def drop_subtotals(df: DataFrame, columns: Sequence[str], label: str = SUBTOTAL_LABEL) -> DataFrame:
    """Keep rows where none of the columns holds the subtotal label (or NULL)."""
    for column in columns:
        df = df.where(F.col(column) != label)
    return df


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column, list[str]]:
    """`right` with renamed keys, the null-safe condition to join it on, and the renamed keys.

    A missing key is a group of its own in every grouped operator here, so joins back to grouped
    results must match NULL with NULL.
    """
    renamed = {key: f"_right_{key}" for key in keys}
    right = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for key, other in renamed.items():
        condition = condition & F.col(key).eqNullSafe(F.col(other))
    return right, condition, list(renamed.values())


def join_back(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", small: bool = False
) -> DataFrame:
    """Null-safe equi join that keeps one copy of the keys.

    `small=True` broadcasts `right`. Set it only where its row count has a fixed bound; otherwise
    AQE measures `right` and picks the join.
    """
    right, condition, extra = same_keys(left, right, keys)
    return left.join(F.broadcast(right) if small else right, condition, how).drop(*extra)
