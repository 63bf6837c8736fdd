"""Which member combinations occur in entities of each size, and how often.

A pattern is the sorted multiset of member codes. It is held as its count vector: fixed width, one
aggregation away from the member rows, and equal exactly when the sorted members are equal. Where the
codes are many or not known before, it is held as its run lengths: (code, count) in code order.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import BAND_CODES
from ..operators.aggregate import column_totals, crosstab, grouped_count, with_share
from ..operators.reshape import count_matrix, count_names, member_total, other_name, run_lengths


def pattern_label(codes: Sequence[int] = BAND_CODES, prefix: str = "b") -> Column:
    """The pattern as text: `1{2}+4{2}` is two members of code 1 and two of code 4; `?` stands for
    members without a known code."""
    parts = [
        F.when(F.col(name) > 0, F.concat(F.lit(f"{code}{{"), F.col(name).cast("string"), F.lit("}")))
        for code, name in [*zip(codes, count_names(codes, prefix), strict=True), ("?", other_name(prefix))]
    ]
    return F.concat_ws("+", *parts)


def pattern_order(codes: Sequence[int] = BAND_CODES, prefix: str = "b") -> list[Column]:
    """Most frequent first; ties in the order of the sorted members."""
    return [F.desc("n"), *[F.desc(name) for name in [*count_names(codes, prefix), other_name(prefix)]]]


def pattern_counts(
    matrix: DataFrame,
    by: Sequence[str] = (),
    codes: Sequence[int] = BAND_CODES,
    prefix: str = "b",
    size_col: str | None = None,
) -> DataFrame:
    """Entities per pattern with the share within the entity size; keeps the count columns.

    The size is the member count, or a stored column that need not agree with it. Totals per size are
    joined back; whether they are small enough to be broadcast is left to their measured size.
    """
    names = [*count_names(codes, prefix), other_name(prefix)]
    size = F.col(size_col) if size_col else member_total(codes, prefix)
    sized = matrix.withColumn("hh_size", size).where("hh_size > 0")
    return with_share(grouped_count(sized, [*by, "hh_size", *names]), by=[*by, "hh_size"])


def labelled(
    counted: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = (), codes: Sequence[int] = BAND_CODES
) -> DataFrame:
    return counted.select(*by, "hh_size", pattern_label(codes).alias("pattern"), "n", "p", *extra)


def ranked_patterns(matrix: DataFrame, by: Sequence[str] = (), size_col: str | None = None) -> DataFrame:
    """All patterns by size, the most frequent first."""
    counted = pattern_counts(matrix, by, size_col=size_col)
    return labelled(counted.orderBy(*by, "hh_size", *pattern_order()), by)


def top_patterns(matrix: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent patterns of each size; partitions are cut to k before the shuffle."""
    window = Window.partitionBy(*by, "hh_size").orderBy(*pattern_order())
    ranked = pattern_counts(matrix, by).withColumn("rank", F.row_number().over(window))
    return labelled(ranked.where(F.col("rank") <= k), by, ["rank"])


def most_frequent(matrix: DataFrame, k: int) -> DataFrame:
    """The k most frequent patterns over all sizes."""
    return labelled(pattern_counts(matrix).orderBy(*pattern_order()).limit(k))


def compare_populations(rosters: Mapping[str, DataFrame], key: str, code: str) -> DataFrame:
    """Patterns by size for several rosters (one row per member: key, code)."""
    stacked = None
    for name, roster in rosters.items():
        part = roster.select(F.lit(name).alias("population"), key, code)
        stacked = part if stacked is None else stacked.unionByName(part)
    matrix = count_matrix(stacked, ["population", key], code)
    return labelled(pattern_counts(matrix, ["population"]), ["population"])


def size_distribution(matrix: DataFrame, size_col: str | None = None) -> DataFrame:
    """Entities and share per size: the member count, or a stored size column."""
    size = F.col(size_col) if size_col else member_total()
    return with_share(grouped_count(matrix.select(size.alias("hh_size")), ["hh_size"]), tiny=True)


def size_by_count(
    matrix: DataFrame, column: str, values: Sequence[int], size: Column | None = None, open_top: bool = False
) -> DataFrame:
    """Size x number of members of one code, with totals and a column for numbers that are not among
    `values`. With `open_top` the last value is an open class."""
    number = F.least(F.col(column), F.lit(values[-1])) if open_top else F.col(column)
    sized = matrix.select((member_total() if size is None else size).alias("hh_size"), number.alias("_count"))
    return crosstab(sized, "hh_size", "_count", values)


def single_member_bands(matrix: DataFrame, size_col: str | None = None) -> DataFrame:
    """Band distribution of one-member entities, bands without any included."""
    size = F.col(size_col) if size_col else member_total()
    return with_share(column_totals(matrix.where(size == 1), count_names()), tiny=True)


def runs_label(runs: Column) -> Column:
    """As `pattern_label`, from run lengths."""
    text = F.transform(
        runs, lambda run: F.concat(F.coalesce(run["code"].cast("string"), F.lit("?")), F.lit("{"), run["n"].cast("string"), F.lit("}"))
    )
    return F.array_join(text, "+")


def sparse_patterns(rows: DataFrame, keys: Sequence[str], code: str, by: Sequence[str] = ()) -> DataFrame:
    """Patterns of any codes by entity size (within `by`, which is among the keys): hh_size, pattern, n, p.

    The pattern is compared by its codes and counts, not by its label. Totals per size are joined back.
    """
    counted = with_share(grouped_count(run_lengths(rows, keys, code), [*by, "hh_size", "runs"]), by=[*by, "hh_size"])
    return counted.select(*by, "hh_size", runs_label(F.col("runs")).alias("pattern"), "n", "p")
