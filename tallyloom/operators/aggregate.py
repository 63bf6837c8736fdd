"""Counts, shares and cross-tabulations."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import TOTAL_LABEL
from .columns import join_back
from .ordered import value_before

#: Codes of a gap that one task makes before the rest goes to another.
CHUNK = 65536
WHOLE = ("tinyint", "smallint", "int", "bigint")


def grouped_sum(df: DataFrame, by: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).cast("bigint").alias(name or value))


def grouped_count(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def with_share(
    df: DataFrame,
    value: str = "n",
    by: Sequence[str] = (),
    name: str = "p",
    guarded: bool = False,
    tiny: bool = False,
    small: bool = False,
) -> DataFrame:
    """Add each row's share of its group's total, or of the grand total without `by`.

    `tiny=True` is for tables of counted categories, whose rows have a fixed bound: one window, one
    pass over whatever made the table. Otherwise totals are aggregated with partial sums and joined
    back (the grand total is a scalar subquery, so there is no cross join), and a group with a
    third of the rows is not pulled into one task. `small=True` broadcasts those totals: set it
    where the number of groups has a fixed bound.

    `guarded` gives 0 where the value is not positive; otherwise a total of 0 gives NULL.
    """
    if tiny:
        wide, whole = df, F.sum(value).over(Window.partitionBy(*by))
    elif by:
        totals = df.groupBy(*by).agg(F.sum(value).alias("_whole"))
        wide = join_back(df, totals, by, small=small)
        whole = F.col("_whole")
    else:
        wide, whole = df, df.agg(F.sum(value)).scalar()
    share = F.try_divide(F.col(value), whole)
    if guarded:
        share = F.when(F.col(value) > 0, share).otherwise(F.lit(0.0))
    return wide.withColumn(name, share).drop("_whole")


def zero_filled(df: DataFrame, domain: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Counts with a 0 for every domain member that was not counted; counts outside it are kept."""
    zeros = domain.select(*keys, F.lit(0).cast("bigint").alias(value))
    return grouped_sum(df.select(*keys, value).unionByName(zeros), keys, value)


def gaps(
    codes: DataFrame, name: str, by: Sequence[str] = (), first: int = 1, segments: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """The codes from `first` on that are not among `codes` (distinct whole numbers, per group) but lie below one that is.

    Each code makes the ones between it and its predecessor. A gap is cut into chunks, which are dealt to the tasks
    before they are expanded, so a gap of a hundred million codes is many bounded pieces.
    """
    kind = codes.schema[name].dataType
    start = F.lit(first - 1).cast("bigint")
    known = codes.where(F.col(name) >= first).select(*by, F.col(name).cast("bigint").alias("_to"))
    placed = value_before(known, "_to", "_to", by, "_from", segments)
    open_ = placed.withColumn("_from", F.coalesce("_from", start) + 1).where(F.col("_from") < F.col("_to"))
    starts = F.sequence(F.col("_from"), F.col("_to") - 1, F.lit(chunk).cast("bigint"))
    # Of a stated number, as the few bytes of the chunks would be put back into one task.
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = open_.withColumn("_start", F.explode(starts)).repartition(tasks, *by, "_start")
    end = F.least(F.col("_to") - 1, F.col("_start") + (chunk - 1))
    made = cut.select(*by, F.explode(F.sequence(F.col("_start"), end)).alias(name))
    return made.withColumn(name, F.col(name).cast(kind))


def code_domain(df: DataFrame, name: str, first: int = 1, segments: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Codes from `first` to the largest one that the column `name` of `df` has, as a table."""
    known = df.where(F.col(name) >= first).select(name).distinct()
    return known.unionByName(gaps(known, name, (), first, segments, chunk))


def gap_filled(
    counts: DataFrame, name: str, value: str = "n", by: Sequence[str] = (), first: int = 1, segments: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Counts per code with a 0 for every code from `first` that was not counted, up to the largest of the group."""
    zeros = gaps(counts, name, by, first, segments, chunk).withColumn(value, F.lit(0).cast(counts.schema[value].dataType))
    return counts.select(*by, name, value).unionByName(zeros)


def column_totals(
    matrix: DataFrame, columns: Sequence[str], by: Sequence[str] = (), code: str = "age", prefix: str = "b"
) -> DataFrame:
    """Total of each count column as rows (by.., code, n), with zero totals kept.

    Sums are taken before the reshape, so only one row per group is unpivoted.
    """
    sums = matrix.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    long = sums.unpivot(list(by), list(columns), "_name", "n")
    return long.select(*by, F.substring("_name", len(prefix) + 1, 10).cast("int").alias(code), "n")


def crosstab(
    df: DataFrame,
    row: str,
    column: str,
    values: Sequence[int],
    weight: Column | None = None,
    prefix: str = "c",
    margins: bool = True,
) -> DataFrame:
    """Rows x declared column values, absent cells 0, and a column for all other values (a missing one
    too), so that a row adds up; `margins` adds a total column and row.

    Cells are summed first, so the totals row expands the small table and not the input.
    """
    one = F.lit(1) if weight is None else weight
    cells = df.groupBy(row, column).agg(F.sum(one).alias("_n"))
    by_row = cells.rollup(row) if margins else cells.groupBy(row)
    counts = [
        F.coalesce(F.sum(F.when(F.col(column) == v, F.col("_n"))), F.lit(0)).cast("bigint").alias(f"{prefix}{v}")
        for v in values
    ]
    listed = F.coalesce(F.col(column).isin(*values), F.lit(False))
    rest = F.coalesce(F.sum(F.when(~listed, F.col("_n"))), F.lit(0)).cast("bigint")
    counts.append(rest.alias(f"{prefix}_other"))
    if not margins:
        return by_row.agg(*counts)
    wide = by_row.agg(F.grouping(row).alias("_is_total"), *counts, F.sum("_n").cast("bigint").alias("total"))
    label = F.when(F.col("_is_total") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col(row).cast("string"))
    return wide.withColumn(row, label).drop("_is_total")


def cube_margins(df: DataFrame, dims: Sequence[str], weight: Column | None = None, name: str = "n") -> DataFrame:
    """Counts for every combination of the dimensions' values and every margin over them, in long form: dims, level, n.

    `level` is the grouping id: bit i, from the right, is 1 where the i-th dimension from the right is summed over (it is
    NULL then); a missing value is a value. Cells are summed before they are expanded, so the expansion meets the
    small table and not the input. The values come from the data; combinations without a row count 0.
    """
    one = F.lit(1) if weight is None else weight
    cells = df.groupBy(*dims).agg(F.sum(one).cast("bigint").alias(name))
    level = F.grouping_id().cast("int").alias("level")
    sums = cells.cube(*dims).agg(level, F.sum(name).cast("bigint").alias(name))
    # One row holds the distinct values of each dimension, and unfolds to the grid without a join.
    one_of = {d: F.collect_set(F.struct(F.lit(0).alias("total"), F.col(d).alias("value"))).alias(d) for d in dims}
    grid = cells.agg(*one_of.values())
    for i, d in enumerate(dims):
        none = F.struct(F.lit(1).alias("total"), F.lit(None).cast(cells.schema[d].dataType).alias("value"))
        values = F.when(F.size(d) > 0, F.array_append(F.col(d), none))
        grid = grid.withColumn(d, F.explode(values))
    bits = [F.col(f"{d}.total") * (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole + bit
    zeros = grid.select(*[F.col(f"{d}.value").alias(d) for d in dims], whole.cast("int").alias("level"), F.lit(0).cast("bigint").alias(name))
    return grouped_sum(sums.unionByName(zeros), [*dims, "level"], name)


def spread_of_group(
    df: DataFrame, by: Sequence[str], value: str, name: str = "variance", digits: int | None = None
) -> DataFrame:
    """Sample variance per group; NULL for a single row. Values of a fractional type are taken to `digits` places.

    It is taken from whole-number sums. A merged running variance depends on the merge order in its last bits, which
    would let a threshold test change with the partitioning. For fractions the squares are taken about a whole number of
    units of the last place, so that nothing large cancels; 10^10 rows of values up to 10^13 units fit in.
    """
    kind = dict(df.dtypes)[value]
    if kind in WHOLE:
        x = F.col(value).cast("bigint")
        sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(x).alias("_sum"), F.sum(x * x).alias("_squares"))
        n, one, squares = (F.col(c).cast("decimal(19,0)") for c in ("n", "_sum", "_squares"))
        numerator = (n * squares - one * one).cast("double")
        variance = F.try_divide(numerator, (n * (n - 1)).cast("double"))
        return sums.select(*by, "n", variance.alias(name))
    if digits is None:
        raise TypeError(f"{value} is {kind}: say to how many digits it counts")
    # A fraction goes by its decimal text, so that 0.29 is 29 hundredths.
    x = (F.round(F.col(value).cast("decimal(38,12)"), digits) * F.lit(10**digits)).cast("decimal(18,0)")
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(x).alias("_sum"), F.sum((x * x).cast("decimal(28,0)")).alias("_squares"))
    n, whole = F.col("n").cast("decimal(18,0)"), F.col("_sum").cast("decimal(28,0)")
    mean = F.floor(F.try_divide(F.col("_sum").cast("double"), F.col("n").cast("double"))).cast("decimal(18,0)")
    # Squares about a whole number near the mean, exact, and how far that number is off in sum.
    off = (whole - (n * mean).cast("decimal(36,0)")).cast("decimal(28,0)")
    about = F.col("_squares") - mean * (whole + off).cast("decimal(28,0)")
    spread = about.cast("double") - F.try_divide(off.cast("double") * off.cast("double"), F.col("n").cast("double"))
    variance = F.try_divide(spread, (F.col("n") - 1).cast("double")) / F.lit(float(10**digits) ** 2)
    return sums.select(*by, "n", variance.alias(name))
