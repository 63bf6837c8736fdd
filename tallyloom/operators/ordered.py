"""Operators that follow a row order: running totals, row numbers, fill-down, block labels.

The order may be of any columns that can be sorted: numbers, text, dates. It is cut into segments at tuples of
all of them, as many segments as there are shuffle partitions; so rows that share the leading value, a third of
the table perhaps, are cut by the further columns. The tuples come from a sample of bounded size that all parts
of the plan share. Each segment is folded on its own; the folds before a segment are added up over the segments
alone, at most as many rows per group as there are segments. So a table without groups, or a group with a third
of all rows, is as many tasks as the cluster has partitions, and small groups take the same path.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import join_back

# A spreadsheet holds at most 2**20 rows, so a published sheet takes a single window.
SHEET = 1

#: Rows of the sample for each segment. With 40 of them a segment's share is within half of the mean.
SAMPLED = 40

SUM = "sum"
LAST = "last"


def _in_window(kind: str, column: str, window) -> Column:
    if kind == SUM:
        return F.coalesce(F.sum(column).over(window), F.lit(0))
    return F.last(column, ignorenulls=True).over(window)


def _of_segment(kind: str, column: str, order: Column) -> Column:
    if kind == SUM:
        return F.sum(column)
    return F.max_by(column, F.when(F.col(column).isNotNull(), order))


def _then(kind: str, earlier: str, later: str) -> Column:
    if kind == SUM:
        return F.coalesce(F.col(earlier), F.lit(0)) + F.col(later)
    return F.coalesce(F.col(later), F.col(earlier))


def _splitters(df: DataFrame, by: Sequence[str], keys: Sequence[str], segments: int) -> Column:
    """segments - 1 tuples of the keys in order, evenly spread over a sample: the rows of least hash."""
    drawn = df.select(F.struct(*keys).alias("_key"), F.xxhash64(*by, *keys).alias("_hash")).orderBy("_hash", "_key")
    tuples = drawn.limit(SAMPLED * segments).agg(F.array_sort(F.collect_list("_key")).alias("_tuples"))
    places = F.array(*[F.lit(i / segments) for i in range(1, segments)])
    at = F.transform(places, lambda share: F.get("_tuples", F.floor(share * F.size("_tuples")).cast("int")))
    return tuples.select(at.alias("_splitters")).scalar()


def _segment(keys: Sequence[str], segments: int) -> Column:
    """How many of the splitters (in _bounds) are up to the row's keys, by halves. Missing keys sort first."""
    own = F.struct(*keys)
    steps = [1 << b for b in reversed(range(segments.bit_length()))]

    def further(place: Column, step: Column) -> Column:
        return F.when(F.get(F.col("_bounds"), place + step - 1) <= own, place + step).otherwise(place)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def in_segments(
    df: DataFrame, by: Sequence[str], keys: Sequence[str], segments: int, sample: DataFrame | None = None
) -> DataFrame:
    """Add _segment, the row's place among `segments` of about equal size in the order of the keys."""
    bounds = _splitters(df if sample is None else sample, by if sample is None else (), keys, segments)
    return df.withColumn("_bounds", bounds).withColumn("_segment", _segment(keys, segments)).drop("_bounds")


def _carry(
    df: DataFrame,
    by: Sequence[str],
    keys: str | Sequence[str],
    wanted: Mapping[str, tuple[str, str]],
    segments: int | None = None,
    end: int = 0,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Add each wanted column: the fold of its input over the rows of the group up to `end`, in the order of
    `keys`, which together are unique within a group.

    The segments are cut by the keys of `df`, or of `sample`, a table with the same keys that costs less to make.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if segments is None:
        segments = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    window = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, end)
    if segments <= 1:
        return df.withColumns({out: _in_window(kind, c, window) for out, (kind, c) in wanted.items()})

    cut = in_segments(df, by, keys, segments, sample)
    order = F.struct(*keys)
    totals = cut.groupBy(*by, "_segment").agg(
        *[_of_segment(kind, c, order).alias(f"_total_{out}") for out, (kind, c) in wanted.items()]
    )
    earlier = Window.partitionBy(*by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *by, "_segment", *[_in_window(kind, f"_total_{out}", earlier).alias(f"_before_{out}") for out, (kind, _) in wanted.items()]
    )
    inside = Window.partitionBy(*by, "_segment").orderBy(*keys).rowsBetween(Window.unboundedPreceding, end)
    local = cut.withColumns({f"_local_{out}": _in_window(kind, c, inside) for out, (kind, c) in wanted.items()})
    joined = join_back(local, before, [*by, "_segment"]) if by else local.join(before, "_segment", "left")
    return joined.withColumns(
        {out: _then(kind, f"_before_{out}", f"_local_{out}") for out, (kind, _) in wanted.items()}
    ).drop("_segment", *[f"_{part}_{out}" for out in wanted for part in ("before", "local")])


def running_totals(
    df: DataFrame,
    key: str | Sequence[str],
    columns: Sequence[str],
    by: Sequence[str] = (),
    prefix: str = "run_",
    segments: int | None = None,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums of integer or decimal columns in key order."""
    return _carry(df, by, key, {prefix + c: (SUM, c) for c in columns}, segments, sample=sample)


def row_numbers(
    df: DataFrame, key: str | Sequence[str], by: Sequence[str] = (), name: str = "row_number", segments: int | None = None
) -> DataFrame:
    """1, 2, 3, ... in key order, within each group of `by` or over the whole table."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return _carry(ones, by, key, {name: (SUM, "_one")}, segments).drop("_one")


def block_labels(df: DataFrame, number: str, each: int, name: str, blocks: int | None = None) -> DataFrame:
    """Label rows by position: `each` rows share a label; labels restart after `blocks`."""
    label = F.expr(f"(`{number}` - 1) div {each}")
    if blocks:
        label = label % blocks
    return df.withColumn(name, (label + 1).cast("int"))


def fill_down(
    df: DataFrame,
    key: str | Sequence[str],
    column: str,
    by: Sequence[str] = (),
    name: str | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Replace missing values by the last one before them in key order (in place unless `name`)."""
    filled = _carry(df, by, key, {"_filled": (LAST, column)}, segments)
    return filled.withColumn(name or column, F.col("_filled")).drop("_filled")


def value_before(
    df: DataFrame, key: str | Sequence[str], column: str, by: Sequence[str] = (), name: str = "before", segments: int | None = None
) -> DataFrame:
    """The last value that is not missing of the rows before, in key order."""
    return _carry(df, by, key, {name: (LAST, column)}, segments, end=-1)
