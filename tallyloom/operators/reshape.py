"""Rosters in wide, long and one-row-per-member form.

The wide roster (one row per entity, one count column per code) is the working form. It comes from
a single aggregation with partial sums on the map side, so an entity that owns a third of all rows
costs no more than any other. Long form, member rows, numbered members and `age_1..age_k` columns
are then row-local expressions: none of them shuffles, and none gathers the rows of an entity.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import BAND_CODES
from ..functions.numeric import total

#: Copies that one task makes of a row before the rest goes to another.
CHUNK = 65536
OTHER = "other"


def count_names(codes: Sequence[int] = BAND_CODES, prefix: str = "b") -> list[str]:
    return [f"{prefix}{code}" for code in codes]


def other_name(prefix: str = "b") -> str:
    """The column that counts what has no known code, a missing one included."""
    return f"{prefix}_{OTHER}"


def count_matrix(
    rows: DataFrame,
    keys: Sequence[str],
    code: str,
    codes: Sequence[int] = BAND_CODES,
    weight: str | None = None,
    prefix: str = "b",
) -> DataFrame:
    """Members (or long counts, with `weight`) to one row per entity with a count per code, and last
    the count of members whose code is missing or not among `codes`, so that nobody is lost."""
    known = F.coalesce(F.col(code).isin(*codes), F.lit(False))
    tests = [*[F.col(code) == c for c in codes], ~known]
    if weight:
        cells = [F.coalesce(F.sum(F.when(test, F.col(weight))), F.lit(0)) for test in tests]
    else:
        cells = [F.count_if(test) for test in tests]
    named = [
        cell.cast("bigint").alias(name)
        for cell, name in zip(cells, [*count_names(codes, prefix), other_name(prefix)], strict=True)
    ]
    return rows.groupBy(*keys).agg(*named)


def member_total(codes: Sequence[int] = BAND_CODES, prefix: str = "b") -> Column:
    """Row-wise member count of a wide roster, members without a known code included."""
    return total([F.col(name) for name in [*count_names(codes, prefix), other_name(prefix)]])


def to_long(
    matrix: DataFrame,
    keys: Sequence[str],
    codes: Sequence[int] = BAND_CODES,
    prefix: str = "b",
    positive: bool = True,
    code: str = "age",
    value: str = "value",
) -> DataFrame:
    """Wide to long; cells that are not positive are dropped unless `positive=False`.

    Members without a known code, where there are any, are a row with a missing code.
    """
    named = dict(zip(count_names(codes, prefix), codes, strict=True))
    return long_from_names(matrix, keys, named, positive, code, value, other_name(prefix))


def long_from_names(
    matrix: DataFrame,
    keys: Sequence[str],
    names: Mapping[str, int],
    positive: bool = True,
    code: str = "age",
    value: str = "value",
    other: str | None = None,
) -> DataFrame:
    """Wide to long for count columns of any name: `names` gives the code of each. Cells of `other`,
    if it is named, get a missing code and are kept where positive."""
    cells = [F.struct(F.lit(c).cast("int").alias(code), F.col(name).alias(value)) for name, c in names.items()]
    kept = F.col(value) > 0
    if other:
        cells.append(F.struct(F.lit(None).cast("int").alias(code), F.col(other).alias(value)))
    long = matrix.select(*keys, F.inline(F.array(*cells)))
    if positive:
        return long.where(kept)
    return long.where(kept | F.col(code).isNotNull()) if other else long


def uncount(rows: DataFrame, weight: str, copy: str = "copy", chunk: int = CHUNK) -> DataFrame:
    """Repeat each row `weight` times, numbering the copies from 1; weights below 1 give no row.

    Every row is cut into chunks of at most `chunk` copies, and the chunks are dealt evenly before
    they are expanded: what is shuffled is one row per chunk, and a row that stands for a third of the
    output is shared among tasks.
    """
    count = F.col(weight).cast("bigint")
    one = F.lit(1).cast("bigint")
    starts = F.sequence(one, count, F.lit(chunk).cast("bigint"))
    # Of a stated number, as the few bytes of the chunks would be put back into one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.where(count > 0).withColumn("_start", F.explode(starts)).repartition(tasks, *rows.columns, "_start")
    end = F.least(count, F.col("_start") + (chunk - 1))
    return cut.withColumn(copy, F.explode(F.sequence(F.col("_start"), end))).drop("_start")


def members(
    matrix: DataFrame,
    keys: Sequence[str],
    codes: Sequence[int] = BAND_CODES,
    prefix: str = "b",
    chunk: int = CHUNK,
    names: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per member, numbered within the entity in code order: keys, pid, age.

    The number is the count in lower codes plus the copy number, so no window is needed. Members without
    a known code come last, with a missing age. `names` gives count columns of any name and their codes.
    """
    pairs = list(names.items()) if names else [*zip(count_names(codes, prefix), codes, strict=True), (other_name(prefix), None)]
    before = F.lit(0).cast("bigint")
    cells = []
    for name, code in pairs:
        cells.append(
            F.struct(F.lit(code).cast("int").alias("age"), before.alias("before"), F.col(name).alias("value"))
        )
        before = before + F.col(name)
    long = matrix.select(*keys, F.inline(F.array(*cells)))
    return uncount(long, "value", chunk=chunk).select(*keys, (F.col("before") + F.col("copy")).alias("pid"), "age")


def members_wide(
    matrix: DataFrame,
    keys: Sequence[str],
    width: int | None = None,
    codes: Sequence[int] = BAND_CODES,
    prefix: str = "b",
) -> DataFrame:
    """Columns age_1..age_<width> in code order beside the count columns, NULL beyond the entity's size.

    Without `width` it is the largest size there is, which is looked up first. With one, larger entities
    still have all their members in the count columns, and `n_over` counts those without an age column.
    """
    names = count_names(codes, prefix)
    size = member_total(codes, prefix)
    if width is None:
        width = matrix.agg(F.max(size).alias("n")).first()["n"] or 0
    pieces = [
        F.array_repeat(F.lit(code), F.least(F.col(name), F.lit(width)).cast("int"))
        for code, name in zip(codes, names, strict=True)
    ]
    counts = [*names, other_name(prefix)]
    listed = matrix.select(*keys, *counts, size.alias("hh_size"), F.flatten(F.array(*pieces)).alias("_members"))
    return listed.select(
        *keys,
        "hh_size",
        *[F.get("_members", F.lit(i)).alias(f"age_{i + 1}") for i in range(width)],
        *counts,
        F.greatest(F.col("hh_size") - width, F.lit(0)).cast("bigint").alias("n_over"),
    )


def run_lengths(rows: DataFrame, keys: Sequence[str], code: str, weight: str | None = None, name: str = "runs") -> DataFrame:
    """Members to one row per entity: its distinct codes in order, each with its count, and its size.

    For codes of any number and type. Members are counted by (entity, code) first, with partial sums, so an entity
    with a third of all rows is shuffled as its counts; only these are put together. Members without a code come last.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    counted = rows.groupBy(*keys, code).agg(count.cast("bigint").alias("_n")).where("_n > 0")
    cell = F.struct(F.col(code).isNull().alias("missing"), F.col(code).alias("code"), F.col("_n").alias("n"))
    cells = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("_cells"), F.sum("_n").alias("hh_size"))
    runs = F.transform("_cells", lambda cell: F.struct(cell["code"].alias("code"), cell["n"].alias("n")))
    return cells.select(*keys, runs.alias(name), "hh_size")


def member_at(runs: Column, position: Column) -> Column:
    """The code of the member at a position, from 1, read off the run lengths without listing the members; NULL beyond."""
    none = F.lit(0).cast("bigint")

    def past(state: Column, run: Column) -> Column:
        """Members in the runs so far, and how many of these runs end before the position."""
        upto = state["upto"] + run["n"]
        return F.struct(upto.alias("upto"), (state["at"] + (upto < position).cast("int")).alias("at"))

    at = F.aggregate(runs, F.struct(none.alias("upto"), F.lit(0).alias("at")), past)["at"]
    return F.when(position >= 1, F.get(runs, at)["code"])
