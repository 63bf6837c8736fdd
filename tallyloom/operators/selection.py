"""Keeping running shares near a target: the drift monitor and its rates by stratum.

It reads a wide roster (one row per entity, integer counts per code) with a unique key.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FIRST_BASELINE
from ..functions.numeric import squared_distance, total
from .ordered import running_totals


def target_shares(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the share of each count column in the total over all columns."""
    sums = counts.agg(*[F.sum(c).alias(c) for c in columns])
    whole = total([F.col(c) for c in columns])
    return sums.select(*[(F.col(c) / whole).alias(c) for c in columns])


def _with_target(df: DataFrame, columns: Sequence[str], target: DataFrame | Sequence[float]) -> DataFrame:
    if isinstance(target, DataFrame):
        shares = target.select(F.array(*columns)).scalar()
    else:
        shares = F.array(*[F.lit(float(p)) for p in target])
    return df.withColumn("_target", shares)


def _distance(counts: Sequence[Column], columns: int) -> Column:
    """Squared distance of the counts' shares to the target; the first baseline if all are 0."""
    whole = total(counts)
    shares = [F.try_divide(count, whole) for count in counts]
    wanted = [F.get("_target", F.lit(i)) for i in range(columns)]
    return F.coalesce(squared_distance(wanted, shares), F.lit(FIRST_BASELINE))


def drift(
    matrix: DataFrame,
    key: str,
    columns: Sequence[str],
    target: DataFrame | Sequence[float],
    threshold: float = 0.0,
    by: Sequence[str] = (),
    segments: int | None = None,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Per entity in key order, over the table or within each stratum `by`: members so far, squared error so
    far, its change, and a flag.

    The error before an entity follows from the running totals less its own counts, so no lag over
    the whole table is needed; the running totals themselves are segmented (see `ordered`), by the
    keys of `sample` if it is given, a table that is cheaper to read than the roster is to make.
    """
    running = running_totals(matrix, key, columns, by, prefix="_run_", segments=segments, sample=sample)
    now = [F.col(f"_run_{c}") for c in columns]
    before = [F.col(f"_run_{c}") - F.col(c) for c in columns]
    measured = _with_target(running, columns, target).select(
        *by,
        key,
        total(now).cast("bigint").alias("n_so_far"),
        _distance(now, len(columns)).alias("ss"),
        _distance(before, len(columns)).alias("_ss_before"),
    )
    return measured.withColumn("change", F.col("ss") - F.col("_ss_before")).drop("_ss_before").withColumn(
        "exceeds", F.col("change") > threshold
    )


def acceptance(monitored: DataFrame, strata: Sequence[str], flag: str = "exceeds") -> DataFrame:
    """Entities below and above the threshold, and the rate of those below, per stratum."""
    return monitored.groupBy(*strata).agg(
        F.count_if(~F.col(flag)).alias("accepted"),
        F.count_if(F.col(flag)).alias("rejected"),
        F.avg((~F.col(flag)).cast("int")).alias("rate"),
    )
