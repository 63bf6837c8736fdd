"""Comparing two margins and checking declared against actual counts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .columns import join_back


def paired(population: DataFrame, sample: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Both counts side by side by category; a category missing on one side counts 0 there.

    The sides are stacked and summed. Unlike a full outer join this needs one shuffle, keeps
    partial sums, and treats a NULL category as a category.
    """
    none = F.lit(0).cast("bigint")
    left = population.select(*keys, F.col(value).alias("n_pop"), none.alias("n_sample"))
    right = sample.select(*keys, none.alias("n_pop"), F.col(value).alias("n_sample"))
    return (
        left.unionByName(right)
        .groupBy(*keys)
        .agg(F.sum("n_pop").alias("n_pop"), F.sum("n_sample").alias("n_sample"))
    )


def side_by_side(counts: DataFrame, keys: Sequence[str], sample: str = "sample", value: str = "n") -> DataFrame:
    """As `paired`, for counts of both sides in one table; `sample` says which side a row is of."""
    sides = {"n_pop": ~F.col(sample), "n_sample": F.col(sample)}
    return counts.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(side, F.col(value))), F.lit(0)).cast("bigint").alias(name) for name, side in sides.items()]
    )


def fit_report(
    population: DataFrame,
    sample: DataFrame,
    category: str,
    by: Sequence[str] = (),
    digits: int = 4,
    tiny: bool = False,
) -> DataFrame:
    """Population share, sample share and rounded difference per category (within `by`).

    `tiny=True` is for categories with a fixed bound, as in `with_share`.
    """
    return report(paired(population, sample, [*by, category]), by, digits, tiny)


def report(both: DataFrame, by: Sequence[str] = (), digits: int = 4, tiny: bool = False) -> DataFrame:
    """As `fit_report`, for counts that stand side by side already."""
    wholes = [F.sum("n_pop").alias("pop"), F.sum("n_sample").alias("sample")]
    if tiny:
        group = Window.partitionBy(*by)
        joined = both.withColumn(
            "_whole",
            F.struct(F.sum("n_pop").over(group).alias("pop"), F.sum("n_sample").over(group).alias("sample")),
        )
    elif by:
        joined = join_back(both, both.groupBy(*by).agg(F.struct(*wholes).alias("_whole")), by)
    else:
        # One subquery for both totals reads the same columns as the report, so it reuses its shuffles.
        joined = both.withColumn("_whole", both.agg(F.struct(*wholes)).scalar())
    shares = {
        "p_pop": F.try_divide(F.col("n_pop"), F.col("_whole.pop")),
        "p_sample": F.try_divide(F.col("n_sample"), F.col("_whole.sample")),
    }
    return (
        joined.withColumns(shares)
        .drop("_whole")
        .withColumn("diff", F.round(F.col("p_sample") - F.col("p_pop"), digits))
    )


def squared_error(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of squared share differences (per group); unrounded shares are used."""
    gap = F.col("p_sample") - F.col("p_pop")
    return report.groupBy(*by).agg(F.sum(gap * gap).alias("ss"))


def member_gap(declared: DataFrame, members: DataFrame, key: str, size: str) -> DataFrame:
    """Declared size, counted members and the gap, for every declared key (0 if none counted)."""
    counted = members.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"))
    joined = declared.join(counted, key, "left").withColumn(
        "n_members", F.coalesce(F.col("n_members"), F.lit(0).cast("bigint"))
    )
    return joined.withColumn("n_missing", F.col(size) - F.col("n_members"))


def without_members(declared: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Declared keys that have no member. Keys are made distinct before the shuffle."""
    return declared.join(members.select(key).distinct(), key, "left_anti")
