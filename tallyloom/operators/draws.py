"""Weighted draws: one outcome per row, with probability proportional to a weight.

A draw is an inverse-CDF range match: the row's uniform number falls into the cumulative interval
of one outcome. As a bare range condition that is a nested-loop join, and with only the
distribution's keys as join keys a popular key becomes a hot partition. So [0, 1) is cut into equal
cells, some for each shuffle partition, each interval is listed under the cells it touches, and rows
join on (keys, cell) with the exact interval test on top. Cells are uniform by construction: they salt
hot keys evenly over all tasks, and a row meets only the few outcomes of its own cell.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import clamp
from ..functions.uniform import normal, uniform
from .aggregate import grouped_sum
from .columns import join_back
from .ordered import running_totals
from .reshape import count_matrix, uncount

CELLS_PER_PARTITION = 4
LEAST_CELLS = 64
#: A distribution that is held as one array has fewer than two to this power of outcomes.
LARGEST_TABLE_BITS = 21


def intervals(
    dist: DataFrame, outcome: str, weight: str, keys: Sequence[str] = (), small: bool = False
) -> DataFrame:
    """Cumulative interval [lo, hi) of `total` for each outcome with a positive weight.

    A distribution holds one row per (keys, outcome). A small one takes a plain window per key.
    Otherwise the running totals follow the outcomes, codes or labels, in segments of about equal size, so
    that a key with very many outcomes is not one task.
    """
    exact = F.col(weight)
    if dict(dist.dtypes)[weight] in ("float", "double"):
        # In binary fractions a bound and the next one's start could come out apart, whatever the order.
        exact = exact.cast("decimal(30,15)")
    positive = dist.select(*keys, outcome, exact.alias("_weight")).where(F.col("_weight") > 0)
    if small:
        group = Window.partitionBy(*keys)
        upto = group.orderBy(outcome).rowsBetween(Window.unboundedPreceding, 0)
        summed = positive.withColumn("hi", F.sum("_weight").over(upto)).withColumn(
            "total", F.max("hi").over(group)
        )
    else:
        running = running_totals(positive, outcome, ["_weight"], by=keys).withColumnRenamed("run__weight", "hi")
        whole = F.sum("_weight").alias("total")
        if keys:
            summed = join_back(running, positive.groupBy(*keys).agg(whole), keys)
        else:
            summed = running.withColumn("total", positive.agg(whole).scalar())
    ends = {"lo": F.col("hi") - F.col("_weight"), "hi": F.col("hi"), "total": F.col("total")}
    return summed.select(*keys, outcome, *[end.cast("double").alias(name) for name, end in ends.items()])


def draw(
    rows: DataFrame,
    dist: DataFrame,
    outcome: str,
    weight: str,
    number: Column,
    keys: Sequence[str] = (),
    name: str | None = None,
    small: bool = False,
    cells: int | None = None,
) -> DataFrame:
    """Add the drawn outcome to every row; NULL where the row's keys have no positive weight.

    `number` is the row's uniform number, `keys` select the distribution, a missing key being one of its own.
    `small=True` broadcasts the distribution: set it where its codes come from a fixed domain. Otherwise AQE
    measures it. Weights that are fractions count to 15 places.
    """
    if cells is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = LEAST_CELLS if small else max(LEAST_CELLS, CELLS_PER_PARTITION * partitions)
    # One cell more on either side keeps rounding at a boundary from hiding the right interval;
    # the interval test below decides.
    first = F.greatest(F.lit(0), F.floor(F.col("lo") * cells / F.col("total")).cast("int") - 1)
    last = F.least(F.lit(cells - 1), F.ceil(F.col("hi") * cells / F.col("total")).cast("int"))
    listed = intervals(dist, outcome, weight, keys, small).select(
        *[F.col(key).alias(f"_d_{key}") for key in keys],
        F.col(outcome).alias("_outcome"),
        "lo",
        "hi",
        "total",
        F.explode(F.sequence(first, last)).alias("_d_cell"),
    )
    placed = rows.withColumn("_u", number).withColumn(
        "_cell", F.floor(F.col("_u") * cells).cast("int")
    )
    match = F.col("_cell") == F.col("_d_cell")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_d_{key}"))
    at = F.col("_u") * F.col("total")
    match = match & (at >= F.col("lo")) & (at < F.col("hi"))
    joined = placed.join(F.broadcast(listed) if small else listed, match, "left")
    return joined.select(*rows.columns, F.col("_outcome").alias(name or outcome))


def pick(weights: Mapping[int, int], number: Column) -> Column:
    """A draw from a fixed table of whole-number weights, as a plain expression."""
    whole = sum(weights.values())
    chosen, upto = None, 0
    *head, last = weights
    for outcome in head:
        upto += weights[outcome]
        test = number * whole < upto
        chosen = F.when(test, outcome) if chosen is None else chosen.when(test, outcome)
    return F.lit(last) if chosen is None else chosen.otherwise(last)


def bernoulli(probability: float | Column, number: Column) -> Column:
    """1 with the given probability, else 0."""
    return (number < probability).cast("int")


def whole_normal(
    *keys: Column | str, mean: float, sd: float, low, high, salt: str, seed: int = 0
) -> Column:
    """A normal draw rounded to a whole number and limited to low..high."""
    drawn = F.round(normal(*keys, mean=mean, sd=sd, salt=salt, seed=seed)).cast("int")
    return clamp(drawn, low, high)


def draw_members(
    rows: DataFrame, key: str, how_many: str, weights: Mapping[int, int], codes: Sequence[int], salt: str, seed: int = 0
) -> DataFrame:
    """`how_many` draws per row from a fixed table, as a wide roster of the rows that get any.

    The copy number is part of the hash key, so each copy has its own number.
    """
    copies = uncount(rows.select(key, how_many), how_many)
    drawn = copies.withColumn("age", pick(weights, uniform(key, "copy", salt=salt, seed=seed)))
    return count_matrix(drawn, [key], "age", codes)


def replicate_fit(
    rows: DataFrame,
    dist: DataFrame,
    outcome: str,
    weight: str,
    key: str,
    replicates: int,
    tolerance: float,
    salt: str,
    seed: int = 0,
    small: bool = False,
) -> DataFrame:
    """Seeded replicates of a draw with their squared error, and the first that fits.

    With `small=True` the distribution is one ordered array of bounds, in which every row looks up its drawn codes by
    halves; they are counted by (replicate, code) in the same task, and only those counts are shuffled. Otherwise
    each row is expanded to its replicates and drawn by join.
    """
    numbers = F.array(*[F.lit(r) for r in range(1, replicates + 1)])
    if small:
        ends = intervals(dist, outcome, weight, small=True)
        table = F.array_sort(F.collect_list(F.struct("hi", "total", F.col(outcome).alias("code"))))
        bounds = ends.agg(table.alias("_bounds")).scalar()
        placed = rows.select(key).withColumn("_bounds", bounds)

        def code_of(replicate: Column) -> Column:
            at = uniform(key, replicate, salt=salt, seed=seed) * F.get("_bounds", F.lit(0))["total"]
            return F.struct(replicate.alias("replicate"), _first_above(F.col("_bounds"), at)["code"].alias(outcome))

        drawn = placed.select(F.inline(F.transform(numbers, code_of))).where(F.col(outcome).isNotNull())
    else:
        expanded = rows.select(key).withColumn("replicate", F.explode(numbers))
        drawn = draw(expanded, dist, outcome, weight, uniform(key, "replicate", salt=salt, seed=seed))
    counted = drawn.groupBy("replicate", outcome).agg(F.count(F.lit(1)).alias("_drawn"))
    # Every outcome takes part in every replicate, drawn or not.
    target = grouped_sum(dist, [outcome], weight, "_wanted").withColumn("replicate", F.explode(numbers))
    none = F.lit(0).cast("bigint")
    stacked = (
        target.select("replicate", outcome, "_wanted", none.alias("_drawn"))
        .unionByName(counted.select("replicate", outcome, none.alias("_wanted"), "_drawn"))
        .groupBy("replicate", outcome)
        .agg(F.sum("_wanted").alias("_wanted"), F.sum("_drawn").alias("_drawn"))
    )
    if small:
        # All counts of a replicate are one row, of as many as the distribution has codes.
        cells = F.sort_array(F.collect_list(F.struct(F.col(outcome).alias("code"), "_drawn", "_wanted")))
        by_replicate = stacked.groupBy("replicate").agg(
            cells.alias("_cells"), F.sum("_drawn").alias("_all_drawn"), F.sum("_wanted").alias("_all_wanted")
        )
        gap = lambda c: c["_drawn"] / F.col("_all_drawn") - c["_wanted"] / F.col("_all_wanted")
        scored = by_replicate.select("replicate", F.aggregate("_cells", F.lit(0.0), lambda ss, c: ss + gap(c) * gap(c)).alias("ss"))
    else:
        # One pair of totals per replicate, read from the same columns as the counts so that both
        # share their shuffle.
        wholes = stacked.groupBy("replicate").agg(
            F.sum("_drawn").alias("_all_drawn"), F.sum("_wanted").alias("_all_wanted")
        )
        totalled = join_back(stacked, wholes, ["replicate"], small=True)
        gap = F.col("_drawn") / F.col("_all_drawn") - F.col("_wanted") / F.col("_all_wanted")
        scored = totalled.withColumn("_gap", gap).groupBy("replicate").agg(F.sum(F.col("_gap") * F.col("_gap")).alias("ss"))
    # One row per replicate from here on: a fixed, small number.
    first = F.min(F.when(F.col("ss") <= tolerance, F.col("replicate"))).over(Window.partitionBy())
    return scored.select(
        "replicate",
        "ss",
        (F.col("ss") <= tolerance).alias("fits"),
        F.coalesce(F.col("replicate") == first, F.lit(False)).alias("chosen"),
    )


def _first_above(bounds: Column, at: Column) -> Column:
    """The first interval of an ordered array that ends above `at`, by halves; NULL for an empty array."""
    bits = F.array(*[F.lit(1 << b) for b in reversed(range(LARGEST_TABLE_BITS))])
    used = F.filter(bits, lambda step: step <= F.size(bounds))

    def further(place: Column, step: Column) -> Column:
        end = F.get(bounds, place + step - 1)["hi"]
        return F.when(end <= at, place + step).otherwise(place)

    return F.get(bounds, F.aggregate(used, F.lit(0), further))
