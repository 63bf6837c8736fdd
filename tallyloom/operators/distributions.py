"""Operators on distributions: tables of (keys, outcome, p).

`small=True`, the default, says that keys and outcomes are category codes with a fixed bound.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import recode
from .aggregate import with_share
from .columns import join_back
from .ordered import running_totals


def joint(
    first: DataFrame, second: DataFrame, keys: Sequence[str], allowed: Column, p: str = "p", small: bool = True
) -> DataFrame:
    """Joint law of two independent outcomes given that `allowed` holds, renormalised by key.

    The same law as redrawing both until `allowed` holds, without the loop. Outcomes are codes of
    fixed categories (counts 0..3 in census tables), so a key has a fixed number of pairs.
    """
    pairs = join_back(first, second.withColumnRenamed(p, "_p2"), keys, "inner", small=small).where(allowed)
    product = pairs.withColumn("_pp", F.col(p) * F.col("_p2")).drop(p, "_p2")
    return with_share(product, "_pp", keys, name=p, tiny=small).drop("_pp")


def exclude(
    dist: DataFrame, keys: Sequence[str], excluded: Column, p: str = "p", small: bool = True
) -> DataFrame:
    """Drop outcomes by rule and renormalise within each key."""
    kept = dist.where(~F.coalesce(excluded, F.lit(False))).withColumnRenamed(p, "_p")
    return with_share(kept, "_p", keys, name=p, tiny=small).drop("_p")


def rebin(
    dist: DataFrame,
    keys: Sequence[str],
    outcome: str,
    codes: Mapping | Column,
    name: str,
    p: str = "p",
    small: bool = True,
) -> DataFrame:
    """Map outcomes to coarser codes (a table or an expression), add up, renormalise by key."""
    coarse = codes if isinstance(codes, Column) else recode(F.col(outcome), codes)
    summed = dist.groupBy(*keys, coarse.alias(name)).agg(F.sum(p).alias("_p"))
    return with_share(summed, "_p", keys, name=p, tiny=small).drop("_p")


def split(
    dist: DataFrame, outcome: str, parts: Mapping[int, Mapping[int, float]], p: str = "p"
) -> DataFrame:
    """Spread one code over finer ones by weight: parts[code] = {finer: weight}.

    Codes without an entry stay. Shares of equal finer codes are not merged; `rebin` does that.
    """
    spread = None
    for code, weights in parts.items():
        whole = sum(weights.values())
        cells = F.array(
            *[
                F.struct(F.lit(fine).alias("code"), F.lit(w / whole).alias("w"))
                for fine, w in weights.items()
            ]
        )
        test = F.col(outcome) == code
        spread = F.when(test, cells) if spread is None else spread.when(test, cells)
    same = F.array(F.struct(F.col(outcome).cast("int").alias("code"), F.lit(1.0).alias("w")))
    whole_rows = same if spread is None else spread.otherwise(same)
    others = [c for c in dist.columns if c not in (outcome, p)]
    return dist.select(*others, F.col(p).alias("_p"), F.inline(whole_rows)).select(
        *others, F.col("code").alias(outcome), (F.col("_p") * F.col("w")).alias(p)
    )


def joint_marginal(
    first: DataFrame, second: DataFrame, keys: Sequence[str], outcome: str, other: str, bound: Column, p: str = "p"
) -> DataFrame:
    """The first outcome's law given that the sum of both, whole numbers, is at most `bound` (of keys): keys, outcome, p.

    The marginal of the joint law without its pairs: each share is weighed by the second law's running total at the largest
    outcome that the bound leaves. Both tables are put in one order and added up once, in segments, so a key
    may have any number of outcomes. Shares count to 15 places, added as decimals.
    """
    exact = F.col(p).cast("decimal(30,15)")
    none = F.lit(0).cast("decimal(30,15)")
    # At equal places the second law's own rows come first.
    steps = second.select(*keys, F.col(other).cast("bigint").alias("_at"), F.lit(0).alias("_asks"), F.lit(None).cast(first.schema[outcome].dataType).alias(outcome), exact.alias("_step"), none.alias("_share"))
    asks = first.select(*keys, (bound - F.col(outcome)).cast("bigint").alias("_at"), F.lit(1).alias("_asks"), outcome, none.alias("_step"), exact.alias("_share"))
    stacked = steps.groupBy(*keys, "_at", "_asks", outcome).agg(F.sum("_step").cast("decimal(30,15)").alias("_step"), F.max("_share").alias("_share"))
    totals = running_totals(stacked.unionByName(asks), ("_at", "_asks", outcome), ["_step"], by=keys)
    weighed = totals.where("_asks = 1").select(*keys, outcome, (F.col("_share").cast("double") * F.col("run__step").cast("double")).alias("_pp"))
    return with_share(weighed.where("_pp > 0"), "_pp", keys, name=p).drop("_pp")
