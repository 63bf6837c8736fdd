"""Coverage of a category domain."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .aggregate import CHUNK, gaps
from .columns import join_back


def never_seen(domain: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Domain members that were not observed, wherever in the domain they lie."""
    return join_back(domain, observed.select(*keys).distinct(), keys, "left_anti")


def unseen_codes(
    observed: DataFrame, code: str, by: Sequence[str], first: int = 1, segments: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Codes from `first` to the largest one of all groups that a group lacks. Groups that have no code from `first` on
    are not there.

    They lie between the codes that the group has, so the domain is not made and no join looks for what is not in it; one
    row per group, one beyond the largest code, closes the last gap.
    """
    known = observed.where(F.col(code) >= first).groupBy(*by, code).agg(F.lit(1).alias("_one")).drop("_one")
    beyond = known.agg(F.max(code)).scalar() + 1
    ends = known.select(*by).distinct().withColumn(code, beyond.cast(observed.schema[code].dataType))
    return gaps(known.unionByName(ends), code, by, first, segments, chunk)
