"""Connected components of a table of links, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.shared import written


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component): for every id in links (a, b), the smallest id that it reaches.

    Each round hooks every root to the smallest root among its members' neighbours, then halves the
    paths to the roots, until nothing changes: O(log n) rounds. A popular id costs its links once
    in a pre-aggregated minimum; joins on a popular root are left to the skew-join rule. Each
    round is a written table. Links with a null end, and of an id to itself, connect nothing.
    """
    ends = links.where("a <> b").select("a", "b")
    both = written(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    lowest = both.groupBy("a").agg(F.min("b").alias("b"))
    roots = written(lowest.select(F.col("a").alias("id"), F.least("a", "b").alias("root")), "roots")
    for _ in range(rounds):
        near = (
            both.join(roots.select(F.col("id").alias("b"), F.col("root").alias("seen")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("seen").alias("seen"))
        )
        joined = roots.join(near, "id").select("id", "root", F.least("root", "seen").alias("low"))
        hooks = joined.groupBy(F.col("root").alias("id")).agg(F.min("low").alias("hook"))
        hooked = joined.join(hooks, "id", "left").select("id", F.least("low", "hook").alias("low"), F.col("root").alias("old"))
        up = hooked.select(F.col("id").alias("low"), F.col("low").alias("higher"))
        lifted = hooked.join(up, "low").select("id", F.col("higher").alias("root"), "old")
        after = written(lifted, "roots")
        changed = not after.where("root <> old").isEmpty()
        roots = after.select("id", "root")
        if not changed:
            return roots.withColumnRenamed("root", "component")
    raise RuntimeError(f"no stable components after {rounds} rounds")
