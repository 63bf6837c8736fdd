"""Groups of rows compared inside tasks: large groups cut into pairs of blocks, rows streamed by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def block_pairs(rows: DataFrame, key: str, spread: str, size: int) -> DataFrame:
    """`rows` dealt so that one task compares one pair of blocks, without rows of a group meeting.

    Adds _unit (group and pair of blocks) and _side (0: first block, 1: second one; -1: the block
    with itself). A group of at most `size` rows is one block. A larger one is cut by the hash of
    `spread` into blocks of about `size` rows, and each row is sent to the pairs of its block.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    cut = rows.join(sizes, key).withColumn("_k", F.ceil(F.col("_n") / size).cast("int"))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64(spread), F.col("_k")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return cut.select(
        *rows.columns,
        F.xxhash64(key, low, high).alias("_unit"),
        F.when(F.col("_own") == F.col("_other"), -1).when(F.col("_own") == low, 0).otherwise(1).alias("_side"),
    )


def by_unit(df: DataFrame) -> DataFrame:
    """Rows of a unit together and in order, ready for `groups`."""
    return df.repartition("_unit").sortWithinPartitions("_unit")


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal `key` in sorted batches, as one table each; a run may span batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            if held and values[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = values[start]
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a, b, positions: bool = False) -> tuple:
    """Links (a, b), indices below n, that connect what all the given ones connect, at most n - 1 of them; of links
    that would do, those given earlier. Rounds of hooking to the smallest label, numpy work throughout.
    With `positions`, where the links stand among the given ones."""
    import numpy as np

    label, kept, at = np.arange(n), [], np.arange(len(a))
    while len(at):
        la, lb = label[a[at]], label[b[at]]
        apart = la != lb
        at, la, lb = at[apart], la[apart], lb[apart]
        if not len(at):
            break
        # Each label but the smallest of its surroundings is hooked by one of its links.
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        hooked, first = np.unique(high, return_index=True)
        kept.append(at[first])
        target = np.arange(n)
        target[hooked] = low[first]
        while True:
            further = target[target]
            if (further == target).all():
                break
            target = further
        label = target[label]
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return kept if positions else (a[kept], b[kept])
