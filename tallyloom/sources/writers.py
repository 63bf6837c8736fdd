"""Writers."""

from pyspark.sql import Column, DataFrame, functions as F

from .readers import RUN_PARTS


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV, one file per partition. The row key is an ordinary column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_run(path: str, roster: DataFrame, types: DataFrame, steps: DataFrame) -> None:
    """Store one run (long roster, household types, fit steps) for `read_run`."""
    for part, df in zip(RUN_PARTS, (roster, types, steps), strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{part}")


def write_roster(roster: DataFrame, table: str, key: str, size: str = "hh_size", buckets: int = 64) -> None:
    """Store a roster as a table that is partitioned by size and bucketed and sorted by its key.

    Tables that are stored so join on the key without a shuffle, and a size reads its own files. Rows are dealt by
    (size, bucket), so a bucket of a size is one file.
    """
    bucket = F.expr(f"pmod(hash(`{key}`), {buckets})")
    dealt = roster.repartition(F.col(size), bucket)
    dealt.write.mode("overwrite").partitionBy(size).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def first_rows(df: DataFrame, *order: Column | str, n: int = 6) -> DataFrame:
    """The first n rows in a stated order (a top-n over partitions, not a full sort)."""
    return df.orderBy(*order).limit(n)
