"""Readers. Every schema is declared by the caller or in `schemas`."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from .. import schemas
from ..constants import AGE5_LABELS, OPEN_SIZE, OPEN_SIZE_LABEL
from ..functions.text import coarser, recode

RUN_PARTS = ("roster", "types", "steps")


def read_block(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    names: Sequence[str] | None = None,
    fmt: str = "csv",
    **options: str,
) -> DataFrame:
    """A headerless block exported from a sheet; `names` renames its columns by position."""
    block = spark.read.format(fmt).options(**options).schema(schema).load(path)
    return block.toDF(*names) if names else block


def ordered_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(ord, line): the lines of text files, numbered from 1 through the files in the order of their paths.

    Lines are counted by split, the counts are added up over the splits alone, and a line's place within its split is
    the distance of its id to the split's least one: Spark gives ids one after the other as it reads a split. So no
    task reads more than its splits. Neither files nor settings may change between the two passes.
    """
    read = spark.read.options(**options).text(path)
    lines = read.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    before = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = lines.join(before, ["_file", "_start"])
    return numbered.select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("ord"), "line")


def read_range(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    rows: tuple[int, int],
    columns: Sequence[str] | None = None,
    sep: str = ",",
) -> DataFrame:
    """A range of an exported sheet, as cell ranges are read from a workbook: `ord` (the row's number in the sheet), and the
    columns of `schema` by position, of which `columns` are kept, for the rows from the first to the last of `rows`.

    A record is a line; cells that do not parse are NULL.
    """
    first, last = rows
    lines = ordered_lines(spark, path).where(F.col("ord").between(first, last))
    names = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    parsed = lines.select("ord", F.from_csv("line", names, {"sep": sep}).alias("_cells"))
    return parsed.select("ord", *[F.col(f"_cells.`{c}`").alias(c) for c in columns or schema.names])


def census_counts(spark: SparkSession, path: str) -> DataFrame:
    """Persons by household size and five-year age: hh_size, age5, age (ten-year code), n."""
    raw = (
        spark.read.option("header", True)
        .option("ignoreTrailingWhiteSpace", True)
        .schema(schemas.CENSUS_COUNTS)
        .csv(path)
    )
    size = recode(F.col("size_label"), {OPEN_SIZE_LABEL: str(OPEN_SIZE)}, keep_unmatched=True)
    code5 = recode(F.col("age5"), {label: code for code, label in enumerate(AGE5_LABELS, start=1)})
    return raw.select(
        size.try_cast("int").alias("hh_size"), "age5", coarser(code5).alias("age"), "n"
    )


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts stored by `write_run`."""
    declared = {
        "roster": schemas.ROSTER_LONG,
        "types": schemas.HOUSEHOLD_TYPE,
        "steps": schemas.FIT_STEPS,
    }
    return {part: spark.read.schema(declared[part]).parquet(f"{path}/{part}") for part in RUN_PARTS}


def stored_roster(spark: SparkSession, table: str, size: int | None = None) -> DataFrame:
    """The roster stored by `write_roster`, or the entities of one size, of which only those files are read."""
    stored = spark.table(table)
    return stored if size is None else stored.where(F.col("hh_size") == size)
