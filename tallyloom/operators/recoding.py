"""Codes for labels from a table.

`functions.text.recode` writes its codes into the plan; for thousands of labels they are a DataFrame.
"""

from pyspark.sql import DataFrame, functions as F

from .columns import join_back


def code_table(table: DataFrame, label: str, code: str) -> DataFrame:
    """(label, code) with every label once. A label with two codes is an error; rows that repeat are one."""
    found = table.groupBy(label).agg(F.min(code).alias(code), F.max(code).alias("_most"))
    message = F.concat(F.lit("two codes for the label "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
    kind = table.schema[code].dataType
    once = F.when(F.col(code).eqNullSafe(F.col("_most")), F.col(code)).otherwise(F.raise_error(message).cast(kind))
    return found.select(label, once.alias(code))


def recode_by_table(df: DataFrame, column: str, table: DataFrame, label: str, code: str, name: str) -> DataFrame:
    """Add the code of each row's label; NULL where the table lacks it. A missing label is a label.

    The table is joined as it is measured: broadcast if it is small, else both sides are dealt by label, and a popular label
    is split.
    """
    codes = code_table(table, label, code).select(F.col(label).alias("_label"), F.col(code).alias("_code"))
    joined = join_back(df.withColumn("_label", F.col(column)), codes, ["_label"])
    return joined.withColumn(name, F.col("_code")).select(*[c for c in df.columns if c != name], name)


def unmatched_labels(recoded: DataFrame, column: str, name: str) -> DataFrame:
    """Labels that got no code, and how many rows have them."""
    return recoded.where(F.col(name).isNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
