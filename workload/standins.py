"""What stands for dwellings, members and published sheets on the given tables."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom import constants as K
from tallyloom.functions.numeric import open_top
from tallyloom.operators.aggregate import grouped_sum
from tallyloom.operators.reshape import count_matrix, member_total, to_long

SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_quantity DOUBLE, l_returnflag STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING",
}
TYPE_CODES = (1, 2, 3, 4, 5)
SIZE_CLASSES = tuple(range(1, K.OPEN_SIZE + 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _code(width: int) -> Column:
    return (F.floor((F.col("l_quantity") - 1) / width) + 1).cast("int")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per member: hid, age (band 1..9), age5_code (1..17), flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hid"),
        _code(6).alias("age"),
        _code(3).alias("age5_code"),
        F.col("l_returnflag").alias("flag"),
    )


def roster(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """Wide roster of all members, or of those with one flag (the sample population)."""
    rows = members(spark, sf_dir)
    return count_matrix(rows.where(F.col("flag") == flag) if flag else rows, ["hid"], "age")


def size_class() -> Column:
    """Size with the open top class."""
    return open_top(member_total(), K.OPEN_SIZE).cast("int")


def dwellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dwelling: hid, hh_type, head_age, custkey, worth."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hid"),
        F.regexp_extract("o_orderpriority", r"^(\d)", 1).cast("int").alias("hh_type"),
        F.col("o_orderstatus").alias("head_age"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("worth"),
    )


def sized_dwellings(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Dwellings with their size class and their counts of band 1 and of bands 7 to 9 (0..3)."""
    counts = roster(spark, sf_dir).select(
        "hid",
        size_class().alias("hh_size"),
        F.least("b1", F.lit(3)).cast("int").alias("child"),
        F.least(F.col("b7") + F.col("b8") + F.col("b9"), F.lit(3)).cast("int").alias("elder"),
    )
    return dwellings(spark, sf_dir).join(counts, "hid", how)


def dwelling_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dwellings counted by every attribute the margins use: at most a few thousand rows.

    All margins are sums of these cells, so queries that need several of them join and aggregate
    the tables once and share that shuffle.
    """
    return (
        sized_dwellings(spark, sf_dir)
        .withColumn("sex", F.when(F.col("worth") < 250000, "Lower").otherwise("Upper"))
        .groupBy("hh_type", "sex", "head_age", "hh_size", "child", "elder")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dwellings per size class, head and type, absent types as 0."""
    wide = count_matrix(
        dwelling_cells(spark, sf_dir), ["hh_size", "head_age"], "hh_type", TYPE_CODES, weight="n", prefix="t"
    )
    return to_long(
        wide, ["hh_size", "head_age"], TYPE_CODES, "t", positive=False, code="hh_type", value="n"
    )


def member_counts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Dwellings per type, size class and number of `name` members."""
    return grouped_sum(dwelling_cells(spark, sf_dir), ["hh_type", "hh_size", name], "n")


def head_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dwelling its type, its realised size class and one of the ten published head-age labels."""
    labels = F.array(*[F.lit(label) for label in K.HEAD_LABELS])
    sizes = roster(spark, sf_dir).select("hid", size_class().alias("hh_size"))
    label = F.get(labels, (F.col("custkey") % len(K.HEAD_LABELS)).cast("int"))
    return dwellings(spark, sf_dir).select("hid", "hh_type", label.alias("head_age")).join(sizes, "hid")


def head_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published sheet of dwellings by head-age label, sizes as columns 1..6."""
    cells = head_labels(spark, sf_dir).groupBy("head_age", "hh_size").agg(F.count(F.lit(1)).alias("n"))
    sheet = count_matrix(cells, ["head_age"], "hh_size", SIZE_CLASSES, weight="n", prefix="s")
    return sheet.select("head_age", *[F.col(f"s{s}").alias(str(s)) for s in SIZE_CLASSES])


def _printed(cell: Column) -> Column:
    return F.when(cell == 0, F.lit(K.NIL_CELL)).otherwise(cell.cast("string"))


def type_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published sheet: blocks of type, group and head with subtotals, block labels on the first
    row only, sizes as columns, dashes for zero."""
    counted_cells = dwelling_cells(spark, sf_dir)
    cells = count_matrix(
        counted_cells, ["hh_type", "sex", "head_age"], "hh_size", SIZE_CLASSES, weight="n", prefix="s"
    )
    sums = cells.groupingSets(
        [["hh_type", "sex", "head_age"], ["hh_type", "sex"], ["hh_type", "head_age"], ["hh_type"]],
        "hh_type",
        "sex",
        "head_age",
    ).agg(
        F.grouping("sex").alias("_all_sex"),
        F.grouping("head_age").alias("_all_head"),
        *[F.sum(f"s{s}").cast("bigint").alias(f"s{s}") for s in SIZE_CLASSES],
    )
    sex = F.when(F.col("_all_sex") == 1, K.SUBTOTAL_LABEL).otherwise(F.col("sex"))
    head = F.when(F.col("_all_head") == 1, K.SUBTOTAL_LABEL).otherwise(F.col("head_age"))
    sex_rank = F.when(F.col("_all_sex") == 1, 3).when(F.col("sex") == "Lower", 1).otherwise(2)
    head_rank = (
        F.when(F.col("_all_head") == 1, 4)
        .when(F.col("head_age") == "F", 1)
        .when(F.col("head_age") == "O", 2)
        .otherwise(3)
    )
    return sums.select(
        (F.col("hh_type") * 100 + sex_rank * 10 + head_rank).cast("bigint").alias("ord"),
        F.when(head_rank == 1, sex).alias("sex"),
        head.alias("head_age"),
        *[_printed(F.col(f"s{s}")).alias(str(s)) for s in SIZE_CLASSES],
    )


def member_sheet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A published sheet of dwellings by type, size and number of `name` members."""
    cells = count_matrix(
        dwelling_cells(spark, sf_dir), ["hh_type", "hh_size"], name, range(4), weight="n", prefix="k"
    )
    sums = cells.rollup("hh_type", "hh_size").agg(
        F.grouping("hh_type").alias("_all_type"),
        F.grouping("hh_size").alias("_all_size"),
        *[F.sum(f"k{k}").cast("bigint").alias(f"k{k}") for k in range(4)],
    )
    size = (
        F.when(F.col("_all_size") == 1, K.SUBTOTAL_LABEL)
        .when(F.col("hh_size") == K.OPEN_SIZE, K.OPEN_SIZE_LABEL)
        .otherwise(F.col("hh_size").cast("string"))
    )
    kind = F.when(F.col("_all_type") == 1, K.SUBTOTAL_LABEL).otherwise(
        F.concat(F.lit("Dwellings of type ("), F.col("hh_type").cast("string"), F.lit(")"))
    )
    # The subtotal row opens its block and carries the label.
    return sums.select(
        (F.coalesce("hh_type", F.lit(99)) * 10 + F.when(F.col("_all_size") == 1, 0).otherwise(F.col("hh_size")))
        .cast("bigint")
        .alias("ord"),
        F.when(F.col("_all_size") == 1, kind).alias("hh_type"),
        size.alias("hh_size"),
        *[_printed(F.col(f"k{k}")).alias(str(k)) for k in range(4)],
    )


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per member with a code of many: hid, code (1..50; missing for some)."""
    rows = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_quantity") % 17 != 0, F.col("l_quantity").cast("int"))
    return rows.select(F.col("l_orderkey").alias("hid"), code.alias("code"))


def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for every dwelling, some of which no table knows: hid, label."""
    label = F.when(F.col("o_custkey") % 17 == 0, F.concat(F.lit("Unlisted "), F.col("o_custkey") % 5)).otherwise(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hid"), label.alias("label"))


def written_sheet(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the dwellings as a published text sheet: a line each, in order of their ids, without their number."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    path = f"{root.rstrip('/')}/sheet-{uuid.uuid4().hex}"
    dwellings(spark, sf_dir).select("hid", "hh_type", "head_age", "worth").orderBy("hid").write.csv(path)
    return path
