import pandas as pd
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.operators.ordered import row_numbers
from tallyloom.operators.reshape import count_matrix, to_long
from tallyloom.sources import first_rows, ordered_lines, read_block, read_range, read_run, stored_roster, write_csv, write_roster, write_run


def _matrix(spark):
    rows = [(1, 1), (1, 1), (1, 5), (2, 9), (3, 2), (3, 3)]
    return count_matrix(spark.createDataFrame(rows, "hid BIGINT, age INT"), ["hid"], "age")


def test_run_round_trip(spark, tmp_path):
    roster = to_long(_matrix(spark), ["hid"])
    types = spark.createDataFrame([(1, 2), (2, 7), (3, 1)], schemas.HOUSEHOLD_TYPE)
    steps = spark.createDataFrame([(1, 0.5), (2, 0.25)], schemas.FIT_STEPS)
    write_run(str(tmp_path / "run"), roster, types, steps)
    back = read_run(spark, str(tmp_path / "run"))
    for part, df in {"roster": roster, "types": types, "steps": steps}.items():
        assert back[part].dtypes == df.dtypes
        assert sorted(map(tuple, back[part].collect())) == sorted(map(tuple, df.collect()))


def test_csv_keeps_the_row_key(spark, tmp_path):
    matrix = _matrix(spark)
    write_csv(matrix, str(tmp_path / "roster"))
    back = spark.read.option("header", True).schema(schemas.ROSTER_WIDE).csv(str(tmp_path / "roster"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, matrix.collect()))


def test_block_is_named_by_position(spark, tmp_path):
    (tmp_path / "block.csv").write_text("0 - 24,1,2\n65+,3,4\n")
    schema = schemas.struct({"a": schemas.TEXT, "b": schemas.BIGINT, "c": schemas.BIGINT})
    block = read_block(spark, str(tmp_path / "block.csv"), schema, ["Age", "1", "2"])
    assert block.columns == ["Age", "1", "2"]
    assert sorted(map(tuple, block.collect())) == [("0 - 24", 1, 2), ("65+", 3, 4)]


def test_first_rows_follow_the_order(spark, plan_text):
    df = spark.range(100).withColumn("v", -F.col("id"))
    first = first_rows(df, "v", n=3)
    assert [r.id for r in first.collect()] == [99, 98, 97]
    assert "TakeOrderedAndProject" in plan_text(first)


def test_sequential_ids(spark):
    keys = pd.DataFrame({"k": [5, 1, 900, 44, 7]})
    numbered = row_numbers(spark.createDataFrame(keys), "k", name="hid")
    assert {r.k: r.hid for r in numbered.collect()} == {1: 1, 5: 2, 7: 3, 44: 4, 900: 5}


def test_lines_are_numbered_through_splits_and_files(spark, tmp_path):
    lines = [f"{i},name {i % 7}" + "x" * (i % 23) for i in range(5000)]
    for part, (a, b) in enumerate([(0, 1200), (1200, 1200), (1200, 4000), (4000, 5000)]):
        (tmp_path / f"part-{part}.csv").write_text("".join(line + "\n" for line in lines[a:b]))
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "64")
        numbered = ordered_lines(spark, str(tmp_path))
        assert numbered.rdd.getNumPartitions() >= 4
        assert [r.line for r in numbered.orderBy("ord").collect()] == lines
        assert [r["ord"] for r in numbered.orderBy("ord").collect()] == list(range(1, 5001))
        schema = schemas.struct({"a": schemas.BIGINT, "b": schemas.TEXT})
        block = read_range(spark, str(tmp_path), schema, (1190, 1210), ["a"])
        assert sorted(map(tuple, block.collect())) == [(i, i - 1) for i in range(1190, 1211)]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_stored_rosters_join_without_a_shuffle(spark, tmp_path, plan_text):
    matrix = _matrix(spark).withColumn("hh_size", F.col("b1") + F.col("b2") + F.col("b3") + F.col("b5") + F.col("b9"))
    names = ["roster_a", "roster_b"]
    try:
        for name in names:
            write_roster(matrix, name, "hid", buckets=4)
        a, b = (stored_roster(spark, name) for name in names)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = a.select("hid", "b1").join(b.select("hid", F.col("b9").alias("n9")), "hid")
        assert sorted(map(tuple, joined.collect())) == [(1, 2, 0), (2, 0, 1), (3, 0, 0)]
        assert "Exchange" not in plan_text(joined)
        couples = stored_roster(spark, "roster_a", size=2)
        assert [r.hid for r in couples.collect()] == [3]
        assert "PartitionFilters: [isnotnull(hh_size" in plan_text(couples)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
