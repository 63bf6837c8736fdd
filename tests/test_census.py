"""Known totals and shares from the census counts, read from a CSV with CRLF line ends."""

import census
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.aggregate import grouped_sum, with_share
from tallyloom.plans import margins
from tallyloom.sources import census_counts


@pytest.fixture(scope="module")
def counts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("census") / "counts.csv"
    path.write_text(census.csv_text(), newline="")
    return census_counts(spark, str(path)).cache()


def test_reads_every_row_with_its_type(counts):
    assert counts.count() == 108
    assert dict(counts.dtypes) == {"hh_size": "int", "age5": "string", "age": "int", "n": "bigint"}
    assert counts.where(F.col("hh_size").isNull() | F.col("age").isNull() | F.col("n").isNull()).count() == 0


def test_totals_by_size(counts):
    rows = {r.hh_size: r.n for r in grouped_sum(counts, ["hh_size"], "n").collect()}
    assert tuple(rows[s] for s in range(1, 7)) == census.TOTALS


def test_band_shares_overall_and_by_size(counts):
    overall = {r.age: r.p for r in margins.band_margin(counts).collect()}
    assert [round(overall[a], 6) for a in range(1, 10)] == list(census.ALL_SHARES)
    by_size = {(r.hh_size, r.age): r.p for r in margins.band_margin(counts, ["hh_size"]).collect()}
    assert [round(by_size[1, a], 6) for a in range(1, 10)] == list(census.SIZE_1_SHARES)
    # The three population shares quoted in percent.
    assert round(100 * by_size[1, 6], 1) == 21.7
    assert (round(100 * by_size[2, 6], 1), round(100 * by_size[2, 7], 1)) == (18.6, 18.8)


def test_shares_of_each_size_sum_to_one(counts):
    shares = with_share(counts, by=["hh_size"]).groupBy("hh_size").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in shares)
