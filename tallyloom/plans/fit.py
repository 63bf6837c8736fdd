"""How close a sample's margins are to the population's."""

from pyspark.sql import DataFrame, functions as F

from ..constants import BAND_CODES
from ..operators.aggregate import column_totals, grouped_count
from ..operators.compare import fit_report, report, side_by_side, squared_error
from ..operators.reshape import count_names, member_total, other_name

DIGITS = {"hh_size": 4, "age": 3, "hh_type": 3}


def size_counts(matrix: DataFrame) -> DataFrame:
    """Dwellings per realised size (the member count, not a declared size)."""
    return grouped_count(matrix.select(member_total().alias("hh_size")).where("hh_size > 0"), ["hh_size"])


def band_counts(matrix: DataFrame) -> DataFrame:
    """Members per band."""
    return column_totals(matrix, count_names())


def band_counts_by_size(matrix: DataFrame) -> DataFrame:
    """Members per band within each realised household size, all sizes in one pass."""
    sized = matrix.withColumn("hh_size", member_total()).where("hh_size > 0")
    return column_totals(sized, count_names(), by=["hh_size"])


def two_sides(members: DataFrame, key: str, code: str, in_sample, codes=BAND_CODES) -> DataFrame:
    """Wide rosters of a population and of a sample of its members, stacked: sample, key, counts.

    Both are counted in one aggregate over one scan; entities without a member on a side are not on it.
    """
    names = [*count_names(codes), other_name()]
    known = F.coalesce(F.col(code).isin(*codes), F.lit(False))
    tests = [*[F.col(code) == c for c in codes], ~known]
    chosen = F.coalesce(in_sample, F.lit(False))
    sides = {"pop": F.lit(True), "smp": chosen}
    counted = members.groupBy(key).agg(
        *[F.count_if(test & side).alias(f"{label}_{name}") for label, side in sides.items() for test, name in zip(tests, names, strict=True)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(label == "smp").alias("sample"), *[F.col(f"{label}_{name}").alias(name) for name in names])
            for label in sides
        ]
    )
    return counted.select(key, F.inline(rows)).where(member_total(codes) > 0)


def size_fit(sides: DataFrame) -> DataFrame:
    counts = grouped_count(sides.select("sample", member_total().alias("hh_size")), ["sample", "hh_size"])
    return report(side_by_side(counts, ["hh_size"]), digits=DIGITS["hh_size"], tiny=True)


def band_fit(sides: DataFrame) -> DataFrame:
    counts = column_totals(sides, count_names(), by=["sample"])
    return report(side_by_side(counts, ["age"]), digits=DIGITS["age"], tiny=True)


def type_fit(sides: DataFrame, types: DataFrame, key: str) -> DataFrame:
    counts = grouped_count(types.join(sides.select(key, "sample"), key), ["sample", "hh_type"])
    return report(side_by_side(counts, ["hh_type"]), digits=DIGITS["hh_type"], tiny=True)


def band_fit_sides_by_size(sides: DataFrame) -> DataFrame:
    """As `band_fit_by_size`, from one table of both sides."""
    sized = sides.withColumn("hh_size", member_total())
    counts = column_totals(sized, count_names(), by=["sample", "hh_size"])
    return report(side_by_side(counts, ["hh_size", "age"]), by=["hh_size"], tiny=True)


def margin_fit(population: DataFrame, sample: DataFrame, category: str) -> DataFrame:
    """Shares side by side with the difference rounded as the category calls for."""
    return fit_report(population, sample, category, digits=DIGITS[category], tiny=True)


def band_fit_by_size(population: DataFrame, sample: DataFrame) -> DataFrame:
    """Band shares side by side within each household size. Sizes without members on a side have
    no shares there. The number of distinct sizes is at most the square root of twice the member
    count, which bounds the table."""
    return fit_report(population, sample, "age", by=["hh_size"], tiny=True)


def fit_summary(reports: dict[str, DataFrame]) -> DataFrame:
    """One squared error per margin."""
    parts = [
        squared_error(report).select(F.lit(margin).alias("margin"), "ss")
        for margin, report in reports.items()
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
