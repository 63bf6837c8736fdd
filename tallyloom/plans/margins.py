"""From published cross-tabs to tidy counts and conditional shares.

Published sheets are wide, label a block only on its first row, print a dash for zero, carry
subtotals and hold numbers as text. Sheets arrive with an `ord` column: their row order.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..functions.text import bracket_digit, cell_count, coarser, recode, retype
from ..operators.aggregate import grouped_sum, with_share
from ..operators.columns import drop_subtotals
from ..operators.ordered import SHEET, fill_down
from ..schemas import MEMBER_COLUMNS, SIZE_COLUMNS


def band_margin(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Persons and share per ten-year band, overall or within `by`."""
    return with_share(grouped_sum(counts, [*by, "age"], "n"), by=by, tiny=True)


def band_pairs_margin(counts: DataFrame, code5: str = "age5_code") -> DataFrame:
    """Persons and share per ten-year band from five-year codes 1, 2, ..."""
    return band_margin(counts.withColumn("age", coarser(F.col(code5))))


def size_margin(counts: DataFrame) -> DataFrame:
    """Share of each household size."""
    return with_share(counts, tiny=True).select("hh_size", "p")


def head_margin(sheet: DataFrame) -> DataFrame:
    """Share of each head-age label within a household size, from columns 1..6."""
    codes = {label: code for code, label in enumerate(K.HEAD_LABELS, start=1)}
    long = sheet.unpivot(["head_age"], list(SIZE_COLUMNS), "_size", "n")
    tidy = long.select(
        F.col("_size").cast("int").alias("hh_size"),
        "head_age",
        recode(F.col("head_age"), codes).alias("head_code"),
        "n",
    )
    return with_share(tidy, by=["hh_size"], tiny=True)


def type_margin(
    sheet: DataFrame, heads: Sequence[str] = K.HEAD_LABELS, label: str = "sex", types: Sequence[int] | None = None
) -> DataFrame:
    """Share of each dwelling type given head age and size.

    Kept rows are those of the subtotal over `label` with a real head age. They come in blocks, one for each
    type; within a block the head ages come in the order of `heads`, so a new block begins where that
    order starts over. A block that lacks a head age, or has another one, is an error.

    The sheet does not name its blocks: `types` are their codes in order, and a sheet with another number of blocks
    is an error, as a type that is not there would shift the others. Without `types` the blocks count from 1.
    """
    filled = fill_down(sheet, "ord", label, segments=SHEET).where(F.col(label) == K.SUBTOTAL_LABEL).drop(label)
    kept = drop_subtotals(filled, ["head_age"])
    place = F.array_position(F.array(*[F.lit(h) for h in heads]), F.col("head_age"))
    rows = Window.orderBy("ord")  # a published sheet
    starts = F.coalesce((place <= F.lag(place).over(rows)).cast("int"), F.lit(1))
    typed = kept.withColumn("_starts", starts).withColumn("_type", F.sum("_starts").over(rows).cast("int"))
    found = F.count_if(place > 0).over(Window.partitionBy("_type"))
    whole = (found == len(heads)) & (F.count(F.lit(1)).over(Window.partitionBy("_type")) == len(heads))
    message = F.concat(F.lit("block "), F.col("_type").cast("string"), F.lit(" of the sheet is not complete"))
    code = F.col("_type")
    if types is not None:
        blocks = F.max("_type").over(Window.partitionBy())
        wrong = F.concat(F.lit(f"{len(types)} blocks are expected, the sheet has "), blocks.cast("string"))
        listed = F.get(F.array(*[F.lit(t) for t in types]), code - 1)
        code = F.when(blocks == len(types), listed).otherwise(F.raise_error(wrong).cast("int"))
    typed = typed.withColumn("hh_type", F.when(whole, code).otherwise(F.raise_error(message).cast("int")))
    typed = typed.drop("_starts", "_type", "ord")
    long = typed.unpivot(["head_age", "hh_type"], list(SIZE_COLUMNS), "_size", "_cell")
    tidy = long.select(
        F.col("_size").cast("int").alias("hh_size"),
        "head_age",
        "hh_type",
        cell_count(F.col("_cell")).alias("n"),
    )
    return conditional_type_share(tidy)


def conditional_type_share(counts: DataFrame) -> DataFrame:
    """Add the guarded share of each type within head age and size (also the data of a stacked chart)."""
    return with_share(counts, by=["head_age", "hh_size"], guarded=True, tiny=True)


def type_totals(margin: DataFrame) -> DataFrame:
    """Dwellings and share per type."""
    return with_share(grouped_sum(margin, ["hh_type"], "n"), tiny=True)


def member_margin(sheet: DataFrame, name: str) -> DataFrame:
    """Share of dwellings with 0..3 such members, given type and size; zero cells are dropped, cells that
    are no number stay with a missing share."""
    filled = drop_subtotals(fill_down(sheet, "ord", "hh_type", segments=SHEET), ["hh_size", "hh_type"])
    digits = filled.withColumn("hh_type", bracket_digit(F.col("hh_type"))).drop("ord")
    long = digits.unpivot(["hh_type", "hh_size"], list(MEMBER_COLUMNS), name, "_cell")
    size = recode(F.col("hh_size"), {K.OPEN_SIZE_LABEL: str(K.OPEN_SIZE)}, keep_unmatched=True)
    tidy = long.select(
        retype(F.col("hh_type"), "int").alias("hh_type"),
        retype(size, "int").alias("hh_size"),
        F.col(name).cast("int").alias(name),
        cell_count(F.col("_cell")).alias("n"),
    )
    return member_count_share(tidy).drop("n")


def member_count_share(counts: DataFrame) -> DataFrame:
    """Positive cells with their share within type and size; a cell that could not be read stays, with a
    missing share."""
    kept = counts.where((F.col("n") > 0) | F.col("n").isNull())
    shared = with_share(kept, by=["hh_type", "hh_size"], guarded=True, tiny=True)
    return shared.withColumn("p", F.when(F.col("n").isNotNull(), F.col("p")))
