"""Registered queries: (spark, sf_dir) -> DataFrame. Each reads whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyloom import constants as K
from tallyloom.functions.numeric import clamp
from tallyloom.functions.text import band_label, bracket_digit, cell_count, coarser, recode
from tallyloom.functions.uniform import uniform
from tallyloom.operators import aggregate, checks, compare, distributions, draws, ordered, relatives, reshape
from tallyloom.operators import recoding, selection
from tallyloom.operators.columns import all_but, starting_with
from tallyloom.plans import fit, margins, patterns
from tallyloom.sources import first_rows, read_block, read_range

from . import standins as S

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

BANDS = reshape.count_names()
SAMPLE_FLAG = "R"
SHARE_DIGITS = 6
ERROR_DIGITS = 9
DRIFT_THRESHOLD = 0.0
REPLICATES = 8
REPLICATE_TOLERANCE = 0.00003


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def rounded(df: DataFrame, *columns: str, digits: int = SHARE_DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns or ("p",)})


# Patterns and sizes


@register
def patterns_by_size(spark, sf_dir):
    return rounded(patterns.ranked_patterns(S.roster(spark, sf_dir)))


@register
def top_patterns(spark, sf_dir):
    return rounded(patterns.top_patterns(S.roster(spark, sf_dir), 3))


@register
def most_frequent_patterns(spark, sf_dir):
    return rounded(patterns.most_frequent(S.roster(spark, sf_dir), 20))


@register
def patterns_two_populations(spark, sf_dir):
    matrix = reshape.count_matrix(S.members(spark, sf_dir), ["flag", "hid"], "age")
    counted = patterns.pattern_counts(matrix.withColumnRenamed("flag", "population"), ["population"])
    return rounded(patterns.labelled(counted, ["population"]))


def _stored(spark, sf_dir):
    """A roster with a stored size that need not agree with its members."""
    return S.roster(spark, sf_dir).withColumn("declared", F.col("hid") % 6 + 1)


@register
def patterns_stored_size(spark, sf_dir):
    return rounded(patterns.ranked_patterns(_stored(spark, sf_dir), size_col="declared"))


@register
def populations_stacked(spark, sf_dir):
    members = S.members(spark, sf_dir)
    rosters = {"all": members, "sample": members.where(F.col("flag") == SAMPLE_FLAG)}
    return rounded(patterns.compare_populations(rosters, "hid", "age"))


@register
def patterns_wide(spark, sf_dir):
    return reshape.members_wide(S.roster(spark, sf_dir), ["hid"])


@register
def patterns_any_code(spark, sf_dir):
    return rounded(patterns.sparse_patterns(S.quantities(spark, sf_dir), ["hid"], "code"))


@register
def members_array(spark, sf_dir):
    """Members in code order as run lengths, and some of them read by position."""
    found = reshape.run_lengths(S.quantities(spark, sf_dir), ["hid"], "code")
    places = {"first": F.lit(1), "middle": F.expr("(hh_size + 1) div 2"), "last": F.col("hh_size"), "tenth": F.lit(10)}
    return found.select(
        "hid",
        "hh_size",
        patterns.runs_label(F.col("runs")).alias("runs"),
        *[reshape.member_at(F.col("runs"), place).alias(name) for name, place in places.items()],
    )


@register
def size_distribution(spark, sf_dir):
    return rounded(patterns.size_distribution(S.roster(spark, sf_dir)))


@register
def stored_size_distribution(spark, sf_dir):
    sized = S.roster(spark, sf_dir).withColumn("declared", S.size_class())
    return rounded(patterns.size_distribution(sized, "declared"))


@register
def sizes_zero_filled(spark, sf_dir):
    counted = fit.size_counts(S.roster(spark, sf_dir)).withColumn("hh_size", F.col("hh_size").cast("int"))
    return aggregate.gap_filled(counted, "hh_size")


@register
def worth_gaps(spark, sf_dir):
    """Dwellings per hundred of worth, and the hundreds that no dwelling of the type has."""
    worth = F.floor(F.col("worth") / 100).cast("bigint")
    counted = aggregate.grouped_count(S.dwellings(spark, sf_dir).select("hh_type", worth.alias("hundreds")), ["hh_type", "hundreds"])
    return aggregate.gap_filled(counted, "hundreds", by=["hh_type"])


@register
def size_by_band1_margins(spark, sf_dir):
    matrix = S.roster(spark, sf_dir)
    return patterns.size_by_count(matrix, "b1", range(K.OPEN_SIZE + 1))


@register
def single_member_bands(spark, sf_dir):
    return rounded(patterns.single_member_bands(S.roster(spark, sf_dir)))


@register
def single_member_stored(spark, sf_dir):
    return rounded(patterns.single_member_bands(_stored(spark, sf_dir), "declared"))


# Roster shapes


@register
def roster_matrix(spark, sf_dir):
    return S.roster(spark, sf_dir)


@register
def roster_long(spark, sf_dir):
    return reshape.to_long(S.roster(spark, sf_dir), ["hid"])


@register
def long_from_names(spark, sf_dir):
    codes = {f"a_{10 * (c - 1)}_{10 * c - 1}": c for c in K.BAND_CODES}
    matrix = S.roster(spark, sf_dir).withColumnsRenamed(dict(zip(BANDS, codes)))
    return reshape.long_from_names(matrix, ["hid"], codes, other=reshape.other_name())


@register
def roster_block(spark, sf_dir):
    """The sheet reader on a table that has no header, columns named by position."""
    names = ["hid", "quantity", "flag"]
    block = read_block(spark, f"{sf_dir}/lineitem.parquet", S.SCHEMAS["lineitem"], names, "parquet")
    return aggregate.grouped_count(block, ["flag"]).withColumnRenamed("n", "n_rows")


@register
def roster_rebuilt(spark, sf_dir):
    long = reshape.to_long(S.roster(spark, sf_dir), ["hid"])
    return reshape.count_matrix(long, ["hid"], "age", weight="value")


@register
def roster_persons(spark, sf_dir):
    return reshape.members(S.roster(spark, sf_dir), ["hid"])


@register
def roster_sizes(spark, sf_dir):
    matrix = S.roster(spark, sf_dir)
    sized = matrix.withColumn("hh_size", reshape.total([F.col(c) for c in starting_with(matrix, "B")]))
    return sized.select(*all_but(sized, *BANDS[1:]))


@register
def couples_of_two(spark, sf_dir):
    typed = S.sized_dwellings(spark, sf_dir)
    chosen = typed.where((F.col("hh_size") == 2) & F.col("hh_type").isin(*K.TYPES_WITH_COUPLE))
    return chosen.select("hid", "hh_type", "hh_size")


@register
def first_rosters(spark, sf_dir):
    return first_rows(S.roster(spark, sf_dir), "hid", n=6)


# Margins


@register
def margin_type_given_head_size(spark, sf_dir):
    return rounded(margins.conditional_type_share(S.type_counts(spark, sf_dir)))


@register
def margin_type_from_sheet(spark, sf_dir):
    return rounded(margins.type_margin(S.type_sheet(spark, sf_dir), heads=("F", "O", "P"), types=S.TYPE_CODES))


@register
def margin_head_from_sheet(spark, sf_dir):
    return rounded(margins.head_margin(S.head_sheet(spark, sf_dir)))


@register
def margin_head_given_size(spark, sf_dir):
    counted = aggregate.grouped_sum(S.dwelling_cells(spark, sf_dir), ["hh_size", "head_age"], "n")
    return rounded(aggregate.with_share(counted, by=["hh_size"], tiny=True))


@register
def margins_cube(spark, sf_dir):
    cells = S.dwelling_cells(spark, sf_dir)
    return aggregate.cube_margins(cells, ["hh_type", "head_age", "hh_size"], F.col("n"))


@register
def margin_type(spark, sf_dir):
    return rounded(margins.type_totals(S.type_counts(spark, sf_dir)))


@register
def margin_size(spark, sf_dir):
    return rounded(margins.size_margin(fit.size_counts(S.roster(spark, sf_dir))))


@register
def margin_band_pairs(spark, sf_dir):
    counts = aggregate.grouped_count(S.members(spark, sf_dir), ["age5_code"])
    return rounded(margins.band_pairs_margin(counts))


@register
def margin_band_by_size(spark, sf_dir):
    counts = fit.band_counts_by_size(S.roster(spark, sf_dir))
    return rounded(margins.band_margin(counts, by=["hh_size"]))


@register
def margin_child(spark, sf_dir):
    return rounded(margins.member_margin(S.member_sheet(spark, sf_dir, "child"), "child"))


@register
def margin_elder(spark, sf_dir):
    return rounded(margins.member_margin(S.member_sheet(spark, sf_dir, "elder"), "elder"))


# Cleaning and row order


@register
def clean_cells(spark, sf_dir):
    label = F.when(F.col("hid") % 5 == 0, F.col("head_age")).otherwise(
        F.concat(F.lit("Type ("), F.col("hh_type").cast("string"), F.lit(")"))
    )
    cell = (
        F.when(F.col("hid") % 7 == 0, F.lit(K.NIL_CELL))
        .when(F.col("hid") % 11 == 0, F.lit("n.a."))
        .otherwise(F.floor("worth").cast("bigint").cast("string"))
    )
    codes = {"F": "1", "O": "2"}
    band = (F.col("hid") % 18 + 1).cast("int")
    return S.dwellings(spark, sf_dir).select(
        "hid",
        bracket_digit(label).alias("digit"),
        cell_count(cell).alias("n"),
        recode(F.col("head_age"), codes).alias("code"),
        recode(F.col("head_age"), codes, keep_unmatched=True).alias("code_or_label"),
        coarser(band).alias("age"),
        band_label(coarser(band)).alias("age_label"),
    )


def _purchases(spark, sf_dir):
    purchase = F.when(F.col("event_type") == "purchase", F.col("value"))
    return S.table(spark, sf_dir, "events").select("ts", "event_id", "user_id", purchase.alias("last_purchase"))


IN_TIME = ("ts", "event_id")


@register
def fill_down(spark, sf_dir):
    return ordered.fill_down(_purchases(spark, sf_dir), IN_TIME, "last_purchase", by=["user_id"]).drop("ts")


@register
def fill_down_table(spark, sf_dir):
    return ordered.fill_down(_purchases(spark, sf_dir), IN_TIME, "last_purchase").drop("ts")


@register
def fill_down_by_name(spark, sf_dir):
    """Text keys: the last balance that is not negative, by name within the nation."""
    rows = S.table(spark, sf_dir, "customer")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("last_balance")
    named = rows.select("c_name", "c_nationkey", "c_custkey", balance)
    return ordered.fill_down(named, ("c_name", "c_custkey"), "last_balance", by=["c_nationkey"])


@register
def fill_down_ties(spark, sf_dir):
    """A third of the events have one time, some have none."""
    noon = F.lit("2020-01-01 12:00:00").cast("timestamp_ntz")
    ts = F.when(F.col("event_id") % 3 == 0, noon).when(F.col("event_id") % 10 != 1, F.col("ts"))
    tied = _purchases(spark, sf_dir).withColumn("ts", ts)
    return ordered.fill_down(tied, IN_TIME, "last_purchase").drop("ts", "user_id")


@register
def sheet_with_order(spark, sf_dir):
    """Rows of a text sheet from the 19th on, by their number in it, and two of its columns."""
    path = S.written_sheet(spark, sf_dir)
    schema = StructType.fromDDL("hid BIGINT, hh_type INT, head_age STRING, worth DOUBLE")
    return read_range(spark, path, schema, (19, 1 << 62), ["hid", "head_age"])


@register
def recode_by_table(spark, sf_dir):
    names = S.table(spark, sf_dir, "customer").select("c_name", F.col("c_nationkey").alias("code"))
    return recoding.recode_by_table(S.customer_names(spark, sf_dir), "label", names, "c_name", "code", "code")


@register
def recode_unmatched(spark, sf_dir):
    return recoding.unmatched_labels(recode_by_table(spark, sf_dir), "label", "code")


@register
def member_numbers(spark, sf_dir):
    events = S.table(spark, sf_dir, "events").select("event_id", "user_id")
    return ordered.row_numbers(events, "event_id", by=["user_id"], name="pid")


@register
def row_ids(spark, sf_dir):
    keys = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hid"))
    numbered = ordered.row_numbers(keys, "hid", name="row_id")
    labelled = ordered.block_labels(numbered, "row_id", 18, "block")
    return ordered.block_labels(labelled, "row_id", 10, "block_of_8", blocks=8)


# Fit


def _sides(spark, sf_dir):
    """Population and sample, counted side by side in one pass over the members."""
    return fit.two_sides(S.members(spark, sf_dir), "hid", "age", F.col("flag") == SAMPLE_FLAG)


def _size_report(spark, sf_dir):
    return fit.size_fit(_sides(spark, sf_dir))


def _band_report(spark, sf_dir):
    return fit.band_fit(_sides(spark, sf_dir))


def _type_report(spark, sf_dir):
    return fit.type_fit(_sides(spark, sf_dir), S.dwellings(spark, sf_dir).select("hid", "hh_type"), "hid")


@register
def fit_size(spark, sf_dir):
    return rounded(_size_report(spark, sf_dir), "p_pop", "p_sample")


@register
def fit_band(spark, sf_dir):
    return rounded(_band_report(spark, sf_dir), "p_pop", "p_sample")


@register
def fit_type(spark, sf_dir):
    return rounded(_type_report(spark, sf_dir), "p_pop", "p_sample")


@register
def fit_errors(spark, sf_dir):
    reports = {
        "hh_size": _size_report(spark, sf_dir),
        "age": _band_report(spark, sf_dir),
        "hh_type": _type_report(spark, sf_dir),
    }
    return rounded(fit.fit_summary(reports), "ss", digits=ERROR_DIGITS)


def _by_size(spark, sf_dir):
    return fit.band_fit_sides_by_size(_sides(spark, sf_dir))


@register
def fit_band_by_size(spark, sf_dir):
    return rounded(_by_size(spark, sf_dir), "p_pop", "p_sample")


@register
def fit_band_by_size_errors(spark, sf_dir):
    errors = compare.squared_error(_by_size(spark, sf_dir), by=["hh_size"])
    return rounded(errors, "ss", digits=ERROR_DIGITS)


@register
def fit_two_tables(spark, sf_dir):
    """Customers by nation against suppliers by nation, two tables that are counted on their own."""
    customers = aggregate.grouped_count(S.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), ["nation"])
    suppliers = aggregate.grouped_count(S.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"])
    return rounded(compare.fit_report(customers, suppliers, "nation"), "p_pop", "p_sample")


@register
def shortfall(spark, sf_dir):
    declared = S.dwellings(spark, sf_dir).select("hid", (F.col("hid") % 6 + 1).alias("declared"))
    return compare.member_gap(declared, S.members(spark, sf_dir), "hid", "declared")


@register
def no_members(spark, sf_dir):
    return compare.without_members(
        S.dwellings(spark, sf_dir).select("hid"), S.members(spark, sf_dir), "hid"
    )


@register
def group_variance(spark, sf_dir):
    spread = aggregate.spread_of_group(S.members(spark, sf_dir), ["hid"], "age")
    variance = F.round("variance", SHARE_DIGITS)
    kind = (
        F.when(F.col("variance").isNull(), "single")
        .when(F.col("variance") > K.SIBLING_VARIANCE, "apart")
        .otherwise("close")
    )
    return spread.select(
        "hid", "n", variance.alias("variance"), kind.alias("kind"), clamp(F.col("n"), 2, 4).alias("n_clamped")
    )


@register
def price_variance(spark, sf_dir):
    """Variance of fractions, by customer."""
    spread = aggregate.spread_of_group(S.dwellings(spark, sf_dir), ["custkey"], "worth", digits=2)
    return rounded(spread, "variance", digits=2)


# Draws and distributions


@register
def draw_weighted(spark, sf_dir):
    keys = S.dwellings(spark, sf_dir).select("hid")
    dist = aggregate.grouped_count(S.members(spark, sf_dir), ["age"])
    return draws.draw(keys, dist, "age", "n", uniform("hid", salt="band", seed=1), small=True)


@register
def draw_conditional(spark, sf_dir):
    rows = S.sized_dwellings(spark, sf_dir, "left").select("hid", "head_age", "hh_size")
    dist = S.type_counts(spark, sf_dir)
    number = uniform("hid", salt="type", seed=1)
    return draws.draw(rows, dist, "hh_type", "n", number, keys=["hh_size", "head_age"], small=True)


@register
def draw_fixed(spark, sf_dir):
    number = uniform("hid", salt="elder", seed=1)
    return S.dwellings(spark, sf_dir).select("hid", draws.pick(K.HEAD_OPEN_SPLIT, number).alias("age"))


@register
def draw_bernoulli(spark, sf_dir):
    number = uniform("hid", salt="gap", seed=1)
    return S.dwellings(spark, sf_dir).select(
        "hid", draws.bernoulli(1 - K.SAME_BAND_PARTNER, number).alias("gap")
    )


@register
def draw_normal(spark, sf_dir):
    mean, sd = K.BIRTH_GAP
    drawn = draws.whole_normal("hid", mean=mean, sd=sd, low=K.BIRTH_GAP_MIN, high=9, salt="birth", seed=1)
    return S.dwellings(spark, sf_dir).select("hid", drawn.alias("age"))


@register
def draw_repeat(spark, sf_dir):
    rows = S.dwellings(spark, sf_dir).select("hid", (F.col("hid") % 4).alias("n_elder"))
    return draws.draw_members(rows, "hid", "n_elder", K.ELDER_WEIGHTS, tuple(K.ELDER_WEIGHTS), "elders", 1)


def _member_shares(spark, sf_dir, name):
    return margins.member_count_share(S.member_counts(spark, sf_dir, name)).drop("n")


@register
def dist_joint(spark, sf_dir):
    allowed = F.col("child") + F.col("elder") < F.col("hh_size")
    child, elder = (_member_shares(spark, sf_dir, name) for name in ("child", "elder"))
    return rounded(distributions.joint(child, elder, ["hh_type", "hh_size"], allowed))


@register
def dist_joint_marginals(spark, sf_dir):
    """The child counts' law of `dist_joint`, without its pairs."""
    child, elder = (_member_shares(spark, sf_dir, name) for name in ("child", "elder"))
    return rounded(distributions.joint_marginal(child, elder, ["hh_type", "hh_size"], "child", "elder", F.col("hh_size") - 1))


def _type_shares(spark, sf_dir):
    return margins.conditional_type_share(S.type_counts(spark, sf_dir)).drop("n")


@register
def dist_exclude(spark, sf_dir):
    rule = (F.col("head_age") == "P") & F.col("hh_type").isin(*K.TYPES_WITH_PARENTS)
    return rounded(distributions.exclude(_type_shares(spark, sf_dir), ["head_age", "hh_size"], rule))


def _band5_shares(spark, sf_dir):
    counts = aggregate.grouped_count(S.members(spark, sf_dir), ["age5_code"])
    return aggregate.with_share(counts, tiny=True).drop("n")


@register
def dist_rebin(spark, sf_dir):
    shares = _band5_shares(spark, sf_dir)
    return rounded(distributions.rebin(shares, [], "age5_code", coarser(F.col("age5_code")), "age"))


@register
def dist_rebin_by_type_size(spark, sf_dir):
    """Head-age labels as bands of other members, by type and size, the top band split evenly."""
    keys = ["hh_type", "hh_size"]
    counted = aggregate.grouped_count(S.head_labels(spark, sf_dir), [*keys, "head_age"])
    shares = aggregate.with_share(counted, by=keys, tiny=True).drop("n")
    coarse = distributions.rebin(shares, keys, "head_age", K.OTHER_MEMBER_BANDS, "age")
    return rounded(distributions.split(coarse, "age", {8: K.OTHER_TOP_SPLIT}))


@register
def dist_split(spark, sf_dir):
    shares = distributions.rebin(
        _band5_shares(spark, sf_dir), [], "age5_code", F.least(coarser(F.col("age5_code")), F.lit(8)), "age"
    )
    return rounded(distributions.split(shares, "age", {8: K.OTHER_TOP_SPLIT}))


@register
def recode_head(spark, sf_dir):
    labels = F.array(*[F.lit(label) for label in K.HEAD_LABELS])
    label = F.get(labels, (F.col("custkey") % len(K.HEAD_LABELS)).cast("int"))
    labelled = S.dwellings(spark, sf_dir).select("hid", label.alias("head_age"))
    return labelled.withColumn("head_code", relatives.head_band(F.col("head_age"), "hid", seed=1))


@register
def derived_age(spark, sf_dir):
    heads = S.dwellings(spark, sf_dir).select("hid", (F.col("hid") % 7 + 3).cast("int").alias("head"))
    with_partner = heads.withColumn("partner", relatives.partner_band(F.col("head"), "hid", seed=1))
    return with_partner.withColumns(
        {
            "child": relatives.child_band(F.col("partner"), "hid", seed=1),
            "parent": relatives.parent_band(F.col("head"), "hid", seed=1),
        }
    )


# Checks, drift and selection


@register
def coverage(spark, sf_dir):
    sized = reshape.count_matrix(S.members(spark, sf_dir), ["flag", "hid"], "age").select(
        "flag", reshape.member_total().alias("hh_size")
    )
    return checks.unseen_codes(sized, "hh_size", ["flag"])


@register
def replicate_fit(spark, sf_dir):
    keys = S.dwellings(spark, sf_dir).select("hid")
    dist = fit.size_counts(S.roster(spark, sf_dir))
    fitted = draws.replicate_fit(keys, dist, "hh_size", "n", "hid", REPLICATES, REPLICATE_TOLERANCE, salt="size", seed=1, small=True)
    return rounded(fitted, "ss", digits=ERROR_DIGITS)


@register
def drift_monitor(spark, sf_dir):
    matrix = S.roster(spark, sf_dir)
    target = selection.target_shares(matrix, BANDS)
    return selection.drift(matrix, "hid", BANDS, target, DRIFT_THRESHOLD, sample=S.dwellings(spark, sf_dir).select("hid"))


def _stratified(spark, sf_dir):
    segment = S.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("stratum")
    )
    strata = S.dwellings(spark, sf_dir).select("hid", "custkey").join(segment, "custkey")
    matrix = S.roster(spark, sf_dir)
    target = selection.target_shares(matrix, BANDS)
    placed = matrix.join(strata.drop("custkey"), "hid")
    return selection.drift(placed, "hid", BANDS, target, DRIFT_THRESHOLD, by=["stratum"], sample=S.dwellings(spark, sf_dir).select("hid"))


@register
def drift_by_stratum(spark, sf_dir):
    return _stratified(spark, sf_dir)


@register
def acceptance_by_stratum(spark, sf_dir):
    return rounded(selection.acceptance(_stratified(spark, sf_dir), ["stratum"]), "rate")
