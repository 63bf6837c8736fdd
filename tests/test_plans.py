"""What the plans must show: pruned scans, pushed filters, shared shuffles, partial sums."""

import re

import pytest

from __spark_entry__ import queries


def _plan(spark, sf_dir, plan_text, name):
    return plan_text(queries()[name](spark, sf_dir))


def _executed(plan: str) -> list[str]:
    """The lines of the plan that ran, without the initial plans kept beside it."""
    kept, outer = [], None
    for line in plan.splitlines():
        depth = len(re.match(r"^[ :]*", line).group(0))
        if outer is not None and depth > outer:
            continue
        outer = depth if "== Initial Plan ==" in line else None
        if outer is None:
            kept.append(line)
    return kept


def test_scans_read_only_what_is_used(spark, sf_dir, plan_text):
    plan = _plan(spark, sf_dir, plan_text, "roster_matrix")
    assert re.findall(r"FileScan parquet \[([^\]]*)\]", plan)[0].count(",") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_size_filter_needs_no_second_pass(spark, sf_dir, plan_text):
    plan = _plan(spark, sf_dir, plan_text, "single_member_bands")
    assert plan.index("Filter") < plan.index("Exchange hashpartitioning(hid")


def test_unpivot_lets_key_filters_through(spark, sf_dir, plan_text):
    df = queries()["roster_long"](spark, sf_dir).where("hid = 5")
    assert "EqualTo(l_orderkey,5)" in plan_text(df)


@pytest.mark.parametrize(
    "name, shuffles_by_household",
    [("patterns_by_size", 1), ("drift_monitor", 1), ("roster_persons", 1), ("margin_child", 1)],
)
def test_dwellings_are_shuffled_once_per_population(spark, sf_dir, plan_text, name, shuffles_by_household):
    """Branches that need the roster again reuse its shuffle: one executed exchange by household per
    population, plus the one of the dwellings table where it is joined."""
    df = queries()[name](spark, sf_dir)
    df.collect()
    parts = _executed(plan_text(df))
    rosters = [
        line for line in parts if "Exchange hashpartitioning(hid" in line and "ReusedExchange" not in line
    ]
    partial = [line for line in parts if "HashAggregate(keys=[hid" in line and "partial_count" in line]
    assert len(partial) == shuffles_by_household
    assert len(rosters) <= shuffles_by_household + 1


def test_margins_sum_the_same_cells(spark, sf_dir, plan_text):
    """The joint law needs two margins; the dwellings are joined and counted once."""
    df = queries()["dist_joint"](spark, sf_dir)
    df.collect()
    assert "\n".join(_executed(plan_text(df))).count("FileScan parquet") == 2


@pytest.mark.parametrize("name", ["fit_size", "fit_band", "fit_type", "fit_band_by_size"])
def test_fit_reports_scan_the_members_once(spark, sf_dir, plan_text, name):
    df = queries()[name](spark, sf_dir)
    df.collect()
    scans = [line for line in _executed(plan_text(df)) if "FileScan parquet" in line and "l_orderkey" in line]
    assert len(scans) == 1


def test_no_python_in_the_plans_and_no_forced_broadcast_of_sizes(spark, sf_dir, plan_text):
    for name in ("acceptance_by_stratum", "drift_by_stratum", "fill_down", "row_ids"):
        assert "Python" not in _plan(spark, sf_dir, plan_text, name)


def test_replicates_shuffle_counts_only(spark, sf_dir, plan_text):
    """Rows meet the distribution as one array: no join, and what is dealt by replicate are partial counts."""
    df = queries()["replicate_fit"](spark, sf_dir)
    df.collect()
    lines = _executed(plan_text(df))
    assert not any("Join" in line for line in lines)
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(replicate" in line and "Reused" not in line]
    assert dealt and all("HashAggregate" in lines[i + 1] for i in dealt)


def test_drift_cuts_segments_by_a_scan_of_the_keys(spark, sf_dir, plan_text):
    plan = _plan(spark, sf_dir, plan_text, "drift_monitor")
    assert re.findall(r"ReadSchema: struct<o_orderkey:bigint>", plan)


def test_the_cube_expands_sums(spark, sf_dir, plan_text):
    lines = _plan(spark, sf_dir, plan_text, "margins_cube").splitlines()
    expands = [i for i, line in enumerate(lines) if "Expand [" in line]
    assert expands and all("HashAggregate" in lines[i + 1] or "HashAggregate" in lines[i + 2] for i in expands)


def test_wide_form_has_the_width_of_the_data(spark, sf_dir):
    df = queries()["patterns_wide"](spark, sf_dir)
    widest = df.agg({"hh_size": "max"}).first()[0]
    assert [c for c in df.columns if c.startswith("age_")] == [f"age_{i}" for i in range(1, widest + 1)]
    assert df.where("n_over > 0").isEmpty()
