"""Plans of registered queries: what they must not hold, and what must reach the scan."""

import contextlib
import io
import re

import pytest
from stressframe.plans import registry

JOINS = ("semi_join_selected_parts", "anti_join_parts", "as_of_join", "linear_interpolation", "nearest_within_radius", "contact_mask", "contact_force_metrics", "exterior_faces", "surface_stress_statistics", "set_field_peaks", "revision_deltas", "peak_tensor_history", "single_pass_with_surfaces")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", JOINS)
def test_no_product_of_tables(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["values_top_percent", "values_between_percentiles", "values_without_outliers"])
def test_percentile_filters_reach_the_scan_of_one_pass(spark, sf, name):
    """The thresholds are numbers by then: a filter, no join and no shuffle."""
    text = plan(registry.QUERIES[name](spark, sf))
    assert "Exchange" not in text and "Join" not in text


def test_few_columns_are_read(spark, sf):
    text = plan(registry.QUERIES["global_extremes_of_series"](spark, sf))
    schema = text.split("ReadSchema:")[1].split("\n")[0]
    assert "l_extendedprice" in schema and "l_tax" not in schema and "l_discount" not in schema


def test_filters_are_pushed(spark, sf):
    text = plan(registry.QUERIES["select_parts_by_id"](spark, sf))
    assert "PushedFilters" in text and "l_suppkey" in text.split("PushedFilters:")[1].split("\n")[0]


@pytest.mark.parametrize("name", [registry.FLAGSHIP, "single_pass_statistics", "single_pass_with_surfaces", "parts_and_faces_in_one_pass", "peak_elements_of_parts", "seven_set_fields_in_one_pass", "set_field_peaks", "surface_stress_statistics", "node_set_metrics", "segment_set_metrics"])
def test_extremes_are_hashed_in_tasks_first(spark, sf, name):
    """No rows of states are sorted to find the element of an extreme; faces of the mesh may be."""
    text = plan(registry.QUERIES[name](spark, sf))
    nodes = re.findall(r"^\(\d+\) .*?(?=\n\n)", text, re.S | re.M)
    assert any(re.match(r"\(\d+\) HashAggregate", n) and "partial_max" in n for n in nodes)
    assert not [n for n in nodes if re.match(r"\(\d+\) SortAggregate", n) and re.search(r"max_by|state_idx|value", n)]


def test_rows_of_parts_are_dealt_before_their_quantities(spark, sf):
    """Seven rows a row and their sums are not shuffled: parts meet by part and state, only surfaces by quantity."""
    dealt = re.findall(r"Arguments: hashpartitioning\((.*?)\)", plan(registry.QUERIES["parts_and_faces_in_one_pass"](spark, sf)))
    assert any(re.match(r"part_id#\d+L?, state_idx#\d+, \d+$", a) for a in dealt)
    assert not [a for a in dealt if "quantity" in a and not a.startswith("surface")]
