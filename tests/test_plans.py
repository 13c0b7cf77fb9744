"""What plans must and must not hold: pruned scans, pushed filters, no cross joins, no Python where built-ins serve."""

import os
import re

import pytest

from docloom import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(spark, name):
    return plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_asked(spark):
    assert re.findall(r"ReadSchema: (\S+)", plan(spark, "agg_type_counts")) == ["struct<event_type:string>"]
    scans = re.findall(r"ReadSchema: (\S+)", plan(spark, "sel_descendant"))
    assert scans and not any("totalprice" in s or "name" in s or "priority" in s for s in scans)
    assert "Window" not in plan(spark, "sel_descendant")  # places of children are not worked out unless asked for


def test_filters_reach_the_scan(spark):
    assert "EqualTo(o_orderstatus,F)" in plan(spark, "join_semi")
    assert "LessThan(p_size,10)" in plan(spark, "join_resolve_refs")


@pytest.mark.parametrize("name", ["join_range_names", "join_full_outer_diff", "diff_lines", "sel_sibling", "graph_page_number", "content_mapped_codes", "join_reference_integrity"])
def test_joins_are_on_keys(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize("name", ["sec_url_rules", "txt_word_stats", "sc_type3_function", "content_operations", "tf_merge", "val_profile_report", "txt_index_terms"])
def test_built_ins_alone(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


def test_aggregates_combine_before_they_shuffle(spark):
    assert "partial_count" in plan(spark, "agg_doc_rollup") and "partial_max" in plan(spark, "set_revision_deltas")
