"""Plans that queries must keep: no Cartesian products, no Python in the relational part, columns pruned, one shuffle of claims in the gate."""

import re

import pytest

from tidemark.operators import gate
from tidemark.plans.decisions import NOW, gate_inputs
from tidemark.plans.registry import QUERIES

#: Python that Spark lacks a function for: gzip, HTML.
PYTHON = {"payload_round_trip", "page_tables", "page_map_tables", "page_map_yield", "html_product_blocks", "html_labelled_rows", "html_articles", "index_and_details", "table_cells", "provider_payloads", "provider_candidates"}
#: Folds in order, of which each step needs the one before.
PYTHON |= {"identity_resolution", "identity_outcomes", "rate_limited", "run_replayed"}
#: Joins without keys: of tables of one row, and of the registry of a handful of origins.
PRODUCT = {"landing_counts", "cascade_delete", "independent_origins"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_and_no_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    if name not in PYTHON:
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas", text)
    if name not in PRODUCT:
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)


def test_calendar_reads_the_columns_it_needs(spark, sf):
    text = plan(QUERIES["past_events"](spark, sf))
    orders = next(x for x in re.findall(r"ReadSchema: struct<([^>]*)>", text.replace("\n", " ")) if "o_orderkey" in x)
    assert "o_totalprice" not in orders


def test_gate_shuffles_claims_once(spark, sf):
    claims, published = gate_inputs(spark, sf)
    text = plan(gate.evaluate(claims, published, NOW))
    assert len(re.findall(r"ObjectHashAggregate.*collect_list|SortAggregate.*collect_list", text)) <= 2
    assert text.count("lineitem") <= 2
