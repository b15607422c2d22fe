"""Plan shape: what must not show up at scale."""

import re

import pytest

from loomshelf import catalog


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("name", ["qa8_true_steady_sellers", "rf14_promo_match", "ig21_certified", "ig14_correct_names", "tx3_keyword_frequency", "dq1_dedup_texts"])
def test_no_pairwise_joins_and_no_row_python(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    # the only nested-loop joins attach a frame of one row
    assert all("Cross" in line for line in text.splitlines() if "BroadcastNestedLoopJoin" in line)


def test_scan_reads_needed_columns(spark, sf):
    text = plan(catalog.QUERIES["ag8_reorder_share"](spark, sf))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(schemas) == ["l_orderkey:bigint,l_returnflag:string", "o_orderkey:bigint"]


def test_date_window_reaches_the_scan(spark, sf):
    text = plan(catalog.QUERIES["rf16_date_window"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text or "o_orderdate" in re.findall(r"DataFilters: \[([^\]]*)", text)[-1]


def test_hot_groups_are_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["ts5_category_stars"](spark, sf))


@pytest.mark.parametrize("name", ["dq1_dedup_texts", "dq11_copied_texts", "dq12_without_copies"])
def test_texts_are_compared_by_digest(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "Expand" not in text and "SortAggregate" not in text
    assert not re.search(r"Exchange hashpartitioning\([^)]*text#", text)


def test_no_table_is_dealt_out_by_its_size(spark, sf):
    from loomshelf.sources import views

    assert "Exchange" not in plan(views.table(spark, sf, "documents"))


def test_words_are_grouped_where_their_text_is_cut(spark, sf):
    """Texts are shuffled whole; their words, one row each, are not."""
    plan = catalog.QUERIES["ig8_dedup_items"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")


def test_words_are_ranked_where_their_text_is_cut(spark, sf):
    """Below the window over a product's words only whole texts are shuffled."""
    lines = plan(catalog.QUERIES["dim7_product_ingredients"](spark, sf)).split("\n")
    window = next(i for i, line in enumerate(lines) if "row_number()" in line and "Window" in line)
    below = [line for line in lines[window:] if "Exchange" in line or "Generate" in line]
    assert "Generate" in below[0] and "Exchange" in below[1]
