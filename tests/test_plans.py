"""What the plans must look like: filters and columns at the scan, partial aggregates, no exchange that isn't needed."""

import re

import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", text))


@pytest.mark.parametrize("name", ["hot_items_top5", "pv_uv_hourly", "ad_clicks_by_province", "ad_click_alarm", "page_ad_clicks"])
def test_filters_and_columns_reach_the_scan(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type", text)
    assert "props" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_top_k_keeps_k_rows_a_group_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["hot_items_top5"](spark, SF))
    assert "WindowGroupLimit" in plan(catalog.QUERIES["top2_per_key"](spark, SF))
    assert "WindowGroupLimit" in plan(catalog.QUERIES["ad_click_limited_for_ever"](spark, SF))


@pytest.mark.parametrize(("name", "most"), [
    ("over_rows_3", 1), ("count_window_3", 1), ("count_window_5_2", 1), ("jump_alarm", 1), ("rising_runs", 1), ("consecutive_errors", 1), ("followed_by_purchase", 1),
    ("group_count_avg", 1), ("partition_by_key", 1), ("word_count", 1), ("split_high_low", 0), ("select_where", 0), ("udf_format", 0), ("access_log_errors", 0),
    ("hot_items_top5", 3), ("ad_click_alarm", 1), ("hot_urls_top5_per_key", 3), ("pv_uv_hourly", 2), ("ad_clicks_by_province", 2), ("ad_clicks_limited_by_province", 3), ("session_counts", 1), ("reconcile_orders", 2),
])
def test_exchanges(spark, name, most):
    assert exchanges(plan(catalog.QUERIES[name](spark, SF))) <= most


def test_no_python_where_builtins_do(spark):
    for name in catalog.QUERIES:
        if "python" not in name and name not in ("udtf_lateral", "udaf_average", "ad_click_limited", "ad_click_alarm", "ad_clicks_limited_by_province", "page_ad_clicks"):
            assert not re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, SF))), name


def test_no_cross_joins(spark):
    for name in catalog.QUERIES:
        assert not re.search("CartesianProduct|NestedLoopJoin", plan(catalog.QUERIES[name](spark, SF))), name


def test_panes_are_summed_before_windows(spark):
    """Rows are added up once a slide and dealt to the windows as panes: the rows that go into the first exchange are not multiplied."""
    text = plan(catalog.QUERIES["hot_items_top5"](spark, SF))
    assert text.index("Generate explode") < text.rindex("Exchange hashpartitioning")  # the plan reads from the result down to the scan
    assert "Expand" not in text
