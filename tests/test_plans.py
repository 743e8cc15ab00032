"""Plan-shape regressions: the properties that matter at scale.

Broadcast-by-size and AQE are switched off so the plans are those of a
cluster where every table is large.
"""

import re

import pytest

from conftest import SF001
from tillroll.plans.catalog import QUERIES


@pytest.fixture
def large(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(spark, name):
    return QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


def scans(p, table):
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", p))


ONE_LINEITEM_SCAN = [
    "daily_revenue", "category_revenue", "tier_revenue", "daily_metrics", "weekday_pattern", "holiday_sales",
    "rfm_base", "customer_clv", "basket_pairs", "association_rules", "reorder_points_daily",
    "economic_order_quantity", "calendar_fill", "future_calendar", "trend_line", "lag_features_top5",
    "sales_fact", "daily_features", "product_performance", "customer_first_attributes", "rfm_with_attributes",
]


@pytest.mark.parametrize("name", ONE_LINEITEM_SCAN)
def test_lineitem_read_once(large, name):
    assert scans(plan(large, name), "lineitem") == 1


@pytest.mark.parametrize("name", ["daily_metrics", "rfm_base", "kpi_summary", "category_revenue"])
def test_lines_pre_aggregated_before_their_shuffle(large, name):
    p = plan(large, name)
    # the lineitem scan feeds a partial aggregate, and the first exchange
    # above the scan is keyed by the order or part key
    m = re.search(r"Exchange hashpartitioning\((l_orderkey|l_partkey)#\d+L?, \d+\)[^\n]*\n(?:[^\n]*\n){0,2}?"
                  r"[^\n]*HashAggregate\(keys=\[(l_orderkey|l_partkey)", p)
    assert m, p


def test_sales_fact_shuffles_lines_twice_at_most(large):
    p = plan(large, "sales_fact")
    line_keys = re.findall(r"Exchange hashpartitioning\((l_orderkey|l_partkey|o_custkey|c_nationkey)#", p)
    # line-level rows are exchanged for the order key and the part key; the
    # customer/nation joins happen on the order side
    assert "o_custkey" in line_keys and line_keys.count("l_orderkey") == 1
    assert re.search(r"SortMergeJoin \[o_custkey#\d+L\], \[c_custkey", p)


def test_no_python_evaluation_anywhere(spark):
    for name in ("category_revenue", "rfm_segments", "basket_pairs", "daily_features", "ses_level",
                 "column_statistics", "seasonal_regressors", "customer_first_attributes"):
        p = plan(spark, name)
        assert "EvalPython" not in p and "PythonUDF" not in p and "MapInPandas" not in p, name


def exchanges(p):
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range)partitioning|(?<!Reused)Exchange SinglePartition", p))


@pytest.mark.parametrize("name", ["column_statistics", "rfm_scores", "dim_customers"])
def test_cut_points_are_counted_not_sorted(large, name):
    """What is left to run after the counting passes."""
    p = plan(large, name)
    assert exchanges(p) < 8 and scans(p, "lineitem") == 0


@pytest.mark.parametrize("name, tables", [("column_statistics", {"lineitem": 1}), ("rfm_scores", {"lineitem": 1})])
def test_one_lineitem_scan_over_all_jobs(large, name, tables):
    """The passes read materialised rows: of all jobs a query starts one scans the lines."""
    listed = []
    real = type(large.read).parquet
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(large.read), "parquet", lambda self, *a, **k: (listed.append(a[0]), real(self, *a, **k))[1])
        QUERIES[name](large, SF001).collect()
    for t, n in tables.items():
        assert sum(f"/{t}.parquet" in p for p in listed) == n
