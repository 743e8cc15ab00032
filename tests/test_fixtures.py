"""Mini fixtures with hand-computed answers (FIXTURES.md section 4)."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.functions import exprs as X
from tillroll.functions.ranking import (
    QUARTILES, exact_quantiles, global_position, order_statistics, qcut_score, value_histogram,
)
from tillroll.operators import basket as B
from tillroll.operators import features as FE
from tillroll.operators import forecast as FC
from tillroll.operators import inventory as INV
from tillroll.operators import kpi as K
from tillroll.operators import rfm as R

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_qcut_n6_not_ntile(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 7)], "x double").repartition(3)
    q = exact_quantiles(df, "x", QUARTILES)[None]
    scored = df.select("x", qcut_score(F.col("x"), *map(F.lit, q)).alias("s"))
    assert [r.s for r in scored.orderBy("x").collect()] == ["1", "1", "2", "3", "4", "4"]


def test_quantiles_of_a_histogram_and_of_rows(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    xs = {"a": [1, 1, 2, 5, 5, 5, 9, 12, 12, 40], "b": list(rng.lognormal(3, 4, 2000)) + [7.25] * 900,
          "c": [-1e308, 1e308, 5e-324, -0.0, 0.0, 1e-300], "d": [3.5], "e": [2.0] * 50}
    df = spark.createDataFrame([(g, float(v)) for g, vs in xs.items() for v in vs] + [("a", None), ("f", None)], "g string, x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    rows = exact_quantiles(df.repartition(7), "x", probs, "g")
    hist = exact_quantiles(value_histogram(df, "x", ["g"]), "x", probs, "g", "n")
    assert rows == hist and set(rows) == set(xs)
    for g, vs in xs.items():
        vs = sorted(vs)
        for q, got in zip(probs, rows[g]):
            h = (len(vs) - 1) * q
            lo = math.floor(h)
            assert got == vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (h - lo)


def test_order_statistics_are_the_sorted_values(spark):
    import random

    rng = random.Random(8)
    vs = sorted(rng.choice([rng.gauss(0, 1), rng.gauss(1e9, 1e-3), 42.0]) for _ in range(3000))
    df = spark.createDataFrame([(v,) for v in vs], "x double").repartition(5)
    n, at = order_statistics(df, "x", lambda n: range(1, n + 1, 37))[order_statistics.__globals__["_WHOLE"]]
    assert n == 3000 and at == {p: vs[p - 1] for p in range(1, 3001, 37)}
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double")
    assert order_statistics(odd, "x", lambda n: [1]) == {}


def test_global_position_is_total_and_distributed(spark):
    rows = [(i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "f int, c int").repartition(7)
    for n in (5, None):  # explicit count, and AQE-sized (coalesced) ranges
        pos = global_position(df, ["f", "c"], num_partitions=n).collect()
        got = {(r.f, r.c): r.pos for r in pos}
        expected = {k: i + 1 for i, k in enumerate(sorted(got))}
        assert got == expected


def _base(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, recency int, frequency long, monetary double, "
                                       "avg_order_value double, monetary_dec decimal(38,4)")


def test_rfm_scores_reversed_recency_and_ranked_frequency(spark):
    from decimal import Decimal

    rows = [(c, c, 5, float(c * 10), 2.0, Decimal(c * 10)) for c in range(1, 7)]
    out = {r.customer_id: r for r in R.rfm_scores(_base(spark, rows)).collect()}
    assert [out[c].r_score for c in range(1, 7)] == ["4", "4", "3", "2", "1", "1"]
    assert [out[c].f_score for c in range(1, 7)] == ["1", "1", "2", "3", "4", "4"]
    assert [out[c].m_score for c in range(1, 7)] == ["1", "1", "2", "3", "4", "4"]


def test_segment_rule(spark):
    codes = ["444", "441", "433", "422", "311", "212", "111", "424"]
    df = spark.createDataFrame([(c,) for c in codes], "rfm_score string")
    got = [r.segment for r in R.rfm_segments(df).collect()]
    assert got == ["Champions", "Loyal Customers", "Potential Loyalists", "New Customers", "Promising",
                   "Need Attention", "At Risk", "At Risk"]


def test_holiday_edges(spark):
    days = [dt.date(2023, 11, 19), dt.date(2023, 11, 20), dt.date(2023, 11, 30), dt.date(2023, 12, 1),
            dt.date(2023, 12, 26), dt.date(2023, 12, 27)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r.h for r in df.select(X.is_holiday(F.col("d")).alias("h")).collect()]
    assert got == [False, True, True, True, True, False]


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 6),), (dt.date(2024, 1, 7),)], "d date")
    got = df.select(X.weekday(F.col("d")).alias("w"), X.is_weekend(F.col("d")).alias("e")).collect()
    assert [(r.w, r.e) for r in got] == [(0, 0), (5, 1), (6, 1)]


def _series(spark, values, gaps=None):
    days = gaps or list(range(len(values)))
    return spark.createDataFrame([(day(d), "P", "C", float(v)) for d, v in zip(days, values)],
                                 "date date, product string, category string, units double")


def test_rolling_partial_and_causal(spark):
    s = _series(spark, range(1, 9))
    compat = [r.rolling_mean_7 for r in FE.rolling_mean_product(s).orderBy("date").collect()]
    assert compat == [1, 1.5, 2, 2.5, 3, 3.5, 4, 5]
    causal = [r.rolling_mean_7 for r in FE.rolling_mean_product(s, frame="causal").orderBy("date").collect()]
    assert causal == [None, 1, 1.5, 2, 2.5, 3, 3.5, 4]


def test_rolling_full_frames(spark):
    df = spark.createDataFrame([(day(i), float(i + 1)) for i in range(8)], "date date, revenue double")
    cols = FE.rolling_full("revenue", 7, Window.orderBy("date"))
    rows = df.select("date", *cols).orderBy("date").collect()
    assert [r.revenue_rolling_mean_7 for r in rows] == [None] * 6 + [4.0, 5.0]
    assert [r.revenue_rolling_std_7 for r in rows] == [None] * 6 + [2.160247, 2.160247]


def test_lag_counts_rows_not_days(spark):
    s = _series(spark, [10, 20, 30], gaps=[1, 2, 9])
    got = [r.lag1 for r in FE.lag_features(s).orderBy("date").collect()]
    assert got == [None, 10.0, 20.0]


def _fact_items(spark, rows):
    return spark.createDataFrame(rows, "order_key long, category string")


def test_basket_repeat_set_vs_multiset(spark):
    f = _fact_items(spark, [(1, "A"), (1, "B"), (1, "A")])
    s = {(r.item_a, r.item_b): r.pair_count for r in B.basket_pairs(f, min_support=0.0).collect()}
    assert s == {("A", "B"): 1}
    m = {(r.item_a, r.item_b): r.pair_count for r in B.basket_pairs_multiset(f).collect()}
    assert m == {("A", "B"): 2, ("A", "A"): 1}


def test_single_item_baskets_no_pairs(spark):
    f = _fact_items(spark, [(1, "A"), (2, "B"), (3, "C")])
    out = B.basket_pairs(f, min_support=0.0)
    assert out.count() == 0
    assert out.columns == ["item_a", "item_b", "pair_count", "support"]


def test_apriori_pruning_keeps_frequent_pairs(spark):
    rows = [(b, it) for b in range(100) for it in ("A", "B")] + [(b, "Z") for b in range(2)] + [(0, "Y")]
    f = _fact_items(spark, rows)
    got = {(r.item_a, r.item_b): r.support for r in B.basket_pairs(f, min_support=0.03).collect()}
    assert got == {("A", "B"): 1.0}


def test_inventory_fixture(spark):
    f = spark.createDataFrame([("P", 2.0), ("P", 4.0), ("P", 6.0), ("Q", 5.0)], "product string, quantity double")
    vol = {r.product: r for r in INV.product_volatility(f).collect()}
    p = vol["P"]
    assert (p.mean, p.std, p.cv) == (4.0, 2.0, 0.5)
    assert p.safety_stock == pytest.approx(3.3)
    assert vol["Q"].std is None and vol["Q"].cv is None
    top = [r.product for r in INV.top_volatile(INV.product_volatility(f)).collect()]
    assert top == ["P", "Q"]  # null CV sorts last
    pts = INV.with_reorder_points(spark.createDataFrame([(4.0, 2.0)], "m double, s double"), "m", "s").first()
    assert round(pts.safety_stock, 6) == 8.703747
    assert round(pts.reorder_point, 6) == 36.703747


def test_zero_divisor_and_null_key(spark):
    from decimal import Decimal

    orders = spark.createDataFrame(
        [(1, 7, D0, Decimal(0)), (2, None, D0, Decimal(5))],
        "order_key long, customer_id long, date date, revenue_dec decimal(38,4)")
    base = R.rfm_base(None, orders).collect()
    assert len(base) == 1 and base[0].avg_order_value == 0.0
    assert X.safe_div(F.lit(1.0), F.lit(0.0)) is not None
    assert spark.range(1).select(X.safe_div(F.lit(1.0), F.lit(0.0)).alias("v")).first().v == 0.0
    f = spark.createDataFrame([(None, Decimal(1)), ("A", Decimal(2))], "category string, revenue_dec decimal(38,4)")
    assert [r.category for r in K.category_revenue(f).collect()] == ["A"]


def test_metrics_fixture(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0), (400.0, 400.0)], "actual double, predicted double")
    m = FC.metrics(df).first()
    assert m.mae == 10.0
    assert m.rmse == 12.909944
    assert m.mape == 6.666667
    assert m.r2 == 0.989286


def test_chrono_split_and_sequences(spark):
    df = spark.createDataFrame([(day(i), float(i)) for i in range(11)], "date date, revenue double")
    split = [r.split for r in FE.chrono_split(df).orderBy("date").collect()]
    assert split.count("train") == 8 and split.count("validation") == 3
    seq = spark.createDataFrame([(day(i), float(i)) for i in range(32)], "date date, revenue double")
    s = FE.revenue_sequences(seq).orderBy("date").collect()
    assert len(s) == 2
    assert s[0].window == [float(i) for i in range(30)] and s[0].target == 30.0


def test_exponential_smoothing(spark):
    s = _series(spark, [1, 2, 3])
    assert FC.ses_level(s).first().level == 1.81


def test_future_calendar(spark):
    daily = spark.createDataFrame([(dt.date(2001, 7, 31), 1.0), (dt.date(2001, 8, 1), 2.0)], "date date, revenue double")
    fut = [r.date for r in FE.future_calendar(daily).where("is_future").orderBy("date").collect()]
    assert len(fut) == 90 and fut[0] == dt.date(2001, 8, 2) and fut[-1] == dt.date(2001, 10, 30)


def test_calendar_fill_zero(spark):
    daily = spark.createDataFrame([(day(0), 1.0), (day(3), 2.0)], "date date, revenue double")
    rows = FE.calendar_fill(daily).orderBy("date").collect()
    assert [r.revenue for r in rows] == [1.0, 0.0, 0.0, 2.0]
    assert [r.has_sales for r in rows] == [True, False, False, True]


def test_daily_demand_stats_include_zero_days(spark):
    f = spark.createDataFrame([("P", day(0), 3.0), ("P", day(2), 3.0), ("Q", day(1), 1.0)],
                              "product string, date date, quantity double")
    out = {r.product: r for r in INV.reorder_points_daily(f).collect()}
    # P over 3 days: 3, 0, 3 -> mean 2, sample std sqrt(3)
    assert out["P"].avg_daily_demand == 2.0
    assert out["P"].std_daily_demand == round(math.sqrt(3.0), 6)
    assert out["P"].days == 3


def test_lag_features_product_filter(spark):
    rows = [(day(i), p, "C", float(i)) for i in range(3) for p in ("P", "Q")]
    s = spark.createDataFrame(rows, "date date, product string, category string, units double")
    out = FE.lag_features(s, products=["Q"]).collect()
    assert {r.product for r in out} == {"Q"} and len(out) == 3


def test_top_k_prefilter_exact(spark):
    from tillroll.functions.ranking import top_k

    rows = [(i % 97 if i % 11 else None, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    order = [F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first()]
    exp = [tuple(r) for r in df.orderBy(*order).limit(1200).collect()]
    got = [tuple(r) for r in top_k(df, 1200, order, lead="a", prefilter_from=100).collect()]
    assert got == exp


def test_smallest_keys_prefilter_exact(spark):
    from tillroll.functions.ranking import smallest_keys

    rows = [((i * 7919) % 3001, i) for i in range(12000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k long, v int").repartition(5)
    exp = sorted({k for k, _ in rows if k is not None})[:1500]
    got = [r.k for r in smallest_keys(df, "k", 1500, prefilter_from=100).collect()]
    assert got == exp


def test_top_k_with_hot_low_value(spark):
    from tillroll.functions.ranking import top_k

    rows = [(0, i) for i in range(3000)] + [(i, i) for i in range(1, 6000)]  # key 0 holds a third
    df = spark.createDataFrame(rows, "a int, b int").repartition(4)
    order = [F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first()]
    exp = [tuple(r) for r in df.orderBy(*order).limit(4000).collect()]
    assert [tuple(r) for r in top_k(df, 4000, order, lead="a", prefilter_from=100).collect()] == exp
