"""Contracts: what models may see, what exports keep, what joins keep."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tillroll.operators import features as FE
from tillroll.operators import ml as ML
from tillroll.plans.catalog import QUERIES
from tillroll.sources import export as EX
from tillroll.sources.tables import FULL_FACT, order_totals, part_totals, sales_fact
from tillroll.streaming.daily_value import daily_value_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------ leakage


def test_causal_frames_do_not_move_with_the_target(spark):
    """Changing one day's units changes that row's target, and no feature of it."""
    dps = QUERIES["daily_product_sales"](spark, SF001)
    key = ["date", "product", "category"]
    frame = FE.model_frame(dps, frame="causal")
    hit = frame.orderBy(F.desc("units"), *key).first()
    is_hit = (F.col("date") == hit.date) & (F.col("product") == hit["product"]) & (F.col("category") == hit.category)
    moved = FE.model_frame(dps.withColumn("units", F.when(is_hit, F.col("units") * 1000).otherwise(F.col("units"))), frame="causal")
    feats = list(ML.V1_FEATURES)
    a, b = frame.where(is_hit).select("units", *feats).first(), moved.where(is_hit).select("units", *feats).first()
    assert a.units != b.units and a[1:] == b[1:]


def test_tuned_features_hold_nothing_of_the_day(spark):
    metrics = QUERIES["daily_metrics"](spark, SF001)
    frame = FE.daily_features(metrics, frame="causal")
    feats = ML.tuned_features(frame.columns)
    assert feats and not {"date", "revenue", *ML.SAME_DAY} & set(feats)
    day = frame.orderBy("date").collect()[200].date
    on_day = F.col("date") == F.lit(day)
    measures = [c for c in ("revenue", *ML.SAME_DAY) if c in metrics.columns]
    moved = metrics.withColumns({c: F.when(on_day, F.col(c) * 3).otherwise(F.col(c)).cast(metrics.schema[c].dataType) for c in measures})
    other = FE.daily_features(moved, frame="causal")
    assert frame.where(on_day).select(*feats).first() == other.where(on_day).select(*feats).first()


def test_model_budgets():
    assert (ML.RF_TREES, ML.GBT_ROUNDS, ML.TUNING_TRIALS, ML.TUNING_ROUNDS, ML.KMEANS_ROUNDS) == (100, 100, 20, (100, 300), 300)


def test_tuned_search_marks_one_best_trial(spark):
    frame = FE.daily_features(QUERIES["daily_metrics"](spark, SF001), frame="causal")
    trials, scored = ML.tuned_gbt(frame, trials=3, rounds=(2, 3))
    got = trials.collect()
    assert len(got) == 3 and sum(r.is_best for r in got) == 1
    best = next(r for r in got if r.is_best)
    assert best.rmse == min(r.rmse for r in got)
    assert scored.count() == frame.count() - int(frame.count() * 0.8)


def test_a_tie_goes_to_the_sequence_model(spark):
    comp = spark.createDataFrame([("Tuned GBT", "MAPE", 10.0), ("AR30", "MAPE", 10.0)], "model string, metric string, value double")
    assert ML.best_of(comp, "MAPE", False, ["AR30", "Tuned GBT"]).first().best_model == "AR30"


# ------------------------------------------------------------------ exports


def test_views_whose_cut_names_clash_are_all_kept(spark, tmp_path):
    long = "a_view_name_that_goes_on_and_on_"
    views = {long + "first": spark.range(5), long + "second": spark.range(9), long.upper() + "THIRD": spark.range(2), "empty": spark.range(0)}
    man = EX.write_views(spark, views, str(tmp_path / "v")).collect()
    assert sorted(r.rows for r in man) == [2, 5, 9] and all(len(r.view_name) <= 31 for r in man)
    assert [spark.read.parquet(r.path).count() for r in man] == [r.rows for r in man]
    assert not (tmp_path / "v" / "empty").exists()


def test_year_partitions_have_few_files(spark, tmp_path):
    f = sales_fact(spark, SF001, FULL_FACT).withColumn("year", F.year("date")).repartition(16)
    man = EX.write_views(spark, {"t": f}, str(tmp_path), partition_by={"t": ["year"]}).first()
    folders = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("year=")]
    assert man.rows == f.count() and all(len(list(p.glob("*.parquet"))) <= 2 for p in folders)


# ------------------------------------------------------------------ joins


@pytest.fixture(scope="module")
def orphans(tmp_path_factory):
    """sf0.001 with lines whose order or part is missing and an order without
    its customer."""
    import duckdb

    d = tmp_path_factory.mktemp("orphans")
    shutil.copytree(SF001, d / "sf", dirs_exist_ok=True)
    (d / "sf").chmod(0o755)  # the copy has the mode of a read-only folder
    for p in (d / "sf").rglob("*"):
        p.chmod(0o755 if p.is_dir() else 0o644)
    for t, where in (("orders", "o_orderkey % 50 <> 1"), ("part", "p_partkey % 40 <> 3"), ("customer", "c_custkey % 30 <> 2")):
        duckdb.sql(f"COPY (SELECT * FROM '{SF001}/{t}.parquet' WHERE {where}) TO '{d}/sf/{t}.parquet' (FORMAT parquet)")
    return str(d / "sf")


def test_every_choice_of_columns_has_the_same_lines(spark, orphans):
    n = spark.read.parquet(f"{orphans}/lineitem.parquet").count()
    for columns in (["sku"], ["date"], ["category"], ["city", "quantity"], ["loyalty_tier"], list(FULL_FACT)):
        assert sales_fact(spark, orphans, columns).count() == n
    f = sales_fact(spark, orphans, ["date", "category", "revenue_dec"])
    assert f.where("date is null").count() > 0 and f.where("category is null").count() > 0
    total = f.agg(F.sum("revenue_dec")).first()[0]
    for part in (order_totals(spark, orphans), part_totals(spark, orphans)):
        r = part.agg(F.sum("revenue_dec"), F.sum("lines")).first()
        assert r[0] == total and r[1] == n


@pytest.mark.parametrize("name", ["category_revenue", "daily_metrics", "kpi_summary", "sales_fact", "product_performance", "tier_revenue", "rfm_base", "dim_products"])
def test_twins_keep_orphan_lines_too(spark, orphans, name):
    import duckdb
    from test_oracle import rows_of

    from tillroll.plans.oracle import SQL

    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{orphans}/{t}.parquet'")
    got, want = QUERIES[name](spark, orphans), con.execute(SQL[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([c[0] for c in want.description], want.fetchall())


# ------------------------------------------------------------------ stream


def test_stream_over_a_folder_of_part_files(spark, tmp_path):
    spark.read.parquet(f"{SF001}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    assert rows(daily_value_stream(spark, str(tmp_path))) == rows(daily_value_stream(spark, SF001))


def test_stream_with_every_window_open_is_empty(spark, tmp_path):
    events = [(i, dt.datetime(2024, 1, 1, i), 1, "click", 1.0, "{}") for i in range(5)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "events.parquet"))
    got = daily_value_stream(spark, str(tmp_path), state_partitions=2)
    assert got.collect() == [] and got.columns == ["window_date", "event_type", "events", "total_value"]


def test_model_queries_sum_the_lines_once(spark, monkeypatch):
    """Forecast, clusters, axes and lifetimes read one table of order totals."""
    from tillroll.plans import catalog as C

    calls = []
    real = C.order_totals
    monkeypatch.setattr(C, "order_totals", lambda *a, **k: calls.append(a) or real(*a, **k))
    C.forget_fits()
    for name in ("revenue_forecast", "actual_vs_forecast", "ar30_forecast", "kmeans_segments", "rfm_pca", "predicted_clv"):
        assert QUERIES[name](spark, SF001).count() > 0
    assert len(calls) == 1
    C.forget_fits()


def test_partitions_of_a_fit_grow_slower_than_its_rows(spark):
    """Each partition sends its own node statistics to the shuffle."""
    sizes = (0, 1, 100_000, 100_001, 2_400_000, 5_000_000, 24_000_001)
    assert [ML.ml_partitions(spark.range(n)) for n in sizes] == [1, 1, 1, 2, 24, 24, 25]


@pytest.fixture(scope="module")
def odd_parts(spark, tmp_path_factory):
    """Lines whose parts are missing, nameless, twice there or named alike."""
    d = str(tmp_path_factory.mktemp("parts"))
    parts = [(1, "saw", "tool"), (2, "saw", "toy"), (3, "saw", None), (4, None, "tool"), (5, None, None), (6, "axe", "tool"),
             (6, "axe", "tool"), (7, "axe", "toy"), (7, "cup", "toy"), (8, "saw", "tool"), (None, "pan", "tool"), (9, "", "")]
    lines = [(o, p, n, float(n + 1), 10.0 * (n + 1), 0.1) for o in (1, 1, 2, 3, None) for n, p in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None))]
    lines += [(4, 6, 1, None, 5.0, 0.0), (None, 9, 1, 2.0, None, 0.0), (5, 7, 1, 3.0, 7.0, None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").withColumn("p_brand", F.lit("b")) \
        .write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double") \
        .write.parquet(f"{d}/lineitem.parquet")
    return d


def test_numbered_lines_give_the_views_of_the_named_ones(spark, odd_parts):
    from tillroll.operators import kpi as K
    from tillroll.sources.tables import item_lines, items

    numbered = items(spark, odd_parts)
    lines = item_lines(spark, odd_parts, numbered)
    named = sales_fact(spark, odd_parts, ["category", "product", "revenue_dec", "quantity", "order_key"])
    assert lines.count() == named.count()
    for new, old in ((K.item_performance, K.product_performance), (K.item_demand, K.product_demand), (K.item_names, K.dim_products)):
        got, want = new(lines, numbered), old(named)
        assert got.dtypes == want.dtypes and rows(got) == rows(want) != []
    none = lines.where("false")
    assert [f(none, numbered).count() for f in (K.item_performance, K.item_demand, K.item_names)] == [0, 0, 0]
    # an order with a product in two categories counts once for the product
    assert {r["product"]: r["frequency"] for r in K.item_demand(lines, numbered).collect()}["saw"] == 3


def test_product_views_of_the_export_read_one_table_of_lines(spark, monkeypatch):
    """No view joins the lines to their parts again, and the counts of distinct
    orders shuffle no names."""
    from tillroll.plans import catalog as C

    monkeypatch.setattr(ML, "RF_TREES", 2)
    monkeypatch.setattr(ML, "GBT_ROUNDS", 2)
    C.forget_fits()
    views = C._export_views(spark, SF001)
    for name in ("dim_products", "Product_Performance", "Inventory_Optimization"):
        plan = views[name]._jdf.queryExecution().executedPlan().toString()
        assert "lineitem.parquet" not in plan and "part.parquet" not in plan
        assert views[name].count() > 0
    assert rows(views["Product_Performance"]) == rows(QUERIES["product_performance"](spark, SF001))
    assert rows(views["Inventory_Optimization"]) == rows(QUERIES["reorder_points"](spark, SF001))
    assert rows(views["dim_products"]) == rows(QUERIES["dim_products"](spark, SF001))
    C.forget_fits()
