"""Revenue and demand roll-ups, KPIs and column profiles.

Every operator takes the fact (or a frame derived from it) and returns a
DataFrame.  Grain: a reference row is a whole transaction, here a transaction
is an order of several lines, so "count of transactions" is a count of
distinct ``order_key`` and "average order value" is revenue / orders.

Order-level figures (daily, weekday, holiday, customer and global KPIs) are
computed from one row per order: ``sources.tables.order_totals`` sums the
lines per order key before joining ``orders`` (``orders_of`` does the same
for an already joined line-level frame), so transactions are plain counts
and the distinct counts run over a quarter of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import exprs as X


def _keys_not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def revenue_by(fact: DataFrame, keys: Sequence[str], name: str = "revenue") -> DataFrame:
    """Exact revenue per key (pandas ``groupby(keys)['TotalPrice'].sum()``).

    ``fact`` may be line rows or pre-aggregated rows (``order_totals``,
    ``part_totals``): decimal sums decompose exactly.
    """
    return _keys_not_null(fact, keys).groupBy(*keys).agg(X.money_sum(F.col("revenue_dec")).alias(name))


def daily_revenue(fact: DataFrame) -> DataFrame:
    return revenue_by(fact, ["date"]).orderBy("date")


def category_revenue(fact: DataFrame) -> DataFrame:
    return revenue_by(fact, ["category"]).orderBy(F.desc("revenue"), "category")


def tier_revenue(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue per loyalty tier: summed per customer first, then joined to
    the customer attributes (one row per customer on each side)."""
    per = orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.sum("revenue_dec").alias("revenue_dec"))
    return revenue_by(per.join(customers, "customer_id"), ["loyalty_tier"]).orderBy("revenue", "loyalty_tier")


def daily_product_sales(fact: DataFrame) -> DataFrame:
    """Units and revenue per (date, product, category)."""
    keys = ["date", "product", "category"]
    return _keys_not_null(fact, keys).groupBy(*keys).agg(
        F.sum("quantity").alias("units"),
        X.money_sum(F.col("revenue_dec")).alias("revenue"),
    )


def orders_of(fact: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per order: its customer, date, revenue (exact), units, lines."""
    keys = ["order_key", "customer_id", "date", *extra]
    return fact.groupBy(*keys).agg(
        X.exact_sum(F.col("revenue_dec")).alias("revenue_dec"),
        F.sum("quantity").alias("units"),
        F.count(F.lit(1)).alias("lines"),
    )


def distinct_count(col: str, exact: bool = True):
    """Exact distinct count, or the HyperLogLog++ estimate (about 1 %
    relative error, fixed-size sketches instead of a (group, value)
    shuffle) when ``exact=False``."""
    return F.countDistinct(col) if exact else F.approx_count_distinct(col, 0.01)


def daily_metrics(orders: DataFrame, exact: bool = True) -> DataFrame:
    """Revenue, units, distinct customers and transactions per day.

    ``orders`` has one row per order (``orders_of`` or ``order_totals``), so
    transactions are a plain count.
    """
    orders = orders.where(F.col("date").isNotNull())
    return orders.groupBy("date").agg(
        X.money_sum(F.col("revenue_dec")).alias("revenue"),
        F.sum("units").alias("units"),
        distinct_count("customer_id", exact).alias("unique_customers"),
        F.count(F.lit(1)).alias("transactions"),
    )


def weekday_pattern(orders: DataFrame) -> DataFrame:
    """Mean transaction value per weekday (Monday = 0), from order rows."""
    orders = orders.where(F.col("date").isNotNull())
    return (
        orders.groupBy(X.weekday(F.col("date")).alias("day_of_week"),
                       F.date_format(F.col("date"), "E").alias("day_name"))
        .agg(
            (X.money_sum(F.col("revenue_dec")) / F.count(F.lit(1))).alias("avg_transaction_value"),
            F.count(F.lit(1)).alias("transactions"),
        )
        .orderBy("day_of_week")
    )


def top_products(fact: DataFrame, n: int = 10) -> DataFrame:
    return revenue_by(fact, ["product"]).orderBy(F.desc("revenue"), "product").limit(n)


def product_performance(fact: DataFrame) -> DataFrame:
    keys = ["category", "product"]
    return _keys_not_null(fact, keys).groupBy(*keys).agg(
        X.money_sum(F.col("revenue_dec")).alias("total_revenue"),
        F.sum("quantity").alias("total_units"),
        F.countDistinct("order_key").alias("transaction_count"),
    )


def _with_orders(lines: DataFrame, key: str, name: str, *measures: Column) -> DataFrame:
    """``measures`` and distinct orders (``name``) per number in ``key``.

    The measures are combined map-side to a row per number and task, so only the
    pairs of number and order, two numbers a row, are shuffled at line grain;
    ``countDistinct`` beside other measures shuffles those with every pair.
    """
    lines = lines.where(F.col(key).isNotNull())
    pairs = lines.where(F.col("order_key").isNotNull()).select(key, "order_key").distinct()
    orders = pairs.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return lines.groupBy(key).agg(*measures).join(orders, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def item_performance(lines: DataFrame, items: DataFrame) -> DataFrame:
    """``product_performance`` of numbered lines (``sources.tables.item_lines``)."""
    per = _with_orders(lines, "item", "transaction_count", X.money_sum(F.col("revenue_dec")).alias("total_revenue"),
                       F.sum("quantity").alias("total_units"))
    return _keys_not_null(items, ["category", "product"]).join(per, "item").select(
        "category", "product", "total_revenue", "total_units", "transaction_count")


def item_names(lines: DataFrame, items: DataFrame) -> DataFrame:
    """``dim_products`` of numbered lines; one row of nulls for lines without names."""
    sold = lines.select("item").distinct()
    return sold.join(items, "item", "left").select("product", "category").distinct()


def holiday_sales(orders: DataFrame) -> DataFrame:
    """Lines, orders, units and revenue on holiday vs other days (order rows)."""
    return orders.groupBy(X.is_holiday(F.col("date")).alias("is_holiday")).agg(
        F.sum("lines").alias("lines"),
        F.count(F.lit(1)).alias("transactions"),
        F.sum("units").alias("units"),
        X.money_sum(F.col("revenue_dec")).alias("revenue"),
    )


def season_label(date) -> "F.Column":
    """Season of the reference's generator: months 11-12 are the holiday season."""
    return F.when(F.month(date).isin(11, 12), F.lit("HOLIDAY")).otherwise(F.lit("REGULAR"))


def season_mix(fact: DataFrame) -> DataFrame:
    """Revenue per (season, category) and its share within the season."""
    by = fact.where(F.col("category").isNotNull()).groupBy(
        season_label(F.col("date")).alias("season"), "category"
    ).agg(
        X.exact_sum(F.col("revenue_dec")).alias("_rev"),
        F.count(F.lit(1)).alias("lines"),
    )
    # one row per (season, category): the season total is a small window
    tot = F.sum("_rev").over(Window.partitionBy("season"))
    return by.select(
        "season", "category", "lines",
        X.to_double(F.col("_rev")).alias("revenue"),
        (X.to_double(F.col("_rev")) / X.to_double(tot)).alias("share"),
    )


def line_totals(fact: DataFrame) -> DataFrame:
    """P1 and P2 per line: list total and discounted, holiday-adjusted total."""
    gross = X.dec(F.col("extended_price"))
    net = X.money(F.col("extended_price"), F.col("discount"))
    return fact.select(
        "order_key", "line_number", "sku", "date", "quantity", "unit_price", "discount", "is_holiday",
        X.to_double(gross).alias("line_total"),
        X.to_double(net).alias("net_total"),
        X.to_double(net * X.holiday_factor(F.col("is_holiday"))).alias("holiday_adjusted_total"),
    )


def seasonal_demand(fact: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Month x category units, one column per category (``units_<name>``).

    ``pivot`` with the category values passed in: no extra job to discover
    them, and Spark aggregates per (month, category) before pivoting.
    """
    wide = fact.groupBy(F.month("date").cast("int").alias("month")) \
        .pivot("category", list(categories)).agg(F.sum("quantity"))
    return wide.select("month", *[F.col(f"`{c}`").alias(f"units_{c.lower()}") for c in categories]).orderBy("month")


def monthly_year_revenue(fact: DataFrame, years: Sequence[int]) -> DataFrame:
    """Month x year revenue pivot, one column per year (``y_<year>``)."""
    wide = fact.withColumn("_year", F.year("date")).groupBy(F.month("date").cast("int").alias("month")) \
        .pivot("_year", list(years)).agg(F.sum("revenue_dec"))
    return wide.select("month", *[X.to_double(F.col(f"`{y}`")).alias(f"y_{y}") for y in years]).orderBy("month")


def _demand() -> list[Column]:
    return [F.avg("quantity").alias("avg_demand"), X.std6(F.col("quantity")).alias("std_demand"), F.sum("quantity").alias("total_demand")]


def product_demand(fact: DataFrame) -> DataFrame:
    """Per-line quantity statistics per product, one pass."""
    return fact.where(F.col("product").isNotNull()).groupBy("product").agg(*_demand(), F.countDistinct("order_key").alias("frequency"))


def item_demand(lines: DataFrame, items: DataFrame) -> DataFrame:
    """``product_demand`` of numbered lines (``sources.tables.item_lines``)."""
    per = _with_orders(lines, "product_item", "frequency", *_demand())
    products = items.where(F.col("item") == F.col("product_item")).where(F.col("product").isNotNull())
    return products.select("product", "product_item").join(per, "product_item").drop("product_item")


def kpi_summary(orders: DataFrame, items: DataFrame, exact: bool = True) -> DataFrame:
    """Global KPIs as one row.

    Orders, lines, revenue, units, customers and dates come from the order
    rows; distinct products and categories from ``items`` (rows carrying
    product and category, e.g. ``part_totals``), pre-aggregated map-side.
    """
    o = orders.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("lines").alias("lines"),
        X.money_sum(F.col("revenue_dec")).alias("total_revenue"),
        X.null_div(X.money_sum(F.col("revenue_dec")), F.count(F.lit(1))).alias("avg_order_value"),
        F.sum("units").alias("total_units"),
        distinct_count("customer_id", exact).alias("unique_customers"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    pc = items.groupBy("product", "category").agg(F.count(F.lit(1)).alias("_n"))
    p = pc.agg(
        F.countDistinct("product").alias("unique_products"),
        F.countDistinct("category").alias("unique_categories"),
    )
    return o.crossJoin(p)  # both sides are single-row global aggregates


def column_statistics(fact: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``describe()`` as tall rows: one row per column.

    count, mean, std and the exact quartiles (6 decimals), min, max.  The columns
    are unpivoted once into (column_name, value) and combined to a histogram,
    which every figure is read from: the fact is evaluated once.  The deviations
    are summed around the mean, a pass of its own.
    """
    from tillroll.functions.ranking import QUARTILES, exact_quantiles, value_histogram

    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    hist = value_histogram(fact.selectExpr(f"stack({len(columns)}, {stack}) as (column_name, v)"), "v", ["column_name"])
    cuts = exact_quantiles(hist, "v", QUARTILES, "column_name", "n")
    whole = hist.groupBy("column_name").agg(
        F.sum("n").alias("count"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max")).collect()  # one row per column
    of = {r["column_name"]: r for r in whole}
    empty = F.lit(None).cast("double")

    def by_column(values: dict) -> Column:
        expr = F.when(F.lit(False), empty)
        for c, v in values.items():
            expr = expr.when(F.col("column_name") == c, F.lit(v))
        return expr.otherwise(empty)

    off = F.col("v") - by_column({c: r["mean"] for c, r in of.items()})
    spread = hist.groupBy("column_name").agg(F.sum(off * off * F.col("n")).alias("ss"))
    names = fact.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    count = F.coalesce(by_column({c: float(r["count"]) for c, r in of.items()}).cast("long"), F.lit(0))
    return names.join(F.broadcast(spread), "column_name", "left").select(
        "column_name", count.alias("count"),
        X.round6(by_column({c: r["mean"] for c, r in of.items()})).alias("mean"),
        X.round6(F.when(count > 1, F.sqrt(F.col("ss") / (count - 1)))).alias("std"),
        by_column({c: r["min"] for c, r in of.items()}).alias("min"),
        *(X.round6(by_column({c: q[i] for c, q in cuts.items()})).alias(n) for i, n in enumerate(("p25", "p50", "p75"))),
        by_column({c: r["max"] for c, r in of.items()}).alias("max"))


def null_counts(fact: DataFrame) -> DataFrame:
    """``info()`` + ``isnull().sum()``: type, non-null and null count per column."""
    cols = fact.columns
    agg = fact.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)],
    )
    types = dict(fact.dtypes)
    stack = ", ".join(
        f"'{c}', '{types[c]}', _nn_{i}" for i, c in enumerate(cols)
    )
    return agg.selectExpr(
        "_rows", f"stack({len(cols)}, {stack}) as (column_name, data_type, non_null)"
    ).select("column_name", "data_type", "non_null", (F.col("_rows") - F.col("non_null")).alias("nulls"))


def transaction_labels(orders: DataFrame) -> DataFrame:
    """Zero-padded transaction label per order (``TXN_%06d``); one row per order in."""
    return orders.select("order_key", F.format_string("TXN_%06d", F.col("order_key")).alias("transaction_label"))


def dim_products(fact: DataFrame) -> DataFrame:
    return fact.select("product", "category").distinct()


def baskets(fact: DataFrame, item: str = "product") -> DataFrame:
    """Baskets in long form: (order, item, lines of that item, basket size).

    A list per basket (the reference's ``agg(list)``) is this multiset; the
    long form keeps one hot basket from becoming one huge row in one task.
    """
    per_item = fact.where(F.col(item).isNotNull()).groupBy("order_key", F.col(item).alias("item")).agg(
        F.count(F.lit(1)).alias("multiplicity"))
    size = per_item.groupBy("order_key").agg(F.sum("multiplicity").alias("basket_size"),
                                            F.count(F.lit(1)).alias("distinct_items"))
    return per_item.join(size, "order_key")
