"""Parquet sources and the canonical ``sales_fact`` view.

One fact row is one order line.  Reference column -> fixture expression:

    order_key      l_orderkey        (the basket / transaction id)
    line_number    l_linenumber
    date           cast(o_orderdate as date)
    customer_id    o_custkey
    category       p_type
    product        p_name
    sku            p_partkey
    brand          p_brand
    quantity       l_quantity
    unit_price     l_extendedprice / l_quantity
    discount       l_discount
    revenue_dec    dec(l_extendedprice) * (1 - dec(l_discount))   exact decimal
    total_price    cast(revenue_dec as double)
    is_holiday     20-30 Nov or 1-26 Dec of the order date
    city           n_name
    loyalty_tier   c_mktsegment
    acctbal        c_acctbal

Only the tables that the requested columns need are joined, so a roll-up by
category never touches ``orders`` or ``customer``.  They are left joins: a line
whose order, customer, nation or part is missing stays, with nulls there.
Joins are plain equi-joins: Spark picks broadcast for the fixed-size nation
table from its file statistics, and AQE re-plans the others from measured
shuffle sizes, so no side is broadcast without a size check.

``order_totals``, ``part_totals`` and ``customers`` are the pre-aggregated
and dimension-side sources: lines summed per order or part *before* their
join, for operators that do not need line grain.  ``item_lines`` are the lines
with numbers for product and category, for counts of distinct orders.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions import exprs as X
from tillroll.session import checkpoint_dir

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# column -> (table it comes from, expression over that table's columns)
_LINE = "lineitem"
_ORD = "orders"
_CUS = "customer"
_NAT = "nation"
_PART = "part"


def _fact_columns() -> dict[str, tuple[str, Column]]:
    return {
        "order_key": (_LINE, F.col("l_orderkey")),
        "line_number": (_LINE, F.col("l_linenumber")),
        "sku": (_LINE, F.col("l_partkey")),
        "quantity": (_LINE, F.col("l_quantity")),
        "extended_price": (_LINE, F.col("l_extendedprice")),
        "unit_price": (_LINE, F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))),
        "discount": (_LINE, F.col("l_discount")),
        "revenue_dec": (_LINE, X.money(F.col("l_extendedprice"), F.col("l_discount"))),
        "total_price": (_LINE, X.money(F.col("l_extendedprice"), F.col("l_discount")).cast("double")),
        "date": (_ORD, F.col("o_orderdate").cast("date")),
        "customer_id": (_ORD, F.col("o_custkey")),
        "is_holiday": (_ORD, X.is_holiday(F.col("o_orderdate").cast("date"))),
        "loyalty_tier": (_CUS, F.col("c_mktsegment")),
        "acctbal": (_CUS, F.col("c_acctbal")),
        "city": (_NAT, F.col("n_name")),
        "category": (_PART, F.col("p_type")),
        "product": (_PART, F.col("p_name")),
        "brand": (_PART, F.col("p_brand")),
    }


# the fact's column order when all columns are asked for
FULL_FACT = (
    "order_key", "line_number", "date", "customer_id", "category", "product", "sku", "brand",
    "quantity", "unit_price", "discount", "total_price", "is_holiday", "city", "loyalty_tier",
)


def sales_fact(spark: SparkSession, sf_dir: str, columns=FULL_FACT) -> DataFrame:
    """The line-level fact restricted to ``columns``; joins only what they need.

    One rule for every choice of columns: each line is one row.  Attributes of
    an order, customer, nation or part that isn't there are null; no join drops
    a line, so every figure over the fact covers the same lines.
    """
    spec = _fact_columns()
    columns = list(columns)
    unknown = [c for c in columns if c not in spec]
    if unknown:
        raise KeyError(f"unknown fact columns {unknown}")
    need = {spec[c][0] for c in columns}
    if _NAT in need:
        need.add(_CUS)
    if _CUS in need:
        need.add(_ORD)

    li_cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
    df = read_table(spark, sf_dir, "lineitem").select(*li_cols)
    if _ORD in need:
        # order-side dimensions are joined at order grain first (a bushy plan:
        # Catalyst keeps the written join order without statistics), so the
        # line rows are shuffled once for the order key, not again for the
        # customer key
        o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        if _CUS in need:
            c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
            o = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        if _NAT in need:
            n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
            o = o.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        df = df.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if _PART in need:
        p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
        df = df.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return df.select(*[spec[c][1].alias(c) for c in columns])


def _line_measures(spark: SparkSession, sf_dir: str, key: str, columns=(), extra=()) -> DataFrame:
    """Lines pre-aggregated by ``key`` (exact revenue, units, line count and the
    ``extra`` aggregates over ``columns``)."""
    li = read_table(spark, sf_dir, "lineitem").select(key, "l_quantity", "l_extendedprice", "l_discount", *columns)
    return li.groupBy(key).agg(
        F.sum(X.money(F.col("l_extendedprice"), F.col("l_discount"))).alias("revenue_dec"),
        F.sum("l_quantity").alias("units"),
        F.count(F.lit(1)).alias("lines"),
        *extra,
    )


def order_totals(spark: SparkSession, sf_dir: str, first_line: bool = False) -> DataFrame:
    """One row per order with lines: order_key, customer_id, date, revenue_dec, units, lines.

    With ``first_line`` also the struct (line_number, sku) of the order's first
    line; rows that repeat a line number count by the smaller part key.

    Eager aggregation: the lines are summed per order key *before* the join
    with ``orders`` (Spark does not push aggregates below joins itself).  The
    lines of an order are stored together, so the map-side partial aggregate
    shrinks the lineitem shuffle to about one row per order, and the
    aggregate's hash partitioning on the order key is reused by the join.
    Equal to grouping the line-level fact by order (sums decompose exactly).
    """
    extra = [F.min(F.struct(F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("sku"))).alias("first_line")]
    names = ["first_line"] if first_line else []
    per = _line_measures(spark, sf_dir, "l_orderkey", ["l_linenumber", "l_partkey"] if first_line else [], extra if first_line else [])
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return per.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        "revenue_dec", "units", "lines", *names,
    )


def part_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with lines: sku, product, category, brand, revenue_dec, units, lines.

    Eager aggregation by part key before the join with ``part``: the join
    then works on one row per part instead of one per line.
    """
    per = _line_measures(spark, sf_dir, "l_partkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return per.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_partkey").alias("sku"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        "revenue_dec", "units", "lines",
    )


def customers(spark: SparkSession, sf_dir: str, with_city: bool = True) -> DataFrame:
    """Customer attributes: customer_id, loyalty_tier and (customer x nation) city."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    if not with_city:
        return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("loyalty_tier"))
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("loyalty_tier"),
        F.col("n_name").alias("city"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair of names that a part has: item, product, category, product_item.

    ``item`` is a number for the pair, ``product_item`` one for the product (its
    smallest item).  Materialised: the numbers depend on the partitioning.
    """
    p = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("product"), F.col("p_type").alias("category"))
    checkpoint_dir(spark)
    pairs = p.distinct().select(F.monotonically_increasing_id().alias("item"), "product", "category").checkpoint(eager=True)
    return pairs.withColumn("product_item", F.min("item").over(Window.partitionBy("product")))


def item_lines(spark: SparkSession, sf_dir: str, numbered: DataFrame) -> DataFrame:
    """The lines with the numbers of ``items`` for their names: order_key, item,
    product_item, quantity, revenue_dec.

    As in ``sales_fact`` each line is one row, and one without a part has nulls.
    Where lines are shuffled by product and order, two numbers go in place of
    two names.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    p = p.join(numbered, p["p_name"].eqNullSafe(numbered["product"]) & p["p_type"].eqNullSafe(numbered["category"])) \
        .select("p_partkey", "item", "product_item")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    spec = _fact_columns()
    return li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        spec["order_key"][1].alias("order_key"), "item", "product_item",
        *(spec[c][1].alias(c) for c in ("quantity", "revenue_dec")))
