"""Inventory planning: volatility, safety stock, reorder points, EOQ.

Per-line statistics follow the reference (its "daily demand" is a mean over
transactions).  ``reorder_points_daily`` uses true daily demand: the mean and
sample standard deviation over *every* day of the calendar span, days
without sales counting as zero.  Zeros add nothing to sum(x) and sum(x^2), so
the statistics come from the observed product-days and the number of days in
the span, with no product x calendar densification.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import exprs as X
from tillroll.operators.kpi import product_demand

ORDER_COST = 50.0      # cost per order placed (EOQ parameter)
HOLDING_RATE = 0.2     # yearly holding cost as a share of unit cost
DAYS_PER_YEAR = 365.0


def _span(per_day: DataFrame, cols: list[str]) -> DataFrame:
    """Days from the first to the last date (one row).

    Min / max run over structs of all of ``per_day``'s columns (date first),
    so column pruning keeps this branch identical to the main one and Spark
    reuses the product-day aggregate instead of recomputing it.
    """
    s = F.struct(*cols)
    return per_day.agg((F.datediff(F.max(s)["date"], F.min(s)["date"]) + 1).alias("days"))


def product_volatility(fact: DataFrame) -> DataFrame:
    """Mean and sample std of quantity per product, CV, simple safety stock."""
    s = fact.where(F.col("product").isNotNull()).groupBy("product").agg(
        F.avg("quantity").alias("mean"),
        X.std6(F.col("quantity")).alias("std"),
    )
    return s.select(
        "product", "mean", "std",
        X.null_div(F.col("std"), F.col("mean")).alias("cv"),
        (F.col("std") * F.lit(X.SAFETY_Z_SIMPLE)).alias("safety_stock"),
    )


def top_volatile(vol: DataFrame, n: int = 10) -> DataFrame:
    return vol.orderBy(F.desc_nulls_last("cv"), "product").limit(n)


def safety_stock_simple(vol: DataFrame, n: int = 10) -> DataFrame:
    return vol.select("product", "mean", "safety_stock").orderBy("product").limit(n)


def with_reorder_points(demand: DataFrame, mean: str, std: str, z: float = X.Z_95,
                        lead_days: int = X.LEAD_TIME_DAYS) -> DataFrame:
    ss = F.col(std) * F.lit(z) * F.lit(math.sqrt(lead_days))
    return demand.withColumn("safety_stock", ss).withColumn(
        "reorder_point", F.col(mean) * F.lit(float(lead_days)) + F.col("safety_stock"))


def reorder_points(fact: DataFrame) -> DataFrame:
    return demand_reorder_points(product_demand(fact))


def demand_reorder_points(demand: DataFrame) -> DataFrame:
    return with_reorder_points(demand, "avg_demand", "std_demand")


def top_demand(points: DataFrame, n: int = 10) -> DataFrame:
    return points.orderBy(F.desc("total_demand"), "product").limit(n)


def reorder_points_daily(fact: DataFrame) -> DataFrame:
    """Daily demand statistics over the whole calendar span, zeros included."""
    per_day = fact.where(F.col("product").isNotNull()).groupBy("product", "date").agg(
        F.sum("quantity").alias("units"))
    span = _span(per_day, ["date", "product", "units"])
    s = per_day.groupBy("product").agg(
        F.sum("units").alias("total_demand"),
        F.sum(F.col("units") * F.col("units")).alias("_s2"),
        F.count(F.lit(1)).alias("selling_days"),
    ).crossJoin(F.broadcast(span))  # one-row span
    d = F.col("days").cast("double")
    s1 = F.col("total_demand").cast("double")
    var = (F.col("_s2").cast("double") - s1 * s1 / d) / (d - F.lit(1.0))
    out = s.select(
        "product", "days", "selling_days", "total_demand",
        (s1 / d).alias("avg_daily_demand"),
        F.when(F.col("days") > 1, X.round6(F.sqrt(F.greatest(var, F.lit(0.0))))).alias("std_daily_demand"),
    )
    return with_reorder_points(out, "avg_daily_demand", "std_daily_demand")


def economic_order_quantity(fact: DataFrame, order_cost: float = ORDER_COST,
                            holding_rate: float = HOLDING_RATE) -> DataFrame:
    """EOQ = sqrt(2 D S / H) per product.

    D = yearly demand (units over the span scaled to 365 days), S = cost per
    order, H = holding rate x unit cost (revenue-weighted list price per unit).
    """
    # one product-day pre-aggregate feeds both the calendar span and the
    # per-product sums, so the line-level join is computed once
    per_day = fact.where(F.col("product").isNotNull()).groupBy("product", "date").agg(
        F.sum("quantity").alias("units"),
        X.exact_sum(X.dec(F.col("extended_price"))).alias("_v"),
    )
    span = _span(per_day, ["date", "product", "units", "_v"])
    s = per_day.groupBy("product").agg(
        F.sum("units").alias("total_units"),
        F.sum("_v").alias("_value"),
    ).crossJoin(F.broadcast(span))
    annual = X.null_div(F.col("total_units") * F.lit(DAYS_PER_YEAR), F.col("days").cast("double"))
    unit_cost = X.null_div(X.to_double(F.col("_value")), F.col("total_units"))
    holding = F.lit(holding_rate) * unit_cost
    return s.select(
        "product", "total_units",
        annual.alias("annual_demand"),
        unit_cost.alias("unit_cost"),
        X.round6(F.sqrt(X.null_div(F.lit(2.0) * annual * F.lit(order_cost), holding))).alias("eoq"),
    )
