"""Customer analytics: RFM base, first attributes, scores, segments, CLV.

Everything is computed from the order-level frame (one row per order), so
``frequency`` is a plain count and the customer aggregate shuffles a quarter
of the line rows.  The snapshot date is a one-row global aggregate joined by
broadcast (its size is one row by construction).

Scores follow ``pandas.qcut`` (linear-interpolated, right-closed quartile
bins), not ``ntile``:
* R: quartiles of recency, labels reversed (recent = 4); recency is a number
  of days, so its histogram is bounded by the calendar span;
* F: quartiles of the rank of frequency, ties by customer id
  (``rank(method='first')``): the rank is a distributed global position and
  the quartiles of ranks 1..N are ``1 + p (N - 1)``;
* M: quartiles of monetary.
The quartiles of R and M are counted, not sorted for (``exact_quantiles``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import exprs as X
from tillroll.functions.ranking import QUARTILES, exact_quantiles, global_position, qcut_score
from tillroll.operators.kpi import orders_of

# The reference's segment rule (score code -> segment).
SEGMENT_RULES = (
    ("Champions", ("444", "443", "434", "344")),
    ("Loyal Customers", ("442", "441", "432", "431")),
    ("Potential Loyalists", ("333", "334", "343", "433")),
    ("New Customers", ("411", "412", "421", "422")),
    ("Promising", ("311", "312", "321", "322")),
    ("Need Attention", ("211", "212", "221", "222")),
)
DEFAULT_SEGMENT = "At Risk"


def rfm_base(fact: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """customer_id, recency, frequency, monetary, avg_order_value (+ exact monetary).

    Where ``orders`` have a ``first_line``, the same aggregate also finds each
    customer's ``first_order`` (date, order_key, first_line).
    """
    orders = orders if orders is not None else orders_of(fact)
    orders = orders.where(F.col("customer_id").isNotNull())
    per = orders.groupBy("customer_id").agg(
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("frequency"),
        X.exact_sum(F.col("revenue_dec")).alias("monetary_dec"),
        *([first_order()] if "first_line" in orders.columns else []),
    )
    more = [c for c in per.columns if c == "first_order"]
    # The snapshot (last date of all) from the customer rows.  The max runs
    # over a struct of every column, ordered by date first (same result), so
    # column pruning leaves both branches identical and Spark reuses the
    # customer aggregate's shuffle instead of recomputing the join.
    snap = per.agg(F.max(F.struct("last_date", "frequency", "monetary_dec", "customer_id", *more))["last_date"]
                   .alias("_snapshot"))
    return per.crossJoin(F.broadcast(snap)).select(
        "customer_id",
        F.datediff("_snapshot", "last_date").alias("recency"),
        "frequency",
        X.to_double(F.col("monetary_dec")).alias("monetary"),
        X.safe_div(X.to_double(F.col("monetary_dec")), F.col("frequency")).alias("avg_order_value"),
        "monetary_dec", *more,
    )


def first_order() -> Column:
    """Aggregate: the earliest (date, order key) of a customer with its first line."""
    return F.min(F.struct("date", "order_key", "first_line")).alias("first_order")


def customer_first_attributes(firsts: DataFrame, parts: DataFrame, customers: DataFrame,
                              keep: tuple[str, ...] = ("customer_id",)) -> DataFrame:
    """First product/category bought and the customer's tier and city.

    ``first`` in row order becomes the minimum over a total order of the lines
    (date, order, line, part).  ``firsts`` has one row per customer (customer_id,
    ``first_order``), so parts (sku, product, category) and customer attributes
    (customer_id, loyalty_tier, city) are joined at customer grain: no line
    reaches a join but the one with its order.  ``keep``: columns of ``firsts``
    to carry along.
    """
    line = F.col("first_order.first_line.sku")
    return firsts.join(parts, line == F.col("sku"), "left").join(customers, "customer_id", "left").select(
        *keep,
        F.col("first_order.date").alias("first_date"),
        F.col("product").alias("first_product"),
        F.col("category").alias("first_category"),
        "loyalty_tier", "city",
    )


def rfm_with_attributes(base: DataFrame, parts: DataFrame, customers: DataFrame) -> DataFrame:
    """RFM figures with the first attributes; ``base`` holds each customer's
    ``first_order``, so both come from one aggregate."""
    keep = ("customer_id", "recency", "frequency", "monetary", "avg_order_value")
    return customer_first_attributes(base, parts, customers, keep)


def rfm_scores(base: DataFrame) -> DataFrame:
    """R, F, M scores, the three-digit code (keeps ``monetary_dec``)."""
    # The ranked frame is checkpointed: the customer aggregate is computed
    # once and the R and M cut points are counted on the materialised rows.
    ranked = global_position(base, ["frequency", "customer_id"], name="f_rank")
    long = ranked.selectExpr("stack(2, 'r', cast(recency as double), 'm', monetary) as (metric, x)")
    cuts = exact_quantiles(long, "x", QUARTILES, "metric")
    none = [None] * len(QUARTILES)
    r_cut, m_cut = ([F.lit(q).cast("double") for q in cuts.get(m, none)] for m in ("r", "m"))
    n = ranked.count()
    f_cut = [F.lit(1.0 + p * (n - 1)) for p in QUARTILES]
    r = qcut_score(F.col("recency").cast("double"), *r_cut, ("4", "3", "2", "1"))
    f = qcut_score(F.col("f_rank").cast("double"), *f_cut)
    m = qcut_score(F.col("monetary"), *m_cut)
    return ranked.select(
        "customer_id", "recency", "frequency", "monetary", "avg_order_value", "monetary_dec",
        r.alias("r_score"), f.alias("f_score"), m.alias("m_score"),
    ).withColumn("rfm_score", F.concat("r_score", "f_score", "m_score"))


def segment_of(code) -> "F.Column":
    expr = None
    for name, codes in SEGMENT_RULES:
        cond = code.isin(*codes)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(DEFAULT_SEGMENT))


def rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.withColumn("segment", segment_of(F.col("rfm_score")))


def public(seg: DataFrame) -> DataFrame:
    return seg.drop("monetary_dec")


def segment_distribution(seg: DataFrame) -> DataFrame:
    counts = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    total = F.sum("customers").over(Window.partitionBy())  # one row per segment (7)
    return counts.select("segment", "customers",
                         (F.col("customers") * F.lit(100.0) / total).alias("share_pct")).orderBy("segment")


def segment_revenue(seg: DataFrame) -> DataFrame:
    return seg.groupBy("segment").agg(X.money_sum(F.col("monetary_dec")).alias("revenue"))


def segment_profiles(seg: DataFrame, key: str = "segment") -> DataFrame:
    """Mean recency, frequency, monetary and AOV per segment, rounded to 2."""
    n = F.count(F.lit(1))
    return seg.groupBy(key).agg(
        F.round(F.sum("recency") / n, 2).alias("recency"),
        F.round(F.sum("frequency") / n, 2).alias("frequency"),
        F.round(X.money_sum(F.col("monetary_dec")) / n, 2).alias("monetary"),
        F.round(F.avg("avg_order_value"), 2).alias("avg_order_value"),
        n.alias("customers"),
    )


def top_segment(seg: DataFrame) -> DataFrame:
    """Mode of the segment column; ties by name."""
    return seg.groupBy("segment").agg(F.count(F.lit(1)).alias("customers")) \
        .orderBy(F.desc("customers"), "segment").limit(1)


def customer_value_summary(seg: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return seg.agg(
        n.alias("customers"),
        X.null_div(X.money_sum(F.col("monetary_dec")), n).alias("avg_customer_value"),
        X.money_sum(F.col("monetary_dec")).alias("total_customer_value"),
    )


def dim_customers(seg: DataFrame, tiers: DataFrame) -> DataFrame:
    """Customer dimension: RFM figures, rule segment and loyalty tier."""
    return seg.select("customer_id", "recency", "frequency", "monetary", "avg_order_value", "segment") \
        .join(tiers, "customer_id", "left")


def rfm_scaled(base: DataFrame) -> DataFrame:
    """Standardised R, F, M, AOV: (x - mean) / sample std, 6 decimals."""
    feats = ["recency", "frequency", "monetary", "avg_order_value"]
    stats = base.agg(*[F.avg(c).alias(f"_mu_{c}") for c in ("recency", "frequency")],
                     X.null_div(X.money_sum(F.col("monetary_dec")), F.count(F.lit(1))).alias("_mu_monetary"),
                     F.avg("avg_order_value").alias("_mu_avg_order_value"),
                     *[F.stddev_samp(c).alias(f"_sd_{c}") for c in feats])
    out = base.crossJoin(F.broadcast(stats))
    return out.select("customer_id", *[
        X.round6(X.null_div(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}"))).alias(f"{c}_z") for c in feats
    ])


def customer_clv(fact_orders: DataFrame, horizon_years: int = 3) -> DataFrame:
    """Historical CLV = AOV x orders per year x horizon.

    Orders per year = orders * 365 / max(tenure days, 365), tenure from the
    first to the last order (both inclusive); shorter histories count as
    one year.
    """
    per = fact_orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("frequency"),
        X.exact_sum(F.col("revenue_dec")).alias("_m"),
    )
    tenure = F.datediff("last_date", "first_date") + 1
    aov = X.to_double(F.col("_m")) / F.col("frequency")
    per_year = (F.col("frequency") * 365).cast("double") / F.greatest(tenure, F.lit(365)).cast("double")
    return per.select(
        "customer_id", "first_date", "last_date", "frequency",
        aov.alias("avg_order_value"),
        per_year.alias("orders_per_year"),
        X.round6(aov * per_year * F.lit(float(horizon_years))).alias("clv"),
    )
