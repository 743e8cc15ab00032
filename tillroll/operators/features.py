"""Calendar, lag and rolling features; the product-day and daily model frames.

Windows count observed rows, not calendar days (pandas ``shift`` /
``rolling``); ``calendar_fill`` densifies explicitly when days are wanted.

Two window layouts:
* per product: ``partitionBy(product, category).orderBy(date)`` over the
  product-day aggregate, so a partition holds at most one row per calendar
  day whatever the data volume;
* the daily series: one row per day, a frame bounded by the calendar span
  (a few thousand rows), which is the only place a window without
  ``partitionBy`` is used.

``frame='compat'`` reproduces the reference (rolling frame ends at the
current row, which is the target); ``frame='causal'`` ends one row earlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import exprs as X
from tillroll.functions.ranking import global_position
from tillroll.session import checkpoint_dir

# Fixed values of the reference's feature set.
PRODUCT_LAGS = (1, 7)
DAILY_LAGS = (1, 2, 3, 7, 14)
DAILY_WINDOWS = (7, 14)
PRODUCT_ROLLING = 7
SEQUENCE_LENGTH = 30
TRAIN_FRACTION = 0.8
HORIZON_DAYS = 90


def _frame(n: int, frame: str) -> tuple[int, int]:
    if frame == "compat":
        return -(n - 1), 0
    if frame == "causal":
        return -n, -1
    raise ValueError(f"frame must be 'compat' or 'causal', not {frame!r}")


def calendar_features(fact: DataFrame) -> DataFrame:
    """Calendar fields for every day with sales (``fact``: line or order rows)."""
    days = fact.select("date").where(F.col("date").isNotNull()).distinct()
    cal = X.calendar_columns(F.col("date"))
    return days.select(
        "date", *[v.alias(k) for k, v in cal.items()],
        F.year("date").cast("int").alias("year"),
        F.date_format("date", "E").alias("day_name"),
    )


def date_bounds(daily: DataFrame, cols=()) -> DataFrame:
    """First and last date (one row).

    Min / max run over a struct of the columns the caller's main branch also
    reads (date first: same result), so column pruning keeps both branches
    identical and Spark reuses the daily aggregate instead of recomputing it.
    """
    s = F.struct("date", *[c for c in cols if c != "date"])
    return daily.agg(F.min(s)["date"].alias("_lo"), F.max(s)["date"].alias("_hi"))


def calendar_fill(daily: DataFrame, value: str = "revenue") -> DataFrame:
    """Dense calendar from the first to the last day, missing days = 0.

    The calendar is generated from a one-row min/max aggregate; its size is
    the calendar span, not the data volume.
    """
    days = date_bounds(daily, [value]).select(F.explode(F.sequence("_lo", "_hi")).alias("date"))
    return days.join(daily, "date", "left").select(
        "date",
        F.coalesce(F.col(value), F.lit(0.0)).alias(value),
        F.col(value).isNotNull().alias("has_sales"),
    )


def future_calendar(daily: DataFrame, periods: int = HORIZON_DAYS) -> DataFrame:
    """Observed days plus ``periods`` days after the last one."""
    hist = daily.select("date", F.lit(False).alias("is_future"))
    fut = date_bounds(daily).select(
        F.explode(F.sequence(F.date_add("_hi", 1), F.date_add("_hi", periods))).alias("date"),
        F.lit(True).alias("is_future"),
    )
    return hist.unionByName(fut)


def _product_window() -> Window:
    return Window.partitionBy("product", "category").orderBy("date")


def lag_features(dps: DataFrame, lags: Sequence[int] = PRODUCT_LAGS, products: Sequence[str] | None = None) -> DataFrame:
    """Lags of units per product (rows, not days); optionally only ``products``."""
    w = _product_window()
    if products is not None:
        dps = dps.where(F.col("product").isin(*products))
    return dps.select("date", "product", "category", "units",
                      *[F.lag("units", k).over(w).alias(f"lag{k}") for k in lags])


def first_products(rows: DataFrame, k: int = 5, cols: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` products in order of first appearance (P6).

    ``rows`` are lines or product-day rows (same first dates).  Ties on the
    first date are broken by the product name.  Each product is reduced to one
    row before the (bounded, ``k``-row) top-k.  The first date is the min of a
    struct (date first, then ``cols``): listing the columns the caller's other
    branch reads keeps both branches identical, so they share one aggregate.
    """
    first = rows.where(F.col("product").isNotNull()).groupBy("product").agg(
        F.min(F.struct("date", *cols))["date"].alias("first_date"))
    return first.orderBy("first_date", "product").limit(k).select("product")


def lag_features_top5(dps: DataFrame, k: int = 5) -> DataFrame:
    """The reference's variant: lags only for the first ``k`` products.

    The first products are read from the product-day rows themselves, so the
    line-level join is computed once for both branches.
    """
    keep = first_products(dps, k, ["category", "units"])
    # the kept list has k rows: a broadcast semi-join
    return lag_features(dps.join(F.broadcast(keep), "product", "left_semi"))


def rolling_mean_product(dps: DataFrame, n: int = PRODUCT_ROLLING, frame: str = "compat") -> DataFrame:
    """Mean of units over the last ``n`` rows per product, partial frames allowed."""
    lo, hi = _frame(n, frame)
    w = _product_window().rowsBetween(lo, hi)
    return dps.select("date", "product", "category", "units", F.avg("units").over(w).alias(f"rolling_mean_{n}"))


def product_codes(rows: DataFrame) -> DataFrame:
    """Alphabetical 0-based code per product of ``rows`` (``LabelEncoder``)."""
    prods = rows.select("product").where(F.col("product").isNotNull()).distinct()
    return global_position(prods, ["product"], name="_pos").select(
        "product", (F.col("_pos") - 1).cast("int").alias("product_code"))


def model_frame(dps: DataFrame, frame: str = "compat") -> DataFrame:
    """product-day rows with calendar, lag 1 and 7, rolling mean and code.

    Like the reference, the label encoder is fitted on the rows left after
    dropping missing lags.  Those rows are checkpointed once (product-day
    rows: calendar x catalog), so the codes and the features come from one
    computation of the aggregate.
    """
    lo, hi = _frame(PRODUCT_ROLLING, frame)
    w = _product_window()
    cal = X.calendar_columns(F.col("date"))
    feats = dps.select(
        "date", "product", "category", "units",
        *[v.alias(k) for k, v in cal.items() if k != "day_of_year"],
        *[F.lag("units", k).over(w).alias(f"lag{k}") for k in PRODUCT_LAGS],
        F.avg("units").over(w.rowsBetween(lo, hi)).alias("rolling_mean_7"),
    ).na.drop(subset=[f"lag{k}" for k in PRODUCT_LAGS])
    checkpoint_dir(feats.sparkSession)
    feats = feats.checkpoint(eager=True)
    # product codes: one row per product, joined back on the product key
    return feats.join(product_codes(feats), "product")


def daily_features(metrics: DataFrame, frame: str = "compat") -> DataFrame:
    """daily metrics, calendar, revenue lags and full-frame rolling stats.

    Rows with any missing feature are dropped (``dropna``).
    """
    w = Window.orderBy("date")
    cols: list[Column] = [
        "date", "revenue", "units", "unique_customers", "transactions",
        X.weekday(F.col("date")).alias("dayofweek"),
        F.month("date").cast("int").alias("month"),
        F.quarter("date").cast("int").alias("quarter"),
        F.dayofyear("date").cast("int").alias("dayofyear"),
        X.is_weekend(F.col("date")).alias("is_weekend"),
    ]
    cols += [F.lag("revenue", k).over(w).alias(f"revenue_lag_{k}") for k in DAILY_LAGS]
    for n in DAILY_WINDOWS:
        cols += rolling_full("revenue", n, w, frame)
    return metrics.select(*cols).na.drop()


def rolling_full(value: str, n: int, w: Window, frame: str = "compat") -> list[Column]:
    """Mean and sample std over the last ``n`` rows, null until the frame is full.

    The moments come from exact decimal sums (a day's revenue has 4
    decimals), so sum(x) and sum(x*x) over the frame are exact and the
    result does not depend on the summation order of a windowed double sum.
    """
    lo, hi = _frame(n, frame)
    wf = w.rowsBetween(lo, hi)
    x = F.col(value).cast("decimal(18,4)")
    full = F.count(value).over(wf) >= n
    s1 = X.to_double(F.sum(x).over(wf))
    s2 = X.to_double(F.sum(x * x).over(wf))
    var = F.greatest(F.lit(0.0), (s2 - s1 * s1 / F.lit(float(n))) / F.lit(float(n - 1)))
    return [
        F.when(full, s1 / F.lit(float(n))).alias(f"{value}_rolling_mean_{n}"),
        F.when(full, X.round6(F.sqrt(var))).alias(f"{value}_rolling_std_{n}"),
    ]


def revenue_sequences(daily: DataFrame, n: int = SEQUENCE_LENGTH) -> DataFrame:
    """Sliding windows of ``n`` revenues and the value that follows (W7).

    Returns the window as an array plus checksum columns.
    """
    w = Window.orderBy("date").rowsBetween(-n, -1)
    seq = daily.select(
        "date",
        F.col("revenue").alias("target"),
        F.collect_list("revenue").over(w).alias("window"),
        X.to_double(F.sum(F.col("revenue").cast("decimal(18,4)")).over(w)).alias("window_sum"),
    ).where(F.size("window") == n)
    return seq.select(
        "date", "target", "window",
        F.col("window")[0].alias("window_first"),
        F.col("window")[n - 1].alias("window_last"),
        "window_sum",
        F.size("window").alias("window_size"),
    )


def chrono_split(daily: DataFrame, train_fraction: float = TRAIN_FRACTION) -> DataFrame:
    """First ``floor(0.8 n)`` days train, the rest validation (by position)."""
    w = Window.orderBy("date")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return daily.select(
        "date", "revenue",
        F.row_number().over(w).alias("row_index"),
        n.alias("_n"),
    ).select(
        "date", "revenue", "row_index",
        F.when(F.col("row_index") <= F.floor(F.col("_n") * F.lit(train_fraction)), F.lit("train"))
        .otherwise(F.lit("validation")).alias("split"),
    )


def last_n_days(daily: DataFrame, n: int = HORIZON_DAYS) -> DataFrame:
    return daily.orderBy(F.desc("date")).limit(n)


def minmax_scale(daily: DataFrame, value: str = "revenue") -> DataFrame:
    """Min-max scaling and its inverse (F12)."""
    b = daily.agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    scaled = daily.crossJoin(F.broadcast(b)).select(
        "date", value,
        X.null_div(F.col(value) - F.col("_mn"), F.col("_mx") - F.col("_mn")).alias("scaled"),
        "_mn", "_mx",
    )
    return scaled.select(
        "date", value, "scaled",
        (F.col("scaled") * (F.col("_mx") - F.col("_mn")) + F.col("_mn")).alias("restored"),
    )
