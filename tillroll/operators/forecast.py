"""Forecast building blocks that are plain SQL: trend line, error metrics,
exponential smoothing (plain and seasonal), autoregressions per series (of lag 1
and of chosen order), seasonal regressors.

Metrics (MAE, RMSE, R^2, MAPE) are one aggregate over (actual, predicted).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import exprs as X

SES_ALPHA = 0.3
YEAR_DAYS = 365.25
WEEK_DAYS = 7.0
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
AR_MOST = 6              # orders tried for each series
SEASON = 12              # months
# Trials of the seasonal smoothing: weights of the error in level, trend and season.
LEVEL_WEIGHTS = (0.1, 0.3, 0.5, 0.7, 0.9)
TREND_WEIGHTS = (0.0, 0.02, 0.1)
SEASON_WEIGHTS = (0.0, 0.05, 0.1)
MAPE_EPS = 2.220446049250313e-16  # floor of |y| in MAPE (machine epsilon)


def day_index(daily: DataFrame) -> DataFrame:
    """Days since the first date (t = 0, 1, ...)."""
    # min over a struct of all columns (date first): keeps this branch
    # identical to the main one under column pruning, so the daily aggregate
    # is computed once
    first = daily.agg(F.min(F.struct("date", *[c for c in daily.columns if c != "date"]))["date"].alias("_d0"))
    return daily.crossJoin(F.broadcast(first)).withColumn("t", F.datediff("date", "_d0")).drop("_d0")


def trend_line(daily: DataFrame, value: str = "revenue") -> DataFrame:
    """Least-squares line value ~ t over the daily series."""
    d = day_index(daily)
    return d.agg(
        X.round6(F.regr_slope(value, "t")).alias("slope"),
        X.round6(F.regr_intercept(value, "t")).alias("intercept"),
        X.round6(F.regr_r2(value, "t")).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def metrics(scored: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R^2 and MAPE (percent) over rows with both values, per group of
    ``by`` if given."""
    s = scored.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(actual) - F.col(predicted)
    y = F.col(actual)
    n = F.count(F.lit(1))
    sse = F.sum(e * e)
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return s.groupBy(*by).agg(
        n.alias("n"),
        X.round6(F.avg(F.abs(e))).alias("mae"),
        X.round6(F.sqrt(sse / n)).alias("rmse"),
        X.round6(F.lit(1.0) - sse / sst).alias("r2"),
        X.round6(F.lit(100.0) * F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(MAPE_EPS)))).alias("mape"),
    )


def naive_forecast(daily: DataFrame, lag: int = 7) -> DataFrame:
    """Seasonal naive forecast: the value ``lag`` rows earlier."""
    w = Window.orderBy("date")
    return daily.select("date", F.col("revenue").alias("actual"), F.lag("revenue", lag).over(w).alias("predicted"))


def ses_level(dps: DataFrame, alpha: float = SES_ALPHA) -> DataFrame:
    """Simple exponential smoothing level per product over its daily units.

    Each product's series has at most one value per calendar day, so the
    ordered array per product is bounded by the calendar span.  The fold is
    the native higher-order ``aggregate`` (no UDF).
    """
    per_day = dps.groupBy("product", "date").agg(F.sum("units").alias("units"))
    series = per_day.groupBy("product").agg(
        F.array_sort(F.collect_list(F.struct("date", "units"))).alias("_s"))
    ys = F.transform("_s", lambda s: s["units"])
    a, b = F.lit(alpha), F.lit(1.0 - alpha)
    level = F.aggregate(F.slice(ys, 2, 1 << 30), ys[0], lambda acc, x: a * x + b * acc)
    return series.select("product", F.size("_s").alias("n_days"), X.round6(level).alias("level"))


def ar1_by_product(dps: DataFrame) -> DataFrame:
    """AR(1) per product: units_t ~ units_{t-1} by least squares (rows)."""
    per_day = dps.groupBy("product", "date").agg(F.sum("units").alias("units"))
    w = Window.partitionBy("product").orderBy("date")
    lagged = per_day.select("product", "units", F.lag("units", 1).over(w).alias("prev"))
    return lagged.where(F.col("prev").isNotNull()).groupBy("product").agg(
        X.round6(F.regr_slope("units", "prev")).alias("phi"),
        X.round6(F.regr_intercept("units", "prev")).alias("c"),
        F.count(F.lit(1)).alias("n"),
    )


def fourier_columns(t_col: str = "t") -> list:
    """Yearly (order 10) and weekly (order 3) sine/cosine terms of day index t."""
    cols = []
    for name, period, order in (("yearly", YEAR_DAYS, YEARLY_ORDER), ("weekly", WEEK_DAYS, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            arg = F.lit(2.0 * math.pi * k) * F.col(t_col).cast("double") / F.lit(period)
            cols.append(X.round6(F.sin(arg)).alias(f"{name}_sin_{k}"))
            cols.append(X.round6(F.cos(arg)).alias(f"{name}_cos_{k}"))
    return cols


def seasonal_regressors(calendar: DataFrame) -> DataFrame:
    """Trend index and Fourier terms for every date of ``calendar``."""
    d = day_index(calendar)
    return d.select("date", "is_future", "t", *fourier_columns())


def autocorrelations(per_day: DataFrame, most: int = AR_MOST, key: str = "product", value: str = "units") -> DataFrame:
    """(key, n, mean, r1, r2, ...): the autocorrelations at lags 1 to ``most``.

    One window and one aggregation give the sums of every lag; sums of whole
    numbers are exact, and the mean is taken off them afterwards.  Constant
    series, and lags that a series is too short for, have 0.
    """
    w = Window.partitionBy(key).orderBy("date")
    lags = range(1, most + 1)
    x = F.col(value).cast("double")
    rows = per_day.where(F.col(value).isNotNull()).select(key, x.alias("x"), *(F.lag(x, k).over(w).alias(f"b{k}") for k in lags))
    sums = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.sum(F.col("x") * F.col("x")).alias("s0"),
        *(F.sum(F.col("x") * F.col(f"b{k}")).alias(f"s{k}") for k in lags),
        *(F.sum(F.when(F.col(f"b{k}").isNotNull(), F.col("x") + F.col(f"b{k}"))).alias(f"e{k}") for k in lags))
    mean, n = F.col("mean"), F.col("n")
    spread = F.col("s0") - n * mean * mean
    alike = lambda k: (F.col(f"s{k}") - mean * F.col(f"e{k}") + (n - k) * mean * mean) / spread
    vary = spread > F.lit(1e-9) * F.col("s0")
    return sums.select(key, "n", "mean", *(F.when(vary & (n > k), alike(k)).otherwise(0.0).alias(f"r{k}") for k in lags))


def ar_order_by_product(per_day: DataFrame, most: int = AR_MOST, key: str = "product", value: str = "units") -> DataFrame:
    """Autoregression per series with the order of least information criterion.

    The Levinson-Durbin recursion over a series' autocorrelations gives the
    coefficients of every order up to ``most``, one order from the one before; the
    order with the least ``n ln(error) + 2 order`` stays (ties: the lower one).
    Columns: key, n, mean, ar_order, phi_1 ... (0 beyond the order), error (share of the
    variance left) and ``off``, by how much the normal equations fail (0).
    """
    steps = autocorrelations(per_day, most, key, value)
    r = lambda k: F.col(f"r{abs(k)}") if k else F.lit(1.0)
    steps = steps.withColumn("error_0", F.lit(1.0))
    for p in range(1, most + 1):
        known = [F.col(f"a{p - 1}_{j}") for j in range(1, p)]
        k = (r(p) - sum((a * r(p - j) for j, a in enumerate(known, 1)), F.lit(0.0))) / F.col(f"error_{p - 1}")
        steps = steps.withColumn(f"a{p}_{p}", k)
        last = F.col(f"a{p}_{p}")
        steps = steps.withColumns({f"a{p}_{j}": a - last * known[p - j - 1] for j, a in enumerate(known, 1)} | {
            f"error_{p}": F.greatest(F.col(f"error_{p - 1}") * (1 - last * last), F.lit(1e-12))})
    score = lambda p: F.col("n") * F.log(f"error_{p}") + 2.0 * p
    best = F.least(*(F.struct(score(p).alias("score"), F.lit(p).alias("p")) for p in range(most + 1)))["p"]
    steps = steps.withColumn("ar_order", best)
    of = lambda names, none: F.coalesce(*(F.when(F.col("ar_order") == p, F.col(c)) for p, c in names), F.lit(none))
    phi = {f"phi_{j}": of([(p, f"a{p}_{j}") for p in range(j, most + 1)], 0.0) for j in range(1, most + 1)}
    chosen = steps.withColumns(phi | {"error": of([(p, f"error_{p}") for p in range(1, most + 1)], 1.0)})
    fails = [F.when(F.col("ar_order") >= i, F.abs(sum((F.col(f"phi_{j}") * r(i - j) for j in range(1, most + 1)), F.lit(0.0)) - r(i)))
             .otherwise(0.0) for i in range(1, most + 1)]
    return chosen.select(key, "n", X.round6(F.col("mean")).alias("mean"), "ar_order", *(X.round6(F.col(c)).alias(c) for c in phi),
                         X.round6(F.col("error")).alias("error"), X.round6(F.greatest(*fails)).alias("off"))


def seasonal_smoothing(rows: DataFrame, key: str = "product", value: str = "units") -> DataFrame:
    """Level, trend and season (12 months) per series, the trial of least error.

    A series has a value for each month between the first and the last of all
    (0 where it has no row).  The step from its first year to the second gives the
    trend, the first year the level and, with the trend taken off, the season; from then on each month's error corrects
    the three by a trial's weights.  One native fold a series and trial; a series
    is as long as the calendar.  Months of under two years: no rows.
    Columns: key, months, the weights, rmse of one month ahead, level, trend,
    next_month and next_year.
    """
    month = F.year("date") * SEASON + F.month("date") - 1
    per = rows.where(F.col("date").isNotNull()).groupBy(key, month.alias("m")).agg(F.sum(value).cast("double").alias("x"))
    series = per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("m", "x"))).alias("at"),
                                  F.min("m").alias("lo"), F.max("m").alias("hi"))
    ends = series.agg(F.min(F.struct("lo", "hi", key, F.size("at")))["lo"].alias("lo_"), F.max(F.struct("hi", "lo", key, F.size("at")))["hi"].alias("hi_"))
    full = series.crossJoin(F.broadcast(ends)).select(
        key, F.transform(F.sequence("lo_", "hi_"), lambda m: F.coalesce(F.try_element_at("at", m), F.lit(0.0))).alias("x"))
    full = full.where(F.size("x") >= 2 * SEASON)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    weights = [(a, b, g) for a in LEVEL_WEIGHTS for b in TREND_WEIGHTS for g in SEASON_WEIGHTS]
    trials = F.array(*(F.struct(F.lit(i).alias("trial"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma"))
                       for i, (a, b, g) in enumerate(weights)))
    first, second = total(F.slice("x", 1, SEASON)) / SEASON, total(F.slice("x", SEASON + 1, SEASON)) / SEASON
    # the first year's line: its mean in the middle, the trend's slope; the season is what the line leaves
    middle = (SEASON - 1) / 2
    start = full.select(key, "x", first.alias("mean"), ((second - first) / SEASON).alias("trend")).select(
        key, "x", (F.col("mean") + middle * F.col("trend")).alias("level"), "trend",
        F.transform(F.slice("x", 1, SEASON), lambda v, i: v - (F.col("mean") + (i - middle) * F.col("trend"))).alias("season"))
    runs = start.select("*", F.inline(trials))

    def corrected(s, x):
        e = x - (s["level"] + s["trend"] + s["season"][0])
        return F.struct(
            (s["level"] + s["trend"] + F.col("alpha") * e).alias("level"), (s["trend"] + F.col("beta") * e).alias("trend"),
            F.concat(F.slice(s["season"], 2, SEASON - 1), F.array(s["season"][0] + F.col("gamma") * e)).alias("season"),
            (s["sse"] + e * e).alias("sse"))

    ended = runs.withColumn("s", F.aggregate(F.slice("x", SEASON + 1, 1 << 30),
                                             F.struct("level", "trend", "season", F.lit(0.0).alias("sse")), corrected))
    best = ended.groupBy(key).agg(F.min(F.struct(
        F.col("s.sse").alias("sse"), "trial", F.size("x").alias("months"), "alpha", "beta", "gamma",
        F.col("s.level").alias("level"), F.col("s.trend").alias("trend"), F.col("s.season").alias("season"))).alias("b")).select(key, "b.*")
    return best.select(
        key, "months", "alpha", "beta", "gamma", X.round6(F.sqrt(F.col("sse") / (F.col("months") - SEASON))).alias("rmse"),
        X.round6(F.col("level")).alias("level"), X.round6(F.col("trend")).alias("trend"),
        X.round6(F.col("level") + F.col("trend") + F.col("season")[0]).alias("next_month"),
        X.round6(F.col("level") * SEASON + F.col("trend") * (SEASON * (SEASON + 1) // 2) + total(F.col("season"))).alias("next_year"))
