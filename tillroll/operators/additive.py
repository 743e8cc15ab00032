"""Additive revenue forecast: a trend whose slope changes sparsely, yearly and
weekly seasons, bounds that widen with the horizon.

The family is that of Taylor and Letham, "Forecasting at scale" (2018): slope
changes at 25 days of the first 80 % of the history under a Laplace prior,
Fourier terms and the line's own terms under normal priors, normal noise.  The
most probable parameters minimise

    |y - X b|^2 / 2 + sigma^2 * (sum |b_c| / PRIOR_CHANGE + sum b_s^2 / (2 prior_s^2))

over the changes ``c`` and the other terms ``s``; sigma^2 is the mean squared
residual, found by repetition.

* The regressors are whole numbers (millionths), revenue is in hundredths, so
  the Gram matrix is exact whatever the partitions.  It is one aggregation with
  map-side sums; only its 54 x 54 numbers reach the driver.
* The terms without a Laplace prior are eliminated, the changes are found by
  coordinate descent on what remains of the Gram matrix, and as soon as their
  signs stand the active ones are solved for exactly.
* Bounds past the last day come from seeded draws of future slope changes (as
  frequent and as large as those of the history) and noise.

No observed day: no rows.  Days without revenue (null) are predicted but not
fitted.  Days that are missing are neither.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.operators import forecast as FC
from tillroll.operators.ml import HORIZON, INTERVAL_Z, SEED, materialized

UNIT = 1_000_000
CENTS = 100
CHANGES = 25
CHANGE_PERCENT = 80      # of the history's days, from the first on
PRIOR_CHANGE = 0.05      # scale of the Laplace prior of a slope change
PRIOR_LINE = 5.0         # standard deviations of the normal priors
PRIOR_SEASON = 10.0
DRAWS = 1000             # simulated futures, half of them mirrored
BAND = 0.9               # upper quantile of the band, the lower mirrors it


class Fit(NamedTuple):
    names: list[str]      # of the regressors, in order
    coef: list[float]     # in units of ``scale``
    penalty: list[float]  # weight of |b| for changes, of b^2 / 2 for the others
    sigma: float          # of the noise, in units of ``scale``
    scale: float          # largest absolute revenue
    days: int             # of the history, less one

    def value(self, terms: list[str]):
        """The part of the prediction that ``terms`` make up."""
        at = {n: c for n, c in zip(self.names, self.coef)}
        return sum((F.lit(at[n] * self.scale / UNIT) * F.col(n) for n in terms), F.lit(0.0))


def change_days(days: int, changes: int = CHANGES) -> list[int]:
    """Days on which the slope may change; fewer on a history shorter than they are."""
    return sorted({CHANGE_PERCENT * days * j // (100 * (changes + 1)) for j in range(1, changes + 1)})


def regressors(calendar: DataFrame, days: int) -> tuple[DataFrame, list[str]]:
    """``calendar`` (with day index ``t``) and its regressors in millionths."""
    at = change_days(days)
    over = F.lit(max(days, 1))
    seasons = calendar.select("*", *FC.fourier_columns())
    names = [c for c in seasons.columns if c.startswith(("yearly_", "weekly_"))]
    whole = lambda c: F.floor(c.cast("long") * UNIT / over)
    frame = seasons.select(
        *calendar.columns,
        F.lit(UNIT).cast("long").alias("one"),
        whole(F.col("t")).alias("line"),
        *(whole(F.greatest(F.col("t") - c, F.lit(0))).alias(f"change_{j}") for j, c in enumerate(at)),
        *(F.round(F.col(c) * UNIT).cast("long").alias(c) for c in names))
    return frame, ["one", "line", *(f"change_{j}" for j in range(len(at))), *names]


def target(revenue: str = "revenue"):
    """Revenue in hundredths, a whole number."""
    return F.floor(F.col(revenue) * CENTS + 0.5).cast("decimal(25,0)")


def gram(frame: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, value): sums of products of the regressors and, last, the target,
    over the rows with a revenue; ``i <= j`` count from 1, values are exact.

    A row becomes one row per pair of regressors, summed in the task that reads
    it; products of millionths stay far below a long's limit.
    """
    x, last = F.array(*names), len(names) + 1
    rows = frame.where(F.col("revenue").isNotNull()).select(x.alias("x"), target().alias("y"))
    left = rows.select("x", F.posexplode("x").alias("i", "a"))
    pairs = left.select((F.col("i") + 1).alias("i"), "a", F.posexplode(F.slice("x", F.col("i") + 1, last)).alias("k", "b"))
    inner = pairs.groupBy("i", (F.col("i") + F.col("k")).alias("j")).agg(F.sum(F.col("a") * F.col("b")).alias("value"))
    with_y = rows.select("y", F.posexplode(F.concat(F.transform("x", lambda v: v.cast("decimal(25,0)")), F.array("y"))).alias("i", "a"))
    outer = with_y.groupBy((F.col("i") + 1).alias("i")).agg(F.sum((F.col("a") * F.col("y")).cast("decimal(38,0)")).alias("value"))
    whole = F.col("value").cast("decimal(38,0)").alias("value")
    return inner.select("i", "j", whole).union(outer.select("i", F.lit(last), whole))


def _sparse(m: np.ndarray, c: np.ndarray, weight: float, start: np.ndarray) -> np.ndarray:
    """The b that minimises ``b'mb / 2 - c'b + weight * sum |b|``."""
    b = start.copy()
    for sweep in range(50_000):
        for j in range(len(b)):
            if m[j, j] > 0:
                r = c[j] - m[j] @ b + m[j, j] * b[j]
                b[j] = np.sign(r) * max(abs(r) - weight, 0.0) / m[j, j]
        if sweep % 100 == 99:  # do the signs of now stand when solved for?
            on = b != 0
            exact, sign = np.zeros(len(b)), np.sign(b)
            if on.any():
                exact[on] = np.linalg.lstsq(m[np.ix_(on, on)], c[on] - weight * sign[on], rcond=None)[0]
            slack = 1e-9 * max(float(np.abs(c).max()), weight)
            if (np.sign(exact) == sign).all() and (np.abs(c - m @ exact) <= weight + slack).all():
                return exact
    return b


def solve(products: np.ndarray, names: list[str], n: int, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, penalties and sigma from the Gram matrix (target last)."""
    g, b, yy = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    change = np.array([x.startswith("change_") for x in names])
    prior = np.array([1.0 / PRIOR_LINE ** 2 if x in ("one", "line") else 1.0 / PRIOR_SEASON ** 2 for x in names])
    coef, variance, s = np.zeros(len(names)), max(yy / n, 1e-12), ~change
    penalty = np.zeros(len(names))
    for _ in range(100):
        penalty = np.where(change, variance / PRIOR_CHANGE, variance * prior)
        inner = g[np.ix_(s, s)] + np.diag(penalty[s])
        down = np.linalg.solve(inner, np.column_stack([g[np.ix_(s, change)], b[s]]))
        m = g[np.ix_(change, change)] - g[np.ix_(change, s)] @ down[:, :-1]
        c = b[change] - g[np.ix_(change, s)] @ down[:, -1]
        coef[change] = _sparse(m, c, variance / PRIOR_CHANGE, coef[change])
        coef[s] = down[:, -1] - down[:, :-1] @ coef[change]
        new = max((yy - 2 * coef @ b + coef @ g @ coef) / n, 1e-12)
        if abs(new - variance) <= 1e-9 * variance:
            break
        variance = new
    return coef, penalty, float(np.sqrt(variance))


def fit(frame: DataFrame, names: list[str], days: int) -> Fit:
    """The most probable parameters over the rows of ``frame`` with a revenue."""
    seen = frame.where(F.col("revenue").isNotNull()).agg(F.count(F.lit(1)), F.max(F.abs(target()))).first()
    n, scale = seen[0], float(seen[1] or 0) / CENTS or 1.0
    if not n:
        return Fit(names, [0.0] * len(names), [0.0] * len(names), 0.0, scale, days)
    unit = np.array([float(UNIT)] * len(names) + [scale * CENTS])
    products = np.zeros((len(unit), len(unit)))
    for i, j, value in gram(frame, names).collect():  # as many numbers as pairs of regressors
        products[i - 1, j - 1] = products[j - 1, i - 1] = float(value) / (unit[i - 1] * unit[j - 1])
    coef, penalty, sigma = solve(products, names, n, scale)
    return Fit(names, coef.tolist(), penalty.tolist(), sigma, scale, days)


def optimality(frame: DataFrame, f: Fit) -> DataFrame:
    """(term, coefficient, gradient, holds) of every regressor, from the rows: the
    residuals' sum of products stays within the penalty's slope, and equals it
    where the coefficient isn't zero."""
    e = (target().cast("double") / (CENTS * f.scale)) - f.value(f.names) / f.scale
    rows = frame.where(F.col("revenue").isNotNull()).select(F.posexplode(F.array(*f.names)).alias("at", "x"), e.alias("e"))
    sums = rows.groupBy("at").agg(F.sum(F.col("x") * F.col("e") / UNIT).alias("gradient"),
                                  F.sum(F.abs(F.col("x") * F.col("e") / UNIT)).alias("size"))
    known = frame.sparkSession.createDataFrame(
        [(i, n, c, p, n.startswith("change_")) for i, (n, c, p) in enumerate(zip(f.names, f.coef, f.penalty))],
        "at int, term string, coefficient double, penalty double, sparse boolean")
    wanted = F.when(F.col("sparse"), F.signum("coefficient")).otherwise(F.col("coefficient")) * F.col("penalty")
    slack = (F.col("size") + F.col("penalty")) * 1e-6
    off = F.when(F.col("sparse") & (F.col("coefficient") == 0), F.abs("gradient") - F.col("penalty")).otherwise(
        F.abs(F.col("gradient") - wanted))
    return sums.join(F.broadcast(known), "at").select("term", "coefficient", "gradient", (off <= slack).alias("holds"))


def _uniform(*key) -> F.Column:
    """A number in (0, 1) that the key alone decides."""
    return (F.pmod(F.xxhash64(*key, F.lit(SEED)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def half_widths(spark: SparkSession, f: Fit, horizon: int, draws: int = DRAWS) -> DataFrame:
    """(h, half_width) for the ``horizon`` days after the history.

    Each draw changes the slope on a day with the history's frequency of
    possible changes, by a Laplace amount of the history's mean absolute change,
    and adds noise; a draw and its mirror image count both, so the band is the
    quantile of one side.  More days can only add doubt, so a day's half width
    is at least the day's before, and at least that of the noise.
    """
    size = [abs(c) for n, c in zip(f.names, f.coef) if n.startswith("change_")]
    mean, rate = sum(size) / max(len(size), 1), min(len(size) / max(f.days, 1), 1.0)
    days = spark.range(draws // 2).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    v = _uniform("draw", "h", F.lit("size")) - 0.5
    change = F.when(_uniform("draw", "h", F.lit("when")) < rate, -F.signum(v) * F.log(1 - 2 * F.abs(v)) * mean).otherwise(0.0)
    noise = F.sqrt(-2 * F.log(_uniform("draw", "h", F.lit("radius")))) * F.cos(2 * np.pi * _uniform("draw", "h", F.lit("angle")))
    so_far = Window.partitionBy("draw").orderBy("h")
    drift = (F.sum("change").over(so_far) * F.col("h") - F.sum(F.col("change") * F.col("h")).over(so_far)) / max(f.days, 1)
    paths = days.withColumn("change", change).select("h", (drift + noise * f.sigma).alias("x"))
    both = paths.select("h", F.explode(F.array(F.col("x"), -F.col("x"))).alias("x"))
    at = both.groupBy("h").agg(F.percentile("x", F.lit(BAND)).alias("q"))
    wide = F.greatest(F.col("q"), F.lit(INTERVAL_Z * f.sigma))
    return at.select("h", (F.max(wide).over(Window.orderBy("h")) * f.scale).alias("half_width"))


class Forecast(NamedTuple):
    forecast: DataFrame    # date, is_future, actual, yhat, yhat_lower, yhat_upper
    components: DataFrame  # date, is_future, trend, yearly, weekly, yhat
    fit: Fit
    frame: DataFrame       # the regressors of every day


def calendar_of(daily: DataFrame, horizon: int = HORIZON) -> tuple[DataFrame, int]:
    """The observed days and ``horizon`` days after them with their day index
    ``t``; the history's days, less one.  ``daily`` is read for its bounds first."""
    first, last = daily.agg(F.min("date"), F.max("date")).first()
    hist = daily.where(F.col("date").isNotNull()).select(
        "date", F.col("revenue").cast("double").alias("revenue"), F.lit(False).alias("is_future"))
    fut = daily.sparkSession.range(horizon if last else 0).select(
        F.date_add(F.lit(last).cast("date"), F.col("id").cast("int") + 1).alias("date"),
        F.lit(None).cast("double").alias("revenue"), F.lit(True).alias("is_future"))
    days = (last - first).days if last else 0
    return hist.unionByName(fut).withColumn("t", F.datediff("date", F.lit(first).cast("date"))), days


def revenue_forecast(daily: DataFrame, horizon: int = HORIZON) -> Forecast:
    """Fit on the observed days of ``daily`` (date, revenue), predict them and the
    ``horizon`` days after.  The band is 80 % wide: noise alone on observed days,
    simulated slope changes and noise after them."""
    spark = daily.sparkSession
    calendar, days = calendar_of(materialized(daily.select("date", "revenue")), horizon)
    frame, names = regressors(calendar, days)
    f = fit(frame, names, days)
    parts = {
        "trend": f.value([n for n in names if n in ("one", "line") or n.startswith("change_")]),
        "yearly": f.value([n for n in names if n.startswith("yearly_")]),
        "weekly": f.value([n for n in names if n.startswith("weekly_")]),
    }
    comps = frame.select("date", "is_future", "revenue", "t", *(c.alias(n) for n, c in parts.items()))
    comps = comps.withColumn("yhat", F.col("trend") + F.col("yearly") + F.col("weekly"))
    widths = materialized(half_widths(spark, f, horizon))  # one row per day of the horizon
    wide = F.coalesce("half_width", F.lit(INTERVAL_Z * f.sigma * f.scale))
    forecast = comps.join(F.broadcast(widths), F.col("t") - days == F.col("h"), "left").select(
        "date", "is_future", F.col("revenue").alias("actual"), "yhat",
        (F.col("yhat") - wide).alias("yhat_lower"), (F.col("yhat") + wide).alias("yhat_upper"))
    return Forecast(forecast, comps.drop("revenue", "t"), f, frame)
