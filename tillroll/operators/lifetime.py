"""Predicted customer value: how long customers stay and how often they buy.

The model is the beta-geometric / beta-Bernoulli one of Fader, Hardie and Shang,
"Customer-base analysis in a discrete-time noncontractual setting" (2010).  Time
goes in quarters.  In each quarter after that of the first order a customer who
is still there buys with a probability of their own (beta distributed with
``alpha``, ``beta``), and before each leaves for good with another (``gamma``,
``delta``).  All that the likelihood needs of a customer is

    x, quarters with an order; t, the last of them; n, quarters seen

(the first quarter itself is number 0 and isn't counted), so customers are
counted by (x, t, n) in one aggregation.  The table of counts has at most one
row per triple of calendar quarters, however many customers there are; the fit
reads that table, and its predictions, one row a triple, go back to the customers
by a join.

The parameters are the most probable ones under wide normal priors of their
logarithms, which keep them finite where nobody leaves or all are alike; Newton's
steps use the exact gradient.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import exprs as X

QUARTERS_AHEAD = 4
PRIOR_SPREAD = 3.0  # standard deviation of each parameter's logarithm
NAMES = ("alpha", "beta", "gamma", "delta")


class Fit(NamedTuple):
    params: dict[str, float]
    gradient: float  # largest slope left, a customer
    customers: int


def purchase_quarters(orders: DataFrame) -> DataFrame:
    """(customer_id, x, t, n, monetary_dec) per customer, from orders
    (customer_id, date, revenue_dec); rows without customer or date count nowhere."""
    quarter = (F.year("date") * 4 + F.quarter("date")).cast("int")
    per = orders.where(F.col("customer_id").isNotNull() & F.col("date").isNotNull()).groupBy(
        "customer_id", quarter.alias("q")).agg(X.exact_sum(F.col("revenue_dec")).alias("m"))
    each = per.groupBy("customer_id").agg(
        F.min("q").alias("first"), F.max("q").alias("last"), (F.count(F.lit(1)) - 1).cast("int").alias("x"),
        X.exact_sum(F.col("m")).alias("monetary_dec"))
    end = each.agg(F.max(F.struct("last", "first", "x", "monetary_dec", "customer_id"))["last"].alias("end"))
    return each.crossJoin(F.broadcast(end)).select(
        "customer_id", "x", (F.col("last") - F.col("first")).alias("t"), (F.col("end") - F.col("first")).alias("n"), "monetary_dec")


def purchase_histogram(quarters: DataFrame) -> DataFrame:
    """(x, t, n, customers): all that the fit reads."""
    return quarters.groupBy("x", "t", "n").agg(F.count(F.lit(1)).alias("customers"))


def _rising(a, most: int) -> np.ndarray:
    """Logarithms of a (a + 1) ... (a + k - 1) for k up to ``most``."""
    return np.concatenate([[0.0], np.cumsum(np.log(a + np.arange(most)))])


def _parts(theta, x, t, n):
    """Of each triple: the likelihood, and its part of customers still there,
    who buy again with the returned odds ``(buy, stay)`` tables."""
    alpha, beta, gamma, delta = np.exp(theta)
    most = int(n.max()) + 2
    ra, rb, rab = _rising(alpha, most), _rising(beta, most), _rising(alpha + beta, most)
    rd, rgd = _rising(delta, most), _rising(gamma + delta, most)
    alive = np.exp(ra[x] + rb[n - x] - rab[n] + rd[n] - rgd[n])
    whole = alive.copy()
    for k in range(int(n.max())):  # left before quarter k + 1
        at = (t <= k) & (k < n)
        xs = x[at]
        whole[at] += np.exp(ra[xs] + rb[k - xs] - rab[k] + np.log(gamma) + rd[k] - rgd[k + 1])
    return whole, alive


def _score(theta, x, t, n, count):
    """Logarithm of the posterior, a customer."""
    prior = -np.sum(theta * theta) / (2 * PRIOR_SPREAD ** 2)
    return (np.sum(count * np.log(_parts(theta, x, t, n)[0])) + prior) / count.sum()


def _gradient(theta, *cells):
    step = 1e-30j  # the imaginary part of an analytic function gives its slope exactly
    return np.array([_score(theta + step * unit, *cells).imag / step.imag for unit in np.eye(len(theta))])


def fit(histogram: DataFrame) -> Fit:
    """The most probable parameters from (x, t, n, customers)."""
    cells = np.array([tuple(r) for r in histogram.select("x", "t", "n", "customers").orderBy("n", "t", "x").collect()], dtype=np.int64)
    if not len(cells):
        return Fit(dict.fromkeys(NAMES, 1.0), 0.0, 0)
    x, t, n, count = cells.T
    args = (x, t, n, count.astype(float))
    theta, damp = np.zeros(4), 1.0
    at, slope = _score(theta, *args), _gradient(theta, *args)
    for _ in range(200):
        if np.abs(slope).max() < 1e-10:
            break
        h = 1e-5
        curve = np.array([(_gradient(theta + h * u, *args) - _gradient(theta - h * u, *args)) / (2 * h) for u in np.eye(4)])
        curve = (curve + curve.T) / 2
        values, vectors = np.linalg.eigh(-curve)
        while damp < 1e12:
            move = vectors @ ((vectors.T @ slope) / (np.abs(values) + damp))
            move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-300))
            new = _score(theta + move, *args)
            if new >= at:
                break
            damp = max(damp * 4, 1e-10)
        else:
            break
        theta, at, damp = theta + move, new, damp / 16
        slope = _gradient(theta, *args)
    return Fit(dict(zip(NAMES, np.exp(theta).tolist())), float(np.abs(slope).max()), int(count.sum()))


def predictions(histogram: DataFrame, f: Fit, ahead: int = QUARTERS_AHEAD) -> DataFrame:
    """(x, t, n, p_alive, expected) of each triple: the probability that the
    customer is still there and the quarters with an order among the next ``ahead``."""
    spark = histogram.sparkSession
    schema = "x int, t int, n int, p_alive double, expected double"
    cells = np.array([tuple(r) for r in histogram.select("x", "t", "n").collect()], dtype=np.int64)
    if not len(cells):
        return spark.createDataFrame([], schema)
    x, t, n = cells.T
    alpha, beta, gamma, delta = (f.params[p] for p in NAMES)
    whole, alive = _parts(np.log([alpha, beta, gamma, delta]), x, t, n)
    most = int(n.max()) + ahead + 1
    stay = np.exp(_rising(delta, most) - _rising(gamma + delta, most))
    later = sum(stay[n + k] for k in range(1, ahead + 1)) / stay[n]
    buys = (alpha + x) / (alpha + beta + n)  # a buyer's mean probability, given that they are there
    rows = zip(x.tolist(), t.tolist(), n.tolist(), (alive / whole).tolist(), (alive / whole * buys * later).tolist())
    return spark.createDataFrame(list(rows), schema)


def predicted_value(quarters: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per customer: what they did, the prediction, and its value at their
    mean revenue a quarter with orders."""
    per = X.to_double(F.col("monetary_dec")) / (F.col("x") + 1)
    return quarters.join(F.broadcast(predicted), ["x", "t", "n"]).select(  # a row per triple of calendar quarters
        "customer_id", F.col("x").alias("repeat_quarters"), F.col("t").alias("last_quarter"), F.col("n").alias("quarters_seen"),
        X.round6(F.col("p_alive")).alias("p_alive"), X.round6(F.col("expected")).alias("expected_quarters"),
        X.round6(per * F.col("expected")).alias("predicted_value"))
