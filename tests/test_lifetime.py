"""Predicted customer value: planted parameters, the likelihood by enumeration, counts."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import lifetime as L


def drawn(truth, customers, most, seed=4):
    rng = np.random.default_rng(seed)
    a, b, c, d = truth
    n = rng.integers(1, most + 1, customers)
    p, leave = rng.beta(a, b, customers), rng.beta(c, d, customers)
    stays = rng.geometric(leave) - 1
    buys = (rng.random((customers, most)) < p[:, None]) & (np.arange(most) < np.minimum(stays, n)[:, None])
    last = np.where(buys.any(axis=1), most - buys[:, ::-1].argmax(axis=1), 0)
    return buys.sum(axis=1), last, n, stays


def histogram(spark, x, t, n):
    cells, counts = np.unique(np.column_stack([x, t, n]), axis=0, return_counts=True)
    return spark.createDataFrame([(*map(int, c), int(k)) for c, k in zip(cells, counts)], "x int, t int, n int, customers long")


def test_planted_parameters_and_later_purchases(spark):
    truth = (1.2, 0.8, 0.7, 2.8)
    x, t, n, stays = drawn(truth, 200_000, 12)
    counts = histogram(spark, x, t, n)
    f = L.fit(counts)
    assert f.gradient < 1e-8 and f.customers == 200_000
    assert [f.params[p] for p in L.NAMES] == pytest.approx(truth, rel=0.15)
    there = {}
    for key, alive in zip(zip(x, t, n), stays >= n):
        there.setdefault(key, []).append(alive)
    rows = L.predictions(counts, f).collect()
    for r in rows:
        seen = there[(r.x, r.t, r.n)]
        assert 0 <= r.p_alive <= 1 and 0 <= r.expected <= L.QUARTERS_AHEAD
        if len(seen) >= 2000:
            assert r.p_alive == pytest.approx(np.mean(seen), abs=0.05)


def test_likelihood_sums_to_one_over_all_histories():
    """Every string of n quarters, weighted by its triple's likelihood."""
    n = 6
    strings = [[i >> k & 1 for k in range(n)] for i in range(1 << n)]
    x = np.array([sum(s) for s in strings])
    t = np.array([max((k + 1 for k in range(n) if s[k]), default=0) for s in strings])
    whole, alive = L._parts(np.log([0.9, 1.7, 0.5, 2.2]), x, t, np.full(len(x), n))
    assert whole.sum() == pytest.approx(1.0, abs=1e-12) and (alive <= whole).all()


def test_gradient_against_differences():
    x, t, n, _ = drawn((1.0, 1.0, 0.6, 2.0), 500, 8)
    args = (x, t, n, np.ones(len(x)))
    theta, h = np.array([0.2, -0.3, 0.1, 0.5]), 1e-6
    plain = [(L._score(theta + h * u, *args) - L._score(theta - h * u, *args)) / (2 * h) for u in np.eye(4)]
    assert L._gradient(theta, *args) == pytest.approx(plain, abs=1e-7)


def test_quarters_of_orders(spark):
    day = dt.date
    rows = [(1, day(2020, 1, 5)), (1, day(2020, 2, 1)), (1, day(2020, 7, 1)), (2, day(2020, 12, 31)), (3, day(2019, 4, 1)),
            (None, day(2022, 1, 1)), (4, None)]
    orders = spark.createDataFrame([(*r, Decimal("2.5")) for r in rows], "customer_id long, date date, revenue_dec decimal(38,4)")
    got = {r.customer_id: (r.x, r.t, r.n, float(r.monetary_dec)) for r in L.purchase_quarters(orders).collect()}
    assert got == {1: (1, 2, 3, 7.5), 2: (0, 0, 0, 2.5), 3: (0, 0, 6, 2.5)}


@pytest.mark.parametrize("orders", [[], [(1, dt.date(2020, 1, 1))], [(i, dt.date(2019 + k, 1, 1)) for i in range(5) for k in range(3)]])
def test_few_and_alike_customers(spark, orders):
    frame = spark.createDataFrame([(*r, Decimal("9")) for r in orders], "customer_id long, date date, revenue_dec decimal(38,4)")
    quarters = L.purchase_quarters(frame)
    counts = L.purchase_histogram(quarters)
    out = L.predicted_value(quarters, L.predictions(counts, L.fit(counts))).collect()
    assert len(out) == len({i for i, _ in orders})
    assert all(0 <= r.p_alive <= 1 and np.isfinite(r.predicted_value) for r in out)


def test_same_fit_however_rows_lie(spark):
    x, t, n, _ = drawn((1.0, 1.0, 0.6, 2.0), 3000, 8)
    counts = histogram(spark, x, t, n)
    assert L.fit(counts.repartition(1)) == L.fit(counts.repartition(7, F.rand(1)))
