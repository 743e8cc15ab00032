"""The additive forecast: exact Gram matrix, sparse changes, widening bounds."""

import datetime as dt

import numpy as np
import pytest

from tillroll.operators import additive as AD

START = dt.date(2018, 1, 1)


def series(spark, values):
    return spark.createDataFrame([(START + dt.timedelta(days=t), float(v)) for t, v in enumerate(values)],
                                 "date date, revenue double")


def planted(n=1100, noise=3.0, seed=5):
    """A line with one break upwards and one downwards, a weekly bump, noise."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    truth = 500 + 0.1 * t + 0.9 * np.maximum(t - 330, 0) - 1.4 * np.maximum(t - 660, 0) + 20 * (t % 7 == 5)
    return truth, truth + rng.normal(0, noise, n)


@pytest.mark.parametrize("partitions", [1, 7])
def test_gram_equals_brute_force(spark, partitions):
    rng = np.random.default_rng(1)
    daily = series(spark, np.round(rng.uniform(0, 5000, 90), 4)).repartition(partitions)
    frame, names = AD.regressors(*AD.calendar_of(daily, 5))
    rows = [r for r in frame.collect() if r.revenue is not None]
    x = [[r[n] for n in names] + [int(np.floor(r.revenue * 100 + 0.5))] for r in rows]
    got = {(r.i, r.j): int(r.value) for r in AD.gram(frame, names).collect()}
    k = len(names) + 1
    assert len(got) == k * (k + 1) // 2
    assert got == {(i + 1, j + 1): sum(r[i] * r[j] for r in x) for i in range(k) for j in range(i, k)}


def test_planted_breaks_are_found(spark):
    truth, seen = planted()
    out = AD.revenue_forecast(series(spark, seen), 30)
    at = AD.change_days(out.fit.days)
    change = np.array([c for n, c in zip(out.fit.names, out.fit.coef) if n.startswith("change_")])
    slope = change * out.fit.scale / out.fit.days  # per day
    near = lambda day: sum(s for d, s in zip(at, slope) if abs(d - day) <= 70)
    assert near(330) == pytest.approx(0.9, abs=0.2) and near(660) == pytest.approx(-1.4, abs=0.25)
    away = [abs(s) for d, s in zip(at, slope) if abs(d - 330) > 70 and abs(d - 660) > 70]
    assert max(away) < 0.1 and (change == 0).sum() >= 5  # sparse
    assert all(r.holds for r in AD.optimality(out.frame, out.fit).collect())
    fitted = {r.date: r.yhat for r in out.forecast.where("not is_future").collect()}
    error = np.array([fitted[START + dt.timedelta(days=t)] - v for t, v in enumerate(truth)])
    assert np.sqrt((error ** 2).mean()) < 3.0


def test_optimality_notices_other_coefficients(spark):
    _, seen = planted(400)
    out = AD.revenue_forecast(series(spark, seen), 10)
    moved = out.fit._replace(coef=[c + 0.01 for c in out.fit.coef])
    assert not all(r.holds for r in AD.optimality(out.frame, moved).collect())


def test_bounds_cover_and_never_narrow(spark):
    truth, seen = planted(1190)
    out = AD.revenue_forecast(series(spark, seen[:1100]), 90)
    fut = out.forecast.where("is_future").orderBy("date").collect()
    width = [r.yhat_upper - r.yhat_lower for r in fut]
    assert len(fut) == 90 and all(b >= a * (1 - 1e-12) for a, b in zip(width, width[1:]))
    assert width[-1] > 1.5 * width[0]
    inside = np.mean([r.yhat_lower <= v <= r.yhat_upper for r, v in zip(fut, seen[1100:])])
    assert inside >= 0.8
    past = out.forecast.where("not is_future").collect()
    known = {START + dt.timedelta(days=t): v for t, v in enumerate(seen)}
    assert 0.7 <= np.mean([r.yhat_lower <= known[r.date] <= r.yhat_upper for r in past]) <= 0.9


def test_short_and_empty_histories(spark):
    assert AD.revenue_forecast(series(spark, []), 10).forecast.count() == 0
    one = AD.revenue_forecast(series(spark, [7.0]), 3).forecast.orderBy("date").collect()
    assert len(one) == 4 and one[0].yhat == pytest.approx(7.0, rel=0.05)
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in one)
    level = AD.revenue_forecast(series(spark, [0.0] * 30), 2)
    assert all(r.yhat == 0 for r in level.forecast.collect())
