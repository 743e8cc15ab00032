"""Autoregressions of chosen order and seasonal smoothing: brute force, planted series."""

import datetime as dt
import math

import numpy as np
import pytest

from tillroll.operators import forecast as FC

START = dt.date(2019, 1, 1)


def frame(spark, series):
    rows = [(k, START + dt.timedelta(days=t), float(v)) for k, xs in series.items() for t, v in enumerate(xs)]
    return spark.createDataFrame(rows, "product string, date date, units double").repartition(5)


def yule_walker(x, most):
    """(order, coefficients) from the normal equations of each order, solved apart."""
    x = np.asarray(x) - np.mean(x)
    r = np.array([(x[k:] * x[:len(x) - k]).sum() for k in range(most + 1)]) / (x * x).sum()
    best = (0.0, 0, [])
    for p in range(1, most + 1):
        phi = np.linalg.solve([[r[abs(i - j)] for j in range(p)] for i in range(p)], r[1:p + 1])
        score = len(x) * math.log(1 - phi @ r[1:p + 1]) + 2 * p
        best = min(best, (score, p, phi.tolist()), key=lambda b: b[:2])
    return best[1:]


def test_orders_equal_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    series = {}
    for name, phi in (("white", []), ("one", [0.7]), ("three", [0.3, -0.2, 0.5]), ("short", [0.4])):
        x = list(rng.normal(size=6))
        for _ in range(40 if name == "short" else 700):
            x.append(sum(p * x[-j] for j, p in enumerate(phi, 1)) + rng.normal())
        series[name] = np.round(100 * np.array(x[6:]) + 500)
    got = {r["product"]: r for r in FC.ar_order_by_product(frame(spark, series)).collect()}
    for name, x in series.items():
        order, phi = yule_walker(x, 6)
        assert got[name].ar_order == order and got[name].off == 0
        assert [got[name][f"phi_{j}"] for j in range(1, 7)] == pytest.approx(phi + [0] * (6 - order), abs=2e-6)
    assert got["three"].ar_order >= 3 and got["three"].phi_3 == pytest.approx(0.5, abs=0.12)


def test_orders_of_odd_series(spark):
    odd = {"constant": [5] * 40, "single": [3], "two": [1, 4], "zero": [0] * 9, "swing": [0, 10] * 60}
    got = {r["product"]: r for r in FC.ar_order_by_product(frame(spark, odd)).collect()}
    assert len(got) == len(odd) and all(r.off == 0 and r.error >= 0 for r in got.values())
    assert all(got[k].ar_order == 0 for k in ("constant", "single", "zero"))
    assert got["swing"].phi_1 < -0.9
    assert FC.ar_order_by_product(frame(spark, {"none": []})).count() == 0


def smoothed(x):
    """(sse, trial, level, trend, season) of the best trial, plainly."""
    best, trial = None, 0
    for a in FC.LEVEL_WEIGHTS:
        for b in FC.TREND_WEIGHTS:
            for g in FC.SEASON_WEIGHTS:
                mean = sum(x[:12]) / 12
                trend, sse = (sum(x[12:24]) / 12 - mean) / 12, 0.0
                level, season = mean + 5.5 * trend, [v - mean - (i - 5.5) * trend for i, v in enumerate(x[:12])]
                for v in x[12:]:
                    e = v - (level + trend + season[0])
                    level, trend, season, sse = level + trend + a * e, trend + b * e, season[1:] + [season[0] + g * e], sse + e * e
                if best is None or sse < best[0]:
                    best = (sse, trial, level, trend, season)
                trial += 1
    return best


def months(spark, series):
    rows = [(k, dt.date(2015 + m // 12, m % 12 + 1, 1 + d), float(v) / 2) for k, xs in series.items()
            for m, v in enumerate(xs) if v is not None for d in (0, 9)]
    return spark.createDataFrame(rows, "product string, date date, units double").repartition(4)


def test_smoothing_equals_brute_force_and_finds_the_season(spark):
    rng = np.random.default_rng(8)
    wave = [100 * math.sin(2 * math.pi * m / 12) for m in range(72)]
    series = {"wave": [float(round(1000 + 5 * m + wave[m])) for m in range(60)],
              "noise": [float(v) for v in rng.integers(0, 90, 60)],
              "gaps": [None if m % 5 == 1 else 40.0 for m in range(60)]}
    got = {r["product"]: r for r in FC.seasonal_smoothing(months(spark, series)).collect()}
    for name, x in series.items():
        sse, _, level, trend, season = smoothed([v or 0.0 for v in x])
        assert got[name].months == 60 and got[name].rmse == pytest.approx(math.sqrt(sse / 48), abs=2e-6)
        assert (got[name].level, got[name].trend) == pytest.approx((level, trend), abs=2e-6)
        assert got[name].next_month == pytest.approx(level + trend + season[0], abs=2e-6)
        assert got[name].next_year == pytest.approx(12 * level + 78 * trend + sum(season), abs=2e-5)
    truth = [1000 + 5 * m + wave[m] for m in range(60, 72)]
    assert got["wave"].next_month == pytest.approx(truth[0], rel=0.02)
    assert got["wave"].next_year == pytest.approx(sum(truth), rel=0.02)


def test_smoothing_of_short_and_empty_tables(spark):
    assert FC.seasonal_smoothing(months(spark, {"a": [3.0] * 23})).count() == 0
    assert FC.seasonal_smoothing(months(spark, {"a": []})).count() == 0
    late = FC.seasonal_smoothing(months(spark, {"a": [3.0] * 24, "late": [None] * 23 + [9.0]})).collect()
    assert {r["product"] for r in late} == {"a", "late"} and all(r.months == 24 for r in late)
