"""Exact K-means: the same labels under any partitioning, planted groups, edge cases."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tillroll.operators import clustering as CL
from tillroll.operators import ml as ML
from tillroll.operators import rfm as R
from tillroll.sources.tables import order_totals

SCHEMA = "customer_id long, recency int, frequency long, monetary double, avg_order_value double, monetary_dec decimal(38,4)"


def base_of(spark, rows):
    """rows of (customer_id, recency, frequency, money)"""
    return spark.createDataFrame([(i, r, f, float(m), float(m) / f, Decimal(m).quantize(Decimal("0.0001"))) for i, r, f, m in rows], SCHEMA)


@pytest.fixture(scope="module")
def customers(spark):
    return ML.materialized(R.rfm_base(None, order_totals(spark, SF001)))


def labels(fit):
    return {r.customer_id: r.segment for r in fit.segments.collect()}


def test_same_labels_under_any_partitioning(customers):
    fits = [CL.kmeans(customers.repartition(n, "customer_id"), 4, 3, 300, 42) for n in (1, 4, 9)]
    assert fits[0].cost == fits[1].cost == fits[2].cost > 0
    assert fits[0].centres == fits[1].centres == fits[2].centres
    assert labels(fits[0]) == labels(fits[1]) == labels(fits[2])


def test_settled_fit_against_brute_force(customers):
    fit = CL.kmeans(customers, 4, 3, 300, 42)
    rows = fit.assigned.collect()
    assert len(rows) == customers.count()
    members = {}
    cost = 0
    for r in rows:
        p = [r[z] for z in CL.GRID]
        dist = [sum((a - b) ** 2 for a, b in zip(p, c)) for c in fit.centres]
        assert r.distance == dist[r.segment] == min(dist)
        cost += r.distance
        members.setdefault(r.segment, []).append(p)
    assert fit.cost == cost / CL.STEPS ** 2
    for s, ps in members.items():
        assert fit.centres[s] == [sum(c) // len(ps) for c in zip(*ps)]


def test_grid_against_plain_arithmetic(customers):
    rows = CL.grid(customers).orderBy("customer_id").collect()
    for j, of in enumerate((lambda r: r.recency, lambda r: r.frequency, lambda r: int(r.monetary_dec * 10000),
                            lambda r: int(r.monetary_dec * 10000) // r.frequency)):
        x = [of(r) for r in rows]
        mean = sum(x) / len(x)
        sd = (sum((v - mean) ** 2 for v in x) / (len(x) - 1)) ** 0.5
        for v, r in zip(x, rows):
            assert abs(r[f"z{j}"] - (v - mean) / sd * CL.STEPS) < 1.001


def test_planted_groups_are_found(spark):
    rng = random.Random(5)
    spots = [(10, 40, 90000), (200, 5, 4000), (400, 20, 30000), (60, 2, 150)]
    rows = [(i, r + rng.randint(-3, 3), f + rng.randint(0, 1), m + rng.randint(-50, 50))
            for i in range(400) for r, f, m in [spots[i % 4]]]
    fit = CL.kmeans(base_of(spark, rows).repartition(5), 4, 5, 100, 7)
    got = labels(fit)
    groups = [{got[i] for i in range(400) if i % 4 == g} for g in range(4)]
    assert [len(g) for g in groups] == [1] * 4 and len(set.union(*groups)) == 4
    assert groups[0] == {0}  # the most valuable first


def test_few_customers_repeats_and_none(spark):
    none = CL.kmeans(base_of(spark, []), 4, 2, 10, 1)
    assert none.segments.count() == 0 and none.cost == 0 and none.segments.columns == ["customer_id", *CL.FEATURES, "segment"]
    one = CL.kmeans(base_of(spark, [(9, 3, 1, 10)]), 4, 2, 10, 1)
    assert labels(one) == {9: 0} and one.cost == 0
    same = CL.kmeans(base_of(spark, [(i, 3, 2, 10) for i in range(20)]), 4, 2, 10, 1)  # every feature constant
    assert set(labels(same).values()) == {0} and same.cost == 0
    two = CL.kmeans(base_of(spark, [(i, 3 + i % 2, 2, 10 + 90 * (i % 2)) for i in range(20)]), 4, 2, 10, 1)
    assert labels(two) == {i: 1 - i % 2 for i in range(20)}


def test_first_step_of_no_customers(spark):
    assert CL.first_step(base_of(spark, []), 4, 42).count() == 0


def test_start_points_are_customers(customers):
    points = CL.grid(customers)
    at = {tuple(r) for r in points.select(*CL.GRID).collect()}
    found = CL.starts(points.select("customer_id", *CL.GRID), 4, 6, 42)
    assert sorted(found) == list(range(6))
    assert all(len(c) == 4 and {tuple(p) for p in c} <= at for c in found.values())
    assert len({tuple(map(tuple, c)) for c in found.values()}) > 1  # restarts differ
    assert found == CL.starts(points.repartition(7).select("customer_id", *CL.GRID), 4, 6, 42)


def test_a_pass_adds_up_all_restarts_without_a_row_for_each(spark, monkeypatch):
    """10 restarts over many customers: the passes read each customer once, and
    restarts may have different numbers of centres; nulls are with the first."""
    rng = random.Random(3)
    rows = [[rng.randint(-20000, 20000) for _ in CL.GRID] for _ in range(500)] + [[None, 5, 6, 7]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "customer_id long, " + ", ".join(f"{z} long" for z in CL.GRID))
    centres = {r: [rows[rng.randrange(500)] for _ in range(1 + r % 4)] for r in range(10)}
    monkeypatch.setattr(CL, "nearest", None)  # a row per customer and restart
    after, cost, size = CL.moved(points.repartition(3), centres)
    for r, c in centres.items():
        members, total = {}, 0
        for p in rows:
            dist = [0] if None in p else [sum((a - b) ** 2 for a, b in zip(p, q)) for q in c]
            members.setdefault(dist.index(min(dist)), []).append(p)
            total += min(dist)
        assert cost[r] == total
        for k, ps in members.items():
            assert size[r, k] == len(ps)
            assert after[r][k] == [sum(v or 0 for v in z) // len(ps) for z in zip(*ps)]
    found = CL.starts(points, 4, 3, 42)
    assert all(p in rows[:-1] for c in found.values() for p in c)
