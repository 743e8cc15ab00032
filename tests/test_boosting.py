"""Many-trial boosting against plain Python, planted functions and layouts."""

import math
import random

import numpy as np
import pytest
from conftest import SF001  # noqa: F401
from pyspark.sql import functions as F

from tillroll.operators import boosting as BO
from tillroll.operators import ml as ML


def plain_splits(bins, residual, node, nodes):
    out = []
    for k in range(nodes):
        rows = [i for i in range(len(node)) if node[i] == k]
        score = lambda s: sum(s) ** 2 / (len(s) + BO.PENALTY)
        best = (1e-9, None)
        for f in range(bins.shape[1]):
            for b in range(BO.BINS):
                left = [residual[i] for i in rows if bins[i, f] <= b]
                right = [residual[i] for i in rows if bins[i, f] > b]
                if left and right:
                    gain = score(left) + score(right) - score(left + right)
                    if gain > best[0] + 1e-7:
                        best = (gain, (f, b))
        out.append(best)
    return out


def test_splits_equal_an_exhaustive_search():
    r = np.random.RandomState(4)
    bins = r.randint(0, 9, (60, 3))
    residual, node = r.standard_normal(60), r.randint(0, 3, 60)
    feature, last, gains = BO.best_splits(bins, residual, node, 3)
    for k, (gain, place) in enumerate(plain_splits(bins, residual, node, 3)):
        assert gains[k] and place is not None
        f, b = place
        side = bins[node == k]
        assert (side[:, feature[k]] <= last[k]).tolist() == (side[:, f] <= b).tolist()


def test_a_full_tree_gives_each_group_its_mean(monkeypatch):
    monkeypatch.setattr(BO, "PENALTY", 1e-9)
    bins = np.array([[i // 4, i % 4] for i in range(16)] * 5)
    label = np.array([float(i * i) for i in range(16)] * 5)
    value = BO.grow(bins, label, np.arange(80), np.arange(2), 8)
    assert np.allclose(value, label)
    stump = BO.grow(bins, label, np.arange(80), np.arange(2), 0)
    assert np.allclose(stump, label.mean())
    assert not BO.grow(bins, label, np.arange(0), np.arange(2), 3).any()


@pytest.fixture(scope="module")
def planted(spark):
    """A daily series whose label is a step function of two features."""
    r = random.Random(8)
    rows = []
    for i in range(600):
        a, b, c = r.random(), r.randint(0, 6), (None if r.random() < 0.1 else r.random())
        y = 100 + 50 * (a > 0.5) + 20 * b + (30 if c is None else 0) + r.gauss(0, 1)
        rows.append((i, a, b, c, y, "train" if i < 480 else "validation"))
    frame = spark.createDataFrame(rows, "i int, a double, b int, c double, label double, split string")
    return frame.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i"))).drop("i")


def trial(t, n, depth=4, step=0.1, rows=1.0, columns=1.0):
    return {"trial": t, "max_iter": n, "max_depth": depth, "step_size": step, "subsampling_rate": rows, "colsample": columns}


def test_planted_function_is_learned(planted):
    params = [trial(0, 1), trial(1, 100), trial(2, 100, rows=0.7, columns=0.7), trial(3, 60, depth=8)]
    scored = BO.boost_trials(planted, ["a", "b", "c"], params).where("split = 'validation'")
    error = {r.trial: math.sqrt(r.e) for r in scored.groupBy("trial").agg(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)).alias("e")).collect()}
    assert set(error) == {0, 1, 2, 3}
    assert error[0] > 30 and max(error[1], error[2], error[3]) < 10, error


def test_layout_does_not_matter(planted):
    params = [trial(0, 20, rows=0.8, columns=0.6), trial(1, 10, rows=0.6)]
    runs = []
    for n in (1, 7):
        out = BO.boost_trials(planted.repartition(n, "label"), ["a", "b", "c"], params).collect()
        assert len(out) == 2 * 600
        runs.append(sorted((r.trial, r.date, r.predicted) for r in out))
    assert runs[0] == runs[1]


def test_trials_have_tasks_of_their_own(planted):
    params = [trial(t, 1) for t in range(20)]
    out = BO.boost_trials(planted, ["a"], params)
    at = out.select("trial", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(at) == 20 and len({r.p for r in at}) >= 15


def test_a_frame_that_is_no_daily_series_is_refused(planted, monkeypatch):
    monkeypatch.setattr(BO, "MOST_ROWS", 10)
    with pytest.raises(ValueError, match="600 rows"):
        BO.boost_trials(planted, ["a"], [trial(0, 1)])


def test_search_prefers_the_better_trial(planted):
    daily = planted.select("date", F.col("label").alias("revenue"), "a", "b", "c")
    trials, scored = ML.tuned_gbt(daily, trials=4, rounds=(2, 60))
    rows = trials.orderBy("trial").collect()
    best = min(rows, key=lambda r: (r.rmse, r.trial))
    assert [r.trial for r in rows if r.is_best] == [best.trial]
    rmse = math.sqrt(scored.agg(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).first()[0])
    assert abs(rmse - best.rmse) < 1e-5 and scored.count() == 120
