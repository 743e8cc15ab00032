"""Histogram gradient boosting of many trials at once.

A random search fits the same small frame (the daily series: a row a day, so
its length is bounded by the calendar) many times over.  Boosting is a chain of
rounds and levels; as Spark jobs that is one job per level, some 2,000 one after
the other for 300 rounds, each far longer than its work.  Here a trial is the
unit that Spark deals out: the rows meet the table of trials in a join, each
trial's rows go to a task of their own, and scored rows come back as a frame,
so a search takes as long as its longest trial however many trials there are.

The trees: squared loss, one histogram of (node, feature, bin) sums per level,
rows and columns sampled once a tree, leaf values ``sum / (count + penalty)``.
Bins are cut at the training rows' approximate quantiles; a missing value goes
to the left.  A trial's draws follow from the seed and its number alone, its
rows are in key order, so results don't depend on partitions or executors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64
PENALTY = 1.0
#: Days of several centuries; a longer frame is no daily series.
MOST_ROWS = 200_000
PARAMS = "trial int, max_iter int, max_depth int, step_size double, subsampling_rate double, colsample double"


def bin_edges(train: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Inner edges of every feature's bins, from one pass over the rows."""
    at = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    row = train.agg(*(F.percentile_approx(F.col(f).cast("double"), at).alias(f) for f in features)).first()
    return [sorted(set(row[f] or ())) for f in features]


def best_splits(bins: np.ndarray, residual: np.ndarray, node: np.ndarray, nodes: int):
    """The best (feature, last bin on the left) of each node and whether it gains
    anything; ``bins`` holds a row's bin of each feature."""
    n, features = bins.shape
    slot = ((node[:, None] * features + np.arange(features)) * BINS + bins).ravel()
    shape = (nodes, features, BINS)
    count = np.bincount(slot, minlength=nodes * features * BINS).reshape(shape).cumsum(axis=2)
    total = np.bincount(slot, weights=np.repeat(residual, features), minlength=nodes * features * BINS).reshape(shape).cumsum(axis=2)
    all_n, all_sum = count[:, :, -1:], total[:, :, -1:]
    score = lambda s, c: s * s / (c + PENALTY)
    gain = score(total, count) + score(all_sum - total, all_n - count) - score(all_sum, all_n)
    gain = np.where((count > 0) & (count < all_n), gain, 0.0).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    return best // BINS, best % BINS, gain[np.arange(nodes), best] > 1e-9


def grow(bins: np.ndarray, residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int) -> np.ndarray:
    """The values that one tree, grown on ``rows``, gives to all rows."""
    value = np.zeros(len(bins))
    node, open_ = np.zeros(len(bins), dtype=np.int64), np.ones(len(bins), dtype=bool)
    nodes, view = 1, bins[:, columns]
    for level in range(depth + 1):
        fit = rows[open_[rows]]
        if not len(fit):
            break
        count = np.bincount(node[fit], minlength=nodes)
        leaf = np.bincount(node[fit], weights=residual[fit], minlength=nodes) / (count + PENALTY)
        here = np.flatnonzero(open_)
        value[here] = leaf[node[here]]
        if level == depth:
            break
        feature, last, gains = best_splits(view[fit], residual[fit], node[fit], nodes)
        open_[here] = gains[node[here]]
        here = here[open_[here]]
        number = np.cumsum(gains) - 1
        right = view[here, feature[node[here]]] > last[node[here]]
        node[here] = 2 * number[node[here]] + right
        nodes = 2 * int(gains.sum())
        if not nodes:
            break
    return value


def boosted(bins: np.ndarray, label: np.ndarray, train: np.ndarray, p: dict, seed: int) -> np.ndarray:
    """Predictions for all rows, fitted on those of ``train``."""
    draw = np.random.RandomState(seed)
    rows = np.flatnonzero(train)
    predicted = np.full(len(label), label[rows].mean() if len(rows) else 0.0)
    wanted = max(1, round(p["colsample"] * bins.shape[1]))
    for _ in range(p["max_iter"]):
        some = rows[draw.random_sample(len(rows)) < p["subsampling_rate"]]
        columns = np.sort(draw.permutation(bins.shape[1])[:wanted])
        predicted += p["step_size"] * grow(bins, label - predicted, some, columns, p["max_depth"])
    return predicted


def boost_trials(data: DataFrame, features: Sequence[str], params: Sequence[dict], seed: int = 42) -> DataFrame:
    """``trial, date, split, actual, predicted`` of every row under every trial.

    ``data`` has ``date`` (one row each), ``split`` (rows of ``train`` are fitted
    on), ``label`` and the features; ``params`` the columns of ``PARAMS``."""
    features = list(features)
    data = data.select("date", "split", F.col("label").cast("double").alias("label"), *(F.col(f).cast("double").alias(f) for f in features))
    if (n := data.count()) > MOST_ROWS:
        raise ValueError(f"{n} rows: trials are fitted a task each, on at most {MOST_ROWS} rows")
    edges = [np.array(e) for e in bin_edges(data.where("split = 'train'"), features)]
    by_trial = {p["trial"]: p for p in params}

    def fit(key, table):
        p = by_trial[key[0].as_py()]
        table = table.sort_by("date")
        columns = []
        for f, cut in zip(features, edges, strict=True):
            x = table.column(f).to_numpy(zero_copy_only=False).astype(np.float64)
            columns.append(np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="left")))
        label = table.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        train = np.array(table.column("split").to_pylist()) == "train"
        known = train & ~np.isnan(label)
        predicted = boosted(np.stack(columns, axis=1), label, known, p, seed + p["trial"])
        return pa.table(
            {"trial": table.column("trial"), "date": table.column("date"), "split": table.column("split"),
             "actual": table.column("label"), "predicted": pa.array(predicted)}
        )

    spark = data.sparkSession
    trials = spark.createDataFrame([(p["trial"],) for p in params], "trial int")
    # one task per trial: a range of its own number
    dealt = data.join(F.broadcast(trials)).repartitionByRange(len(params), "trial")
    return dealt.groupBy("trial").applyInArrow(fit, "trial int, date date, split string, actual double, predicted double")
