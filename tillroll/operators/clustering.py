"""K-means whose labels don't depend on partitioning.

Features become whole numbers (steps of 1/4096 standard deviation, from exact
sums), so distances, sums and moved centres are exact whatever the order of the
rows.  A fit is a few passes over the customers, all restarts in each pass:

* start points by seeded weighted sampling, in rounds: a first point per
  restart, then in each round the ``OVERSAMPLE`` x k points with the smallest
  ``-ln(u) / distance^2`` to the points taken so far, ``u`` from a hash of seed,
  restart, round and customer.  A restart so has at most 1 + rounds x 2k
  candidates; each is weighted with the customers next to it, and k of them are
  drawn on the driver;
* assignment and new centres: a task adds up its customers by (restart, cluster)
  in arrays of whole numbers, without a row per customer and restart, so
  restarts x k rows are shuffled by a task and reach the driver.  A centre is
  the floor of its customers' mean; one without customers stays.  A restart is
  done when no centre moves.

A feature on the grid stays below sqrt(customers) x ``STEPS``, so squared
distances and a task's sums of them are far from a long's limit.

Ties of distance go to the smaller cluster number, ties of cost to the earlier
restart.  Clusters are numbered by descending mean monetary value.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("recency", "frequency", "monetary", "avg_order_value")
STEPS = 4096        # whole steps per standard deviation
OVERSAMPLE = 2      # candidates a round, in multiples of k
START_ROUNDS = 3
GRID = tuple(f"z{j}" for j in range(len(FEATURES)))

Centres = list[list[int]]


class Fit(NamedTuple):
    segments: DataFrame     # customer_id, features, segment
    cost: float             # squared distance in standard deviations, summed
    assigned: DataFrame     # customer_id, z0.., segment, distance
    centres: Centres        # by segment, on the grid


def grid(base: DataFrame) -> DataFrame:
    """``base`` with the standardised features as whole numbers ``z0``..

    Money counts in 1/10,000; the mean order value is a whole division.  A
    feature that is the same for all customers is 0 everywhere.
    """
    money = (F.col("monetary_dec").cast("decimal(28,4)") * F.lit(10000)).cast("long")
    raw = [F.col("recency").cast("long"), F.col("frequency").cast("long"), money, F.expr("_x2 div _x1")]
    x = base
    for j, c in enumerate(raw):
        x = x.withColumn(f"_x{j}", c)
    whole = [F.col(f"_x{j}").cast("decimal(19,0)") for j in range(len(FEATURES))]
    row = x.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).cast("double").alias(f"s{j}") for j, c in enumerate(whole)),
                *(F.sum(c * c).cast("double").alias(f"q{j}") for j, c in enumerate(whole))).first()
    n, z = row["n"], []
    for j in range(len(FEATURES)):
        s, q = row[f"s{j}"] or 0.0, row[f"q{j}"] or 0.0
        spread = max(q - s * s / n, 0.0) / (n - 1) if n > 1 else 0.0
        if spread == 0:
            z.append(F.lit(0).cast("long"))
        else:
            z.append(F.floor((F.col(f"_x{j}").cast("double") - F.lit(s / n)) / F.lit(spread ** 0.5) * F.lit(float(STEPS))))
    return x.select(*base.columns, *(c.cast("long").alias(name) for c, name in zip(z, GRID)))


def _literal(centres: dict[int, Centres]) -> str:
    """The centres of each restart as one constant array (restart, centres)."""
    def points(c):
        return "array(" + ", ".join("array(" + ", ".join(f"{v}L" for v in p) + ")" for p in c) + ")"

    return "array(" + ", ".join(f"named_struct('restart', {r}, 'centres', {points(c)})" for r, c in centres.items()) + ")"


def nearest(points: DataFrame, centres: dict[int, Centres]) -> DataFrame:
    """A row per point and restart with ``cluster`` and ``distance`` (squared);
    all restarts have the same number of centres."""
    m = len(next(iter(centres.values())))
    far = [" + ".join(f"(({z} - centres[{k}][{j}]) * ({z} - centres[{k}][{j}]))" for j, z in enumerate(GRID)) for k in range(m)]
    best = ", ".join(f"named_struct('distance', {d}, 'cluster', {k})" for k, d in enumerate(far))
    return points.selectExpr("*", f"inline({_literal(centres)})").selectExpr(*points.columns, "restart", f"array_min(array({best})) as _b") \
        .selectExpr(*points.columns, "restart", "_b.cluster", "_b.distance")


def _whole(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """The grid's columns, 0 for null, and which rows have a null."""
    columns = [batch.column(batch.schema.get_field_index(z)) for z in GRID]
    missing = np.zeros(batch.num_rows, dtype=bool)
    for c in columns:
        if c.null_count:
            missing |= c.is_null().to_numpy(zero_copy_only=False)
    return [pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in columns], missing


def _closest(x: list[np.ndarray], missing: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of every row's nearest centre; a row with a
    null is with the first one and adds no distance."""
    best, at = None, np.zeros(len(missing), dtype=np.int64)
    for k, p in enumerate(centres):
        far = sum((c - v) ** 2 for c, v in zip(x, p))
        if best is None:
            best = far
        else:
            at[far < best] = k
            np.minimum(best, far, out=best)
    at[missing], best[missing] = 0, 0
    return at, best


SUMS = "restart int, cluster int, n long, distance long, " + ", ".join(f"{z} long" for z in GRID)


def moved(points: DataFrame, centres: dict[int, Centres]) -> tuple[dict[int, Centres], dict[int, int], dict[tuple[int, int], int]]:
    """One assignment and update: new centres and cost of each restart, customers
    of each (restart, cluster)."""

    def task_sums(batches):
        total = {r: np.zeros((len(c), 2 + len(GRID)), dtype=np.int64) for r, c in centres.items()}
        for batch in batches:
            x, missing = _whole(batch)
            for r, c in centres.items():
                at, far = _closest(x, missing, c)
                for k in range(len(c)):
                    here = at == k
                    total[r][k] += [np.count_nonzero(here), *(v.sum(where=here) for v in (far, *x))]
        rows = [(r, k, *row) for r, t in total.items() for k, row in enumerate(t.tolist()) if row[0]]
        names = ["restart", "cluster", "n", "distance", *GRID]
        types = [pa.int32(), pa.int32()] + [pa.int64()] * (2 + len(GRID))
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(types)], names)

    sums = points.select(*GRID).mapInArrow(task_sums, SUMS).groupBy("restart", "cluster").agg(*(
        F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "distance", *GRID)))
    after = {r: [list(p) for p in c] for r, c in centres.items()}
    cost, size = dict.fromkeys(centres, 0), {}
    for row in sums.collect():  # restarts x centres at most
        n = int(row["n"])
        after[row["restart"]][row["cluster"]] = [int(row[z]) // n for z in GRID]
        cost[row["restart"]] += int(row["distance"])
        size[row["restart"], row["cluster"]] = n
    return after, cost, size


def _least(points: DataFrame, centres: dict[int, Centres], seed: int, turn: int, n: int) -> dict[int, Centres]:
    """Of each restart ``n`` points drawn without replacement, weighted by their
    squared distance to its centres (all alike without centres)."""
    def key(r):
        digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(r), F.lit(turn), F.col("customer_id").cast("string")))
        return -F.log((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52))

    names = ["restart", "_key", "customer_id", *GRID]
    order = [("_key", "ascending"), ("customer_id", "ascending")]

    def task_least(batches):
        kept = dict.fromkeys(centres)
        for batch in batches:
            x, missing = _whole(batch)
            for r, c in centres.items():
                weight = _closest(x, missing, c)[1] if c else np.where(missing, 0, 1)
                drawn = np.flatnonzero(weight)
                keys = batch.column(batch.schema.get_field_index(f"_key{r}")).to_numpy()[drawn] / weight[drawn].astype(np.float64)
                if kept[r] is not None and len(kept[r]) == n:  # only what comes before the last one kept
                    few = keys <= kept[r]["_key"][n - 1].as_py()
                    drawn, keys = drawn[few], keys[few]
                if not len(drawn):
                    continue
                rows = batch.select(names[2:]).take(pa.array(drawn))
                more = pa.table([pa.array(np.full(len(drawn), r, dtype=np.int32)), pa.array(keys), *rows.columns], names)
                both = pa.concat_tables([kept[r], more]) if kept[r] is not None else more
                kept[r] = both.take(pc.select_k_unstable(both, n, order))
        for t in kept.values():
            if t is not None:
                yield from t.to_batches()

    schema = T.StructType([T.StructField("restart", T.IntegerType()), T.StructField("_key", T.DoubleType()),
                           points.schema["customer_id"], *(T.StructField(z, T.LongType()) for z in GRID)])
    drawn = points.select("customer_id", *GRID, *(key(r).alias(f"_key{r}") for r in centres)).mapInArrow(task_least, schema)
    first = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("restart").orderBy("_key", "customer_id"))).where(F.col("_rank") <= n)
    out: dict[int, Centres] = {}
    for row in first.select("restart", "_rank", *GRID).orderBy("restart", "_rank").collect():
        out.setdefault(row["restart"], []).append([row[z] for z in GRID])
    return out


def _draw(points: Centres, weights: list[int], k: int, rng: random.Random) -> Centres:
    """k of the weighted candidates, each with the chance of weight x squared
    distance to those drawn before; repeats fill up where they run out."""
    far = [1] * len(points)
    out: Centres = []
    while len(out) < k:
        mass = [w * d for w, d in zip(weights, far)]
        if not sum(mass):
            out.append(list(out[0] if out else points[0]))
            continue
        at = rng.randrange(sum(mass))
        pick = 0
        while at >= mass[pick]:
            at -= mass[pick]
            pick += 1
        dist = [sum((a - b) ** 2 for a, b in zip(p, points[pick])) for p in points]
        far = dist if not out else [min(a, b) for a, b in zip(far, dist)]
        out.append(list(points[pick]))
    return out


def starts(points: DataFrame, k: int, restarts: int, seed: int) -> dict[int, Centres]:
    """Start centres of every restart."""
    found = _least(points, {r: [] for r in range(restarts)}, seed, 0, 1)
    if not found:
        return {}
    for turn in range(1, START_ROUNDS + 1):
        more = _least(points, found, seed, turn, OVERSAMPLE * k)
        found = {r: p + more.get(r, []) for r, p in found.items()}
    _, _, size = moved(points, found)
    return {r: _draw(p, [size.get((r, i), 0) for i in range(len(p))], k, random.Random(f"{seed}|{r}"))
            for r, p in sorted(found.items())}


def _tasks(base: DataFrame) -> int:
    """Tasks a pass: as many as the cluster runs at once, none under 1,000
    customers, none over 100,000 (labels are the same with any number)."""
    n = base.count()
    return max(1, min(n // 1_000, max(base.sparkSession.sparkContext.defaultParallelism, n // 100_000)))


def hashed_starts(points: DataFrame, k: int, seed: int) -> Centres:
    """The k points whose hash of seed and customer is smallest."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("customer_id").cast("string")))
    return [list(r) for r in points.orderBy(digest, "customer_id").select(*GRID).limit(k).collect()]


def kmeans(base: DataFrame, k: int, restarts: int, rounds: int, seed: int) -> Fit:
    """Best of ``restarts`` fits over ``base`` (materialised: it is read in every
    round).  Without customers the result is empty; with fewer different
    customers than ``k`` some segments are."""
    rows = grid(base)
    points = rows.select("customer_id", *GRID).repartition(_tasks(base)).cache()
    open_ = starts(points, k, restarts, seed)
    done: dict[int, tuple[Centres, int]] = {}
    for _ in range(rounds):
        if not open_:
            break
        after, cost, _ = moved(points, open_)
        done |= {r: (c, cost[r]) for r, c in open_.items() if after[r] == c}
        open_ = {r: c for r, c in after.items() if r not in done}
    if open_:  # stopped by the number of rounds
        _, cost, _ = moved(points, open_)
        done |= {r: (c, cost[r]) for r, c in open_.items()}
    if not done:
        points.unpersist()
        empty = rows.withColumn("segment", F.lit(0)).withColumn("distance", F.lit(0).cast("long"))
        return Fit(empty.select("customer_id", *FEATURES, "segment"), 0.0, empty.select("customer_id", *GRID, "segment", "distance"), [])
    best = min(done, key=lambda r: (done[r][1], r))
    centres, cost = done[best]
    points.unpersist()
    near = nearest(rows, {best: centres})
    worth = {row["cluster"]: Fraction(row["m"]) / row["n"] for row in near.groupBy("cluster").agg(
        F.sum("monetary_dec").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(range(k), key=lambda c: (c not in worth, -worth.get(c, Fraction(0)), c))
    names = F.array(*(F.lit(order.index(c)) for c in range(k)))
    out = near.withColumn("segment", F.element_at(names, F.col("cluster") + 1))
    return Fit(out.select("customer_id", *FEATURES, "segment"), cost / STEPS ** 2,
               out.select("customer_id", *GRID, "segment", "distance"), [centres[c] for c in order])


def first_step(base: DataFrame, k: int, seed: int) -> DataFrame:
    """One assignment and update from ``hashed_starts``: cluster, customers, the
    moved centre on the grid and the squared distances summed.  All in whole
    numbers, so any SQL engine can repeat it."""
    points = grid(base)
    begin = hashed_starts(points, k, seed)
    if not begin:
        return points.select(F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("customers"),
                             *(F.col(z).alias(f) for z, f in zip(GRID, FEATURES)), F.lit(0).cast("long").alias("distance"))
    sums = nearest(points, {0: begin}).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), *(F.sum(z).alias(f) for z, f in zip(GRID, FEATURES)), F.sum("distance").alias("distance"))
    return sums.select("cluster", "customers", *(F.expr(f"({f} - pmod({f}, customers)) div customers").alias(f) for f in FEATURES),
                       "distance")
