"""Distributed global positions, exact quantiles and ``qcut``-style scores.

A ``row_number()`` over a window without ``partitionBy`` moves every row to a
single task.  ``global_position`` instead range-partitions on a *total* order
(ties broken by the remaining key columns, so one repeated value is split
across partitions), sorts inside each partition, counts the rows of each
partition and adds the running count of the partitions before it.  The sorted
frame is checkpointed to the session's reliable checkpoint folder first, so
the per-partition counts and the row offsets are read from the same
materialised partitions even if an executor is lost and work is redone.

Only the per-partition counts (one row per partition, a proven bound) travel
through a single task and are broadcast.

``exact_quantiles`` reads the two order statistics around each requested
position (linear interpolation) by counting passes over narrowing ranges of
values: nothing is sorted and only counts are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _range_partition(df: DataFrame, cols: Sequence[Column | str], num_partitions: int | None) -> DataFrame:
    """Range-partition on ``cols``; without an explicit count the shuffle is
    sized by AQE from its measured output (adjacent ranges are coalesced, so
    the order across partitions is kept)."""
    if num_partitions:
        return df.repartitionByRange(num_partitions, *cols)
    return df.repartitionByRange(*cols)


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """``df`` with a 1-based position in the total order ``order``.

    ``order`` must be a total order on the rows (end it with a key); equal
    keys would get arbitrary but distinct positions.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = (
        _range_partition(df, order_cols, num_partitions)
        .sortWithinPartitions(*order_cols)
        .withColumn("_tr_pid", F.spark_partition_id())
        .withColumn("_tr_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    counts = ranked.groupBy("_tr_pid").agg(F.count(F.lit(1)).alias("_tr_n"))
    # one row per partition: the running offset is a tiny single-task window
    offsets = counts.select(
        "_tr_pid",
        F.coalesce(
            F.sum("_tr_n").over(Window.orderBy("_tr_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_tr_off"),
    )
    row_in_part = F.col("_tr_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ranked.join(F.broadcast(offsets), "_tr_pid")
        .withColumn(name, (F.col("_tr_off") + row_in_part + 1).cast("long"))
        .drop("_tr_pid", "_tr_mid", "_tr_off")
    )


BINS = 1024           # counted ranges of values a pass
_WHOLE = "_tr_whole"  # the group's name where there is none


def value_histogram(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their counts ``(*group, value, n)``, materialised.

    Equal values are combined map-side; the frame is written to the reliable
    checkpoint folder, so ``df`` is evaluated once however many passes follow.
    """
    checkpoint_dir(df.sparkSession)
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)


def order_statistics(df: DataFrame, value: str, positions: Callable[[int], Sequence[int]], group: str | None = None,
                     weight: str | None = None) -> dict[object, tuple[int, dict[int, float]]]:
    """Per group the row count and the values at the wanted 1-based positions.

    Selection by counting, without a sort: a pass counts the rows in ``BINS``
    equally wide ranges between the least and the greatest value (a partial
    aggregate: at most ranges + 1 rows per group and task are shuffled); the
    next pass looks only into the ranges that hold a wanted position, between
    the least and greatest value found in each, until a range holds one value.
    Every pass narrows a range ``BINS`` times, so a handful of passes is enough
    for any doubles, and a value that repeats ends its range at once.

    ``df`` is read once a pass: hand in a materialised frame.  ``group`` is a
    column with few values (names of columns); ``weight`` counts a row several
    times.  Nulls, NaN and infinities are left out.
    """
    g = F.col(group) if group else F.lit(_WHOLE)
    w = F.col(weight) if weight else F.lit(1)
    v = F.col(value).cast("double")
    rows = df.select(g.alias("_g"), v.alias("_v"), w.cast("long").alias("_w")) \
        .where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    found: dict[object, tuple[int, dict[int, float]]] = {}
    open_: list[tuple] = []  # (group, least, greatest, rows before, positions)

    def settle(name, lo, hi, before, want):
        if lo == hi:
            found[name][1].update(dict.fromkeys(want, lo))
        elif want:
            open_.append((name, lo, hi, before, want))

    for r in rows.groupBy("_g").agg(F.sum("_w").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
        found[r["_g"]] = (r["n"], {})
        settle(r["_g"], r["lo"], r["hi"], 0, sorted({p for p in positions(r["n"]) if 1 <= p <= r["n"]}))
    while open_:
        spans, open_ = open_, []
        parts = []
        for i, (name, lo, hi, _, _) in enumerate(spans):
            unit = 1.0 if math.isfinite(hi - lo) else 0.5  # the width is a double
            parts.append(F.struct(F.lit(i).alias("i"), F.lit(name).alias("g"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                                  F.lit(unit).alias("unit"), F.lit(hi * unit - lo * unit).alias("width")))
        s = F.col("_s")
        at = F.floor((F.col("_v") * s["unit"] - s["lo"] * s["unit"]) / s["width"] * BINS)
        inside = F.filter(F.array(*parts), lambda s: s["g"].eqNullSafe(F.col("_g")) & (F.col("_v") >= s["lo"]) & (F.col("_v") <= s["hi"]))
        counted = rows.withColumn("_s", F.explode(inside)).groupBy(F.col("_s.i").alias("i"), at.alias("bin")).agg(
            F.sum("_w").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
        for r in sorted(counted, key=lambda r: (r["i"], r["bin"])):
            name, lo, hi, before, want = spans[r["i"]]
            here = [p for p in want if before < p <= before + r["n"]]
            settle(name, r["lo"], r["hi"], before, here)
            spans[r["i"]] = (name, lo, hi, before + r["n"], want)
    return found


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: str | None = None,
                    weight: str | None = None) -> dict[object, list[float]]:
    """Linear-interpolated quantiles of each group (``None`` without one), as
    NumPy/pandas ``quantile`` and DuckDB ``quantile_cont`` define them; a group
    without values has none.  ``lo + (hi - lo) * f`` between the two
    neighbouring order statistics, which ``order_statistics`` finds.
    """
    def around(n):
        return [p for q in probs for p in (math.floor((n - 1) * q) + 1, math.floor((n - 1) * q) + 2)]

    out = {}
    for name, (n, at) in order_statistics(df, value, around, group, weight).items():
        cuts = []
        for q in probs:
            h = (n - 1) * q
            lo = at[math.floor(h) + 1]
            cuts.append(lo + (at.get(math.floor(h) + 2, lo) - lo) * (h - math.floor(h)))
        out[name if group else None] = cuts
    return out


QUARTILES = (0.25, 0.5, 0.75)

_SKETCH_ACCURACY = 100000
_FRACTIONS = [10.0 ** (-k / 2) for k in range(24, -1, -1)]  # 1e-12 ... 1
_PREFILTER_TRIES = 3
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def top_k(df: DataFrame, n: int, order: Sequence[Column], lead: str | None = None,
          prefilter_from: int = 1000) -> DataFrame:
    """First ``n`` rows of ``df`` in ``order`` (exact), for large ``n`` too.

    ``orderBy().limit(n)`` plans a top-k whose last task merges ``n`` rows
    from every input partition.  For ``n >= prefilter_from`` and a numeric or
    date leading sort column ``lead`` (ascending, nulls first), one sketch job
    finds a threshold ``t`` with about ``2 n`` rows at or below it; a count
    verifies that ``lead <= t`` (or null) keeps at least ``n`` rows, and the
    top-k then runs on those candidates only.  Any row of the true first
    ``n`` has ``lead <= t``, so the result is exact; if the check fails the
    plain top-k is used.
    """
    plain = df.orderBy(*order).limit(n)
    if lead is None or n < prefilter_from or dict(df.dtypes).get(lead) not in _NUMERIC:
        return plain
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 F.percentile_approx(lead, _FRACTIONS, _SKETCH_ACCURACY).alias("_q")).first()
    total, qs = row["_n"], row["_q"]
    if not total or qs is None:
        return plain
    need = 2 * n + 2 * total / _SKETCH_ACCURACY
    tries = 0
    for frac, t in zip(_FRACTIONS, qs):
        if frac * total >= need and t is not None:
            cand = df.where(F.col(lead).isNull() | (F.col(lead) <= F.lit(t)))
            if cand.count() >= n:
                return cand.orderBy(*order).limit(n)
            tries += 1  # e.g. one hot value at the low end: widen the threshold
            if tries == _PREFILTER_TRIES:
                break
    return plain


def qcut_score(x: Column, q0: Column, q1: Column, q2: Column, labels: Sequence[str] = ("1", "2", "3", "4")) -> Column:
    """Right-closed quartile bins like ``pandas.qcut(x, 4, labels)``.

    Equal cut points do not raise; the value falls into the lowest bin.
    """
    return (
        F.when(x <= q0, F.lit(labels[0]))
        .when(x <= q1, F.lit(labels[1]))
        .when(x <= q2, F.lit(labels[2]))
        .otherwise(F.lit(labels[3]))
    )


def smallest_keys(df: DataFrame, key: str, n: int, prefilter_from: int = 1000) -> DataFrame:
    """The ``n`` smallest distinct non-null values of ``key`` (exact).

    Without help this is a distinct over every key (a shuffle of all keys)
    and a top-k.  For ``n >= prefilter_from`` and a numeric or date key, one
    sketch job picks a threshold ``t`` with a few times ``n`` rows below it;
    the distinct runs only on ``key <= t`` and a count verifies that at least
    ``n`` distinct keys are there (else the plain plan is used).  Every one
    of the ``n`` smallest keys is ``<= t`` in that case, so the result is exact.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    plain = keys.distinct().orderBy(key).limit(n)
    if n < prefilter_from or dict(df.dtypes).get(key) not in _NUMERIC:
        return plain
    row = keys.agg(F.count(F.lit(1)).alias("_n"),
                   F.percentile_approx(key, _FRACTIONS, _SKETCH_ACCURACY).alias("_q")).first()
    total, qs = row["_n"], row["_q"]
    if not total or qs is None:
        return plain
    need = 8 * n + 2 * total / _SKETCH_ACCURACY  # rows, allowing several rows per key
    tries = 0
    for frac, t in zip(_FRACTIONS, qs):
        if frac * total >= need and t is not None:
            cand = keys.where(F.col(key) <= F.lit(t)).distinct()
            if cand.count() >= n:
                return cand.orderBy(key).limit(n)
            tries += 1
            if tries == _PREFILTER_TRIES:
                break
    return plain
