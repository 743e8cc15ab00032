"""Hot keys: one basket, customer or value holding a third of all rows.

Results must stay exact, and the hot group must not end up as one huge
unit of work where the design says it is split.
"""

import datetime as dt
import itertools
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.operators import basket as B
from tillroll.operators import kpi as K
from tillroll.operators import rfm as R


def test_giant_basket_pairs_exact(spark):
    items = ["A", "B", "C", "D", "E", "F"]
    lines = [(0, items[i % 6]) for i in range(3000)]                       # one basket, 1/3 of the lines
    lines += [(b, items[(b + j) % 6]) for b in range(1, 2001) for j in range(3)]  # 2000 ordinary baskets
    f = spark.createDataFrame(lines, "order_key long, category string").repartition(8)
    got = {(r.item_a, r.item_b): r.pair_count for r in B.basket_pairs(f, min_support=0.0).collect()}
    sets = {}
    for b, it in lines:
        sets.setdefault(b, set()).add(it)
    want = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    assert got == dict(want)
    multi = {(r.item_a, r.item_b): r.pair_count for r in B.basket_pairs_multiset(f).collect()}
    # list semantics for the giant basket: 500 lines per item
    assert multi[("A", "B")] >= 500 * 500 and multi[("A", "A")] >= 500 * 499 // 2


def test_hot_customer_rfm_exact(spark):
    d0 = dt.date(2024, 1, 1)
    rows = [(o, 1, d0 + dt.timedelta(days=o % 30), Decimal("1.5")) for o in range(1000)]          # hot customer
    rows += [(1000 + o, 2 + o % 100, d0 + dt.timedelta(days=o % 7), Decimal("2.0")) for o in range(2000)]
    f = spark.createDataFrame(rows, "order_key long, customer_id long, date date, revenue_dec decimal(18,2)") \
        .withColumn("quantity", F.lit(1.0)).withColumn("revenue_dec", F.col("revenue_dec").cast("decimal(38,4)"))
    base = {r.customer_id: r for r in R.rfm_base(None, K.orders_of(f.repartition(8))).collect()}
    assert base[1].frequency == 1000 and base[1].monetary == 1500.0
    assert base[2].frequency == 20 and base[2].monetary == 40.0


def test_range_partitioning_splits_a_hot_value(spark):
    # half the rows share frequency 5; the total order (frequency, id) lets the
    # range partitioner spread them over several partitions
    rows = [(5 if i % 2 else i % 50, i) for i in range(20000)]
    df = spark.createDataFrame(rows, "frequency int, customer_id int")
    parts = df.repartitionByRange(8, "frequency", "customer_id").where("frequency = 5") \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 3
