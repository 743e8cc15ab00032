"""Market-basket analysis: item pairs, support, association rules, FP-growth.

Pair counting is a self equi-join of (basket, item) on the basket id with the
theta condition ``a.item < b.item``.  Before the join each basket is reduced to
its distinct items (set semantics) or to (item, multiplicity) (list
semantics), so a basket contributes at most C(d, 2) pairs where d is its
number of *distinct* items, never pairs of lines.

For set semantics with a support threshold the a-priori bound prunes items
first: an item in fewer than ``min_support * baskets`` baskets cannot be part
of a frequent pair, and at most ``avg distinct items per basket / min_support``
items survive, so the pairs per basket are bounded by the threshold, not by
the basket size.  The surviving item list is bounded by the same argument and
is joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import PAIR_MIN_SUPPORT

BASKET_SAMPLE = 2000  # the reference scans the first 2,000 baskets


def basket_items(fact: DataFrame, item: str) -> DataFrame:
    """Distinct (basket, item) rows.

    The distinct is combined map-side before its shuffle, so a hot basket
    (even a third of all lines) reaches the shuffle as at most one row per
    item and map task.
    """
    # both null checks are explicit so that every consumer of this frame sees
    # the same filters (and Spark can reuse one shuffle for all of them)
    return fact.where(F.col(item).isNotNull() & F.col("order_key").isNotNull()).select(
        F.col("order_key").alias("basket"), F.col(item).alias("item")).distinct()


def basket_count(items: DataFrame) -> DataFrame:
    """One row: baskets with at least one (non-null) item."""
    return items.groupBy("basket").agg(F.count(F.lit(1)).alias("_k")).agg(F.count(F.lit(1)).alias("baskets"))


def item_support(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("item_baskets"))


def pair_counts(items: DataFrame) -> DataFrame:
    """Baskets containing both items, for every unordered pair a < b."""
    a = items.select(F.col("basket"), F.col("item").alias("item_a"))
    b = items.select(F.col("basket"), F.col("item").alias("item_b"))
    return a.join(b, (a["basket"] == b["basket"]) & (F.col("item_a") < F.col("item_b"))) \
        .groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("pair_count"))


def frequent_pair_frames(fact: DataFrame, item: str, min_support: float):
    """(items, basket count, item support, pair counts) from one items frame.

    All four derive from the same ``items`` subtree, so Spark reuses its
    shuffle output instead of scanning the fact again.  With a positive
    threshold the items are pruned a-priori by an inner broadcast join with
    the frequent items (at most avg items per basket / min_support of them);
    an inner join, unlike a semi join, is not pushed below the distinct, so
    the subtree stays shared.
    """
    items = basket_items(fact, item)
    n = basket_count(items)
    sup = item_support(items)
    if min_support > 0:
        keep = sup.crossJoin(F.broadcast(n)).where(
            F.col("item_baskets") >= F.lit(min_support) * F.col("baskets")).select("item")
        pruned = items.join(F.broadcast(keep), "item").select("basket", "item")
    else:
        pruned = items
    return items, n, sup, pair_counts(pruned)


def basket_pairs(fact: DataFrame, item: str = "category", min_support: float = PAIR_MIN_SUPPORT) -> DataFrame:
    """Pairs with support >= ``min_support``, by descending support."""
    _, n, _, pairs = frequent_pair_frames(fact, item, min_support)
    return pairs.crossJoin(F.broadcast(n)).select(
        "item_a", "item_b", "pair_count",
        (F.col("pair_count") / F.col("baskets")).alias("support"),
    ).where(F.col("support") >= F.lit(min_support)).orderBy(F.desc("support"), "item_a", "item_b")


def basket_pairs_top(pairs: DataFrame, n: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("support"), "item_a", "item_b").limit(n)


def basket_pairs_sample(fact: DataFrame, item: str = "category", min_support: float = PAIR_MIN_SUPPORT,
                        sample: int = BASKET_SAMPLE) -> DataFrame:
    """The reference's sampled variant: only the first ``sample`` baskets.

    The denominator is the number of baskets actually scanned.  The sample
    list has at most ``sample`` rows and is joined by broadcast.
    """
    from tillroll.functions.ranking import smallest_keys

    first = smallest_keys(fact, "order_key", sample)
    sub = fact.join(F.broadcast(first), "order_key", "left_semi")
    return basket_pairs(sub, item, min_support)


def basket_pairs_multiset(fact: DataFrame, item: str = "category") -> DataFrame:
    """List semantics: every pair of lines in a basket, repeats included.

    With n_a lines of item a in a basket, the pair (a, b) occurs n_a * n_b
    times for a < b and n_a (n_a - 1) / 2 times for (a, a).  Baskets are first
    reduced to (item, n) rows, so the join is over distinct items per basket.
    """
    per = fact.where(F.col(item).isNotNull()).groupBy(F.col("order_key").alias("basket"), F.col(item).alias("item")) \
        .agg(F.count(F.lit(1)).alias("n"))
    a = per.select("basket", F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = per.select("basket", F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    cross = a.join(b, (a["basket"] == b["basket"]) & (F.col("item_a") < F.col("item_b"))) \
        .select("item_a", "item_b", (F.col("n_a") * F.col("n_b")).alias("w"))
    same = per.where(F.col("n") >= 2).select(
        F.col("item").alias("item_a"), F.col("item").alias("item_b"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("w"))
    n = per.groupBy("basket").agg(F.count(F.lit(1)).alias("_k")).agg(F.count(F.lit(1)).alias("baskets"))
    return cross.unionByName(same).groupBy("item_a", "item_b").agg(F.sum("w").alias("pair_count")) \
        .crossJoin(F.broadcast(n)).select(
            "item_a", "item_b", "pair_count", (F.col("pair_count") / F.col("baskets")).alias("support"))


def association_rules(fact: DataFrame, item: str = "category", min_support: float = PAIR_MIN_SUPPORT) -> DataFrame:
    """Rules a -> b from frequent pairs: support, confidence, lift.

    Each ratio is one division of exact integer counts.
    """
    _, n, sup, pairs = frequent_pair_frames(fact, item, min_support)
    fp = pairs.crossJoin(F.broadcast(n)).where(F.col("pair_count") / F.col("baskets") >= F.lit(min_support)) \
        .select("item_a", "item_b", "pair_count")
    both = fp.select(F.col("item_a").alias("antecedent"), F.col("item_b").alias("consequent"), "pair_count") \
        .unionByName(fp.select(F.col("item_b").alias("antecedent"), F.col("item_a").alias("consequent"), "pair_count"))
    sa = sup.select(F.col("item").alias("antecedent"), F.col("item_baskets").alias("antecedent_baskets"))
    sc = sup.select(F.col("item").alias("consequent"), F.col("item_baskets").alias("consequent_baskets"))
    r = both.join(sa, "antecedent").join(sc, "consequent").crossJoin(F.broadcast(n))
    return r.select(
        "antecedent", "consequent", "pair_count",
        (F.col("pair_count") / F.col("baskets")).alias("support"),
        (F.col("pair_count") / F.col("antecedent_baskets")).alias("confidence"),
        ((F.col("pair_count") * F.col("baskets")) / (F.col("antecedent_baskets") * F.col("consequent_baskets"))).alias("lift"),
    )


def frequent_itemsets(fact: DataFrame, item: str = "category", min_support: float = PAIR_MIN_SUPPORT,
                      min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """FP-growth (``pyspark.ml.fpm.FPGrowth``) on the set of items per basket.

    A basket's item set is bounded by the item vocabulary.  Returns the
    frequent itemsets (items joined with '|', sorted) and the rules.
    """
    from pyspark.ml.fpm import FPGrowth

    tx = fact.where(F.col(item).isNotNull()).groupBy("order_key").agg(F.collect_set(item).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(tx)
    sets = model.freqItemsets.select(
        F.concat_ws("|", F.array_sort("items")).alias("itemset"),
        F.size("items").alias("size"),
        F.col("freq").cast("long").alias("baskets"),
    )
    rules = model.associationRules.select(
        F.concat_ws("|", F.array_sort("antecedent")).alias("antecedent"),
        F.concat_ws("|", F.array_sort("consequent")).alias("consequent"),
        "confidence", "lift", "support",
    )
    return sets, rules
