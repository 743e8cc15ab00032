"""N-gram Jaccard self-join of whole texts by a grouped prefix join.

A document's set holds its distinct ``k``-word shingles as 64-bit hashes.  Two
documents link when ``100 * intersection >= percent * union``.  The result is
exact: every pair that can link is verified on the whole sets, or lies within
one component already.

1. Frequent shingles are estimated over all texts (a shingle that repeats
   within a block of texts is counted).  They only decide the *order* of
   shingles, rare before frequent, then by hash: any order gives the same
   links, this one keeps common passages out of the prefixes.
2. A set's prefix is its first ``n - ceil(percent * n / 100) + 1`` shingles.
   Documents with one set are one node, nodes with one size and prefix are one
   group.
3. Nodes that share a minimum hash are held against the group's most ordinary
   member (a star, not all pairs); verified links give first components, so
   that large families of near copies are one component before any pairing.
4. Group pairs of two components meet where they share a shingle among the
   first that their two sizes call for, and their prefixes must have as much in
   common as those of linked sets.  Survivors expand to their members and are
   verified on the whole sets.

Defined cases: null, empty and blank texts have an empty set, link with
nothing and are their own component; a null id is linked with nothing and has
a null component; rows that repeat an id are one document that links through
any of its texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.arrow import pieces
from tillroll.llm.components import components
from tillroll.llm.tables import drop, written
from tillroll.llm.words import U, distinct, mix, shingle_sets

#: Shingles counted together when looking for those that repeat.
BLOCK = 2_000_000
#: At most this many frequent shingles are broadcast (9 bytes each).
FREQUENT = 1_000_000
#: A side of at most this many ids or shingles is broadcast, a larger one joined.
BROADCAST_ROWS = 2_000_000


def needed(n: int, percent: int) -> int:
    """The least overlap a set of this size needs with a linked one."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1


# ------------------------------------------------------------------ order


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and ranks of the shingles that repeat most; the rank
    is the bit length of the estimated count."""

    def repeats(batches):
        held, size = [], 0

        def counted():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

        for batch in pieces(batches, 0):
            for s in shingle_sets(batch.column(0).to_pylist(), k):
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(repeats, "token long, n long")
    counts = written(
        found.groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8").select("token", F.length(F.bin("n")).cast("byte").alias("rank")),
        "frequent",
    )
    sizes = {r["rank"]: r["n"] for r in counts.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = 64, 0
    while least > 0 and total + sizes.get(least, 0) <= FREQUENT:
        total += sizes.get(least, 0)
        least -= 1
    top = counts.where(F.col("rank") > least).toArrow()
    drop(counts)
    token = top.column("token").to_numpy().view(U)
    order = np.argsort(token)
    return token[order], top.column("rank").to_numpy()[order]


def _ranks(s: np.ndarray, token: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """0 for a shingle that isn't frequent."""
    if not len(token):
        return np.zeros(len(s), dtype=np.int8)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    return np.where(token[at] == s, rank[at], 0).astype(np.int8)


# ------------------------------------------------------------------ sets

PREFIX_SCHEMA = "doc_id long, n long, rare long, set_key binary, group_key binary, prefix array<long>, keys array<long>"


def prefixes(docs: DataFrame, k: int, percent: int, shared: Broadcast) -> DataFrame:
    """One row per document: size, number of shingles that aren't frequent, a
    128-bit key of the set, one of size and prefix, the prefix, minimum hashes.
    ``shared`` holds the frequent shingles and their ranks."""
    seeds = mix(np.arange(1, 3, dtype=U))

    def rows(batches):
        token, rank = shared.value
        for batch in pieces(batches, 1):
            out: list[tuple] = []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
                ranks = _ranks(s, token, rank)
                first = s[np.argsort(ranks, kind="stable")[: prefix_length(len(s), percent)]] if len(s) else s
                low = s[ranks == 0]
                # the hashes of the whole set, and of what is rare in it
                keys = [int(mix(x ^ seed).min().view(np.int64)) for x, seed in zip((s, s, low), (*seeds, U(0)), strict=True) if len(x)]
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                group = hashlib.blake2b(len(s).to_bytes(8, "little") + first.tobytes(), digest_size=16).digest()
                out.append((doc, len(s), len(low), digest, group, first.view(np.int64), keys))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["doc_id", "n", "rare", "set_key", "group_key", "prefix", "keys"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, PREFIX_SCHEMA)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``node, shingles`` of the documents named in ``ids(node)``."""

    def rows(batches):
        for batch in pieces(batches, 1):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    few = ids.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return texts.join(F.broadcast(ids) if few else ids, "node", "left_semi").mapInArrow(rows, "node long, shingles array<long>")


# ------------------------------------------------------------------ pairs


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether two sizes can link at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The overlap that two linked sets of these sizes have at least."""
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def _enough(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose prefixes have as much in common as those of
    linked sets: the overlap their sizes call for, less all that can lie behind
    the prefix that ends first.  ``nodes(node, n, prefix)``."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}")) for x in "ab")
    n, m = F.col("na"), F.col("nb")
    behind = F.ceil(F.greatest(n, m) * percent / F.lit(100)) - 1
    enough = F.size(F.array_intersect("pa", "pb")) >= _overlap(n, m, percent) - behind
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets link."""
    ids = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    sets = written(sets_of(docs, ids, k), "sets")
    left, right = (sets.toDF(x, f"s{x}") for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    linked = pairs.select("a", "b").join(left, "a").join(right, "b").where(common * 100 >= union * percent)
    out = written(linked.select("a", "b"), "links")
    drop(sets)
    return out


def star_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Each node against the most ordinary node (fewest rare shingles) that
    shares its prefix and size or one of its minimum hashes."""
    keys = F.concat(F.col("keys"), F.array(F.xxhash64("group_key")))
    entries = nodes.select("node", "n", F.posexplode(keys).alias("kind", "key"), "rare")
    centres = entries.groupBy("kind", "key").agg(F.min(F.struct("rare", "node", "n")).alias("c"), F.count(F.lit(1)).alias("size"))
    centres = written(centres.where("size > 1").select("kind", "key", F.col("c.node").alias("centre"), F.col("c.n").alias("m")), "centres")
    pairs = (
        entries.join(centres, ["kind", "key"])
        .where((F.col("node") != F.col("centre")) & _alike(F.col("n"), F.col("m"), percent))
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )
    # the prefixes alone tell most pairs apart that share just a passage
    return _enough(pairs, nodes, percent)


def cross_pairs(nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Node pairs of different components that can link: pairs within a group,
    and members of group pairs with enough prefix shingles in common."""
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named.select("node", "n", "component", "group_key", "prefix"), "named")
    mixed = -F.min("node") - 1  # a group of several components is none of them
    groups = named.groupBy("group_key").agg(
        F.min("node").alias("g"),
        F.when(F.min("component") == F.max("component"), F.min("component")).otherwise(mixed).alias("of"),
        F.min(F.struct("n", "prefix")).alias("p"),
    )
    groups = written(groups.select("group_key", "g", "of", "p.n", "p.prefix"), "groups")
    entries = groups.select("g", "n", "of", F.posexplode("prefix").alias("at", "token"))
    shared = entries.groupBy("token").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi")
    shared = written(shared.select("token"), "shared-tokens")
    few = shared.count() <= BROADCAST_ROWS
    entries = written(entries.join(F.broadcast(shared) if few else shared, "token"), "entries")
    left, right = (entries.select("token", *(F.col(c).alias(c + x) for c in ("g", "n", "of", "at"))) for x in "ab")
    n, m = F.col("na"), F.col("nb")
    # linked sets share one of their first n - overlap + 1 shingles each
    spare_a, spare_b = (size - _overlap(n, m, percent) for size in (n, m))
    met = left.join(right, "token").where(
        (F.col("ga") < F.col("gb")) & (F.col("ofa") != F.col("ofb")) & _alike(n, m, percent)
        & (F.col("ata") <= spare_a) & (F.col("atb") <= spare_b)
    )
    group_pairs = met.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
    group_pairs = _enough(group_pairs, groups.withColumnRenamed("g", "node"), percent).toDF("ga", "gb")

    members = named.join(groups.select("group_key", "g", "of"), "group_key").select("g", "node", "component", "of")
    one, two = (members.select(*(F.col(c).alias(c[0] + x) for c in ("g", "node", "component"))) for x in "ab")
    across = group_pairs.join(one, "ga").join(two, "gb").withColumnsRenamed({"na": "va", "nb": "vb"})
    several = members.where("of < 0")
    one, two = (several.select(F.col("g"), F.col("node").alias(f"v{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    inside = one.join(two, "g").where("va < vb")
    differ = F.col("ca") != F.col("cb")
    pairs = across.where(differ).select("va", "vb").union(inside.where(differ).select("va", "vb"))
    out = written(pairs.select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")).where("a <> b").distinct(), "cross-pairs")
    drop(entries, shared, groups, named)
    return out


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))
    found = written(prefixes(docs, k, percent, order), "prefixes")
    order.destroy()
    there = found.where("n > 0 and doc_id is not null")
    one = there.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "rare", "group_key", "prefix", "keys")).alias("m"))
    fields = [F.col(f"m.{c}").alias(c) for c in ("n", "rare", "group_key", "prefix", "keys")]
    nodes = written(one.select("set_key", F.col("m.doc_id").alias("node"), *fields), "nodes")

    # an id that has several texts links their nodes
    texts = there.select("doc_id", "set_key").distinct()
    several = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("doc_id")
    repeats = texts.join(several, "doc_id").join(nodes.select("set_key", "node"), "set_key").where("doc_id <> node")
    repeats = repeats.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    first = _verified(docs, written(star_pairs(nodes, percent), "star-pairs"), k, percent)
    first = written(first.union(repeats), "links")
    labels = components(first)
    rest = _verified(docs, cross_pairs(nodes, labels, percent), k, percent)
    if not rest.isEmpty():
        labels = components(written(first.union(rest), "links"))

    classes = written(nodes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component")), "classes")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.join(classes, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
