"""K-means over integer vectors, centroids searched in a vantage-point tree.

Each round builds a vantage-point tree over the centroids, broadcasts it (its
size is that of the centroids: their number times their components) and assigns
every vector by a best-first branch-and-bound: a vector always opens the node
with its smallest lower bound and stops when that bound exceeds its best
distance.  A bound equal to the best distance is still opened (inclusive
pruning), so that of equally near centroids the smaller number is found.  All
vectors of a batch search at once, each with its own queue.  Distances at
vantage points and in leaves are exact integers; only the bounds are floating
point, lowered by more than their rounding error.

Sums go up as one row per task, centroid and component; the new centroids are
exact floors of sum / count.  The integer vectors are written once and read in
every round: a lost executor costs its tasks of one round.

Defined cases: vectors with a null, a non-finite component or another number of
components, and null vectors, are left out; rows that repeat an id are vectors
each; a null id is clustered like any other and comes last in the choice of
starting centroids; vectors with one hash are chosen in the order of their
components; with fewer vectors than centroids there are as many centroids as
vectors, repeated ones stay empty; an empty table gives no rows; other columns
are ignored.  Components beyond ``LARGEST`` in size have squared distances that
don't fit a long and stop the query with a message.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.tables import written

#: Centroids in a leaf at most.
LEAF = 2
#: Vectors that search together; each has a queue as long as the tree.
TOGETHER = 4096
#: 64 squares of twice this fit a long.
LARGEST = 1 << 27
#: Distances are of integers below 2**34; their bounds are lowered by this much.
MARGIN = 1e-4


@dataclass
class Node:
    members: np.ndarray  # centroid numbers to measure here: a leaf's, or the vantage point
    #: (child, least, most distance of its centroids from the vantage point)
    children: list[tuple[int, float, float]] = field(default_factory=list)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def build(centroids: np.ndarray) -> list[Node]:
    """The tree as a list, root first: at a vantage point the others part at
    the median distance, points at it on the inside."""
    tree: list[Node] = []

    def add(numbers: np.ndarray) -> int:
        place = len(tree)
        if len(numbers) <= LEAF:
            tree.append(Node(numbers))
            return place
        # the point farthest from the first one sees the others best apart
        vantage = numbers[np.argmax(squared(centroids[numbers], centroids[numbers[0]]))]
        rest = numbers[numbers != vantage]
        away = squared(centroids[rest], centroids[vantage])
        if not away.any():  # one point many times
            tree.append(Node(numbers))
            return place
        tree.append(Node(np.array([vantage])))
        inside = away <= np.sort(away)[(len(away) - 1) // 2]
        for part in (inside, ~inside):
            if part.any():
                least, most = np.sqrt(away[part].min()), np.sqrt(away[part].max())
                tree[place].children.append((add(rest[part]), float(least), float(most)))
        return place

    if len(centroids):
        add(np.arange(len(centroids)))
    return tree


def nearest(vectors: np.ndarray, centroids: np.ndarray, tree: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of every vector's nearest centroid, the
    smaller number of equally near ones."""
    n = len(vectors)
    best = np.full(n, np.iinfo(np.int64).max)
    number = np.full(n, len(centroids))
    queue = np.full((n, len(tree)), np.inf)  # lower bounds of the nodes not opened yet
    queue[:, 0] = 0.0
    searching = np.arange(n)
    while len(searching):
        node = np.argmin(queue[searching], axis=1)
        bound = queue[searching, node]
        go = bound * bound <= best[searching]
        searching, node, bound = searching[go], node[go], bound[go]
        queue[searching, node] = np.inf
        for k in np.unique(node):
            here = searching[node == k]
            for c in tree[k].members:
                d = squared(vectors[here], centroids[c])
                better = (d < best[here]) | ((d == best[here]) & (c < number[here]))
                best[here[better]], number[here[better]] = d[better], c
            if tree[k].children:
                away = np.sqrt(d.astype(np.float64))  # a vantage point stands alone
                for child, least, most in tree[k].children:
                    apart = np.maximum(np.maximum(least - away, away - most) - MARGIN, 0.0)
                    queue[here, child] = np.maximum(apart, bound[node == k])
        # an empty queue has the bound infinity and ends the search
    return number, best


def kept_vectors(table: DataFrame, components: int, scale: int) -> DataFrame:
    """``vec_id, x``: the vectors that count, as integers ``floor(scale * x)``."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = table.where(F.col("embedding").isNotNull() & (F.size("embedding") == components)).where(finite)
    scaled = F.transform(values, lambda v: F.floor(F.lit(float(scale)) * v))
    large = F.exists(values, lambda v: F.abs(v) * scale > LARGEST)
    message = F.concat(F.lit("a vector has a component beyond the range of exact distances: "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    x = F.when(large, F.raise_error(message).cast("array<bigint>")).otherwise(scaled)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.ListArray, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), components)


def starting_centroids(vectors: DataFrame, k: int, salt: str, components: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("vec_id", "x").orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), components)


def searched(batches, centroids: np.ndarray, tree: list[Node], components: int):
    """``batch, vectors, number, distance`` for pieces of ``TOGETHER`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, TOGETHER):
            piece = batch.slice(i, TOGETHER)
            x = matrix(piece.column(piece.schema.get_field_index("x")), components)
            yield piece, x, *nearest(x, centroids, tree)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, components = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, build(centroids)))

    def sums(batches):
        points, tree = shared.value
        total, count = np.zeros((k, components), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, x, number, _ in searched(batches, points, tree, components):
            there = np.argsort(number, kind="stable")
            seen, at = np.unique(number[there], return_index=True)
            total[seen] += np.add.reduceat(x[there], at, axis=0)
            count += np.bincount(number, minlength=k)
        cluster, place = (a.ravel() for a in np.indices((k, components)))
        full = np.repeat(count, components) > 0
        columns = [cluster[full], place[full], np.repeat(count, components)[full], total.ravel()[full]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "place", "n", "total"])

    parts = vectors.mapInArrow(sums, "cluster long, place long, n long, total long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total")]
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(*exact).collect():  # a row per centroid and component
        out[r["cluster"], r["place"]] = int(r["total"]) // int(r["n"])
    shared.destroy()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    components = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, build(centroids)))

    def rows(batches):
        points, tree = shared.value
        for piece, _, number, distance in searched(batches, points, tree, components):
            yield pa.RecordBatch.from_arrays(
                [piece.column(piece.schema.get_field_index("vec_id")), pa.array(number.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    out = written(vectors.mapInArrow(rows, "vec_id long, cluster int, distance long"), "assigned")
    shared.destroy()
    return out


def sha256_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def vp_kmeans(
    spark: SparkSession, table: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, salt: str = "3"
) -> DataFrame:
    """One row per vector: its cluster, squared distance, the distances summed
    over its cluster and over all, and the hash of its final centroid."""
    vectors = written(kept_vectors(table, components, scale), "vectors")
    centroids = starting_centroids(vectors, k, salt, components)
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = assigned(vectors, centroids)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row per centroid
    of_cluster = {r["cluster"]: int(r["d"]) for r in sums}
    rows = [(c, d, sum(of_cluster.values()), sha256_of(centroids[c])) for c, d in of_cluster.items()]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
