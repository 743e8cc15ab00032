"""Near duplicates by SimHash, compared through tables of pivot distances.

A document's fingerprint has a 1 where more than half of its shingles' 64-bit
hashes have one.  Two documents link when their fingerprints differ in at most
``bits`` places; the result is exact.

1. Equal fingerprints are one node, so exact copies never meet each other.
2. The Hamming distances from every node to ``PIVOTS`` reference fingerprints
   are computed once.  By the triangle inequality two linked nodes differ by at
   most ``bits`` in every coordinate of that table, so a pair with a larger
   coordinate difference is discarded unseen; survivors are verified.
3. Distances to references alone bring no two nodes together without comparing
   all pairs (one coordinate keeps half of them).  Nodes meet where they agree
   on whole blocks: of ``b`` blocks, ``bits`` differing places leave ``b -
   bits`` alike, so linked nodes share a key for some choice of ``b - bits``
   blocks.  More nodes call for more blocks, that is longer keys, so that the
   number of chance meetings of a node stays bounded; any number is exact.
4. A key's nodes are held against one of them first (a star, not all pairs).
   The links give components; then only the keys that still hold several
   components are joined with themselves, for pairs of different components.

Defined cases: null, empty and blank texts have the fingerprint zero and link
like any other; a null id links with nothing and has a null component; rows
that repeat an id are one document that links through any of its texts; an
empty table gives no rows; other columns are ignored.  A text of any length is
read whole, its shingles are counted ``CHUNK`` at a time.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tillroll.llm.arrow import pieces, utf8
from tillroll.llm.components import components
from tillroll.llm.tables import drop, written

#: Reference fingerprints; eight distances are packed in one long.
PIVOTS = 16
#: Shingles whose hashes are counted together.
CHUNK = 1 << 16
#: Chance meetings of a node that a choice of blocks may lead to.
MEETINGS = 64
SEED = 42


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (rows of eight bytes) have each bit, first bit
    first.  255 rows are added with eight counters in each 64-bit word."""
    whole = len(hashes) // 255 * 255
    planes = np.unpackbits(hashes, axis=1)
    sums = planes[:whole].reshape(-1, 255, 64).view(np.uint64).sum(axis=1, dtype=np.uint64).view(np.uint8)
    return sums.sum(axis=0, dtype=np.int64) + planes[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, k: int) -> bytes:
    """The eight bytes of a text's fingerprint, highest bit first."""
    words = text.lower().split()  # A-Z only, and ASCII white space
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    last = min(k, len(words)) - 1
    n = len(words) - last
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        here = zip(start[i : min(n, i + CHUNK)].tolist(), end[i + last : i + last + CHUNK].tolist(), strict=False)
        digests = b"".join(map(xxh64_digest, [joined[a:b] for a, b in here], repeat(SEED)))
        counts += bit_counts(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8))
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, fp`` of every row, the fingerprint as a signed long."""

    def rows(batches):
        for batch in pieces(batches, 1):
            found = b"".join(fingerprint(t, k) for t in utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, dtype=">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long")


# ------------------------------------------------------------------ pivots


def choose_pivots(nodes: DataFrame) -> list[int]:
    """Reference fingerprints: those of the smallest hashes.  The choice has no
    influence on the result."""
    return [r["fp"] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(PIVOTS).select("fp").collect()]


def distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(b if isinstance(b, Column) else F.lit(b)))


def with_table(nodes: DataFrame, pivots: list[int]) -> DataFrame:
    """The nodes with their distances to the references, a byte each."""
    packed = []
    for word in range(PIVOTS // 8):
        column = F.lit(0).cast("long")
        for i, pivot in enumerate(pivots[8 * word : 8 * word + 8]):
            column = column.bitwiseOR(F.shiftleft(distance(F.col("fp"), pivot).cast("long"), 8 * i))
        packed.append(column.alias(f"d{word}"))
    return nodes.select("*", *packed)


def near_in_table(a: str, b: str, bits: int, pivots: int) -> Column:
    """Whether no coordinate of two nodes' tables differs by more than ``bits``."""
    out = F.lit(True)
    for i in range(pivots):
        one, two = (F.shiftright(F.col(f"d{i // 8}{x}"), 8 * (i % 8)).bitwiseAND(F.lit(255)) for x in (a, b))
        out = out & F.abs(one - two).between(0, bits)
    return out


# ------------------------------------------------------------------ meeting


def block_masks(blocks: int, alike: int) -> list[int]:
    """For every choice of ``alike`` blocks the bits they cover, as signed longs."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    masks = [sum(one[i] for i in chosen) for chosen in combinations(range(blocks), alike)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, bits: int) -> int:
    """The least number of blocks (two alike at least) that keeps the chance
    meetings of one of ``n`` nodes within ``MEETINGS``."""
    blocks = bits + 2
    while blocks < 3 * bits and comb(blocks, bits) * n > MEETINGS * 2 ** (64 * (blocks - bits) // blocks):
        blocks += 1
    return blocks


def entries(nodes: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))
    return nodes.select("*", F.posexplode(keys).alias("choice", "key"))


def linked(bits: int, pivots: int) -> Column:
    return near_in_table("a", "b", bits, pivots) & (distance(F.col("fpa"), F.col("fpb")) <= bits)


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select("choice", "key", *(F.col(c).alias(c + x) for c in df.columns if c not in ("choice", "key")))


def simhash_components(docs: DataFrame, k: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``."""
    found = written(fingerprints(docs, k), "fingerprints")
    there = found.where("doc_id is not null")
    nodes = written(there.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    pivots = choose_pivots(nodes)
    table = written(with_table(nodes, pivots), "pivot-table")
    masks = block_masks(blocks := blocks_for(table.count(), bits), blocks - bits)
    close = linked(bits, len(pivots))

    # an id that has several fingerprints links their nodes
    prints = there.distinct()
    several = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("prints")).where("prints > 1").select("doc_id")
    repeats = prints.join(several, "doc_id").join(nodes, "fp").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    met = entries(table, masks)
    centres = met.groupBy("choice", "key").agg(F.min(F.struct("fp", "node", "d0", "d1")).alias("c"), F.count(F.lit(1)).alias("n"))
    centres = centres.where("n > 1").select("choice", "key", *(F.col(f"c.{c}").alias(f"{c}b") for c in ("fp", "node", "d0", "d1")))
    star = _side(met, "a").join(centres, ["choice", "key"]).where((F.col("fpa") != F.col("fpb")) & close)
    first = written(star.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct().union(repeats), "star-links")

    labels = components(first)
    named = table.join(labels, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
    met = entries(written(named, "named"), masks)
    mixed = met.groupBy("choice", "key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("choice", "key")
    met = written(met.join(mixed, ["choice", "key"]), "mixed-keys")
    pairs = _side(met, "a").join(_side(met, "b"), ["choice", "key"]).where((F.col("fpa") < F.col("fpb")) & (F.col("ofa") != F.col("ofb")) & close)
    rest = written(pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct(), "cross-links")
    drop(met)
    if not rest.isEmpty():
        labels = components(written(first.union(rest), "links"))

    classes = written(nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component")), "classes")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return found.join(classes, "fp", "left").select("doc_id", "fp", component.alias("component_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
