"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity`` ids (only longer ones
are cut) and the pieces are packed whole into sequences.

Only the histogram of piece lengths decides how lengths combine, and it has at
most ``capacity`` rows whatever the size of the corpus, so ``packing_plan``
runs on the driver: longest first, it fills the gap that a length leaves
exactly with one available length, a pair or a triple (looked up by their sum),
uses that combination as often as the counts allow, and places what has no
exact complement by best fit.  Each use of a combination exhausts a length, so
the plan has a few rows per length, not per document.

Pieces find their place without meeting: a piece's rank among the pieces of
its length (counted within small salted buckets) points into the plan.

Defined cases: a null text counts as empty and gives its end id alone; a null
id is carried along; rows that repeat an id give their own pieces; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.arrow import pieces as pieces_of
from tillroll.llm.encoding import encoder
from tillroll.llm.tables import written

#: A salted bucket holds about this many pieces of all lengths.
BUCKET_ROWS = 500_000
#: Offsets of buckets are broadcast up to this many rows, else joined.
BROADCAST_ROWS = 1_000_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        enc = encoder(tokenizer_path)
        for batch in pieces_of(batches, 1):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


# ------------------------------------------------------------------ the plan


def _pair(free: np.ndarray, total: int) -> tuple[int, int] | None:
    """Two available lengths with this sum, as even as possible."""
    half = total // 2
    low = np.arange(half, 0, -1)
    high = total - low
    low, high = low[high < len(free)], high[high < len(free)]
    ok = (free[low] > 0) & (free[high] > 0)
    if total % 2 == 0 and len(ok) and low[0] == high[0]:
        ok[0] = free[half] > 1
    at = np.flatnonzero(ok)
    return (int(low[at[0]]), int(high[at[0]])) if len(at) else None


class _Sums:
    """Which sums single lengths and pairs can make.  Counts only fall, so a
    sum once out of reach stays so; an entry that proves stale is struck out."""

    def __init__(self, free: np.ndarray) -> None:
        self.free = free
        there = (free > 0).astype(np.float64)
        self.pair = np.rint(np.convolve(there, there))[: len(free)] > 0

    def two(self, total: int) -> tuple[int, ...] | None:
        if total < 2 or not self.pair[total]:
            return None
        found = _pair(self.free, total)
        if found is None:
            self.pair[total] = False
        return found

    def three(self, total: int) -> tuple[int, ...] | None:
        if total < 3:
            return None
        first = np.arange(min(total - 2, len(self.free) - 1), 0, -1)
        for a in first[(self.free[first] > 0) & self.pair[total - first]]:
            self.free[a] -= 1
            rest = _pair(self.free, total - int(a))
            self.free[a] += 1
            if rest:
                return (int(a), *rest)
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """Available lengths, three at most, with exactly this sum."""
        if gap < len(self.free) and self.free[gap] > 0:
            return (gap,)
        return self.two(gap) or self.three(gap)


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ``(((length, copies), ...), sequences)`` that use every piece once."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        free[length] = n
    plan: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if free[capacity]:
        plan.append((((capacity, 1),), int(free[capacity])))
        free[capacity] = 0
    sums = _Sums(free)
    for length in range(capacity - 1, 0, -1):
        while free[length] > 0:
            free[length] -= 1
            rest = sums.fill(capacity - length)
            free[length] += 1
            if rest is None:
                break
            uses = Counter((length, *rest))
            times = min(int(free[x]) // m for x, m in uses.items())
            for x, m in uses.items():
                free[x] -= times * m
            plan.append((tuple(sorted(uses.items(), reverse=True)), times))

    bins: dict[int, list] = defaultdict(list)  # gap -> [pattern, sequences]
    gaps: list[int] = []

    def put(pattern: Counter, gap: int, n: int) -> None:
        if gap == 0:
            plan.append((tuple(sorted(pattern.items(), reverse=True)), n))
            return
        if not bins[gap]:
            insort(gaps, gap)
        bins[gap].append((pattern, n))

    for length in range(capacity - 1, 0, -1):
        left = int(free[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no open sequence has room
                each = capacity // length
                if whole := left // each:
                    put(Counter({length: each}), capacity - each * length, whole)
                if left % each:
                    put(Counter({length: left % each}), capacity - left % each * length, 1)
                break
            gap = gaps[at]
            pattern, n = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(at)
            each = min(gap // length, left)
            used = min(n, left // each)
            put(pattern + Counter({length: each}), gap - each * length, used)
            if n > used:
                put(pattern, gap, n - used)
            left -= used * each
    for gap in gaps:
        for pattern, n in bins[gap]:
            plan.append((tuple(sorted(pattern.items(), reverse=True)), n))
    return plan


def _slots(plan: list) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted: the
    pieces of a length fill the patterns that use it in this order."""
    rows, used, sequence = [], Counter(), 0
    for pattern, n in plan:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used[length], sequence, copies, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ------------------------------------------------------------------ placing


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``rank`` (from 0) of each piece among those of its length: the rank in
    its salted bucket plus the sizes of the buckets before it."""
    buckets = rows // BUCKET_ROWS + 16
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    key = ["length", "_bucket"]
    inside = Window.partitionBy(*key).orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = salted.withColumn("_local", F.row_number().over(inside) - 1)
    if buckets * 4096 <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return local.join(offsets, key).withColumn("rank", F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``pieces`` must give the same rows whenever it is read (a written table).
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if bad := [x for x in histogram if x is None or not 0 < x <= capacity]:
        raise ValueError(f"piece lengths must be 1 to {capacity}, found {bad[:5]}")
    slots = _slots(packing_plan(histogram, capacity))
    rows = sum(histogram.values())
    shared = pieces.sparkSession.sparkContext.broadcast(slots)

    def place(batches):
        table = shared.value
        key = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(key, (length << 44) | rank, side="right") - 1]
            at = rank - row[:, 1]
            out = [*batch.columns[:-1], pa.array(row[:, 2] + at // row[:, 3]), pa.array(row[:, 4] + at % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "sequence_id", "offset"])

    names = pieces.columns
    schema = pieces.select(*names).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked(pieces, rows).select(*names, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Every document's pieces with their sequence and place in it."""
    pieces = written(token_pieces(docs, tokenizer_path, end_id, capacity), "token-pieces")
    return pack(pieces, capacity)
