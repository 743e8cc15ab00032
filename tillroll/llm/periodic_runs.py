"""Maximal periodic runs of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q``, at least
``max(least, 2 * q)`` words long, that no neighbouring word extends.

Texts are laid one after the other, each with an alphabet and an end mark of
its own, so that no match ever leaves a text.  On that sequence:

1. Prefix doubling ranks the factors of 1, 2, 4, ... words and ends in the
   suffix array; only suffixes whose factor still repeats are sorted again.
   Equal ranks tell equal factors, so two positions' common extension is found
   by halving steps in both directions.
2. A run of length ``L`` and period ``q`` holds a dyadic block, ``2**k`` words
   at a multiple of ``2**k``, that occurs again ``q`` words later, with ``L - q
   >= 2**(k+1) - 1`` and ``q < 2**(k+2)``.  Every block looks for its
   occurrences in the window of that size: they are the block's interval of
   the suffix array, and the next one after a position is a range successor,
   which a wavelet tree over the suffix array answers by counting.
3. Occurrences that overlap by half the block or more are an arithmetic
   progression; its difference is the block's own period and it is stepped over
   at once.  Distances to the occurrences are candidate periods.  Of a
   progression in another run of that same period only those can be smallest
   periods of a long enough stretch that bring both runs' starts or ends
   together, or that lie where the two runs touch; so the candidates are
   bounded by the blocks and the runs.
4. Common extension of a block and its occurrence gives a candidate's stretch;
   of candidates with one stretch the smallest is its period.

Memory and time are those of about ``TOGETHER`` bytes of text at a time, or of
one longer text (four bytes a word and level, one level more where the longest
repeat doubles).  Nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no runs; rows that
repeat an id, and rows with a null id, are handled each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.arrow import pieces, utf8

TOGETHER = 1 << 20


# ------------------------------------------------------------------ index


class Factors:
    """Ranks of all factors of ``2**k`` symbols, and the suffix array.

    ``symbols[i]`` names the symbol at ``i``; those at the ends of texts occur
    once.  ``rank[k][i] == rank[k][j]`` where the factors at ``i`` and ``j`` are
    equal; the rank is the first place of the factor's interval in the suffix
    array.  ``repeated[k]`` holds, in suffix order, the positions whose factor
    occurs more than once, ``size[k]`` how often.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        suffixes = np.argsort(symbols, kind="stable")
        places = np.arange(n)
        rank, found, key = np.empty(n, dtype=np.int32), suffixes, symbols[suffixes]
        self.rank, self.repeated, self.size = [], [], []
        width = 1
        while True:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
            sizes = np.diff(np.append(first, len(key)))
            rank[found] = np.repeat(places[first], sizes)
            suffixes[places] = found
            again = np.repeat(sizes > 1, sizes)
            self.rank.append(rank.copy())
            self.repeated.append(found[again])
            self.size.append(np.repeat(sizes, sizes)[again])
            found, places = found[again], places[again]
            if not len(found):
                break
            key = rank[found].astype(np.int64) * n + rank[found + width]
            order = np.argsort(key)
            found, key = found[order], key[order]
            width *= 2
        self.suffixes = suffixes

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that starts at ``x`` and ``y``."""
        n, out = len(self.suffixes), np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            a, b = x + out, y + out
            there = np.maximum(a, b) < n
            same = there & (self.rank[k][np.where(there, a, 0)] == self.rank[k][np.where(there, b, 0)])
            out += same.astype(np.int64) << k
        return out

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that ends before ``x`` and ``y``."""
        out = np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            a, b = x - out - (1 << k), y - out - (1 << k)
            there = np.minimum(a, b) >= 0
            same = there & (self.rank[k][np.where(there, a, 0)] == self.rank[k][np.where(there, b, 0)])
            out += same.astype(np.int64) << k
        return out


class WaveletTree:
    """Order statistics of any stretch of an array, one bit of the values a
    level, highest first."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.zeros = []  # by level: zeros before each place; the last one is all zeros
        for level in range(bits - 1, -1, -1):
            zero = (values >> level & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in ``[left, right)`` are less than ``bound``."""
        out = np.zeros(len(left), dtype=np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            one = (bound >> level & 1) == 1
            l0, r0 = zeros[left], zeros[right]
            out += np.where(one, r0 - l0, 0)
            left = np.where(one, zeros[-1] + left - l0, l0)
            right = np.where(one, zeros[-1] + right - r0, r0)
        return out

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest value (from 0) in ``[left, right)``."""
        out = np.zeros(len(left), dtype=np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            one = k >= r0 - l0
            k = np.where(one, k - (r0 - l0), k)
            out += one.astype(np.int64) << level
            left = np.where(one, zeros[-1] + left - l0, l0)
            right = np.where(one, zeros[-1] + right - r0, r0)
        return out

    def successor(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray, none: int) -> np.ndarray:
        """The smallest value of at least ``bound`` in ``[left, right)``."""
        k = self.below(left, right, bound)
        there = k < right - left
        out = np.full(len(left), none, dtype=np.int64)
        out[there] = self.smallest(left[there], right[there], k[there])
        return out


# ------------------------------------------------------------------ runs


def blocks(index: Factors, lowest: int) -> tuple[np.ndarray, ...]:
    """Position, width, and interval among the ``lowest`` level's repeated
    suffixes of every dyadic block that occurs more than once."""
    member = np.zeros(len(index.suffixes), dtype=bool)
    member[index.repeated[lowest]] = True
    before = np.concatenate([[0], np.cumsum(member[index.suffixes])])
    at, width, left, size = [], [], [], []
    for k in range(lowest, len(index.rank)):
        aligned = index.repeated[k] & ((1 << k) - 1) == 0
        b = index.repeated[k][aligned]
        at.append(b)
        width.append(np.full(len(b), 1 << k, dtype=np.int64))
        left.append(before[index.rank[k][b]])
        size.append(index.size[k][aligned])
    at, width, left, size = (np.concatenate(c) for c in (at, width, left, size))
    return at, width, left, left + size


def candidates(index: Factors, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a position and a candidate period of the run around it."""
    empty = np.empty(0, dtype=np.int64)
    if len(index.repeated) <= lowest or not len(index.repeated[lowest]):
        return empty, empty
    n = len(index.suffixes)
    b, width, left, right = blocks(index, lowest)
    member = np.zeros(n, dtype=bool)
    member[index.repeated[lowest]] = True
    tree = WaveletTree(index.suffixes[member[index.suffixes]], n.bit_length())
    last = b  # the block's last occurrence so far
    out = [(empty, empty)]
    while len(b):
        o = tree.successor(left, right, last + 1, n)
        near = o < np.minimum(b + 4 * width, n)
        b, width, left, right, last, o = (c[near] for c in (b, width, left, right, last, o))
        out.append((b, o - b))
        step = o - last
        new = o.copy()
        many = np.flatnonzero(2 * step <= width)
        if len(many):  # a progression from ``last`` on
            at, w, first, p = b[many], width[many], last[many], step[many]
            end = first + p + index.forward(first, first + p)
            final = first + (end - w - first) // p * p
            new[many] = final
            other = first > at  # not the run that holds the block itself
            at, w, first, p, end, final = (c[other] for c in (at, w, first, p, end, final))
            start = first - index.backward(first, first + p)
            own_end = at + p + index.forward(at, at + p)
            own_start = at - index.backward(at, at + p)
            least, most = first - at, np.minimum(final - at, 4 * w - 1)
            for d in (start - own_start, end - own_end):
                fits = (d >= least) & (d <= most) & ((d - least) % p == 0)
                out.append((at[fits], d[fits]))
            most = np.minimum(np.minimum(most, own_end - own_start), np.minimum((end - own_start) // 2, end - start))
            times = np.where(own_end >= start, np.maximum((most - least) // p + 1, 0), 0)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append((np.repeat(at, times), np.repeat(least, times) + nth * np.repeat(p, times)))
        last = new
    at, period = (np.concatenate([c[i] for c in out]) for i in (0, 1))
    return at, period


def runs_of(symbols: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run, by start, then period."""
    # blocks of a level serve stretches whose length less the period is at least 2 * width - 1
    lowest = max(0, (least - least // 2 + 1).bit_length() - 2)
    index = Factors(symbols)
    at, period = candidates(index, lowest)
    end = at + period + index.forward(at, at + period)
    start = at - index.backward(at, at + period)
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def symbols_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words in one sequence, a word named by the place of its first
    occurrence in its text, an end mark after each text; where each text starts."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    symbols = np.arange(starts[-1])
    for words, start in zip(texts, starts.tolist(), strict=False):
        if words:
            symbols[start : start + len(words)] = list(map({}.setdefault, words, count(start)))
    return symbols, starts


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SCHEMA = f"doc_id long, n_words long, runs {RUNS}, collapsed string"


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs`` (by start, then period)
    and ``collapsed``, the words that no run holds after its first period,
    joined by one space."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.split() for t in utf8(batch.column(1))]
        symbols, starts = symbols_of(texts)
        start, end, period = runs_of(symbols, least)
        drop = np.zeros(len(symbols) + 1, dtype=np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, end, -1)
        kept = np.cumsum(drop)[:-1] == 0
        first = np.searchsorted(start, starts)  # of each text's runs
        collapsed = []
        for i, words in enumerate(texts):
            if first[i] < first[i + 1]:
                words = [words[j] for j in np.flatnonzero(kept[starts[i] : starts[i + 1] - 1]).tolist()]
            collapsed.append(b" ".join(words))
        of = np.repeat(starts[:-1], np.diff(first))
        fields = [pa.array(c.astype(np.int64)) for c in (start - of, end - start, period)]
        runs = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        n = pa.array(np.diff(starts) - 1)
        return pa.RecordBatch.from_arrays([batch.column(0), n, runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def rows(batches):
        for batch in pieces(batches, 1, TOGETHER):
            yield found(batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCHEMA)


# ------------------------------------------------------------------ query


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts (``crc32(doc_id) % 10 = 0``)
    repeat one stretch of words from a place on that the id chooses."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumns({"n": n, "a": F.when(n > 0, F.col("g") % n)})
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    n, a, p = F.col("n").cast("int"), F.col("a").cast("int"), F.col("p")
    often = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), often)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run of each document (ties: smallest start, then period), and
    digests of all its runs and of what is left of the text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.withColumn("r", longest)
    start, length, period = -F.col("r.s"), F.col("r.length"), -F.col("r.p")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * r.length div -r.p").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
