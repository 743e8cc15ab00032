"""Benchmark decontamination by latent semantic retrieval.

1. Words are runs of letters and digits, ASCII case folded.  The vocabulary is
   the benchmark's; its document frequencies are counted over all documents.
2. Benchmark items are cut into passages of ``WINDOW`` words, weighted by
   TF-IDF; a randomised SVD over their distributed rows (each task returns the
   partial product of its rows, summed by feature block) gives the latent space.
3. Every document is cut into windows of ``WINDOW`` words, half overlapping.  A
   window's latent vector is held against all passages: candidates have a
   cosine of ``COSINE`` or more and carry at least that share of the passage.
4. Where a candidate would place the item, the longest common subsequence of
   words decides: ``SURE`` of the item's words in order, or ``LIKELY`` of them
   if the item's answer (its last words) is there too, as in a paraphrase.

Documents are only scanned, never shuffled.  Items go in blocks of
``ITEM_BLOCK``, so what is broadcast is bounded.

Defined cases: null or empty texts match nothing; items without words match
nothing; items of under ``SHORT`` words must be there whole; rows that repeat
an id give their own rows; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.arrow import pieces
from tillroll.llm.tables import written
from tillroll.llm.words import PUNCTUATED, distinct, word_hash_lists

WINDOW = 32
STRIDE = WINDOW // 2
COSINE = 0.5
SURE, LIKELY, ANSWER = 0.8, 0.55, 0.6
SHORT = 8
RANK = 64
ITEM_BLOCK = 2_000
_FEATURES = 512

RESULT = "doc_id long, item_id long, cosine double, lcs double, answer double, start_word long"


def _words(texts):
    return word_hash_lists(texts, PUNCTUATED)


def _index(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in the vocabulary, -1 outside."""
    if not len(vocabulary):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word is, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        seen, n = np.zeros(len(known) + 1, dtype=np.int64), 0
        for batch in pieces(batches, 0):
            for words in _words(batch.column(0).to_pylist()):
                at = distinct(_index(known, words))
                seen[at[at >= 0]] += 1
                n += 1
        seen[-1] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def passages_of(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(first word, words) of an item's passages; the last one ends with it."""
    last = max(0, len(words) - WINDOW)
    starts = sorted({*range(0, last, STRIDE), last})
    return [(s, words[s : s + WINDOW]) for s in starts]


def latent_space(benchmark: DataFrame, vocabulary: np.ndarray, weight: np.ndarray, rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' TF-IDF rows, by a
    randomised SVD whose products are made where the rows lie."""
    spark = benchmark.sparkSession
    width = min(len(vocabulary), rank + 16)
    known = spark.sparkContext.broadcast((vocabulary, weight))

    def product(basis: np.ndarray) -> np.ndarray:
        """transpose(A) A basis, for the rows A of all tasks."""
        shared = spark.sparkContext.broadcast(basis)

        def partial(batches):
            words_known, w = known.value
            q, out = shared.value, np.zeros_like(shared.value)
            for batch in batches:
                for words in _words(batch.column(0).to_pylist()):
                    for _, part in passages_of(words):
                        at, n = np.unique(_index(words_known, part), return_counts=True)
                        at, n = at[at >= 0], n[at >= 0]
                        row = n * w[at]
                        row = row / (np.linalg.norm(row) or 1.0)
                        out[at] += np.outer(row, row @ q[at])
            for i in range(0, len(out), _FEATURES):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([out[i : i + _FEATURES].tobytes()])], ["block", "part"])

        def added(key, rows):
            parts = [np.frombuffer(x.as_py()) for x in rows.column("part")]
            return pa.table({"block": pa.array([key[0].as_py()]), "part": pa.array([np.sum(parts, axis=0).tobytes()])})

        schema = "block long, part binary"
        rows = benchmark.select("text").mapInArrow(partial, schema).groupBy("block").applyInArrow(added, schema).collect()
        out = np.zeros_like(basis)
        for r in rows:
            part = np.frombuffer(r["part"]).reshape(-1, basis.shape[1])
            out[r["block"] : r["block"] + len(part)] = part
        shared.destroy()
        return out

    basis = np.random.RandomState(7).standard_normal((len(vocabulary), width))
    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    known.destroy()
    best = np.argsort(value)[::-1][:rank]
    return basis @ vector[:, best[value[best] > 1e-9]]


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(item)) - 1
    for w in words:
        hit = row & places.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def judge(item: list[int], near: list[int]) -> tuple[float, float, bool]:
    """Share of the item's words in order, of its answer's, and the verdict."""
    tail = item[-max(3, len(item) // 5) :]
    lcs = common_subsequence(item, near) / len(item)
    answer = common_subsequence(tail, near) / len(tail)
    if len(item) < SHORT:
        return lcs, answer, lcs == 1.0
    return lcs, answer, lcs >= SURE or (lcs >= LIKELY and answer >= ANSWER)


def _search(docs: DataFrame, items: list[tuple[int, np.ndarray]], benchmark: DataFrame) -> DataFrame:
    """Leaks of one block of items."""
    spark = docs.sparkSession
    vocabulary = distinct(np.concatenate([w for _, w in items]))
    seen, n = document_frequencies(docs, vocabulary)
    weight = np.log((1 + n) / (1 + seen)) + 0.01
    vectors = latent_space(benchmark, vocabulary, weight)
    table = (weight[:, None] * vectors).astype(np.float32)
    owner, first, rows = [], [], []
    for k, (_, words) in enumerate(items):
        for start, part in passages_of(words):
            owner.append(k)
            first.append(start)
            rows.append(table[_index(vocabulary, part)].sum(axis=0))
    passage = np.array(rows)
    length = np.maximum(np.linalg.norm(passage, axis=1), 1e-9)
    shared = spark.sparkContext.broadcast((items, vocabulary, table, np.array(owner), np.array(first), passage / length[:, None], length))

    def leaks(batches):
        known_items, known, project, own, at_word, unit, norm = shared.value
        listed = [w.tolist() for _, w in known_items]
        for batch in pieces(batches, 1):
            found: list[tuple] = []
            for doc, words in zip(batch.column(0).to_pylist(), _words(batch.column(1).to_pylist()), strict=True):
                best: dict[int, tuple] = {}
                for window, p, cosine in _candidates(words, known, project, unit, norm):
                    k = int(own[p])
                    item = listed[k]
                    begin = window * STRIDE - int(at_word[p])
                    slack = STRIDE + len(item) // 4
                    low = max(0, begin - slack)
                    lcs, answer, leak = judge(item, words[low : begin + len(item) + slack].tolist())
                    if leak and (k not in best or lcs > best[k][3]):
                        best[k] = (doc, known_items[k][0], cosine, lcs, answer, max(0, begin))
                found += best.values()
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            names = ["doc_id", "item_id", "cosine", "lcs", "answer", "start_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(leaks, RESULT), "leaks")
    shared.destroy()
    return found


def _candidates(words, vocabulary, project, unit, norm):
    """(window, passage, cosine) worth a look in one document."""
    at = _index(vocabulary, words)
    place = np.flatnonzero(at >= 0)
    if not len(place):
        return
    half, begin = np.unique(place // STRIDE, return_index=True)
    sums = np.add.reduceat(project[at[place]], begin, axis=0)
    halves = np.zeros((half[-1] + 2, sums.shape[1]), dtype=np.float32)
    halves[half] = sums
    windows = halves[:-1] + halves[1:]
    size = np.linalg.norm(windows, axis=1)
    worth = np.flatnonzero(size >= COSINE * norm.min())
    if not len(worth):
        return
    score = windows[worth] @ unit.T
    hit, passage = np.nonzero((score >= COSINE * size[worth][:, None]) & (score >= COSINE * norm[None, :]))
    for i, p in zip(hit.tolist(), passage.tolist(), strict=True):
        yield int(worth[i]), p, float(score[i, p] / size[worth[i]])


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaked item of a document: ``doc_id, item_id, cosine, lcs,
    answer, start_word`` (where the item begins or would begin, in words)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-bench.count() // ITEM_BLOCK))
    out = None
    for b in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else bench
        rows = block.collect()  # about ITEM_BLOCK items
        items = [(r["item_id"], w) for r, w in zip(rows, _words([r["text"] for r in rows]), strict=True) if len(w)]
        if items:
            found = _search(docs, items, block)
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], RESULT) if out is None else out
