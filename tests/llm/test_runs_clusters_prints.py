"""Periodic runs, K-means in a vantage-point tree and SimHash by pivots."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import SF001, docs_of, no_docs, odd_docs  # noqa: F401
from tillroll.llm import oracle, periodic_runs, queries, simhash_pivots, vp_kmeans
from tillroll.llm.arrow import pieces, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pieces_are_bounded_and_whole():
    texts = ["a" * n for n in (1, 5, 100, 0, 3, 3, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    cut = list(pieces([batch, batch.slice(0, 0)], "text", 6))
    assert [p.num_rows for p in cut] == [2, 1, 3, 2]
    assert [t for p in cut for t in utf8(p.column(1))] == [(t or "").encode() for t in texts]


# ------------------------------------------------------------------ periodic runs


def brute_runs(words, least):
    """Every period in turn, stretch by stretch; of equal stretches the least."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in out.items())


def odd_sequence(r, n):
    kind = r.random()
    if kind < 0.3:
        return [r.choice("abc"[: r.choice([1, 2, 2, 3])]) for _ in range(n)]
    if kind < 0.4:
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    if kind < 0.8:
        out = []
        while len(out) < n:
            out += [r.choice("ab") for _ in range(r.randint(1, 7))] * r.randint(1, 9)
            out = out[: len(out) - r.randint(0, 3)]
        return out[:n]
    out = ([r.choice("abcd") for _ in range(max(1, n // r.randint(2, 6)))] * 8)[:n]
    if out:
        out[r.randrange(len(out))] = "x"
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        texts = [[w.encode() for w in odd_sequence(r, r.choice([0, 1, 5, 13, 30, 80, 200]))] for _ in range(r.randint(1, 5))]
        least = r.choice([12, 12, 2, 4, 5, 7])
        symbols, starts = periodic_runs.symbols_of(texts)
        start, end, period = periodic_runs.runs_of(symbols, least)
        want = [(int(o) + s, q, int(o) + e) for words, o in zip(texts, starts, strict=False) for s, q, e in brute_runs(words, least)]
        assert list(zip(start.tolist(), period.tolist(), end.tolist(), strict=True)) == sorted(want)


def test_wavelet_tree_against_sorting():
    r = np.random.RandomState(3)
    values = r.permutation(1000)[:300]
    tree = periodic_runs.WaveletTree(values, 10)
    left = r.randint(0, 290, 200)
    right = np.minimum(300, left + r.randint(0, 40, 200))
    bound = r.randint(0, 1001, 200)
    got = tree.successor(left, right, bound, 5000)
    assert got.tolist() == [min((v for v in values[a:b].tolist() if v >= c), default=5000) for a, b, c in zip(left, right, bound, strict=True)]


def test_long_periodic_texts_take_linear_work():
    unit = [str(i).encode() for i in range(977)]
    texts = [unit * 200, [b"x"] * 100_000, ([b"a", b"b"] * 500 + [b"a"]) * 100]
    began = time.time()
    symbols, starts = periodic_runs.symbols_of(texts)
    at, period = periodic_runs.candidates(periodic_runs.Factors(symbols), 1)
    start, end, q = periodic_runs.runs_of(symbols)
    assert time.time() - began < 60 and len(at) < 2 * len(symbols)
    assert (starts[0], starts[1] - 1, 977) in set(zip(start.tolist(), end.tolist(), q.tolist(), strict=True))
    assert (starts[1], starts[2] - 1, 1) in set(zip(start.tolist(), end.tolist(), q.tolist(), strict=True))
    assert (starts[2], starts[3] - 1, 1001) in set(zip(start.tolist(), end.tolist(), q.tolist(), strict=True))


def expected_digest(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    dropped = {i for s, q, e in runs for i in range(s + q, e)}
    best = max(runs, key=lambda r: (r[2] - r[0], -r[0], -r[1]), default=None)
    first = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *first, *(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in (lines, kept)))


def test_periodic_runs_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SF001).collect()}
    assert got.keys() == texts.keys()
    checked = [i for i, t in texts.items() if len(WORD.findall(t or "")) < 3000]
    assert len(checked) > 150 and any(got[i][1] for i in checked)
    for i in checked:
        assert got[i] == expected_digest(i, texts[i])


def test_periodic_runs_of_odd_rows(spark, odd_docs, no_docs):
    out = periodic_runs.periodic_runs(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [tuple(x) for x in by_id[6].runs] == [(0, 30000, 1)] and by_id[6].collapsed == "word"
    assert by_id[2].runs == [] and by_id[2].collapsed == "" and by_id[2].n_words == 0
    assert by_id[5].collapsed == "a b c d e f g" and by_id[5].n_words == 7
    digests = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_repeats(odd_docs))).collect()
    want = Counter(expected_digest(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id not in (6, None))
    assert Counter(tuple(r) for r in digests if r.doc_id not in (6, None)) == want
    assert sum(r.doc_id is None for r in digests) == 2
    assert periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_repeats(no_docs))).collect() == []


# ------------------------------------------------------------------ K-means


@pytest.mark.parametrize("k", [1, 2, 3, 8, 40, 150])
def test_tree_search_against_all_distances(k):
    r = np.random.RandomState(k)
    for spread in (3, 50, 1 << 26):
        centroids = r.randint(-spread, spread + 1, (k, 4))
        centroids[r.randint(0, k, k // 3)] = centroids[0]  # points that stand twice
        vectors = np.concatenate([r.randint(-spread, spread + 1, (300, 4)), centroids])
        d = vp_kmeans.squared(vectors[:, None, :], centroids[None, :, :])
        number, best = vp_kmeans.nearest(vectors, centroids, vp_kmeans.build(centroids))
        assert best.tolist() == d.min(axis=1).tolist() and number.tolist() == d.argmin(axis=1).tolist()


def test_tree_search_prunes():
    r = np.random.RandomState(0)
    centroids = r.randint(-1000, 1001, (256, 2))
    tree = vp_kmeans.build(centroids)
    measured = 0

    def counted(x, y, plain=vp_kmeans.squared):
        nonlocal measured
        measured += len(x)
        return plain(x, y)

    vectors = r.randint(-1000, 1001, (200, 2))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(vp_kmeans, "squared", counted)
        vp_kmeans.nearest(vectors, centroids, tree)
    assert measured < 200 * 256 / 4


def test_kmeans_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF001}/embeddings.parquet'")
    got = queries.QUERIES["op12_vp_kmeans"](spark, SF001)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle.SQL['op12_vp_kmeans']})").fetchall()
    assert sorted(want) == sorted(map(tuple, got.collect())) and len({r[1] for r in want}) > 1


def test_kmeans_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, x string, cluster int"
    good = [[float((i * 7 + j * j) % 11 - 5) / 8 for j in range(4)] for i in range(30)]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(3, good[3], "x", 1), (4, good[9], "x", 1), (None, good[0], "x", 1)]
    bad = [None, [], [1.0, 2.0], [1.0, 2.0, None, 4.0], [1.0, float("nan"), 3.0, 4.0], [float("inf"), 0.0, 0.0, 0.0], [0.0] * 5]
    table = spark.createDataFrame(rows + [(100 + i, v, "x", 1) for i, v in enumerate(bad)], schema)
    results = []
    for parts in (1, 5):
        out = vp_kmeans.vp_kmeans(spark, table.repartition(parts), k=5, rounds=3, components=4)
        results.append(sorted(map(tuple, out.collect()), key=str))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    assert sum(r[2] for r in results[0]) == results[0][0][4]
    few = vp_kmeans.vp_kmeans(spark, spark.createDataFrame(rows[:2] * 2, schema), k=8, rounds=2, components=4).collect()
    assert len(few) == 4 and all(r.distance == 0 for r in few)
    assert vp_kmeans.vp_kmeans(spark, table.limit(0), components=4).collect() == []
    with pytest.raises(Exception, match="beyond the range of exact distances: 7"):
        vp_kmeans.vp_kmeans(spark, spark.createDataFrame([(7, [1e30, 0.0], "x", 1)], schema), components=2).collect()


# ------------------------------------------------------------------ SimHash


def test_fingerprints_equal_sparks_own_hash(spark):
    """The majority of each bit over Spark's xxhash64 (seed 42) of the shingles."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Ab", "c", "É", "中", "ab", "xY"]) for _ in range(n)) + "\t" for n in (1, 2, 3, 4, 5, 40, 700)]
    docs = docs_of(spark, list(enumerate([*texts, "", None, " \n"])))
    got = {r.doc_id: r.fp for r in simhash_pivots.fingerprints(docs, 4).collect()}
    rows = []
    for i, t in enumerate(texts):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        n = min(4, len(words))
        rows += [(i, " ".join(words[j : j + n])) for j in range(len(words) - n + 1)]
    hashed = spark.createDataFrame(rows, "i int, s string").select("i", F.xxhash64("s").alias("h")).collect()
    for i in range(len(texts)):
        h = [r.h & (1 << 64) - 1 for r in hashed if r.i == i]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i] & (1 << 64) - 1 == want
    assert [got[i] for i in range(len(texts), len(texts) + 3)] == [0, 0, 0]


def test_counts_of_many_hashes():
    h = np.random.RandomState(1).randint(0, 256, (1000, 8), dtype=np.uint8)
    for n in (0, 1, 254, 255, 256, 1000):
        assert simhash_pivots.bit_counts(h[:n]).tolist() == np.unpackbits(h[:n], axis=1).sum(axis=0).tolist()


def brute_components(rows, bits):
    """Smallest id by repeated minimum over all pairs of fingerprints and over ids."""
    prints = sorted({f for i, f in rows if i is not None})
    near = {f: [g for g in prints if ((f ^ g) & (1 << 64) - 1).bit_count() <= bits] for f in prints}
    label = {f: min(i for i, g in rows if g == f and i is not None) for f in prints}
    of_id = {}
    while True:
        before = dict(label)
        for i, f in rows:
            if i is not None:
                of_id[i] = min(of_id.get(i, i), label[f])
        for f in prints:
            label[f] = min([label[g] for g in near[f]] + [of_id[i] for i, g in rows if g == f and i is not None])
        if label == before:
            return sorted(((i, f, None if i is None else label[f]) for i, f in rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_simhash_components_against_all_pairs(spark, monkeypatch, seed):
    r = random.Random(seed)
    rows = [(0, 0), (1, -1), (None, 0), (5000, 3), (5000, 1 << 40)]
    for family in range(6):  # scattered families: chains of few bits, members far from the first
        base = [r.getrandbits(64)]
        for _ in range(r.choice([3, 40, 120])):
            f = r.choice(base)
            for b in r.sample(range(64), r.choice([1, 3, 4, 5, 6])):
                f ^= 1 << b
            base.append(f)
        rows += [(1000 * family + 10 + i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(base)]
    rows += [(9000 + i, rows[20][1]) for i in range(30)]  # exact copies
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash_pivots, "fingerprints", lambda docs, k: docs)
    got = simhash_pivots.simhash_components(frame, bits=4).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 4)


def test_any_number_of_blocks_meets_all_linked(spark):
    r = random.Random(2)
    a = [r.getrandbits(64) for _ in range(200)]
    b = [x ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for x in a]
    for blocks in (6, 7, 9, 12):
        masks = [m & (1 << 64) - 1 for m in simhash_pivots.block_masks(blocks, blocks - 4)]
        assert all(any(x & m == y & m for m in masks) for x, y in zip(a, b, strict=True))
    assert [simhash_pivots.blocks_for(n, 4) for n in (0, 10**5, 10**8, 10**12)] == sorted(simhash_pivots.blocks_for(n, 4) for n in (0, 10**5, 10**8, 10**12))


def test_pivot_table_never_discards_a_linked_pair(spark):
    r = random.Random(4)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    a = [r.getrandbits(64) for _ in range(300)]
    b = [x ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 9))) for x in a]
    pivots = [signed(r.getrandbits(64)) for _ in range(simhash_pivots.PIVOTS)]
    one = simhash_pivots.with_table(spark.createDataFrame([(i, signed(x)) for i, x in enumerate(a)], "i int, fp long"), pivots)
    two = simhash_pivots.with_table(spark.createDataFrame([(i, signed(x)) for i, x in enumerate(b)], "i int, fp long"), pivots)
    pairs = one.select("i", *(F.col(c).alias(c + "a") for c in ("fp", "d0", "d1"))).join(two.select("i", *(F.col(c).alias(c + "b") for c in ("fp", "d0", "d1"))), "i")
    kept = {x.i for x in pairs.where(simhash_pivots.near_in_table("a", "b", 4, len(pivots))).collect()}
    linked = {i for i, (x, y) in enumerate(zip(a, b, strict=True)) if (x ^ y).bit_count() <= 4}
    seen = {i for i, (x, y) in enumerate(zip(a, b, strict=True)) if all(abs((x ^ p).bit_count() - (y ^ p).bit_count()) <= 4 for p in ((q & (1 << 64) - 1) for q in pivots))}
    assert linked <= kept == seen and len(kept) < 300


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    got = simhash_pivots.digest(simhash_pivots.simhash_components(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (1, 5, -9) for r in by_id[i]} == {-9}
    assert {(r.fingerprint, r.component_id) for i in (2, 3, 4) for r in by_id[i]} == {("0" * 16, 2)}
    assert {r.component_id for r in by_id[None]} == {None} and {r.component_id for r in by_id[8]} == {8}
    assert simhash_pivots.digest(simhash_pivots.simhash_components(no_docs)).collect() == []
