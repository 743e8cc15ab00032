"""Exact dedup, n-gram join and components against brute force."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cases import SF001, docs_of, no_docs, odd_docs  # noqa: F401
from tillroll.llm import components, exact_dedup, ngram_join, oracle, queries
from tillroll.llm.tables import written

SPACE = re.compile(r"[\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def test_exact_dedup_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    got = queries.QUERIES["op7_exact_dedup"](spark, SF001)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle.SQL['op7_exact_dedup']})").fetchall()
    assert sorted(want) == sorted(map(tuple, got.collect()))


def test_exact_dedup_of_repeated_rows_equals_sql(spark):
    docs = docs_of(spark, [(1, "a b"), (1, "a b"), (2, "a  b"), (None, "a b"), (None, None), (None, ""), (3, "c"), (3, "d")])
    got = exact_dedup.exact_dedup(docs)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.execute("CREATE VIEW typed AS SELECT doc_id::BIGINT AS doc_id, text FROM documents")
    sql = oracle.SQL["op7_exact_dedup"].replace("FROM documents", "FROM typed")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(want, key=str) == sorted(map(tuple, got.collect()), key=str)
    assert {r.doc_id: r.group_size for r in got.collect()}[2] == 4


def weak(text):
    return F.pmod(F.length(text), F.lit(3))


@pytest.mark.parametrize("digest", [exact_dedup.md5_128, weak])
def test_texts_that_share_a_hash_stay_apart(spark, digest):
    rows = [(i, f"text {i % 7}" if i % 3 else f"text   {i % 7}") for i in range(60)] + [(100 + i, None) for i in range(3)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    want = sorted((i, min(g), len(g), i == min(g)) for g in groups.values() for i in g)
    got = exact_dedup.exact_dedup(docs_of(spark, rows), digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_exact_dedup_of_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(odd_docs).collect()}
    by_id = defaultdict(list)
    for (i, _), r in got.items():
        by_id[i].append(r)
    assert [(r.keep_id, r.group_size) for r in by_id[5]] == [(-9, 5)]
    assert {(r.keep_id, r.group_size) for i in (2, 3) for r in by_id[i]} == {(2, 3)}
    assert [r.keep_id for r in by_id[4]] == [4]  # one space is not empty
    assert sorted((r.keep_id, r.kept) for r in by_id[None]) == [(-9, False), (2, False)]
    assert len(by_id[8]) == 2 and all(r.kept for r in by_id[8])
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [-9, 2, 4, 6, 7, 8, 8]
    assert exact_dedup.exact_dedup(no_docs).collect() == []


# ------------------------------------------------------------------ near copies


def brute(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = [x for x in SPACE.split((t or "").translate(FOLD)) if x]
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        met = defaultdict(int)
        for x in s:
            for e in holders[x]:
                met[e] += 1
            holders[x].append(d)
        for e, common in met.items():
            if 100 * common >= percent * (len(s) + len(sets[e]) - common):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {(d, len(s), find(d)) for d, s in sets.items()}


def found(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def test_ngram_join_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert found(queries.QUERIES["op3_ngram_jaccard_join"](spark, SF001)) == brute(rows, 4, 85)


def family(seed, n=160):
    """Near copies with more and more edits, texts that share a long passage,
    short texts, chains whose ends differ, copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(70)]
    rows = []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind <= 1:  # near copies: some within, some just outside
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = word()
            w = w[: len(w) - rng.randrange(12)]
        elif kind == 2:
            w = passage + [word() for _ in range(rng.randrange(5, 60))]
        elif kind == 3:
            w = [rng.choice("abc") for _ in range(rng.randrange(7))]
        elif kind == 4:
            w = rows[rng.randrange(len(rows))][1].upper().split() if rows else ["x"]
            w = w + ([word()] if rng.random() < 0.5 else [])
        else:  # a chain: every step is near the one before
            w = [f"c{i}" for i in range(len(rows) // 6 * 3, len(rows) // 6 * 3 + 100)]
        rows.append((len(rows) * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 4, 85)])
def test_ngram_join_of_families_against_brute_force(spark, seed, k, percent, monkeypatch):
    if seed == 4:  # every side joined instead of broadcast, no frequent shingles
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    rows = family(seed)
    assert found(ngram_join.ngram_jaccard_join(docs_of(spark, rows), k, percent)) == brute(rows, k, percent)


def test_prefix_bound_holds_for_linked_sets():
    rng = random.Random(5)
    for _ in range(3000):
        percent = rng.choice([60, 80, 85, 95])
        a = set(rng.sample(range(60), rng.randrange(1, 50)))
        b = set(a)
        for _ in range(rng.randrange(6)):
            b ^= {rng.randrange(60)}
        common = len(a & b)
        if not b or 100 * common < percent * len(a | b):
            continue
        pa, pb = (set(sorted(x)[: ngram_join.prefix_length(len(x), percent)]) for x in (a, b))
        n, m = len(a), len(b)
        overlap = -(-(n + m) * percent // (100 + percent))
        assert 100 * min(n, m) >= percent * max(n, m)
        assert len(pa & pb) >= max(1, overlap - ngram_join.needed(max(n, m), percent) + 1)


def test_ngram_join_of_odd_rows(odd_docs, no_docs):
    got = found(ngram_join.ngram_jaccard_join(odd_docs, 4, 85))
    assert {(1, 4, -9), (5, 4, -9), (-9, 4, -9), (2, 0, 2), (3, 0, 3), (4, 0, 4), (7, 1, 7), (6, 1, 6)} <= got
    assert {(None, 4, None), (None, 0, None)} <= got
    assert {c for d, _, c in got if d == 8} == {8}
    assert ngram_join.ngram_jaccard_join(no_docs, 4, 85).collect() == []


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(201, 200), (202, 201)]
    random.Random(1).shuffle(edges)
    df = written(spark.createDataFrame([(max(e), min(e)) if e[0] % 2 else e for e in edges], "a long, b long"), "e")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 203)}}
