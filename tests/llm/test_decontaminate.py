"""Decontamination: planted items, paraphrases, recall, clean texts."""

import random

import numpy as np
import pytest

from cases import SF01, docs_of, no_docs, odd_docs  # noqa: F401
from tillroll.llm import decontaminate, queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in "ab")
        assert decontaminate.common_subsequence(a, b) == lcs(a, b)


def test_query_finds_every_planted_item_and_no_other(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if t and x in t}
    got = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op6_decontamination"](spark, SF01).collect()}
    assert len(want) > 10 and set(got) == want


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    common = ["the", "of", "and", "a", "in"]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, say(rng.randrange(12, 70))) for i in range(60)]
    docs, leaks = [], set()
    for d in range(300):
        w = say(rng.randrange(0, 400))
        kind = rng.randrange(5)
        if kind < 3:
            i, item = rng.choice(items)
            part = list(item)
            if kind >= 1:  # a paraphrase: some words changed, left out or put in, the end kept
                body = len(part) - max(3, len(part) // 5)
                for _ in range(body // 6):
                    part[rng.randrange(body)] = rng.choice(vocabulary)
                for _ in range(body // 10):
                    part.insert(rng.randrange(body), rng.choice(vocabulary))
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
            leaks.add((d, i))
        docs.append((d, " ".join(x.upper() + "," if rng.random() < 0.1 else x for x in w)))
    return docs, [(i, " ".join(w)) for i, w in items], leaks


@pytest.mark.parametrize("blocks", [1, 3])
def test_recall_of_paraphrases(spark, cases, blocks, monkeypatch):
    docs, items, leaks = cases
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 20)
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & leaks) >= 0.95 * len(leaks)
    assert got <= leaks


def test_candidate_search_against_brute_force(cases):
    """Of the windows that brute force accepts, retrieval finds at least 0.9."""
    docs, items, leaks = cases
    listed = list(decontaminate._words([t for _, t in items]))
    vocabulary = decontaminate.distinct(np.concatenate(listed))
    texts = list(decontaminate._words([t for _, t in docs]))
    seen = np.zeros(len(vocabulary))
    for t in texts:
        at = decontaminate.distinct(decontaminate._index(vocabulary, t))
        seen[at[at >= 0]] += 1
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(listed):
            if decontaminate.judge(item.tolist(), t.tolist())[2] and len(np.intersect1d(item, t)) > 0.6 * len(set(item.tolist())):
                want.add((d, i))
    assert len(want & leaks) >= 0.9 * len(leaks)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (4, "..."), (None, "one"), (1, "a b c d e f g")], "item_id long, text string")
    got = decontaminate.benchmark_leaks(odd_docs, items).collect()
    assert {r.doc_id for r in got if r.item_id == 1} == {1, 5, -9, None}
    assert {r.doc_id for r in got if r.item_id is None} == {7}
    assert decontaminate.benchmark_leaks(no_docs, items).collect() == []
    assert decontaminate.benchmark_leaks(docs_of(spark, [(1, "x")]), items.limit(0)).collect() == []
