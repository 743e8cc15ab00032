"""Word hashes, token ids and token counts against plain Python."""

import os
import re
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import SF001, no_docs, odd_docs  # noqa: F401
from tillroll.llm import encoding, memo, queries, wordpiece_count, words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SPACE = re.compile(r"[\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ALPHABET = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0aAbZ'stremvld1²½.,-!ªµßÿĀİſKé́ 　中😀ŉΣς<|>_")
texts = st.lists(st.sampled_from(ALPHABET + ["<|endoftext|>", "'s", "  ", "\n\n", "the "]), max_size=14).map("".join)


def split(text):
    return [w for w in SPACE.split(text.translate(FOLD)) if w]


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=5))
def test_word_hashes_agree_with_words(several):
    for text, batched in zip(several, words.word_hash_lists(several), strict=True):
        plain, hashes = split(text), words.word_hashes(text)
        assert len(plain) == len(hashes)
        assert np.array_equal(hashes, batched)
        assert len(set(plain)) == len(set(hashes.tolist()))
    together = [w for t in several for w in split(t)]
    hashed = np.concatenate([words.word_hashes(t) for t in several]) if several else []
    assert len(set(together)) == len(set(zip(together, list(hashed), strict=True)))


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 5))
def test_shingle_sets_have_the_right_size(text, k):
    w = split(text)
    plain = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    assert len(words.shingle_set(text, k)) == len(plain)
    assert np.array_equal(next(words.shingle_sets([text], k)), words.shingle_set(text, k))


def test_null_text_has_no_words():
    assert [len(x) for x in words.shingle_sets([None, "", "a"], 4)] == [0, 0, 1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    enc = encoding.Encoder(public_tokenizers.path(name))

    @settings(max_examples=600, deadline=None)
    @given(texts)
    def same(text):
        assert enc.ids(text) == enc.whole(text)

    same()


def test_encoder_forgets_within_its_bound(monkeypatch):
    monkeypatch.setattr(memo, "BYTES", 4000)
    enc = encoding.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"w{i}" for i in range(100)) + " " + " ".join(f"w{i}" for i in range(100))
    assert enc.ids(text) == enc.whole(text)
    assert len(enc.of_piece) <= 10 and len(enc.of_piece.older) <= 10


def test_memo_is_bounded_in_bytes():
    made = []
    known = memo.Memo(lambda key: made.append(key) or key.encode())
    for i in range(200_000):  # words without white space, as in Chinese text
        assert known[chr(0x4E00 + i % 20_000) * 40 + str(i)]
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for d in (known, known.older) for k, v in d.items())
    assert held + sys.getsizeof(known) + sys.getsizeof(known.older) < 2 * memo.BYTES
    long = "x" * 1000
    assert known[long] == known[long] == long.encode() and made.count(long) == 2


def test_long_texts_hash_as_short_ones_do():
    rng = np.random.RandomState(3)
    parts = ["w" * n for n in (1, 5, 300_000, 131_071, 131_072, 131_073)] + [str(x) for x in rng.randint(0, 1 << 40, 60_000)]
    text = " ".join(parts[i] for i in rng.permutation(len(parts)))
    got = words.word_hashes(text)
    for w, h in list(zip(text.split(), got, strict=True))[:500]:
        assert words.word_hashes(w)[0] == h
    by_word = dict(zip(text.split(), got.tolist(), strict=True))
    for w in parts[:6]:
        # the definition, byte by byte
        total = sum(int(words._CODE[b]) * pow(words.BASE, i, 1 << 64) for i, b in enumerate(w.encode()[:300])) if len(w) <= 300 else None
        if total is not None:
            assert by_word[w] == int(words.mix(np.array([(total + len(w)) % (1 << 64)], dtype=np.uint64))[0])
        assert by_word[w] == int(words.word_hashes(f"a {w} b")[1])


def test_a_text_of_50_mb_takes_little_memory():
    """In a process of its own: nothing is kept after the text, and the peak is
    a few times the text."""
    said = """
import resource, sys
from tillroll.llm import words
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = " ".join(f"word{i}" for i in range(4_500_000))
assert len(text) > 45_000_000
n = len(words.shingle_set(text, 5))
peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(n, (peak - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", said], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()
    assert int(out[0]) == 4_500_000 - 4 and int(out[1]) < 1000


def greedy(entries, data):
    longest, at, n = max(map(len, entries)), 0, 0
    while at < len(data):
        at += next(k for k in range(min(longest, len(data) - at), 0, -1) if data[at : at + k] in entries)
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.binary(max_size=20))
def test_automaton_counts_greedy_pieces(entries, data):
    data = bytes(x % 3 + 97 for x in data)
    known = {*entries, *(bytes([b]) for b in range(256))}
    assert wordpiece_count.Automaton(entries).pieces(data) == greedy(known, data)


def test_token_counts_query(spark):
    entries = {*wordpiece_count.vocabulary(public_tokenizers.path("byte_bpe_50k.json")), *(bytes([b]) for b in range(256))}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    found = queries.QUERIES["op10_token_counts"](spark, SF001).collect()
    assert len(found) == len(docs)
    cache = {}
    for r in found[:60]:
        listed = [w for w in SPACE.split(docs[r.doc_id]) if w]
        for w in listed:
            if w not in cache:
                cache[w] = greedy(entries, b" " + w.encode())
        assert (r.n_words, r.n_tokens) == (len(listed), sum(cache[w] for w in listed))


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [(r.doc_id, r.n_words) for r in wordpiece_count.token_counts(odd_docs, path).collect()]
    assert len(got) == 13 and got.count((2, 0)) == 1 and (6, 30000) in got and (None, 0) in got
    assert wordpiece_count.token_counts(no_docs, path).collect() == []
