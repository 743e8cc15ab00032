"""Packing and token record files: exact round trips and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import SF001, no_docs, odd_docs  # noqa: F401
from tillroll.llm import packing, queries, token_records

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library_ids(path, texts, end):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return [np.array([*e.ids, end], dtype="<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=14))
def test_plan_uses_every_piece_once_within_capacity(histogram):
    plan = packing.packing_plan(histogram, 24)
    used = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(length * m for length, m in pattern) <= 24
        for length, m in pattern:
            used[length] += m * n
    assert used == Counter(histogram)


@pytest.mark.parametrize(
    "histogram",
    [{24: 5}, {20: 3, 4: 3}, {15: 7, 9: 7}, {14: 4, 7: 4, 3: 4}, {13: 2, 5: 2, 4: 2, 2: 2}, {12: 10}, {8: 9}],
)
def test_exact_complements_leave_no_gap(histogram):
    plan = packing.packing_plan(histogram, 24)
    assert sum(n for _, n in plan) * 24 == sum(length * n for length, n in histogram.items())


def test_plan_size_does_not_follow_the_counts():
    few = {length: 3 + length % 5 for length in range(1, 400)}
    many = {length: n * 1_000_003 for length, n in few.items()}
    a, b = (packing.packing_plan(h, 400) for h in (few, many))
    assert len(b) < 3 * len(a) + 400
    total = sum(length * n for length, n in many.items())
    assert sum(n for _, n in b) <= 1.01 * total / 400 + 400


def check_packed(rows, capacity=4096):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    want = set()
    for d, ids in zip(docs, library_ids(WORD, [d.text for d in docs], 1), strict=True):
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.add((d.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    rows = queries.QUERIES["op1_best_fit_packing"](spark, SF001).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    total = sum(r.length for r in rows)
    assert check_packed(rows) <= -(-total // 4096) + 1


def test_packing_of_odd_rows(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)  # the joined way
    rows = packing.pack_documents(odd_docs, WORD).collect()
    check_packed(rows)
    assert sum(r.doc_id is None for r in rows) == 2
    assert [r.length for r in rows if r.doc_id == 2] == [1]
    assert sorted(r.piece for r in rows if r.doc_id == 6) == list(range(8))
    assert packing.pack_documents(no_docs, WORD).collect() == []


def test_hot_length_is_ranked_in_salted_buckets(spark):
    pieces = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 5 + 1).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"),
    )
    got = packing.ranked(pieces, 3000).groupBy("length").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("rank")).collect()
    for _, low, high, distinct, n in got:
        assert (low, high, distinct) == (0, n - 1, n)
    check_packed(packing.pack(pieces, 16).collect(), 16)


# ------------------------------------------------------------------ records


def test_records_query_round_trip(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for d, ids in zip(docs, library_ids(BYTE, [d.text for d in docs], 0), strict=True):
        want.append((d.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    rows = queries.QUERIES["op5_token_records"](spark, SF001).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == want
    for r in rows[::37]:  # shuffled reads by the index
        doc, ids = token_records.record_at(spark, r.file, r.offset, r.size)
        assert doc == r.doc_id and len(ids) == r.n_tokens and zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r.ids_crc32


def test_several_files_a_task_keep_the_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_records, "BLOCK_BYTES", 200)
    monkeypatch.setattr(token_records, "BLOCKS_PER_FILE", 1)
    docs = spark.range(60).select((59 - F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = token_records.encode_to_records(docs, BYTE, path=str(tmp_path / "r")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(60))
    assert len({r.file for r in rows}) >= 9
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 65535), max_size=6)), max_size=5), st.booleans())
def test_frames_round_trip_and_reject_damage(rows, narrow):
    packed = [(d, np.array(x, dtype="<u4").tobytes()) for d, x in rows]
    data = b"".join(token_records.framed(token_records.serialized(d, x, narrow)) for d, x in packed)
    assert [token_records.parsed(p) for _, _, p in token_records.frames(data)] == packed
    for i in range(0, len(data), 5):
        hurt = data[:i] + bytes([data[i] ^ 64]) + data[i + 1 :]
        with pytest.raises(ValueError):
            list(token_records.frames(hurt))
    if data:
        with pytest.raises(ValueError):
            list(token_records.frames(data[:-1]))


def test_records_of_odd_rows(odd_docs, no_docs):
    rows = token_records.encode_to_records(odd_docs, BYTE).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, -9, 1, 2, 3, 4, 5, 5, 6, 7, 8, 8]
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert sum(r.n_tokens for r in rows) == rows[-1].start + rows[-1].n_tokens
    assert token_records.encode_to_records(no_docs, BYTE).collect() == []


def test_ids_that_do_not_fit_are_refused():
    wide = np.array([5, 70_000], dtype="<u4").tobytes()
    with pytest.raises(OverflowError, match="70000"):
        token_records.serialized(1, wide, True)
    assert token_records.parsed(token_records.serialized(1, wide, False)) == (1, wide)
    assert token_records.fits_two_bytes(BYTE, 0) and not token_records.fits_two_bytes(BYTE, 70_000)


def test_rows_of_one_id_are_spread(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where partitions are large
    docs = spark.range(400).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = token_records.encode_to_records(docs, BYTE, path=str(tmp_path / "r")).orderBy("start").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 400 and len({r.file for r in rows}) > 1
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])
