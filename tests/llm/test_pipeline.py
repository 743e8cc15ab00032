"""The pipeline's stages against brute force on a planted corpus."""

import os
import random
import subprocess
import sys

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from cases import DOCS, SF001, docs_of, odd_docs  # noqa: F401
from tillroll.llm import queries

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of known kinds: clean, toxic, copies, near copies, leaks."""
    rng = random.Random(21)
    say = lambda n: [rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.3 else f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [" ".join(say(rng.randrange(15, 50))) for _ in range(20)]
    rows, kind = [], {}
    clean: list[list[str]] = []
    for i in range(420):
        pick = rng.choice(["clean", "clean", "clean", "toxic", "copy", "near", "leak", "long"])
        w = say(rng.randrange(60, 160))
        if pick in ("copy", "near") and clean:
            w = list(rng.choice(clean))
            if pick == "near":
                w[rng.randrange(len(w))] = f"edit{i}"
        elif pick == "toxic":
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty", "hateful", "rotten"])
        elif pick == "leak":
            w[20:20] = rng.choice(items).split()
        elif pick == "long":
            w = say(6000)
            pick = "clean"
        elif pick != "clean":
            pick = "clean"
        if pick == "clean":
            clean.append(w)
        glue = "  \n" if pick == "copy" else " "
        rows.append((i, glue.join(w)))
        kind[i] = pick
    rows += [(1000, None), (1001, "")]
    d = str(tmp_path_factory.mktemp("corpus"))
    docs_of(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, int(k == "toxic")) for i, k in kind.items() if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, dict(rows), kind


def test_every_stage_keeps_what_it_should(spark, corpus):
    d, texts, kind = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, there = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns
        rows = docs.collect()
        kept = {r.doc_id for r in rows}
        assert len(rows) == len(kept) and all(r.text == texts[r.doc_id] for r in rows)
        gone = there - kept
        if name == "toxicity":
            assert gone == {i for i, k in kind.items() if k == "toxic"}
        elif name == "exact dedup":
            first = {}
            for i in sorted(there):
                first.setdefault(" ".join((texts[i] or "").split()), i)
            assert kept == set(first.values())
        elif name == "n-gram jaccard join":
            assert gone and {kind[i] for i in gone} <= {"near", "clean"}
            assert not {i for i in kept if kind.get(i) == "near" and len(texts[i].split()) > 80} - near_without_partner(texts, kept)
        else:
            assert gone == {i for i in there if kind.get(i) == "leak"}
        there = kept
        docs = docs.sparkSession.createDataFrame(rows, DOCS)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == there
    run = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, d).collect()}
    assert run == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed}


def near_without_partner(texts, kept):
    """Near copies none of whose partners is left."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in kept if (w := (texts[i] or "").split())}
    linked = lambda a, b: a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    return {a for a in sets if not any(linked(a, b) for b in sets)}


def test_stages_of_odd_rows(spark, odd_docs, corpus):
    d = corpus[0]
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns[:2] == ["doc_id", "text"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} == {-9, 2, 4, 6, 7, 8}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of(spark, [(1, "x")]).limit(0), d).collect() == []


def test_leaks_go_by_id_and_text(spark, corpus):
    d = corpus[0]
    item = spark.read.parquet(f"{d}/benchmark.parquet").first().text
    docs = docs_of(spark, [(None, f"before {item} after"), (None, "clean words"), (1, f"x {item} y"), (1, "a clean text of the same id"), (2, None)])
    got = corpus_pipeline.drop_leaks(spark, docs, d).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, "clean words"), (1, "a clean text of the same id"), (2, None)}


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"]
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_entry_works_without_this_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "tillroll", ".git", "tests"):
            (tmp_path / name).symlink_to(os.path.join(ROOT, name))
    (tmp_path / "tillroll").mkdir()
    for name in os.listdir(os.path.join(ROOT, "tillroll")):
        if name != "llm":
            (tmp_path / "tillroll" / name).symlink_to(os.path.join(ROOT, "tillroll", name))
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    said = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 88 and 'pipeline' not in q and 'op7_exact_dedup' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())
    assert os.path.exists(SF001)


def test_near_copies_go_by_row_not_by_id(spark, corpus):
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["edit"] + base[31:]
    other = [f"v{i}" for i in range(60)]
    third = [f"u{i}" for i in range(60)]
    say = " ".join
    docs = docs_of(spark, [(1, say(base)), (2, say(near)), (2, say(other)), (None, say(base[:59])), (None, say(third)), (5, say(third[:59]))])
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, corpus[0]).collect()}
    # the row of id 2 with the near text goes, the other one stays; rows without an id go like others
    assert got == {(1, say(base)), (2, say(other)), (5, say(third[:59]))}


def test_stages_keep_columns_of_any_name(spark, corpus):
    d = corpus[0]
    names = ["key", "_key", "_toxic", "toxic", "Severity", "_sha0", "sha", "number", "keep", "said", "n", "id"]
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 60 or doc_id >= 1000")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(f"{n} "), F.coalesce("doc_id", F.lit(0)).cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id or 0}" for r in rows for n in names), name
