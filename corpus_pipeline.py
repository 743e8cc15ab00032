"""The corpus pipeline: stages over ``documents``, each by one of the dealt
operators.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes what each
stage returns as Parquet in the shared scratch folder and reads it back as the
next one's documents.  All but the last return the columns of ``documents``:

* toxicity: texts that the cumulative-link model finds more likely toxic than
  not go;
* exact dedup: of equal texts the smallest id stays;
* n-gram join: of each group of near duplicates (shingles of five words,
  similarity 0.8) the smallest id stays;
* decontamination: documents that hold a benchmark item go;
* packing: the rest become pieces of sequences of at most 4096 tokens.

Every stage works on whole texts and on all rows its predecessor kept.  Null
texts count as empty and stay (of several, one stays: they are equal texts).
Rows that repeat an id, and rows without one, stay or go as their id and text
do; in the n-gram join they come after all rows that have an id of their own.
Columns of any name are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from tillroll.llm.tables import unused, written

WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = tuple(unused(docs, n) for n in ("severity", "grade", "toxic"))
    return toxicity.severity(docs, labels, names).where(~F.col(names[2])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # an id tells rows apart only where it stands on one; the others get numbers of their own, after all ids
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = written(counts.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("id")), "shared-ids")
    same = docs["doc_id"].eqNullSafe(shared["id"])
    single, number, key = docs, unused(docs, "number"), unused(docs, "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = None
    if not shared.isEmpty():
        most = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
        single = docs.join(shared, same, "left_anti")
        odd = docs.join(shared, same, "left_semi").withColumn(number, F.monotonically_increasing_id() + most + 1)
        odd = written(odd, "numbered")  # numbers are given once
        texts = single.select(F.col("doc_id").cast("long").alias("doc_id"), "text").union(odd.select(number, "text"))
    found = ngram_join.ngram_jaccard_join(texts, WORDS, PERCENT)
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)), "near-copies")
    kept = single.join(gone, F.col("doc_id") == F.col(key), "left_anti")
    if odd is not None:
        kept = kept.unionByName(odd.join(gone, F.col(number) == F.col(key), "left_anti").select(*docs.columns))
    return kept.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # id and text decide, by a 64-bit hash: ids may be null or repeat
    key = unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    texts = keyed.select(F.col(key).alias("doc_id"), "text")
    leaks = written(decontaminate.benchmark_leaks(texts, benchmark).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: A fitted model and latent retrieval decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i + 1}")
    return docs
