"""Exact duplicates: grouped by a 128-bit content hash, bytes compared.

Two texts are equal when they are identical after every run of ASCII white
space became one space.  Texts meet in a hash aggregation on (hash, text): the
hash decides where a text goes and the text's own bytes decide which class it
joins, so two texts whose hashes collide never share a class.  Equal texts
collapse map-side, so a class that holds a third of all rows costs one row per
task.  Rows learn their class by a join on the hash alone (16 bytes a row);
AQE splits that join where a class is large.

Defined cases: a null text counts as empty; empty texts are equal to one
another; rows that repeat both id and text give one output row and count each
in ``group_size``; a null id never is the kept id unless its whole class has
null ids; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.tables import unused, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``digest`` makes the content hash; results don't depend on it.
    """
    texts = docs.select(F.col("doc_id").alias("_id"), normalised(F.col("text")).alias("_text"))
    texts = texts.withColumn("_hash", digest(F.col("_text")))
    by_text = texts.groupBy("_hash", "_text").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    columns = ["_hash", "keep_id", "group_size", F.sha2("_text", 256).alias("text_sha256")]
    classes = written(by_text.select(*columns), "dedup-classes")
    rows = texts.select("_id", "_hash").distinct()

    shared = classes.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_hash")
    if shared.isEmpty():
        found = rows.join(classes, "_hash")
    else:  # different texts share a hash: there the text itself is the key
        apart = by_text.join(shared, "_hash", "left_semi").select("_text", *columns)
        colliding = texts.join(shared, "_hash", "left_semi").select("_id", "_hash", "_text").distinct()
        found = (
            rows.join(shared, "_hash", "left_anti")
            .join(classes, "_hash")
            .unionByName(colliding.join(apart, ["_hash", "_text"]).drop("_text"))
        )
    return found.select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns; rows repeating id and text once."""
    own = unused(docs, "sha")
    sha = F.sha2(normalised(F.col("text")), 256)
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("said"))
    return (
        docs.withColumn(own, sha)
        .join(kept, docs["doc_id"].eqNullSafe(kept["keep"]) & (F.col(own) == kept["said"]), "left_semi")
        .dropDuplicates(["doc_id", own])
        .drop(own)
    )
