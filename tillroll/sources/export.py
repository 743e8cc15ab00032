"""Sinks: CSV and parquet views for BI tools, bounded samples, previews.

``write_views`` writes each non-empty view as parquet under one folder and
returns a manifest (view, rows) read back from the written files.  View names
are cut to 31 characters (the sheet-name limit the reference works around).
The output folder must be shared by the cluster: by default it is created
beside the session's checkpoint folder (``tillroll.export.dir`` overrides).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import remove_folder, scratch_path

MAX_VIEW_NAME = 31
SAMPLE_ROWS = 10000
PREVIEW_ROWS = 5


def total_order(df: DataFrame) -> list:
    """All columns, ascending: a total order on distinct rows."""
    return [F.col(c).asc_nulls_first() for c in df.columns]


def bounded_sample(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """First ``n`` rows in a total order (``head(n)``).

    A top-k plan; for large ``n`` the candidates are prefiltered on the
    leading column so the final merge stays near ``2 n`` rows
    (``ranking.top_k``).
    """
    from tillroll.functions.ranking import top_k

    return top_k(df, n, total_order(df), lead=df.columns[0])


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    return bounded_sample(df, n)


def short_names(names: list[str], limit: int = MAX_VIEW_NAME) -> dict[str, str]:
    """Each view's name cut to the limit; of views whose cut names clash, all
    but the first get a number instead of their last characters."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for name in names:
        short, n = name[:limit], 1
        while short.lower() in taken:
            n += 1
            short = f"{name[: limit - len(str(n)) - 1]}_{n}"
        taken.add(short.lower())
        out[name] = short
    return out


def write_views(spark: SparkSession, views: dict[str, DataFrame], base: str | None = None,
                parallelism: int = 4, partition_by: dict[str, list[str]] | None = None) -> DataFrame:
    """Write every non-empty view as parquet; manifest (view_name, rows, path).

    Each view is evaluated once: it is written, its rows are counted from the
    files, and the folder of an empty one is removed.  The views are
    independent, so their jobs are submitted concurrently from a small driver
    thread pool.  ``partition_by`` names partition columns per view (directory
    partitioning, so later reads that filter on them skip whole folders); the
    rows are rebalanced on them first, so that a folder has few files.
    """
    partition_by = partition_by or {}
    from concurrent.futures import ThreadPoolExecutor

    base = base or scratch_path(spark, "views")
    short = short_names(list(views))

    def write(item):
        name, df = item
        path = os.path.join(base, short[name])
        columns = partition_by.get(name)
        writer = (df.hint("rebalance", *columns) if columns else df).write.mode("overwrite")
        if columns:
            writer = writer.partitionBy(*columns)
        writer.parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        if rows:
            return (short[name], rows, path)
        remove_folder(spark, path)
        return None

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = [r for r in pool.map(write, views.items()) if r is not None]
    schema = T.StructType([
        T.StructField("view_name", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("path", T.StringType()),
    ])
    return spark.createDataFrame(rows, schema)


def scratch_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet in a scratch folder and read back, for
    frames of many rows that several jobs read: compressed, and each reads only
    its columns."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def csv_roundtrip(spark: SparkSession, df: DataFrame, base: str | None = None) -> DataFrame:
    """Write ``df`` as CSV with a header (no index), read it back with its schema."""
    path = base or scratch_path(spark, "csv")
    df.write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema(df.schema).option("header", True).csv(path)
