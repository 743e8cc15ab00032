"""Intermediate tables in the shared scratch folder.

``written`` cuts lineage with a Parquet table beside ``spark.checkpoint.dir``:
executors can be lost afterwards without recomputing what lies before it.  The
folder is registered for deletion when the application ends; ``drop`` frees it
earlier.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import scratch_path

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = str(8 << 20)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared scratch folder, deleted at the end."""
    path = scratch_path(spark, name)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most ``BATCH_BYTES`` in the jobs started inside, so
    that neither side of a Python stage holds more than a few of that size."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once and read back."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tillroll_path = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again."""
    for df in frames:
        fs, p = _file_system(df.sparkSession, df._tillroll_path)
        fs.delete(p, True)
