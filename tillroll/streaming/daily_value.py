"""Structured Streaming: tumbling one-day value per event type.

``events.ts`` is ``timestamp_ntz``, which ``withWatermark`` refuses, so it is
cast to ``timestamp`` (session time zone UTC).  Append mode emits a window
once the watermark (max event time - delay) passes its end; the last windows
stay open, exactly like a live stream.  The sink is a parquet folder next to
the checkpoint folder and the query runs with ``trigger(availableNow=True)``,
so a finished run is a table that later batch jobs read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import scratch_path

WINDOW = "1 day"
WATERMARK = "1 day"


def _reader(spark: SparkSession, schema, max_files: int | None):
    r = spark.readStream.schema(schema)
    return r.option("maxFilesPerTrigger", max_files) if max_files else r


def _source_folder(spark: SparkSession, source_dir: str, table: str) -> tuple[str, str | None]:
    """Where the stream reads and which files: a table that is a folder of part
    files is read as it is, a single file by its name in the folder above."""
    path = os.path.join(source_dir, table)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return (path, None) if fs.getFileStatus(p).isDirectory() else (source_dir, table)


def daily_value_stream(spark: SparkSession, source_dir: str, file_glob: str = "events.parquet",
                       out: str | None = None, state_partitions: int | None = None,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream to completion and return the emitted (closed) windows.

    ``file_glob`` is a file, a folder of part files, or a file pattern within
    ``source_dir``.  ``state_partitions`` sets the state store's partitions in a
    child session; by default they follow the session's shuffle partitions.
    When no window has closed the result is an empty frame.
    """
    parent = spark
    if state_partitions:
        spark = spark.newSession()
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    if "*" in file_glob:
        folder, pattern = source_dir, file_glob
        schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    else:
        folder, pattern = _source_folder(spark, source_dir, file_glob)
        schema = spark.read.parquet(os.path.join(source_dir, file_glob)).schema
    tz = spark.conf.get("spark.sql.session.timeZone", "UTC")
    # wall-clock event time read as UTC, so one-day windows are calendar days
    # of the recorded wall clock whatever the session time zone is
    event_time = F.from_utc_timestamp(F.col("ts").cast("timestamp"), tz)
    reader = _reader(spark, schema, max_files_per_trigger)
    stream = (
        (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)
        .select(event_time.alias("ts"), "event_type",
                F.col("value").cast("decimal(18,2)").alias("value"))
        .withWatermark("ts", WATERMARK)
        .groupBy(F.window("ts", WINDOW), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("_v"))
        .select(
            F.to_date(F.to_utc_timestamp(F.col("window.start"), tz)).alias("window_date"),
            "event_type", "events",
            F.col("_v").cast("double").alias("total_value"),
        )
    )
    base = out or scratch_path(spark, "stream_daily_value")
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", os.path.join(base, "data"))
        .option("checkpointLocation", os.path.join(base, "_checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return parent.read.schema(stream.schema).parquet(os.path.join(base, "data"))
