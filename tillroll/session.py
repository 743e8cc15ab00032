"""Session helpers.

Library code never builds its own session; it receives one.  ``local_session``
is for tests, the bench and ad-hoc runs.  ``checkpoint_dir`` reads the shared
folder the cluster names in ``spark.checkpoint.dir`` and only invents one when
running in local mode with nothing configured.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "tillroll") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: float, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the input volume.

    Shuffles start with enough partitions for ``target_partition_bytes`` each
    (at least 3 per core) and AQE coalesces the small ones and splits skewed
    join partitions; scans read ``target_partition_bytes`` splits; broadcast
    stays limited to genuinely small sides (64 MB measured at runtime).
    Apply with ``SparkSession.builder.config(map=...)`` or ``spark.conf.set``.
    """
    shuffle = max(3 * total_cores, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # coalesce to the advisory size rather than to the default parallelism
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
        # checkpoints of frames that are no longer referenced are deleted
        # (static: set when the application starts)
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return False


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The reliable checkpoint folder of this session.

    Order: the context's directory, then ``spark.checkpoint.dir``; only a
    local-mode session without either gets a fresh scratch folder.  On a
    cluster with nothing configured we refuse rather than write to a
    machine-local path that other executors cannot see.  (A Spark Connect
    session manages its checkpoint folder on the server; we only read it.)
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = conf or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        conf = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, beside the checkpoint folder."""
    explicit = spark.conf.get("tillroll.export.dir", None)
    ckpt = checkpoint_dir(spark)
    if not explicit and not ckpt:
        raise RuntimeError("set tillroll.export.dir or spark.checkpoint.dir to a shared folder")
    base = explicit or os.path.join(ckpt, "tillroll-tables")
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    if not explicit:  # scratch: gone when the application ends
        _delete_at_exit(spark, path)
    return path


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    except Exception:  # noqa: BLE001 - Spark Connect has no JVM here
        return


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
