"""Session helpers: a local session for tests and bench, and the shared folder.

On a cluster the session comes from the platform; only ``shared_dir`` is used
there, and it reads ``spark.checkpoint.dir`` from the session.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "costmart", extra: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the local bench (no UI, AQE on, UTC clock)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COSTMART_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; we only fall
    back to a fresh temporary folder in local mode (tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
        base = tempfile.mkdtemp(prefix="costmart-ckpt-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def _own_dir(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/costmart-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder below this application's part of the shared checkpoint folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete every folder that ``shared_dir`` has given to this application.

    To be called when its results are no longer read, e.g. before the session
    stops.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of ended jobs deleted.

    Spark deletes them once the driver has collected the plans that made them. On a
    driver with memory to spare that may not happen before the session ends, so a
    job of many steps asks for it after a step; nothing still in use is touched.
    """
    gc.collect()                               # Python's hold on plans no longer named
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Several consumers of a costly frame then read one copy that outlives a
    lost executor, and column pruning applies to that copy only.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scale_conf(input_bytes: int, total_cores: int,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings sized for a run over ``input_bytes`` of Parquet.

    The initial shuffle partition count is set high (input / target, at least
    three waves of the cores) and AQE coalesces it down to the
    ``target_partition_bytes`` the data actually produces; file splits are
    sized so a scan task reads about one target. Skew-join splitting stays on.
    Apply with ``SparkSession.builder.config(map=...)`` or ``spark.conf.set``.
    """
    partitions = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
    }
