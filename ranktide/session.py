"""Spark session and lineage helpers.

The library never picks a machine-local folder on a real cluster: the
checkpoint folder comes from ``spark.checkpoint.dir`` (or an already
configured ``SparkContext.getCheckpointDir()``). Only local-mode sessions
(tests, the bench) get a scratch folder of their own when nothing is set.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "ranktide",
    extra: dict | None = None,
) -> SparkSession:
    """Session with the settings every job here assumes.

    AQE is on (runtime coalescing, skew-join splitting, SMJ->BHJ conversion
    from measured sizes), the session zone is pinned to UTC and the UI is off.
    """
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    if shuffle_partitions is None:
        wanted = os.environ.get("RANKTIDE_SHUFFLE_PARTITIONS", "8" if master.startswith("local") else "")
        shuffle_partitions = int(wanted) if wanted else None
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RANKTIDE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions is not None:  # a cluster's own setting stays otherwise
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder shared by the cluster"
        )
    scratch = tempfile.mkdtemp(prefix="ranktide-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, each query's shuffle files are deleted when it has ended, not when the driver's next full garbage
    collection finds them: for loops that write what they need again."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss). The rows are written, so what was shuffled
    for them is deleted at once."""
    checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame keeps the setting that it was made under


def released(df: DataFrame) -> None:
    """Deletes the files that :func:`cut_lineage` wrote for ``df``, which nothing reads any more."""
    spark = df.sparkSession
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isDefined():
        at = spark._jvm.org.apache.hadoop.fs.Path(path.get())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
