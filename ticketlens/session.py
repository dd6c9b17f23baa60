"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ticketlens", **conf: str) -> SparkSession:
    """Session with the settings the operators rely on: UTC wall clock and adaptive execution.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command decides both, and AQE coalesces whatever count it starts from.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return f"{configured.rstrip('/')}/ticketlens-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_SCRATCH:
        folder = tempfile.mkdtemp(prefix="ticketlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_SCRATCH[application] = folder
    return _LOCAL_SCRATCH[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The result has no lineage to recompute after an executor loss, and Spark
    knows its exact byte size, so a later join broadcasts it only when it is
    below ``spark.sql.autoBroadcastJoinThreshold``. The shuffle files of the
    write go with it; else they lie on the disks until the driver's next
    garbage collection.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``frame``; nothing may read it any more."""
    files = frame.inputFiles()
    if files:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def folder_state(spark: SparkSession, folder: str) -> tuple:
    """Name, size, number of files and time of change of every table in a folder: differs once a table has changed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    state = []
    for entry in files.listStatus(root):
        total = files.getContentSummary(entry.getPath())
        state.append((entry.getPath().getName(), total.getLength(), total.getFileCount(), entry.getModificationTime()))
    return tuple(sorted(state))
