"""Spark session defaults for local runs, and the shared scratch folder of a cluster."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_folder: list[str] = []
_written: list[str] = []


def local_session(app: str = "cleanloom", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else os.cpu_count()))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # larger methods are never compiled by the JVM
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` when the session names one.

    Only a local master without that setting gets a folder of its own; on a cluster a missing
    setting is an error, because executors could not see a driver-local folder.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="cleanloom-"))
    return _local_folder[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/cleanloom-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not when the driver next collects its garbage.

    The first round frees the plans, the second what only they referred to.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def drop_scratch(spark: SparkSession, written: str) -> bool:
    """Delete an intermediate table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written)
    if written in _written:
        _written.remove(written)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def release_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; frames that still read them become invalid."""
    released = 0
    while _written:
        released += drop_scratch(spark, _written[-1])
    return released


def cut_lineage(df):
    """Reliable checkpoint into the shared folder: survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
