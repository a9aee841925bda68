"""Session helpers shared by tests, the bench and command lines."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale; sizes (partitions, memory) stay with the caller or the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", partitions: int | None = None, **extra: str) -> SparkSession:
    """A local session with the engine's defaults; on a cluster use the session the platform gives you."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sparkwright")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions or (os.cpu_count() or 8)),
        "spark.driver.memory": "8g",
    } | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A driver table as a DataFrame; the scan stays lazy, so filters and columns are pushed down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def local_folder() -> str:
    """One temporary folder for a local session, removed when the process ends."""
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="sparkwright"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one for a local session only."""
    base = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):  # local-cluster is a cluster
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or local_folder()}/scratch/{uuid.uuid4().hex}"


def scratch_table(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a scratch folder, read again: what is costly to make and read more than once."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
