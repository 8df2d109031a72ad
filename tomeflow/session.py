"""Spark sessions: one for this machine, and the settings that matter on a cluster."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; a cluster adds its own partition counts and memory.
COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int | None = None, app: str = "tomeflow", extra: dict[str, str] | None = None) -> SparkSession:
    """A session on ``local[cpus]`` with the common settings."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = COMMON | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus), "spark.ui.enabled": "false"} | (extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the folder of ``spark.checkpoint.dir``, which all executors share.

    Only a session on ``local`` gets a temporary folder if none is named.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", "")
        if not configured and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tomeflow-checkpoint-"))
    return df.checkpoint(eager=True)
