"""Versioned tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one; on a
    cluster that is an error, as each executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        set_dir = context.getCheckpointDir()
        if not set_dir.isDefined() and not context.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = set_dir.get() if set_dir.isDefined() else f"file://{tempfile.mkdtemp(prefix='field-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """A new version of a table, written and read back: rollback is reading an earlier one."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete snapshots that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
