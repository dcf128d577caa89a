"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder named in spark.checkpoint.dir; a private one only where it is unset and all runs on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="trackforge-checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """The rows of df written to the shared checkpoint folder, with their partitioning kept."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files that nothing refers to any more, so that they don't pile up on disk."""
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame) -> DataFrame:
    """The rows of df written as Parquet to the shared checkpoint folder and read again; the files go when the session ends."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = df.sparkSession.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(files)
    return df.sparkSession.read.schema(df.schema).parquet(path)
