"""Tables written in between, so that a plan doesn't grow with every step that reads it and lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; a private one where none is set and all runs on one machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='trackforge-')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet and read again; the files go when the session ends."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(files)
    return spark.read.schema(df.schema).parquet(path)
