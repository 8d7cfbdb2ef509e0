"""Intermediate tables in the folder that the driver and all executors share.

What several later steps read is written once: a plan that repeats its source at every use grows with
each step, and a written table also outlives a lost executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs in this one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def tables_folder(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    path = f"{tables_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that saved() wrote in this application; results not read by then can't be read any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
