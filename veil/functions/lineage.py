"""Cutting the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`, which driver and executors must share.

    Where it is unset, a session without a cluster (tests) uses its warehouse; any other is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder below the shared one."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/veil-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> bool:
    """Deletes the tables this application wrote. Data frames built on them cannot be used afterwards."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    The result survives the loss of executors, has a one-node lineage and carries size statistics,
    so later joins with it can still be planned as broadcasts when it is small. `drop_scratch`
    removes all such tables at the end of a job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
