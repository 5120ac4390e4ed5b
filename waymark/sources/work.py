"""Work tables in the folder that the cluster shares, where a plan must not be evaluated twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, in local mode only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if not hasattr(work_folder, "own"):
        work_folder.own = tempfile.mkdtemp(prefix="waymark-")
    return f"file://{work_folder.own}"


def stored(df: DataFrame) -> DataFrame:
    """Written once and read back, so that every use sees the same rows and lost executors cost no recomputation."""
    path = f"{work_folder(df.sparkSession)}/waymark/work-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
