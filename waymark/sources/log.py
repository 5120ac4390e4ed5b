"""The observation log: Parquet partitioned by kind, in place of the binary archives of recorded sessions.

Rows are ``(t_ns, sensor_label, kind, sensor_pose, payload…)``; sensory frames are arrays of observations and are
flattened. Partitioning by kind makes the publish switches partition filters; random access by timestep is a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.temporal import with_timestep

SCHEMA_VERSION = 1


def write_log(observations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    observations.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode(mode).partitionBy("kind").parquet(path)


def read_log(spark: SparkSession, path: str, kinds: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """The log, or some kinds (partition pruning) and labels (pushed to the scan) of it."""
    log = spark.read.parquet(path)
    if kinds is not None:
        log = log.where(F.col("kind").isin(kinds))
    if labels is not None:
        log = log.where(F.col("sensor_label").isin(labels))
    return checked_version(log)


def checked_version(df: DataFrame, known: int = SCHEMA_VERSION) -> DataFrame:
    """Fails on rows of a version that isn't known."""
    ok = F.assert_true(F.col("schema_version") <= known, F.lit("unknown schema version"))
    return df.withColumn("schema_version", F.when(ok.isNull(), F.col("schema_version")))


def flatten_frames(frames: DataFrame, column: str = "observations") -> DataFrame:
    return frames.select(F.posexplode(column).alias("slot", "o"), *[c for c in frames.columns if c != column]).select("o.*", "slot", *[c for c in frames.columns if c != column])


class Dataset:
    """Random access to a replayable stream: size, observations of a timestep, ground truth."""

    def __init__(self, log: DataFrame, order: list[str], truth: DataFrame | None = None):
        self.log, self.order, self._truth = log, order, truth

    def size(self) -> int:
        return self.log.count()

    def observations(self, step: int) -> DataFrame:
        return with_timestep(self.log, self.order).where(F.col("timestep") == step)

    def has_truth(self) -> bool:
        return self._truth is not None

    def truth(self) -> DataFrame:
        if self._truth is None:
            raise LookupError("no ground truth")
        return self._truth


def read_bag(spark: SparkSession, path: str) -> DataFrame:
    """Recorded bags need a decoder that is not part of Spark or the standard library; normalised Parquet is read instead."""
    storage = {"mcap": "mcap", "db3": "sqlite3"}.get(path.rsplit(".", 1)[-1])
    if storage:
        raise NotImplementedError(f"bags stored as {storage} must be converted to an observation log first")
    return spark.read.parquet(path)
