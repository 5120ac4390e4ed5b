"""Sinks: text forms of maps and trajectories, saved maps and world models, fan-out to several subscribers."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geom import to_matrix12
from waymark.functions.text import ns_to_seconds
from waymark.sources.log import SCHEMA_VERSION, checked_version


def map_lines(points: DataFrame) -> DataFrame:
    return points.select(F.format_string("%f %f %f", F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")).alias("value"))


def write_map_text(points: DataFrame, path: str) -> None:
    map_lines(points).write.text(path)


def kitti_lines(frames: DataFrame, order: str = "frame") -> DataFrame:
    m = to_matrix12(F.col("pose"))
    return frames.orderBy(order).select(F.array_join(F.transform(m, lambda v: v.cast("string")), " ").alias("value"))


def tum_lines(frames: DataFrame, order: str = "t_ns") -> DataFrame:
    cells = [F.format_string("%.9f", ns_to_seconds(F.col("t_ns"))), *(F.col(f"pose.{c}").cast("string") for c in ("x", "y", "z", "qx", "qy", "qz", "qw"))]
    return frames.orderBy(order).select(F.concat_ws(" ", *cells).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def save_map(points: DataFrame, path: str, **parameters) -> None:
    """Voxel map with its parameters and schema version beside it."""
    points.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "parameters": F.lit(json.dumps(parameters, sort_keys=True))}).write.parquet(path)


def load_map(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    table = checked_version(spark.read.parquet(path))
    row = table.select("parameters").first()
    return table.drop("parameters", "schema_version"), json.loads(row.parameters) if row else {}


def save_world(path: str, entities: DataFrame, factors: DataFrame, annotations: DataFrame | None = None) -> None:
    """Entities, then factors, all kinds alike; blobs in a table of their own."""
    for name, df in (("entities", entities), ("factors", factors), ("annotations", annotations)):
        if df is not None:
            df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.parquet(f"{path}/{name}")


def load_world(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    out = {n: checked_version(spark.read.parquet(f"{path}/{n}")).drop("schema_version") for n in ("entities", "factors")}
    try:
        out["annotations"] = checked_version(spark.read.parquet(f"{path}/annotations")).drop("schema_version")
    except AnalysisException:  # saved without any
        pass
    return out


def export_stream(stream: DataFrame, path: str, checkpoint: str, by: str = "kind"):
    """Every observation of a stream to the log, exactly once."""
    return stream.withColumn("schema_version", F.lit(SCHEMA_VERSION)).writeStream.format("parquet").partitionBy(by).option("path", path).option("checkpointLocation", checkpoint)


def tf_rows(poses: DataFrame, parent: str, child: str) -> DataFrame:
    """``(t_ns, parent, child, x … qz)``: poses as transforms to publish."""
    return poses.select("t_ns", F.lit(parent).alias("parent"), F.lit(child).alias("child"), *(F.col(f"pose.{c}").alias(c) for c in ("x", "y", "z", "qw", "qx", "qy", "qz")))


def odometry_rows(states: DataFrame) -> DataFrame:
    """Messages of poses and twists, as ``messages.odometry`` reads them."""
    part = lambda of, names: F.struct(*(F.col(f"{of}.{n}").alias(c) for n, c in names))
    pose = F.struct(part("pose", [(c, c) for c in "xyz"]).alias("position"), part("pose", [(f"q{c}", c) for c in "xyzw"]).alias("orientation"))
    twist = F.struct(part("twist", [(f"v{c}", c) for c in "xyz"]).alias("linear"), part("twist", [(f"w{c}", c) for c in "xyz"]).alias("angular"))
    return states.select("t_ns", "sensor_label", F.struct(F.lit("base_link").alias("child_frame_id"), F.struct(pose.alias("pose")).alias("pose"), F.struct(twist.alias("twist")).alias("twist")).alias("payload"))


def write_metrics(tables: Mapping[str, DataFrame], path: str) -> None:
    """A CSV folder for each table: segment errors, curves by length and speed, totals."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def fan_out(stream: DataFrame, subscribers: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str, on_error: Callable[[str, Exception], None] | None = None):
    """One micro-batch to several subscribers; one that fails doesn't keep the others from it."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for name, call in subscribers.items():
                try:
                    call(batch, epoch)
                except Exception as e:  # isolated by contract
                    if on_error is None:
                        raise
                    on_error(name, e)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def per_kind(batch: DataFrame, sinks: Mapping[str, Callable[[DataFrame], None]], column: str = "kind") -> None:
    """Each kind's rows to its sink (publishers by kind)."""
    for kind, sink in sinks.items():
        sink(batch.where(F.col(column) == kind))
