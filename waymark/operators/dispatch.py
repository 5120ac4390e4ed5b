"""Filters and dispatch of observation streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Message types that are recognised on their own, with the observation they become (fixed values).
AUTO_TYPES = {
    "sensor_msgs/msg/PointCloud2": "PointCloud",
    "sensor_msgs/msg/LaserScan": "Scan2D",
    "sensor_msgs/msg/Image": "Image",
    "sensor_msgs/msg/Imu": "IMU",
    "sensor_msgs/msg/NavSatFix": "GPS",
    "nav_msgs/msg/Odometry": "Odometry",
}


def map_filter(df: DataFrame, column: str, fn) -> DataFrame:
    """The column mapped by fn; rows for which it gives null go."""
    return df.withColumn(column, fn(F.col(column))).where(F.col(column).isNotNull())


def guarded(df: DataFrame, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose value (a try_ expression) could be made, and those in quarantine."""
    made = df.withColumn(column, value)
    return made.where(F.col(column).isNotNull()), made.where(F.col(column).isNull()).drop(column)


def by_source(df: DataFrame, names: str | Sequence[str], column: str = "source") -> DataFrame:
    return df.where(F.col(column).isin([names] if isinstance(names, str) else list(names)))


def by_kind(df: DataFrame, switches: Mapping[str, bool], column: str = "kind") -> DataFrame:
    return df.where(F.col(column).isin([k for k, on in switches.items() if on]))


def topic_kind(topic: Column, type_: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Observation class of a topic: its override, else by message type, else null."""
    out = F.lit(None).cast("string")
    for k, v in AUTO_TYPES.items():
        out = F.when(type_ == k, v).otherwise(out)
    for k, v in (overrides or {}).items():
        out = F.when(topic == k, v).otherwise(out)
    return out


def has_fields(fields: Column, needed: Sequence[str] = ("x", "y", "z")) -> Column:
    out = F.lit(True)
    for f in needed:
        out &= F.array_contains(fields, f)
    return out


def cloud_kind(fields: Column) -> Column:
    """XYZ, XYZI or XYZIRT by the fields of a message; null without coordinates."""
    full = has_fields(fields, ("x", "y", "z", "ring")) & (F.array_contains(fields, "time") | F.array_contains(fields, "timestamp") | F.array_contains(fields, "t"))
    return F.when(full, "XYZIRT").when(has_fields(fields, ("x", "y", "z", "intensity")), "XYZI").when(has_fields(fields), "XYZ")


def unmapped_topics(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Topics without a mapping, once each."""
    return messages.select("topic").distinct().join(known.select("topic"), "topic", "left_anti")


def inventory(messages: DataFrame, *keys: str) -> DataFrame:
    return messages.groupBy(*keys).agg(F.count("*").alias("n"))


def due(t: Column, t0: Column, replayed: Column) -> Column:
    return t - t0 <= replayed
