"""Decoders of recorded messages: normalised rows ``(t_ns, sensor_label, payload)`` to observations, a function a kind.

Payloads are structs (or JSON text, read by the schema of their kind) with the field names of the public message definitions.
Everything is a projection; only the packed records of point clouds are taken apart in Arrow batches, a message at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geom import pose_of

_VEC = "struct<x:double,y:double,z:double>"
_QUAT = "struct<x:double,y:double,z:double,w:double>"
_POSE = f"struct<position:{_VEC},orientation:{_QUAT}>"
_TWIST = f"struct<linear:{_VEC},angular:{_VEC}>"
#: Payload schemas of the kinds that have no packed data.
SCHEMAS = {
    "Scan2D": "struct<angle_min:double,angle_max:double,angle_increment:double,time_increment:double,scan_time:double,range_min:double,range_max:double,ranges:array<double>,intensities:array<double>>",
    "RotatingScan": "struct<rows:int,columns:int,range_unit:double,ranges:array<int>,intensities:array<int>>",
    "IMU": f"struct<orientation:{_QUAT},angular_velocity:{_VEC},linear_acceleration:{_VEC}>",
    "GPS": "struct<latitude:double,longitude:double,altitude:double,status:int,position_covariance:array<double>>",
    "Odometry": f"struct<child_frame_id:string,pose:struct<pose:{_POSE},covariance:array<double>>,twist:struct<twist:{_TWIST},covariance:array<double>>>",
    "Image": "struct<height:int,width:int,encoding:string,step:int,data:binary>",
    "Transforms": f"struct<transforms:array<struct<frame_id:string,child_frame_id:string,t_ns:bigint,transform:struct<translation:{_VEC},rotation:{_QUAT}>>>>",
}
#: Data types of the fields of a point cloud, by their number in the message (fixed values).
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
CLOUD = "t_ns long, sensor_label string, pt_idx int, x float, y float, z float, intensity float, ring int, t double"


def parsed(messages: DataFrame, kind: str, column: str = "payload") -> DataFrame:
    """JSON payloads as structs of their kind; rows that can't be read have a null payload."""
    return messages.withColumn(column, F.from_json(column, SCHEMAS[kind]))


def _p(field: str) -> Column:
    return F.col(f"payload.{field}")


def laser_scan(messages: DataFrame) -> DataFrame:
    """``(…, beam, angle, range, valid)``: beams in order; a range outside the sensor's limits, or none, isn't valid."""
    beams = messages.select("t_ns", "sensor_label", "payload", F.posexplode("payload.ranges").alias("beam", "range"))
    valid = F.col("range").isNotNull() & ~F.isnan("range") & (F.col("range") >= _p("range_min")) & (F.col("range") <= _p("range_max"))
    return beams.select("t_ns", "sensor_label", "beam", (_p("angle_min") + F.col("beam") * _p("angle_increment")).alias("angle"), "range", valid.alias("valid"))


def scan_points(beams: DataFrame) -> DataFrame:
    """Valid beams as points in the sensor's plane."""
    return beams.where("valid").select("t_ns", "sensor_label", F.col("beam").alias("pt_idx"), (F.col("range") * F.cos("angle")).alias("x"), (F.col("range") * F.sin("angle")).alias("y"), F.lit(0.0).alias("z"))


def rotating_scan(messages: DataFrame) -> DataFrame:
    """``(…, row, column, range, intensity)`` of an organised scan; a range of 0 is no return."""
    cells = messages.select("t_ns", "sensor_label", "payload", F.posexplode("payload.ranges").alias("i", "r")).where("r > 0")
    return cells.select("t_ns", "sensor_label", F.expr("i div payload.columns").cast("int").alias("row"), F.expr("i % payload.columns").cast("int").alias("column"), (F.col("r") * _p("range_unit")).alias("range"), F.get(_p("intensities"), F.col("i")).alias("intensity"))


def imu(messages: DataFrame) -> DataFrame:
    cells = [_p(f"{a}.{c}").alias(f"{n}{c}") for a, n in (("angular_velocity", "w"), ("linear_acceleration", "a")) for c in "xyz"]
    return messages.select("t_ns", "sensor_label", *cells, *(_p(f"orientation.{c}").alias(f"q{c}") for c in "wxyz"))


def gps(messages: DataFrame) -> DataFrame:
    """With the dilution that a covariance stands for; without nine numbers there is none."""
    from waymark.sources.files import gps_dilution

    cov = F.when(F.size(_p("position_covariance")) == 9, _p("position_covariance"))
    return messages.select("t_ns", "sensor_label", _p("latitude").alias("lat"), _p("longitude").alias("lon"), _p("altitude").alias("alt"), gps_dilution(cov[0]).alias("hdop"), cov.alias("cov"))


def pose_column(position: str, orientation: str) -> Column:
    return pose_of(*(_p(f"{position}.{c}") for c in "xyz"), *(_p(f"{orientation}.{c}") for c in "wxyz")).col


def odometry(messages: DataFrame) -> DataFrame:
    twist = F.struct(*(_p(f"twist.twist.{a}.{c}").alias(f"{n}{c}") for a, n in (("linear", "v"), ("angular", "w")) for c in "xyz"))
    return messages.select("t_ns", "sensor_label", _p("child_frame_id").alias("child"), pose_column("pose.pose.position", "pose.pose.orientation").alias("pose"), twist.alias("twist"))


def image(messages: DataFrame) -> DataFrame:
    """Sizes and the raw rows; pixels stay packed."""
    return messages.select("t_ns", "sensor_label", *(_p(c).alias(c) for c in ("height", "width", "encoding", "step", "data")), (F.length(_p("data")) == _p("height") * _p("step")).alias("whole"))


def transforms(messages: DataFrame) -> DataFrame:
    """``(parent, child, t_ns, pose)``, a row a transform."""
    rows = messages.select(F.explode("payload.transforms").alias("payload"))
    return rows.select(_p("frame_id").alias("parent"), _p("child_frame_id").alias("child"), _p("t_ns").alias("t_ns"), pose_column("transform.translation", "transform.rotation").alias("pose"))


def point_cloud(messages: DataFrame) -> DataFrame:
    """Points of ``(t_ns, sensor_label, fields array<struct<name,offset,datatype>>, point_step, is_bigendian, data binary)``.

    Fields that a message lacks are null; a message without coordinates, or whose data isn't whole records, gives no points.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                order = ">" if m["is_bigendian"] else "<"
                named = {f["name"]: (f["offset"], order + FIELD_TYPES[f["datatype"]]) for f in m["fields"] or () if f["datatype"] in FIELD_TYPES}
                step, data = m["point_step"] or 0, m["data"] or b""
                if not {"x", "y", "z"} <= named.keys() or step <= 0 or len(data) % step:
                    continue
                kind = np.dtype({"names": list(named), "formats": [f for _, f in named.values()], "offsets": [o for o, _ in named.values()], "itemsize": step})
                rec = np.frombuffer(data, kind)
                n, time = len(rec), next((k for k in ("t", "time", "timestamp") if k in named), None)
                one = lambda c, t, of=rec, have=named: pa.array(np.ascontiguousarray(of[c]).astype(t)) if c in have else pa.nulls(len(of), pa.from_numpy_dtype(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m["t_ns"]] * n, pa.int64()), pa.array([m["sensor_label"]] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *(one(c, np.dtype("f4")) for c in ("x", "y", "z", "intensity")), one("ring", np.dtype("i4")), one(time, np.dtype("f8"))],
                    names=["t_ns", "sensor_label", "pt_idx", "x", "y", "z", "intensity", "ring", "t"],
                )

    return messages.select("t_ns", "sensor_label", "fields", "point_step", "is_bigendian", "data").mapInArrow(decode, CLOUD)


DECODERS = {"Scan2D": laser_scan, "RotatingScan": rotating_scan, "IMU": imu, "GPS": gps, "Odometry": odometry, "Image": image, "Transforms": transforms, "PointCloud": point_cloud}


def decoded(messages: DataFrame, kind: str) -> DataFrame:
    """Messages of one kind, JSON payloads included."""
    if kind in SCHEMAS and dict(messages.dtypes).get("payload") == "string":
        messages = parsed(messages, kind)
    return DECODERS[kind](messages)
