"""File sources: text tables and binary scans as DataFrames with explicit schemas.

Text goes through Spark's readers and column expressions; binary scans through ``binaryFile`` and Arrow batches, a file at
a time. ``step`` numbers come from names sorted, as the datasets define them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.functions.geom import correct_elevation, from_matrix12, pose_of, vec
from waymark.operators.trajectory import from_ypr_rows

POINT = "path string, pt_idx int, x float, y float, z float, intensity float"
#: Points of a MulRan scan (fixed value).
MULRAN_POINTS = 65_536


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``(step, path, length)`` of the files that fit the pattern, numbered by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return files.withColumn("step", F.row_number().over(Window.orderBy("path")) - 1)  # a row a file


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of a text file, numbered from 0 in file order (one file is one partition's run of ids)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def kitti_times(spark: SparkSession, path: str) -> DataFrame:
    lines = text_lines(spark, path).select("line_no", F.trim("line").try_cast("double").alias("t")).where("t is not null")
    return lines.select(F.col("line_no").alias("step"), text.seconds_to_ns(F.col("t")).alias("t_ns"))


def kitti_poses(spark: SparkSession, path: str) -> DataFrame:
    """``(frame, pose)`` of 3x4 rows; lines that aren't twelve numbers are left out, and frames number the good rows."""
    rows = text_lines(spark, path).select("line_no", text.numbers(F.col("line")).alias("m")).where(text.well_formed(F.col("m"), 12))
    frame = F.row_number().over(Window.orderBy("line_no")) - 1  # a row a pose of one sequence
    return rows.select(frame.cast("long").alias("frame"), from_matrix12(F.col("m")).col.alias("pose"))


def kitti_calibration(spark: SparkSession, path: str, keys: tuple[str, ...] = ("P0", "P1", "P2", "P3", "Tr")) -> DataFrame:
    """``(key, m array<double>)``; each key must be there."""
    lines = text_lines(spark, path)
    rows = lines.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), text.calibration(F.col("line"), k).alias("m")) for k in keys))).alias("r")).where("r.m is not null").select("r.*")
    return rows


def kitti_camera_offsets(calibration: DataFrame) -> DataFrame:
    """``(key, x)``: the camera's offset along x of its projection matrix, -P(0,3)/P(0,0)."""
    return calibration.where(F.col("key").startswith("P")).select("key", (-F.col("m")[3] / F.col("m")[0]).alias("x"))


def camera_poses(calibration: DataFrame) -> dict[str, list[list[float]]]:
    """4x4 poses of the cameras in the lidar's frame: inv(Tr), then the offset along x of each projection matrix. Five rows, on the driver."""
    m = {r.key: np.array(r.m).reshape(3, 4) for r in calibration.collect()}
    if missing := {"P0", "P1", "P2", "P3", "Tr"} - m.keys():
        raise ValueError(f"calibration without {sorted(missing)}")
    base = np.linalg.inv(np.vstack((m["Tr"], [0, 0, 0, 1])))
    out = {}
    for k in ("P0", "P1", "P2", "P3"):
        at = np.eye(4)
        at[0, 3] = -m[k][0, 3] / m[k][0, 0]
        out[k] = (base @ at).tolist()
    return out


class KittiSequence:
    """A sequence's folder: times, scans with corrected elevations, images, cameras and ground truth; their numbers must agree."""

    def __init__(self, spark: SparkSession, folder: str, poses: str | None = None):
        self.spark, self.folder, self.poses = spark, folder.rstrip("/"), poses
        self.times = kitti_times(spark, f"{self.folder}/times.txt")
        self.scans = list_files(spark, f"{self.folder}/velodyne", "*.bin")
        self.calibration = kitti_calibration(spark, f"{self.folder}/calib.txt")
        n, scans = self.times.count(), self.scans.count()
        if n != scans:
            raise ValueError(f"{n} times but {scans} scans")
        if poses and (k := self.truth().count()) != n:
            raise ValueError(f"{n} times but {k} poses")

    def observations(self) -> DataFrame:
        """``(step, t_ns, path)`` of the scans."""
        return self.times.join(self.scans.select("step", "path"), "step")

    def points(self, step: int | None = None) -> DataFrame:
        """Points with their scan's step and time; elevations are corrected."""
        scans = self.observations() if step is None else self.observations().where(F.col("step") == step)
        raw = binary_points(self.spark, f"{self.folder}/velodyne") if step is None else binary_points(self.spark, scans.first().path)
        at = correct_elevation(vec(F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")))
        fixed = raw.withColumn("_p", at.col).select("path", "pt_idx", *(F.col(f"_p.{c}").alias(c) for c in "xyz"), "intensity")
        return fixed.join(F.broadcast(scans), "path").drop("path")

    def images(self, camera: int) -> DataFrame:
        """``(step, t_ns, path)``; as many as times, or none."""
        files = list_files(self.spark, f"{self.folder}/image_{camera}", "*.png")
        if (n := files.count()) not in (0, self.times.count()):
            raise ValueError(f"{n} images of camera {camera}")
        return self.times.join(files.select("step", "path"), "step")

    def cameras(self) -> dict[str, list[list[float]]]:
        return camera_poses(self.calibration)

    def truth(self) -> DataFrame:
        return kitti_poses(self.spark, self.poses)


def read_table(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options) -> DataFrame:
    """Any format that Spark reads: parquet, orc, json, csv, text, jdbc."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path) if kind != "jdbc" else reader.option("url", path).load()


def sensor_yaml(content: str) -> dict[str, object]:
    """The pose, intrinsics and distortion of a camera or IMU file: scalars and (nested) lists of one level of mappings."""
    body = "\n".join(x.split("#", 1)[0] for x in content.splitlines() if not x.startswith("%"))
    lists = {k: [float(v) for v in found.group(1).split(",") if v.strip()] for k in ("data", "intrinsics", "distortion_coefficients", "resolution") if (found := re.search(rf"\b{k}\s*:\s*\[([^\]]*)\]", body))}
    words = dict(re.findall(r"^(\w+)\s*:[ \t]*([^\[\s][^\n]*?)[ \t]*$", body, re.MULTILINE))
    if len(lists.get("data", ())) != 16:
        raise ValueError("a sensor file needs sixteen numbers of T_BS")
    if "intrinsics" in lists and len(lists["intrinsics"]) != 4:
        raise ValueError("four intrinsics are needed")
    return {"pose": [lists["data"][i : i + 4] for i in range(0, 16, 4)], **{k: v for k, v in lists.items() if k != "data"}, **words}


def euroc_sensor(spark: SparkSession, path: str) -> dict[str, object]:
    """``sensor.yaml`` of a sensor."""
    return sensor_yaml(spark.read.text(path, wholetext=True).first().value)


def binary_points(spark: SparkSession, folder: str, pattern: str = "*.bin", fields: int = 4, exact: int | None = None) -> DataFrame:
    """Long-form points ``(path, pt_idx, x, y, z, intensity)`` of little-endian float32 records; ``exact`` asserts their number."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rec = np.frombuffer(content, "<f4")
                if len(rec) % fields or (exact is not None and len(rec) != exact * fields):
                    raise ValueError(f"{path}: {len(rec)} numbers don't make whole scans")
                rec = rec.reshape(-1, fields)
                cols = [pa.array(np.ascontiguousarray(rec[:, i])) for i in range(3)] + [pa.array(np.ascontiguousarray(rec[:, 3]) if fields > 3 else np.zeros(len(rec), np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rec)), pa.array(np.arange(len(rec), dtype=np.int32)), *cols], names=["path", "pt_idx", "x", "y", "z", "intensity"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInArrow(decode, POINT)


def kitti360_times(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark, path).select(F.col("line_no").alias("frame_idx"), text.datetime_ns(F.trim("line")).alias("t_ns")).where("t_ns is not null")


def kitti360_poses(spark: SparkSession, path: str) -> DataFrame:
    """``(frame_idx, pose)`` of rows with an index and twelve numbers."""
    rows = text_lines(spark, path).select(text.numbers(F.col("line")).alias("v")).where(text.well_formed(F.col("v"), 13))
    return rows.select(F.col("v")[0].cast("long").alias("frame_idx"), from_matrix12(F.slice("v", 2, 12)).col.alias("pose"))


def kitti360_truth(times: DataFrame, poses: DataFrame) -> DataFrame:
    """Ground truth with times, joined by frame index (it is sparse)."""
    return times.join(poses, "frame_idx")


def euroc_camera(spark: SparkSession, path: str, label: str) -> DataFrame:
    """``(t_ns, sensor_label, image_id)``; stamps stay integers."""
    rows = spark.read.csv(path, schema="t_ns long, image string", comment="#")
    return rows.select("t_ns", F.lit(label).alias("sensor_label"), F.regexp_extract("image", r"(\d+)", 1).try_cast("long").alias("image_id")).where("t_ns is not null")


def euroc_imu(spark: SparkSession, path: str, label: str = "imu0") -> DataFrame:
    names = ("wx", "wy", "wz", "ax", "ay", "az")
    rows = spark.read.csv(path, schema="t_ns long, " + ", ".join(f"{n} double" for n in names), comment="#")
    return rows.where("t_ns is not null").withColumn("sensor_label", F.lit(label))


def euroc_streams(spark: SparkSession, folder: str) -> DataFrame:
    """The three streams of a sequence in time order."""
    from waymark.operators.temporal import merge_streams

    cams = [euroc_camera(spark, f"{folder}/{c}/data.csv", c) for c in ("cam0", "cam1")]
    streams = [s.withColumn("seq", F.col("t_ns")) for s in (*cams, euroc_imu(spark, f"{folder}/imu0/data.csv"))]
    return merge_streams(streams)


def gps_dilution(variance: Column) -> Column:
    """Dilution that a horizontal variance stands for."""
    return F.sqrt(variance) / HDOP_METRES


#: Metres of standard deviation that stand for a dilution of 1 (fixed value).
HDOP_METRES = 4.5


def mulran_gps(spark: SparkSession, path: str) -> DataFrame:
    """``(t_ns, lat, lon, alt, hdop, cov array<double>)``."""
    rows = spark.read.csv(path, schema="t_ns long, lat double, lon double, alt double, " + ", ".join(f"c{i} double" for i in range(9)))
    cov = F.array(*(F.col(f"c{i}") for i in range(9)))
    return rows.where("t_ns is not null").select("t_ns", "lat", "lon", "alt", gps_dilution(F.col("c0")).alias("hdop"), cov.alias("cov"))


def mulran_truth(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, schema="t_ns long, " + ", ".join(f"m{i} double" for i in range(12)))
    return rows.where("t_ns is not null").select("t_ns", from_matrix12(F.array(*(F.col(f"m{i}") for i in range(12)))).col.alias("pose"))


def mulran_scans(spark: SparkSession, folder: str) -> DataFrame:
    """``(step, t_ns, path)``: stamps are file names; the last scan is dropped."""
    files = list_files(spark, folder, "*.bin").withColumn("t_ns", text.file_stamp_ns(F.col("path")))
    last = F.max("step").over(Window.partitionBy())
    return files.withColumn("_l", last).where("step < _l").select("step", "t_ns", "path")


def mulran_points(spark: SparkSession, folder: str, exact: int = MULRAN_POINTS) -> DataFrame:
    from waymark.functions.geom import sweep_time

    return binary_points(spark, folder, exact=exact).withColumn("_s", sweep_time(F.col("pt_idx"))).select("*", F.col("_s.ring").alias("ring"), F.col("_s.t").alias("t")).drop("_s")


def ply_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points of ascii or little-endian PLY frames: ``(path, pt_idx, x, y, z, intensity, t double)``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "short": "<i2", "int16": "<i2", "char": "i1", "int8": "i1"}
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, _, body = content.partition(b"end_header\n")
                lines = head.decode("ascii").split("\n")
                n, fields = 0, []
                for line in (x.split() for x in lines):
                    if line[:2] == ["element", "vertex"]:
                        n = int(line[2])
                    elif line[:1] == ["property"]:
                        fields.append((line[2], kinds[line[1]]))
                if any("ascii" in x for x in lines):
                    rows = np.array([x.split() for x in body.decode().split("\n")[:n]], float).reshape(n, len(fields))
                    data = {name: rows[:, i] for i, (name, _) in enumerate(fields)}
                else:
                    raw = np.frombuffer(body, np.dtype(fields), n)
                    data = {name: raw[name] for name, _ in fields}
                if not {"x", "y", "z", "timestamp"} <= data.keys():
                    raise ValueError(f"{path}: no coordinates or timestamp")
                cols = [pa.array(np.ascontiguousarray(data.get(c, np.zeros(n))).astype(np.float32)) for c in ("x", "y", "z", "intensity")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(n, dtype=np.int32)), *cols, pa.array(np.ascontiguousarray(data["timestamp"]).astype(float))], names=["path", "pt_idx", "x", "y", "z", "intensity", "t"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(folder).select("path", "content")
    return files.mapInArrow(decode, POINT + ", t double")


def paris_luco_scans(spark: SparkSession, folder: str, period_ns: int = 100_000_000) -> DataFrame:
    """``(step, t_ns, path)``: synthetic time at 10 Hz, the first at 0.1 s."""
    return list_files(spark, folder, "*.ply").select("step", ((F.col("step") + 1) * F.lit(period_ns).cast("long")).alias("t_ns"), "path")


def paris_luco_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points with centred times and rings by pitch."""
    from waymark.functions.geom import ring_of
    from waymark.operators.temporal import centred_times

    return centred_times(ply_points(spark, folder), "path", "t").withColumn("ring", ring_of(vec(F.col("x"), F.col("y"), F.col("z"))))


def paris_luco_truth(spark: SparkSession, path: str, period_ns: int = 100_000_000) -> DataFrame:
    """Translations as a trajectory (published, unlike poses that are only loaded)."""
    rows = text_lines(spark, path).select("line_no", text.numbers(F.col("line")).alias("v")).where(text.well_formed(F.col("v"), 3))
    return rows.select(((F.col("line_no") + 1) * F.lit(period_ns).cast("long")).alias("t_ns"), pose_of(F.col("v")[0], F.col("v")[1], F.col("v")[2], 1, 0, 0, 0).col.alias("pose"))


def tum_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """``(t_ns, pose)`` of rows ``t x y z qx qy qz qw``; comments are skipped."""
    rows = text_lines(spark, path).where(~F.col("line").startswith("#")).select(text.numbers(F.col("line")).alias("v")).where(text.well_formed(F.col("v"), 8))
    v = F.col("v")
    return rows.select(text.seconds_to_ns(v[0]).alias("t_ns"), pose_of(v[1], v[2], v[3], v[7], v[4], v[5], v[6]).col.alias("pose"))


def ypr_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """``(t_ns, pose)`` of rows ``t x y z yaw pitch roll`` in radians."""
    rows = text_lines(spark, path).where(~F.col("line").startswith("#")).select(text.numbers(F.col("line")).alias("v")).where(text.well_formed(F.col("v"), 7))
    flat = rows.select(text.seconds_to_ns(F.col("v")[0]).alias("t_ns"), *(F.col("v")[i + 1].alias(n) for i, n in enumerate(("x", "y", "z", "yaw", "pitch", "roll"))))
    return from_ypr_rows(flat)
