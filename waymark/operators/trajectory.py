"""Trajectory tools and ordered folds: re-expression, finite differences, extrapolation, gyro integration, gating."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.geom import bind, compose, conjugate, difference, from_ypr, grow_covariance, pose, pose_of, quat, quat_mul, rotate, so3_exp, so3_log, transform, vec

#: Defaults of the fusion (fixed values): use of the velocity model in seconds, random walks.
MAX_DT, SIGMA_LINEAR, SIGMA_ANGULAR = 2.0, 1.0, 1.0
FOLD = 4096  # samples that are folded in one array
ROUNDING = 1e-12  # of coordinates (as a share) and angles: what differs by less is equal


def rebase_first(frames: DataFrame, key: str = "traj_id", order: str = "t_ns") -> DataFrame:
    """Poses seen from the first one of their trajectory. The first is found by a partial aggregate."""
    first = frames.groupBy(key).agg(F.min_by("pose", order).alias("p0"))
    return frames.join(first, key).withColumn("pose", difference(F.col("pose"), F.col("p0")).col).drop("p0")


def transformed(frames: DataFrame, tf, key: str = "traj_id", order: str = "t_ns") -> DataFrame:
    """tf composed with (p seen from p0)."""
    return rebase_first(frames, key, order).withColumn("pose", compose(tf, F.col("pose")).col)


def rebased(frames: DataFrame, start, key: str = "traj_id", order: str = "t_ns") -> DataFrame:
    """(start seen from p0) composed with p."""
    first = frames.groupBy(key).agg(F.min_by("pose", order).alias("p0"))
    return frames.join(first, key).withColumn("pose", compose(difference(start, F.col("p0")), F.col("pose")).col).drop("p0")


def from_ypr_rows(rows: DataFrame) -> DataFrame:
    """``(…, x, y, z, yaw, pitch, roll)`` to ``(…, pose)``."""
    q = from_ypr(F.col("yaw"), F.col("pitch"), F.col("roll"))
    return rows.withColumn("pose", pose(vec(F.col("x"), F.col("y"), F.col("z")), q).col).drop("x", "y", "z", "yaw", "pitch", "roll")


def kitti_vehicle_frame(frames: DataFrame, cam0) -> DataFrame:
    """axisChange composed with gtCam0 composed with cam0 inverse; the axis change is ypr(-90, 0, -90) degrees."""
    half = F.lit(np.pi / 2)
    axis = pose(vec(0, 0, 0), from_ypr(-half, F.lit(0.0), -half))
    q = conjugate(cam0)
    t = rotate(q, cam0)
    return frames.withColumn("pose", compose(compose(axis, F.col("pose")), pose(vec(-t.x, -t.y, -t.z), q)).col)


def finite_twist(frames: DataFrame, key: str = "traj_id", order: str = "t_ns", max_dt: float = MAX_DT) -> DataFrame:
    """Twist between consecutive poses; null for the first and where dt >= max_dt. dt <= 0 is an error."""
    w = Window.partitionBy(key).orderBy(order)
    out = frames.withColumns({"_p": F.lag("pose").over(w), "dt": (F.col(order) - F.lag(order).over(w)) / F.lit(1e9)})
    ok = F.assert_true(F.col("dt").isNull() | (F.col("dt") > 0), F.lit("time must go on")).isNull()

    def rate(v: Column) -> Column:
        w = so3_log(v.inc)
        return F.struct(*((v.inc[c] / v.dt).alias(f"v{c}") for c in "xyz"), *((w[c] / v.dt).alias(f"w{c}") for c in "xyz"))

    # bound, so that each part is evaluated once and the generated code stays small
    moved = bind(F.struct(F.col("pose").alias("p"), F.col("_p").alias("q"), "dt"), lambda s: F.struct(difference(s.p, s.q).col.alias("inc"), s.dt.alias("dt")))
    dt = F.col("dt")
    return out.withColumn("twist", F.when(ok & dt.isNotNull() & (dt < max_dt), bind(moved, rate))).drop("_p")


def motion(twist, dt: Column) -> Column:
    """Pose that dt of constant twist moves by."""
    return pose(vec(twist.vx * dt, twist.vy * dt, twist.vz * dt), so3_exp(vec(twist.wx * dt, twist.wy * dt, twist.wz * dt))).col


def extrapolate_states(queries: DataFrame, states: DataFrame, key: str = "traj_id", time: str = "t_ns", max_dt: float = MAX_DT) -> DataFrame:
    """``(…, est)``: the state at or before each query's time, moved on to it; null without a twist or beyond max_dt.

    ``states(key, t_ns, pose, twist)``.
    """
    from waymark.operators.temporal import asof_join

    j = asof_join(queries, states, [key], time, ["pose", "twist"])
    dt = (F.col(time) - F.col(f"{time}_right")) / F.lit(1e9)
    j = j.withColumn("dt", dt)
    ok = F.col("twist").isNotNull() & F.col("pose").isNotNull() & (F.abs(F.col("dt")) <= max_dt)  # exactly max_dt still counts
    given = bind(F.struct("pose", "twist", "dt"), lambda s: F.struct(s.pose.alias("pose"), motion(s.twist, s.dt).alias("move")))
    return j.withColumn("est", F.when(ok, bind(given, lambda s: compose(s.pose, s.move).col))).drop("pose", "twist")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inverse6(cov: pd.Series) -> pd.Series:
    """Inverse of symmetric 6x6 matrices, row-major; null where there is none."""
    out: list = [None] * len(cov)
    good = [i for i, c in enumerate(cov) if c is not None and len(c) == 36]
    if good:
        m = np.stack([np.asarray(cov.iloc[i], float) for i in good]).reshape(-1, 6, 6)
        fine = np.isfinite(m).all(axis=(1, 2))
        least = np.zeros(len(m))
        least[fine] = np.linalg.eigvalsh(m[fine])[:, 0]
        fine &= least > 0  # positive definite
        for i, x in zip(np.array(good)[fine].tolist(), np.linalg.inv(m[fine]), strict=True):
            out[i] = x.ravel()
    return pd.Series(out, dtype=object)


def propagated_covariance(cov: Column, dt: Column, linear: float = SIGMA_LINEAR, angular: float = SIGMA_ANGULAR) -> Column:
    """Diagonal grown by (dt sigma)^2, the rest kept."""
    return F.transform(cov, lambda c, i: F.when(i % 7 == 0, grow_covariance(c, dt, 1.0) - dt * dt + (dt * F.when(i < 21, linear).otherwise(angular)) ** 2).otherwise(c))


def integrate_rotation(samples: DataFrame, key: str, order: Sequence[str], bias: tuple[float, float, float] = (0, 0, 0), sensor: Column | None = None) -> DataFrame:
    """``(key, dt, q, n)``: ordered product of the increments of angular rates ``(wx, wy, wz, dt)``, starting at identity.

    An ordered fold over each key's samples, ``FOLD`` at once; reset by a new key (keyframe).
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    lists = samples.withColumn("_chunk", F.floor(place / FOLD)).groupBy(key, "_chunk").agg(F.array_sort(F.collect_list(F.struct(*order, "wx", "wy", "wz", "dt"))).alias("l"))

    def step(acc: Column, s: Column) -> Column:
        w = vec(s.wx - bias[0], s.wy - bias[1], s.wz - bias[2])
        if sensor is not None:
            w = rotate(sensor, w)
        q = quat_mul(acc.q, so3_exp(vec(w.x * s.dt, w.y * s.dt, w.z * s.dt)))
        return F.struct((acc.dt + s.dt).alias("dt"), q.col.alias("q"))

    start = F.struct(F.lit(0.0).alias("dt"), F.struct(*(F.lit(v).alias(c) for c, v in zip(("qw", "qx", "qy", "qz"), (1.0, 0.0, 0.0, 0.0), strict=True))).alias("q"))
    # products of rotations are associative: chunks are folded apart, then their results in order
    parts = lists.select(key, "_chunk", F.aggregate("l", start, step).alias("r"), F.size("l").cast("long").alias("n"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "r"))).alias("l"), F.sum("n").alias("n"))
    total = F.aggregate("l", start, lambda acc, c: F.struct((acc.dt + c.r.dt).alias("dt"), quat_mul(acc.q, c.r.q).col.alias("q")))
    return whole.select(key, total.alias("r"), "n").select(key, "r.dt", "r.q", "n")


class Kept:
    """Keyframes of one trajectory by cell."""

    def __init__(self, distance: float, angle: float, poses: Sequence[Sequence[float]] = ()):
        self.distance, self.angle, self.cells = distance, angle, {}
        for p in poses:
            self._add(np.asarray(p, float))

    def _cell(self, p) -> tuple[int, int, int]:
        return tuple(int(np.floor(c / self.distance)) if self.distance > 0 else hash(float(c)) for c in p[:3])

    def _add(self, p: np.ndarray) -> None:
        self.cells.setdefault(self._cell(p), []).append(p)

    def _near(self, p: np.ndarray, reach: float) -> list[np.ndarray]:
        """Those of the cells that the box of ``reach`` around a pose meets."""
        if self.distance <= 0:
            return self.cells.get(self._cell(p), [])
        low, high = self._cell(p[:3] - reach), self._cell(p[:3] + reach)
        return [k for c in product(*(range(a, b + 1) for a, b in zip(low, high, strict=True))) for k in self.cells.get(c, ())]

    def offer(self, p: np.ndarray) -> bool:
        """Keeps a pose if none so far is within both limits; a pose at a limit is within, however its numbers were rounded."""
        reach = self.distance + ROUNDING * float(np.abs(p[:3]).max()) if self.distance > 0 else 0.0
        near = self._near(p, reach * (1 + ROUNDING))
        if near:
            kept = np.array(near)
            side = np.where(kept[:, 3:] @ p[3:] < 0, -1.0, 1.0)[:, None]
            angle = 4 * np.arcsin(np.minimum(1, np.linalg.norm(kept[:, 3:] - side * p[3:], axis=1) / 2))  # by the chord, exact for small ones too
            if ((np.linalg.norm(kept[:, :3] - p[:3], axis=1) <= reach) & (angle <= self.angle + ROUNDING)).any():
                return False
        self._add(p)
        return True


def keyframes(frames: DataFrame, key: str, order: str, distance: float, angle: float) -> DataFrame:
    """Greedy gating: a pose is a keyframe if no keyframe so far is within both the distance and the angle.

    Sequential by nature: each trajectory is streamed in order; only its keyframes are held, by cells as wide as the distance,
    so that a pose meets those of the cells within its reach.
    """
    flat = frames.select(key, order, *(F.col(f"pose.{c}").alias(c) for c in ("x", "y", "z", "qw", "qx", "qy", "qz")))

    def gate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, Kept(distance, angle)
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            poses = pdf[["x", "y", "z", "qw", "qx", "qy", "qz"]].to_numpy(float)
            for i, (k, p) in enumerate(zip(pdf[key], poses, strict=True)):
                if k != now:
                    now, kept = k, Kept(distance, angle)
                keep[i] = kept.offer(p)
            yield pdf[keep]

    return flat.repartition(key).sortWithinPartitions(key, order).mapInPandas(gate, flat.schema)


def point_in_map(points: DataFrame, pose_) -> DataFrame:
    """Points of a scan moved by the pose (both on insertion and for the likelihood)."""
    p = transform(pose_, vec(F.col("x"), F.col("y"), F.col("z")))
    return points.withColumns({c: p[c] for c in "xyz"})


def planar_pose(x, y, yaw):
    return pose(vec(x, y, 0), from_ypr(yaw, 0, 0))


def identity_pose():
    return pose_of(0, 0, 0, 1, 0, 0, 0)
