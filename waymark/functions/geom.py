"""Rigid-body algebra as Column expressions.

A pose column is ``struct<x,y,z,qw,qx,qy,qz: double>``, a vector column ``struct<x,y,z>``. Functions take such columns or the
``Parts`` that they return, whose components are plain expressions: nested calls then grow with the algebra and not
with the structs taken apart again. ``Parts.col`` makes a struct column of them. Everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSE = ("x", "y", "z", "qw", "qx", "qy", "qz")
#: Vertical correction of the KITTI scanners, in degrees (fixed value).
ELEVATION_DEG = 0.205


class Parts:
    """Named component expressions of a vector, rotation, pose or triple of angles."""

    def __init__(self, **parts: Column):
        self.__dict__.update(parts)
        self._names = tuple(parts)

    @property
    def col(self) -> Column:
        """A struct; null where any component is."""
        some = [getattr(self, n) for n in self._names]
        return F.when(~F.isnull(sum(some[1:], some[0])), F.struct(*(c.alias(n) for c, n in zip(some, self._names, strict=True))))

    def __getitem__(self, name: str) -> Column:
        return getattr(self, name)


def vec(x, y, z) -> Parts:
    return Parts(**dict(zip("xyz", (_lit(c).cast("double") for c in (x, y, z)), strict=True)))


def quat(w, x, y, z) -> Parts:
    return Parts(**dict(zip(POSE[3:], (_lit(c).cast("double") for c in (w, x, y, z)), strict=True)))


def pose(t, q) -> Parts:
    return Parts(**{n: t[n] for n in "xyz"}, **{n: q[n] for n in POSE[3:]})


def pose_of(x, y, z, qw, qx, qy, qz) -> Parts:
    return Parts(**dict(zip(POSE, (_lit(c).cast("double") for c in (x, y, z, qw, qx, qy, qz)), strict=True)))


def choose(condition: Column, a, b) -> Parts:
    return Parts(**{n: F.when(condition, a[n]).otherwise(b[n]) for n in a._names})


def _lit(c) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


def identity() -> Parts:
    return pose_of(0, 0, 0, 1, 0, 0, 0)


# --- rotations ------------------------------------------------------------------------------------------------------


def quat_mul(a, b) -> Parts:
    return quat(
        a.qw * b.qw - a.qx * b.qx - a.qy * b.qy - a.qz * b.qz,
        a.qw * b.qx + a.qx * b.qw + a.qy * b.qz - a.qz * b.qy,
        a.qw * b.qy - a.qx * b.qz + a.qy * b.qw + a.qz * b.qx,
        a.qw * b.qz + a.qx * b.qy - a.qy * b.qx + a.qz * b.qw,
    )


def conjugate(q) -> Parts:
    return quat(q.qw, -q.qx, -q.qy, -q.qz)


def rotate(q, p) -> Parts:
    """R(q) p."""
    cx, cy, cz = (q.qy * p.z - q.qz * p.y) * 2, (q.qz * p.x - q.qx * p.z) * 2, (q.qx * p.y - q.qy * p.x) * 2
    return vec(
        p.x + q.qw * cx + (q.qy * cz - q.qz * cy),
        p.y + q.qw * cy + (q.qz * cx - q.qx * cz),
        p.z + q.qw * cz + (q.qx * cy - q.qy * cx),
    )


def from_ypr(yaw, pitch, roll) -> Parts:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    y, p, r = (_lit(c) / 2 for c in (yaw, pitch, roll))
    cy, sy, cp, sp, cr, sr = F.cos(y), F.sin(y), F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    return quat(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def to_ypr(q) -> Parts:
    """Parts yaw, pitch and roll, in radians."""
    yaw = F.atan2(2 * (q.qw * q.qz + q.qx * q.qy), 1 - 2 * (q.qy * q.qy + q.qz * q.qz))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (q.qw * q.qy - q.qz * q.qx))))
    roll = F.atan2(2 * (q.qw * q.qx + q.qy * q.qz), 1 - 2 * (q.qx * q.qx + q.qy * q.qy))
    return Parts(yaw=yaw, pitch=pitch, roll=roll)


def rotation_matrix(q) -> Column:
    """array<double> of nine, row-major."""
    w, x, y, z = q.qw, q.qx, q.qy, q.qz
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def from_rotation(m: list[Column]) -> Parts:
    """Quaternion of a row-major 3x3 rotation, by its largest component."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    tr = m00 + m11 + m22
    s0 = F.sqrt(F.greatest(tr + 1, F.lit(1e-300))) * 2
    s1 = F.sqrt(F.greatest(1 + m00 - m11 - m22, F.lit(1e-300))) * 2
    s2 = F.sqrt(F.greatest(1 + m11 - m00 - m22, F.lit(1e-300))) * 2
    s3 = F.sqrt(F.greatest(1 + m22 - m00 - m11, F.lit(1e-300))) * 2
    by_trace = quat(s0 / 4, (m21 - m12) / s0, (m02 - m20) / s0, (m10 - m01) / s0)
    by_x = quat((m21 - m12) / s1, s1 / 4, (m01 + m10) / s1, (m02 + m20) / s1)
    by_y = quat((m02 - m20) / s2, (m01 + m10) / s2, s2 / 4, (m12 + m21) / s2)
    by_z = quat((m10 - m01) / s3, (m02 + m20) / s3, (m12 + m21) / s3, s3 / 4)
    return choose(tr > 0, by_trace, choose((m00 >= m11) & (m00 >= m22), by_x, choose(m11 >= m22, by_y, by_z)))


def so3_log(q) -> Parts:
    """Rotation vector, shortest way round."""
    sign = F.when(q.qw < 0, -1.0).otherwise(1.0)
    n = F.sqrt(q.qx * q.qx + q.qy * q.qy + q.qz * q.qz)
    k = F.when(n < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(n, sign * q.qw) / n) * sign
    return vec(k * q.qx, k * q.qy, k * q.qz)


def so3_exp(w) -> Parts:
    """Quaternion of a rotation vector."""
    a = F.sqrt(w.x * w.x + w.y * w.y + w.z * w.z)
    k = F.when(a < 1e-12, F.lit(0.5) - a * a / 48).otherwise(F.sin(a / 2) / a)
    return quat(F.cos(a / 2), k * w.x, k * w.y, k * w.z)


def rotation_angle(q) -> Column:
    n = F.sqrt(q.qx * q.qx + q.qy * q.qy + q.qz * q.qz)
    return 2 * F.atan2(n, F.abs(q.qw))


def trace_angle(q) -> Column:
    """acos of the clamped (trace - 1) / 2."""
    half = (4 * q.qw * q.qw - 2) / 2
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), half)))


def bind(value: Column, fn) -> Column:
    """fn of a value that is evaluated once, however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def slerp(a, b, u: Column) -> Column:
    """Rotation column on the shortest path; nearly equal rotations are interpolated linearly and normalised."""
    given = F.struct(*(a[n].alias(f"a_{n}") for n in POSE[3:]), *(b[n].alias(f"b_{n}") for n in POSE[3:]), u.cast("double").alias("u"))

    def with_sign(s: Column) -> Column:
        dot = sum((s[f"a_{n}"] * s[f"b_{n}"] for n in POSE[4:]), s.a_qw * s.b_qw)
        return F.struct(s.alias("s"), F.when(dot < 0, -1.0).otherwise(1.0).alias("sign"))

    def with_angle(v: Column) -> Column:
        gap = [v.s[f"a_{n}"] - v.sign * v.s[f"b_{n}"] for n in POSE[3:]]
        half = F.least(F.lit(1.0), F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0])) / 2)
        return F.struct(v.s.alias("s"), v.sign.alias("sign"), (2 * F.asin(half)).alias("theta"))

    def weighted(v: Column) -> Column:
        near, t, w = v.theta < 1e-7, v.theta, v.s.u
        ka = F.when(near, 1 - w).otherwise(F.sin((1 - w) * t) / F.sin(t))
        kb = F.when(near, w).otherwise(F.sin(w * t) / F.sin(t)) * v.sign
        return F.struct(*((ka * v.s[f"a_{n}"] + kb * v.s[f"b_{n}"]).alias(n) for n in POSE[3:]))

    def normalised(q: Column) -> Column:
        norm = F.sqrt(sum((q[n] * q[n] for n in POSE[4:]), q.qw * q.qw))
        return F.struct(*((q[n] / norm).alias(n) for n in POSE[3:]))

    return bind(bind(bind(bind(given, with_sign), with_angle), weighted), normalised)


# --- poses ----------------------------------------------------------------------------------------------------------


def transform(a, p) -> Parts:
    """a applied to a point."""
    r = rotate(a, p)
    return vec(a.x + r.x, a.y + r.y, a.z + r.z)


def compose(a, b) -> Parts:
    return pose(transform(a, b), quat_mul(a, b))


def inverse(a) -> Parts:
    q = conjugate(a)
    t = rotate(q, a)
    return pose(vec(-t.x, -t.y, -t.z), q)


def difference(b, a) -> Parts:
    """b seen from a: inverse(a) composed with b."""
    q = conjugate(a)
    return pose(rotate(q, vec(b.x - a.x, b.y - a.y, b.z - a.z)), quat_mul(q, b))


def interpolate(a, b, u: Column) -> Parts:
    return pose(vec(*(a[n] + u * (b[n] - a[n]) for n in "xyz")), slerp(a, b, u))


def from_matrix12(m: Column) -> Parts:
    """Pose of a row-major 3x4 matrix, ``array<double>`` of twelve."""
    return pose(vec(m[3], m[7], m[11]), from_rotation([m[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)]))


def to_matrix12(a) -> Column:
    r = rotation_matrix(a)
    return F.array(r[0], r[1], r[2], a.x, r[3], r[4], r[5], a.y, r[6], r[7], r[8], a.z)


def norm(v) -> Column:
    return F.sqrt(v.x * v.x + v.y * v.y + v.z * v.z)


def squared_distance(a, b) -> Column:
    return (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)


def to_planar(a) -> Parts:
    """Parts x, y and yaw of an odometry pose."""
    return Parts(x=a.x, y=a.y, yaw=to_ypr(a).yaw)


# --- sensors --------------------------------------------------------------------------------------------------------


def correct_elevation(p, degrees: float = ELEVATION_DEG) -> Parts:
    """Rotates a point by a small angle about p x z, which lifts its elevation; points on the z axis stay."""
    n = F.sqrt(p.x * p.x + p.y * p.y)
    a = F.radians(F.lit(degrees))
    # axis k = (y, -x, 0)/n is normal to p: p' = p cos + (k x p) sin
    ux, uy = p.y / n, -p.x / n
    c, s = F.cos(a), F.sin(a)
    moved = vec(p.x * c + uy * p.z * s, p.y * c - ux * p.z * s, p.z * c + (ux * p.y - uy * p.x) * s)
    return choose(n > 0, moved, p)


def range_image_cell(p, rows: int, columns: int, down_deg: float = 24.8, up_deg: float = 2.0) -> Column:
    """struct<row,col> of the range image; null where the pitch has no arc sine (|z| above the horizontal range)."""
    flat = F.sqrt(p.x * p.x + p.y * p.y)
    ratio = F.when((flat > 0) & (F.abs(p.z) <= flat), p.z / flat)
    down, fov = F.radians(F.lit(down_deg)), F.radians(F.lit(down_deg + up_deg))
    row = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor((F.asin(ratio) + down) / fov * rows).cast("int")))
    turn = columns * (F.atan2(p.y, p.x) + F.pi()) / (2 * F.pi())
    column = F.least(F.lit(columns - 1), F.greatest(F.lit(0), turn.cast("int")))
    return F.when(ratio.isNotNull(), F.struct(row.alias("row"), column.alias("col")))


def ring_of(p, rings: int = 32, down_deg: float = 36.374, up_deg: float = 10.860, near: float = 0.05) -> Column:
    """Ring number by pitch, saturated; null for near points and those without a pitch."""
    flat = F.sqrt(p.x * p.x + p.y * p.y)
    ratio = F.when((flat >= near) & (F.abs(p.z) <= flat), p.z / flat)
    down, fov = F.radians(F.lit(down_deg)), F.radians(F.lit(down_deg + up_deg))
    ring = F.rint((rings - 1) * (F.asin(ratio) + down) / fov).cast("int")
    return F.when(ratio.isNotNull(), F.least(F.lit(rings - 1), F.greatest(F.lit(0), ring)))


def azimuth_time(p, sweep: float = 0.1) -> Column:
    """Time of a point in a sweep by its azimuth, from -sweep/2."""
    return F.lit(-sweep / 2) * (F.atan2(p.y, p.x) + F.pi()) / (2 * F.pi())


def sweep_time(index: Column, sweep: float = 0.1, rings: int = 64, columns: int = 1024) -> Column:
    """struct<ring,t> of a point by its place in an organised scan."""
    turn = F.floor(index / rings)
    return F.struct((index % rings).cast("int").alias("ring"), (F.lit(-sweep / 2) + F.lit(sweep) * turn / columns).alias("t"))


def grow_covariance(diagonal: Column, dt: Column, sigma: float) -> Column:
    """A diagonal entry after dt of random-walk acceleration."""
    return diagonal + (dt * sigma) * (dt * sigma)
