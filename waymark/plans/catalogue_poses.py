"""Queries that hold whole poses, rotations, identifiers and covariances against their formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import cells, geom
from waymark.operators import graph, maps, trajectory
from waymark.plans.catalogue import C, P, T, points, query, r6
from waymark.plans.catalogue_maps import SIZE, xyz
from waymark.plans.catalogue_time import entities, frames

# rotation about z by x, then about the new y by y, then about the new x by z
ROT = f"""{P}, a AS (SELECT id, x, y, z, cos(x) AS cy, sin(x) AS sy, cos(y) AS cp, sin(y) AS sp, cos(z) AS cr, sin(z) AS sr FROM p),
r AS (SELECT *, cy * cp AS r00, cy * sp * sr - sy * cr AS r01, cy * sp * cr + sy * sr AS r02, sy * cp AS r10, sy * sp * sr + cy * cr AS r11, sy * sp * cr - cy * sr AS r12, -sp AS r20, cp * sr AS r21, cp * cr AS r22 FROM a)"""
ENTRIES = [f"r{i}{j}" for i in range(3) for j in range(3)]


def posed(spark, sf):
    """``(id, x, y, z, a)``: the point as a place and, as yaw, pitch and roll, a rotation."""
    return points(spark, sf).select("id", "x", "y", "z", geom.pose(xyz(), geom.from_ypr(F.col("x"), F.col("y"), F.col("z"))).col.alias("a"))


@query("pose_matrix", f"WITH {ROT} SELECT id, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in ENTRIES)}, round(x, 6) + 0e0 AS tx, round(y, 6) + 0e0 AS ty, round(z, 6) + 0e0 AS tz FROM r")
def pose_matrix(spark, sf):
    m = posed(spark, sf).select("id", geom.to_matrix12(F.col("a")).alias("m"))
    names = [*ENTRIES[:3], "tx", *ENTRIES[3:6], "ty", *ENTRIES[6:], "tz"]
    return m.select("id", *(r6(F.col("m")[i]).alias(c) for i, c in enumerate(names)))


@query("pose_inverse", f"WITH {ROT} SELECT id, round(-(r00 * x + r10 * y + r20 * z), 6) + 0e0 AS tx, round(-(r01 * x + r11 * y + r21 * z), 6) + 0e0 AS ty, round(-(r02 * x + r12 * y + r22 * z), 6) + 0e0 AS tz, round(r10, 6) + 0e0 AS r01, round(r20, 6) + 0e0 AS r02, round(r21, 6) + 0e0 AS r12 FROM r")
def pose_inverse(spark, sf):
    """The inverse has the transposed rotation."""
    b = posed(spark, sf).select("id", geom.inverse(F.col("a")).col.alias("b")).withColumn("m", geom.to_matrix12(F.col("b")))
    return b.select("id", *(r6(f"b.{c}").alias(f"t{c}") for c in "xyz"), *(r6(F.col("m")[i]).alias(c) for i, c in ((1, "r01"), (2, "r02"), (6, "r12"))))


@query("pose_angle", f"WITH {ROT}, g AS (SELECT id, acos(greatest(-1e0, least(1e0, (r00 + r11 + r22 - 1) / 2))) AS angle FROM r) SELECT id, CASE WHEN angle > 1e-1 THEN round(angle, 5) ELSE 0e0 END AS angle FROM g")
def pose_angle(spark, sf):
    """Angles by the trace; 0 where the rotation is nearly none, as the trace is no measure there."""
    angle = geom.bind(geom.from_ypr(F.col("x"), F.col("y"), F.col("z")).col, geom.rotation_angle)
    return points(spark, sf).select("id", angle.alias("angle")).select("id", F.when(F.col("angle") > 0.1, r6("angle", 5)).otherwise(0.0).alias("angle"))


@query("so3_quaternion", f"WITH {P}, a AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM p) SELECT id, round(cos(n / 2), 6) + 0e0 AS qw, round(sin(n / 2) / n * x, 6) + 0e0 AS qx, round(sin(n / 2) / n * y, 6) + 0e0 AS qy, round(sin(n / 2) / n * z, 6) + 0e0 AS qz FROM a WHERE n > 1e-3")
def so3_quaternion(spark, sf):
    q = points(spark, sf).where("sqrt(x * x + y * y + z * z) > 1e-3").select("id", geom.so3_exp(xyz()).col.alias("q"))
    return q.select("id", *(r6(f"q.{c}").alias(c) for c in ("qw", "qx", "qy", "qz")))


def packed(spark, sf, limit: int, sub_bits: int, cell_bits: int):
    p = maps.downsample(points(spark, sf), SIZE, limit)
    return p.select("id", cells.pack_point_id(F.col("sub"), F.col("cx"), F.col("cy"), F.col("cz"), sub_bits, cell_bits).alias("point_id")).where("point_id is not null")


NUMBERED = f"{C}, n AS (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY seq) - 1 AS k FROM c)"


@query("point_id_hashed", f"WITH {NUMBERED} SELECT id, k::BIGINT | (cx::BIGINT << 5) | (cy::BIGINT << 25) | (cz::BIGINT << 45) AS point_id FROM n WHERE k < 32 AND cx >= 0 AND cy >= 0 AND cz >= 0")
def point_id_hashed(spark, sf):
    return packed(spark, sf, 32, 5, 20)


@query("point_id_grid", f"WITH {NUMBERED} SELECT id, k::BIGINT | (cx::BIGINT << 20) | (cy::BIGINT << 34) | (cz::BIGINT << 48) AS point_id FROM n WHERE k < 32 AND cx >= 0 AND cy >= 0 AND cz >= 0")
def point_id_grid(spark, sf):
    return packed(spark, sf, 32, 20, 14)


@query("entity_twist_update", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus NOT IN ('O', 'F') THEN o_orderkey::DOUBLE ELSE o_totalprice END AS vx FROM orders")
def entity_twist_update(spark, sf):
    e = entities(spark, sf)
    zero = {c: F.lit(0.0) for c in ("vy", "vz", "wx", "wy", "wz")}
    new = e.where("id % 3 = 0").select("id", F.struct(F.col("id").cast("double").alias("vx"), *(v.alias(c) for c, v in zero.items())).alias("new_twist"))
    return graph.update_twist(e, new).select("id", F.col("twist.vx").alias("vx"))


@query("twist_in_body", f"""WITH {T}, z AS (SELECT *, lag(value) OVER w AS v0, (dist - lag(dist) OVER w) / 100 AS d, (t_us - lag(t_us) OVER w) / 1e6 AS dt FROM f WINDOW w AS (PARTITION BY traj_id ORDER BY frame))
SELECT event_id, round(1e3 * cos(v0 / 1000) * d / dt, 6) + 0e0 AS vx, round(-1e3 * sin(v0 / 1000) * d / dt, 6) + 0e0 AS vy, round(1e3 * (value - v0) / 1000 / dt, 6) + 0e0 AS wz FROM z WHERE dt < 864000""")
def twist_in_body(spark, sf):
    """All that a planar twist has, a thousandfold: the step as the frame before sees it, and the turn."""
    f = frames(spark, sf)
    f = f.select("traj_id", "event_id", (F.col("t_us") * 1000).alias("t_ns"), trajectory.planar_pose(F.col("dist") / 100, F.lit(0.0), F.col("value") / 1000).col.alias("pose"))
    out = trajectory.finite_twist(f, max_dt=864_000.0).where("twist is not null")
    return out.select("event_id", *(r6(F.col(f"twist.{c}") * 1000).alias(c) for c in ("vx", "vy", "wz")))


# the inverse of the unit matrix plus a column times itself is known in closed form
@query("covariance_inverse_full", f"WITH {P}, n AS (SELECT *, 1 + 2 * (x * x + y * y + z * z) AS n FROM p) SELECT id, round(1 - x * x / n, 6) + 0e0 AS i00, round(-x * y / n, 6) + 0e0 AS i01, round(-z * z / n, 6) + 0e0 AS i23, round(1 - x * x / n, 6) + 0e0 AS i44, round(-x * y / n, 6) + 0e0 AS i50 FROM n")
def covariance_inverse_full(spark, sf):
    u = [F.col(c) for c in "xyzzxy"]
    dense = F.array(*(u[i] * u[j] + (1.0 if i == j else 0.0) for i in range(6) for j in range(6)))
    inv = points(spark, sf).select("id", trajectory.inverse6(dense).alias("m"))
    return inv.select("id", *(r6(F.col("m")[6 * i + j]).alias(f"i{i}{j}") for i, j in ((0, 0), (0, 1), (2, 3), (4, 4), (5, 0))))
