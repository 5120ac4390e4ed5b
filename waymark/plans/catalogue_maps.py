"""Queries on points, cells, poses and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import cells, geom
from waymark.operators import maps, spatial, trajectory
from waymark.plans.catalogue import CH, CR, C, P, points, query, r6, table

SIZE = 0.1


@query("voxel_downsample", f"WITH {C} SELECT id, cx, cy, cz, (sub)::INTEGER AS sub FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY seq) - 1 AS sub FROM c) WHERE sub < 3")
def voxel_downsample(spark, sf):
    return maps.downsample(points(spark, sf), SIZE, 3).select("id", "cx", "cy", "cz", "sub")


@query("voxel_round", f"WITH {CR} SELECT id, cx, cy, cz, (sub)::INTEGER AS sub FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY seq) - 1 AS sub FROM c) WHERE sub < 16")
def voxel_round(spark, sf):
    return maps.downsample(points(spark, sf), SIZE, 0, "round", hard_cap=maps.SPARSE_CAP).select("id", "cx", "cy", "cz", "sub")


@query("voxel_half_shift", f"WITH {CH} SELECT cx, cy, cz, count(*) AS n FROM c GROUP BY cx, cy, cz")
def voxel_half_shift(spark, sf):
    return cells.with_cells(points(spark, sf), SIZE, "half_shift").groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))


@query("voxel_floor", f"WITH {P} SELECT floor(x * 10e0)::INTEGER AS cx, floor(y * 10e0)::INTEGER AS cy, floor(z * 10e0)::INTEGER AS cz, count(*) AS n FROM p GROUP BY ALL")
def voxel_floor(spark, sf):
    return cells.with_cells(points(spark, sf), SIZE, "floor").groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))


MEANS = "m AS (SELECT cx, cy, cz, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY seq) AS k FROM c) WHERE k <= 16 GROUP BY ALL)"


@query("voxel_means", f"WITH {CR}, {MEANS} SELECT cx, cy, cz, n, round(mx, 6) + 0e0 AS mx, round(my, 6) + 0e0 AS my, round(mz, 6) + 0e0 AS mz FROM m")
def voxel_means(spark, sf):
    return maps.voxel_means(points(spark, sf), SIZE).select("cx", "cy", "cz", "n", *(r6(c).alias(c) for c in ("mx", "my", "mz")))


@query("match_means", f"WITH {CR}, {MEANS} SELECT id AS query_id, n, round((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2, 6) + 0e0 AS d2 FROM c JOIN m USING (cx, cy, cz)")
def match_means(spark, sf):
    p = points(spark, sf)
    return spatial.match_means(p, maps.voxel_means(p, SIZE), SIZE).select("query_id", "n", r6("d2").alias("d2"))


@query("voxel_counts", f"WITH {C} SELECT count(*) AS voxels, coalesce(sum(least(n, 32)), 0)::BIGINT AS points FROM (SELECT count(*) AS n FROM c GROUP BY cx, cy, cz)")
def voxel_counts(spark, sf):
    return maps.voxel_counts(points(spark, sf), SIZE)


@query("voxel_blocks", f"""WITH {P}, g AS (SELECT round_even(x * 100e0, 0)::INTEGER AS cx, round_even(y * 100e0, 0)::INTEGER AS cy, round_even(z * 100e0, 0)::INTEGER AS cz FROM p)
SELECT cx & -32 AS bx, cy & -32 AS by, cz & -32 AS bz, count(*) AS points, count(DISTINCT (cx & 31) + (cy & 31) * 32 + (cz & 31) * 1024) AS voxels FROM g GROUP BY ALL""")
def voxel_blocks(spark, sf):
    return maps.block_sizes(points(spark, sf), 0.01)


@query("voxel_origins", f"WITH {CH} SELECT DISTINCT cx, cy, cz, round((cx - 0.5e0) * 1e-1, 6) + 0e0 AS ox, round((cy - 0.5e0) * 1e-1, 6) + 0e0 AS oy, round((cz - 0.5e0) * 1e-1, 6) + 0e0 AS oz FROM c")
def voxel_origins(spark, sf):
    at = cells.with_cells(points(spark, sf), SIZE, "half_shift").select("cx", "cy", "cz").distinct()
    return at.select("*", *(r6(cells.cell_origin(F.col(f"c{c}"), SIZE, "half_shift")).alias(f"o{c}") for c in "xyz"))


@query("point_bbox", f"WITH {P} SELECT coalesce(min(x), 0e0) AS min_x, coalesce(min(y), 0e0) AS min_y, coalesce(min(z), 0e0) AS min_z, coalesce(max(x), 0e0) AS max_x, coalesce(max(y), 0e0) AS max_y, coalesce(max(z), 0e0) AS max_z FROM p")
def point_bbox(spark, sf):
    return maps.bounding_box(points(spark, sf))


@query("point_bbox_empty", "SELECT 0e0 AS min_x, 0e0 AS min_y, 0e0 AS min_z, 0e0 AS max_x, 0e0 AS max_y, 0e0 AS max_z")
def point_bbox_empty(spark, sf):
    return maps.bounding_box(points(spark, sf).where("id < 0"))


@query("roi_square", f"""WITH {P}, s AS (SELECT min(x * 1000e0) AS lx, max(x * 1000e0) AS hx, min(y * 1000e0) AS ly, max(y * 1000e0) AS hy FROM p),
h AS (SELECT *, 0.5e0 * 1.1e0 * greatest(hx - lx, hy - ly) AS half FROM s)
SELECT trunc((lx + hx) / 2e0 - half)::INTEGER AS x0, trunc((lx + hx) / 2e0 + half)::INTEGER AS x1, trunc((ly + hy) / 2e0 - half)::INTEGER AS y0, trunc((ly + hy) / 2e0 + half)::INTEGER AS y1 FROM h""")
def roi_square(spark, sf):
    from waymark.operators.metrics import roi_square as square

    return square(points(spark, sf).select((F.col("x") * 1000.0).alias("x"), (F.col("y") * 1000.0).alias("y")))


PAIRS27 = f"""WITH {C}, o AS (SELECT a.v AS dx, b.v AS dy, c2.v AS dz FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) c2(v)),
q AS (SELECT id AS query_id, x AS qx, y AS qy, z AS qz, cx + dx AS cx, cy + dy AS cy, cz + dz AS cz FROM c, o),
j AS (SELECT query_id, id AS match_id, (qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z) AS d2 FROM q JOIN c USING (cx, cy, cz) WHERE query_id <> id)"""


@query("knn_cells_k3", f"{PAIRS27} SELECT query_id, match_id, round(d2, 6) AS d2, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, match_id) AS rank FROM j) WHERE rank <= 3")
def knn_cells_k3(spark, sf):
    p = points(spark, sf)
    return spatial.knn_join(p, p, SIZE, 3, drop_self=True).select("query_id", "match_id", r6("d2").alias("d2"), "rank")


RADIUS = f"""WITH {P}, j AS (SELECT a.id AS query_id, b.id AS match_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 5e-2)"""


@query("radius_join", f"{RADIUS} SELECT query_id, match_id, round(d2, 6) AS d2 FROM j WHERE d2 <= 5e-2 * 5e-2")
def radius_join(spark, sf):
    p = points(spark, sf)
    return spatial.radius_join(p, p, SIZE, 0.05, drop_self=True).select("query_id", "match_id", r6("d2").alias("d2"))


@query("radius_top3", f"{RADIUS} SELECT query_id, match_id, round(d2, 6) AS d2, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, match_id) AS rank FROM j WHERE d2 <= 5e-2 * 5e-2) WHERE rank <= 3")
def radius_top3(spark, sf):
    p = points(spark, sf)
    return spatial.radius_join(p, p, SIZE, 0.05, max_points=3, drop_self=True).select("query_id", "match_id", r6("d2").alias("d2"), "rank")


@query("nn_cell_only", f"WITH {CH}, j AS (SELECT a.id AS query_id, b.id AS match_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM c a JOIN c b USING (cx, cy, cz) WHERE a.id <> b.id) SELECT query_id, match_id, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, match_id) AS k FROM j) WHERE k = 1")
def nn_cell_only(spark, sf):
    p = points(spark, sf)
    return spatial.nearest_in_cell(p, p, SIZE, drop_self=True).select("query_id", "match_id", r6("d2").alias("d2"))


@query("scan_likelihood", f"""WITH {C}, s AS (SELECT * FROM c WHERE label >= 5 AND seq % 10 = 0), o AS (SELECT a.v AS dx, b.v AS dy, c2.v AS dz FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) c2(v)),
q AS (SELECT id AS query_id, x AS qx, y AS qy, z AS qz, cx + dx AS cx, cy + dy AS cy, cz + dz AS cz FROM s, o),
j AS (SELECT query_id, min((qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z)) AS d2 FROM q JOIN (SELECT * FROM c WHERE label < 5) USING (cx, cy, cz) GROUP BY query_id)
SELECT count(*) AS points, round(coalesce(-sum(least(coalesce(d2, 0e0), 4e-2 * 4e-2)) / count(*) / 5e-1, 0e0), 9) + 0e0 AS log_likelihood FROM s LEFT JOIN j ON s.id = j.query_id""")
def scan_likelihood(spark, sf):
    p = points(spark, sf, label=True)
    scan = maps.decimate_points(p.where("label >= 5"), 10)
    best = spatial.knn_join(scan.drop("label", "seq"), p.where("label < 5"), SIZE, 1).select(F.col("query_id").alias("id"), "d2")
    out = maps.scan_likelihood(scan.join(best, "id", "left"), 0.5, 0.04)
    return out.select("points", r6("log_likelihood", 9).alias("log_likelihood"))


@query("voxel_prune_chebyshev", f"WITH {C} SELECT DISTINCT cx, cy, cz FROM c WHERE greatest(abs(cx - 1), abs(cy - 0), abs(cz - 0)) <= 2")
def voxel_prune_chebyshev(spark, sf):
    c = cells.with_cells(points(spark, sf), SIZE).select("cx", "cy", "cz").distinct()
    return maps.prune_far(c, SIZE, (0.15, 0.0, 0.0), 0.15)


@query("grid_prune_box", f"WITH {CH} SELECT id, cx, cy, cz FROM c WHERE cx BETWEEN -1 AND 1 AND cy BETWEEN 0 AND 2 AND cz BETWEEN -2 AND 0")
def grid_prune_box(spark, sf):
    return maps.prune_box(cells.with_cells(points(spark, sf), SIZE, "half_shift"), (-1, 0, -2), (1, 2, 0)).select("id", "cx", "cy", "cz")


@query("pose_prune", f"WITH {P} SELECT id FROM p WHERE x * x + y * y + z * z <= 3e-2 * 1e0")
def pose_prune(spark, sf):
    p = points(spark, sf).select("id", geom.pose_of(F.col("x"), F.col("y"), F.col("z"), 1, 0, 0, 0).col.alias("pose"))
    return spatial.prune_poses(p, (0.0, 0.0, 0.0), 0.03**0.5).select("id")


@query("point_id_pack", f"WITH {C} SELECT id, (k & 15)::BIGINT | (cx::BIGINT << 4) | (cy::BIGINT << 24) | (cz::BIGINT << 44) AS point_id FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY seq) - 1 AS k FROM c) WHERE k < 16 AND cx >= 0 AND cy >= 0 AND cz >= 0")
def point_id_pack(spark, sf):
    p = maps.downsample(points(spark, sf), SIZE, 16)
    packed = cells.pack_point_id(F.col("sub"), F.col("cx"), F.col("cy"), F.col("cz"), 4, 20)
    return p.select("id", packed.alias("point_id")).where("point_id is not null")


@query("spatial_hash", f"WITH {C} SELECT id, xor(xor((cx::BIGINT * 73856093) & 4294967295, (cy::BIGINT * 19349663) & 4294967295), (cz::BIGINT * 83492791) & 4294967295) & 1048575 AS hash FROM c")
def spatial_hash(spark, sf):
    c = cells.with_cells(points(spark, sf), SIZE)
    return c.select("id", cells.spatial_hash(F.col("cx"), F.col("cy"), F.col("cz")).alias("hash"))


@query("clearance_insert", f"WITH {CH}, b AS (SELECT * FROM c WHERE label < 5), s AS (SELECT * FROM c WHERE label >= 5) SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.cx = s.cx AND b.cy = s.cy AND b.cz = s.cz AND (s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y) + (s.z - b.z) * (s.z - b.z) <= 5e-2 * 5e-2)")
def clearance_insert(spark, sf):
    p = points(spark, sf, label=True)
    return maps.clearance_insert(p.where("label >= 5"), p.where("label < 5"), SIZE, 0.05).select("id")


GREEDY = f"""WITH {C}, l AS (SELECT cx, cy, cz, list([{{'seq': seq, 'x': x, 'y': y, 'z': z}}] ORDER BY seq) AS pts FROM c GROUP BY ALL),
k AS (SELECT cx, cy, cz, list_reduce(pts, lambda kept, p: CASE WHEN len(kept) >= {maps.HASHED_CAP} OR len(list_filter(kept, lambda k: (k.x - p[1].x) * (k.x - p[1].x) + (k.y - p[1].y) * (k.y - p[1].y) + (k.z - p[1].z) * (k.z - p[1].z) < 4e-2 * 4e-2)) > 0 THEN kept ELSE list_concat(kept, p) END) AS kept FROM l)
SELECT unnest(list_transform(kept, lambda k: k.seq)) AS seq, cx, cy, cz FROM k"""


@query("min_distance_insert", GREEDY)
def min_distance_insert(spark, sf):
    return maps.min_distance_insert(points(spark, sf), SIZE, 0.04).select("seq", "cx", "cy", "cz")


HIST = f"h AS (SELECT least(floor((x - lo) / (hi - lo) * 100), 99)::INTEGER AS bin, count(*) AS n FROM p, (SELECT min(x) AS lo, max(x) AS hi FROM p) GROUP BY ALL)"


@query("colour_histogram", f"WITH {P}, {HIST} SELECT bin, n FROM h")
def colour_histogram(spark, sf):
    return maps.histogram(points(spark, sf), "x")


@query("colour_range", f"WITH {P}, {HIST}, c AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t FROM h) SELECT min(bin) AS low_bin, max(bin) AS high_bin FROM c WHERE c > 2e-2 * t AND t - c + n > 2e-2 * t")
def colour_range(spark, sf):
    return maps.confidence_range(maps.histogram(points(spark, sf), "x"))


@query("occupancy_grid", f"WITH {P} SELECT floor(x * 10e0)::INTEGER AS ix, floor(y * 10e0)::INTEGER AS iy, round(greatest(-4.6e0, least(4.6e0, sum(CASE WHEN z > 0 THEN 847e-3 ELSE -405e-3 END))), 6) + 0e0 AS log_odds FROM p GROUP BY ALL")
def occupancy_grid(spark, sf):
    return maps.occupancy(points(spark, sf).withColumn("occupied", F.col("z") > 0), SIZE).select("ix", "iy", r6("log_odds").alias("log_odds"))


@query("map_text", f"WITH {P} SELECT format('{{:.6f}} {{:.6f}} {{:.6f}}', x, y, z) AS value FROM p")
def map_text(spark, sf):
    from waymark.sources.sinks import map_lines

    return map_lines(points(spark, sf))


# --- geometry -------------------------------------------------------------------------------------------------------


def xyz():
    return geom.vec(F.col("x"), F.col("y"), F.col("z"))


@query("transform_points", f"WITH {P} SELECT id, round(1e0 + cos(5e-1) * x - sin(5e-1) * y, 6) + 0e0 AS x, round(2e0 + sin(5e-1) * x + cos(5e-1) * y, 6) + 0e0 AS y, round(3e0 + z, 6) + 0e0 AS z FROM p")
def transform_points(spark, sf):
    at = geom.pose(geom.vec(1, 2, 3), geom.from_ypr(0.5, 0.0, 0.0))
    return trajectory.point_in_map(points(spark, sf), at).select("id", *(r6(c).alias(c) for c in "xyz"))


@query("pose_compose_planar", f"WITH {P} SELECT id, round(x + cos(z) * y - sin(z) * x, 6) + 0e0 AS px, round(y + sin(z) * y + cos(z) * x, 6) + 0e0 AS py, round(2 * z, 6) + 0e0 AS yaw FROM p")
def pose_compose_planar(spark, sf):
    a = trajectory.planar_pose(F.col("x"), F.col("y"), F.col("z"))
    b = trajectory.planar_pose(F.col("y"), F.col("x"), F.col("z"))
    c = points(spark, sf).select("id", geom.to_planar(geom.compose(a, b)).col.alias("c"))
    return c.select("id", r6("c.x").alias("px"), r6("c.y").alias("py"), r6("c.yaw").alias("yaw"))


@query("pose_inverse_identity", f"WITH {P} SELECT id, 0e0 AS dx, 0e0 AS dy, 0e0 AS dz, 0e0 AS angle FROM p")
def pose_inverse_identity(spark, sf):
    a = geom.pose(xyz(), geom.from_ypr(F.col("x"), F.col("y"), F.col("z")))
    d = points(spark, sf).select("id", a.col.alias("a")).select("id", geom.compose(F.col("a"), geom.inverse(F.col("a"))).col.alias("d"))
    return d.select("id", r6("d.x").alias("dx"), r6("d.y").alias("dy"), r6("d.z").alias("dz"), r6(geom.rotation_angle(F.col("d"))).alias("angle"))


@query("so3_round_trip", f"WITH {P} SELECT id, round(x, 6) + 0e0 AS wx, round(y, 6) + 0e0 AS wy, round(z, 6) + 0e0 AS wz FROM p")
def so3_round_trip(spark, sf):
    w = points(spark, sf).select("id", geom.so3_log(geom.so3_exp(xyz())).col.alias("w"))
    return w.select("id", *(r6(f"w.{c}").alias(f"w{c}") for c in "xyz"))


@query("ypr_round_trip", f"WITH {P} SELECT id, round(x, 6) + 0e0 AS yaw, round(y, 6) + 0e0 AS pitch, round(z, 6) + 0e0 AS roll FROM p")
def ypr_round_trip(spark, sf):
    a = points(spark, sf).select("id", geom.to_ypr(geom.from_ypr(F.col("x"), F.col("y"), F.col("z"))).col.alias("a"))
    return a.select("id", *(r6(f"a.{c}").alias(c) for c in ("yaw", "pitch", "roll")))


@query("matrix_round_trip", f"WITH {P} SELECT id, 0e0 AS angle, round(x, 6) + 0e0 AS x FROM p")
def matrix_round_trip(spark, sf):
    a = points(spark, sf).select("id", geom.pose(xyz(), geom.from_ypr(F.col("x") * 8, F.col("y"), F.col("z") * 8)).col.alias("a"))
    b = a.withColumn("m", geom.to_matrix12(F.col("a"))).withColumn("b", geom.from_matrix12(F.col("m")).col)
    return b.select("id", r6(geom.rotation_angle(geom.difference(F.col("b"), F.col("a")))).alias("angle"), r6("b.x").alias("x"))


@query("rotation_error", f"WITH {P} SELECT id, round(abs(x), 5) + 0e0 AS angle FROM p WHERE abs(x) > 1e-2")
def rotation_error(spark, sf):
    a = points(spark, sf).where("abs(x) > 0.01")
    return a.select("id", r6(geom.trace_angle(geom.from_ypr(F.col("x"), 0.0, 0.0)), 5).alias("angle"))


@query("slerp_halfway", f"WITH {P} SELECT id, round((x + y) / 2, 6) + 0e0 AS yaw FROM p")
def slerp_halfway(spark, sf):
    q = geom.slerp(geom.from_ypr(F.col("x"), 0.0, 0.0), geom.from_ypr(F.col("y"), 0.0, 0.0), F.lit(0.5))
    return points(spark, sf).select("id", q.alias("q")).select("id", r6(geom.to_ypr(F.col("q")).yaw).alias("yaw"))


@query("elevation_correction", f"""WITH {P} SELECT id, round(sqrt(x * x + y * y + z * z), 6) AS norm, round(asin(z / sqrt(x * x + y * y + z * z)) + radians(205e-3), 6) + 0e0 AS elevation FROM p""")
def elevation_correction(spark, sf):
    c = points(spark, sf).select("id", geom.correct_elevation(xyz()).col.alias("c"))
    n = geom.norm(F.col("c"))
    return c.select("id", r6(n).alias("norm"), r6(F.asin(F.col("c.z") / n)).alias("elevation"))


@query("range_image", f"""WITH {P}, f AS (SELECT *, sqrt(x * x + y * y) AS d FROM p)
SELECT id, CASE WHEN abs(z) <= d AND d > 0 THEN least(63, greatest(0, floor((asin(z / d) + radians(24.8e0)) / radians(26.8e0) * 64)))::INTEGER END AS "row",
CASE WHEN abs(z) <= d AND d > 0 THEN least(1023, greatest(0, trunc(1024 * (atan2(y, x) + pi()) / (2 * pi()))))::INTEGER END AS col FROM f""")
def range_image(spark, sf):
    return points(spark, sf).select("id", geom.range_image_cell(xyz(), 64, 1024).alias("c")).select("id", "c.row", "c.col")


@query("ring_by_pitch", f"""WITH {P}, f AS (SELECT *, sqrt(x * x + y * y) AS d FROM p)
SELECT id, CASE WHEN d >= 5e-2 AND abs(z) <= d THEN least(31, greatest(0, round_even(31 * (asin(z / d) + radians(36.374e0)) / radians(36.374e0 + 10.86e0), 0)))::INTEGER END AS ring FROM f""")
def ring_by_pitch(spark, sf):
    return points(spark, sf).select("id", geom.ring_of(xyz()).alias("ring"))


@query("azimuth_time", f"WITH {P} SELECT id, round(-5e-2 * (atan2(y, x) + pi()) / (2 * pi()), 6) + 0e0 AS t FROM p")
def azimuth_time(spark, sf):
    return points(spark, sf).select("id", r6(geom.azimuth_time(xyz())).alias("t"))


@query("sweep_time", f"WITH {P} SELECT id, (id % 64)::INTEGER AS ring, round(-5e-2 + 1e-1 * floor(id / 64e0) / 1024, 6) + 0e0 AS t FROM p")
def sweep_time(spark, sf):
    s = points(spark, sf).select("id", geom.sweep_time(F.col("id")).alias("s"))
    return s.select("id", "s.ring", r6("s.t").alias("t"))


@query("nearest_poses", f"""WITH {P}, g AS (SELECT *, floor(x * 10e0) AS cx, floor(y * 10e0) AS cy, floor(z * 10e0) AS cz FROM p),
j AS (SELECT a.id AS query_id, b.id AS match_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, (a.x - b.x) * (a.x - b.x) AS w2
FROM g a JOIN g b ON a.label < 2 AND b.label >= 2 AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, match_id) AS r FROM j), s AS (SELECT query_id, match_id, d2 + w2 AS score FROM k WHERE r <= 20)
SELECT query_id, round(min(score), 6) AS score FROM s GROUP BY query_id""")
def nearest_poses(spark, sf):
    p = points(spark, sf, label=True).select("id", "label", geom.pose(xyz(), geom.from_ypr(F.col("x"), 0.0, 0.0)).col.alias("pose"))
    out = spatial.nearest_poses(p.where("label < 2").drop("label"), p.where("label >= 2").drop("label"), SIZE)
    return out.select("query_id", r6("score").alias("score"))


@query("covariance_growth", f"WITH {P} SELECT id, round(1e0 + (x * 2e0) * (x * 2e0), 6) AS v FROM p")
def covariance_growth(spark, sf):
    return points(spark, sf).select("id", r6(geom.grow_covariance(F.lit(1.0), F.col("x"), 2.0)).alias("v"))


@query("covariance_inverse", f"WITH {P} SELECT id, round(1 / (1e0 + x * x), 6) AS v FROM p")
def covariance_inverse(spark, sf):
    unit = F.array(*(F.lit(1.0 if i % 7 == 0 else 0.0) for i in range(36)))
    inv = trajectory.inverse6(trajectory.propagated_covariance(unit, F.col("x")))
    return points(spark, sf).select("id", r6(inv[0]).alias("v"))


@query("gps_hdop", "SELECT event_id, round(sqrt(value) / 4.5e0, 6) AS hdop FROM events")
def gps_hdop(spark, sf):
    from waymark.sources.files import gps_dilution

    return table(spark, sf, "events").select("event_id", r6(gps_dilution(F.col("value"))).alias("hdop"))


@query("voxel_order", f"WITH {C} SELECT id, row_number() OVER (ORDER BY cx, cy, cz, id) - 1 AS place FROM c")
def voxel_order(spark, sf):
    """Points in the lexicographic order of their cells."""
    return cells.index_order(points(spark, sf), 0.1).select("id", "place")


@query("ring_histogram", f"""WITH {P}, f AS (SELECT *, sqrt(x * x + y * y) AS d FROM p),
r AS (SELECT id, label, CASE WHEN d >= 5e-2 AND abs(z) <= d THEN least(31, greatest(0, round_even(31 * (asin(z / d) + radians(36.374e0)) / radians(36.374e0 + 10.86e0), 0)))::INTEGER END AS ring FROM f)
SELECT ring, label AS t, max(id) AS idx, count(*) AS n FROM r WHERE ring IS NOT NULL GROUP BY ring, label""")
def ring_histogram(spark, sf):
    return maps.ring_histogram(points(spark, sf, label=True).withColumn("ring", geom.ring_of(xyz())), "ring", "label", "id").select("ring", F.col("label").alias("t"), "idx", "n")


@query("gyro_rows", "SELECT user_id AS key, count(*) AS n, round(count(*) * 1e-3, 6) AS dt, round(abs(cos(sum(value) / 2e6)), 5) AS qw FROM events GROUP BY user_id")
def gyro_rows(spark, sf):
    """Angular rates about one axis from the events of each user: half angles add up."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), (F.col("value") / 1000).alias("wz"), F.lit(1e-3).alias("dt"))
    out = trajectory.integrate_rotation(e, "key", ["event_id"])
    return out.select("key", "n", r6("dt").alias("dt"), r6(F.abs("q.qw"), 5).alias("qw"))


@query("gyro_integration", "WITH w AS (SELECT sqrt(1e-8 + 4e-8 + 30003e-4 * 30003e-4) AS a) SELECT 0::BIGINT AS key, 2000::BIGINT AS n, 2e0 AS dt, round(cos(a), 6) + 0e0 AS qw, round(sin(a) / a * 1e-4, 6) + 0e0 AS qx, round(sin(a) / a * -2e-4, 6) + 0e0 AS qy, round(sin(a) / a * 30003e-4, 6) + 0e0 AS qz FROM w")
def gyro_integration(spark, sf):
    """2,000 samples of 3 rad/s over 1 ms each, with a bias: a yaw of 6 rad."""
    samples = spark.range(2000).select(F.lit(0).cast("long").alias("key"), F.col("id").alias("seq"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), F.lit(3.0).alias("wz"), F.lit(1e-3).alias("dt"))
    out = trajectory.integrate_rotation(samples, "key", ["seq"], (-1e-4, 2e-4, -3e-4))
    return out.select("key", "n", r6("dt").alias("dt"), *(r6(f"q.{c}").alias(c) for c in ("qw", "qx", "qy", "qz")))
