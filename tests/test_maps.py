"""Cells, caps, neighbours and insertion on small clouds against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import cells
from waymark.operators import maps, metrics, spatial, temporal


def cloud(spark, pts):
    return spark.createDataFrame([(i, i, *map(float, p)) for i, p in enumerate(pts)], "id long, seq long, x double, y double, z double")


def test_cells_truncate_round_and_shift(spark):
    df = spark.createDataFrame([(-0.19,), (-0.05,), (0.05,), (0.15,)], "x double")
    got = df.select(*(cells.cell_index(F.col("x"), 0.1, m).alias(m) for m in cells.MODES)).collect()
    assert [r.trunc for r in got] == [-1, 0, 0, 1]
    assert [r.floor for r in got] == [-2, -1, 0, 1]
    assert [r.round for r in got] == [-2, 0, 0, 2]
    assert [r.half_shift for r in got] == [-1, 0, 1, 2]


def test_knn_equals_brute_force_where_the_cells_reach(spark):
    rng = np.random.default_rng(3)
    pts = rng.uniform(0, 1, (200, 3))
    p = cloud(spark, pts)
    got = {}
    for r in spatial.knn_join(p, p, 0.25, 2, mode="floor", drop_self=True).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.d2))
    for i, a in enumerate(pts):
        d2 = np.sort(((pts - a) ** 2).sum(axis=1))[1:3]
        for k, want in enumerate(d2):
            if want <= 0.25**2:
                assert dict(got[i])[k + 1] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("mode", cells.MODES)
def test_knn_cuts_dense_cells_into_tiles(spark, monkeypatch, mode):
    monkeypatch.setattr(spatial, "DENSE", 40)
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(0, 0.12, (900, 3)), np.round(rng.normal(0, 0.12, (300, 3)), 1), np.full((150, 3), 0.03), rng.uniform(-3, 3, (40, 3))])
    pts = pts[rng.permutation(len(pts))]
    p = cloud(spark, pts)
    at = [tuple(r) for r in p.orderBy("id").select(*(cells.cell_index(F.col(c), 0.2, mode) for c in "xyz")).collect()]
    at, want = np.array(at), []
    for i, a in enumerate(pts):
        d = [pts[:, j] - a[j] for j in range(3)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        seen = [j for j in np.nonzero((abs(at - at[i]) <= 1).all(axis=1))[0] if j != i]
        want += [(i, j, d2[j], n + 1) for n, j in enumerate(sorted(seen, key=lambda j: (d2[j], j))[:3])]
    got = spatial.knn_join(p, p, 0.2, mode=mode, drop_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # no pairs of points go through the plan


def test_min_distance_insertion_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(-0.2, 0.2, (300, 3))
    kept = {}
    for i, p in enumerate(pts):
        c = tuple(np.trunc(p * 10).astype(int))
        own = kept.setdefault(c, [])
        if len(own) < 32 and all(((pts[k] - p) ** 2).sum() >= 0.04**2 for k in own):
            own.append(i)
    got = {r.seq for r in maps.min_distance_insert(cloud(spark, pts), 0.1, 0.04).collect()}
    assert got == {i for v in kept.values() for i in v}


@pytest.mark.parametrize("limit", [0, 3])
def test_greedy_insertion_over_many_batches(spark, limit):
    """One hot cell and others, in batches of 7 rows; maps apart by a key that may be null; points without a place."""
    rng = np.random.default_rng(9)
    rows = [(["a", "b", None][i % 3], i, *(float(v) for v in rng.uniform(0, 0.1 if i % 4 else 0.3, 3))) for i in range(400)] + [("a", 400, None, 0.0, 0.0), ("a", 401, None, 0.0, 0.0)]
    kept = {}
    for k, i, *p in rows:
        own = kept.setdefault((k, None if p[0] is None else tuple(np.trunc(np.array(p) * 10).astype(int))), [])
        near = p[0] is not None and any(sum((a - b) ** 2 for a, b in zip(rows[j][2:], p, strict=True)) < 0.02**2 for j in own)
        if len(own) < (limit or 32) and not near:
            own.append(i)
    df = spark.createDataFrame(rows, "map string, seq long, x double, y double, z double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(r.seq for r in maps.min_distance_insert(df, 0.1, 0.02, limit, keys=("map",)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(i for v in kept.values() for i in v)
    assert maps.min_distance_insert(df.where("seq < 0"), 0.1, 0.02, keys=("map",)).count() == 0


def test_exactly_the_distance_is_kept_by_one_map_and_rejected_by_the_other(spark):
    base, batch = cloud(spark, [(0.0, 0, 0)]), spark.createDataFrame([(9, 9, 0.5, 0.0, 0.0), (10, 10, 0.25, 0.0, 0.0)], "id long, seq long, x double, y double, z double")
    assert [r.seq for r in maps.clearance_insert(batch, base, 4.0, 0.25).collect()] == [9]
    both = base.union(batch.where("seq = 10"))
    assert maps.min_distance_insert(both, 4.0, 0.25).count() == 2


def test_caps_and_empty_maps(spark):
    same = cloud(spark, [(0.01, 0.01, 0.01)] * 40)
    assert maps.downsample(same, 0.1).count() == 32
    assert maps.voxel_means(same, 0.1).first().n == 16
    empty = same.where("id < 0")
    assert maps.bounding_box(empty).first().asDict() == dict.fromkeys(("min_x", "min_y", "min_z", "max_x", "max_y", "max_z"), 0.0)
    assert maps.scan_likelihood(empty.withColumn("d2", F.lit(None).cast("double")), 0.5, 1.0).first().log_likelihood == 0.0
    assert spatial.radius_join(same, same, 0.1, 0.0).count() == 0


def test_segments_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for k in range(3):
        dist = np.cumsum(np.append(rng.exponential(3, 150), 500 * (k == 1)))
        rows += [(k, i, float(d)) for i, d in enumerate(dist)]
        for i in range(0, len(dist), 10):
            for length in (100, 200):
                later = np.flatnonzero(dist > dist[i] + length)
                if len(later):
                    want.add((k, i, float(length), int(later[0])))
    got = metrics.segments(spark.createDataFrame(rows, "traj_id long, frame long, dist double"), (100, 200))
    assert {(r.traj_id, r.first_frame, r.len, r.last_frame) for r in got.collect()} == want


def test_as_of_takes_equal_times_and_respects_the_gap(spark):
    left = spark.createDataFrame([(1, 10), (1, 25)], "k long, t long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 12, "b")], "k long, t long, v string")
    assert [(r.t, r.v) for r in temporal.asof_join(left, right, ["k"], "t", ["v"]).orderBy("t").collect()] == [(10, "a"), (25, "b")]
    kept = temporal.asof_join(left, right, ["k"], "t", ["v"], max_gap=5, inner=False).orderBy("t").collect()
    assert [(r.t, r.v) for r in kept] == [(10, "a"), (25, None)]
