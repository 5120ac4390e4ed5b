"""Rotations and poses against numpy, the gyro fixture, and the folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geom
from waymark.operators import trajectory


def matrix(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.fixture(scope="module")
def poses(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(40, 8))
    rows = []
    for r in q:
        a, b = r[:4] / np.linalg.norm(r[:4]), r[4:] / np.linalg.norm(r[4:])
        ta, tb = rng.normal(size=3), rng.normal(size=3)
        rows.append(((*map(float, ta), *map(float, a)), (*map(float, tb), *map(float, b))))
    kind = "struct<" + ",".join(f"{c}:double" for c in geom.POSE) + ">"
    return spark.createDataFrame(rows, f"a {kind}, b {kind}").persist()


def test_compose_and_inverse_match_numpy(poses):
    out = poses.select("a", "b", geom.compose(F.col("a"), F.col("b")).col.alias("c"), geom.inverse(F.col("a")).col.alias("i")).collect()
    for r in out:
        ra, rb = matrix(r.a[3:]), matrix(r.b[3:])
        assert np.allclose(matrix(r.c[3:]), ra @ rb)
        assert np.allclose(r.c[:3], ra @ np.array(r.b[:3]) + np.array(r.a[:3]))
        assert np.allclose(matrix(r.i[3:]), ra.T)
        assert np.allclose(r.i[:3], -ra.T @ np.array(r.a[:3]))


def test_slerp_is_on_the_shortest_path(poses):
    out = poses.select("a", "b", geom.slerp(F.col("a"), F.col("b"), F.lit(0.25)).alias("s")).collect()
    for r in out:
        a, b, s = np.array(r.a[3:]), np.array(r.b[3:]), np.array(r.s)
        whole, part = np.arccos(min(1, abs(a @ b))), np.arccos(min(1, abs(a @ s)))
        assert part == pytest.approx(whole * 0.25, abs=1e-7)


def test_gyro_fixture(spark):
    samples = spark.range(2000).select(F.lit(0).alias("k"), F.col("id").alias("seq"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), F.lit(3.0).alias("wz"), F.lit(1e-3).alias("dt"))
    r = trajectory.integrate_rotation(samples, "k", ["seq"], (-1e-4, 2e-4, -3e-4)).first()
    want = np.array([[np.cos(6), -np.sin(6), 0], [np.sin(6), np.cos(6), 0], [0, 0, 1]])
    assert np.linalg.norm(matrix(r.q) - want) < 1e-2
    assert r.dt == pytest.approx(2.0, abs=1e-3)


def test_key_frames_are_far_from_those_kept(spark):
    rows = [(1, i, (0.4 * i, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)) for i in range(10)]
    kind = "struct<" + ",".join(f"{c}:double" for c in geom.POSE) + ">"
    out = trajectory.keyframes(spark.createDataFrame(rows, f"k long, i long, pose {kind}"), "k", "i", 1.0, 0.1).collect()
    assert sorted(r.i for r in out) == [0, 3, 6, 9]


def test_range_image_without_a_pitch_is_null(spark):
    row = spark.sql("SELECT named_struct('x', 0.1D, 'y', 0D, 'z', 1D) AS p").select(geom.range_image_cell(F.col("p"), 64, 1024).alias("c")).first()
    assert row.c is None
