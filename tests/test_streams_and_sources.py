"""Streams against their batch forms, late rows, restarts; datasets, decoders and the command line on written files."""

import struct
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.__main__ import main
from waymark.functions import geom
from waymark.operators import graph, maps, messages, metrics, temporal, trajectory
from waymark.plans import config
from waymark.sources import files, log, sinks
from waymark.streaming import stateful


def run(stream, folder, name):
    """All rows that a stream gives."""
    got = []
    q = stateful.run_available(stream, lambda batch, _: got.extend(tuple(r) for r in batch.collect()), f"{folder}/{name}").start()
    q.awaitTermination()
    assert q.exception() is None
    return got


def parts(spark, rows, schema, folder, size):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.parquet(f"{folder}/{i:06d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_insert_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(scale=0.3, size=3))) for i in range(300)]
    schema = "seq long, x double, y double, z double"
    got = run(stateful.insert_stream(parts(spark, rows, schema, f"{tmp_path}/in", 75), 0.4, 3), tmp_path, "c")
    want = maps.downsample(spark.createDataFrame(rows, schema), 0.4, 3).select("cx", "cy", "cz", "seq", "sub").collect()
    assert sorted((*r[:4], r[7]) for r in got) == sorted(map(tuple, want))


def test_integration_with_reset(spark, tmp_path):
    rows = [(1, i, 0.1, 0.2 * (i % 3), 3.0, 1e-2, i in (0, 20)) for i in range(40)]
    schema = "key long, t_ns long, wx double, wy double, wz double, dt double, reset boolean"
    got = sorted(run(stateful.integrate_stream(parts(spark, rows, schema, f"{tmp_path}/in", 15)), tmp_path, "c"))
    df = spark.createDataFrame(rows, schema)
    for last, lo in ((19, 0), (39, 20)):
        (want,) = trajectory.integrate_rotation(df.where(F.col("t_ns").between(lo, last)), "key", ["t_ns"]).collect()
        assert got[last][2:4] == (pytest.approx(want.dt), want.n) and got[last][4:] == pytest.approx(tuple(want.q), abs=1e-9)


def test_chunked_integration_equals_one_fold(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i % 2, i, *map(float, rng.normal(size=3)), 1e-2) for i in range(100)], "key long, seq long, wx double, wy double, wz double, dt double")
    one = {r.key: tuple(r.q) for r in trajectory.integrate_rotation(df, "key", ["seq"]).collect()}
    monkeypatch.setattr(trajectory, "FOLD", 7)
    assert {r.key: tuple(r.q) for r in trajectory.integrate_rotation(df, "key", ["seq"]).collect()} == {k: pytest.approx(v, abs=1e-12) for k, v in one.items()}


def test_keyframes_equal_brute_force_and_the_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    at, rows = np.zeros(3), []
    for i in range(200):
        at = at + rng.normal(scale=0.6, size=3)
        yaw = float(rng.normal(scale=0.4))
        rows.append((i % 2, i, *map(float, at), float(np.cos(yaw / 2)), 0.0, 0.0, float(np.sin(yaw / 2))))
    want = []
    for key in (0, 1):
        kept = []
        for r in (r for r in rows if r[0] == key):
            p = np.array(r[2:])
            if not any(np.linalg.norm(k[:3] - p[:3]) <= 1.5 and 2 * np.arccos(min(1, abs(k[3:] @ p[3:]))) <= 0.3 for k in kept):
                kept.append(p)
                want.append((key, r[1]))
    schema = "key long, t_ns long, " + ", ".join(f"{c} double" for c in stateful.POSE)
    df = spark.createDataFrame(rows, schema).withColumn("pose", F.struct(*stateful.POSE))
    assert sorted((r.key, r.t_ns) for r in trajectory.keyframes(df, "key", "t_ns", 1.5, 0.3).collect()) == sorted(want)
    got = run(stateful.keyframes_stream(parts(spark, rows, schema, f"{tmp_path}/in", 60), 1.5, 0.3), tmp_path, "c")
    assert sorted(r[:2] for r in got) == sorted(want)


def pose_rows(times, key=1):
    return [(key, t, "pose", float(i), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, *[0.0] * 6) for i, t in enumerate(times)]


def test_late_poses_and_null_keys_are_set_aside(spark, tmp_path):
    rows = [*pose_rows([0, 10**9, 2 * 10**9, 5 * 10**8, 3 * 10**9]), (None, 1, "pose", *[0.0] * 13)]
    df = spark.createDataFrame(rows, stateful.ROW)
    good, late = stateful.split_late(stateful.fuse_batch(df))
    assert good.count() == 5 and late.count() == 0  # sorted, none is late
    stream = stateful.fuse_stream(parts(spark, rows, stateful.ROW, f"{tmp_path}/in", 3))
    got = run(stream, tmp_path, "c")
    assert sorted(r[1] for r in got if r[-1]) == [5 * 10**8] and len(got) == 5


def test_restart_from_a_checkpoint_goes_on(spark, tmp_path):
    rows = pose_rows([i * 10**8 for i in range(12)])
    spark.createDataFrame(rows[:6], stateful.ROW).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(stateful.ROW).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    first = run(stateful.fuse_stream(stream()), tmp_path, "c")
    spark.createDataFrame(rows[6:], stateful.ROW).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    second = run(stateful.fuse_stream(stream()), tmp_path, "c")
    whole = stateful.fuse_batch(spark.createDataFrame(rows, stateful.ROW)).collect()
    assert (len(first), len(second)) == (6, 6)
    assert sorted(first + second) == sorted(map(tuple, whole))


def test_windows_drop_rows_behind_the_watermark(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    schema = "ts timestamp, key string"
    rows = [[(at(s), "a") for s in some] for some in ((1, 5, 12, 50), (51,), (2, 52), (90,), (91,))]  # late rows are told by the watermark of the batch before
    import datetime as dt

    for i, some in enumerate(rows):
        spark.createDataFrame([(dt.datetime.fromisoformat(t), k) for t, k in some], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = run(stateful.windowed_counts(stream, "ts", "key", "10 seconds", late="10 seconds"), tmp_path, "c")
    counts = {r[0].start.second: r[2] for r in got}
    assert counts[0] == 2 and counts[10] == 1  # the row of second 2 came after the watermark


def test_player_pauses_seeks_and_refuses_to_go_back(spark, tmp_path):
    schema, got = "t_ns long", []
    stream = parts(spark, [(i,) for i in range(20)], schema, f"{tmp_path}/in", 5)
    p = stateful.Player(stream, lambda b, _: got.extend(r.t_ns for r in b.collect()), f"{tmp_path}/c", forward_only=True)
    p.resume().awaitTermination()
    p.pause()
    p.resume().awaitTermination()
    assert sorted(got) == list(range(20)) and p.reached == 19
    with pytest.raises(ValueError, match="go back"):
        p.seek(3)
    p.forward_only = False
    got.clear()
    p.seek(15)
    p.resume().awaitTermination()
    assert sorted(got) == list(range(15, 20))


def test_range_numbering(spark):
    rows = [(int(x), i) for i, x in enumerate(np.random.default_rng(4).permutation(500))]
    df = spark.createDataFrame(rows, "v long, id long").repartition(7)
    assert all(r.timestep == r.v for r in temporal.with_timestep(df, ["v"]).collect())
    assert temporal.drop_last(df, ["v"]).agg(F.max("v")).first()[0] == 498
    assert temporal.forward(df, 490, 3, ["v"]).count() == 10


def kitti_folder(tmp_path, scans=3):
    d = tmp_path / "seq"
    (d / "velodyne").mkdir(parents=True)
    (d / "times.txt").write_text("0.0\n0.1\n0.2\n")
    rng = np.random.default_rng(5)
    clouds = [rng.normal(size=(10, 4)).astype("<f4") for _ in range(scans)]
    for i, c in enumerate(clouds):
        (d / "velodyne" / f"{i:06d}.bin").write_bytes(c.tobytes())
    line = lambda k, x: f"{k}: 7 0 0 {x} 0 7 0 0 0 0 1 0\n"
    (d / "calib.txt").write_text("".join(line(f"P{i}", -3.5 * i) for i in range(4)) + "Tr: 0 -1 0 0.1 0 0 -1 0.2 1 0 0 0.3\n")
    (d / "poses.txt").write_text("1 0 0 0 0 1 0 0 0 0 1 0\nnot a pose\n1 0 0 1 0 1 0 0 0 0 1 0\n1 0 0 2 0 1 0 0 0 0 1 0\n")
    return d, clouds


def test_kitti_sequence(spark, tmp_path):
    d, clouds = kitti_folder(tmp_path)
    s = files.KittiSequence(spark, str(d), str(d / "poses.txt"))
    assert [r.frame for r in s.truth().orderBy("frame").collect()] == [0, 1, 2]
    pts = s.points(1).orderBy("pt_idx").collect()
    raw = clouds[1][:, :3].astype(float)
    assert len(pts) == 10 and np.allclose([np.linalg.norm([r.x, r.y, r.z]) for r in pts], np.linalg.norm(raw, axis=1))
    assert {r.t_ns for r in pts} == {100_000_000} and s.points().count() == 30
    tr = np.array([[0, -1, 0, 0.1], [0, 0, -1, 0.2], [1, 0, 0, 0.3], [0, 0, 0, 1]])
    at = np.eye(4)
    at[0, 3] = 1.0  # of P2: 7 / 7
    assert np.allclose(s.cameras()["P2"], np.linalg.inv(tr) @ at)
    (d / "velodyne" / "000002.bin").unlink()
    with pytest.raises(ValueError, match="scans"):
        files.KittiSequence(spark, str(d))


def test_sensor_file():
    text = "%YAML:1.0\n# a camera\nsensor_type: camera\nrate_hz: 20\nT_BS:\n  cols: 4\n  rows: 4\n  data: [1, 0, 0, 0.5,\n         0, 1, 0, 0,\n         0, 0, 1, 0,\n         0, 0, 0, 1]\nintrinsics: [458.6, 457.2, 367.2, 248.3] #fu\ndistortion_coefficients: [-0.28, 0.07, 0.0, 0.0]\n"
    got = files.sensor_yaml(text)
    assert got["pose"][0] == [1, 0, 0, 0.5] and got["intrinsics"][3] == 248.3 and got["sensor_type"] == "camera" and got["rate_hz"] == "20"
    with pytest.raises(ValueError, match="sixteen"):
        files.sensor_yaml("T_BS: 1")


def test_text_and_binary_files(spark, tmp_path):
    (tmp_path / "t.tum").write_text("# head\n1.5 1 2 3 0 0 0 1\nbad\n")
    (r,) = files.tum_trajectory(spark, str(tmp_path / "t.tum")).collect()
    assert (r.t_ns, r.pose.x, r.pose.qw) == (1_500_000_000, 1.0, 1.0)
    (tmp_path / "y.ypr").write_text("2 1 0 0 1.5707963267948966 0 0\n")
    (r,) = files.ypr_trajectory(spark, str(tmp_path / "y.ypr")).collect()
    assert r.pose.qz == pytest.approx(2**-0.5)
    ply = tmp_path / "ply"
    ply.mkdir()
    head = "ply\nformat {} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty float intensity\nproperty double timestamp\nend_header\n"
    (ply / "a.ply").write_text(head.format("ascii") + "1 0 0 5 0.5\n0 2 0 6 0.6\n")
    (ply / "b.ply").write_bytes(head.format("binary_little_endian").encode() + b"".join(struct.pack("<4fd", *v) for v in ((1, 0, 0, 5, 0.5), (0, 2, 0, 6, 0.6))))
    got = files.ply_points(spark, str(ply)).orderBy("path", "pt_idx").collect()
    assert [(r.x, r.y, r.intensity, r.t) for r in got] == [(1, 0, 5, 0.5), (0, 2, 6, 0.6)] * 2
    (tmp_path / "gps.csv").write_text("7,1.0,2.0,3.0," + ",".join(["20.25"] + ["0"] * 8) + "\n")
    (r,) = files.mulran_gps(spark, str(tmp_path / "gps.csv")).collect()
    assert (r.t_ns, r.lat, r.hdop, len(r.cov)) == (7, 1.0, 1.0, 9)
    (tmp_path / "global_pose.csv").write_text("9,1,0,0,4,0,1,0,5,0,0,1,6\n")
    (r,) = files.mulran_truth(spark, str(tmp_path / "global_pose.csv")).collect()
    assert (r.t_ns, r.pose.x, r.pose.z) == (9, 4.0, 6.0)
    scans = tmp_path / "scans"
    scans.mkdir()
    for k in (10, 20, 30):
        (scans / f"{k}.bin").write_bytes(np.full((8, 4), k, "<f4").tobytes())
    assert [r.t_ns for r in files.mulran_scans(spark, str(scans)).orderBy("step").collect()] == [10, 20]
    assert files.mulran_points(spark, str(scans), exact=8).count() == 24
    with pytest.raises(Exception, match="whole scans"):
        files.mulran_points(spark, str(scans), exact=9).count()
    spark.range(3).write.orc(f"{tmp_path}/orc")
    spark.range(3).write.json(f"{tmp_path}/json")
    assert files.read_table(spark, f"{tmp_path}/orc", "orc").count() == files.read_table(spark, f"{tmp_path}/json", "json", "id long").count() == 3


def test_point_clouds_and_scans(spark):
    rec = np.zeros(4, np.dtype({"names": ["x", "y", "z", "intensity", "ring", "t"], "formats": ["<f4", "<f4", "<f4", "<f4", "<u2", "<f8"], "offsets": [0, 4, 8, 16, 20, 24], "itemsize": 32}))
    rec["x"], rec["ring"], rec["t"] = np.arange(4), [3, 2, 1, 0], 0.25
    fields = [(n, o, d) for n, o, d in (("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("intensity", 16, 7), ("ring", 20, 4), ("t", 24, 8))]
    big = np.arange(6, dtype=">f4").reshape(2, 3)
    schema = "t_ns long, sensor_label string, fields array<struct<name:string,offset:int,datatype:int>>, point_step int, is_bigendian boolean, data binary"
    rows = [(1, "a", fields, 32, False, rec.tobytes()), (2, "b", fields[:3], 12, True, big.tobytes()), (3, "c", fields[:2], 8, False, b"\0" * 8), (4, "d", fields[:3], 12, False, b"\0" * 13), (5, "e", None, None, None, None)]
    got = messages.point_cloud(spark.createDataFrame(rows, schema)).orderBy("t_ns", "pt_idx").collect()
    assert [(r.t_ns, r.x, r.ring, r.t) for r in got] == [(1, float(i), 3 - i, 0.25) for i in range(4)] + [(2, 0.0, None, None), (2, 3.0, None, None)]
    imu = spark.createDataFrame([(1, "i", '{"orientation":{"x":0,"y":0,"z":0,"w":1},"angular_velocity":{"x":1,"y":2,"z":3},"linear_acceleration":{"x":4,"y":5,"z":6}}'), (2, "i", "no json")], "t_ns long, sensor_label string, payload string")
    rows = messages.decoded(imu, "IMU").orderBy("t_ns").collect()
    assert (rows[0].wz, rows[0].ax, rows[0].qw, rows[1].wz) == (3.0, 4.0, 1.0, None)
    fix = spark.createDataFrame([(1, "g", '{"latitude":1,"longitude":2,"altitude":3,"position_covariance":[20.25,0,0,0,1,0,0,0,1]}'), (2, "g", '{"latitude":1,"position_covariance":[1]}')], "t_ns long, sensor_label string, payload string")
    assert [r.hdop for r in messages.decoded(fix, "GPS").orderBy("t_ns").collect()] == [1.0, None]
    turn = spark.createDataFrame([(1, "r", '{"rows":2,"columns":3,"range_unit":0.5,"ranges":[0,2,0,4,0,6],"intensities":[1,2,3,4,5,6]}')], "t_ns long, sensor_label string, payload string")
    assert [(r.row, r.column, r.range, r.intensity) for r in messages.decoded(turn, "RotatingScan").orderBy("row", "column").collect()] == [(0, 1, 1.0, 2), (1, 0, 2.0, 4), (1, 2, 3.0, 6)]
    tf = spark.createDataFrame([(1, "t", '{"transforms":[{"frame_id":"a","child_frame_id":"b","t_ns":5,"transform":{"translation":{"x":1,"y":0,"z":0},"rotation":{"x":0,"y":0,"z":0,"w":1}}}]}')], "t_ns long, sensor_label string, payload string")
    (r,) = messages.decoded(tf, "Transforms").collect()
    assert (r.parent, r.child, r.t_ns, r.pose.x) == ("a", "b", 5, 1.0)


def test_back_end_events_and_edges(spark, tmp_path):
    b = graph.BackEnd(spark, str(tmp_path / "be"))
    one = b.add_keyframes(spark.createDataFrame([(5,), (3,)], "t_ns long"), ["t_ns"])
    assert sorted((r.id, r.t_ns) for r in one.collect()) == [(0, 3), (1, 5)]
    b.add_keyframes(spark.createDataFrame([(9,)], "t_ns long"), ["t_ns"])
    assert sorted((r.id, r.t_ns) for r in b.table("entities").collect()) == [(0, 3), (1, 5), (2, 9)]
    b.add_factors(spark.createDataFrame([("RelativePose3", [0, 1])], "kind string, edges array<long>"), ["kind"])
    assert sorted((r.entity_id, r.fid, r.event) for r in b.table("events").collect()) == [(0, 0, "edge"), (1, 0, "edge")]
    b.advertise(spark.createDataFrame([(1, "odom", 2.0), (4, "odom", 7.0)], "t_ns long, frame string, x double").select("t_ns", "frame", F.struct("x").alias("pose")))
    assert b.latest_pose("odom").first().pose.x == 7.0
    n = spark.createDataFrame([("RelativePose3", [1, 2]), ("SmartIMU", None), ("Other", [1])], "kind string, edges array<long>").select(graph.edge_count(F.col("kind"), F.col("edges")).alias("n"))
    assert [r.n for r in n.collect()] == [2, 0, 1]
    short = spark.createDataFrame([("RelativePose3", [1])], "kind string, edges array<long>").select(graph.edge_count(F.col("kind"), F.col("edges")))
    with pytest.raises(Exception, match="has 2 edges"):
        short.collect()


def test_world_with_annotations_and_export(spark, tmp_path):
    e, f, a = spark.range(3), spark.range(2), spark.createDataFrame([(0, "n", b"x")], "id long, name string, data binary")
    sinks.save_world(str(tmp_path / "w"), e, f, a)
    assert sinks.load_world(spark, str(tmp_path / "w"))["annotations"].first().data == b"x"
    sinks.save_world(str(tmp_path / "v"), e, f)
    assert set(sinks.load_world(spark, str(tmp_path / "v"))) == {"entities", "factors"}
    spark.createDataFrame([(1, "a", "k"), (2, "b", "l")], "t_ns long, sensor_label string, kind string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t_ns long, sensor_label string, kind string").parquet(f"{tmp_path}/in")
    sinks.export_stream(stream, f"{tmp_path}/out", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert log.read_log(spark, f"{tmp_path}/out", kinds=["l"]).count() == 1


def test_published_rows_are_read_again(spark):
    states = spark.range(1).select(F.lit(5).cast("long").alias("t_ns"), F.lit("o").alias("sensor_label"), geom.pose_of(1, 2, 3, 1, 0, 0, 0).col.alias("pose"), F.struct(*(F.lit(float(i)).alias(c) for i, c in enumerate(("vx", "vy", "vz", "wx", "wy", "wz")))).alias("twist"))
    (r,) = messages.odometry(sinks.odometry_rows(states)).collect()
    assert (r.pose.y, r.twist.wz) == (2.0, 5.0)
    (t,) = sinks.tf_rows(states, "map", "odom").collect()
    assert (t.parent, t.x, t.qw) == ("map", 1.0, 1.0)


def test_visitors_and_measures(spark):
    pts = spark.createDataFrame([(i, 0.1 * i, 0.0, 0.0) for i in range(20)], "seq long, x double, y double, z double")
    assert maps.visit_points(pts, F.count("*").alias("n")).first().n == 20
    import pandas as pd

    got = maps.visit_voxels(pts, lambda cell, pdf: pd.DataFrame([(cell[0], len(pdf))], columns=["cx", "n"]), "cx int, n long", 1.0).collect()
    assert sum(r.n for r in got) == 20
    df, seen = metrics.observed(pts, "measures", n=F.count("*"), far=F.max("x"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 20 and seen.get["far"] == pytest.approx(1.9)


def own_builder(spark, inputs, at_least):
    return inputs[0].where(F.col("id") >= at_least)


def test_pipeline_specifications(spark, tmp_path):
    spark.range(10).write.json(f"{tmp_path}/in")
    (tmp_path / "p.json").write_text('{"at_least": 4}')
    sys.modules.setdefault("test_own", sys.modules[__name__])
    spec = {"modules": [{"name": "a", "type": "table", "params": {"path": f"{tmp_path}/in", "kind": "json", "schema": "id long"}, "execution_rate": 20}, {"name": "b", "type": "test_own:own_builder", "inputs": "a", "params_file": "p.json", "verbosity_level": "WARN"}, {"name": "c", "type": "map_filter", "inputs": "b", "params": {"column": "id", "value": "nullif(id, 9)"}}]}
    out = config.build(spark, spec, tmp_path)
    assert out["b"].count() == 6 and out["c"].count() == 5
    assert [m["name"] for m in config.find(spec, interface="source")] == ["a"] and config.find(spec, name="c")[0]["type"] == "map_filter"
    assert config.trigger_of(spec["modules"][0]) == {"processingTime": "50 milliseconds"} and config.trigger_of(spec["modules"][1]) == {"processingTime": "1000 milliseconds"}
    with pytest.raises(ValueError, match="verbosity"):
        config.build(spark, {"modules": [dict(spec["modules"][0], verbosity_level="LOUD")]})


def test_metrics_command(spark, tmp_path):
    for s in ("a", "b"):
        lines = [f"1 0 0 {i * 2.0} 0 1 0 0 0 0 1 0" for i in range(200)]
        (tmp_path / f"{s}_gt.txt").write_text("\n".join(lines))
        (tmp_path / f"{s}.txt").write_text("\n".join(f"1 0 0 {i * 2.02} 0 1 0 0 0 0 1 0" for i in range(200)))
    args = ["metrics", str(tmp_path / "out"), "--format", "kitti"]
    for s in ("a", "b"):
        args += ["--pair", str(tmp_path / f"{s}_gt.txt"), str(tmp_path / f"{s}.txt")]
    assert main(args) == 0
    stats = spark.read.csv(f"{tmp_path}/out/stats", header=True, inferSchema=True).first()
    assert stats.t_err == pytest.approx(0.01, rel=0.05) and stats.segments % 2 == 0
    assert spark.read.csv(f"{tmp_path}/out/sequence_1/path", header=True).count() == 200
    (tmp_path / "b.txt").write_text("1 0 0 0 0 1 0 0 0 0 1 0\n")
    with pytest.raises(SystemExit):
        main(args)
    assert main(["modules"]) == 0
