"""Sources, sinks, configuration and streaming on small files."""

import json

import numpy as np
import pytest

from waymark.plans import config
from waymark.sources import files, log, sinks
from waymark.streaming import stateful


def test_kitti_files_round_trip(spark, tmp_path):
    (tmp_path / "times.txt").write_text("0.0\n0.1\n")
    (tmp_path / "poses.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7\nnot a row\n0 -1 0 0 1 0 0 0 0 0 1 0\n")
    assert [r.t_ns for r in files.kitti_times(spark, str(tmp_path / "times.txt")).collect()] == [0, 100_000_000]
    frames = files.kitti_poses(spark, str(tmp_path / "poses.txt"))
    lines = [[float(x) for x in r.value.split()] for r in sinks.kitti_lines(frames).collect()]
    assert np.allclose(lines, [[1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7], [0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0]])


def test_binary_scans(spark, tmp_path):
    data = np.arange(40, dtype="<f4").reshape(10, 4)
    (tmp_path / "000.bin").write_bytes(data.tobytes())
    rows = files.binary_points(spark, str(tmp_path)).orderBy("pt_idx").collect()
    assert np.array_equal(np.array([(r.x, r.y, r.z, r.intensity) for r in rows], "f4"), data)


def test_stamps_stay_integers(spark, tmp_path):
    (tmp_path / "imu.csv").write_text("#t,wx,wy,wz,ax,ay,az\n1403636579758555391,1,2,3,4,5,6\n")
    r = files.euroc_imu(spark, str(tmp_path / "imu.csv")).first()
    assert (r.t_ns, r.wz) == (1403636579758555391, 3.0)
    (tmp_path / "ts.txt").write_text("2013-05-28 08:46:02.901234567\nbad\n")
    assert [r.t_ns for r in files.kitti360_times(spark, str(tmp_path / "ts.txt")).collect()] == [1369730762901234567]


def test_log_prunes_kinds_and_checks_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "IMU"), (2, "b", "GPS")], "t_ns long, sensor_label string, kind string")
    log.write_log(df, str(tmp_path / "log"))
    assert log.read_log(spark, str(tmp_path / "log"), kinds=["GPS"]).count() == 1
    newer = df.withColumn("schema_version", df.t_ns + 98)
    with pytest.raises(Exception, match="unknown schema version"):
        log.checked_version(newer).collect()


def test_configuration(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "in.json").write_text('{"v": "${B|${A|7}}"}')
    (tmp_path / "top.json").write_text('# $include{nothing}\n{"sub": "$include{d/in.json}", "who": "${A|x}y"}')
    assert config.load(tmp_path / "top.json", {}) == {"sub": {"v": 7}, "who": "xy"}
    assert config.load(tmp_path / "top.json", {"A": "q"}) == {"sub": {"v": "q"}, "who": "qy"}
    with pytest.raises(KeyError):
        config.substitute("${NOPE}", {})


def test_pipeline_specification(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 2 AS k", "id AS t_ns").write.parquet(str(tmp_path / "in"))
    spec = {"modules": [{"name": "f", "type": "filter", "inputs": "src", "params": {"where": "k = 1"}}, {"name": "src", "type": "parquet", "params": {"path": str(tmp_path / "in")}}]}
    assert config.build(spark, json.loads(json.dumps(spec)))["f"].count() == 10


def test_stream_and_batch_fusion_agree_over_micro_batches(spark, tmp_path):
    pose = lambda t, x: (1, t, "pose", x, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, *[0.0] * 6)
    twist = (1, 2_500_000_000, "twist", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 9.0, *[0.0] * 5)
    rows = [pose(0, 0.0), pose(1_000_000_000, 2.0), twist, pose(5_000_000_000, 3.0)]
    for i in range(0, 4, 2):
        spark.createDataFrame(rows[i : i + 2], stateful.ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = stateful.fuse_batch(spark.createDataFrame(rows, stateful.ROW))
    out = []
    q = stateful.run_available(stateful.fuse_stream(stateful.replay(spark, str(tmp_path / "in"), stateful.ROW)), lambda df, _: out.extend(df.collect()), str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch.collect()))
    last = {r.t_ns: (r.vx, r.has_twist) for r in out}
    assert last == {0: (0.0, False), 1_000_000_000: (2.0, True), 2_500_000_000: (9.0, True), 5_000_000_000: (0.0, False)}
