"""Some queries against DuckDB; the driver compares all of them."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["voxel_downsample", "knn_cells_k3", "interp_value", "segment_pairs", "segment_errors_scaled", "graph_neighbors", "lookup_ids", "concatenated_errors", "laser_scan_points", "odometry_messages", "voxel_order", "ring_histogram", "gyro_rows", "factor_events", "rate_ema", "graph_degree", "session_windows", "min_distance_insert", "keyframes", "fused_states", "pose_matrix", "pose_inverse", "pose_angle", "so3_quaternion", "point_id_hashed", "point_id_grid", "entity_twist_update", "twist_in_body", "covariance_inverse_full"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_whole_queries_equal_brute_force(spark, sf):
    from waymark.plans import catalogue_time

    paths, want = {}, set()
    for r in catalogue_time.frames(spark, sf).orderBy("traj_id", "frame").collect():
        paths.setdefault(r.traj_id, []).append(r)
    mean = sum(r.value for p in paths.values() for r in p) / sum(map(len, paths.values()))
    errors = {}
    for k, p in paths.items():
        for i in range(0, len(p), 10):
            for length in range(100, 801, 100):
                if last := next((r for r in p[i:] if r.dist > p[i].dist + length), None):
                    want.add((k, i, float(length), last.frame))
                    errors.setdefault(float(length), []).append(abs(last.value - mean) / length)
    run = lambda name, *cols: [tuple(r) for r in entry.queries()[name](spark, sf).select(*cols).collect()]
    assert sorted(run("segment_pairs", "traj_id", "first_frame", "len", "last_frame")) == sorted(want)
    assert sorted(run("segment_errors", "traj_id", "first_frame", "len", "last_frame", "t_err")) == sorted((*x, 0.0) for x in want)
    assert {x[:3]: x[3] for x in run("segment_speed", "traj_id", "first_frame", "len", "speed")} == pytest.approx({(k, i, n): n / (0.1 * (j - i + 1)) for k, i, n, j in want}, abs=1e-5)
    assert {x[0]: x[1:] for x in run("error_by_length", "len", "n", "t_err")} == {n: (len(e), pytest.approx(sum(e) / len(e), abs=1e-5)) for n, e in errors.items() if len(e) >= 3}
    assert run("error_overall", "n") == [(len(want),)]
    speeds = [n / (10 * (j - i + 1)) for _, i, n, j in want]
    binned = {b: n for b in range(2, 25, 2) if (n := sum(abs(v - b) < 2 for v in speeds)) >= 3}
    assert dict(run("error_by_speed", "bin", "n")) == binned
    orders, pairs = {}, set()
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    for s in orders.values():
        pairs |= {(a, b) for a in s for b in s if a != b}
    assert sorted(run("graph_neighbors", "entity_id", "neighbour")) == sorted(pairs)
    assert max(a for a, _ in pairs) >= 50
    assert sorted(x for x, in run("lookup_ids", "o_orderkey")) == sorted(orders)


@pytest.fixture(scope="module")
def even(spark, tmp_path_factory):
    """Events of 40 users whose values are tenths that often sum to hundreds, or differ by 300: ends at exactly a length, poses at exactly a limit."""
    import random
    from datetime import datetime, timedelta

    r, d, rows = random.Random(5), tmp_path_factory.mktemp("even"), []
    for user in range(40):
        for i in range(60):
            rows.append((user * 60 + i, datetime(2024, 1, 1) + timedelta(seconds=i), user, "view", r.choice((0.1, 9.9, 20.1, 29.9, 33.3, 66.7, 40.2, 59.8) if user % 2 else (0.1, 49.9, 100.2, 300.1, 349.9, 99.8, 400.2)), None))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    paths = {}
    for _, _, user, _, value, _ in rows:
        p = paths.setdefault(user, [])
        p.append((round(value * 100), round(value * 100) + (p[-1][1] if p else 0)))
    return str(d), paths


def exact_segments(paths):
    """In whole cents: ``(traj, first, length, last)``, and how many ends lie at exactly a length."""
    out, ties = {}, 0
    for k, p in paths.items():
        for i in range(0, len(p), 10):
            for n in range(100, 801, 100):
                ties += sum(d == p[i][1] + 100 * n for _, d in p[i:])
                if (j := next((j for j in range(i, len(p)) if p[j][1] > p[i][1] + 100 * n), None)) is not None:
                    out[k, i, float(n)] = j
    assert ties > 20
    return out


def rows_of(spark, name, d, *cols):
    return [tuple(r) for r in entry.queries()[name](spark, d).select(*cols).collect()]


def test_segment_pairs_at_exact_lengths(spark, even):
    d, paths = even
    assert {x[:3]: x[3] for x in rows_of(spark, "segment_pairs", d, "traj_id", "first_frame", "len", "last_frame")} == exact_segments(paths)


def test_keyframes_at_exact_limits(spark, even):
    d, paths = even
    want, ties = set(), 0
    for k, p in paths.items():
        kept = []
        for i, (v, s) in enumerate(p):
            ties += any(abs(s - a) == 50000 or abs(v - b) == 30000 for b, a in kept)
            if not any(abs(s - a) <= 50000 and abs(v - b) <= 30000 for b, a in kept):
                kept.append((v, s))
                want.add((k, i))
    assert ties > 3
    assert sorted(rows_of(spark, "keyframes", d, "traj_id", "frame")) == sorted(want)


def test_segment_errors_at_exact_lengths(spark, even):
    d, paths = even
    assert {x[:3]: x[3:] for x in rows_of(spark, "segment_errors", d, "traj_id", "first_frame", "len", "last_frame", "t_err")} == {k: (j, 0.0) for k, j in exact_segments(paths).items()}


def test_segment_errors_scaled_at_exact_lengths(spark, even):
    d, paths = even
    assert {x[:3]: x[3] for x in rows_of(spark, "segment_errors_scaled", d, "traj_id", "first_frame", "len", "last_frame")} == exact_segments(paths)


def test_segment_speed_at_exact_lengths(spark, even):
    d, paths = even
    want = {(k, i, n): pytest.approx(n / (0.1 * (j - i + 1)), abs=1e-5) for (k, i, n), j in exact_segments(paths).items()}
    assert {x[:3]: x[3] for x in rows_of(spark, "segment_speed", d, "traj_id", "first_frame", "len", "speed")} == want


def exact_errors(paths):
    mean = sum(v for p in paths.values() for v, _ in p) / sum(map(len, paths.values())) / 100
    return [(n, abs(paths[k][j][0] / 100 - mean) / n, n / (10 * (j - i + 1))) for (k, i, n), j in exact_segments(paths).items()]


def test_error_overall_at_exact_lengths(spark, even):
    d, paths = even
    t = [t for _, t, _ in exact_errors(paths)]
    assert rows_of(spark, "error_overall", d, "n", "t_percent") == [(len(t), pytest.approx(100 * sum(t) / len(t), abs=2e-6))]


def test_error_by_length_at_exact_lengths(spark, even):
    d, paths = even
    of = {}
    for n, t, _ in exact_errors(paths):
        of.setdefault(n, []).append(t)
    assert {x[0]: x[1:] for x in rows_of(spark, "error_by_length", d, "len", "n", "t_err")} == {n: (len(t), pytest.approx(sum(t) / len(t), abs=2e-6)) for n, t in of.items()}


def test_error_by_speed_at_exact_lengths(spark, even):
    d, paths = even
    of = {b: [t for _, t, v in exact_errors(paths) if abs(v - b) < 2] for b in range(2, 25, 2)}
    assert {x[0]: x[1:] for x in rows_of(spark, "error_by_speed", d, "bin", "n", "t_err")} == {b: (len(t), pytest.approx(sum(t) / len(t), abs=2e-6)) for b, t in of.items() if len(t) >= 3}


def test_concatenated_errors_at_exact_lengths(spark, even):
    d, paths = even
    t = [t for _, t, _ in exact_errors(paths)]
    mean = pytest.approx(100 * sum(t) / len(t), abs=2e-6)
    assert {x[0]: x[1:] for x in rows_of(spark, "concatenated_errors", d, "sequence", "n", "t_percent")} == {0: (len(t), mean), 1: (len(t), mean), -1: (2 * len(t), mean)}
