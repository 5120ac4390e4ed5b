"""Queries on streams, trajectories, segments, the graph and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geom, text
from waymark.operators import dispatch, graph, messages, metrics, temporal, trajectory
from waymark.plans.catalogue import E, T, events, query, r6, table

ORDER = ["t_us", "event_id"]


def stream(spark, sf, kind: str):
    return events(spark, sf).where(F.col("event_type") == kind).select("user_id", "event_id", "t_us", "value")


@query("asof_last_view", f"WITH {E} SELECT p.user_id, p.event_id, p.t_us, v.t_us AS t_us_right, v.value AS seen FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM e WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.t_us >= v.t_us")
def asof_last_view(spark, sf):
    left = stream(spark, sf, "purchase").select("user_id", "event_id", "t_us")
    return temporal.asof_join(left, stream(spark, sf, "view").withColumnRenamed("value", "seen"), ["user_id"], "t_us", ["seen"])


@query("asof_within_gap", f"WITH {E} SELECT p.user_id, p.event_id, p.t_us, v.t_us AS t_us_right, v.value AS seen FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM e WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.t_us >= v.t_us WHERE p.t_us - v.t_us <= 43200000000")
def asof_within_gap(spark, sf):
    left = stream(spark, sf, "purchase").select("user_id", "event_id", "t_us")
    return temporal.asof_join(left, stream(spark, sf, "view").withColumnRenamed("value", "seen"), ["user_id"], "t_us", ["seen"], max_gap=12 * 3_600_000_000)


@query("interp_value", f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view'),
a AS (SELECT p.user_id, p.event_id, p.t_us, v.t_us AS t0, v.value AS v0 FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.t_us >= v.t_us),
b AS (SELECT p.event_id, v.t_us AS t1, v.value AS v1 FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.t_us <= v.t_us)
SELECT user_id, a.event_id, t_us, round(v0 + (v1 - v0) * CASE WHEN t1 > t0 THEN (t_us - t0)::DOUBLE / (t1 - t0) ELSE 0e0 END, 6) + 0e0 AS value FROM a JOIN b USING (event_id) WHERE t1 - t0 <= 864000000000""")
def interp_value(spark, sf):
    left = stream(spark, sf, "purchase").select("user_id", "event_id", "t_us")
    out = temporal.interp_join(left, stream(spark, sf, "view"), ["user_id"], "t_us", "value", 240 * 3_600_000_000)
    return out.select("user_id", "event_id", "t_us", r6("value").alias("value"))


@query("interp_pose", f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view'),
a AS (SELECT p.event_id, p.t_us, v.t_us AS t0, v.value AS v0 FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.t_us >= v.t_us),
b AS (SELECT p.event_id, v.t_us AS t1, v.value AS v1 FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.t_us <= v.t_us)
SELECT event_id, round(v0 + (v1 - v0) * u, 6) + 0e0 AS x, round((v0 + (v1 - v0) * u) / 1000, 5) + 0e0 AS yaw FROM (SELECT *, CASE WHEN t1 > t0 THEN (t_us - t0)::DOUBLE / (t1 - t0) ELSE 0e0 END AS u FROM a JOIN b USING (event_id)) WHERE t1 - t0 <= 864000000000""")
def interp_pose(spark, sf):
    """Ground-truth poses joined to scans: linear in translation, SLERP in rotation."""
    left = stream(spark, sf, "purchase").select("user_id", "event_id", "t_us")
    poses = stream(spark, sf, "view").withColumn("pose", trajectory.planar_pose(F.col("value"), F.lit(0.0), F.col("value") / 1000).col)
    out = temporal.interp_join(left, poses, ["user_id"], "t_us", "pose", 240 * 3_600_000_000, poses=True)
    return out.select("event_id", r6("pose.x").alias("x"), r6(geom.to_ypr(F.col("pose")).yaw, 5).alias("yaw"))


@query("tf_latest", f"WITH {E} SELECT user_id AS frame, max(t_us) AS t_us, arg_max(value, t_us) AS value FROM e GROUP BY user_id")
def tf_latest(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("frame"), "t_us", "value")
    return temporal.keep_latest(e, ["frame"], ["t_us"])


@query("merged_stream", f"WITH {E} SELECT event_id, t_us, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS src_rank FROM e WHERE event_type IN ('click', 'view', 'error')")
def merged_stream(spark, sf):
    streams = [stream(spark, sf, k).select("event_id", "t_us") for k in ("click", "view", "error")]
    return temporal.merge_streams(streams, "t_us", "event_id")


@query("replay_until", f"WITH {E} SELECT event_id, t_us FROM e WHERE t_us - (SELECT min(t_us) FROM e) BETWEEN 86400000000 AND 86400000000 + 2 * 86400000000")
def replay_until(spark, sf):
    day = 86_400_000_000
    return temporal.replay_until(events(spark, sf).select("event_id", "t_us"), day, "t_us", warp=2.0, start=day)


@query("timestep_at", f"WITH {E} SELECT user_id, event_id, timestep FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1)::INTEGER AS timestep FROM e) WHERE timestep = 7")
def timestep_at(spark, sf):
    return temporal.at_timestep(events(spark, sf), 7, ORDER, ["user_id"]).select("user_id", "event_id", "timestep")


@query("decimate_every_n", f"WITH {E} SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t_us, event_id) - 1 AS k FROM e) WHERE k % 10 = 0")
def decimate_every_n(spark, sf):
    return temporal.decimate(events(spark, sf), 10, "event_type", ORDER).select("event_type", "event_id")


@query("drop_last", f"WITH {E} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) AS k FROM e) WHERE k > 1")
def drop_last(spark, sf):
    return temporal.drop_last(events(spark, sf), ORDER, ["user_id"]).select("user_id", "event_id")


@query("positional_join", f"""WITH {E}, a AS (SELECT event_id AS a_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS timestep, user_id FROM e WHERE event_type = 'click'),
b AS (SELECT event_id AS b_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS timestep, user_id FROM e WHERE event_type = 'view') SELECT user_id, timestep::INTEGER AS timestep, a_id, b_id FROM a JOIN b USING (user_id, timestep)""")
def positional_join(spark, sf):
    a = stream(spark, sf, "click").select("user_id", "t_us", F.col("event_id").alias("a_id"))
    b = stream(spark, sf, "view").select("user_id", F.col("t_us").alias("t2"), F.col("event_id").alias("b_id"))
    return temporal.positional_join(a, b, ["t_us", "a_id"], ["t2", "b_id"], ["user_id"]).select("user_id", "timestep", "a_id", "b_id")


@query("index_join", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def index_join(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return l.where("l_linenumber = 1").join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_totalprice")


RATES = f"{E}, d AS (SELECT event_type, event_id, t_us, (t_us - lag(t_us) OVER (PARTITION BY event_type ORDER BY t_us, event_id)) / 1e6 AS dt FROM e), r AS (SELECT *, CASE WHEN dt > 0 THEN 1 / dt WHEN dt IS NOT NULL THEN 1e0 END AS rate FROM d)"


@query("stream_rate", f"WITH {RATES} SELECT event_type, event_id, round(rate, 6) AS rate FROM r WHERE rate IS NOT NULL")
def stream_rate(spark, sf):
    out = temporal.rates(events(spark, sf), "event_type", "t_us", ORDER, 1e6).where("rate is not null")
    return out.select("event_type", "event_id", r6("rate").alias("rate"))


@query("rate_ema", f"WITH {E}, d AS (SELECT user_id, event_id, t_us, (t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id)) / 1e6 AS dt FROM e), r AS (SELECT *, CASE WHEN dt > 0 THEN 1 / dt ELSE 1e0 END AS rate FROM d WHERE dt IS NOT NULL) SELECT user_id, count(*) AS n, round(list_reduce(list(rate ORDER BY t_us, event_id), lambda a, x: a * 0.9e0 + x * (1 - 0.9e0)), 6) + 0e0 AS ema FROM r GROUP BY user_id")
def rate_ema(spark, sf):
    return temporal.rate_ema(events(spark, sf), "user_id", "t_us", ORDER, unit=1e6).select("user_id", "n", r6("ema").alias("ema"))


@query("keep_latest_by_type", f"WITH {E} SELECT event_type, max(t_us) AS t_us, arg_max(event_id, t_us) AS event_id, arg_max(value, t_us) AS value FROM e GROUP BY event_type")
def keep_latest_by_type(spark, sf):
    return temporal.keep_latest(events(spark, sf).select("event_type", "t_us", "event_id", "value"), ["event_type"], ORDER)


@query("first_seen_labels", f"WITH {E} SELECT event_type, min(t_us) AS first_t_us, arg_min(event_id, t_us) AS first_event_id FROM e GROUP BY event_type")
def first_seen_labels(spark, sf):
    return temporal.first_seen(events(spark, sf), "event_type", ORDER)


@query("stream_origin", f"WITH {E} SELECT min(t_us) AS t0 FROM e")
def stream_origin(spark, sf):
    return temporal.stream_origin(events(spark, sf), "t_us")


@query("centred_times", f"WITH {E} SELECT event_id, round((t_us / 1e6 - min(t_us / 1e6) OVER (PARTITION BY user_id)) - 5e-2, 3) + 0e0 AS t FROM e")
def centred_times(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", (F.col("t_us") / 1e6).alias("t"))
    return temporal.centred_times(e, "user_id", "t").select("event_id", r6("t", 3).alias("t"))


@query("message_inventory", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def message_inventory(spark, sf):
    return dispatch.inventory(table(spark, sf, "events"), "event_type")


@query("idle_entities", f"WITH {E} SELECT user_id, max(t_us) AS last_seen FROM e GROUP BY user_id HAVING (SELECT max(t_us) FROM e) - max(t_us) > 3600000000")
def idle_entities(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("t_us").alias("now"))
    last = e.groupBy("user_id").agg(F.max("t_us").alias("last_seen"))
    return last.crossJoin(F.broadcast(now)).where(F.col("now") - F.col("last_seen") > 3_600_000_000).drop("now")


# --- trajectories ---------------------------------------------------------------------------------------------------


def frames(spark, sf):
    """Frames along a line: x is the distance so far, so that a step has the event's value as its length."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = events(spark, sf).select(F.col("user_id").alias("traj_id"), "event_id", "t_us", "value", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("dist"))
    return e


@query("path_length", f"WITH {T} SELECT traj_id, event_id, round(dist - first_value(dist) OVER (PARTITION BY traj_id ORDER BY frame), 4) + 0e0 AS dist FROM f")
def path_length(spark, sf):
    f = frames(spark, sf).select("traj_id", "event_id", "frame", F.col("dist").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return metrics.path_length(f).select("traj_id", "event_id", r6("dist", 4).alias("dist"))


SEG = f"{T}, l AS (SELECT unnest([100e0, 200e0, 300e0, 400e0, 500e0, 600e0, 700e0, 800e0]) AS len), s AS (SELECT i.traj_id, i.frame AS first_frame, len, min(j.frame) AS last_frame FROM f i, l, f j WHERE i.frame % 10 = 0 AND j.traj_id = i.traj_id AND j.dist > i.dist + len GROUP BY ALL)"
LENGTHS = metrics.LENGTHS


def segs(spark, sf, lengths=LENGTHS):
    return metrics.segments(frames(spark, sf).select("traj_id", "frame", "dist"), lengths)


@query("segment_pairs", f"WITH {SEG} SELECT traj_id, first_frame, len, last_frame FROM s")
def segment_pairs(spark, sf):
    return segs(spark, sf)


@query("segment_speed", f"WITH {SEG} SELECT traj_id, first_frame, len, round(len / (0.1e0 * (last_frame - first_frame + 1)), 6) AS speed FROM s")
def segment_speed(spark, sf):
    return segs(spark, sf).select("traj_id", "first_frame", "len", r6(metrics.speed()).alias("speed"))


ERR = f"{SEG}, m AS (SELECT avg(value) AS a FROM events), x AS (SELECT s.*, abs(f.value - a) / len AS t_err, abs(f.value - a) / len / 10 AS r_err, len / (10e0 * (last_frame - first_frame + 1)) AS speed FROM s JOIN f ON f.traj_id = s.traj_id AND f.frame = s.last_frame, m)"


def errors(spark, sf, lengths=LENGTHS):
    f = frames(spark, sf)
    mean = table(spark, sf, "events").agg(F.avg("value").alias("a"))
    ends = segs(spark, sf, lengths).join(f.select("traj_id", F.col("frame").alias("last_frame"), "value"), ["traj_id", "last_frame"]).crossJoin(F.broadcast(mean))
    t = F.abs(F.col("value") - F.col("a")) / F.col("len")
    return ends.select("len", t.alias("t_err"), (t / 10).alias("r_err"), metrics.speed(period=10.0).alias("speed"))


CURVE = "count(*) AS n, round(avg(t_err), 6) AS t_err, round(avg(r_err), 6) AS r_err"


@query("error_by_length", f"WITH {ERR} SELECT len, {CURVE} FROM x GROUP BY len HAVING count(*) >= 3")
def error_by_length(spark, sf, lengths=LENGTHS):
    return metrics.error_by_length(errors(spark, sf, lengths)).select("len", "n", r6("t_err").alias("t_err"), r6("r_err").alias("r_err"))


@query("error_by_speed", f"WITH {ERR}, b AS (SELECT unnest(range(2, 25, 2))::DOUBLE AS bin) SELECT bin, {CURVE} FROM x, b WHERE abs(speed - bin) < 2 GROUP BY bin HAVING count(*) >= 3")
def error_by_speed(spark, sf, lengths=LENGTHS):
    return metrics.error_by_speed(errors(spark, sf, lengths)).select("bin", "n", r6("t_err").alias("t_err"), r6("r_err").alias("r_err"))


@query("error_overall", f"WITH {ERR} SELECT count(*) AS n, round(100 * avg(t_err), 6) AS t_percent, round(degrees(avg(r_err)), 6) AS r_deg FROM x")
def error_overall(spark, sf, lengths=LENGTHS):
    return metrics.error_overall(errors(spark, sf, lengths)).select("n", r6("t_percent").alias("t_percent"), r6("r_deg").alias("r_deg"))


def pose_frames(spark, sf):
    """Planar frames: x is the distance so far over 100, the heading the event's value over 100."""
    f = frames(spark, sf)
    return f.select("traj_id", "event_id", "frame", F.col("t_us").alias("t_us"), (F.col("t_us") * 1000).alias("t_ns"), trajectory.planar_pose(F.col("dist") / 100, F.lit(0.0), F.col("value") / 1000).col.alias("pose"))


@query("segment_errors", f"WITH {SEG} SELECT traj_id, first_frame, last_frame, len, 0e0 AS r_err, 0e0 AS t_err FROM s")
def segment_errors(spark, sf, lengths=LENGTHS):
    """A trajectory against itself moved rigidly: all errors are 0."""
    f = frames(spark, sf).select("traj_id", "frame", trajectory.planar_pose(F.col("dist"), F.lit(0.0), F.col("value") / 1000).col.alias("pose"))
    at = geom.pose(geom.vec(1, 2, 3), geom.from_ypr(0.5, 0.2, 0.1))
    moved = f.withColumn("pose", geom.compose(at, F.col("pose")).col)
    out = metrics.segment_errors(f, moved, lengths)
    return out.select("traj_id", "first_frame", "last_frame", "len", r6("r_err").alias("r_err"), r6("t_err").alias("t_err"))


SCALED = f"""{SEG}, y AS (SELECT s.*, a.value / 1000 AS y0, b.value / 1000 AS y1, b.dist - a.dist AS d FROM s JOIN f a ON a.traj_id = s.traj_id AND a.frame = s.first_frame JOIN f b ON b.traj_id = s.traj_id AND b.frame = s.last_frame)"""


@query("segment_errors_scaled", f"WITH {SCALED} SELECT traj_id, first_frame, last_frame, len, round((sqrt(3e0) - 1) * abs(y1 - y0) / len, 6) + 0e0 AS r_err, round(d * sqrt(2.0404e0 - 2.04e0 * cos((sqrt(3e0) - 1) * y0)) / len, 5) + 0e0 AS t_err FROM y")
def segment_errors_scaled(spark, sf):
    """Against a trajectory with steps 2 per cent longer and headings larger by the root of 3: errors by the law of cosines."""
    f = frames(spark, sf)
    truth = f.select("traj_id", "frame", trajectory.planar_pose(F.col("dist"), F.lit(0.0), F.col("value") / 1000).col.alias("pose"))
    result = f.select("traj_id", "frame", trajectory.planar_pose(F.col("dist") * 1.02, F.lit(0.0), F.col("value") / 1000 * 3**0.5).col.alias("pose"))
    out = metrics.segment_errors(truth, result)
    return out.select("traj_id", "first_frame", "last_frame", "len", r6("r_err").alias("r_err"), r6("t_err", 5).alias("t_err"))


@query("concatenated_errors", f"WITH {ERR}, t AS (SELECT 0 AS sequence, * FROM x UNION ALL SELECT 1, * FROM x) SELECT sequence, count(*) AS n, round(100 * avg(t_err), 6) AS t_percent FROM t GROUP BY sequence UNION ALL SELECT -1, count(*), round(100 * avg(t_err), 6) FROM t")
def concatenated_errors(spark, sf):
    """The errors of two sequences, each and together."""
    both = metrics.concatenated([errors(spark, sf), errors(spark, sf)])
    each = both.groupBy("sequence").agg(F.count("*").alias("n"), (100 * F.avg("t_err")).alias("t_percent"))
    every = metrics.error_overall(both).select(F.lit(-1).alias("sequence"), "n", "t_percent")
    return each.union(every).select("sequence", "n", r6("t_percent").alias("t_percent"))


@query("rebase_first", f"WITH {T}, z AS (SELECT *, first_value(dist) OVER w AS d0, first_value(value) OVER w AS v0 FROM f WINDOW w AS (PARTITION BY traj_id ORDER BY frame)) SELECT event_id, round(cos(v0 / 1000) * (dist - d0) / 100, 4) + 0e0 AS x, round(-sin(v0 / 1000) * (dist - d0) / 100, 4) + 0e0 AS y, round((value - v0) / 1000, 5) + 0e0 AS yaw FROM z")
def rebase_first(spark, sf):
    out = trajectory.rebase_first(pose_frames(spark, sf), order="frame")
    return out.select("event_id", r6("pose.x", 4).alias("x"), r6("pose.y", 4).alias("y"), r6(geom.to_ypr(F.col("pose")).yaw, 5).alias("yaw"))


@query("transform_trajectory", f"WITH {T}, z AS (SELECT *, first_value(dist) OVER w AS d0, first_value(value) OVER w AS v0 FROM f WINDOW w AS (PARTITION BY traj_id ORDER BY frame)) SELECT event_id, round(1 + cos(v0 / 1000) * (dist - d0) / 100, 4) + 0e0 AS x, round(2 - sin(v0 / 1000) * (dist - d0) / 100, 4) + 0e0 AS y FROM z")
def transform_trajectory(spark, sf):
    out = trajectory.transformed(pose_frames(spark, sf), geom.pose_of(1, 2, 0, 1, 0, 0, 0), order="frame")
    return out.select("event_id", r6("pose.x", 4).alias("x"), r6("pose.y", 4).alias("y"))


@query("finite_diff_velocity", f"WITH {T}, z AS (SELECT *, value - lag(value) OVER w AS dv, (t_us - lag(t_us) OVER w) / 1e6 AS dt FROM f WINDOW w AS (PARTITION BY traj_id ORDER BY frame)) SELECT event_id, round(dv / 1000 / dt, 9) + 0e0 AS wz FROM z WHERE dt < 864000")
def finite_diff_velocity(spark, sf):
    out = trajectory.finite_twist(pose_frames(spark, sf).withColumn("t_ns", F.col("t_us") * 1000), max_dt=864_000.0)
    return out.where("twist is not null").select("event_id", r6("twist.wz", 9).alias("wz"))


@query("extrapolate_state", f"""WITH {T}, z AS (SELECT *, (dist - lag(dist) OVER w) / ((t_us - lag(t_us) OVER w) / 1e6) AS v, t_us - lag(t_us) OVER w AS gap FROM f WINDOW w AS (PARTITION BY traj_id ORDER BY frame)),
s AS (SELECT traj_id, t_us, dist, v FROM z), q AS (SELECT traj_id, event_id, t_us + 1000000 AS t_us FROM f)
SELECT event_id, round(dist + v * (q.t_us - s.t_us) / 1e6, 4) + 0e0 AS x FROM q ASOF JOIN s ON q.traj_id = s.traj_id AND q.t_us >= s.t_us WHERE v IS NOT NULL AND (q.t_us - s.t_us) / 1e6 <= 2""")
def extrapolate_state(spark, sf):
    f = frames(spark, sf).select("traj_id", "event_id", (F.col("t_us") * 1000).alias("t_ns"), geom.pose_of(F.col("dist"), 0, 0, 1, 0, 0, 0).col.alias("pose"))
    states = trajectory.finite_twist(f, max_dt=1e12)
    queries = f.select("traj_id", "event_id", (F.col("t_ns") + 1_000_000_000).alias("t_ns"))
    out = trajectory.extrapolate_states(queries, states).where("est is not null")
    return out.select("event_id", r6("est.x", 4).alias("x"))


KEYS = f"""WITH {T}, l AS (SELECT traj_id, list([{{'frame': frame, 'x': dist / 100, 'yaw': value / 1000}}] ORDER BY frame) AS poses FROM f GROUP BY traj_id),
k AS (SELECT traj_id, list_reduce(poses, lambda kept, p: CASE WHEN len(list_filter(kept, lambda k: abs(k.x - p[1].x) <= 5 AND abs(k.yaw - p[1].yaw) <= 3e-1)) > 0 THEN kept ELSE list_concat(kept, p) END) AS kept FROM l)
SELECT traj_id, unnest(list_transform(kept, lambda k: k.frame)) AS frame FROM k"""


@query("keyframes", KEYS)
def keyframes(spark, sf):
    return trajectory.keyframes(pose_frames(spark, sf), "traj_id", "frame", 5.0, 0.3).select("traj_id", "frame")


# a pose sets the place, odometry after it moves on by its own steps; velocity is what the last row that sets one gave
FUSED = f"""WITH {E}, r AS (SELECT user_id AS key, t_us, event_type AS kind, value AS v FROM e WHERE event_type IN ('click', 'view', 'error') AND user_id IS NOT NULL),
a AS (SELECT *, count(*) FILTER (kind = 'click') OVER w AS seg, last_value(CASE WHEN kind = 'view' THEN v END IGNORE NULLS) OVER w AS odo FROM r WINDOW w AS (PARTITION BY key ORDER BY t_us)),
b AS (SELECT *, first_value(v) OVER w AS place, first_value(t_us) OVER w AS since, first_value(odo IGNORE NULLS) OVER w AS base, lag(odo) OVER (PARTITION BY key ORDER BY t_us) AS odo_before FROM a WINDOW w AS (PARTITION BY key, seg ORDER BY t_us)),
c AS (SELECT *, CASE WHEN seg > 0 THEN place + coalesce(odo - base, 0) END AS x FROM b),
d AS (SELECT *, lag(x) OVER w AS x_before, (t_us - lag(since) OVER w) / 1e6 AS dt FROM c WINDOW w AS (PARTITION BY key ORDER BY t_us)),
g AS (SELECT *, CASE WHEN kind = 'error' THEN {{'on': true, 'vx': v}} WHEN kind = 'view' AND seg > 0 AND odo_before IS NOT NULL THEN {{'on': true, 'vx': 0e0}}
WHEN kind = 'click' THEN CASE WHEN seg > 1 AND dt < {trajectory.MAX_DT} THEN {{'on': true, 'vx': (v - x_before) / dt}} ELSE {{'on': false, 'vx': 0e0}} END END AS given FROM d),
h AS (SELECT *, last_value(given IGNORE NULLS) OVER (PARTITION BY key ORDER BY t_us) AS now FROM g)
SELECT key, t_us * 1000 AS t_ns, round(x, 6) + 0e0 AS x, round(now.vx, 6) + 0e0 AS vx, now.on AS has_twist FROM h WHERE seg > 0"""


@query("fused_states", FUSED)
def fused_states(spark, sf):
    """Stateful fusion in batch form: clicks are poses, views odometry, errors twists."""
    from waymark.streaming.stateful import POSE, TWIST, fuse_batch

    e = events(spark, sf).where("event_type in ('click', 'view', 'error')")
    kind = F.when(F.col("event_type") == "click", "pose").when(F.col("event_type") == "view", "odometry").otherwise("twist")
    zero = {c: F.lit(0.0) for c in (*POSE, *TWIST)}
    rows = e.select(F.col("user_id").alias("key"), (F.col("t_us") * 1000).alias("t_ns"), kind.alias("kind"), *((F.col("value") if c in ("x", "vx") else F.lit(1.0) if c == "qw" else v).alias(c) for c, v in zero.items()))
    return fuse_batch(rows).select("key", "t_ns", r6("x").alias("x"), r6("vx").alias("vx"), "has_twist")


# --- graph ----------------------------------------------------------------------------------------------------------


def factors(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fid"), (F.col("l_linenumber") - 1).alias("slot"), F.col("l_partkey").alias("entity_id"))


@query("graph_edges", "SELECT l_orderkey AS fid, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS slot, l_partkey AS entity_id FROM lineitem")
def graph_edges(spark, sf):
    """Lists of edges taken apart again: slots follow the line numbers."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("fid")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    edges = graph.edge_table(l.select("fid", F.transform("l", lambda s: s.l_partkey).alias("edges")))
    return edges.select("fid", "slot", "entity_id")


@query("graph_adjacency", "SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS least, max(l_orderkey) AS most FROM lineitem GROUP BY l_partkey")
def graph_adjacency(spark, sf):
    a = graph.adjacency(factors(spark, sf))
    return a.select("entity_id", F.size("fids").cast("long").alias("n"), F.element_at("fids", 1).alias("least"), F.element_at("fids", -1).alias("most"))


@query("graph_neighbors", "WITH e AS (SELECT DISTINCT l_orderkey AS fid, l_partkey AS entity_id FROM lineitem) SELECT DISTINCT a.entity_id, b.entity_id AS neighbour FROM e a JOIN e b USING (fid) WHERE a.entity_id <> b.entity_id")
def graph_neighbors(spark, sf):
    return graph.neighbours(factors(spark, sf))


@query("graph_degree", "SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS n_factors, count(*)::BIGINT AS n_edges FROM lineitem GROUP BY l_partkey")
def graph_degree(spark, sf):
    return graph.degrees(factors(spark, sf))


@query("factor_edge_at", "SELECT l_orderkey AS fid, count(*)::INTEGER AS n, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS first_edge FROM lineitem GROUP BY l_orderkey")
def factor_edge_at(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("fid")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    f = f.select("fid", F.transform("l", lambda s: s.l_partkey).alias("edges"))
    return f.select("fid", graph.edge_count(F.lit("Other"), F.col("edges")).alias("n"), graph.edge_at(F.col("edges"), F.lit(0)).alias("first_edge"))


KIND = "CASE o_orderstatus WHEN 'O' THEN 'RefPose3' WHEN 'F' THEN 'RelPose3' ELSE 'RelDynPose3KF' END"


def entities(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "RefPose3").when(F.col("o_orderstatus") == "F", "RelPose3").otherwise("RelDynPose3KF")
    twist = F.struct(*(F.col("o_totalprice").alias(c) for c in ("vx", "vy", "vz", "wx", "wy", "wz")))
    return o.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), geom.pose_of(F.col("o_totalprice"), 0, 0, 1, 0, 0, 0).col.alias("pose"), twist.alias("twist"))


@query("entity_dispatch", f"SELECT o_orderkey AS id, {KIND} AS kind, CASE WHEN o_orderstatus = 'O' THEN 0e0 ELSE o_totalprice END AS x, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_totalprice END AS vx FROM orders")
def entity_dispatch(spark, sf):
    e = entities(spark, sf)
    return e.select("id", "kind", graph.entity_pose(F.col("kind"), F.col("pose")).x.alias("x"), graph.entity_twist(F.col("kind"), F.col("twist")).vx.alias("vx"))


@query("entity_update", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'O' THEN 1e0 ELSE o_totalprice END AS x FROM orders")
def entity_update(spark, sf):
    e = entities(spark, sf)
    new = e.where("id % 2 = 0").select("id", geom.pose_of(1, 0, 0, 1, 0, 0, 0).col.alias("new_pose"))
    return graph.update_pose(e, new).select("id", F.col("pose.x").alias("x"))


@query("append_ids", "WITH t AS (SELECT coalesce(max(o_orderkey), -1) + 1 AS top FROM orders) SELECT c_custkey, top + row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer, t")
def append_ids(spark, sf):
    return graph.append_ids(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf, "customer").select("c_custkey"), "id", ["c_custkey"])


@query("lookup_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def lookup_ids(spark, sf):
    """Every order that a line item names."""
    return graph.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct())


@query("factor_events", "SELECT l_partkey AS entity_id, l_orderkey AS fid, 'edge' AS event FROM lineitem GROUP BY ALL")
def factor_events(spark, sf):
    """What a back end is told when every order's factor gets its edges."""
    return graph.factor_events(factors(spark, sf)).select("entity_id", "fid", "event")


@query("laser_scan_points", "SELECT event_id, i::INTEGER AS pt_idx, round(r * cos(-0.5e0 + 0.25e0 * i), 6) + 0e0 AS x, round(r * sin(-0.5e0 + 0.25e0 * i), 6) + 0e0 AS y FROM (SELECT event_id, unnest([value, value / 2, 0.05e0, value / 4]) AS r, unnest([0, 1, 2, 3]) AS i FROM events) WHERE r >= 0.1 AND r <= 50")
def laser_scan_points(spark, sf):
    payload = F.to_json(F.struct(F.lit(-0.5).alias("angle_min"), F.lit(0.25).alias("angle_increment"), F.lit(0.1).alias("range_min"), F.lit(50.0).alias("range_max"), F.array(F.col("value"), F.col("value") / 2, F.lit(0.05), F.col("value") / 4).alias("ranges")))
    m = table(spark, sf, "events").select(F.col("event_id").alias("t_ns"), F.col("event_type").alias("sensor_label"), payload.alias("payload"))
    p = messages.scan_points(messages.decoded(m, "Scan2D"))
    return p.select(F.col("t_ns").alias("event_id"), "pt_idx", r6("x").alias("x"), r6("y").alias("y"))


@query("odometry_messages", "SELECT event_id, event_type AS child, value AS x, value / 2 AS vx FROM events")
def odometry_messages(spark, sf):
    vec = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    turn = F.struct(*(F.lit(v).alias(c) for c, v in zip("xyzw", (0.0, 0.0, 0.0, 1.0), strict=True)))
    payload = F.struct(F.col("event_type").alias("child_frame_id"), F.struct(F.struct(vec(F.col("value")).alias("position"), turn.alias("orientation")).alias("pose")).alias("pose"), F.struct(F.struct(vec(F.col("value") / 2).alias("linear"), vec(F.lit(0.0)).alias("angular")).alias("twist")).alias("twist"))
    m = table(spark, sf, "events").select(F.col("event_id").alias("t_ns"), F.col("event_type").alias("sensor_label"), F.to_json(payload).alias("payload"))
    return messages.decoded(m, "Odometry").select(F.col("t_ns").alias("event_id"), "child", F.col("pose.x").alias("x"), F.col("twist.vx").alias("vx"))


@query("stamped", "SELECT event_id, epoch_us(ts) AS t FROM events")
def stamped(spark, sf):
    """Simulated time: the stamps of the data, not those of the wall clock."""
    return temporal.stamped(events(spark, sf), "t_us", simulated=True).select("event_id", F.col("stamp").alias("t"))


# --- dispatch and text ----------------------------------------------------------------------------------------------


@query("topic_kinds", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'Lidar2D' WHEN event_type = 'view' THEN 'GPS' WHEN event_type = 'error' THEN 'IMU' END AS kind FROM events")
def topic_kinds(spark, sf):
    type_ = F.when(F.col("event_type") == "view", "sensor_msgs/msg/NavSatFix").when(F.col("event_type") == "error", "sensor_msgs/msg/Imu").otherwise("other")
    return table(spark, sf, "events").select("event_id", dispatch.topic_kind(F.col("event_type"), type_, {"click": "Lidar2D"}).alias("kind"))


@query("unmapped_topics", "SELECT DISTINCT event_type AS topic FROM events WHERE event_type NOT IN ('click', 'view')")
def unmapped_topics(spark, sf):
    known = spark.createDataFrame([("click",), ("view",)], "topic string")
    return dispatch.unmapped_topics(table(spark, sf, "events").select(F.col("event_type").alias("topic")), known)


@query("kind_switch", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def kind_switch(spark, sf):
    return dispatch.by_kind(table(spark, sf, "events"), {"click": True, "view": False, "error": True}, "event_type").select("event_id")


@query("guarded_rows", "SELECT event_id, k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k IS NOT NULL")
def guarded_rows(spark, sf):
    good, _ = dispatch.guarded(table(spark, sf, "events"), "k", F.get_json_object("props", "$.k").try_cast("int"))
    return good.select("event_id", "k")


@query("datetime_ns", "SELECT o_orderkey, epoch_us(o_orderdate) * 1000 + 123456789 AS t_ns FROM orders")
def datetime_ns(spark, sf):
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(".123456789"))
    return table(spark, sf, "orders").select("o_orderkey", text.datetime_ns(line).alias("t_ns"))


@query("parse_numbers", "SELECT o_orderkey, round(o_totalprice, 2) AS second FROM orders")
def parse_numbers(spark, sf):
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.round("o_totalprice", 2).cast("string"), F.lit("x"))
    return table(spark, sf, "orders").select("o_orderkey", r6(text.numbers(line)[1], 2).alias("second"))


@query("progress_text", "SELECT o_orderkey, format('Timestep: {} / 100 ({:.2f}%)', o_orderkey % 100, (o_orderkey % 100)::DOUBLE) AS line FROM orders")
def progress_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.progress(F.col("o_orderkey") % 100, F.lit(100)).alias("line"))
