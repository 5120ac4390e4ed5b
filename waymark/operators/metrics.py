"""Trajectory error metrics: path lengths, segments, errors by length and speed.

Frames are ``(traj_id, frame, …)``. The segment join is a range join within a trajectory; lengths are bucketed, so that a
start frame only meets the few buckets where its end can lie, and adding the trajectory as a key keeps it an equi join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from waymark.functions.geom import difference, norm, trace_angle

#: Segment lengths, the step of start frames, and the rate of frames (fixed values of the benchmark).
LENGTHS = (100, 200, 300, 400, 500, 600, 700, 800)
STEP, PERIOD, LEAST = 10, 0.1, 3
SPEEDS, HALF_WIDTH = tuple(range(2, 25, 2)), 2.0
#: Share of a path length by which its sum may be off: equal lengths differ by that when their steps are added in another order.
ROUNDING = 1e-12


def path_length(frames: DataFrame, order: str = "frame", key: str = "traj_id") -> DataFrame:
    """Adds ``dist``: length of the path up to the frame. ``frames`` have x, y, z."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    return frames.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("dist", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def segments(frames: DataFrame, lengths: Sequence[float] = LENGTHS, step: int = STEP, key: str = "traj_id") -> DataFrame:
    """``(key, first_frame, len, last_frame)``: the first later frame whose dist exceeds the start's by more than len.

    ``frames(key, frame, dist)`` with dist ascending. One equi join on (trajectory, bucket): a bucket is as wide as the
    shortest length, an end is found in the bucket of ``dist + len`` or, where that bucket has none behind it, as the first
    frame of the next bucket in use. Lengths that differ by no more than the rounding of their sums are equal, so that an
    end at exactly len is none, however the sums were rounded.
    """
    width = float(min(lengths))
    f = frames.select(key, "frame", "dist").withColumn("bucket", F.floor(F.col("dist") / width))
    heads = f.groupBy(key, "bucket").agg(F.min("frame").alias("head"))
    following = heads.select(key, "bucket", F.lead("head").over(Window.partitionBy(key).orderBy("bucket")).alias("next_head"))
    starts = f.where(F.col("frame") % step == 0).withColumn("len", F.explode(F.array(*(F.lit(float(x)) for x in lengths))))
    goal = F.col("dist") + F.col("len")
    starts = starts.select(key, F.col("frame").alias("first_frame"), "len", (goal + F.abs(goal) * ROUNDING).alias("goal"))
    starts = starts.withColumn("goal_bucket", F.floor(F.col("goal") / width))
    inside = starts.join(f.select(key, F.col("bucket").alias("goal_bucket"), "frame", "dist"), [key, "goal_bucket"]).where("dist > goal and frame >= first_frame")
    inside = inside.groupBy(key, "first_frame", "len").agg(F.min("frame").alias("last_frame"))
    # the bucket in use before or at the goal's, whose successor starts with the first frame behind it
    tagged = following.select(key, "bucket", F.lit(0).alias("side"), "next_head", F.lit(None).cast("long").alias("first_frame"), F.lit(None).cast("double").alias("len")).unionByName(
        starts.select(key, F.col("goal_bucket").alias("bucket"), F.lit(1).alias("side"), F.lit(None).cast(dict(following.dtypes)["next_head"]).alias("next_head"), F.col("first_frame").cast("long").alias("first_frame"), "len")
    )
    w = Window.partitionBy(key).orderBy("bucket", "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("side") == 0, F.struct("next_head")), ignorenulls=True).over(w)
    beyond = tagged.withColumn("c", carried).where("side = 1").select(key, "first_frame", "len", F.col("c.next_head").alias("fallback"))
    both = beyond.join(inside.withColumn("first_frame", F.col("first_frame").cast("long")), [key, "first_frame", "len"], "left")
    return both.select(key, "first_frame", "len", F.coalesce("last_frame", "fallback").cast("long").alias("last_frame")).where("last_frame is not null")


def speed(length: str = "len", first: str = "first_frame", last: str = "last_frame", period: float = PERIOD):
    return F.col(length) / (F.lit(period) * (F.col(last) - F.col(first) + 1))


def segment_errors(truth: DataFrame, result: DataFrame, lengths: Sequence[float] = LENGTHS, step: int = STEP, key: str = "traj_id") -> DataFrame:
    """``(key, first_frame, last_frame, len, r_err, t_err, speed)`` of two trajectories ``(key, frame, pose)``.

    Path lengths come from the ground truth; errors are of the relative poses and are divided by the length.
    """
    flat = truth.select(key, "frame", F.col("pose.x").alias("x"), F.col("pose.y").alias("y"), F.col("pose.z").alias("z"))
    pairs = segments(path_length(flat, key=key), lengths, step, key)
    both = truth.select(key, "frame", F.col("pose").alias("gt")).join(result.select(key, "frame", F.col("pose").alias("est")), [key, "frame"])
    ends = pairs.join(both.select(key, F.col("frame").alias("first_frame"), F.col("gt").alias("g0"), F.col("est").alias("e0")), [key, "first_frame"])
    ends = ends.join(both.select(key, F.col("frame").alias("last_frame"), F.col("gt").alias("g1"), F.col("est").alias("e1")), [key, "last_frame"])
    ends = ends.withColumns({"dg": difference(F.col("g1"), F.col("g0")).col, "de": difference(F.col("e1"), F.col("e0")).col})
    ends = ends.withColumn("err", difference(F.col("dg"), F.col("de")).col)
    return ends.select(key, "first_frame", "last_frame", "len", (trace_angle(F.col("err")) / F.col("len")).alias("r_err"), (norm(F.col("err")) / F.col("len")).alias("t_err"), speed().alias("speed"))


def error_by_length(errors: DataFrame, least: int = LEAST) -> DataFrame:
    out = errors.groupBy("len").agg(F.count("*").alias("n"), F.avg("t_err").alias("t_err"), F.avg("r_err").alias("r_err"))
    return out.where(F.col("n") >= least)


def error_by_speed(errors: DataFrame, speeds: Sequence[int] = SPEEDS, half: float = HALF_WIDTH, least: int = LEAST) -> DataFrame:
    """Bins overlap: an error counts for every speed it is nearer to than ``half``."""
    near = F.filter(F.array(*(F.lit(float(s)) for s in speeds)), lambda s: F.abs(F.col("speed") - s) < half)
    out = errors.withColumn("bin", F.explode(near)).groupBy("bin").agg(F.count("*").alias("n"), F.avg("t_err").alias("t_err"), F.avg("r_err").alias("r_err"))
    return out.where(F.col("n") >= least)


def error_overall(errors: DataFrame) -> DataFrame:
    """Percent of translation and degrees a metre."""
    return errors.agg(F.count("*").alias("n"), (100 * F.avg("t_err")).alias("t_percent"), F.degrees(F.avg("r_err")).alias("r_deg"))


def concatenated(errors: Sequence[DataFrame]) -> DataFrame:
    """Errors of several sequences, in one table with the sequence's number."""
    return reduce(DataFrame.unionByName, (e.withColumn("sequence", F.lit(i)) for i, e in enumerate(errors)))


def stats(errors: DataFrame) -> DataFrame:
    """One row of totals: mean errors as fractions and radians a metre, with the numbers of segments."""
    return errors.agg(F.count("*").alias("segments"), F.avg("t_err").alias("t_err"), F.avg("r_err").alias("r_err"), F.max("t_err").alias("worst_t_err"))


def path_rows(truth: DataFrame, result: DataFrame, key: str = "traj_id") -> DataFrame:
    """What a plot of both paths shows: ``(key, frame, gt_x, gt_z, x, z)``."""
    a = truth.select(key, "frame", F.col("pose.x").alias("gt_x"), F.col("pose.z").alias("gt_z"))
    return a.join(result.select(key, "frame", F.col("pose.x").alias("x"), F.col("pose.z").alias("z")), [key, "frame"])


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """The frame with named measures that are taken while it is computed, without another pass."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in measures.items())), seen


def same_counts(truth: DataFrame, result: DataFrame, key: str = "traj_id") -> DataFrame:
    """Trajectories whose numbers of poses differ or are zero; evaluation asks that there are none."""
    a, b = truth.groupBy(key).agg(F.count("*").alias("n_truth")), result.groupBy(key).agg(F.count("*").alias("n_result"))
    return a.join(b, key, "full").where("n_truth is null or n_result is null or n_truth <> n_result")


def roi_square(paths: DataFrame, pad: float = 1.1) -> DataFrame:
    """``(x0, x1, y0, y1)``: padded square around the points ``(x, y)``, truncated to integers."""
    e = paths.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    half = 0.5 * pad * F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"))
    mx, my = (F.col("lx") + F.col("hx")) / 2, (F.col("ly") + F.col("hy")) / 2
    return e.select((mx - half).cast("int").alias("x0"), (mx + half).cast("int").alias("x1"), (my - half).cast("int").alias("y0"), (my + half).cast("int").alias("y1"))
