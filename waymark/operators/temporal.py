"""Time: merging, replaying, numbering and decimating streams, as-of and interpolating joins, rates, folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geom import interpolate
from waymark.sources.work import stored


def merge_streams(streams: Sequence[DataFrame], time: str = "t_ns", seq: str = "seq") -> DataFrame:
    """Bag union in time order; equal times keep the order of the streams and of their rows (``src_rank``, seq)."""
    ranked = [s.withColumn("src_rank", F.lit(i)) for i, s in enumerate(streams)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked).orderBy(time, "src_rank", seq)


def range_numbered(df: DataFrame, order: Sequence[str], name: str = "timestep") -> DataFrame:
    """Position from 0 in the whole order. Rows are sorted and counted by ranges, which are written once; a row a range is
    summed, so that no task sees all rows."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stored(laid.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    parts = laid.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    parts = parts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n") - F.col("_first")).alias("_shift"))
    return laid.join(F.broadcast(parts), "_p").withColumn(name, F.col("_m") + F.col("_shift")).drop("_p", "_m", "_shift")


def with_timestep(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Position from 0, per key."""
    if not keys:
        return range_numbered(df, order)
    return df.withColumn("timestep", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def at_timestep(df: DataFrame, step: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return with_timestep(df, order, keys).where(F.col("timestep") == step)


def replay_until(df: DataFrame, elapsed: int, time: str = "t_ns", warp: float = 1.0, start: int = 0) -> DataFrame:
    """Rows due after ``elapsed`` units of wall time at a speed, from a teleport point on: t - t0 <= start + elapsed * warp."""
    first = df.agg(F.min(time).alias("t0"))
    due = F.col(time) - F.col("t0")
    return df.crossJoin(F.broadcast(first)).where((due >= start) & (due <= start + int(elapsed * warp))).drop("t0")


def decimate(df: DataFrame, every: int, label: str, order: Sequence[str]) -> DataFrame:
    """Every Nth row of each label, the first included."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(label).orderBy(*order)) - 1).where(F.col("nth") % every == 0)


def forward(df: DataFrame, step: int, position: int, order: Sequence[str]) -> DataFrame:
    """Rows from a step on, for sources that only go on: a step before the position is refused."""
    if step < position:
        raise ValueError(f"cannot go back from {position} to {step}")
    return with_timestep(df, order).where(F.col("timestep") >= step)


def stamped(df: DataFrame, time: str, simulated: bool) -> DataFrame:
    """With ``stamp``: the data's own time, or the wall clock's in microseconds."""
    return df.withColumn("stamp", F.col(time) if simulated else F.unix_micros(F.current_timestamp()))


def drop_last(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    if not keys:
        rows = range_numbered(df, order, "_step")
        return rows.join(F.broadcast(rows.agg(F.max("_step").alias("_last"))), F.col("_step") < F.col("_last")).drop("_step", "_last")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_back", last).where("_back > 1").drop("_back")


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key; a partial aggregate, so a key with very many rows costs no more."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)))


def first_seen(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(F.min(F.struct(*order)).alias("r")).select(label, *(F.col(f"r.{c}").alias(f"first_{c}") for c in order))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], max_gap: int | None = None, inner: bool = True) -> DataFrame:
    """Each left row with the values of the latest right row at or before it, per key (a tagged union and one window).

    At equal times a right row counts as before a left one. ``<time>_right`` is the right row's time; rows without one, or
    with an older one than ``max_gap``, are dropped (inner) or keep nulls.
    """
    payload = F.struct(F.col(time).alias("_t"), *values)
    tagged = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(_struct_type(right, time, values))}).unionByName(
        right.select(*keys, time, F.lit(0).alias("_side"), payload.alias("_r")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = tagged.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    ok = F.col("_r").isNotNull() if max_gap is None else F.col(time) - F.col("_r._t") <= max_gap
    if inner:
        found = found.where(ok)
    return found.select(*left.columns, F.when(ok, F.col("_r._t")).alias(f"{time}_right"), *(F.when(ok, F.col(f"_r.{v}")).alias(v) for v in values))


def _struct_type(right: DataFrame, time: str, values: Sequence[str]) -> str:
    kinds = dict(right.dtypes)
    return "struct<" + ",".join(f"`{n}`:{kinds[c]}" for n, c in (("_t", time), *((v, v) for v in values))) + ">"


def bracket_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Each left row with the right values just at or before (``_prev``) and at or after it (``_next``), per key."""
    kind = _struct_type(right, time, [value])
    tagged = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(kind)}).unionByName(
        right.select(*keys, time, F.lit(0).alias("_side"), F.struct(F.col(time).alias("_t"), value).alias("_r")), allowMissingColumns=True
    )
    before = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(time), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.withColumns({"_p": F.last("_r", True).over(before), "_n": F.last("_r", True).over(after)}).where("_side = 1")
    return out.select(*left.columns, F.col("_p._t").alias(f"{time}_prev"), F.col(f"_p.{value}").alias(f"{value}_prev"), F.col("_n._t").alias(f"{time}_next"), F.col(f"_n.{value}").alias(f"{value}_next"))


def interp_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, max_gap: int, poses: bool = False) -> DataFrame:
    """Interpolating as-of join: linear, or linear and SLERP for poses; rows without both neighbours within the gap go."""
    b = bracket_join(left, right, keys, time, value)
    t, p, n = F.col(time), F.col(f"{time}_prev"), F.col(f"{time}_next")
    b = b.where(p.isNotNull() & n.isNotNull() & (n - p <= max_gap))
    u = F.when(n > p, (t - p) / (n - p)).otherwise(F.lit(0.0))
    a, c = F.col(f"{value}_prev"), F.col(f"{value}_next")
    b = b.withColumn("_u", u)
    out = interpolate(a, c, F.col("_u")).col if poses else a + (c - a) * F.col("_u")
    return b.select(*left.columns, out.alias(value))


def rates(df: DataFrame, label: str, time: str, order: Sequence[str], unit: float = 1e9) -> DataFrame:
    """Rate of each row to the one before of its label; 1.0 where time stands or goes back; null for the first row."""
    dt = (F.col(time) - F.lag(time).over(Window.partitionBy(label).orderBy(*order))) / unit
    return df.withColumn("dt", dt).withColumn("rate", F.when(F.col("dt") > 0, 1 / F.col("dt")).when(F.col("dt").isNotNull(), 1.0))


def rate_ema(df: DataFrame, label: str, time: str, order: Sequence[str], alpha: float = 0.9, unit: float = 1e9) -> DataFrame:
    """``(label, n, ema)``: exponential mean of the rates in order, seeded with the first one (as weights by the place from the end)."""
    with_rate = rates(df, label, time, order, unit).where("rate is not null")
    back = F.row_number().over(Window.partitionBy(label).orderBy(*(F.desc(c) for c in order))) - 1
    weighted = with_rate.withColumn("_w", F.pow(F.lit(alpha), back) * (1 - alpha) * F.col("rate"))
    first = F.min_by("rate", F.struct(*order))  # weighs alpha^(n-1), of which the sum has a part 1 - alpha
    return weighted.groupBy(label).agg(F.count("*").alias("n"), (F.sum("_w") + F.pow(F.lit(alpha), F.count("*")) * first).alias("ema"))


def stream_origin(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("t0"))


def centred_times(df: DataFrame, scan: str, t: str, sweep: float = 0.1) -> DataFrame:
    """Times of a scan's points from -sweep/2 on."""
    return df.withColumn(t, F.col(t) - F.min(t).over(Window.partitionBy(scan)) - sweep / 2)


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The k-th row of one side with the k-th of the other, per key."""
    a, b = with_timestep(left, left_order, keys), with_timestep(right, right_order, keys)
    return a.join(b, [*keys, "timestep"])


def idle(df: DataFrame, key: str, time: str, now: Column, age: int) -> DataFrame:
    """``(key, last_seen)`` of keys whose last access is older than ``age`` by event time."""
    last = df.groupBy(key).agg(F.max(time).alias("last_seen"))
    return last.where(now - F.col("last_seen") > age)
