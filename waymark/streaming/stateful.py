"""Structured Streaming: replay, keep-latest, decimation, windows, and the stateful fusion of poses and twists.

State is held by key in the state store with a time-out for idle keys; rows of a key in a micro-batch are taken in time
order. The batch form of the fusion uses the same step function over sorted keys, so both agree on the same input.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.functions.cells import with_cells
from waymark.operators.maps import HASHED_CAP
from waymark.operators.trajectory import MAX_DT, Kept

POSE = ("x", "y", "z", "qw", "qx", "qy", "qz")
TWIST = ("vx", "vy", "vz", "wx", "wy", "wz")
ROW = "key long, t_ns long, kind string, " + ", ".join(f"{c} double" for c in (*POSE, *TWIST))
OUT = "key long, t_ns long, " + ", ".join(f"{c} double" for c in (*POSE, *TWIST)) + ", has_twist boolean, late boolean"
STATE = "t_ns long, has_pose boolean, has_twist boolean, has_odom boolean, " + ", ".join(f"{c} double" for c in POSE) + ", " + ", ".join(f"{c} double" for c in TWIST) + ", ox double, oy double, oyaw double"
EMPTY = (None, False, False, False, *([0.0] * 3), 1.0, *([0.0] * 3), *([0.0] * 6), 0.0, 0.0, 0.0)


def _mul(a, b):
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def _turn(q, v):
    _, x, y, z = _mul(_mul(q, (0.0, *v)), (q[0], -q[1], -q[2], -q[3]))
    return x, y, z


def _log(q):
    n = math.sqrt(q[1] ** 2 + q[2] ** 2 + q[3] ** 2)
    sign = -1.0 if q[0] < 0 else 1.0
    k = 2.0 * sign if n < 1e-12 else sign * 2 * math.atan2(n, sign * q[0]) / n
    return k * q[1], k * q[2], k * q[3]


def fuse_step(state: tuple, row: dict, max_dt: float = MAX_DT) -> tuple:
    """State after a row of kind ``pose``, ``odometry`` (x, y and a planar rotation), ``twist`` or ``imu`` (no effect)."""
    s = list(state)
    t, has_pose, has_odom = s[0], s[1], s[3]
    p, q = tuple(s[4:7]), tuple(s[7:11])
    kind = row["kind"]
    if kind == "pose":
        new_p, new_q = tuple(row[c] for c in POSE[:3]), tuple(row[c] for c in POSE[3:])
        dt = 0.0 if t is None else (row["t_ns"] - t) / 1e9
        if has_pose and dt < max_dt:
            if dt <= 0:
                raise ValueError("poses must go on in time")
            back = (q[0], -q[1], -q[2], -q[3])
            inc = _turn(back, tuple(a - b for a, b in zip(new_p, p, strict=True)))
            s[11:17] = [x / dt for x in (*inc, *_log(_mul(back, new_q)))]
            s[2] = True
        else:
            s[2], s[11:17] = False, [0.0] * 6
        s[0], s[1], s[4:7], s[7:11] = row["t_ns"], True, list(new_p), list(new_q)
    elif kind == "odometry":
        yaw = 2 * math.atan2(row["qz"], row["qw"])
        if has_odom and has_pose:
            dx, dy, turn = row["x"] - s[17], row["y"] - s[18], yaw - s[19]
            c, n = math.cos(s[19]), math.sin(s[19])
            move = _turn(q, (c * dx + n * dy, -n * dx + c * dy, 0.0))
            s[4:7] = [a + b for a, b in zip(p, move, strict=True)]
            s[7:11] = list(_mul(q, (math.cos(turn / 2), 0.0, 0.0, math.sin(turn / 2))))
            s[2], s[11:17] = True, [0.0] * 6  # the velocity model is discarded; the pose's time stays
        s[3], s[17], s[18], s[19] = True, row["x"], row["y"], yaw
    elif kind == "twist":
        s[2], s[11:17] = True, [row[c] for c in TWIST]
    return tuple(s)


def _states(key: int, rows: pd.DataFrame, state: tuple) -> tuple[list, tuple]:
    """A pose that isn't behind the last one in time changes nothing; its row is marked late."""
    out = []
    for row in rows.sort_values(["t_ns"], kind="stable").to_dict("records"):
        late = row["kind"] == "pose" and state[1] and row["t_ns"] <= state[0]
        if not late:
            state = fuse_step(state, row)
        if state[1]:
            out.append((key, row["t_ns"], *state[4:17], state[2], late))
    return out, state


def split_late(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States, and the late rows for quarantine."""
    return states.where("not late").drop("late"), states.where("late").select("key", "t_ns")


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "t_ns", *POSE, *TWIST, "has_twist", "late"])


def fuse_batch(rows: DataFrame) -> DataFrame:
    """The state after each row, per key in time order; streamed over sorted partitions, only the last state is held."""
    names = ["key", "t_ns", "kind", *POSE, *TWIST]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, EMPTY
        for pdf in batches:
            out = []
            for key, part in pdf.groupby("key", sort=False):
                if key != now:
                    now, state = key, EMPTY
                made, state = _states(int(key), part, state)
                out += made
            yield _frame(out)

    return rows.select(*names).where("key is not null").repartition("key").sortWithinPartitions("key", "t_ns").mapInPandas(run, OUT)


def fuse_stream(rows: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same on a stream; keys that stay idle for ``idle_ms`` lose their state (processing time)."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else EMPTY
        out, held = _states(int(key[0]), pd.concat(list(parts)), held)
        state.update(held)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield _frame(out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.where("key is not null").groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", timeout)


def fuse_stream_by_event_time(rows: DataFrame, late: str, idle_ms: int) -> DataFrame:
    """The same with time-outs by event time: a key goes when the watermark has passed its last row by ``idle_ms``. Rows need ``ts``."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows_ = pd.concat(list(parts))
        out, held = _states(int(key[0]), rows_, tuple(state.get) if state.exists else EMPTY)
        state.update(held)
        state.setTimeoutTimestamp(max(int(rows_["t_ns"].max() // 1_000_000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield _frame(out)

    timed = rows.where("key is not null").withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def integrate_stream(samples: DataFrame) -> DataFrame:
    """Rotation since the last reset, ``(key, t_ns, dt, n, qw, qx, qy, qz)`` for each row ``(key, t_ns, wx, wy, wz, dt, reset)``.

    A reset starts at identity before its row counts (a new key frame). The state is one rotation a key.
    """

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n, *q = state.get if state.exists else (0.0, 0, 1.0, 0.0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(parts)).sort_values("t_ns", kind="stable").itertuples():
            if r.reset:
                total, n, q = 0.0, 0, (1.0, 0.0, 0.0, 0.0)
            half = 0.5 * r.dt * math.sqrt(r.wx**2 + r.wy**2 + r.wz**2)
            k = 0.5 * r.dt if half < 1e-12 else math.sin(half) / half * 0.5 * r.dt
            total, n, q = total + r.dt, n + 1, _mul(tuple(q), (math.cos(half), k * r.wx, k * r.wy, k * r.wz))
            out.append((int(key[0]), r.t_ns, total, n, *q))
        state.update((float(total), int(n), *map(float, q)))
        yield pd.DataFrame(out, columns=["key", "t_ns", "dt", "n", "qw", "qx", "qy", "qz"])

    cells = "dt double, n long, qw double, qx double, qy double, qz double"
    return samples.where("key is not null").groupBy("key").applyInPandasWithState(run, f"key long, t_ns long, {cells}", cells, "append", GroupStateTimeout.NoTimeout)


def keyframes_stream(poses: DataFrame, distance: float, angle: float) -> DataFrame:
    """Greedy gating of ``(key, t_ns, x … qz)``: rows that become key frames. The state is the key's key frames."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat = state.get[0] if state.exists else []
        kept = Kept(distance, angle, [flat[i : i + 7] for i in range(0, len(flat), 7)])
        rows = pd.concat(list(parts)).sort_values("t_ns", kind="stable")
        out = rows[[kept.offer(p) for p in rows[list(POSE)].to_numpy(float)]]
        state.update((list(flat) + out[list(POSE)].to_numpy(float).ravel().tolist(),))
        yield out[["key", "t_ns", *POSE]]

    cells = ", ".join(f"{c} double" for c in POSE)
    return poses.where("key is not null").groupBy("key").applyInPandasWithState(run, f"key long, t_ns long, {cells}", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def insert_stream(points: DataFrame, size: float, limit: int = 0, mode: str = "trunc", hard_cap: int = HASHED_CAP) -> DataFrame:
    """Incremental map insertion: the points ``(seq, x, y, z)`` that their voxel takes, ``(cx, cy, cz, seq, x, y, z, sub)``.

    State is one counter a voxel, so a map of any size is spread over the state store; a full voxel takes no more. Over batches
    in the order of ``seq`` the rows are those of the batch form.
    """
    cap = min(limit or hard_cap, hard_cap)

    def run(cell: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        if held >= cap:
            return
        rows = pd.concat([p.nsmallest(cap - held, "seq") for p in parts]).nsmallest(cap - held, "seq")
        rows = rows[["cx", "cy", "cz", "seq", "x", "y", "z"]].assign(sub=range(held, held + len(rows)))
        state.update((held + len(rows),))
        yield rows

    schema = "cx int, cy int, cz int, seq long, x double, y double, z double, sub int"
    return with_cells(points, size, mode).groupBy("cx", "cy", "cz").applyInPandasWithState(run, schema, "n int", "append", GroupStateTimeout.NoTimeout)


class Player:
    """A replay that can be paused, resumed and moved on.

    Pausing stops the query; its checkpoint keeps the place, so resuming goes on with the next row. ``seek`` starts another
    checkpoint from a time on; sources that only go on refuse a time before the one they have reached.
    """

    def __init__(self, stream: DataFrame, sink, checkpoint: str, time: str = "t_ns", forward_only: bool = False):
        self.stream, self.sink, self.checkpoint, self.time, self.forward_only = stream, sink, checkpoint, time, forward_only
        self.start, self.reached, self.moves, self.query = None, None, 0, None

    def _each(self, batch: DataFrame, epoch: int) -> None:
        self.sink(batch, epoch)
        last = batch.agg(F.max(self.time)).first()[0]
        self.reached = last if self.reached is None else max(self.reached, last if last is not None else self.reached)

    def resume(self):
        rows = self.stream if self.start is None else self.stream.where(F.col(self.time) >= self.start)
        self.query = run_available(rows, self._each, f"{self.checkpoint}/{self.moves}").start()
        return self.query

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()

    def seek(self, time: int) -> None:
        if self.forward_only and self.reached is not None and time < self.reached:
            raise ValueError(f"cannot go back from {self.reached} to {time}")
        self.pause()
        self.start, self.moves = time, self.moves + 1


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, options: dict | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a micro-batch; pacing by wall clock is left to the trigger."""
    return spark.readStream.schema(schema).options(**(options or {})).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Keep-latest per key (update mode): one row of state a key."""
    rest = [c for c in rows.columns if c not in (*keys, time)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in (time, *rest)))


def publish_every(stream: DataFrame, seconds: float, sink, checkpoint: str):
    """Drains the latest values on a timer."""
    return stream.writeStream.outputMode("update").trigger(processingTime=f"{int(seconds * 1000)} milliseconds").foreachBatch(sink).option("checkpointLocation", checkpoint)


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Takes what is there and ends (end of stream)."""
    return stream.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(sink).option("checkpointLocation", checkpoint)


def windowed_counts(rows: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    if late:
        rows = rows.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w, key).agg(F.count("*").alias("n"))


def decimated(rows: DataFrame, label: str, every: int) -> DataFrame:
    """Every Nth row of a label over all micro-batches; the state is a counter a label."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for pdf in parts:
            yield pdf[[(seen + i) % every == 0 for i in range(len(pdf))]]
            seen += len(pdf)
        state.update((seen,))

    return rows.groupBy(label).applyInPandasWithState(run, ", ".join(columns), "seen long", "append", GroupStateTimeout.NoTimeout)
