"""Queries by name over the driver's tables, with the SQL that checks each.

``P(x, y, z)`` are the first three components of ``embeddings``; a trajectory is the events of a user in (ts, event_id)
order with ``value`` as the step; sensor streams are event types; factors are orders and entities are parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, n: int = 6):
    """Rounded, without a negative zero, so that engines agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def points(spark, sf_dir, label: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), *cols, *(["label"] if label else []))


def events(spark, sf_dir) -> DataFrame:
    """Events with ``t_us``, microseconds that don't depend on the session's time zone."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").withColumn("t_us", t)


P = "p AS (SELECT vec_id AS id, vec_id AS seq, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
C = f"{P}, c AS (SELECT *, trunc(x * 10e0)::INTEGER AS cx, trunc(y * 10e0)::INTEGER AS cy, trunc(z * 10e0)::INTEGER AS cz FROM p)"
CR = f"{P}, c AS (SELECT *, round_even(x * 10e0, 0)::INTEGER AS cx, round_even(y * 10e0, 0)::INTEGER AS cy, round_even(z * 10e0, 0)::INTEGER AS cz FROM p)"
CH = f"{P}, c AS (SELECT *, trunc((x + 5e-2) * 10e0)::INTEGER AS cx, trunc((y + 5e-2) * 10e0)::INTEGER AS cy, trunc((z + 5e-2) * 10e0)::INTEGER AS cz FROM p)"
E = "e AS (SELECT *, epoch_us(ts) AS t_us FROM events)"
T = f"{E}, f AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id, t_us, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS dist FROM e)"

from waymark.plans import catalogue_base, catalogue_maps, catalogue_poses, catalogue_time  # noqa: E402, F401
