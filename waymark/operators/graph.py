"""World model as three tables: entities, factors, and the edges between them.

``entities(id, kind, base_id, t_ns, pose, twist, point)``, ``factors(fid, kind, edges array<long>, …)``,
``edges(fid, slot, entity_id)``. Neighbours are one self join on the factor id; entities or factors with very many edges
only meet partial aggregates and joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geom import identity
from waymark.operators.temporal import range_numbered

#: The tagged unions' alternatives and the number of edges of each factor with a fixed number (fixed values).
ENTITY_KINDS = ("RefPose3", "RelPose3", "RelPose3KF", "RelDynPose3KF", "LandmarkPoint3", "Other")
FACTOR_KINDS = ("RelativePose3", "DynamicsConstVel", "StereoProjectionPose", "SmartStereoProjectionPose", "SmartIMU", "Other")
FACTOR_EDGES = {"RelativePose3": 2, "DynamicsConstVel": 2, "StereoProjectionPose": 2}
ROBUST_KINDS = ("L2", "HUBER", "CAUCHY", "TUKEY", "WELSH", "GEMANMCCLURE")
WITH_POSE, WITH_TWIST = ("RelPose3", "RelPose3KF", "RelDynPose3KF"), ("RelDynPose3KF",)


def edge_table(factors: DataFrame) -> DataFrame:
    return factors.select("fid", F.posexplode("edges").alias("slot", "entity_id"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(entity_id, fids)``: the sorted set of factors of each entity."""
    return edges.groupBy("entity_id").agg(F.array_sort(F.collect_set("fid")).alias("fids"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(entity_id, n_factors, n_edges)``; needs no lists, so that an entity with very many factors is no problem."""
    pairs = edges.groupBy("entity_id", "fid").agg(F.count("*").alias("k"))
    return pairs.groupBy("entity_id").agg(F.count("*").alias("n_factors"), F.sum("k").alias("n_edges"))


def neighbours(edges: DataFrame, of: DataFrame | None = None, with_self: bool = False) -> DataFrame:
    """``(entity_id, neighbour)`` pairs that share a factor, without repeats; ``of`` restricts the first side."""
    e = edges.select("fid", "entity_id").distinct()
    start = e if of is None else e.join(of.select("entity_id"), "entity_id", "left_semi")
    pairs = start.join(e.select("fid", F.col("entity_id").alias("neighbour")), "fid").select("entity_id", "neighbour").distinct()
    return pairs if with_self else pairs.where("entity_id <> neighbour")


def append_ids(table: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows with dense ids after the table's largest (from 0).

    Ids are dealt by ranges: rows are counted by range partition and numbered inside it, so no task sorts all rows.
    """
    top = table.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("_top"))
    numbered = range_numbered(new, order, "_place").crossJoin(F.broadcast(top))
    return numbered.withColumn(key, F.col("_top") + F.col("_place")).drop("_place", "_top")


def lookup(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted keys; a wanted key that is missing fails the query, as a lookup by id must."""
    found = wanted.select(key).join(table.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.assert_true(F.col("_found").isNotNull(), F.concat(F.lit("no row with id "), F.col(key).cast("string"))).isNull(), F.col(key))
    return found.withColumn(key, checked).drop("_found")


def entity_pose(kind: Column, own: Column) -> Column:
    """The pose by kind: identity for the reference frame, null (no pose) for others without one."""
    return F.when(kind == "RefPose3", identity().col).when(kind.isin(*WITH_POSE), own)


def entity_twist(kind: Column, own: Column) -> Column:
    return F.when(kind.isin(*WITH_TWIST), own)


def required(value: Column, what: str) -> Column:
    """The value; a null fails the query."""
    return F.when(F.assert_true(value.isNotNull(), F.lit(f"entity without {what}")).isNull(), value)


def update_pose(entities: DataFrame, new: DataFrame) -> DataFrame:
    """``new(id, new_pose)`` replaces the poses of entities whose kind has one."""
    joined = entities.join(new, "id", "left")
    can = F.col("kind").isin(*WITH_POSE) & F.col("new_pose").isNotNull()
    return joined.withColumn("pose", F.when(can, F.col("new_pose")).otherwise(F.col("pose"))).drop("new_pose").select(*entities.columns)


def update_twist(entities: DataFrame, new: DataFrame) -> DataFrame:
    joined = entities.join(new, "id", "left")
    can = F.col("kind").isin(*WITH_TWIST) & F.col("new_twist").isNotNull()
    return joined.withColumn("twist", F.when(can, F.col("new_twist")).otherwise(F.col("twist"))).drop("new_twist").select(*entities.columns)


def edge_count(kind: Column, edges: Column) -> Column:
    """By kind; smart factors have as many as they list, and none without a list. A factor of a kind with a fixed number that lists another is an error."""
    listed = F.coalesce(F.size(edges), F.lit(0))
    listed = F.when(listed < 0, 0).otherwise(listed)
    out = listed
    for k, n in FACTOR_EDGES.items():
        whole = F.assert_true(listed == n, F.concat(F.lit(f"{k} has {n} edges, not "), listed.cast("string")))
        out = F.when(kind == k, F.when(whole.isNull(), n)).otherwise(out)
    return out


def edge_at(edges: Column, i: Column) -> Column:
    """Bounds-checked: outside is an error."""
    ok = F.assert_true((i >= 0) & (i < F.size(edges)), F.lit("no such edge"))
    return F.when(ok.isNull(), F.element_at(edges, i + 1))


def factor_events(edges: DataFrame) -> DataFrame:
    """``(entity_id, fid, event)``: what a back end is told of each entity that a factor has got as an edge; a table to append to."""
    return edges.select("entity_id", "fid").distinct().withColumn("event", F.lit("edge"))


class BackEnd:
    """Tables that key frames, factors and poses are appended to; a solver reads them and advertises what it found.

    Ids go on from the largest in the table; each call writes one batch, and one writer is expected.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was written yet
            return None

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def _dealt(self, name: str, key: str, rows: DataFrame, order: list[str]) -> DataFrame:
        old = self.table(name)
        return append_ids(rows.limit(0).select(F.lit(0).cast("long").alias(key)) if old is None else old.select(key), rows, key, order)

    def add_keyframes(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """Entities with their new ids."""
        out = self._dealt("entities", "id", rows, order)
        self._append("entities", out)
        return out

    def add_factors(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """Factors (with ``edges``) with their new ids; the events of their edges are appended as well."""
        out = self._dealt("factors", "fid", rows, order)
        self._append("factors", out)
        self._append("events", factor_events(edge_table(out)))
        return out

    def advertise(self, poses: DataFrame) -> None:
        """``(t_ns, frame, pose)`` for those who follow."""
        self._append("poses", poses)

    def latest_pose(self, frame: str) -> DataFrame:
        return self.table("poses").where(F.col("frame") == frame).agg(F.max("t_ns").alias("t_ns"), F.max_by("pose", "t_ns").alias("pose"))


def annotations(entities: DataFrame, blobs: DataFrame, name: str) -> DataFrame:
    """``(id, data)`` of one annotation; only its column is read."""
    return entities.select("id").join(blobs.where(F.col("name") == name).select("id", "data"), "id", "left")
