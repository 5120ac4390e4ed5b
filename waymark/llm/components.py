"""Connected components by repeated hooking to the smallest neighbour and contraction.

Each round every node points at its smallest neighbour if that is smaller than itself, pointers are
doubled twice, and the links are rewritten between the nodes pointed at. Links that fall together
vanish, so rounds shrink fast; nodes, links and labels stay distributed. Links between the same two
nodes are pre-aggregated before each shuffle, and a node with very many links only ever takes part in
partial aggregates and in joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import drop_saved, saved

ROUNDS = 60


def connected_components(links: DataFrame, name: str = "cc") -> DataFrame:
    """``links(a, b)`` to ``(node, root)`` with root the smallest node that can be reached; only linked nodes appear.

    Links with a null end and links of a node with itself say nothing and are left out.
    """
    edges = saved(links.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = saved(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct().select("node", F.col("node").alias("root")), f"{name}-labels")
    for _ in range(ROUNDS):
        if edges.isEmpty():
            return labels
        hooks = [saved(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), f"{name}-hooks")]
        for _ in range(2):  # pointer doubling: a node whose target points on follows it
            hooks.append(saved(_followed(hooks[-1]), f"{name}-hooks"))
        old, hooks_ = (labels, edges, *hooks), hooks[-1]
        labels = saved(_mapped(labels, hooks_, "root"), f"{name}-labels")
        edges = saved(_mapped(_mapped(edges, hooks_, "a"), hooks_, "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
        for df in old:
            drop_saved(df)
    raise RuntimeError("components did not settle")


def _followed(hooks: DataFrame) -> DataFrame:
    on = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return hooks.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"))


def _mapped(df: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    return df.join(hooks.select(F.col("node").alias(column), F.col("to").alias("_to")), column, "left").select(*[F.coalesce("_to", column).alias(column) if c == column else F.col(c) for c in df.columns])
