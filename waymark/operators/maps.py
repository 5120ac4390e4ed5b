"""Voxel maps as DataFrames: points in long form with a cell, and the operators on them.

A map is ``(…, seq, x, y, z)`` with ``seq`` the order of insertion; voxels are never more than rows of a cell. Everything
but the greedy insertion is a projection and one shuffle by cell, with caps applied before joins so that dense cells
stay bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.cells import block_of, cell_distance, cell_index, inner_of, with_cells

CELL = ("cx", "cy", "cz")
#: Points a voxel holds at most when no limit is given (fixed values of the two maps).
HASHED_CAP, SPARSE_CAP = 32, 16


def downsample(points: DataFrame, size: float, limit: int = 0, mode: str = "trunc", order: str = "seq", hard_cap: int = HASHED_CAP) -> DataFrame:
    """The first ``limit`` points of each cell in insertion order; 0 means the map's hard cap."""
    cap = min(limit or hard_cap, hard_cap)
    first = Window.partitionBy(*CELL).orderBy(order)
    return with_cells(points, size, mode).withColumn("sub", F.row_number().over(first) - 1).where(F.col("sub") < cap)


def voxel_means(points: DataFrame, size: float, mode: str = "round", order: str = "seq", hard_cap: int = SPARSE_CAP) -> DataFrame:
    """``(cx, cy, cz, n, mx, my, mz)`` of the stored points of each voxel."""
    kept = downsample(points, size, 0, mode, order, hard_cap)
    return kept.groupBy(*CELL).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))


def voxel_counts(points: DataFrame, size: float, mode: str = "trunc", hard_cap: int = HASHED_CAP) -> DataFrame:
    """One row: occupied voxels and stored points. Partial sums by cell, nothing but counts is shuffled."""
    cells = with_cells(points, size, mode).groupBy(*CELL).agg(F.count("*").alias("n"))
    return cells.agg(F.count("*").alias("voxels"), F.coalesce(F.sum(F.least("n", F.lit(hard_cap))), F.lit(0)).cast("long").alias("points"))


def bounding_box(points: DataFrame) -> DataFrame:
    """Exact extent of the points; zeros for an empty map."""
    return points.agg(*(F.coalesce(f(c).cast("double"), F.lit(0.0)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))


def blocks(points: DataFrame, size: float, mode: str = "round") -> DataFrame:
    """Points with their two-level address: outer block (bx, by, bz) and inner cell (ix, iy, iz)."""
    out = with_cells(points, size, mode)
    return out.withColumns({f"b{c}": block_of(F.col(f"c{c}")) for c in "xyz"} | {f"i{c}": inner_of(F.col(f"c{c}")) for c in "xyz"})


def block_sizes(points: DataFrame, size: float, mode: str = "round") -> DataFrame:
    return blocks(points, size, mode).groupBy("bx", "by", "bz").agg(F.count("*").alias("points"), F.countDistinct("ix", "iy", "iz").alias("voxels"))


def prune_far(cells: DataFrame, size: float, centre: tuple[float, float, float], distance: float, mode: str = "trunc") -> DataFrame:
    """Keeps cells within ceil(distance / size) cells (Chebyshev) of the centre's."""
    at = [F.lit(c) for c in centre]
    around = [cell_index(c, size, mode) for c in at]
    reach = -int(-distance // size)
    return cells.where(F.greatest(*(F.abs(F.col(n) - c) for n, c in zip(CELL, around, strict=True))) <= reach)


def prune_box(cells: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Keeps cells inside an axis-aligned box of cells; the bounds reach the scan where cells are stored columns."""
    keep = F.lit(True)
    for n, lo, hi in zip(CELL, low, high, strict=True):
        keep &= F.col(n).between(lo, hi)
    return cells.where(keep)


def _greedy(names: list[str], cap: int, least: float):
    """Streams rows sorted by cell and order. In each round the first row that a cell has left is kept, and those near it go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros((0, 3))  # the cell that a batch ended in, and what it has kept
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i) for i in range(len(names))]
            edge = np.zeros(batch.num_rows, bool)
            edge[0] = True
            for c in own:
                code = c.dictionary_encode().indices.fill_null(-1).to_numpy()
                edge[1:] |= code[1:] != code[:-1]
            cell = np.cumsum(edge) - 1
            xyz = np.stack([batch.column(batch.schema.get_field_index(c)).fill_null(np.nan).to_numpy().astype(float) for c in "xyz"], axis=1)
            count, kept, left = np.zeros(cell[-1] + 1, np.int64), [], np.arange(len(cell))
            before = held if repr([c[0].as_py() for c in own]) == last else held[:0]
            count[0] = len(before)
            for p in before:
                left = left[(cell[left] > 0) | ~(((xyz[left] - p) ** 2).sum(axis=1) < least)]
            while True:
                left = left[count[cell[left]] < cap]
                if not len(left):
                    break
                at = np.flatnonzero(np.diff(cell[left], prepend=-1))
                first = left[at]
                kept.append(first)
                count[cell[first]] += 1
                of = np.repeat(first, np.diff(np.append(at, len(left))))
                left = left[~(((xyz[left] - xyz[of]) ** 2).sum(axis=1) < least) & (left != of)]
            rows = np.sort(np.concatenate(kept)) if kept else left
            here = xyz[rows[cell[rows] == cell[-1]]]
            held = np.concatenate((before, here)) if cell[-1] == 0 else here
            last = repr([c[-1].as_py() for c in own])
            yield batch.take(pa.array(rows))

    return run


def min_distance_insert(points: DataFrame, size: float, distance: float, limit: int = 0, mode: str = "trunc", hard_cap: int = HASHED_CAP, keys: tuple[str, ...] = ()) -> DataFrame:
    """Greedy insertion: a point is rejected if a point kept before it in its cell is nearer than ``distance``.

    Cells are independent; each is folded in insertion order, as sorted partitions are streamed: only what a cell has kept is
    held, which the cap bounds, so that a hot cell takes one task's time but no more memory. A point at exactly the distance is
    kept, and so is one without a place, which is near to nothing. A full cell rejects.
    """
    cap = min(limit or hard_cap, hard_cap)
    names = [*keys, *CELL]
    rows = with_cells(points, size, mode).select(*names, "seq", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return rows.repartition(*names).sortWithinPartitions(*names, "seq").mapInArrow(_greedy(names, cap, distance * distance), rows.schema)


def clearance_insert(batch: DataFrame, base: DataFrame, size: float, distance: float, mode: str = "half_shift") -> DataFrame:
    """Points of a batch that are farther than ``distance`` from every point of the map as it was in their own cell.

    The batch is checked against the snapshot, so its points never suppress each other; exactly the distance is rejected.
    """
    a = with_cells(batch, size, mode)
    b = with_cells(base, size, mode).select(*CELL, F.col("x").alias("mx"), F.col("y").alias("my"), F.col("z").alias("mz"))
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 + (F.col("z") - F.col("mz")) ** 2
    near = a.join(b, list(CELL)).where(d2 <= distance * distance).select("seq").distinct()
    return a.join(near, "seq", "left_anti")


def scan_likelihood(matches: DataFrame, sigma: float, max_distance: float, d2: str = "d2") -> DataFrame:
    """Minus the mean of clamped squared distances over sigma; unmatched points count with 0; an empty scan or map gives 0.

    ``matches`` has one row a scan point with its squared distance to the nearest map point, or null.
    """
    error = F.least(F.coalesce(F.col(d2), F.lit(0.0)), F.lit(max_distance * max_distance))
    return matches.agg(F.count("*").alias("points"), F.coalesce(-F.sum(error) / F.count("*") / sigma, F.lit(0.0)).alias("log_likelihood"))


def decimate_points(points: DataFrame, every: int = 10, index: str = "seq") -> DataFrame:
    return points.where(F.col(index) % every == 0)


def histogram(values: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """``(bin, n)`` of equal-width bins between the extremes; one value makes one bin."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    cell = F.when(F.col("hi") > F.col("lo"), F.least(at, F.lit(bins - 1))).otherwise(0).cast("int")
    return values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).select(cell.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def confidence_range(hist: DataFrame, tail: float = 0.02) -> DataFrame:
    """First and last bin left when a share ``tail`` of the counts is cut at each end; works on the bins, not the rows."""
    up = Window.orderBy("bin")
    total = F.sum("n").over(Window.partitionBy())
    cum = hist.select("bin", F.sum("n").over(up).alias("c"), "n", total.alias("t"))
    inside = cum.where((F.col("c") > tail * F.col("t")) & (F.col("t") - F.col("c") + F.col("n") > tail * F.col("t")))
    return inside.agg(F.min("bin").alias("low_bin"), F.max("bin").alias("high_bin"))


def ring_histogram(points: DataFrame, ring: str = "ring", time: str = "t", index: str = "pt_idx") -> DataFrame:
    """``(ring, time, idx, n)``: of each ring and time the last point's index and the number of points; points without a ring are left out."""
    return points.where(F.col(ring).isNotNull()).groupBy(ring, time).agg(F.max(index).alias("idx"), F.count("*").alias("n"))


def visit_points(points: DataFrame, *measures: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """A fold over all points of a map, or of each group, by aggregates."""
    return points.groupBy(*by).agg(*measures)


def visit_voxels(points: DataFrame, fn, schema: str, size: float, mode: str = "trunc", hard_cap: int = HASHED_CAP) -> DataFrame:
    """``fn(cell, points as a pandas frame)`` for each voxel's stored points, which are bounded by the cap; it gives a frame of the schema."""
    kept = downsample(points, size, 0, mode, hard_cap=hard_cap)
    return kept.groupBy(*CELL).applyInPandas(lambda cell, pdf: fn(tuple(int(c) for c in cell), pdf), schema)


def occupancy(hits: DataFrame, size: float, hit: float = 0.847, miss: float = -0.405, low: float = -4.6, high: float = 4.6) -> DataFrame:
    """Occupancy grid ``(ix, iy, log_odds)``: summed log-odds of hits and misses of each cell, clamped.

    ``hits(x, y, occupied boolean)``; the default weights are the log-odds of 0.7 and 0.4.
    """
    cells = hits.select(cell_index(F.col("x"), size, "floor").alias("ix"), cell_index(F.col("y"), size, "floor").alias("iy"), F.when(F.col("occupied"), hit).otherwise(miss).alias("l"))
    return cells.groupBy("ix", "iy").agg(F.greatest(F.lit(low), F.least(F.lit(high), F.sum("l"))).alias("log_odds"))


def chebyshev(at: tuple[int, int, int]) -> Column:
    return cell_distance(F.col("cx"), F.col("cy"), F.col("cz"), at)
