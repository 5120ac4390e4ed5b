"""Operator 10: exact cosine near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of one label are one *class* with a multiplicity, so a vector that a third of all rows share
costs one row. The classes of a label are dealt into blocks; each pair of blocks is one tile, a task's work of
bounded size. In a tile, unit vectors u = s q + e are held as int8 vectors q with a scale s per vector; the
products of the int8 tiles are exact (they run as float32 matrix products, whose integer sums stay below 2**24
up to 1,040 components, in float64 beyond). With |e| computed per vector,

    |u.v - s_u s_v q_u.q_v| <= |e_u| |s_v q_v| + |u| |e_v|

so a product beyond the threshold by more than the bound (and the rounding allowed for) is a link for sure, one
that falls short by more is none, and only those between are recomputed in double precision from the vectors.
A tile gives each class the number of rows that it is linked to there, and the smallest class of its part of the
tile's link graph, so that a group of near copies yields a row a class and not its pairs.

Components are scaled by powers of two first, so that no square under- or overflows. Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label, link with
nothing. Vectors of different lengths don't link. Repeated rows count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import saved, ship_package, starts, table, whole_groups
from waymark.llm.components import connected_components

THRESHOLD = 0.93
BLOCK = 4096  # classes in a block, on average: each vector is copied once for every block of its label
ROWS = 512  # rows of a tile that are compared at once
SLACK = 1e-9  # above any rounding of the bounds themselves


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, scales, and rigorous |e| and |s q| of unit vectors."""
    s = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / s[:, None])
    back = q * s[:, None]
    return q.astype(np.int8), s, np.linalg.norm(unit - back, axis=1) * (1 + 1e-12) + 1e-15, np.linalg.norm(back, axis=1) * (1 + 1e-12)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The boolean matrix of cosine(a_i, b_j) >= threshold in double precision."""
    # by powers of two, which change no digit: squares of very large or small components stay in range
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / na[:, None], b / nb[:, None]
    qa, sa, ea, la = quantise(ua)
    qb, sb, eb, lb = quantise(ub)
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    links, right = np.zeros((len(a), len(b)), bool), np.ascontiguousarray(qb.astype(kind).T)
    for lo in range(0, len(a), ROWS):
        r = slice(lo, lo + ROWS)
        about = (qa[r].astype(kind) @ right).astype(np.float64) * sa[r, None] * sb[None, :]
        bound = ea[r, None] * lb[None, :] + (1 + SLACK) * eb[None, :] + SLACK
        links[r] = about - bound >= threshold
        i, j = np.nonzero((about + bound >= threshold) & ~links[r])
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)]
            exact = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            hit = exact >= threshold
            links[x[hit], y[hit]] = True
    return links


def tile_roots(links: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node of each row's and column's part of the bipartite link graph."""
    big = np.iinfo(np.int64).max
    rows, cols = own.copy(), other.copy()
    while True:
        new_rows, new_cols = rows.copy(), cols.copy()
        for lo in range(0, len(rows), ROWS):
            r = slice(lo, lo + ROWS)
            new_rows[r] = np.minimum(rows[r], np.where(links[r], new_cols[None, :], big).min(axis=1))
            new_cols = np.minimum(new_cols, np.where(links[r], new_rows[r, None], big).min(axis=0))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def tiler(threshold: float):
    keys = ["grp", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, keys):
            at = starts(group, keys)
            for lo, hi in zip(at, np.append(at[1:], group.num_rows), strict=True):
                part = group.slice(lo, hi - lo)
                node, times, side = (part.column(c).to_numpy() for c in ("node", "times", "side"))
                vec = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.float64).reshape(len(node), -1)
                one = part.column("i")[0].as_py() == part.column("j")[0].as_py()
                x = np.flatnonzero(side == 0)
                y = x if one else np.flatnonzero(side == 1)
                if not len(x) or not len(y):
                    continue
                links = tile_links(vec[x], vec[y], threshold)
                if one:
                    np.fill_diagonal(links, False)
                rx, ry = links.any(axis=1), links.any(axis=0)
                if not rx.any():
                    continue
                roots_x, roots_y = tile_roots(links[np.ix_(rx, ry)], node[x][rx], node[y][ry])
                out = [(node[x][rx], links[rx] @ times[y], roots_x)]
                if not one:
                    out.append((node[y][ry], times[x] @ links[:, ry], roots_y))
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "links", "root"])

    return run


def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the vector as float64 bytes; null where it can link with nothing."""
    for batch in batches:
        n, column, label = batch.num_rows, batch.column(2), batch.column(1)
        flat = column.flatten()  # of the rows that are not null
        size = np.zeros(n, np.int64)
        there = column.is_valid().to_numpy(zero_copy_only=False)
        size[there] = np.asarray(column.drop_null().value_lengths(), np.int64) if there.any() else 0
        ends = np.cumsum(size)
        x = np.ascontiguousarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
        row = np.repeat(np.arange(n), size)
        good = there & label.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(x)], minlength=n) == 0) & (np.bincount(row[x != 0], minlength=n) > 0)
        x = np.where(x == 0, 0.0, x)  # one zero
        out = [x[e - k : e].tobytes() if g else None for g, e, k in zip(good.tolist(), ends.tolist(), size.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), label, pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, label, embedding)``."""
    ship_package(vectors.sparkSession)
    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = saved(rows.mapInArrow(usable, f"vec_id long, label {label}, vec binary"), "op10-rows")
    good = rows.where("vec is not null")
    # a class is named by a hash of its label and vector, and grouped by these; its smallest vec_id names it in the result
    for seed in range(8):
        name = F.xxhash64(F.lit(seed), "label", "vec")
        classes = good.groupBy(name.alias("node"), "label", "vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"))
        classes = saved(classes.withColumn("grp", F.xxhash64("label", F.length("vec"))), "op10-classes")
        if classes.groupBy("node").count().where("count > 1").isEmpty():  # else two unlike vectors have one hash
            break
    sizes = classes.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    work = classes.join(sizes, "grp").withColumn("own", F.pmod(F.hash("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    work = work.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "times", (F.col("own") > F.col("other")).cast("int").alias("side"), "vec")
    tiles = saved(work.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(tiler(threshold), "node long, links long, root long"), "op10-tiles")
    found = connected_components(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")), "op10-cc")
    counts = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    roots = classes.select("node", "vec_id", "times").join(found, "node", "left").join(counts, "node", "left").select("node", "vec_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    roots = saved(roots, "op10-roots")
    least = roots.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    by_class = saved(roots.join(least, "root").select("node", "n_links", "component_id"), "op10-by-class")
    out = rows.withColumn("node", F.when(F.col("vec").isNotNull(), name)).join(by_class, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
