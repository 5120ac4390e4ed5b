"""Cell indices of points, in the three rules of the maps and with floor, and what follows from them.

``trunc`` truncates toward zero, so that the cell 0 is twice as wide; ``round`` rounds half to even; ``half_shift``
shifts by half a cell and truncates; ``floor`` is the plain grid.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("trunc", "round", "half_shift", "floor")
INNER_BITS = 5
#: Factors of the spatial hash (fixed values, Teschner et al. 2003).
HASH_FACTORS = (73856093, 19349663, 83492791)


def cell_index(x: Column, size: float, mode: str = "trunc") -> Column:
    inv = F.lit(1.0 / size)
    if mode == "trunc":
        return (x * inv).cast("int")
    if mode == "round":
        return F.rint(x * inv).cast("int")
    if mode == "half_shift":
        return ((x + F.lit(size / 2)) * inv).cast("int")
    if mode == "floor":
        return F.floor(x * inv).cast("int")
    raise ValueError(f"no such mode: {mode}")


def cell_origin(i: Column, size: float, mode: str = "trunc") -> Column:
    """Coordinate that stands for a cell: its corner, its centre (round), or shifted by half a cell (half_shift)."""
    return (i - 0.5) * size if mode == "half_shift" else i * F.lit(float(size))


def with_cells(df, size: float, mode: str = "trunc", names: tuple[str, str, str] = ("cx", "cy", "cz"), of: tuple[str, str, str] = ("x", "y", "z")):
    return df.withColumns({n: cell_index(F.col(c), size, mode) for n, c in zip(names, of, strict=True)})


def block_of(i: Column, bits: int = INNER_BITS) -> Column:
    """Outer index: the low bits cleared (two's complement, so -3 lies in block -32)."""
    return i.bitwiseAND(F.lit(~((1 << bits) - 1)))


def inner_of(i: Column, bits: int = INNER_BITS) -> Column:
    return i.bitwiseAND(F.lit((1 << bits) - 1))


def plain_of(ix: Column, iy: Column, iz: Column, bits: int = INNER_BITS) -> Column:
    """Inner 3-D index as one number."""
    return ix + F.shiftleft(iy, bits) + F.shiftleft(iz, 2 * bits)


def plain_to_inner(p: Column, bits: int = INNER_BITS) -> Column:
    mask = F.lit((1 << bits) - 1)
    return F.struct(p.bitwiseAND(mask).alias("ix"), F.shiftright(p, bits).bitwiseAND(mask).alias("iy"), F.shiftright(p, 2 * bits).bitwiseAND(mask).alias("iz"))


def pack_point_id(sub: Column, cx: Column, cy: Column, cz: Column, sub_bits: int, cell_bits: int) -> Column:
    """sub + cells in one long: the sub index in the low bits, then x, y, z; null for negative cells, which don't fit.

    Layouts: 5 + 3x20 (hashed; one bit too long, so z keeps 18 bits of sign-free range), 4 + 3x20, 20 + 3x14.
    """
    top = min(cell_bits, 63 - sub_bits - 2 * cell_bits)
    ok = (cx >= 0) & (cy >= 0) & (cz >= 0) & (cx < (1 << cell_bits)) & (cy < (1 << cell_bits)) & (cz < (1 << top)) & (sub >= 0) & (sub < (1 << sub_bits))
    cells = [F.shiftleft(c.cast("long"), sub_bits + k * cell_bits) for k, c in enumerate((cx, cy, cz))]
    return F.when(ok, sub.cast("long").bitwiseOR(cells[0]).bitwiseOR(cells[1]).bitwiseOR(cells[2]))


def spatial_hash(cx: Column, cy: Column, cz: Column, bits: int = 20) -> Column:
    wrapped = [((c.cast("long") * f).bitwiseAND(F.lit(0xFFFFFFFF))) for c, f in zip((cx, cy, cz), HASH_FACTORS, strict=True)]
    return wrapped[0].bitwiseXOR(wrapped[1]).bitwiseXOR(wrapped[2]).bitwiseAND(F.lit((1 << bits) - 1))


def neighbour_offsets(reach: int = 1) -> list[tuple[int, int, int]]:
    span = range(-reach, reach + 1)
    return list(product(span, span, span))


def index_order(df, size: float, mode: str = "trunc", tie: str = "id", name: str = "place"):
    """Rows numbered in the lexicographic order of their cells (x, then y, then z)."""
    from waymark.operators.temporal import range_numbered

    return range_numbered(with_cells(df, size, mode), ["cx", "cy", "cz", tie], name)


def cell_distance(cx: Column, cy: Column, cz: Column, at: tuple[int, int, int]) -> Column:
    """Chebyshev distance in cells."""
    return F.greatest(F.abs(cx - at[0]), F.abs(cy - at[1]), F.abs(cz - at[2]))
