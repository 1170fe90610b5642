"""Column functions of voxel grids: chunk keys, voxel numbers, packed labels and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Voxels along a chunk's edge, and instances that a packed label has room for.
EDGE, INSTANCES = 8, 10_000
NO_INSTANCE = 9_999


def chunk_key(x: Column | str, size: float) -> Column:
    """Number of the cell of a given size that holds x."""
    return F.floor(F.col(x) / F.lit(float(size)) if isinstance(x, str) else x / F.lit(float(size))).cast("long")


def voxel_in_chunk(x: Column, size: float, edge: int = EDGE) -> Column:
    """Number of x's voxel, of size by edge, within its chunk of the given size."""
    return F.pmod(F.floor(x / F.lit(float(size) / edge)), F.lit(edge)).cast("long")


def voxel_id(vx: Column, vy: Column, vz: Column, edge: int = EDGE) -> Column:
    return vx + vy * edge + vz * (edge * edge)


def voxel_coords(vid: Column) -> tuple[Column, Column, Column]:
    """The three octal digits of a voxel number, for an edge of 8."""
    part = lambda n: F.shiftright(vid, 3 * n).bitwiseAND(F.lit(7)).cast("long")
    return part(0), part(1), part(2)


def voxel_centre(chunk: Column, vox: Column, size: float, edge: int = EDGE) -> Column:
    step = float(size) / edge
    return chunk * F.lit(float(size)) + (vox + F.lit(0.5)) * F.lit(step)


def pack_label(semantic: Column, instance: Column) -> Column:
    """semantic * 10000 + instance; a null instance is the sentinel."""
    return (semantic * INSTANCES + F.coalesce(instance, F.lit(NO_INSTANCE))).cast("long")


def unpack_label(label: Column) -> tuple[Column, Column]:
    instance = F.pmod(label, F.lit(INSTANCES)).cast("long")
    return F.floor(label / INSTANCES).cast("long"), F.when(instance != NO_INSTANCE, instance)


def is_border(semantic: Column) -> Column:
    """Wall, window or door (fixed class numbers 0, 8, 7)."""
    return semantic.isin(0, 8, 7)


def is_floor(semantic: Column) -> Column:
    return semantic == 1


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return (F.shiftleft(r, 16) + F.shiftleft(g, 8) + b).cast("long")


def unpack_rgb(rgb: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(rgb, n).bitwiseAND(F.lit(255)).cast("long") for n in (16, 8, 0))


def corner_code(values: list[Column]) -> Column:
    """Sum of 2^i over the values below zero."""
    out = F.lit(0)
    for i, v in enumerate(values):
        out = out + F.when(v < 0, F.lit(1 << i)).otherwise(F.lit(0))
    return out
