"""Operators on voxel tables: fusion, retraction, merging, neighbourhoods, simplification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to the sum of weights, and the weight up to which a voxel is unknown (fixed values of the fusion rule).
EPSILON, LEAST_WEIGHT = 1e-4, 0.5


def fuse(observed: DataFrame, keys: Sequence[str], value: str, weight: str, least: float = LEAST_WEIGHT, epsilon: float = EPSILON) -> DataFrame:
    """Signed-weight mean by key, with the voxels of too little weight left out.

    Contributions are associative: negative weights take observations back, and the
    rule's epsilon and threshold are applied once, after the sum.
    """
    sums = observed.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias("sum_dw"), F.sum(weight).alias("sum_w"))
    return finish(sums, least, epsilon)


def finish(sums: DataFrame, least: float = LEAST_WEIGHT, epsilon: float = EPSILON) -> DataFrame:
    return sums.where(F.col("sum_w") > least).withColumn("value", F.col("sum_dw") / (F.col("sum_w") + epsilon)).drop("sum_dw").withColumnRenamed("sum_w", "weight")


def merge(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sums (sum_dw, sum_w) of several submaps added up by key: a full outer merge without a join."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys).agg(F.sum("sum_dw").alias("sum_dw"), F.sum("sum_w").alias("sum_w"))


def retracted(old: DataFrame, new: DataFrame, weight: str) -> DataFrame:
    """Old contributions with negative weight, followed by the new ones."""
    return old.withColumn(weight, -F.col(weight)).unionByName(new)


def shifted(df: DataFrame, keys: Sequence[str], offsets: Sequence[Sequence[int]], name: str = "offset") -> DataFrame:
    """Each row at each offset of its integer key; the offset's number in a column."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), *[F.lit(o).cast("long").alias(k) for k, o in zip(keys, off, strict=True)]) for i, off in enumerate(offsets)]))
    rest = [c for c in df.columns if c not in keys]
    return df.select("*", steps.alias("__step")).select(*[(F.col(k) + F.col(f"__step.{k}")).alias(k) for k in keys], *rest, F.col("__step.n").alias(name))


def faces(dims: int) -> list[tuple[int, ...]]:
    """The cell itself and its face neighbours."""
    zero = (0,) * dims
    return [zero, *(tuple(s if i == d else 0 for i in range(dims)) for d in range(dims) for s in (-1, 1))]


def corners(dims: int) -> list[tuple[int, ...]]:
    """The 2^dims cells from the cell itself upwards, first axis fastest."""
    return [tuple(n >> d & 1 for d in range(dims)) for n in range(1 << dims)]


def dirty(updated: DataFrame, keys: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """Updated cells and their face neighbours, of known cells only if those are given."""
    out = shifted(updated.select(*keys).distinct(), keys, faces(len(keys))).drop("offset").distinct()
    return out.join(known.select(*keys).distinct(), list(keys), "left_semi") if known is not None else out


def full_cells(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For each cell whose upper neighbours are all there: their values by corner (array)."""
    dims = len(keys)
    # A cell is corner n of the cell that lies n's offset below it.
    moved = shifted(cells.select(*keys, value), keys, [tuple(-x for x in c) for c in corners(dims)], "corner")
    found = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("corner", F.col(value).alias("v")))).alias("vs"))
    return found.where(F.col("n") == 1 << dims).select(*keys, F.col("vs.v").alias("values"))


def lookup(points: DataFrame, cells: DataFrame, keys: Sequence[str], value: str, default: float) -> DataFrame:
    """Points with the value of their cell, or a default."""
    return points.join(cells.select(*keys, F.col(value).alias("__v")), list(keys), "left").withColumn(value, F.coalesce("__v", F.lit(default))).drop("__v")


def allocate(observed: DataFrame, current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed cells that neither of two submaps has."""
    return observed.select(*keys).distinct().join(current, list(keys), "left_anti").join(previous, list(keys), "left_anti")


def garbage(created: DataFrame, updated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Created cells without those never updated."""
    return created.join(updated.select(*keys).distinct(), list(keys), "left_semi")


def group_means(points: DataFrame, keys: Sequence[str], means: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Means by cell, and the mean distance of the spread columns from theirs (two passes)."""
    avg = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in means])
    both = points.join(avg.select(*keys, *[f"mean_{c}" for c in spread]), list(keys))
    gap = None
    for c in spread:
        d = (F.col(c) - F.col(f"mean_{c}")) * (F.col(c) - F.col(f"mean_{c}"))
        gap = d if gap is None else gap + d
    return avg.join(both.groupBy(*keys).agg(F.avg(F.sqrt(gap)).alias("residual")), list(keys))


def majority(points: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The most frequent label by key; of equally frequent ones the greatest."""
    counts = points.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("n", label)).alias(label), F.sum("n").alias("n"))


def representatives(vertices: DataFrame, cell: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """Each vertex with the first vertex (by order) of its cell: clustering simplification."""
    named = vertices.select("*", *[c.alias(f"__c{i}") for i, c in enumerate(cell)])
    keys = [f"__c{i}" for i in range(len(cell))]
    first = named.groupBy(*keys).agg(F.min(F.struct(*order)).alias("rep"))
    return named.join(first, keys).drop(*keys)


def solid(triangles: DataFrame, corner: Sequence[str]) -> DataFrame:
    """Triangles with three different corners."""
    a, b, c = (F.col(x) for x in corner)
    return triangles.where((a != b) & (b != c) & (a != c))
