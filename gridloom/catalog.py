"""Registry of the library's own queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuse weighted observations into grid cells; drop weakly observed cells."""
    li = table(spark, sf_dir, "lineitem")
    cell = lambda c, s: F.floor(F.col(c) / F.lit(float(s))).cast("long")
    return (
        li.groupBy(cell("l_quantity", 10).alias("cx"), cell("l_extendedprice", 20000).alias("cy"))
        .agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("fused"), F.sum("l_quantity").alias("weight"))
        .where(F.col("weight") > 0.5)
    )


FLAGSHIP_SQL = """
SELECT floor(l_quantity / 10)::BIGINT AS cx, floor(l_extendedprice / 20000)::BIGINT AS cy, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS fused, sum(l_quantity) AS weight
FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0.5
"""


def _modules() -> list:
    from gridloom.plans import mapping, matching, rooms, scalars, sequences, streams, voxels

    return [scalars, voxels, sequences, matching, rooms, streams, mapping]


def queries() -> dict:
    out = {"flagship_voxel_grid": flagship}
    for m in _modules():
        out |= m.R.queries
    return out


def oracles() -> dict:
    out = {"flagship_voxel_grid": FLAGSHIP_SQL}
    for m in _modules():
        out |= m.R.oracles
    return out
