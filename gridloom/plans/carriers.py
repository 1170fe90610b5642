"""Tables that carry the operators, derived from the supplied ones, as DataFrames and as SQL with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import retrieval
from gridloom.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: Points: position, unit normal, weight, class, instance, agent and frame.
POINTS_SQL = """p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_extendedprice / 2000.0 AS y, l_discount * 100.0 AS z,
  (l_tax * 10 + 0.1) / sqrt((l_tax * 10 + 0.1) * (l_tax * 10 + 0.1) + l_discount * l_discount * 100 + 0.25) AS nx,
  l_discount * 10 / sqrt((l_tax * 10 + 0.1) * (l_tax * 10 + 0.1) + l_discount * l_discount * 100 + 0.25) AS ny,
  0.5 / sqrt((l_tax * 10 + 0.1) * (l_tax * 10 + 0.1) + l_discount * l_discount * 100 + 0.25) AS nz,
  l_tax + 0.01 AS w, l_suppkey % 13 AS semantic, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 50 END AS instance,
  l_suppkey % 5 AS camera, l_linenumber::BIGINT AS frame, l_orderkey % 40 AS submap FROM lineitem)"""

FEATURES_SQL = """f AS (SELECT vec_id, label, """ + ", ".join(
    f"list_sum(list_transform(range(0, 16), lambda i: CASE WHEN embedding[{16 * b} + i + 1] > 0 THEN 1 << i ELSE 0 END))::BIGINT AS b{b}" for b in range(4)
) + " FROM embeddings)"

FRAMES_SQL = "e AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    tax, disc = F.col("l_tax") * 10 + 0.1, F.col("l_discount")
    length = F.sqrt(tax * tax + disc * disc * 100 + 0.25)
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000.0).alias("y"), (disc * 100.0).alias("z"),
        (tax / length).alias("nx"), (disc * 10 / length).alias("ny"), (0.5 / length).alias("nz"), (F.col("l_tax") + 0.01).alias("w"), (F.col("l_suppkey") % 13).alias("semantic"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") % 50).alias("instance"), (F.col("l_suppkey") % 5).alias("camera"), F.col("l_linenumber").cast("long").alias("frame"), (F.col("l_orderkey") % 40).alias("submap"),
    )


BANDS = ["b0", "b1", "b2", "b3"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = [c.alias(b) for c, b in zip(retrieval.sign_bands("embedding", 4, 16), BANDS, strict=True)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label"), *bands)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", F.row_number().over(order).cast("long").alias("seq"))


class Registry:
    """Queries by name, with their SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return put


def r6(c, name: str):
    """A measure, rounded for comparison."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)
