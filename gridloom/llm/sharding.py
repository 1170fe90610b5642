"""Hierarchical weighted hash tree: regions, racks and shards.

At each node the key draws ``-ln(u) / w`` for every child, u being uniform from a hash of
the child's name and the key, and w the weight of the child's subtree; the smallest draw
is entered, first among the regions, then among the chosen region's racks, then among
the chosen rack's shards.  A child gets keys in proportion to its weight.  A changed
weight changes one draw a level, on the way from that leaf to the root, so keys move only
into or out of subtrees whose weight changed.  A shard that is added as a region of its
own takes keys only into itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import table

SHARDS = 8
#: Children of a region and of a rack, in the trees that default_tree() makes.
RACKS, SHARDS_A_RACK = 2, 2
#: Rows that one window task numbers, about; the buckets of a shard are at least MIN_BUCKETS.
ROWS_A_BUCKET, MIN_BUCKETS = 100_000, 256


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def default_tree(shards: int) -> list[Leaf]:
    """Shards 0, 1, ... in racks of two, racks in regions of two; a leaf's place never depends on the count."""
    return [Leaf(i, f"region{i // (RACKS * SHARDS_A_RACK)}", f"rack{i // SHARDS_A_RACK}") for i in range(shards)]


def grown_tree(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """tree with one shard more, the next number, in a rack and region of its own: no other subtree's weight changes, so keys move only into it."""
    shard = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Leaf(shard, f"region of {shard}", f"rack of {shard}", weight)]


def _entered(key: Column, path: str, children: dict[str, tuple[float, int]]) -> Column:
    """The number of the child with the smallest draw; children: name -> (weight, number)."""
    draws = []
    for name, (weight, number) in children.items():
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{path}/{name}"), key), 11)
        draw = -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(float(weight))
        draws.append(F.struct(draw.alias("draw"), F.lit(number).alias("child")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def place(rows: DataFrame, key: Column, tree: Sequence[Leaf], name: str = "shard") -> DataFrame:
    """rows with a column name: the shard of the key. Each level is drawn within the branch that the level above entered, and in no other. Leaves of weight 0 get nothing."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not regions:
        raise ValueError("a tree needs a leaf of positive weight")
    weight = lambda leaves: sum(x.weight for x in leaves)
    racks = [(r, k, leaves) for r, of in regions.items() for k, leaves in of.items()]
    number = {(r, k): i for i, (r, k, _) in enumerate(racks)}
    region = _entered(key, "", {r: (sum(map(weight, of.values())), i) for i, (r, of) in enumerate(regions.items())})

    def chosen(column: str, branches: list[Column]) -> Column:
        """The branch of the number in column; a CASE reads no other branch."""
        out = F.when(F.col(column) == 0, branches[0])
        for i, b in enumerate(branches[1:], 1):
            out = out.when(F.col(column) == i, b)
        return out

    rack = chosen("__region", [_entered(key, f"/{r}", {k: (weight(leaves), number[r, k]) for k, leaves in of.items()}) for r, of in regions.items()])
    shard = chosen("__rack", [_entered(key, f"/{r}/{k}", {str(x.shard): (x.weight, x.shard) for x in leaves}) for r, k, leaves in racks])
    return rows.withColumn("__region", region).withColumn("__rack", rack).withColumn(name, shard).drop("__region", "__rack")


def assign(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard) for all rows of docs.

    Law ``key``: the key and the tree alone decide.  size is the text's UTF-8 bytes plus 1.
    A null text counts as empty; null keys are one key and share a shard; equal rows get
    slots of their own; an empty table gives no rows.  Other columns are ignored.
    Slots number a shard's rows without gaps: rows are counted in hash buckets, the small
    table of bucket counts is summed up, and each bucket is numbered from its offset.
    Equal rows are counted before the shuffle, so no key gathers in one task.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(text_) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text_, "UTF-8")).alias("crc"))
    rows = rows.groupBy("key", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    buckets = max(MIN_BUCKETS, math.ceil(docs.count() / len(tree) / ROWS_A_BUCKET))
    rows = place(rows, F.col("key"), tree).select("*", F.pmod(F.xxhash64(F.lit("slot"), "key", "size", "crc"), F.lit(buckets)).alias("bucket"))
    # One row for each shard and bucket: len(tree) * buckets rows at most.
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("in_bucket"))
    totals = counts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "in_bucket"))).alias("all"))
    starts = totals.select("shard", F.inline(F.expr("transform(all, (x, i) -> struct(x.bucket AS bucket, aggregate(slice(all, 1, i), 0L, (s, y) -> s + y.in_bucket) AS start))"))) if buckets <= 4096 else None
    if starts is None:  # more buckets than a quadratic sum within a row should take
        starts = counts.select("shard", "bucket", F.expr("coalesce(sum(in_bucket) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("start"))
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY shard, bucket ORDER BY key, size, crc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
    numbered = rows.withColumn("before", before).join(F.broadcast(starts), ["shard", "bucket"])
    numbered = place(numbered, F.col("key"), grown, "moved") if grown else numbered.withColumn("moved", F.lit(None).cast("int"))
    return numbered.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        F.col("moved").alias("grown_shard"), F.explode(F.sequence(F.col("start") + F.col("before"), F.col("start") + F.col("before") + F.col("n") - 1)).alias("slot"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 by law ``key``; grown_shard with one shard more."""
    tree = default_tree(SHARDS)
    out = assign(table(spark, sf_dir, "documents"), tree, grown_tree(tree))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
