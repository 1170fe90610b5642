import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import sharding as S


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def draw(key, name, weight):
    seed = xxhash.xxh64_intdigest(name.encode(), 42)
    h = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed) if key is not None else seed
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def plain(key, tree):
    """Descent from the root: at each node the child with the least draw by its subtree's weight."""
    left, path = [x for x in tree if x.weight > 0], ""
    for level in (lambda x: x.region, lambda x: x.rack, lambda x: str(x.shard)):
        weights = Counter()
        for x in left:
            weights[level(x)] += x.weight
        best = min(weights, key=lambda n: draw(key, f"{path}/{n}", weights[n]))
        left, path = [x for x in left if level(x) == best], f"{path}/{best}"
    return left[0].shard


def placed(spark, keys, tree):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    return {r.k: r.shard for r in S.place(df, F.col("k"), tree).collect()}


def test_descent(spark):
    tree = [S.Leaf(i, f"r{i % 3}", f"k{i % 6}", w) for i, w in enumerate([1, 2, 0.5, 3, 1, 1, 0, 2])]
    keys = [None, 0, -5, *range(1, 400)]
    assert placed(spark, keys, tree) == {k: plain(k, tree) for k in keys}


def test_weights_and_confined_movement(spark):
    tree = [S.Leaf(i, f"r{i // 4}", f"k{i // 2}", 1 + i % 2) for i in range(8)]
    before = placed(spark, range(12000), tree)
    share = Counter(before.values())
    for x in tree:
        assert abs(share[x.shard] / 12000 - x.weight / 12) < 0.02
    # Shards 0-3 are region r0, 2 and 3 its rack k1.
    heavier = placed(spark, range(12000), [S.Leaf(x.shard, x.region, x.rack, 4.0) if x.shard == 3 else x for x in tree])
    moves = {(before[k], heavier[k]) for k in before if before[k] != heavier[k]}
    assert any(a == 2 and b == 3 for a, b in moves) and any(a < 2 and b in (2, 3) for a, b in moves) and any(a > 3 and b < 2 for a, b in moves)
    assert not any(a < 4 <= b or (a in (2, 3) and b < 2) or (a == 3 and b == 2) or {a, b} == {0, 1} or (a > 3 and b > 3) for a, b in moves)
    # A shard as a region of its own takes keys only into itself.
    grown = placed(spark, range(12000), S.grown_tree(tree))
    assert {grown[k] for k in before if before[k] != grown[k]} == {8}
    # Racks matter: the same leaves in other racks place other keys.
    other = placed(spark, range(12000), [S.Leaf(x.shard, x.region, f"k{x.shard % 2}", x.weight) for x in tree])
    assert any(before[k] != other[k] for k in before) and all(before[k] // 4 == other[k] // 4 for k in before)
    with pytest.raises(ValueError):
        S.place(spark.range(1), F.col("id"), [S.Leaf(0, "a", "b", 0.0)])


def test_only_the_entered_branch_is_read(spark):
    plan = S.place(spark.range(1), F.col("id"), S.default_tree(8))._jdf.queryExecution().optimizedPlan().toString()
    # Three projects: region, then rack by region, then shard by rack.
    assert plan.count("CASE WHEN") == 2 and plan.count("Project") == 3


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = S.op9_sharding(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    old = S.default_tree(8)
    new = S.grown_tree(old)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (plain(r.doc_id, old), plain(r.doc_id, new))
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_edge_rows(spark):
    rows = [(1, None, 0)] * 3 + [(1, "a", 0), (None, "", 0), (None, "b", 0)] + [(7, "same", 0)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = S.assign(docs, S.default_tree(8)).collect()
    assert len(got) == len(rows) and all(r.grown_shard is None for r in got)
    assert Counter((r.doc_id, r.size) for r in got) == Counter({(1, 1): 3, (1, 2): 1, (None, 1): 1, (None, 2): 1, (7, 5): 50})
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert S.assign(docs.limit(0), S.default_tree(8)).count() == 0
