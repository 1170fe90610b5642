import math
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import toxicity as T


def all_segments(scores):
    """Maximal segments by their definition: recursively, the best segment and those left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if best is None or s > best[2] + 1e-9 or abs(s - best[2]) <= 1e-9 and j - i < best[1] - best[0]:
                best = (i, j, s)
    if best is None or best[2] <= 1e-9:
        return []
    i, j, s = best
    return [*all_segments(scores[:i]), (i, j - 1, s), *((i2 + j, j2 + j, s2) for i2, j2, s2 in all_segments(scores[j:]))]


def test_segments_against_the_definition():
    rng = random.Random(3)
    for _ in range(150):
        scores = [rng.choice([-1, -1, -1, rng.randint(1, 7) + rng.random()]) for _ in range(rng.randint(0, 22))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        got = [(a, b, round(s, 6)) for a, b, s in T.segments(hits, cost=1.0)]
        assert got == [(a, b, round(s, 6)) for a, b, s in all_segments(scores)]


def test_segments_are_linear_in_scattered_hits():
    began = time.perf_counter()
    assert len(T.segments([(i * 400, 2.0) for i in range(100_000)], cost=0.02)) == 100_000
    assert len(T.segments([(i, 2.0) for i in range(100_000)], cost=0.02)) == 1
    assert time.perf_counter() - began < 1


def test_segments_together_weigh_more_than_the_best():
    m = T.Model({}, rate=0.8, scale=0.01)
    assert m.together([], 10) == m.together([0.0], 10) == 0
    assert m.together([9.0], 100) == m.evidence(9.0, 100)
    assert m.together([9.0, 9.0], 100) > m.together([9.0], 100)
    # Segments that any text of this length has add nothing.
    assert m.together([9.0] + [1.0] * 50, 10_000) == m.evidence(9.0, 10_000)
    x = 2 * (0.8 * 9 - math.log(0.01 * 100))
    assert abs(m.together([9.0, 9.0], 100) + math.log10(math.exp(-x) * x / 2 * 2)) < 1e-9


def test_evidence_grows_with_the_segment_and_falls_with_length():
    m = T.Model({}, rate=0.8, scale=0.01)
    assert m.evidence(0, 100) == 0 and m.evidence(5, 0) == 0
    assert m.evidence(9, 100) > m.evidence(5, 100) > m.evidence(5, 10000) >= 0
    assert 0 <= m.score(-1e9) <= m.score(0) <= m.score(1e9) <= 1


@pytest.mark.parametrize("size", ["sf0.1"])
def test_held_out_accuracy(spark, size):
    at = f"/root/testdata/{size}"
    got = T.op5_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    toxic = [r.score for r in got if r.toxic]
    clean = [r.score for r in got if not r.toxic]
    area = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean)
    print("accuracy", right, "area", area, "recall", sum(s >= 0.5 for s in toxic) / len(toxic), "false", sum(s >= 0.5 for s in clean) / len(clean))
    assert right > 0.95 and area > 0.95


def test_edge_rows(spark):
    model = T.Model({"bad": 4.0, "nast*": 3.0}, rate=1.0, scale=0.05, slope=2.0, shift=-3.0)
    rows = [(1, None, "x"), (2, "", "x"), (3, "a BAD nasty thing", "x"), (3, "a BAD nasty thing", "x"), (None, "fine " * 60000, None), (4, "bad " + "ok " * 500 + "nastier", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = sorted(T.score(docs, model, ["doc_id"]).collect(), key=lambda r: (str(r.doc_id), r.score))
    assert [r.n_passages for r in out] == [0, 0, 1, 1, 0, 0]
    assert (out[2].passages[0].start, out[2].passages[0].end) == (2, 11) and out[2].score == out[3].score > 0.5
    assert out[0].score == out[1].score < 0.1
    assert T.score(docs.limit(0), model, ["doc_id"]).count() == 0
    clean = T.kept(docs, model)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["1", "2", "4", "None"]
    odd = docs.selectExpr("doc_id", "text", "score", *[f"1 AS {c}" for c in ("k", "y", "key", "weight", "sig", "tune", "entry", "toxic", "best", "n_passages", "passages")])
    assert T.kept(odd, model).columns == odd.columns
    assert T.score(odd, model, odd.columns).columns == [*odd.columns, "score_", "best_", "n_passages_", "passages_"]
    many = spark.createDataFrame([(i, f"bad nasty words {i}" if i % 2 else f"good kind words {i}", i) for i in range(200)], "doc_id long, text string, k long").withColumn("y", F.lit(0))
    learnt = T.train(many, spark.createDataFrame([(i, i % 2, 1) for i in range(200)], "doc_id long, toxic int, k int"))
    assert learnt.scores and T.kept(many, learnt).where("doc_id % 2 = 1").count() == 0 and T.kept(many, learnt).count() == 100
    none = T.train(docs, spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int"))
    assert none.scores == {}
    held = docs.select("doc_id", (T.fold("doc_id") == 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id or "").encode()) % 5 == 0) for r in held)
