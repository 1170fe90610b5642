import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import neardup


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """rows: (doc_id, fp) -> component id of each row, by a search over all pairs."""
    seen = [None] * len(rows)
    for i in range(len(rows)):
        if seen[i] is None:
            todo, group = [i], {i}
            while todo:
                x = todo.pop()
                for j in range(len(rows)):
                    if j not in group and (rows[x][1] ^ rows[j][1]).bit_count() <= 3:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                seen[j] = min(ids, default=None)
    return seen


def test_fingerprint_of_edge_cases_and_slices(monkeypatch):
    texts = [None, "", " \n\t", "one", "One  two", "a b c", "a b c d a b c d", "Ärger ÀB  x   y", "x " * 999]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    assert [neardup.fingerprint(t) for t in texts] == [plain(t) for t in texts]
    monkeypatch.setattr(neardup, "SLICE", 3)
    assert [neardup.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = {0, 2**64 - 1, 7, 15, 1 << 63}
    for s in map(int, seeds):
        for _ in range(12):
            x = s
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    frame = spark.createDataFrame(signed, "fp long")
    for radius in (0, 1, 2, 3, 5):
        got = {(r.u, r.v) for r in neardup.links(frame, radius).collect()}
        want = {(min(a, b), max(a, b)) for (a,) in signed for (b,) in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
        assert got == want
        assert neardup.links(frame, radius).count() == len(got)


def test_few_unrelated_fingerprints_meet(spark):
    rng = np.random.default_rng(8)
    fps = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63, 30_000)], "fp long").distinct()
    # About 5e-7 of all pairs.
    assert neardup.candidates(fps).count() < 1e-6 * 30_000**2 / 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(205, 203), (203, 201)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {i: 201 for i in (201, 203, 205)}
    assert neardup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_all_pairs(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in neardup.op2_simhash(spark, sf).collect()}
    rows = [(i, plain(t)) for i, t in sorted(docs.items())]
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in rows}
    assert {i: r.component_id for i, r in got.items()} == want


def test_nulls_ties_repeats_extra_columns(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "x"), (5, text, "x"), (3, text, "y"), (None, text, None), (9, None, "n"), (8, "", "n"), (7, "other words are here now", "n"), (7, "a third text of its own", "n"), (None, "nobody has this one", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("key", F.lit(1))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted([("5", "3"), ("5", "3"), ("3", "3"), ("None", "3"), ("9", "8"), ("8", "8"), ("7", "7"), ("7", "7"), ("None", "None")])
    kept = sorted((str(r.doc_id), str(r.text)) for r in neardup.keep_one(docs).collect())
    assert kept == sorted([("3", text), ("8", ""), ("7", "other words are here now"), ("7", "a third text of its own"), ("None", "nobody has this one")])
    assert neardup.keep_one(docs).columns == docs.columns
    again = spark.createDataFrame([(5, text, "x")] * 3, "doc_id long, text string, fp string")
    assert neardup.keep_one(again).count() == 1
    nulls = spark.createDataFrame([(1, text, None, "x"), (1, text, "x", None)], "doc_id long, text string, lang string, source string")
    assert neardup.keep_one(nulls).count() == neardup.keep_similar(nulls).count() == 1
    odd = docs.selectExpr("doc_id", "text", *[f"doc_id AS {c}" for c in ("gone_key", "gone_row", "known", "group", "key", "row", "fp", "sim", "n", "x", "given", "its_key", "best", "stays", "copies", "last", "`a.b`")])
    for keep in (neardup.keep_one, neardup.keep_similar):
        assert sorted((str(r.doc_id), str(r.text)) for r in keep(odd).collect()) == kept and keep(odd).columns == odd.columns
    assert neardup.near_duplicates(odd).count() == len(rows)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_similar_texts_are_those_of_all_pairs(spark, sf):
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    line = "this line stands in a great many of the texts that follow here"
    for i in range(30):
        words = [f"w{rng.randrange(9**6)}" for _ in range(200)]
        texts.append(" ".join([line, *words]))
        for edits in (1, 4, 6, 9):
            copy = list(words)
            for at in rng.sample(range(200), edits):
                copy[at] = f"e{i}"
            texts.append(" ".join([line, *copy]))
    base = [f"b{i}" for i in range(150)]
    texts += [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 150, 3)]
    rng.shuffle(texts)
    sets, group = [five_words(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in neardup.keep_similar(docs).collect()} == set(group)
    assert len(set(group)) < len({r.doc_id for r in neardup.keep_one(docs).collect()}) - 30


def test_a_group_of_half_similar_texts_lists_few_pairs(spark, monkeypatch):
    """Texts that share most shingles of their prefixes, and few of which are similar: the pairs that are verified."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(120), 5):
            words[at] = f"e{rng.randrange(9**6)}"
        texts.append(" ".join(words))
    sets, listed = [five_words(t) for t in texts], []
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    told = neardup.components
    monkeypatch.setattr(neardup, "components", lambda edges, rounds=60: (listed.append(edges.count()), told(edges, rounds))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in neardup.keep_similar(docs).collect()} == set(group)
    assert listed[-1] < 20 * len(texts)


def test_components_alone_and_in_rounds_are_the_same(spark, monkeypatch):
    rng = random.Random(11)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (9, 8), (9, 8), (2**63 - 1, -(2**63))]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            low, high = sorted((find(u), find(v)))
            root[high] = low
    frame = spark.createDataFrame(edges, "u long, v long")
    for alone in (neardup.ALONE, 200, 0):
        monkeypatch.setattr(neardup, "ALONE", alone)
        got = [(r.node, r.root) for r in neardup.components(frame).collect()]
        assert sorted(got) == sorted((x, find(x)) for x in root)


def test_few_texts_in_many_partitions_take_few_tasks(spark):
    """Tasks, each of which leaves files, while the session has many more partitions than the texts fill."""
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(9**6)}" for _ in range(90)]
        for i in range(25):
            words = [*words[1:], f"x{i}"]
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    sc = spark.sparkContext
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "few-tasks")
        assert {r.doc_id for r in neardup.keep_similar(docs).collect()} == set(range(0, 300, 25))
    finally:
        sc.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)
    seen = {s for j in sc.statusTracker().getJobIdsForGroup("few-tasks") for s in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for s in seen if (x := sc.statusTracker().getStageInfo(s)))
    assert 0 < tasks < 80 * 97
