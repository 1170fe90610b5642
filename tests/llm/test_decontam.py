import random

from gridloom.llm import decontam as D


def least(pattern, text):
    """For each end, the least edit distance of pattern to a part of text; plain dynamic programming."""
    column, out = list(range(len(pattern) + 1)), []
    for s in text:
        before, column = column, [0]
        for i, p in enumerate(pattern, 1):
            column.append(min(before[i] + 1, column[-1] + 1, before[i - 1] + (p != s or s == 0)))
        out.append(column[-1])
    return out


def test_myers_against_plain_programming():
    rng = random.Random(2)
    for _ in range(300):
        pattern = [rng.randint(1, 4) for _ in range(rng.randint(1, 90))]
        text = [rng.randint(0, 5) for _ in range(rng.randint(0, 60))] + pattern[: rng.randint(0, 90)] + [rng.randint(0, 4) for _ in range(9)]
        assert D.myers(pattern, text) == least(pattern, text)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            words.insert(i, f"new{rng.randrange(99)}")
        elif words and kind == 1:
            words.pop(min(i, len(words) - 1))
        elif words:
            words[min(i, len(words) - 1)] = f"other{rng.randrange(99)}"
    return words


def test_search_finds_all_that_programming_finds():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 45)))) for i in range(25)]
    index = D.Index(items)
    found_any = 0
    for _ in range(100):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(items)[1].split()
            parts += changed(rng, words, rng.randint(0, 1 + len(words) // 4)) + [rng.choice(vocabulary)]
        got = {k: d for k, d, *_ in index.search(" ".join(parts))}
        want = {}
        for key, text in items:
            words = text.split()
            best = min(least(words, parts), default=99)
            if best <= D.budget(len(words)):
                want[key] = best
        assert got == want
        found_any += len(want)
    assert found_any > 50


def test_places_and_counts():
    item = "One two three four five six seven eight nine ten eleven twelve"
    text = f"Before. {item.upper()}! Between: one two three FOUR five six seven eight ten eleven twelve; after"
    (key, distance, count, start, end), = D.Index([("x", item)]).search(text)
    assert (key, distance, count) == ("x", 0, 2) and text[start:end] == item.upper()


def test_texts_shorter_than_a_piece():
    index = D.Index([(1, "a b c d e f g h i j"), (2, "a b")])
    assert index.search("a") == [] and index.search("x y") == [] and [h[0] for h in index.search("a b")] == [2]


def test_query_on_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.distance for r in D.op3_decontamination(spark, sf).collect()}
    want = {}
    for d in docs:
        there = D.words_of(d.text)
        for i in items:
            words = D.words_of(i.text)
            if len(set(words) & set(there)) < 0.5 * len(set(words)):
                continue
            best = min(D.myers(D.Index([(0, i.text)]).items[0][1], [D.Index([(0, i.text)]).numbers.get(w, 0) for w in there]), default=99) if len(there) < 400 else None
            if best is not None and best <= D.budget(len(words)):
                want[d.doc_id, i.item_id] = best
    short = {d.doc_id for d in docs if len(D.words_of(d.text)) < 400}
    assert {k: v for k, v in got.items() if k[0] in short} == want


def test_edge_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "..."), (4, "solo pair")], "item_id long, text string")
    rows = [(1, None, 7), (2, "", 7), (3, f"x {item} y", 7), (3, f"x {item} y", 7), (None, "a Solo, pair it is", 7), (5, "word " * 50000 + item, 7), (6, "solo and pair", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((str(r.doc_id), r["item_id"], r.distance) for r in D.matches(docs, items, ["doc_id"], block_words=5).collect())
    assert got == sorted([("3", 1, 0)] * 4 + [("None", 4, 0)] + [("5", 1, 0)] * 2)
    left = D.clean(docs, items)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "6"]
    assert sorted(str(r.doc_id) for r in D.clean(docs, items, block_words=1).collect()) == ["1", "2", "6"]
    assert D.matches(docs, items, docs.columns).columns == [*docs.columns, "item_id_", "distance", "matches", "start", "end"]
    assert D.matches(docs, items.limit(0), ["doc_id"]).count() == 0 and D.matches(docs.limit(0), items, ["doc_id"]).count() == 0
