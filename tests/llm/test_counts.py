import math
import random
import struct

import pytest
import sentencepiece

from gridloom.llm import counts
from gridloom.llm.pieces import fields, model_bytes


@pytest.fixture(scope="module")
def unigram():
    return counts.Unigram(model_bytes())


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def library(unigram):
    """The sentencepiece library on the same vocabulary and scores, as a unigram model."""
    out = b""
    for number, value in fields(model_bytes()):
        if number == 1:
            part = dict(fields(value))
            body = field(1, part[1])
            if part.get(3, 1) == 1:
                body += field(2, unigram.score[part[1].decode()])
            else:
                body += field(2, 0.0) + field(3, part[3])
            out += field(1, body)
        elif number == 2:
            body = b"".join(field(n, v) if isinstance(v, int) else varint(n << 3 | 5) + v if n in (10, 15, 51) else field(n, v) for n, v in fields(value) if n not in (3, 35, 43))
            out += field(2, body + field(3, 1) + field(35, 1))
        else:
            out += field(number, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def plain(unigram, word):
    """(score, tokens) by plain programming over one word."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            if (s := unigram.score.get(word[start:end])) is not None:
                options.append((best[start][0] + s, best[start][1] + 1))
        if word[end - 1] not in unigram.score:
            options.append((best[end - 1][0] + unigram.unknown, best[end - 1][1] + len(word[end - 1].encode())))
        best.append(max(options))
    return best[-1]


def test_trie_against_plain_programming(unigram):
    rng = random.Random(4)
    words = {counts.SPACE + "".join(rng.choice("thereinga漢🙂é▁") for _ in range(rng.randint(0, 14))) for _ in range(1500)}
    got = unigram.counts(words)
    assert set(got) == words
    for w in words:
        assert got[w] == plain(unigram, w)[1]
    assert unigram.counts(set()) == {}


def test_library_agrees(unigram, sf):
    import pyarrow.parquet as pq

    sp = library(unigram)
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    words = {w for t in texts for w in counts.pretokens(t)}
    got = unigram.counts(words)
    ours = [sum(got[w] for w in counts.pretokens(t)) for t in texts]
    theirs = [len(x) for x in sp.encode(texts)]
    # The library adds in single precision: equally good paths may be told apart differently.
    assert sum(a != b for a, b in zip(ours, theirs, strict=True)) <= 0.02 * len(texts)
    assert math.isclose(sum(ours), sum(theirs), rel_tol=1e-4)


def test_edge_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " "), (4, "the the"), (4, "the the"), (None, "the " * 40000), (5, "a\nb  c")]
    docs = spark.createDataFrame(rows, "n_tokens long, text string")
    got = sorted((str(r[0]), r.n_pretokens) for r in counts.count(docs.withColumnRenamed("n_tokens", "key"), ["key"]).collect())
    assert got == sorted([("1", 0), ("2", 0), ("3", 2), ("4", 2), ("4", 2), ("None", 40001), ("5", 3)])
    assert counts.count(docs.limit(0), ["n_tokens"]).count() == 0
