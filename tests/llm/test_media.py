import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from gridloom.llm import media as M


def filtered(samples, kinds, step):
    """Scan lines filtered by hand, pixel by pixel."""
    out = []
    for y, line in enumerate(samples):
        up = samples[y - 1] if y else bytes(len(line))
        row = [kinds[y]]
        for x, v in enumerate(line):
            a = line[x - step] if x >= step else 0
            b, c = up[x], up[x - step] if x >= step else 0
            p = a + b - c
            near = min((a, b, c), key=lambda t: abs(p - t))
            row.append((v - [0, a, b, (a + b) // 2, near][kinds[y]]) & 255)
        out.append(bytes(row))
    return b"".join(out)


def png(width, lines, body, colour=2):
    head = struct.pack(">IIBBBBB", width, lines, 8, colour, 0, 0, 0)
    data = zlib.compress(body)
    return M.SIGNATURE + M._chunk(b"IHDR", head) + M._chunk(b"tEXt", b"a\x00b") + M._chunk(b"IDAT", data[:7]) + M._chunk(b"IDAT", data[7:]) + M._chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,step", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters_are_undone(colour, step):
    rng = random.Random(step)
    samples = [bytes(rng.randrange(256) for _ in range(5 * step)) for _ in range(40)]
    kinds = [rng.randrange(5) for _ in samples]
    got = M.decode_png(png(5, 40, filtered(samples, kinds, step), colour))
    assert got.tobytes() == b"".join(samples)


def test_broken_pictures_are_refused():
    good = M.encode_png(M.pad(b"hello " * 100))
    assert M.decode_png(good).tobytes() == M.pad(b"hello " * 100)
    for bad in (good[:-1], good[:20], b"x" + good[1:], good[:50] + bytes([good[50] ^ 1]) + good[51:]):
        with pytest.raises(ValueError):
            M.decode_png(bad)


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 191, b"x" * 192, b"x" * 193, bytes(range(256)) * 300, b"word " * 60000])
def test_payload_round_trip(data):
    padded = M.pad(data)
    assert len(padded) % 192 == 0 and len(padded) >= 192 and padded.startswith(data) and set(padded[len(data) :]) <= {32}
    stored = M.encode_png(padded)
    assert M.decode_png(stored).tobytes() == padded and M.encode_png(padded) == stored
    assert len(M.feature(M.decode_png(stored))) == 8


def test_hash_of_a_near_picture_is_near():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (200, 192)).astype(np.uint8)
    b = a.copy()
    b[5, 7] ^= 3
    other = rng.integers(0, 256, (200, 192)).astype(np.uint8)
    far = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(M.feature(x), M.feature(y), strict=True))
    assert far(a, b) <= 4 < far(a, other)
    grey = a.reshape(200, -1, 3).mean(axis=2)
    assert np.allclose(M._shrink(grey, 25), grey.reshape(25, 8, 64).mean(axis=1))


def test_query_and_edge_rows(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = M.op7_media(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        padded = M.pad(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "é🙂", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = sorted(M.digest(M.store(docs)).collect(), key=lambda r: (r.n_bytes, str(r.doc_id)))
    assert [(r.doc_id, r.n_bytes, r.payload_bytes) for r in out] == [(1, 0, 192), (1, 0, 192), (None, 0, 192), (2, 6, 192)]
    assert len({(r.media_sha256, r.feature) for r in out[:3]}) == 1
    assert M.digest(M.store(docs.limit(0))).count() == 0
