"""Media columns: payloads as PNG in binary columns, read back, with cosine-transform hashes.

PNG by its public specification: IHDR, IDAT (a zlib stream cut into chunks) and IEND,
each with a CRC-32; scan lines are filtered and unfiltered with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import ship, table

#: A scan line has WIDTH pixels of three 8-bit samples.
WIDTH, SAMPLES = 64, 3
LINE = WIDTH * SAMPLES
CHUNK = 1 << 16
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the shrunk picture, and of the block of low frequencies that is hashed.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes) -> bytes:
    """data followed by spaces up to a positive multiple of a scan line."""
    return data + b" " * (max(LINE, -(-len(data) // LINE) * LINE) - len(data))


def encode_png(payload: bytes) -> bytes:
    """An RGB picture WIDTH pixels wide whose samples are the payload.

    Either no line is filtered, or each takes the filter (none, sub, up) of the least
    absolute sum; the smaller stream is stored.
    """
    raw = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    left = np.zeros_like(raw)
    left[:, SAMPLES:] = raw[:, :-SAMPLES]
    above = np.zeros_like(raw)
    above[1:] = raw[:-1]
    forms = np.stack([raw, raw - left, raw - above])
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.zeros((len(raw), LINE + 1), np.uint8)
    lines[:, 1:] = raw
    packed = zlib.compress(lines.tobytes(), LEVEL)
    if best.any():
        lines[:, 0] = best
        lines[:, 1:] = forms[best, np.arange(len(raw))]
        packed = min(packed, zlib.compress(lines.tobytes(), LEVEL), key=len)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(raw), 8, 2, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered scan lines, for all five filters. Runs of one vectorisable filter are undone together."""
    out = np.empty_like(lines)
    zero = np.zeros(lines.shape[1], np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        kind, part = int(kinds[start]), lines[start:end]
        above = out[start - 1] if start else zero
        if kind == 0:
            out[start:end] = part
        elif kind == 1:
            out[start:end] = np.cumsum(part.reshape(len(part), -1, step), axis=1, dtype=np.uint8).reshape(part.shape)
        elif kind == 2:
            out[start:end] = np.cumsum(np.vstack([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(start, end):
                out[y] = _by_pixel(lines[y], out[y - 1] if y else zero, kind, step)
        else:
            raise ValueError(f"unknown filter {kind}")
    return out


def _by_pixel(line: np.ndarray, above: np.ndarray, kind: int, step: int) -> np.ndarray:
    now, up, got = line.astype(int), above.astype(int), np.zeros(len(line), int)
    for x in range(0, len(line), step):
        s = slice(x, x + step)
        a = got[x - step : x] if x else np.zeros(step, int)
        c = up[x - step : x] if x else np.zeros(step, int)
        b = up[s]
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        got[s] = (now[s] + guess) & 255
    return got.astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """Samples (lines x bytes) of an 8-bit picture without interlace. A wrong signature, checksum, length or chunk order is a ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off within a chunk")
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(body) != n or crc != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, colour, _, _, interlace = head
    step = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or step is None or interlace:
        raise ValueError("only 8-bit grey or colour pictures without interlace are read")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (width * step + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(height, -1)
    return unfilter(raw[:, 1:], raw[:, 0], step)


@lru_cache(maxsize=4)
def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n) + 1)[None] / (2 * n))


def _shrink(grey: np.ndarray, side: int) -> np.ndarray:
    """Means over side equal parts of the first axis; parts may hold fractions of lines."""
    total = np.vstack([np.zeros(grey.shape[1]), np.cumsum(grey, axis=0)])
    edges = np.linspace(0, len(grey), side + 1)
    whole = np.minimum(edges.astype(int), len(grey) - 1)
    at = total[whole] + (edges - whole)[:, None] * grey[whole]
    return np.diff(at, axis=0) * (side / len(grey))


def feature(samples: np.ndarray) -> bytes:
    """64 bits: signs, against their median, of the lowest frequencies of the shrunk grey picture but the mean's."""
    grey = samples.reshape(len(samples), -1, SAMPLES).mean(axis=2)
    small = _shrink(_shrink(grey, SIDE).T, SIDE).T
    basis = _cosines(SIDE, LOW + 1)
    low = np.round(basis @ small @ basis.T, 6)[:LOW, 1:]
    return np.packbits((low > np.median(low)).ravel()).tobytes()


def _encoded(batches: Iterator[pa.RecordBatch], passed: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # a bounded number of pictures at a time
            part = batch.slice(at, 256)
            data = [(x or "").encode() for x in part.column(part.schema.get_field_index("text")).to_pylist()]
            columns = [part.column(part.schema.get_field_index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in data], pa.int64()), pa.array([encode_png(pad(x)) for x in data], pa.binary())], [*passed, "n_bytes", "media"])


def store(docs: DataFrame, passed: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns passed, n_bytes and media (the PNG). Null texts count as empty: one line of spaces. Other columns are left out."""
    ship(docs.sparkSession)
    kept = docs.select(*passed, F.col(text).cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*passed).schema)
    return kept.mapInArrow(lambda it: _encoded(it, list(passed)), f"{fields}, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch], passed: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item in batch.column(batch.schema.get_field_index("media")):
            data = item.as_py()
            samples = decode_png(data)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples).hex()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in passed), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*passed, *names])


def digest(media: DataFrame, passed: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Columns passed and what the stored pictures hold, read back from the binary column media."""
    ship(media.sparkSession)
    kept = media.select(*passed, "media")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*passed).schema)
    return kept.mapInArrow(lambda it: _read(it, list(passed)), f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as PNG, read back, with digests and a picture hash."""
    return digest(store(table(spark, sf_dir, "documents")))
