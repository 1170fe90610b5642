"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of m words may differ from a passage in k words (inserted, left out or
changed), k = ERRORS_IN of m.  Cut into k + 1 pieces, at least one piece stands in the
passage unchanged and at most k words from its place.  Texts are searched for exact
pieces, and the stretches around hits are verified with Myers' bit-parallel distance,
in which the item is matched against any part of the stretch.

The test items are taken in blocks of bounded size: each block goes to all tasks as a
broadcast index, and the documents pass over it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.memory import freed
from gridloom.llm.names import free
from gridloom.session import cut, ship, table

#: Share of an item's words that may differ; items shorter than SHORT words must match exactly.
ERRORS_IN, SHORT = 0.2, 8
#: Words of test items in one block, at most (an item is never cut; a longer one is a block of its own).
BLOCK_WORDS = 200_000
#: Filters of blocks that run in one task.
CHAIN = 4
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def budget(m: int, share: float = ERRORS_IN) -> int:
    return int(m * share) if m >= SHORT else 0


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """For each place of text, the least edit distance of pattern to a part of text that ends there (Myers 1999, semi-global); symbol 0 equals nothing."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, s in enumerate(pattern):
        masks[s] = masks.get(s, 0) | 1 << i
    masks[0] = 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []
    for s in text:
        eq = masks.get(s, 0)
        across = eq | down
        diag = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(diag | up) & full, up & diag
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        # A match may begin anywhere: the first row stays zero.
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(across | plus) & full, plus & across
        out.append(score)
    return out


class Index:
    """Pieces of a block of items, by piece length, as sorted hashes with the (item, place) of each."""

    def __init__(self, items: list[tuple[object, str | None]], share: float = ERRORS_IN):
        self.numbers: dict[str, int] = {}
        #: Keys of equal word sequences (one search stands for all), the sequence, and its budget.
        self.items: list[tuple[list, list[int], int]] = []
        at: dict[tuple, int] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for key, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if not words:
                continue
            if (known := at.setdefault(tuple(words), len(self.items))) < len(self.items):
                self.items[known][0].append(key)
                continue
            k = budget(len(words), share)
            cuts = [len(words) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = self._hashes(np.array(words[a:b], np.uint64), b - a)
                found.setdefault(b - a, []).append((int(piece[0]), len(self.items), a))
            self.items.append(([key], words, k))
        self.pieces = {}
        for n, rows in found.items():
            rows.sort()
            self.pieces[n] = np.array([r[0] for r in rows], np.uint64), [r[1:] for r in rows]

    @staticmethod
    def _hashes(words: np.ndarray, n: int) -> np.ndarray:
        """A hash of every n words in a row; hits are verified, so equal hashes of other words do no harm."""
        if len(words) < n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ words[i : len(words) - n + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def search(self, text: str | None) -> list[tuple[object, int, int, int, int]]:
        """(item, distance, matches, first word's start, last word's end) of the items within their budget: the best match's distance and place, and how many matches do not overlap."""
        lowered = (text or "").lower()
        get = self.numbers.get
        words = np.fromiter((get(w, 0) for w in WORD.findall(lowered)), np.uint64)
        if not words.any():
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for n, (hashes, places) in self.pieces.items():
            there = self._hashes(words, n)
            left = np.searchsorted(hashes, there)
            for at in np.flatnonzero((left < len(hashes)) & (hashes[np.minimum(left, len(hashes) - 1)] == there)):
                j = int(left[at])
                while j < len(hashes) and hashes[j] == there[at]:
                    item, place = places[j]
                    k, m = self.items[item][2], len(self.items[item][1])
                    begin = int(at) - place
                    spans.setdefault(item, []).append((max(0, begin - k), min(len(words), begin + m + k)))
                    j += 1
        out, offsets = [], None
        for item, ranges in spans.items():
            keys, pattern, k = self.items[item]
            best, ends = None, []
            for a, b in _merged(ranges):
                for i, d in enumerate(myers(pattern, words[a:b].tolist()), a):
                    if d <= k:
                        ends.append((d, i))
            if not ends:
                continue
            count = _apart(ends, len(pattern) - k)
            best = min(ends)
            if offsets is None:
                offsets = [m.span() for m in WORD.finditer(lowered)]
            first = _first(pattern, words, best[1], best[0], k)
            out += [(key, best[0], count, offsets[first][0], offsets[best[1]][1]) for key in keys]
        return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _apart(ends: list[tuple[int, int]], least: int) -> int:
    """How many matches lie at least so many words apart, the better ones first within reach."""
    n, last = 0, None
    for _, i in sorted(ends, key=lambda x: x[1]):
        if last is None or i - last >= max(1, least):
            n, last = n + 1, i
    return n


def _first(pattern: list[int], words: np.ndarray, end: int, distance: int, k: int) -> int:
    """The first word of a match that ends at end: the reversed item against the reversed words before it."""
    a = max(0, end - len(pattern) - k + 1)
    back = words[a : end + 1][::-1].tolist()
    m = len(pattern)
    row = list(range(m + 1))
    best = (row[m], end + 1)
    for j, s in enumerate(back, 1):
        before, row = row, [j]
        for i, p in enumerate(reversed(pattern), 1):
            row.append(min(before[i] + 1, row[-1] + 1, before[i - 1] + (p != s or s == 0)))
        if row[m] < best[0]:
            best = (row[m], end + 1 - j)
        if best[0] <= distance:
            break
    return min(best[1], end)


def _searched(batches: Iterator[pa.RecordBatch], index, item: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    held = index.value
    for b in batches:
        rows, found = [], []
        for i, text in enumerate(b.column(b.num_columns - 1)):
            for hit in held.search(text.as_py()):
                rows.append(i)
                found.append(hit)
        if rows:
            left = [c.take(pa.array(rows)) for c in b.columns[:-1]]
            more = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([*left, pa.array(more[0], item), *(pa.array(c, pa.int32()) for c in more[1:])], [*b.schema.names[:-1], *names])


def matches(docs: DataFrame, items: DataFrame, passed: list[Column | str], text: str = "text", item: str = "item_id", item_text: str = "text", share: float = ERRORS_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and test item that stands in it: columns passed, item_id, distance, matches, start, end.

    Words are runs of letters and digits in lower case; distance counts words; start and
    end are characters of the lower-cased text. Every item is compared with every text,
    whole, block of items by block of items; there is no limit on hits. Null and empty
    texts and items without words match nothing; items of fewer than SHORT words must
    stand in a text exactly; repeated items and documents give repeated rows. A made
    column whose name a passed one has gets an underscore; an empty table gives no rows.
    """
    from pyspark.sql.types import LongType, StringType

    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item].dataType
    whole = isinstance(kind, LongType) or kind.simpleString() in ("int", "smallint", "tinyint")
    named = items.select(F.col(item).cast(LongType() if whole else StringType()).alias("item"), F.col(item_text).cast("string").alias("text"))
    rows = docs.select(*passed, F.col(text).cast("string").alias("__text"))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    names = free(["item_id", "distance", "matches", "start", "end"], rows.columns)
    fields = ", ".join([*given, f"`{names[0]}` {'long' if whole else 'string'}", *(f"`{n}` int" for n in names[1:])])
    kind_ = pa.int64() if whole else pa.string()
    out = None
    for block in _blocks(named, block_words):
        index = spark.sparkContext.broadcast(Index(block, share))
        part = rows.mapInArrow(lambda it, index=index: _searched(it, index, kind_, names), fields)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).mapInArrow(lambda it: iter(()), fields)


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of at most so many words, one block at a time on the driver."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len(words_of(r.text))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r.item, r.text))
        size += n
    if block:
        yield block


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that stands in it."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def _clean(batches: Iterator[pa.RecordBatch], index, at: int) -> Iterator[pa.RecordBatch]:
    held = index.value
    for b in batches:
        yield b.filter(pa.array([not held.search(x.as_py()) for x in b.column(at)], pa.bool_()))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", share: float = ERRORS_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs in which no test item stands, with their columns, whatever their names: one filter for each block of items, without a shuffle.

    Null and empty texts stay. So many filters run in one task, each with a worker of its
    own; beyond CHAIN blocks what is left is written down in between.
    """
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text)
    for n, block in enumerate(_blocks(items.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")), block_words)):
        if n and n % CHAIN == 0:
            docs = cut(docs)
        index = spark.sparkContext.broadcast(Index(block, share))
        docs = docs.mapInArrow(freed(lambda it, index=index: _clean(it, index, at)), docs.schema)
    return docs
