"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a run of documents are walked in the order of their trie: a
node's best forward score, under a unigram model, comes from the nodes above it from
which a piece leads to it, and is computed once for all pre-tokens that begin with it.
Terminal nodes store how many tokens the best path has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.names import free
from gridloom.llm.pieces import BYTE, NORMAL, SPACE, fields, model_bytes
from gridloom.session import ship, table

#: Characters of text whose pre-tokens share a trie, about.
RUN = 12_000_000
#: How much less a character outside the vocabulary scores than the rarest piece.
PENALTY = 10.0


class Unigram:
    """A vocabulary with log-probabilities by Zipf's law of a piece's rank in the model file: p ~ 1 / (rank + 2.7)."""

    def __init__(self, model: bytes):
        parts = [dict(fields(v)) for n, v in fields(model) if n == 1]
        names = [p[1].decode() for p in parts if p.get(3, NORMAL) == NORMAL]
        total = math.log(sum(1 / (r + 2.7) for r in range(len(names))))
        self.score = {p: -math.log(r + 2.7) - total for r, p in enumerate(names)}
        self.bytes = sum(p.get(3, NORMAL) == BYTE for p in parts) == 256
        self.unknown = min(self.score.values()) - PENALTY
        # The lengths of pieces by their last character: few are tried at a node.
        lengths: dict[str, set[int]] = {}
        for p in names:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(x) for c, x in lengths.items()}

    def counts(self, words: set[str]) -> dict[str, int]:
        """Tokens of each pre-token. Of equally good paths, the one whose last piece is longest."""
        score, lengths, unknown, out = self.score.get, self.lengths, self.unknown, {}
        best, tokens, last = [0.0], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                char = word[end - 1]
                for length in lengths.get(char, ()):
                    if length > end:
                        break
                    if (s := score(word[end - length : end])) is not None and (now := best[end - length] + s) >= top:
                        top, n = now, tokens[end - length] + 1
                if score(char) is None and (now := best[end - 1] + unknown) > top:
                    top, n = now, tokens[end - 1] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else 1)
                best.append(top)
                tokens.append(n)
            last, out[word] = word, tokens[-1]
        return out


def pretokens(text: str | None) -> list[str]:
    """A text's words, each with the sign for the space before it; further spaces in a row are words of their own."""
    return [SPACE + w for w in text.split(" ")] if text else []


@lru_cache(maxsize=2)
def unigram_of(model: bytes) -> Unigram:
    return Unigram(model)


def _counted(batches: Iterator[pa.RecordBatch], model: bytes, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches are gathered up to RUN characters, so that their pre-tokens share a trie."""
    unigram = unigram_of(model)
    run: list[pa.RecordBatch] = []
    words: set[str] = set()
    size = 0

    def settled() -> Iterator[pa.RecordBatch]:
        known = unigram.counts(words)
        for batch in run:
            pre, total = [], []
            for text in batch.column(batch.num_columns - 1):
                found = pretokens(text.as_py())
                pre.append(len(found))
                total.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pre, pa.int64()), pa.array(total, pa.int64())], [*batch.schema.names[:-1], *names])

    for whole in batches:
        for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
            run.append(batch)
            for text in batch.column(batch.num_columns - 1):
                words.update(pretokens(text.as_py()))
                size += len(text.as_py() or "")
            if size >= RUN:
                yield from settled()
                run, words, size = [], set(), 0
    yield from settled()


def count(docs: DataFrame, passed: list[Column | str], text: str = "text", path: str | None = None) -> DataFrame:
    """Columns passed, n_pretokens and n_tokens of every text, whole. Null and empty texts have none; equal texts have equal counts; other columns are ignored."""
    ship(docs.sparkSession)
    model = model_bytes(path)
    rows = docs.select(*passed, F.col(text).cast("string").alias("__text"))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    names = free(["n_pretokens", "n_tokens"], rows.columns)
    return rows.mapInArrow(lambda it: _counted(it, model, names), ", ".join([*given, *(f"`{n}` long" for n in names)]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    return count(table(spark, sf_dir, "documents"), ["doc_id"])
