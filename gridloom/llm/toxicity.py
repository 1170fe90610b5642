"""Toxicity by maximum-scoring segments over token log-odds.

Words and their beginnings get log-odds of toxic against clean documents under an
informative Dirichlet prior; the lower confidence bound is a word's score, and words
without one cost a little.  All maximal scoring segments of a text are found in one pass
(Ruzzo and Tompa).  By extreme-value theory the best segment of a clean text of n words
reaches x with probability 1 - exp(-K n exp(-lambda x)) (Karlin and Altschul), and the r
best together reach a sum of normalised scores x with about exp(-x) x^(r-1) / (r! (r-1)!).
The least of these probabilities, over all numbers of segments, is the text's; minus its
logarithm is the evidence, which a logistic curve turns into a score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.memory import freed
from gridloom.llm.names import free
from gridloom.session import cut, ship, table

#: Labelled documents that a model is fitted on, about, however many there are.
TRAIN_ROWS = 16_000
#: Rest of crc32(doc_id) by FOLDS: 0 is held out, the last calibrates, the others are counted.
FOLDS = 5
#: Lengths of word beginnings; the prior's documents as a share of the counted ones; documents that an entry needs; standard errors of the bound; least score of an entry.
STEMS, PRIOR, SUPPORT, ERRORS, LEAST = (4, 5, 6), 0.02, 3, 1.64, 1.0
#: What a word without an entry costs: so many times what clean documents gain a word, and at least this; significance that a reported passage needs.
COST_TIMES, COST, SIGNIFICANT = 3.0, 0.01, 0.01
WORD = re.compile(r"[^\W\d_]+")
#: Words remembered by a worker, and documents whose entries are counted together.
REMEMBERED, COUNTED = 75_000, 200


def entries_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = -3.0
    cost: float = COST
    none: float = 0.0

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def word(self, word: str) -> float:
        """A word's score: of its entries, the one of the largest score; 0 if it has none."""
        if (found := self._known.get(word)) is None:
            found = max((s for e in entries_of(word) if (s := self.scores.get(e)) is not None), default=0.0)
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            if len(word) <= 40:
                self._known[word] = found
        return found

    def hits(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """(number of the word, score) of the words that score, and the number of words."""
        out, n, get, new = [], 0, self._known.get, self.word
        for n, word in enumerate(WORD.findall(text.lower()), 1):
            if (s := get(word)) is None:
                s = new(word)
            if s:
                out.append((n - 1, s))
        return out, n

    def evidence(self, best: float, words: int) -> float:
        """-log10 of the chance that a clean text of so many words has a segment as good."""
        if best <= 0 or words <= 0:
            return 0.0
        expected = self.scale * words * math.exp(-self.rate * best)
        return -math.log10(-math.expm1(-expected)) if expected > 1e-9 else (self.rate * best - math.log(self.scale * words)) / math.log(10)

    def together(self, scores: list[float], words: int) -> float:
        """-log10 of the least chance that a clean text of so many words has r segments as good, over all r; each r more is charged with a factor of two.

        Only segments that lie above what a text of this length has by chance count.
        """
        if not scores or words <= 0:
            return 0.0
        found = self.evidence(max(scores), words)
        if len(scores) > 1:
            base, total, parts = math.log(self.scale * words), 0.0, 0.0
            for r, s in enumerate(sorted(scores, reverse=True), 1):
                x = self.rate * s - base
                if x <= 0:
                    break
                total += x
                # ln r! + ln (r - 1)!
                parts += math.log(r) + (math.log(r - 1) if r > 1 else 0.0)
                if r > 1:
                    found = max(found, (total - (r - 1) * math.log(max(total, 1e-300)) + parts - (r - 1) * math.log(2)) / math.log(10))
        return found

    def score(self, evidence: float) -> float:
        """Without evidence, the share of toxic documents that have none either; else by the curve, and not below."""
        if evidence <= 0:
            return self.none
        return max(self.none, 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.shift)))))


def segments(hits: list[tuple[int, float]], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in order, in linear time; words between hits cost the same each.

    Each segment knows the nearest one to its left that began lower, so that a search for
    such a one goes from link to link and passes none twice.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, link
    total, at = 0.0, 0
    for place, score in hits:
        total -= cost * (place - at)
        at = place + 1
        first, last, before = place, place, total
        total += score
        if score <= 0:
            continue
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, last, before, total, j))
                break
            first, _, before, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, after - before) for a, b, before, after, _ in found]


def _signature(text: str) -> int:
    """Least hash of the five-word shingles: near copies mostly share it, and count as one document when a model is fitted."""
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def _map(df: DataFrame, function, fields: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(freed(function), fields)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_signature(t) for t in b.column(0).to_pylist()], pa.int64())], [*b.schema.names, "sig"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of document weights by entry and class, one row for each entry of so many documents: a batch's entries would fill the worker's memory."""
    for b in (x.slice(at, COUNTED) for x in batches for at in range(0, x.num_rows, COUNTED)):
        sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for text, toxic, weight in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for entry in {e for w in set(WORD.findall(text.lower())) for e in entries_of(w)}:
                sums[entry][toxic] += weight
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array([x[1] for x in sums.values()], pa.float64()), pa.array([x[0] for x in sums.values()], pa.float64())], ["entry", "toxic", "clean"])


def _tallied(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Clean texts: how often each score occurs; the row without a score holds words, and weights times words and times gains."""
    for b in batches:
        times: dict[float, int] = defaultdict(int)
        words, weighted, gained = 0, 0.0, 0.0
        for text, weight in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
            hits, n = model.hits(text)
            words, weighted, gained = words + n, weighted + weight * n, gained + weight * sum(s for _, s in hits)
            for _, s in hits:
                times[s] += 1
        columns = [[None, *times], [words, *times.values()], [weighted] + [0.0] * len(times), [gained] + [0.0] * len(times)]
        kinds = [pa.float64(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["score", "n", "weighted", "gained"])


def _measured(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Label, weight, words, best segment and evidence of each text."""
    for b in batches:
        rows = []
        for text, toxic, weight in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            hits, n = model.hits(text)
            scores = [s for *_, s in segments(hits, model.cost)]
            rows.append((toxic, weight, n, max(scores, default=0.0), model.together(scores, n)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["toxic", "weight", "words", "best", "evidence"])


def fold(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model from about `rows` labelled documents, chosen by a hash of the key; those of fold 0 never take part.

    A key with several labels is toxic if one of them is. Rows without key, label or text
    are left out. With one class only, nothing scores.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(fold("k") != 0)
    share = min(1.0, rows / max(1, known.count()))
    # About `rows` keys: the broadcast is bounded whatever the number of labels.
    some = known.where(F.pmod(F.xxhash64(F.lit("train"), "k"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(some), F.col("key") == F.col("k")).select("text", "y", (fold("k") == FOLDS - 1).alias("tune"))
    picked = cut(_map(picked, _signed, "text string, y int, tune boolean, sig long"))
    copies = picked.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    picked = picked.join(F.broadcast(copies), "sig").select("text", "y", (F.lit(1.0) / F.col("n")).alias("weight"), "tune")
    sizes = picked.groupBy("tune", "y").agg(F.sum("weight").alias("n")).collect()
    of = {(r.tune, r.y): r.n for r in sizes}
    na, nb = of.get((False, 1), 0.0), of.get((False, 0), 0.0)
    if not na or not nb:
        return Model()
    prior = PRIOR * (na + nb)
    counts = _map(picked.where("NOT tune").select("text", "y", "weight"), _counted, "entry string, toxic double, clean double").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") > SUPPORT - 0.5)
    mass = F.lit(prior) * (F.col("a") + F.col("b")) / F.lit(na + nb)
    odds = F.log((F.col("a") + mass) / (F.lit(na + prior) - F.col("a") - mass + 0.5)) - F.log((F.col("b") + mass) / (F.lit(nb + prior) - F.col("b") - mass + 0.5))
    bound = odds - F.lit(ERRORS) * F.sqrt(1 / (F.col("a") + mass) + 1 / (F.col("b") + mass))
    # As many entries as the counted documents have: what is collected is bounded by their number, which rows bounds.
    best = counts.select("entry", bound.alias("score")).where(F.col("score") > LEAST).orderBy(F.desc("score"), "entry").collect()
    model = Model({r.entry: float(r.score) for r in best})
    return _calibrated(model, picked.where("tune").select("text", "y", "weight"))


def _calibrated(model: Model, tuning: DataFrame) -> Model:
    """Rate and scale of the extreme-value law from clean documents, then a logistic curve over the evidence. To the driver come one row a score and a few numbers a document."""
    tally = _map(tuning.where("y = 0").select("text", "weight"), lambda it: _tallied(it, model), "score double, n long, weighted double, gained double")
    tally = tally.groupBy("score").agg(F.sum("n").alias("n"), F.sum("weighted").alias("weighted"), F.sum("gained").alias("gained")).collect()
    whole = next((r for r in tally if r.score is None), None)
    model.cost = max(COST, COST_TIMES * (whole.gained / max(1.0, whole.weighted) if whole else 0.0))
    # One hit of the middle strength is added, so that the rate stays finite.
    known = sorted((r.score, r.n) for r in tally if r.score is not None) + [(float(np.median(list(model.scores.values()) or [1.0])), 1)]
    values, times = np.array([v for v, _ in known]), np.array([n for _, n in known])
    plain = max(1, (whole.n if whole else 0) + 1 - int(times.sum()))
    total = lambda rate: (plain * math.exp(-rate * model.cost) + times @ np.exp(rate * values)) / (plain + times.sum())
    low, high = 1e-3, 4.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    model.rate = max(0.05, low)
    fields = "toxic int, weight double, words long, best double, evidence double"
    clean = _map(tuning.where("y = 0"), lambda it: _measured(it, model), fields).select("words", "best").collect()
    tops = [model.rate * r.best - math.log(r.words) for r in clean if r.words and r.best > 0]
    model.scale = min(1.0, max(1e-6, math.exp(float(np.mean(tops)) - 0.5772) * len(tops) / max(1, len(clean)))) if tops else 1e-3
    seen = sorted(_map(tuning, lambda it: _measured(it, model), fields).select("toxic", "weight", "evidence").collect())
    x = np.array([r.evidence for r in seen])
    y = np.array([float(r.toxic) for r in seen])
    w = np.array([r.weight for r in seen])
    bare = x <= 0
    model.none = min(0.49, float(w[bare] @ y[bare] / max(1.0, w[bare].sum()))) if len(x) else 0.0
    # Toxic labels without any evidence say nothing about how much of it is enough.
    used = ~bare | (y == 0)
    x, y, w = x[used], y[used], w[used]
    if not len(x) or y.min() == y.max():
        return model
    # Smoothed targets and a weak ridge keep the curve finite for separable classes.
    up, down = (w @ y + 1) / (w @ y + 2), 1 / (w @ (1 - y) + 2)
    aim = np.where(y > 0, up, down)
    a, b = 1.0, -2.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([w @ ((p - aim) * x) + 1e-3 * a, w @ (p - aim) + 1e-3 * b])
        q = w * p * (1 - p) + 1e-9
        h = np.array([[q @ (x * x) + 1e-3, q @ x], [q @ x, q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-8:
            break
    model.slope, model.shift = max(a, 1e-3), b
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model, made: list[str]) -> Iterator[pa.RecordBatch]:
    limit = -math.log10(SIGNIFICANT)
    kinds = [pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))]
    for b in batches:
        rows = []
        for item in b.column(b.num_columns - 1):
            text = item.as_py() or ""
            hits, n = model.hits(text)
            found = segments(hits, model.cost)
            sure = [x for x in found if model.evidence(x[2], n) >= limit]
            places = [m.span() for m in WORD.finditer(text.lower())] if sure else []
            passages = [{"start": places[x][0], "end": places[y][1], "score": s} for x, y, s in sure]
            scores = [s for *_, s in found]
            rows.append((model.score(model.together(scores, n)), max(scores, default=0.0), len(sure), passages))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*b.schema.names[:-1], *made])


def score(docs: DataFrame, model: Model, passed: list[Column | str], text: str = "text") -> DataFrame:
    """Columns passed, score (0 to 1), best (of the segments), n_passages and passages: struct(start, end, score), in characters of the lower-cased text.

    Every text is read whole. All segments together make the score; a passage is one that
    is significant by itself. Null and empty texts have no evidence: the lowest score.
    Equal texts have equal scores; columns not passed are never read; a made column whose
    name a passed one has gets an underscore.
    """
    rows = docs.select(*passed, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    made = free(["score", "best", "n_passages", "passages"], rows.columns)
    kinds = ["double", "double", "int", "array<struct<start:int,`end`:int,score:double>>"]
    told = ", ".join(f"`{n}` {k}" for n, k in zip(made, kinds, strict=True))
    return _map(rows, lambda it: _scored(it, model, made), f"{fields}, {told}")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of the labels outside fold 0, and its toxic passages (start:end). A null doc_id counts as the empty text in the fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, ["doc_id", (fold("doc_id") == 0).alias("held_out")])
    told = F.expr("array_join(transform(passages, p -> concat(p.start, ':', p.end)), ',')")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "best", "n_passages", told.alias("passages"))


def _passed(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for item in b.column(at):
            hits, n = model.hits(item.as_py() or "")
            keep.append(model.score(model.together([s for *_, s in segments(hits, model.cost)], n)) < 0.5)
        yield b.filter(pa.array(keep, pa.bool_()))


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns, whatever their names. Null and empty texts stay."""
    at = docs.columns.index(text)
    return _map(docs, lambda it: _passed(it, model, at), docs.schema)
