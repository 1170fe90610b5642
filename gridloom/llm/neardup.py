"""SimHash near-duplicates by segment-popcount embedding and a grid range-join.

Fingerprints of 64 bits are cut into 32 segments of two bits.  A segment's bit count is
0, 1 or 2; kept in unary (00, 01, 11) the counts of a fingerprint fill 64 bits again, and
the Manhattan distance of two count vectors is the number of differing unary bits.  A
flipped bit moves one count by at most one, so the Manhattan distance never exceeds the
Hamming distance.  The count vector is cut into PARTS + radius parts: of two vectors
within the radius, PARTS parts at least are equal.  Every choice of PARTS parts is a grid
whose cells are the counts there; fingerprints that share a cell, in the first grid in
which they do, must pass the Manhattan bound and are then verified by Hamming distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.memory import freed
from gridloom.session import cut, let_go, ship, small, table

WORDS, SEED, RADIUS = 3, 42, 3
#: Words of a shingle and the least similarity of near copies, a fraction, where shingle sets are compared.
SET_WORDS, LEAST = 5, (4, 5)
#: Every so many texts one is looked at for common shingles; how often such a one stands there, and how many are remembered.
EVERY, OFTEN, COMMON = 16, 3, 300_000
#: How often sets are drawn to be compared, at most, and with how many others a set is each time; they are drawn while this many pairs of roots meet for each set at a shingle.
DRAWS, DRAWN, MANY = 8, 4, 8
#: Bits of a set's sketch, least and most: the power of two that its size needs; each shingle flips one.
SKETCH = 64, 4096
#: Numbers of 64 bits that a sketch is laid over to where it goes with every shingle: a power of two.
LAID = 8
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20
SPACES = b" \t\n\r\x0b\x0c"
#: Equal parts of the count vector that make a cell of a grid.
PARTS = 4
#: As many edges at most as one task takes by itself; more are tied in rounds.
ALONE = 400_000
#: Texts for each partition of what is written down between the joins, at least.
DEALT = 2000


def _word_blocks(data: bytes, words: int) -> Iterator[list[bytes]]:
    """Words of data in lists of bounded size; each list begins with the last words - 1 of the one before."""
    at, kept = 0, []
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and data[end] not in SPACES:
            end += 1
        found = kept + data[at:end].split()
        if len(found) >= words or end == len(data):
            yield found
            kept = found[len(found) - words + 1 :] if words > 1 else []
        else:
            kept = found
        at = end


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the XXH64 of all word shingles; fewer words than a shingle has: of the whole sequence; none: 0."""
    if not text:
        return 0
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for found in _word_blocks(text.encode("utf-8", "surrogatepass").lower(), words):
        if len(found) >= words:
            hashes = [digest(b" ".join(x), seed) for x in zip(*(found[i:] for i in range(words)), strict=False)]
        elif found and not n:
            hashes = [digest(b" ".join(found), seed)]
        else:
            continue
        n += len(hashes)
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = np.fromiter((fingerprint(x.as_py(), words, seed) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, passed: list[Column | str], text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Columns passed, and fp (the fingerprint's bits as a long). Null texts count as empty."""
    ship(docs.sparkSession)
    rows = docs.select(*passed, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(freed(lambda it: _fingerprints(it, words, seed)), f"{fields}, fp long")


def _grids(radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Bits of the parts of the count vector, and the grids: all choices of PARTS parts."""
    n = PARTS + radius
    cuts = [32 * i // n for i in range(n + 1)]
    return [sum(3 << 2 * x for x in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)], list(combinations(range(n), PARTS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counts(fp: Column) -> Column:
    """The count vector of a fingerprint, in unary."""
    low, high, odd = fp, F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    # Segments 01 and 10 have a count of one, 01 in unary; 11 has two and stays 11.
    return low.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(low.bitwiseAND(high).bitwiseAND(odd), 1))


def candidates(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column fp that share a cell of a grid; each pair once."""
    masks, grids = _grids(radius)
    vec = F.col("vec")
    cells = F.array(*[vec.bitwiseAND(F.lit(_signed(sum(masks[i] for i in g)))) for g in grids])
    laid = fps.select("fp", counts(F.col("fp")).alias("vec")).select("fp", F.posexplode(cells).alias("grid", "cell"))
    p, q = laid.select(F.col("fp").alias("a"), "grid", "cell"), laid.select(F.col("fp").alias("b"), F.col("grid").alias("b_grid"), F.col("cell").alias("b_cell"))
    differ = counts(F.col("a")).bitwiseXOR(counts(F.col("b")))
    equal = sum((F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(masks)), F.lit(0))
    # The first grid in which two meet: no equal part but its own lies before its last one.
    upto = F.element_at(F.array(*[F.lit((1 << g[-1] + 1) - 1) for g in grids]), F.col("grid") + 1)
    once = F.bit_count(equal.bitwiseAND(upto)) == PARTS
    return p.join(q, (F.col("grid") == F.col("b_grid")) & (F.col("cell") == F.col("b_cell")) & (F.col("a") < F.col("b")) & once).select("a", "b")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct fingerprints in column fp that differ in at most radius bits."""
    if not 0 <= radius <= 8:
        raise ValueError("the grids are C(radius + 4, 4) for each fingerprint: radius is 0 to 8")
    u, v = F.col("a"), F.col("b")
    near = (F.bit_count(counts(u).bitwiseXOR(counts(v))) <= radius) & (F.bit_count(u.bitwiseXOR(v)) <= radius)
    return candidates(fps, radius).where(near).select(u.alias("u"), v.alias("v"))


def _least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of the edges (u, v), and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        # Of two roots that an edge joins the larger one goes below the smaller one, then every node right below its root.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (above := root[root])).any():
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _solved(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (u, v), in one task."""
    ship(edges.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([x.to_numpy() for x in batch.columns]) for batch in batches]
        if parts:
            nodes, roots = _least_reachable(*np.concatenate(parts, axis=1))
            for at in range(0, len(nodes), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000]) for x in (nodes, roots)], ["node", "root"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(freed(each), "node long, root long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes, long numbers, in edges (u, v): up to ALONE edges in one task, more by alternating large and small stars, each round written to the shared checkpoint folder.

    root is the smallest node of the component. Stops when a round changes nothing.
    """
    now, seen = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")), None
    if now.count() <= ALONE:
        return _solved(now)
    now = cut(now.distinct())
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] <= ALONE:
            return _solved(now)
        if state == seen:
            break
        seen = state
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.toDF("u", "v")).distinct())
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def groups(rows: DataFrame, key: Column, radius: int = RADIUS) -> DataFrame:
    """For rows with a column fp: (fp, n, root, component_id, n_links) for each fingerprint.

    n: its rows; root: the smallest fingerprint reachable over links; component_id: the
    smallest key reachable; n_links: how many other fingerprints it links to.
    """
    each = cut(rows.groupBy("fp").agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("n")))
    edges = cut(links(each, radius))
    roots = cut(components(edges))
    degree = edges.select("u").union(edges.select("v")).groupBy("u").agg(F.count(F.lit(1)).alias("n_links"))
    tied = roots.join(degree, roots.node == degree.u).drop("u")
    first = roots.join(each, roots.node == each.fp).groupBy("root").agg(F.min("key").alias("least"))
    named = tied.join(first, "root").select("node", "root", "least", "n_links")
    out = each.join(named, each.fp == named.node, "left")
    return out.select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) for every row of docs.

    Words are what stands between ASCII white space, A-Z in lower case. Null and empty
    texts have fingerprint zero and link like any other; repeated rows come out as often
    as they go in; a null key never becomes a component's id unless all keys of the
    component are null; an empty table gives no rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs, [F.col(key).alias("key")], text, words))
    found = groups(rows, F.col("key"), radius).where("n > 1 OR n_links > 0")
    # Copies share a fingerprint, so the large side may be skewed: a short list is broadcast, a long one joined, where adaptive execution splits the skew.
    named = small(cut(found.select(F.col("fp").alias("known"), "component_id", "n_links")))
    out = rows.join(named, F.col("fp") == F.col("known"), "left")
    return out.select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("known").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def _hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """The XXH64 of the text's word shingles, repeats included; fewer words than a shingle has: of the whole sequence; none: none."""
    digest, parts = xxhash.xxh64_intdigest, []
    for found in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower(), words):
        if len(found) >= words:
            parts.append(np.array([digest(b" ".join(x), seed) for x in zip(*(found[i:] for i in range(words)), strict=False)], np.uint64))
        elif found and not parts:
            parts.append(np.array([digest(b" ".join(found), seed)], np.uint64))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: str | None, words: int = SET_WORDS, seed: int = SEED) -> np.ndarray:
    """The hashes of the text's different word shingles in order, as signed numbers."""
    return np.unique(_hashes(text, words, seed).view(np.int64))


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _set_hash(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def _sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(fp, set): the hash of each text's shingle set, and the set."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                found = [shingles(x.as_py(), words) for x in batch.column(0).slice(at, 100)]
                yield pa.RecordBatch.from_arrays([pa.array(map(_set_hash, found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["fp", "set"])

    return docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(freed(each), "fp long, `set` array<long>")


def _prefixes(docs: DataFrame, passed: list[Column | str], text: str, words: int, least: tuple[int, int]) -> DataFrame:
    """Columns passed, fp (the hash of the shingle set), sim (the SimHash of the shingles), n (the set's size), sketch and prefix: sets as similar as least share a shingle of their prefixes.

    Two sketches differ in no more bits than the sets differ in shingles.

    Any order of shingles that is the same for all texts will do; common shingles, as a
    sample shows them, come last, so that few texts meet at one.
    """
    every = _sets(docs.where(F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(EVERY)) == 0), text, words).select(F.explode("set").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    common = every.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "x").limit(COMMON).orderBy("x").toPandas()
    known, times = common["x"].to_numpy(np.int64), common["n"].to_numpy(np.int64)
    up, down = least
    rows = docs.select(*passed, F.col(text).cast("string").alias("__text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sims, sizes, heads, flips = [], [], [], [], []
            for x in batch.column(batch.num_columns - 1):
                hashes = _hashes(x.as_py(), words)
                found = np.unique(hashes.view(np.int64))
                n = len(found)
                often = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    often = np.where(known[at] == found, times[at], 0)
                fps.append(_set_hash(found))
                sims.append(_majority(hashes))
                sizes.append(n)
                bits = min(SKETCH[1], max(SKETCH[0], 1 << (n - 1).bit_length()))
                odd = np.bincount(found.view(np.uint64) % np.uint64(bits), minlength=bits) & 1
                flips.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                heads.append(found[np.lexsort((found, often))[: n - -(-n * up // down) + 1]])
            cols = [pa.array(fps, pa.int64()), pa.array(sims, pa.int64()), pa.array(sizes, pa.int64()), pa.array(flips, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], "fp", "sim", "n", "sketch", "prefix"])

    ship(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(freed(each), f"{fields}, fp long, sim long, n long, sketch array<long>, prefix array<long>")


def _dealt(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """cut() in no more partitions than rows fill: each partition of few rows is files and tasks that cost more than its rows."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // DEALT)
    return lambda df: cut(df.coalesce(parts))


def similar(rows: DataFrame, texts: DataFrame, words: int = SET_WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """(node, root) of all sets with a chain of sets between them whose neighbours have a Jaccard similarity of at least least.

    rows: row, fp, sim, n, sketch, prefix as by _prefixes; texts: row, text. Pairs come first
    from the fingerprints' links, and from comparing each set with the smallest one at each
    shingle of its prefix, then from some draws where many sets meet that are not yet tied;
    then all sets that are not yet tied are paired where they share a shingle of their
    prefixes, so that a large group of near copies does not meet pair by pair, and no pair is
    missed. All pairs are verified by their whole sets.
    """
    up, down = least
    cut = _dealt(rows)
    same = cut(rows.groupBy("fp").agg(F.min("row").alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("fp").alias("known"), "best"))
    one = rows.join(small(same), F.col("fp") == F.col("known"), "left").where("known IS NULL OR row = best")
    each = one.select("fp", "row", "n", "sketch")

    def may(nu: str, nv: str, iu: str, iv: str) -> Column:
        """Whether sets of these sizes whose first common shingles stand at these places of their order can be similar."""
        sizes = F.least(nu, nv) * down >= F.greatest(nu, nv) * up
        return sizes & (F.least(F.col(nu) - F.col(iu), F.col(nv) - F.col(iv)) * (up + down) >= (F.col(nu) + F.col(nv)) * up)

    # The longer of two sketches is twice the other at most, as sizes differ by a quarter at most: its halves are laid over each other.
    fold = lambda a, b: f"if(size({a}) > size({b}), zip_with(slice({a}, 1, size({b})), slice({a}, size({b}) + 1, size({b})), (p, q) -> p ^ q), {a})"
    differ = F.expr(f"aggregate(zip_with({fold('su', 'sv')}, {fold('sv', 'su')}, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)")
    close = differ * (up + down) <= (F.col("nu") + F.col("nv")) * (down - up)

    # Dealt out by shingle once: the aggregate, the join and the distinct rows need no other exchange.
    met = one.select("fp", "n", F.posexplode("prefix").alias("i", "x")).repartition("x")
    least_one = F.min(F.struct("fp", "n", "i"))
    shared = met.groupBy("x").agg(least_one.alias("first"), F.max("fp").alias("last")).where("first.fp <> last").select("x", "first")
    held = cut(met.join(shared, "x").distinct().select("x", "fp", "n", "i", F.col("first.fp").alias("u"), F.col("first.n").alias("nu"), F.col("first.i").alias("iu")))
    let_go(rows.sparkSession)

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are similar."""
        size = small(cut(pairs.select("u").union(pairs.select("v")).distinct().toDF("fp").join(each.select("fp", "n", "sketch").dropDuplicates(["fp"]), "fp")), 50_000)
        sized = pairs.join(size.toDF("u", "nu", "su"), "u").join(size.toDF("v", "nv", "sv"), "v").where(F.least("nu", "nv") * down >= F.greatest("nu", "nv") * up)
        tried = cut(sized.where(close).select("u", "v", "nu", "nv"))
        wanted = small(cut(each.join(tried.select("u").union(tried.select("v")).distinct().toDF("fp"), "fp").select("row")))
        sets = cut(_sets(texts.join(wanted, "row"), "text", words).dropDuplicates(["fp"]))
        full = tried.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
        found = cut(full.where(F.size(F.array_intersect("a", "b")) * (up + down) >= (F.col("nu") + F.col("nv")) * up).select("u", "v"))
        let_go(rows.sparkSession)
        return found

    # Sets of one fingerprint are compared with the least of them; of two that link, the least ones are.
    sims = cut(one.groupBy("sim").agg(F.min("fp").alias("rep"), F.max("fp").alias("last")))
    reps = sims.select("sim", "rep")
    linked = links(reps.select(F.col("sim").alias("fp"))).join(reps.toDF("u", "a"), "u").join(reps.toDF("v", "b"), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    alike = one.select("sim", "fp").join(small(sims.where("rep <> last").select("sim", "rep")), "sim").where("fp <> rep").select(F.col("rep").alias("u"), F.col("fp").alias("v"))
    # u is the smaller of the two here and below.
    firsts = cut(held.withColumnRenamed("n", "nv").where(F.col("fp") != F.col("u")).where(may("nu", "nv", "iu", "i")).select("u", F.col("fp").alias("v")).union(linked).union(alike).distinct())
    let_go(rows.sparkSession)
    ties = near(firsts)
    tied = components(ties)
    placed = lambda: cut(held.select("x", "fp", "n", "i").join(small(cut(tied)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    at = placed()
    # While many roots meet, as in a large group in which each is similar to some of the others: each set with a few more, drawn at each shingle, until the draws bring little.
    for turn in range(DRAWS):
        crowds = at.groupBy("x").agg(F.count(F.lit(1)).alias("all"), F.approx_count_distinct("root").alias("roots")).where("roots > 1")
        meetings, sets_there = crowds.agg(F.sum(F.col("roots") * (F.col("roots") - 1) / 2), F.sum("all")).first()
        if not meetings or meetings < MANY * sets_there:
            break
        mixed = at.groupBy("x").agg(F.min_by(F.struct("fp", "n", "i", "root"), F.xxhash64("fp", "x", F.lit(turn))).alias("drawn"))
        drawn = at.join(mixed, "x").where(F.col("root") != F.col("drawn.root")).where(may("n", "drawn.n", "i", "drawn.i"))
        few = drawn.groupBy("fp").agg(F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("fp", "drawn.fp", F.lit(turn)).alias("h"), F.col("drawn.fp").alias("other")))), 1, DRAWN).alias("few")).select("fp", F.explode("few.other").alias("other"))
        tried = cut(few.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct().join(small(firsts), ["u", "v"], "left_anti"))
        found = near(tried)
        firsts, brought = firsts.union(tried), found.count()
        if brought:
            ties = ties.union(found)
            tied = components(ties)
            at = placed()
        if brought * 50 < tried.count():
            break
    # First the roots that meet at a shingle, then their members: tied sets are never paired.
    roots = cut(at.groupBy("x", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("i").alias("i")))
    fits = (F.least("p.high", "q.high") * down >= F.greatest("p.low", "q.low") * up) & (F.least(F.col("p.high") - F.col("p.i"), F.col("q.high") - F.col("q.i")) * (up + down) >= (F.col("p.low") + F.col("q.low")) * up)
    others = cut(roots.alias("p").join(roots.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.root") < F.col("q.root")) & fits).select(F.col("p.x").alias("x"), F.col("p.root").alias("root"), F.col("q.root").alias("other")))
    far = small(cut(others.select("x", F.col("other").alias("root")).distinct()), 400_000)
    one_side = cut(at.join(small(others, 400_000), ["x", "root"]).select("x", "other", F.col("fp").alias("a"), F.col("n").alias("nu"), F.col("i").alias("iu")))
    other_side = cut(at.join(far, ["x", "root"], "left_semi").select("x", F.col("root").alias("other"), F.col("fp").alias("b"), F.col("n").alias("nv"), F.col("i").alias("iv")))
    # Sketches, laid over to a few numbers, go with both sides, so that pairs of a large group that cannot be similar are never listed.
    short = f"if(size(sketch) <= {LAID}, sketch, transform(sequence(1, {LAID}), j -> aggregate(sequence(j, size(sketch), {LAID}), 0L, (s, k) -> s ^ element_at(sketch, k))))"
    seen = small(cut(one_side.select("a").union(other_side.select("b")).distinct().toDF("fp").join(each.select("fp", F.expr(short).alias("s")).dropDuplicates(["fp"]), "fp")), 50_000)
    pairs = one_side.join(seen.toDF("a", "su"), "a").join(other_side.join(seen.toDF("b", "sv"), "b"), ["x", "other"]).where(may("nu", "nv", "iu", "iv") & close)
    return components(ties.union(near(cut(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().join(small(firsts), ["u", "v"], "left_anti")))))


def _row(docs: DataFrame) -> Column:
    """A hash of all columns in which a null is no other value's."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))])


def keep_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SET_WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """As keep_one, where texts are near copies if the Jaccard similarity of their word shingles is at least least; all such pairs are found."""
    row = _row(docs)
    rows = cut(_prefixes(docs, [F.col(key).alias("key"), row.alias("row")], text, words, least))
    tied = similar(rows.select("row", "fp", "sim", "n", "sketch", "prefix"), docs.select(row.alias("row"), F.col(text).alias("text")), words, least)
    copies = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    known = copies.join(tied, copies.fp == tied.node, "left").where("copies > 1 OR root IS NOT NULL")
    shared = small(cut(known.select(F.col("fp").alias("known"), F.coalesce("root", "fp").alias("group"))))
    return _best(docs, rows.select("key", "row", "fp"), shared, key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without all but one of each component: the row of the smallest key, ties by the hash of all columns.

    Exactly repeated rows are one row; rows that differ in a null are not. Columns stay as
    they are, whatever their names; a null key comes last; null and empty texts are copies
    of each other; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, [F.col(key).alias("key"), _row(docs).alias("row")], text, words))
    shared = small(cut(groups(rows, F.col("key"), radius).where("n > 1 OR n_links > 0").select(F.col("fp").alias("known"), F.col("root").alias("group"))))
    return _best(docs, rows, shared, key)


def _best(docs: DataFrame, rows: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """The rows of docs without all but the best of each group; rows: key, row, fp; shared: known (an fp), group."""
    member = rows.join(shared, F.col("fp") == F.col("known")).groupBy("group", "key", "row").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("key").isNull().alias("last"), "key", "row", "copies")
    best = small(cut(member.groupBy("group").agg(F.min(order).alias("best"))))
    # Rows that go: all members but the best of each group. Exact repeats of the best go below.
    ranked = cut(member.join(best, "group").select("key", "row", (F.col("best.key").eqNullSafe(F.col("key")) & (F.col("best.row") == F.col("row"))).alias("stays"), "copies"))
    # The caller's columns stay in one struct, so that no name of theirs meets one of ours.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(key).alias("its_key"), _row(docs).alias("its_row"))
    same = F.col("its_key").eqNullSafe(F.col("key")) & (F.col("its_row") == F.col("row"))
    # A short list of rows that go is broadcast; a long one is joined by key.
    left = marked.join(small(ranked.where(~F.col("stays")).select("key", "row")), same, "left_anti")
    twice = ranked.where("stays AND copies > 1").select("key", "row")
    if twice.isEmpty():
        return left.select("given.*")
    return left.join(twice, same, "left_anti").select("given.*").unionByName(left.join(twice, same, "left_semi").select("given.*").dropDuplicates())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
