"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans stand alone.  Weak candidates (identifiers, mixed-case keys, endpoints) are
reported only where a complementary part stands within SCOPE code points: an identifier
needs a secret, a secret an identifier or an endpoint, an endpoint a secret.  The search
is an interval join: parts are laid into cells of SCOPE code points, each cell keeps per
type its least start and greatest end, and a candidate meets the cells within reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import cut, small, table

SCOPE = 200
#: Spans of a block, and code points of a slice of a text, where a row holds many.
BLOCK, SLICE = 256, 4096


def _folded(words: str) -> str:
    """Letters of a pattern in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({_folded('password|passwd|secret|token|api_?key')}){_SET}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
IDENT = f"({_folded('access_?key_?id|client_?id|account_?id|username|login')}){_SET}([A-Za-z0-9_.@-]{{3,}})"
KEY = "[A-Za-z0-9+/]{24,}={0,2}"
URL = r"""(?:https?|wss?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+"""
#: Kinds in the order of ties, with the part that each is.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "key": "secret", "url": "endpoint"}
BASE = ("assign", "access", "hex")
_EMPTY = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _starts(parts: str, matches: str) -> str:
    """Sum of the lengths before each match; by blocks of 256 matches, as SQL has no running sum over an array. An aggregate over one element names a value, so that it is worked out once and not for every match."""
    gaps = f"aggregate(array({parts}), cast(array() as array<int>), (none0, ps) -> transform({matches}, (m, i) -> length(ps[i]) + if(i = 0, 0, length({matches}[i - 1]))))"
    return (
        f"aggregate(array({gaps}), cast(array() as array<int>), (none, g) -> "
        "aggregate(array(transform(sequence(0, (size(g) - 1) div 256), b -> aggregate(slice(g, b * 256 + 1, 256), 0, (s, x) -> s + x))), cast(array() as array<int>), (none2, sums) -> "
        "transform(g, (x, i) -> aggregate(slice(sums, 1, i div 256), 0, (s, y) -> s + y) + aggregate(slice(g, (i div 256) * 256 + 1, i % 256 + 1), 0, (s, y) -> s + y))))"
    )


def _found(df: DataFrame, kind: str, pattern: str, maybe: Column, fits: str = "true", group: int = 0) -> DataFrame:
    """df with a column kind: spans of the pattern's matches that fit, SQL over x.m, the match or its group if one is given. Texts that are not maybe have none."""
    rank = list(KINDS).index(kind)
    df = df.withColumn("__m", F.when(maybe, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("__m", F.when(F.size("__m") > 0, F.col("__m")))
    has = F.col("__m").isNotNull()
    df = df.withColumn("__parts", F.when(has, F.split("__text", pattern, -1)))
    df = df.withColumn("__g", F.when(has, F.regexp_extract_all("__text", F.lit(pattern), F.lit(group))) if group else F.col("__m"))
    df = df.withColumn("__at", F.when(has, F.expr(_starts("__parts", "__m"))))
    spans = f"filter(transform(arrays_zip(__m, __g, __at), x -> struct(x.__at AS start, {rank} AS rank, x.__at + length(x.__m) AS end, '{kind}' AS kind, x.__g AS m)), x -> {fits})"
    spans = f"transform({spans}, x -> struct(x.start AS start, x.rank AS rank, x.end AS end, x.kind AS kind))"
    return df.withColumn(kind, F.coalesce(F.expr(spans), F.expr(f"cast(array() as {_EMPTY})"))).drop("__m", "__parts", "__g", "__at")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns __given (a struct of all columns of docs, so that no name of theirs meets one of ours), __text, __row (a hash of the text), __base and __weak (arrays of spans).

    A span is struct(start, rank, end, kind), code points, end exclusive. Matches are
    leftmost and do not overlap within a kind; those that fail their length go. Weak
    candidates that overlap a base span are left out.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__given"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    text_ = F.col("__text")
    sign = text_.contains("=") | text_.contains(":")
    # Cheap tests first: most texts need no search for positions.
    named = lambda *words: sign & text_.rlike("|".join(map(_folded, words)))
    df = _found(df, "assign", ASSIGN, named("passw", "secret", "token", "api"), "length(x.m) >= 12", group=2)
    df = _found(df, "access", ACCESS, text_.contains("AKIA"))
    df = _found(df, "hex", HEX, text_.rlike(HEX))
    df = _found(df, "ident", IDENT, named("access", "client", "account", "username", "login"))
    df = _found(df, "key", KEY, text_.rlike(KEY), "x.m RLIKE '[a-z]' AND x.m RLIKE '[A-Z]' AND x.m RLIKE '[0-9]'")
    df = _found(df, "url", URL, text_.contains("://"))
    df = df.withColumn("base", F.array_sort(F.concat(*BASE)))
    # Base spans by blocks in the order of their starts: of many, a weak one meets the few blocks that it touches.
    blocks = (
        f"transform(sequence(0, (size(base) - 1) div {BLOCK}), i -> aggregate(array(slice(base, i * {BLOCK} + 1, {BLOCK})), cast(null as struct<first:int,last:int,spans:{_EMPTY}>), "
        "(none, b) -> struct(b[0].start AS first, array_max(transform(b, x -> x.end)) AS last, b AS spans)))"
    )
    hits = "exists(b, x -> x.first < w.end AND w.start < x.last AND exists(x.spans, y -> y.start < w.end AND w.start < y.end))"
    weak = "concat(ident, key, url)"
    clear = f"if(size(base) = 0 OR size({weak}) = 0, {weak}, aggregate(array({blocks}), cast(array() as {_EMPTY}), (none, b) -> filter({weak}, w -> NOT {hits})))"
    row = F.struct(F.xxhash64("__text"), F.xxhash64(F.lit("again"), "__text"), F.length("__text"))
    return df.select("__given", "__text", row.alias("__row"), F.col("base").alias("__base"), F.expr(clear).alias("__weak"))


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(__row, added): the weak candidates of each text that stand within scope of a complementary part."""
    part = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("s.kind")]
    hold = scanned.where(F.size("__weak") > 0).select(F.col("__row").alias("row"), F.col("__base").alias("base"), F.col("__weak").alias("weak")).distinct()
    parts = hold.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s", part.alias("part"))
    reach = lambda by: F.explode(F.sequence(F.floor((F.col("s.start") - by) / scope), F.floor((F.col("s.end") + by) / scope)))
    cells = parts.select("row", "part", "s", reach(0).alias("cell")).groupBy("row", "cell", "part").agg(F.min("s.start").alias("first"), F.max("s.end").alias("last"))
    weak = hold.select("row", F.explode("weak").alias("s")).select("row", "s", part.alias("part"), reach(scope).alias("cell"))
    c = cells.select(F.col("row").alias("c_row"), F.col("cell").alias("c_cell"), F.col("part").alias("c_part"), "first", "last")
    fits = ((F.col("part") == "secret") & F.col("c_part").isin("identifier", "endpoint")) | (F.col("part").isin("identifier", "endpoint") & (F.col("c_part") == "secret"))
    near = (F.col("row") == F.col("c_row")) & (F.col("cell") == F.col("c_cell")) & fits & (F.col("first") <= F.col("s.end") + scope) & (F.col("last") >= F.col("s.start") - scope)
    return weak.join(c, near, "left_semi").groupBy(F.col("row").alias("__row")).agg(F.collect_set("s").alias("added"))


def _held(scanned: DataFrame) -> DataFrame:
    """Texts with weak candidates: __row, __base, __weak, written down. The running number keeps the filter above the scan, which else would be done twice."""
    once = scanned.select("__row", "__base", "__weak", F.monotonically_increasing_id().alias("__n"))
    return cut(once.where(F.size("__weak") > 0).drop("__n").distinct())


def _all(scanned: DataFrame, held: DataFrame, scope: int) -> DataFrame:
    """scanned with a column __found: base spans and the linked ones.

    What is linked is a short list, counted and broadcast; a long one is joined by the
    text's hash, where copies of a text may make the large side skewed, and adaptive
    execution splits it.
    """
    none = F.expr(f"cast(array() as {_EMPTY})")
    added = small(cut(linked(held, scope)).withColumnRenamed("__row", "__of"))
    both = scanned.join(added, F.col("__row") == F.col("__of"), "left")
    return both.select("__given", "__text", "__base", F.array_sort(F.concat("__base", F.coalesce("added", none))).alias("__found"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, found) for every row of docs.

    found is the array of all spans, spans the same as text. Null texts count as empty and
    have no spans; equal texts have equal spans, whatever their keys; repeated rows come
    out as often as they go in; an empty table gives no rows; other columns are ignored.
    """
    ours = docs.select(F.col(key).alias("id"), F.col(text).alias("value"))
    rows = cut(scan(ours, "value").select(F.struct("__given.id").alias("__given"), F.lit("").alias("__text"), "__row", "__base", "__weak"))
    out = _all(rows, _held(rows), scope)
    told = lambda c: F.expr(f"array_join(transform({c}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")
    n = [F.expr(f"cast(size(filter(__base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return out.select(F.col("__given.id").alias(key), *n, F.sha2(told("__base"), 256).alias("base_sha256"), told("__found").alias("spans"), F.col("__found").alias("found"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with every found span replaced by ``[kind]``; overlapping spans become one. Columns stay as they are; n_chars, where there is one, is counted anew.

    Null texts stay null; rows without spans stay as they are; repeated rows are redacted
    alike; other columns may have any names; an empty table gives no rows. Spans are merged
    first; then the text is taken in slices, each with the spans that touch it, so that
    a text of many spans is not copied for each of them.
    """
    # Written down once, texts and all: else every text would be scanned for the links and again for its spans.
    scanned = cut(scan(docs, text))
    rows = _all(scanned, _held(scanned), scope)
    # The open group is kept when a span begins after its end.
    step = "if(s.start < a.at, struct(greatest(a.at, s.end) AS at, a.kept AS kept, a.now AS now), struct(s.end AS at, if(a.now.kind IS NULL, a.kept, concat(a.kept, array(struct(a.now.start AS start, a.at AS end, a.now.kind AS kind)))) AS kept, struct(s.start AS start, s.kind AS kind) AS now))"
    none = "struct(0 AS at, cast(array() as array<struct<start:int,end:int,kind:string>>) AS kept, cast(null as struct<start:int,kind:string>) AS now)"
    merged = f"aggregate(__found, {none}, (a, s) -> {step}, a -> concat(a.kept, array(struct(a.now.start AS start, a.at AS end, a.now.kind AS kind))))"
    # A slice: what lies between its spans, and the kind of each that begins in it.
    here = f"filter(m, s -> s.start < (i + 1) * {SLICE} AND s.end > i * {SLICE})"
    label = f"if(s.start >= i * {SLICE}, concat('[', s.kind, ']'), '')"
    cut_ = f"aggregate({here}, struct(0 AS at, '' AS out), (a, s) -> struct(least({SLICE}, s.end - i * {SLICE}) AS at, concat(a.out, substring(b, a.at + 1, s.start - i * {SLICE} - a.at), {label}) AS out), a -> concat(a.out, substring(b, a.at + 1)))"
    sliced = f"aggregate(array({merged}), '', (none, m) -> array_join(transform(regexp_extract_all(__text, '(?s).{{1,{SLICE}}}', 0), (b, i) -> {cut_}), ''))"
    some = F.size("__found") > 0
    rows = rows.withColumn("__new", F.when(some, F.expr(sliced)))
    out = []
    for c in docs.columns:
        given = F.col("__given").getField(c)
        if c == text:
            given = F.when(some, F.col("__new")).otherwise(given)
        elif c == "n_chars":
            given = F.when(some, F.length("__new").cast(docs.schema[c].dataType)).otherwise(given)
        out.append(given.alias(c))
    return rows.select(*out)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the base spans, and all spans."""
    return find(table(spark, sf_dir, "documents")).drop("found")


def _spans_sql(kind: str, pattern: str, fits: str) -> str:
    """DuckDB SQL for the spans of one kind over d(id, doc_id, t)."""
    rank, quoted = list(KINDS).index(kind), pattern.replace("'", "''")
    group = f"regexp_extract_all(t, '{quoted}'{', 2' if 'gs[' in fits else ''})"
    return f"""SELECT id, {rank} AS rk, '{kind}' AS kind, '{KINDS[kind]}' AS part,
      list_sum(list_transform(ps[1:i], lambda p: length(p)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0)::BIGINT AS s,
      length(ms[i]) AS n FROM (SELECT id, ms, ps, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT id, regexp_extract_all(t, '{quoted}') AS ms, regexp_split_to_array(t, '{quoted}') AS ps, {group} AS gs FROM d)) WHERE {fits}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join([_spans_sql("assign", ASSIGN, "length(gs[i]) >= 12"), _spans_sql("access", ACCESS, "true"), _spans_sql("hex", HEX, "true")])}),
loose AS ({" UNION ALL ".join([_spans_sql("ident", IDENT, "true"), _spans_sql("key", KEY, "regexp_matches(ms[i], '[a-z]') AND regexp_matches(ms[i], '[A-Z]') AND regexp_matches(ms[i], '[0-9]')"), _spans_sql("url", URL, "true")])}),
weak AS (SELECT * FROM loose w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = w.id AND b.s < w.s + w.n AND w.s < b.s + b.n)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
added AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM parts p WHERE p.id = w.id AND (w.part = 'secret') <> (p.part = 'secret') AND p.s <= w.s + w.n + {SCOPE} AND p.s + p.n >= w.s - {SCOPE})),
spans AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM added),
told AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rk) FILTER (is_base) AS b, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rk) AS a FROM spans GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN told USING (id)
"""
