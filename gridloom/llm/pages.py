"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its elements, by their place in the tree, and its text
blocks, by path and content.  A token's occurrence vector says how often it stands on
each page of a host.  Tokens with equal vectors form an equivalence class; classes that
stand on most pages of the host are valid and, nested by their places, are its template.
What stands between a template's tokens are its slots.  From the root on, the slot that
holds the text of its parent is entered, until text or headings would be left outside:
that slot is the article's.  What is extracted is the article slot's blocks, without the
texts that belong to valid classes themselves.  Names of elements (nav, form, "sidebar")
only settle which blocks inside a slot are parts of another kind.

Vectors are never gathered: two sums of page hashes stand for each, so a host with a
third of all pages is aggregated like any other.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import cut, ship, small, table

#: Share of a host's pages that a class must stand on, and the tokens that it needs.
SHARE, TOKENS = 0.8, 2
#: Shares of a slot's text that may be left outside: in other slots, and loose beside them.
OUTSIDE, LOOSE = 0.25, 0.02
#: Shares of a host's text, and of one page's article slot, that may be the template's own: beyond them the pages are copies of each other, and equal texts say nothing.
OWN_TEXT, OWN_SLOT = 0.5, 0.75
#: Share of a page's text beyond which a name alone no longer makes an element another part than the article, if it has so many words.
MOST, PROSE = 0.5, 10
#: So many blocks in a row that are links only are a menu, where no slot was entered.
MENU = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend"}
#: Elements that a start tag of the same group ends, up to the nearest container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are nodes of the tree: what may hold slots.
NODES = frozenset("html body main article section div center table tbody tr td".split())
SKIPPED = frozenset("head title nav footer aside form script style noscript template iframe object svg math canvas button select textarea dialog menu audio video map datalist".split())
RAW = "script|style|textarea|iframe|title|noembed|noframes|xmp"
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal overlay "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond replies related recommended share sharing social widget pagination pager skip".split()
)
#: Hints that count whatever word stands beside them, but for words of state, which tell of a page and not of the element.
SURE = frozenset("adbox advert adverts advertisement advertising sponsored cookie cookies gdpr newsletter breadcrumb breadcrumbs sidebar navbar navigation disqus commentlist".split())
STATE = frozenset("has have no not is with without on off open closed enabled disabled layout single full".split())
#: Words that may stand beside a hint in one name.
BESIDE = frozenset("list area box block wrap wrapper container bar link links button buttons left right top bottom main slot unit inner outer section site page post entry article item items text primary secondary global thread form panel row col column content body group holder wp js the my icon icons title zone global bottom small large".split())
#: Names of reader comments.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Names of the article's own parts, with which the faint hints don't count: an article's header holds its heading.
OWN, FAINT = frozenset("article post entry story content body".split()), frozenset("header masthead aside notice".split())
#: As browsers read a tag: a quote opens a value only after an equals sign. Possessive, so that no text makes it slow.
ATTRS = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))?+)*+"""
TAG = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW})(?=[\s/>]){ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|<(?:[!?]|/(?![a-zA-Z>]))[^>]*(?:>|\Z)|</>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>{ATTRS})>|</?[a-zA-Z].*\Z""", re.S | re.I
)
ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]*+))?+""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Kinds of tokens: tree nodes (any, article, main), text blocks.
PLAIN, ARTICLE, MAIN, TEXT = 0, 1, 2, 3


class Block:
    __slots__ = ("head", "heading", "linked", "named", "nodes", "parts", "path", "sure", "text")

    def __init__(self, path: str, nodes: tuple[int, ...], sure: bool, named: tuple[int, ...], heading: bool, head: int):
        self.path, self.nodes, self.sure, self.named, self.heading, self.head = path, nodes, sure, named, heading, head
        self.parts, self.linked, self.text = [], 0, ""


class Page:
    """A page's blocks in order, and its tree nodes: token -> (parent, kind)."""

    __slots__ = ("blocks", "nodes")

    def __init__(self):
        self.blocks: list[Block] = []
        self.nodes: dict[int, tuple[int, int]] = {0: (0, PLAIN)}


def _hash(*parts: object) -> int:
    return (xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) or 1) - (1 << 63)


def _hinted(word: str) -> set[str]:
    """The hints of one name: all its words are hints or stand beside one, or a sure hint stands in it without a word of state."""
    parts = {p.lower() for p in PART.findall(word)}
    hints = parts & HINTS
    if not hints or not (parts <= HINTS | BESIDE or all(len(p) < 2 or p.isdigit() or p in HINTS or p in BESIDE for p in parts) or (parts & SURE and not parts & STATE)):
        return set()
    return hints


def _role(name: str, attrs: str) -> tuple[str, str, int]:
    """(class for the path, what its attributes say: "" nothing, "off" no part of an article, "named" so by its names, "comments" reader comments, kind)."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
    own = re.sub(r"\d+", "0", found.get("class", ""))
    role = found.get("role", "").lower()
    kind = ARTICLE if role == "article" or found.get("itemprop", "").lower() == "articlebody" else MAIN if role == "main" else PLAIN
    if kind or name in ("html", "body", "main") or name in HEADINGS:
        return own, "", kind
    if role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return own, "off", kind
    words = [*found.get("class", "").split(), *found.get("id", "").split()]
    hints: set[str] = set().union(*map(_hinted, words)) if words else set()
    if hints and OWN & {p.lower() for w in words for p in PART.findall(w)}:
        hints -= FAINT
    if name == "article":
        hints &= COMMENTS | {"related", "ad", "ads", "sponsored", "promo"}
    return own, ("comments" if hints <= COMMENTS else "named") if hints else "", kind


def parse(source: str | None) -> Page:
    """The page's text blocks and tree. Broken markup is read as browsers do in the cases that matter here: left-out and unknown end tags, stray quotes."""
    page = Page()
    blocks = page.blocks
    # Open elements: name, path, nodes, sure, named, depth of the outermost header's parent (-1: in none), seen children.
    stack: list[tuple] = [("", "", (0,), False, (), -1, {})]
    now = Block("", (0,), False, (), False, -1)
    sizes: dict[int, int] = {}
    words: dict[int, int] = {}
    comments: set[int] = set()
    links = at = number = 0

    def flush() -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            blocks.append(now)
        name, path, nodes, sure, named, head, _ = stack[-1]
        now = Block(path, nodes, sure, named, name in HEADINGS, head)

    def text(raw: str) -> None:
        if raw:
            shown = entities.unescape(raw) if "&" in raw else raw
            now.parts.append(shown)
            if links:
                now.linked += len(shown.strip())

    source = source or ""
    for m in TAG.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "a":
                links = 0
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            # An inline end tag never ends a block.
            if depth and (name in BLOCK or name in SKIPPED or not any(x[0] in BLOCK for x in stack[depth:])):
                shut = any(x[0] in BLOCK or x[0] in SKIPPED for x in stack[depth:])
                del stack[depth:]
                if shut:
                    flush()
            continue
        if name == "br":
            text(" ")
            continue
        ended = len(stack)
        if name in CLOSES_P:
            ended = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), ended)
        if name in SIBLINGS:
            like, within = SIBLINGS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in like:
                    ended = min(ended, i)
        if ended < len(stack):
            del stack[ended:]
        own, said, kind = _role(name, m["attrs"]) if m["attrs"] else ("", "", PLAIN)
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK:
            if name in BLOCK:
                flush()
            continue
        if name == "a":
            links = 1
        _, path, nodes, sure, named, head, children = stack[-1]
        own = f"{name}.{own}" if own else name
        if name in NODES or kind:
            nth = children[own] = children.get(own, -1) + 1
            node = _hash("node", nodes[-1], own, nth)
            page.nodes[node] = (nodes[-1], kind or (ARTICLE if name == "article" else MAIN if name == "main" else PLAIN))
            nodes = (*nodes, node)
        if said in ("named", "comments"):
            number += 1
            named = (*named, number)
            if said == "comments":
                comments.add(number)
        if name == "header" and head < 0:
            head = len(nodes) - 1
        stack.append((name, f"{path}/{own}", nodes, sure or said == "off" or name in SKIPPED, named, head, {}))
        if name in BLOCK or name in SKIPPED:
            flush()
    text(source[at:])
    stack = stack[:1]
    flush()
    # A name that would take most of the page's text is no hint; comments go unless there is nothing else.
    total = 0
    for b in blocks:
        if not b.sure:
            total += len(b.text)
            for x in b.named:
                sizes[x] = sizes.get(x, 0) + len(b.text)
                words[x] = words.get(x, 0) + b.text.count(" ") + 1
    void = {x for x, n in sizes.items() if words[x] >= PROSE and (n >= total if x in comments else n > MOST * total)}
    for b in blocks:
        b.sure = b.sure or any(x not in void for x in b.named)
    return page


def _of_header(b: Block) -> bool:
    """Whether a block of a header is none of the article's: of its header only the headings stay, of the site's nothing."""
    return b.head >= 0 and not b.heading


def measure(page: Page) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Nodes: token -> [parent, kind, text, headings, text within child nodes] of what stands below; text blocks: token -> [node, TEXT, text, headings, how often]. Blocks of other parts count nothing."""
    nodes = {token: [parent, kind, 0, 0, 0] for token, (parent, kind) in page.nodes.items()}
    texts: dict[int, list[int]] = {}
    for b in page.blocks:
        if b.sure or _of_header(b):
            continue
        mass = max(0, len(b.text) - b.linked)
        heads = int(b.heading and mass > 0 and (b.head < 0 or b.head > 0 and page.nodes[b.nodes[b.head]][1] != PLAIN))
        for token in b.nodes:
            row = nodes[token]
            row[2] += mass
            row[3] += heads
            row[4] += mass * (token != b.nodes[-1])
        row = texts.setdefault(_hash("text", b.path, b.text), [b.nodes[-1], TEXT, 0, 0, 0])
        row[2] += mass
        row[3] += heads
        row[4] += 1
    return nodes, texts


def descend(nodes: dict[int, list[float]], pages: float) -> int:
    """The article slot: from the root, the child that holds its parent's text is entered while little text and no heading is left outside; an article or main element decides where text doesn't."""
    children: dict[int, list[int]] = {}
    for token, (parent, *_) in nodes.items():
        if token != parent:
            children.setdefault(parent, []).append(token)
    at = 0
    while nodes[at][1] != ARTICLE and (below := children.get(at)):
        best = max(below, key=lambda x: (nodes[x][2], nodes[x][3], -x))
        like = [x for x in below if nodes[x][1] in (ARTICLE, MAIN) and nodes[x][2] > 0]
        if len(like) == 1:
            best = like[0]
        whole, heads = nodes[at][2], nodes[at][3] - nodes[best][3]
        outside, loose = whole - nodes[best][2], whole - nodes[at][4]
        if nodes[best][2] <= 0 or heads >= 0.5 * pages or len(like) != 1 and (outside > OUTSIDE * whole or loose > LOOSE * whole):
            break
        at = best
    return at


def extract(page: Page, slots: Iterable[int] = (), own: frozenset[int] = frozenset()) -> str:
    """The blocks of the article slot, joined: the first of slots that the page has, else the one that its own tree gives. own: texts of the template."""
    slot = next((x for x in slots if x in page.nodes and x), None)
    if slot is None:
        slot = descend(measure(page)[0], 1)
    found = [b for b in page.blocks if not b.sure and slot in b.nodes]
    # A header inside the slot keeps its headings; one that the slot lies beside or within is the site's.
    found = [b for b in found if b.head < 0 or b.heading and slot != 0 and b.nodes.index(slot) <= b.head and (page.nodes[slot][1] != PLAIN or b.nodes[b.head] != slot or len(b.nodes) > b.head + 1)]
    left = [b for b in found if _hash("text", b.path, b.text) not in own]
    if sum(len(b.text) for b in left) < (1 - OWN_SLOT) * sum(len(b.text) for b in found):
        left = found
    if page.nodes[slot][1] == PLAIN and (slot == 0 or page.nodes[slot][0] in (0, *_tops(page))):
        left = _no_menus(left)
    return "\n".join(b.text for b in left)


def _tops(page: Page) -> list[int]:
    """The nodes right below the root, as html is."""
    return [x for x, (parent, _) in page.nodes.items() if parent == 0 and x]


def _no_menus(blocks: list[Block]) -> list[Block]:
    """Blocks without runs of MENU or more that are nothing but links."""
    out: list[Block] = []
    run: list[Block] = []
    for b in [*blocks, None]:
        if b is not None and b.linked >= len(b.text):
            run.append(b)
            continue
        out += run if len(run) < MENU else []
        run = []
        if b is not None:
            out.append(b)
    return out


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 8]
    for batch in batches:
        columns: list[list] = [[] for _ in kinds]
        for host, page, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nodes, texts = measure(parse(source))
            for rows in (nodes, texts):
                for token, (parent, kind, mass, heads, more) in rows.items():
                    seen = xxhash.xxh64_intdigest(f"{page}:{more if kind == TEXT else 1}")
                    for c, x in zip(columns, (host, token, parent, kind, mass, heads, 0 if kind == TEXT else more, seen & 0xFFFFFFFF, seen >> 32), strict=True):
                        c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "token", "parent", "kind", "mass", "heads", "below", "a", "b"])


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, own) from each host's common tokens."""
    for batch in batches:
        rows = [(host, *deduce(tokens)) for host, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["host", "slot", "own"])


def deduce(tokens: list[dict]) -> tuple[int, list[int]]:
    """The template of a host's common tokens: its article slot (0: none), and the texts of valid classes."""
    sizes: dict[tuple, int] = {}
    for t in tokens:
        vector = t["pages"], t["a"], t["b"]
        sizes[vector] = sizes.get(vector, 0) + 1
    valid = [t for t in tokens if sizes[t["pages"], t["a"], t["b"]] >= TOKENS]
    nodes: dict[int, list[float]] = {t["token"]: [t["parent"], t["kind"], t["mass"], t["heads"], t["below"]] for t in valid if t["kind"] != TEXT}
    root = next((t for t in tokens if t["token"] == 0), None)
    if root is None:
        return 0, []
    nodes[0] = [0, PLAIN, root["mass"], root["heads"], root["below"]]
    # A node whose parent is in no valid class cannot be reached and nests nowhere.
    nodes = {x: row for x, row in nodes.items() if row[0] in nodes}
    texts = [t for t in valid if t["kind"] == TEXT]
    if sum(t["mass"] for t in texts) > OWN_TEXT * root["mass"]:
        texts = []
    for t in texts:
        at = t["parent"]
        while at in nodes:
            nodes[at][2] -= t["mass"]
            nodes[at][3] -= t["heads"]
            nodes[at][4] -= t["mass"] * (at != t["parent"])
            if at == 0:
                break
            at = nodes[at][0]
    return int(descend(nodes, root["pages"])), [t["token"] for t in texts]


def templates(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, int]:
    """(host, slot, own) for every host of two pages or more, and the article slot of the classes over all hosts.

    A class is valid if it stands on SHARE of the host's pages and has TOKENS tokens. A
    token's vector is known by its count of pages and two sums of hashes of page and
    number of occurrences. What is collected for a host are tokens that stand on most of
    its pages: no more than one page holds, by a factor.
    """
    ship(pages.sparkSession)
    rows = pages.select(_host(url).alias("host"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    seen = rows.mapInArrow(_tokenised, "host string, token long, parent long, kind long, mass long, heads long, below long, a long, b long")
    sums = [F.sum(c).alias(c) for c in ("mass", "heads", "below", "a", "b")]
    vectors = cut(seen.groupBy("host", "token", "parent", "kind").agg(F.count(F.lit(1)).alias("pages"), *sums).where(f"pages > 1 OR kind <> {TEXT}"))

    def common(tokens: DataFrame) -> DataFrame:
        sizes = small(tokens.where("token = 0 AND pages > 1").select(F.col("host").alias("of"), F.col("pages").alias("all")))
        held = tokens.join(sizes, F.col("host") == F.col("of")).where(F.col("pages") >= F.lit(SHARE) * F.col("all"))
        return held.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "kind", "pages", "mass", "heads", "below", "a", "b")).alias("tokens")).mapInArrow(_deduced, "host string, slot long, own array<long>")

    every = vectors.where(f"kind <> {TEXT}").groupBy(F.lit("").alias("host"), "token", "parent", "kind").agg(F.sum("pages").alias("pages"), *sums)
    overall = common(every).select("slot").first()
    return common(vectors), overall["slot"] if overall else 0


def _extracted(batches: Iterator[pa.RecordBatch], overall: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for source, slot, own in zip(*(batch.column(batch.num_columns - i).to_pylist() for i in (3, 2, 1)), strict=True):
            out.append(extract(parse(source), (slot or 0, overall), frozenset(own or ())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*batch.schema.names[:-3], "text", "n_chars"])


def main_text(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Every page is read whole. A page without its host's article slot, or alone on its
    host, takes the slot of the classes over all hosts; without that, the one that its own
    tree gives. A null or empty page has an empty text; pages whose URL is null or has no
    host share one; a repeated page_id counts once for each row; an empty table gives no
    rows; other columns are ignored.
    """
    found, overall = templates(pages, page, url, html)
    known = cut(found)
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), _host(url).alias("host"), F.col(html).cast("string").alias("html"))
    # Hosts are counted; many are joined by key, where adaptive execution splits a hot one: a template is a few numbers.
    joined = rows.join(small(known.withColumnRenamed("host", "of")), F.col("host") == F.col("of"), "left")
    ship(pages.sparkSession)
    return joined.select("page_id", "url", "html", "slot", "own").mapInArrow(lambda it: _extracted(it, overall), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
