"""Main text of web pages by markup and nearest-URL page differencing.

A page becomes a list of lines, one a block. Markup decides most of them: prose inside the article is kept;
navigation, headers, footers, asides, forms, adverts, notices and comments are dropped. Lines that
markup leaves open (pages without an article, blocks of no known kind inside one) are decided by differencing: pages
of a host are ordered by URL path, each is paired with the neighbour whose path shares the longer
prefix, the two pages' lines outside sure prose are aligned by longest common subsequence, and open lines in it are
deleted as the site's template. A neighbour that would leave no open line at all is a copy of the page and deletes nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LISTED, cut, identity, in_python, partitions

#: A quote that is not closed before the next tag is no quote: then the tag ends at the first ">".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+(?=>)|[^>]*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements whose content is no text, elements that are dropped, blocks, prose blocks.
RAW = frozenset("script style noscript template iframe svg textarea title head object video audio canvas".split())
#: Of these, those that run to the end of the page if their end tag is missing; of others only the tag is skipped then.
UNENDED = frozenset("script style textarea title".split())
#: End tags in any case of their ASCII letters, and the start tag that ends a head without one.
ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW}
BODY = re.compile(r"<body(?=[\s/>]|\Z)", re.I | re.A)
#: A slash that belongs to an unquoted value does not close its tag.
VALUE = re.compile(r"=\s*[^\s\"'=<>`]+/\Z")
DROPPED = frozenset("nav footer aside form menu dialog button select fieldset label".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li blockquote pre td th dd dt figcaption caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Words of class, id or role that mark what is no part of an article.
MARKS = frozenset(
    "nav navbar navigation menu submenu footer sidebar aside widget ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices comment comments "
    "disqus respond share sharing social related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe signup login popup modal overlay toolbar masthead contentinfo complementary search".split()
)
HOLDERS = frozenset("article main content post entry story articlebody".split())
#: Marks that hold for an article element too, where it stands inside another.
REPLIES = frozenset("comment comments disqus respond".split())


class Line:
    """A block's text and where it stands: dropped for certain, numbers of marked elements and of articles around it, in a content holder, in prose."""

    __slots__ = ("text", "dropped", "marked", "articles", "holder", "prose")

    def __init__(self, text, dropped, marked, articles, holder, prose):
        self.text, self.dropped, self.marked, self.articles, self.holder, self.prose = text, dropped, marked, articles, holder, prose


class Open(NamedTuple):
    """An open element; ``marked`` numbers one that only its words mark, ``soft`` says that it is one of prose."""

    tag: str
    dropped: bool
    marked: int
    soft: bool
    article: int
    holder: bool
    prose: bool


def marks_of(attributes: str) -> tuple[set[str], bool]:
    """(words of class, id, role and itemprop, whether the element is hidden)."""
    words, hidden = set(), False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role", "itemprop"):
            words.update(re.split(r"[^a-z0-9]+", value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return words, hidden


def lines_of(html: str) -> list[Line]:
    """The blocks of a page in order.

    Words that mark an element drop it, but for the page's articles and what stands around them; marked prose inside an article
    is left open.
    """
    lines: list[Line] = []
    buffer: list[str] = []
    stack: list[Open] = []
    articles, marked, at, n = 0, 0, 0, len(html)
    unended: set[str] = set()
    around: set[int] = set()

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            lines.append(Line(text, any(x.dropped for x in stack), [(x.marked, x.soft) for x in stack if x.marked], [x.article for x in stack if x.article], any(x.holder for x in stack), any(x.prose for x in stack)))

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            buffer.append(html[at:])
            break
        buffer.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            continue
        if tag in RAW:
            if tag == "svg" and m[3].endswith("/") and not VALUE.search(m[3]) or tag in unended:
                continue
            end = ENDS[tag].search(html, at) or (BODY.search(html, at) if tag == "head" else None)
            if end:
                at = end.start()
            elif tag in UNENDED:
                at = n
            else:
                unended.add(tag)
            continue
        if tag not in BLOCKS:
            if tag == "br" or tag == "img":
                buffer.append(" ")
            continue
        flush()
        if stack and stack[-1].tag == "p":
            stack.pop()
        for same in CLOSES.get(tag, "").split():
            if stack and stack[-1].tag == same:
                stack.pop()
        if tag in VOID:
            continue
        words, hidden = marks_of(m[3]) if m[3] else (set(), False)
        within = any(x.article for x in stack)
        inside = within or any(x.holder for x in stack)
        number = 0
        if tag == "article":
            articles += 1
            number = articles
            if not within:
                around.update(x.marked for x in stack)
            words &= REPLIES if within else frozenset()
        says = bool(words & MARKS) and tag not in ("html", "body", "main")
        marked += says
        dropped = hidden or tag in DROPPED or (tag == "header" or "header" in words and tag == "div") and not inside
        stack.append(Open(tag, dropped, marked if says else 0, within and tag in PROSE, number, tag == "main" or bool(words & HOLDERS) and tag not in ("html", "body"), tag in PROSE))
    flush()
    for x in lines:
        left = [soft for i, soft in x.marked if i not in around]
        x.dropped = x.dropped or not all(left)
        x.prose = x.prose and not left
    return lines


KEEP, DROP, OPEN = 1, 0, 2


def states(lines: list[Line]) -> list[int]:
    """KEEP, DROP or OPEN for each line; the article with most text is the page's."""
    length: dict[int, int] = {}
    for x in lines:
        if not x.dropped and x.articles:
            length[x.articles[0]] = length.get(x.articles[0], 0) + len(x.text)
    best = max(length, key=lambda a: (length[a], -a), default=0)
    holder = not best and any(x.holder and not x.dropped for x in lines)
    out = []
    for x in lines:
        inside = best in x.articles if best else x.holder if holder else True
        out.append(DROP if x.dropped or not inside else KEEP if (best or holder) and x.prose else OPEN)
    return out


#: Matching places up to which runs over them are kept; beyond, rows of bits take their place. Both are exact.
MATCHES = 200_000


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    if sum(len(places.get(x, ())) for x in a) > MATCHES:
        return shared_bits(a, b, places)
    # Longest increasing run over matching places; those of a repeated line in falling order, so that one serves each of ``a``.
    tails: list[int] = []
    links: list[tuple[int, object]] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def shared_bits(a: list[int], b: list[int], places: dict[int, list[int]]) -> set[int]:
    """As ``shared``, a row of bits for each line of ``a``: a bit of ``b`` is 0 where the length rises.

    Every so many rows one is kept; those between are made again when the way back comes to them, so rows held grow as the root of ``a``.
    """
    n, every = len(b), isqrt(len(a)) + 1
    full = (1 << n) - 1
    masks = {x: sum(1 << j for j in js) for x, js in places.items() if len(js) < 64}
    for x, js in places.items():
        if x not in masks:
            bits = bytearray(n // 8 + 1)
            for j in js:
                bits[j >> 3] |= 1 << (j & 7)
            masks[x] = int.from_bytes(bits, "little")

    def after(v: int, x: int) -> int:
        u = v & masks.get(x, 0)
        return ((v + u) | (v - u)) & full

    kept, v = [full], full  # kept[k] is the row before line k * every
    for i, x in enumerate(a, 1):
        v = after(v, x)
        if i % every == 0:
            kept.append(v)
    out, j = set(), n - 1
    for k in range(len(kept) - 1, -1, -1):
        part = a[k * every : (k + 1) * every]
        rows = [kept[k]]
        for x in part:
            rows.append(after(rows[-1], x))
        i = len(part)  # rows[i] is the row behind line k * every + i - 1
        while i > 0 and j >= 0:
            if rows[i] >> j & 1:  # no rise at j: the length up to j is that up to j - 1
                j -= 1
            elif not rows[i - 1] >> j & 1:  # the line before has the rise already
                i -= 1
            else:
                out.add(k * every + i - 1)
                i -= 1
                j -= 1
    return out


def deletions(own: list[int], marks: list[int], other: list[int]) -> list[int]:
    """Indexes of open lines of a page that it shares with ``other``; none if all open lines would go."""
    found = shared(own, other)
    gone = [m for i, m in enumerate(marks) if m >= 0 and i in found]
    return gone if len(gone) < sum(m >= 0 for m in marks) else []


def prefix(a: str, b: str) -> int:
    """Leading path segments in common, then characters."""
    x, y = a.split("/"), b.split("/")
    k = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    if k == min(len(x), len(y)):
        return k * 1000
    p, q = x[k], y[k]
    return k * 1000 + min(999, next((i for i, (c, d) in enumerate(zip(p, q, strict=False)) if c != d), min(len(p), len(q))))


def render(html: str | None, gone: list[int] | None) -> str:
    if not html:
        return ""
    lines = lines_of(html)
    drop = set(gone or ())
    return "\n".join(x.text for i, (x, s) in enumerate(zip(lines, states(lines), strict=True)) if s == KEEP or s == OPEN and i not in drop)


EDGE = "host string, path string, page_id string, k1 long, k2 long, own array<long>, marks array<int>, need boolean"


def neighbours(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    """(k1, k2, gone, edge) for pages in order: the open lines that a page loses to its nearer neighbour, where any.

    Without ``ends`` the first and the last page of the batches have neighbours elsewhere. They come as ``edge``, with ``need`` if
    undecided, along with the pages next to them.
    """
    done: list[tuple] = []
    edges: list[tuple] = []

    def judged(before, x, behind) -> list[int]:
        near = [y for y in (behind, before) if y and y["host"] == x["host"]]
        y = max(near, key=lambda y: prefix(x["path"], y["path"]), default=None)
        return deletions(x["own"], x["marks"], y["own"]) if y else []

    def edge(x, need: bool) -> None:
        if all((y["k1"], y["k2"]) != (x["k1"], x["k2"]) for _, y in edges):
            edges.append(([], x | {"need": need}))

    def batch() -> pa.RecordBatch:
        rows = [(k1, k2, g, None) for k1, k2, g in done] + [(x["k1"], x["k2"], g, x) for g, x in edges]
        kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("own", pa.list_(pa.int64())), ("marks", pa.list_(pa.int32())), ("need", pa.bool_())])
        types = {"k1": pa.int64(), "k2": pa.int64(), "gone": pa.list_(pa.int32()), "edge": kind}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))

    two = one = None
    place = 0
    for x in (row for b in batches for row in b.to_pylist()):
        if one is not None:
            if two or ends:
                if gone := judged(two, one, x):
                    done.append((one["k1"], one["k2"], gone))
                if place == 2 and not ends:
                    edge(one, False)
            else:
                edge(one, True)
        two, one, place = one, x, place + 1
        if len(done) > 20_000:
            yield batch()
            done.clear()
            edges.clear()
    if one is not None:
        if ends:
            if gone := judged(two, one, None):
                done.append((one["k1"], one["k2"], gone))
        else:
            edge(one, True)
            if two:
                edge(two, False)
    yield batch()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; text is empty for null, empty or articleless html.

    Pages without a URL or host form one group in order of page_id; repeated rows have one pairing.
    Neighbours come from a range-sorted shuffle of line hashes alone; the few rows at range borders
    are paired in a second step, so no host is handled in one task. Pages are written where they are read, while
    at most ``common.LISTED`` of them lose a line to a neighbour; beyond that each page is shuffled once.
    """
    html = F.col("html").cast("string")
    k1, k2 = identity(F.col("page_id").cast("string"), F.col("url").cast("string"), html)
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), k1.alias("k1"), k2.alias("k2"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^?#]*)", 1), F.lit(""))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            own, marks = [], []
            for x in batch.column(5):
                lines = lines_of(x.as_py() or "")
                rest = [(i, a, s) for i, (a, s) in enumerate(zip(lines, states(lines), strict=True)) if s != KEEP]
                own.append([xxh64_intdigest(a.text.encode("utf-8", "surrogatepass")) - (1 << 63) for _, a, _ in rest])
                marks.append([i if s == OPEN else -1 for i, _, s in rest])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int32()))], [*order, "own", "marks"])

    order = ["host", "path", "page_id", "k1", "k2"]
    schema = EDGE.removesuffix(", need boolean")
    outlined = base.select(host.alias("host"), path.alias("path"), F.col("page_id").cast("string").alias("page_id"), "k1", "k2", "html")
    outlined = in_python(outlined, outline, schema)
    outlined = outlined.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("host", "path", "page_id", "own", "marks")]).select(*order, "own", "marks")
    ranged = outlined.repartitionByRange(partitions(pages.sparkSession), *order).sortWithinPartitions(*order)
    spec = f"k1 long, k2 long, gone array<int>, edge struct<{EDGE.replace(' ', ':').replace(',:', ',')}>"
    first = cut(ranged.mapInArrow(lambda b: neighbours(b, False), spec))
    # At most four rows a range.
    borders = first.where("edge is not null").select("edge.*").repartition(1).sortWithinPartitions(*order)
    second = borders.select(*order, "own", "marks").mapInArrow(lambda b: neighbours(b, True), spec).select("k1", "k2", "gone")
    needed = first.where("edge.need").select("k1", "k2")
    gone = cut(first.where("edge is null").select("k1", "k2", "gone").union(second.join(needed, ["k1", "k2"], "left_semi")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(h, g) for h, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    side = F.broadcast(gone) if gone.count() <= LISTED else gone
    joined = base.join(side, ["k1", "k2"], "left").select("page_id", "url", "html", "gone")
    kind = pages.schema["page_id"].dataType.simpleString()
    return in_python(joined, write, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
