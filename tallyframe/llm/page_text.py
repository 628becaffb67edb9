"""HTML extraction by nearest-URL page differencing.

Pages of one host are ordered by URL path, equal ones as one page. Each page is aligned, line by line, with the
neighbour whose path shares more with its own, by longest common subsequence; lines both have are the site's and go,
others stay, within an article element or not. What an article element holds is the page's own even where a neighbour
quotes it, and a neighbour that is nearly a copy says nothing about the site, so then the other one is asked. Elements
that by name or class hold menus, notices, adverts, forms or comments go in any case.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import by_batch, columns, written

# Element and class names.
SKIPPED = frozenset("nav header footer aside form script style noscript template iframe object embed svg canvas button select option textarea "
                    "title head dialog menu audio video math datalist".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary "
                   "table tbody td tfoot th thead title tr ul".split())
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
                        "disclaimer disqus feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager "
                        "popup promo promotion recommended related replies respond rss search share sharing sidebar signup skip social sponsor sponsored "
                        "subscribe toolbar widget".split())
LACKING = frozenset("no not has have with without".split())
HEADERS = frozenset("header masthead topbar".split())

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none", re.I)
URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(\?[^#]*)?")

#: A neighbour that shares more than this part of a page's text, and of what its article elements hold, is its copy.
COPY = 0.8


def names_of(attributes: str) -> set[str]:
    found: set[str] = set()
    for m in NAMES.finditer(attributes):
        for name in next(x for x in m.groups() if x is not None).lower().split():
            parts = re.split(r"[^a-z0-9]+", name)
            # ``no-sidebar`` names what is not there, ``with-comments`` something beside.
            if not LACKING.intersection(parts):
                found.update(parts)
    return found


def blocks(page: str) -> list[tuple[str, bool]]:
    """The page's lines as (text, within an article), without the skipped elements: one per block with text."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    # Open elements as (name, skipped, within an article); the first one stands for the page.
    open_: list[tuple[str, bool, bool]] = [("", False, False)]

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, open_[-1][2]))
            parts.clear()

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if not open_[-1][1]:
            parts.append(page[at:m.start() if m else size])
        if not m:
            break
        at = m.end()
        if m[1] is not None and not open_[-1][1]:
            parts.append(m[1])
        if m[3] is None:
            continue
        name, attributes = m[3].lower(), m[4]
        if m[2]:
            if name in BLOCKS or name in SKIPPED:
                end_block()
            if any(o[0] == name for o in open_[1:]):
                while open_.pop()[0] != name:
                    pass
            continue
        if name == "br":
            parts.append(" ")
        if name in EMPTY:
            if name == "hr":
                end_block()
            continue
        if name in BLOCKS or name in SKIPPED:
            end_block()
        if name in CLOSED_BY_NEXT and open_[-1][0] in CLOSED_BY_NEXT and (open_[-1][0] == name or name[0] == "h" or open_[-1][0] == "p"):
            open_.pop()
        _, skipped, article = open_[-1]
        if name in ("article", "main"):
            names = names_of(attributes) if attributes else set()
            skipped = bool(names & BOILERPLATE) or (skipped and any(o[2] for o in open_))
            article = not skipped
        elif name in BLOCKS or name in SKIPPED:
            # The head of an article is part of it.
            skipped = skipped or (name in SKIPPED and not (name == "header" and article))
            if attributes and not skipped and name not in ("body", "html"):
                names = names_of(attributes)
                skipped = bool(names & BOILERPLATE) or bool(names & HEADERS and not article) or bool(HIDDEN.search(attributes))
        elif name not in SKIPPED:
            # Within a line only names that hide something matter.
            if attributes and (HIDDEN.search(attributes) or names_of(attributes) & BOILERPLATE):
                skipped = True
            else:
                continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        open_.append((name, skipped, article))
    end_block()
    return out


def page_lines(page: str) -> tuple[list[str], list[bool]]:
    """The lines that may be the article's, and which of them an article element holds."""
    found = blocks(page)
    return [t for t, _ in found], [i for _, i in found]


def common(a: list[int], b: list[int]) -> list[bool]:
    """Which items of ``a`` are in a longest common subsequence with ``b``."""
    n, m = len(a), len(b)
    keep = [False] * n
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        keep[start] = True
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        keep[n] = True
    # Lines that the other page lacks are in no common subsequence.
    there = set(b[start:m])
    x = [i for i in range(start, n) if a[i] in there]
    here = {a[i] for i in x}
    y = [v for v in b[start:m] if v in here]
    for i in _subsequence([a[i] for i in x], y):
        keep[x[i]] = True
    return keep


def _subsequence(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence, in space linear in both: the middle of ``a`` is
    aligned with every place of ``b`` from both sides, and both halves go on alone."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    bb = np.array(b, np.int64)
    while todo:
        lo, hi, s, e = todo.pop()
        if lo >= hi or s >= e:
            continue
        if hi - lo == 1:
            if (bb[s:e] == a[lo]).any():
                out.append(lo)
            continue
        mid = (lo + hi) // 2
        head = _row(a[lo:mid], bb[s:e])
        tail = _row(a[mid:hi][::-1], bb[s:e][::-1])[::-1]
        cut = s + int(np.argmax(head + tail))
        todo += [(lo, mid, s, cut), (mid, hi, cut, e)]
    return sorted(out)


def _row(a: list[int], b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` with every prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == v)))
    return row


def address(url: str) -> tuple[str, str]:
    """Host and path with query of a URL; a URL without a host has the empty one."""
    m = URL.match(url)
    return (m[1].lower(), (m[2] or "/") + (m[3] or "")) if m else ("", url.split("#")[0])


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def keep_lines(page: dict, before: dict | None, after: dict | None) -> list[bool]:
    """Which lines of a page stay, given its neighbours in path order."""
    sides = [s for s in (before, after) if s]
    sides.sort(key=lambda s: -_prefix(page["path"], s["path"]))
    for side in sides:
        shared = common(page["hashes"], side["hashes"])
        if not _copy(page["sizes"], shared) or not _copy([s * i for s, i in zip(page["sizes"], page["inside"])], shared):
            return [inside or not c for inside, c in zip(page["inside"], shared)]
    return [True] * len(page["hashes"])


def _copy(sizes: list[int], shared: list[bool]) -> bool:
    return not any(sizes) or sum(s for s, c in zip(sizes, shared) if c) > COPY * sum(sizes)


LINES = "path string, hashes array<bigint>, sizes array<int>, inside array<boolean>"


def _parsed(pages: DataFrame, light: bool) -> DataFrame:
    """Per page its key with what pairing needs (``light``) or with its lines."""
    def build():
        def run(batch):
            rows = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                lines, inside = page_lines(page or "")
                if light:
                    host, path = address(url or "")
                    rows.append((host, path, [_hash(t) for t in lines], [len(t) for t in lines], inside))
                else:
                    rows.append((lines,))
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())) if light \
                else (pa.list_(pa.string()),)
            own = ["key"] if light else ["key", "page_id", "url"]
            return pa.record_batch([*(batch.column(c) for c in own), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))],
                                   [*own, *(["host", "path", "hashes", "sizes", "inside"] if light else ["lines"])])
        return run
    return by_batch(pages, build, f"key long, host string, {LINES}" if light else
                    "key long, page_id long, url string, lines array<string>")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def neighbours(light: DataFrame) -> DataFrame:
    """Each page with the pages before and after it in its host's path order. Hosts may be of any size:
    pages are dealt out by range of (host, path), and only the outermost pages of each range are
    matched across ranges."""
    ranged = written(light.repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id()), "page-order")
    page = F.struct("path", "hashes")
    order = ["path", "key"]
    inner = Window.partitionBy("part", "host").orderBy(*order)
    near = ranged.withColumns({"before": F.lag(page).over(inner), "after": F.lead(page).over(inner)})
    outer = Window.partitionBy("host").orderBy(*order)
    edge = F.col("before").isNull() | F.col("after").isNull()
    edges = near.where(edge).withColumns({
        "before": F.coalesce("before", F.lag(page).over(outer)), "after": F.coalesce("after", F.lead(page).over(outer))})
    return near.where(~edge).unionByName(edges)


def decisions(pages: DataFrame) -> DataFrame:
    """``key`` and ``keep``, one flag per line. Equal rows share a key, and pages of a host with equal lines share a
    decision: they are one page to their neighbours, at the first of their paths."""
    light = _parsed(pages, light=True).withColumn("content", F.xxhash64("host", "hashes", "inside"))
    light = written(light.dropDuplicates(["key"]), "page-lines")
    first = light.groupBy("content").agg(F.min(F.struct("path", "key", "host", "hashes", "sizes", "inside")).alias("page"))
    near = neighbours(first.select("content", "page.*"))

    def build():
        def run(batch):
            rows = batch.select(["path", "hashes", "sizes", "inside", "before", "after"]).to_pylist()
            keep = [keep_lines(r, r["before"], r["after"]) for r in rows]
            return pa.record_batch([batch.column("content"), pa.array(keep, pa.list_(pa.bool_()))], ["content", "keep"])
        return run
    keep = by_batch(near.select("content", "path", "hashes", "sizes", "inside", "before", "after"), build,
                    "content long, keep array<boolean>")
    return light.select("key", "content").join(keep, "content").select("key", "keep")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null and empty html gives the empty text; a null ``url`` has the empty host; null ids and repeated rows stay.
    Lines are joined by two line feeds, nothing else is dropped or cut.
    """
    rows = columns(pages, page_id="bigint", url="string", html="string").withColumn("key", F.xxhash64("page_id", "url", "html"))
    keep = decisions(rows).withColumnRenamed("key", "of")
    kept = F.filter("lines", lambda x, i: F.coalesce(F.get("keep", i), F.lit(True)))
    text = F.array_join(kept, "\n\n")
    joined = _parsed(rows, light=False).join(keep, F.col("key") == F.col("of"))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
