"""Main text of web pages by site template removal.

Every element of a page that holds text is hashed with all that is in it.  Spark counts, per
host, on how many different pages each subtree occurs, and subtrees that recur on many
pages of their host are deleted as template.  Copies of one page say nothing about a template, so
support is counted in distinct pages, by a hash of all blocks in order.  On a page without an article or
main element the evidence has to be stronger than beside one, and stronger still inside.  What the counts can't know, on a host with
few pages, a rule by tag, role and class removes: menus, page headers and footers, sidebars, notices,
adverts, forms and reader comments.

Pages are parsed twice, once to count and once to cut, so no text is shuffled or stored: only
(host, page hash, subtree hash) is.  A hash can pass the share test only in proportion to a page's elements,
so the templates of a host are few however many pages it has.  The table of templates is broadcast up to
``BROADCAST_TEMPLATES`` hashes; a larger one is joined by host, where a hot host's pages are
split by adaptive execution.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import partial
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.url_reputation import split_url
from roamframe.plans.scratch import cut
from roamframe.plans.workers import prepared

#: Distinct pages and share of the host's distinct pages from which a subtree is template:
#: beside an article, on a page that has none, and inside an article.
BESIDE, ALONE, INSIDE = (4, 0.05), (4, 0.3), (12, 0.6)

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|title|textarea|iframe"
#: Dropped up to their end tag, but by their own tag alone if self-closed or never closed.
EMBEDDED = frozenset("template svg object select canvas audio video".split())
#: What may stand in a head; any other element, and text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes".split())
NEVER = frozenset("nav footer aside form button head dialog menu fieldset label".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("ul ol dl table article section div body main blockquote".split())
_JUNK_WORDS = "ad|ads|adv|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|replies|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar"
#: Such a word in a class or id makes an element junk; an article or main element only if it is a whole name.
JUNK, WHOLE_JUNK = re.compile(rf"(?:^|[\s_-])(?:{_JUNK_WORDS})(?:$|[\s_-])", re.I), re.compile(rf"(?:^|\s)(?:{_JUNK_WORDS})(?:$|\s)", re.I)
#: Holds reader comments, articles among them.
REMARKS = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|replies)(?:$|[\s_-])", re.I)
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in EMBEDDED}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Template hashes that are broadcast, 8 bytes each; a larger table is joined.
BROADCAST_TEMPLATES = 1 << 21


class Block(NamedTuple):
    text: str
    inside: bool  # in an article or main element
    junk: bool  # by tag, role or class


class Page(NamedTuple):
    """Blocks in page order, and the subtrees around them: hash, first block, end."""

    blocks: list[Block]
    subtrees: list[tuple[int, int, int]]


class _Element:
    __slots__ = ("first", "junk", "loose", "parts", "root", "tag")

    def __init__(self, tag: str, first: int, names: str, root: bool, junk: bool, loose: bool):
        self.tag, self.first, self.parts = tag, first, [f"<{tag}{names}>"]
        self.root, self.junk = root, junk
        self.loose = loose  # junk by a class word alone, which an article inside disproves


class _Parser:
    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.open_tags: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.text: list[str] = []
        self.junk = self.hidden = self.root = 0  # open elements that are junk blocks, junk inside a block, roots

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.blocks.append(Block(text, self.root > 0, self.junk > 0))
            if self.stack:
                self.stack[-1].parts.append(text)

    def end_head(self) -> None:
        if self.open_tags["head"]:
            self.close_within({"head"}, frozenset())

    def open(self, tag: str, attributes: str) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCK:
            self.flush()
        if tag in CLOSES_P:
            self.close_within({"p"}, LIMITS - {"div"})
        if tag in SIBLINGS:
            self.close_within(SIBLINGS[tag], LIMITS)
        if tag in VOID:
            self.text.append(" ")
            return
        names, role, hidden = "", "", False
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value, name = "".join(values), name.lower()
                if name in ("class", "id"):
                    names += " " + value
                elif name == "role":
                    role = value.lower()
                elif name == "hidden":
                    hidden = True
                elif name == "aria-hidden":
                    hidden = hidden or value.lower() == "true"
        root = tag in ("article", "main") or role == "main"
        firm = tag in NEVER or hidden or role in _JUNK_ROLES or (tag == "header" and not self.root)
        loose = tag not in ("html", "body") and bool((WHOLE_JUNK if root else JUNK).search(names))
        if root and not firm and not loose:
            for above in self.stack:
                if above.loose:
                    above.junk = above.loose = False
                    self.count(above.tag, -1)
        element = _Element(tag, len(self.blocks), names, False, firm or loose, loose and not firm and not REMARKS.search(names))
        element.root = root and not element.junk and not self.junk
        if element.junk:
            self.count(tag, 1)
        self.root += element.root
        self.open_tags[tag] += 1
        self.stack.append(element)

    def count(self, tag: str, by: int) -> None:
        if tag in BLOCK or tag in NEVER:
            self.junk += by
        else:
            self.hidden += by

    def pop(self, inline: bool = False) -> None:
        """Close the innermost element; ``inline`` leaves its block open."""
        if not inline:
            self.flush()
        element = self.stack.pop()
        self.open_tags[element.tag] -= 1
        if element.junk:
            self.count(element.tag, -1)
        self.root -= element.root
        apart = element.junk or element.root
        if element.tag in BLOCK and element.tag not in ("html", "body") and not element.root and len(self.blocks) > element.first:
            digest = xxhash.xxh64_intdigest("\x1f".join(element.parts)) - 2**63
            self.subtrees.append((digest, element.first, len(self.blocks)))
            if self.stack and not apart:
                self.stack[-1].parts.append(str(digest))
        elif self.stack and not apart:
            self.stack[-1].parts.extend(element.parts)

    def close_within(self, tags: set[str], limits: frozenset[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``limits`` is nearer."""
        if not any(self.open_tags[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k].tag
            if tag in tags:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in limits:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.open_tags[tag]:
            return
        inline = tag not in BLOCK
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self.pop(inline)
                return
            if inline and self.stack[k].tag in BLOCK:
                return


def parse_page(html: str | None) -> Page:
    """Blocks and subtrees of a page; null counts as empty."""
    page = _Parser()
    html = html or ""
    at = 0
    unclosed: set[str] = set()  # embedded elements without an end tag in the rest of the page
    while True:
        token = _TOKEN.search(html, at)
        text = html[at : token.start() if token else len(html)]
        if page.stack and page.stack[-1].tag == "head" and text.strip():
            page.end_head()
        if text and not page.hidden:
            page.text.append(unescape(text))
        if token is None:
            break
        at = token.end()
        raw, slash, tag, attributes, slash2, tag2, attributes2 = token.groups()
        tag = (tag or tag2 or "").lower()
        attributes = attributes or attributes2 or ""
        if tag in EMBEDDED:
            if not (slash or slash2 or attributes.endswith("/") or tag in unclosed):
                end = _END[tag].search(html, at)
                at = end.end() if end else at
                if end is None:
                    unclosed.add(tag)
        elif tag == "math" and attributes.endswith("/"):
            continue
        elif tag and (slash or slash2):
            page.close(tag)
        elif tag:
            page.open(tag, attributes)
    while page.stack:
        page.pop()
    page.flush()
    return Page(page.blocks, page.subtrees)


def page_text(page: Page, beside: Container[int], alone: Container[int], inside: Container[int]) -> tuple[str, int]:
    """What stays of a page without the template subtrees and the junk, and how many blocks the templates took."""
    outside = beside if any(b.inside for b in page.blocks) else alone
    gone = np.zeros(len(page.blocks) + 1, dtype=np.int64)
    for digest, first, end in page.subtrees:
        # a subtree inside an article has no block outside it
        if digest in (inside if page.blocks[first].inside and page.blocks[end - 1].inside else outside):
            gone[first] += 1
            gone[end] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return "\n".join(b.text for b, g in zip(page.blocks, gone, strict=True) if not g and not b.junk), int(gone.sum())


def _host_hash(host: str, digest: int) -> int:
    return xxhash.xxh64_intdigest(host.encode(), seed=digest & 0xFFFFFFFFFFFFFFFF) - 2**63


_SUPPORT = pa.schema([("host", pa.string()), ("page", pa.int64()), ("h", pa.int64())])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, hash of the page's blocks, and each different subtree; a null one stands for the page itself."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            hosts, pages, found = [], [], []
            for host, html in zip(part.column("host").to_pylist(), part.column("html"), strict=True):
                page = parse_page(html.as_py())
                digests = {d for d, _, _ in page.subtrees}
                whole = xxhash.xxh64_intdigest("\x1f".join(b.text for b in page.blocks)) - 2**63
                hosts += [host] * (len(digests) + 1)
                pages += [whole] * (len(digests) + 1)
                found += [None, *digests]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(found, pa.int64())], schema=_SUPPORT)


def host_templates(rows: DataFrame) -> DataFrame:
    """(host, h, grade): subtree hashes that are template beside an article, by grade 1 also without one, by 2 also inside one."""
    seen = prepared(rows.select("host", "html")).mapInArrow(_subtrees, "host string, page bigint, h bigint").distinct()
    support = seen.groupBy("host", "h").agg(F.count("*").alias("n"))
    support = cut(support.filter(f"n >= {BESIDE[0]}"))  # of a host with fewer pages nothing can pass
    pages = support.filter("h is null").select("host", F.col("n").alias("pages"))
    passes = [(F.col("n") >= n) & (F.col("n") >= share * F.col("pages")) for n, share in (BESIDE, ALONE, INSIDE)]
    grade = F.when(passes[2], 2).when(passes[1], 1).otherwise(0)
    return support.filter("h is not null").join(pages, "host").filter(passes[0]).select("host", "h", grade.alias("grade"))


class _Known:
    """Membership of a host's hashes in a sorted array of all hosts'."""

    def __init__(self, table: np.ndarray, host: str):
        self.table, self.host = table, host

    def __contains__(self, digest: int) -> bool:
        key = _host_hash(self.host, digest)
        at = int(np.searchsorted(self.table, key))
        return at < len(self.table) and int(self.table[at]) == key


def _extracted(batches: Iterator[pa.RecordBatch], known: Broadcast | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts, counts = [], []
            for row, html in enumerate(part.column("html")):
                if known is None:
                    known_here = [frozenset(part.column(f"grade{g}")[row].as_py() or ()) for g in range(3)]
                else:
                    host = part.column("host")[row].as_py()
                    known_here = [_Known(t, host) for t in known.value]
                text, n = page_text(parse_page(html.as_py()), *known_here)
                texts.append(text), counts.append(n)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_template"])


def extract_main_text(pages: DataFrame, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """``page_id, url, text, n_chars, n_template`` of every row of ``pages``.

    Blocks are joined in page order by a line feed; null, empty and text-free pages give an
    empty text.  A null url counts as one host of its own.  Repeated rows get a row each, other
    columns are ignored, and an empty table gives none.  ``n_template`` counts the blocks in
    recurring subtrees, whether or not the tag rule takes them too.
    """
    host, _ = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.coalesce(host, F.lit("")).alias("host"))
    templates = cut(host_templates(rows))
    fields = "page_id bigint, url string, text string, n_template bigint"
    if templates.count() <= broadcast_templates:
        got = templates.toArrow()  # at most broadcast_templates rows
        keys = np.array([_host_hash(h, d) for h, d in zip(got["host"].to_pylist(), got["h"].to_pylist(), strict=True)], dtype=np.int64)
        grades = got["grade"].to_numpy()
        known = pages.sparkSession.sparkContext.broadcast([np.sort(keys[grades >= g]) for g in range(3)])
    else:
        known = None
        # by the share test a host has at most (elements of a page / share) hashes
        lists = templates.groupBy("host").agg(*(F.collect_list(F.when(F.col("grade") >= g, F.col("h"))).alias(f"grade{g}") for g in range(3)))
        rows = rows.join(lists, "host", "left")
    out = prepared(rows).mapInArrow(partial(_extracted, known=known), fields)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
