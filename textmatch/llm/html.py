"""Main text of web pages by tag-path ratios.

Every block of text has the path of tags from the root to it. For each path of a page, text length and punctuation are summed and divided by its
number of blocks; both ratios are smoothed over neighbouring paths in page order and fused by their product, and paths at or above a share of the page's
mean score are content. The article is the smallest element of two blocks or more that holds most of the content text and splits no content path:
all its blocks are kept in page order, so a heading or a one-word paragraph is not lost. Where that is the whole page, what comes before the first and after the
last content block is kept only if it is prose (heading, paragraph, list item, cell, ...) and not mostly links.

Tags, roles, class names and ids never choose; they only exclude furniture: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments. (A header inside an article or main element is no furniture.)

One page is one row: no shuffle, and memory is that of a batch of pages. A path is a number (that of its parent and a tag), and what an element needs to
know of those around it is handed down, so time and memory grow with the length of a page, however deep it is. Malformed markup never fails: stray end
tags are dropped, open elements end with what encloses them, an unfinished tag at the end is dropped, a lone "<" is text.

Nulls: a null html is empty and gives the empty text. Rows that repeat are extracted alike. No rows give no rows. Of equally long content blocks the first
leads to the article. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, read

THRESHOLD = 0.5
#: Least share of the content text that the article holds.
SHARE = 0.9

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|textarea|title|noscript|xmp|iframe|noembed|noframes)(?=[\s/>])(?P<rawattrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never the article's.
FURNITURE = frozenset("nav aside footer form menu dialog button select option datalist template svg math canvas audio video object applet head search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form status toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert disclaimer "
    "comment comments commentlist disqus respond replies sidebar side rail aside menu menus nav navbar navigation breadcrumb breadcrumbs topbar header masthead footer foot related recommended recommendations "
    "share sharing social subscribe subscription newsletter signup login popup modal overlay widget widgets pagination pager toolbar copyright".split()
)
#: Blocks that belong to a page's text even at its edges.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p li dt dd blockquote pre figcaption caption summary td th".split())
#: Groups of tags that a start tag looks for among the open elements, and the tags behind which it does not look.
_GROUPS = (
    ("p", {"p"}, frozenset("article aside blockquote body button caption dd details dialog div dl fieldset figure footer form header html li main nav object ol section table td th ul".split())),
    ("li", {"li"}, {"ul", "ol", "menu"}), ("dt", {"dt", "dd"}, {"dl"}), ("tr", {"tr"}, {"table"}), ("td", {"td", "th"}, {"table", "tr"}), ("option", {"option"}, {"select"}),
    ("part", {"thead", "tbody", "tfoot"}, {"table"}), ("head", {"head"}, set()),
)
_GROUP = {name: k for k, (name, _, _) in enumerate(_GROUPS)}
#: What a start tag closes, outermost first.
_CLOSES = {"li": ("li",), "dt": ("dt",), "dd": ("dt",), "tr": ("tr",), "td": ("td",), "th": ("td",), "option": ("option",), "thead": ("part", "tr"), "tbody": ("part", "tr"), "tfoot": ("part", "tr"), "body": ("head",)}
_NEVER_P = frozenset("caption tbody td tfoot th thead tr option optgroup html body head legend".split())
#: For a tag that is in or bounds groups: what becomes of each group below it (True: the element itself, False: nothing, None: as above).
_BELOW = {tag: tuple(True if tag in has else False if tag in stop else None for _, has, stop in _GROUPS) for _, has_, stop_ in _GROUPS for tag in {*has_, *stop_}}


class _Element:
    __slots__ = ("tag", "parent", "skip", "path", "main", "link", "block", "open", "first", "end")

    def __init__(self, tag: str, parent: _Element | None, path: int, skip: bool, main: bool, first: int):
        self.tag, self.parent, self.path, self.skip, self.main = tag, parent, path, skip, main
        self.first = self.end = first  # numbers of the first block inside and of the one behind
        self.link = tag == "a" or bool(parent and parent.link)
        self.block = tag if tag in BLOCK or not parent else parent.block
        below = _BELOW.get(tag)
        above = parent.open if parent else (None,) * len(_GROUPS)
        self.open = above if below is None else tuple(a if b is None else self if b else None for a, b in zip(above, below, strict=True))


class Block:
    """A run of text between block boundaries: its element, path, tag of the block element, and characters in links."""

    __slots__ = ("element", "text", "linked")

    def __init__(self, element: _Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def _furniture(tag: str, attrs: str, parent: _Element) -> bool:
    if tag in FURNITURE or tag == "header" and not parent.main:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("hidden", "inert"):
            return True
        value = unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in ROLES or name == "aria-hidden" and value.strip() == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and tag not in ("article", "main") and not NAMES.isdisjoint(_WORDS.findall(value)):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """Blocks of a page that hold more than white space, in page order, without those of furniture."""
    paths: dict[tuple[int, str], int] = {}
    depth: dict[str, int] = {}  # open elements by tag
    root = _Element("", None, 0, False, False, 0)
    at, found, run, owner, linked = root, [], [], root, 0

    def flush() -> None:
        nonlocal run, linked
        if run:
            if text := _SPACE.sub(" ", unescape("".join(run))).strip():
                found.append(Block(owner, text, linked))
            run, linked = [], 0

    def leave(to: _Element) -> None:
        """Ends the open elements down to and with to."""
        nonlocal at
        while True:
            x = at
            if x.tag in BLOCK:
                flush()
            x.end = len(found) + bool(run)
            depth[x.tag] -= 1
            at = x.parent
            if x is to:
                return

    for m in _TOKEN.finditer(html):
        kind = m.lastgroup
        if kind == "text":
            if not at.skip:
                if not run:
                    owner = at
                run.append(m[0])
                if at.link:
                    linked += len(m[0])
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if depth.get(tag):
                x = at
                while x.tag != tag:
                    x = x.parent
                leave(x)
            elif tag in BLOCK:
                flush()
            elif tag == "br" and run:
                run.append(" ")
            continue
        if m["tag2"] and not m[0].endswith(">"):
            continue
        if tag in BLOCK:
            if tag not in _NEVER_P and (x := at.open[0]):
                leave(x)
            for group in _CLOSES.get(tag, ()):
                if x := at.open[_GROUP[group]]:
                    leave(x)
            flush()
        if tag in VOID:
            if run:
                run.append(" " if tag == "br" else "")
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        skip = at.skip or _furniture(tag, attrs, at)
        if skip and not at.skip and tag not in BLOCK and run:
            run.append(" ")
        inside = at.main or tag in ("article", "main") or 'role="main"' in attrs
        if not (attrs.endswith("/") and tag in ("svg", "path", "circle", "rect", "use")):
            at = _Element(tag, at, paths.setdefault((at.path, tag), len(paths) + 1), skip, inside, len(found))
            depth[tag] = depth.get(tag, 0) + 1
    flush()
    while at is not None:
        at.end, at = len(found), at.parent
    return found


def scores(found: list[Block]) -> dict[int, float]:
    """The fused, smoothed ratios of each path."""
    sums: dict[int, list[int]] = {}
    for b in found:
        s = sums.setdefault(b.element.path, [0, 0, 0])
        s[0] += len(b.text)
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += 1
    ratios = [(s[0] / s[2], s[1] / s[2] + 0.1) for s in sums.values()]  # in page order

    def smooth(k: int, of: int) -> float:
        near = [(w, ratios[j][of]) for j, w in ((k - 1, 1), (k, 4), (k + 1, 1)) if 0 <= j < len(ratios)]
        return sum(w * r for w, r in near) / sum(w for w, _ in near)

    return {path: smooth(k, 0) * smooth(k, 1) for k, path in enumerate(sums)}


def content_paths(found: list[Block]) -> set[int]:
    """Paths whose score reaches THRESHOLD times the mean."""
    of = scores(found)
    least = THRESHOLD * sum(of.values()) / len(of)
    return {path for path, score in of.items() if score >= least}


def _article(found: list[Block], content: list[bool]) -> _Element:
    """The smallest element of two blocks or more (else the root) that holds SHARE of the content text and all blocks of each content path in it."""
    mass, first, last = [0], {}, {}
    for k, b in enumerate(found):
        mass.append(mass[-1] + (len(b.text) if content[k] else 0))
        if content[k]:
            first.setdefault(b.element.path, k)
            last[b.element.path] = k
    at = max((k for k in range(len(found)) if content[k]), key=lambda k: len(found[k].text))
    x, lo, hi, least, most = found[at].element, at, at, at, at
    while x.parent is not None:
        for k in (*range(x.first, lo), *range(hi, x.end)):  # blocks that the step up has added
            if content[k]:
                least, most = min(least, first[found[k].element.path]), max(most, last[found[k].element.path])
        lo, hi = min(lo, x.first), max(hi, x.end)
        if x.tag in BLOCK and hi - lo > 1 and least >= lo and most < hi and mass[hi] - mass[lo] >= SHARE * mass[-1]:
            return x
        x = x.parent
    return x


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    chosen = content_paths(found)
    content = [b.element.path in chosen for b in found]
    article = _article(found, content)
    lo, hi = article.first, article.end
    kept = found[lo:hi]
    if article.tag in ("", "html", "body"):
        start, stop = content.index(True), len(found) - content[::-1].index(True)
        kept = [b for k, b in enumerate(kept, lo) if start <= k < stop or b.element.block in PROSE and 2 * b.linked < len(b.text)]
    return "\n\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_map(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
