"""HTML main text by tag-path ratios.

A page's text is grouped by its path of tags from the root to the innermost block (inline markup is
part of its block). Each path gets two ratios to its number of blocks: text length, where text in
links counts a quarter, and punctuation. Both are smoothed over the tree of paths, where paths that
are few steps apart lend each other weight, fused into one score and cut by a threshold. Paths
in elements marked as menus, adverts and so on score below zero. The blocks of the selected paths
are the result, with those paths that fill gaps within an element of mostly selected text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import plus, rows_of

#: Elements whose text is none of the page's.
NO_TEXT = frozenset("script style noscript template svg math head title iframe object canvas select option textarea button".split())
#: Elements that stand beside the article, and words in class, id or role that mark others as such.
SIDE = frozenset("nav header footer aside form menu dialog".split())
SIDE_WORDS = frozenset("ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu sidebar side breadcrumb breadcrumbs header footer masthead comment comments disqus reply replies respond cookie cookies consent notice notices newsletter subscribe popup modal share sharing social related recommended widget toolbar pagination pager legal copyright".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption center dialog menu".split())
#: Markup within a block, which makes no path of its own.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Opening one of the second kind ends an open one of the first.
_P_ENDS = BLOCKS - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "caption"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_LIST_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
PUNCTUATION = frozenset(".,;:!?…。，、；：！？")
#: Width of the smoothing kernel and its reach, in steps between paths.
SIGMA, REACH = 1.0, 4
KERNEL = [exp(-0.5 * (d / SIGMA) ** 2) for d in range(REACH + 1)]
#: The part of the best score from which a path is selected, and what a character in a link counts.
CUT, LINK = 0.05, 0.25


@dataclass(eq=False)
class Path:
    """A node of the tree of tag paths, with the text that ends there."""

    parent: Path | None = None
    side: bool = False
    text: bool = True
    page: bool = False
    children: dict[str, Path] = field(default_factory=dict)
    chars: float = 0.0
    plain: int = 0
    punctuation: int = 0
    blocks: set[int] = field(default_factory=set)


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    path: Path
    link: bool = False


@dataclass(eq=False)
class Node:
    """A stretch of text within one element and block."""

    element: Element
    block: int
    text: str


def _marks(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name on a path, and whether it stands beside the article."""
    if not attributes.strip():
        return tag, tag in SIDE
    got = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    words = {w for a in ("class", "id") for w in _SPLIT.split(got.get(a, "")) if w}
    hidden = "hidden" in _SPLIT.split(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes.lower())) or "display:none" in got.get("style", "").replace(" ", "") or got.get("aria-hidden") == "true"
    side = tag in SIDE or bool(words & SIDE_WORDS) or got.get("role") in SIDE_ROLES or hidden
    # an element named as the article or the page's body is not put aside by its class
    if tag in ("article", "main", "body", "html") and not hidden:
        side = False
    name = tag + "".join(f".{w}" for w in sorted(_SPLIT.split(got.get("class", ""))) if w)
    return name, side


def _opened(here: Element, tag: str, name: str, side: bool) -> Element:
    up = here.path
    if tag in INLINE and not side:
        path = up
    else:
        key = name + "!" * side
        path = up.children.get(key)
        if path is None:
            path = up.children[key] = Path(up, up.side or side, up.text and tag not in NO_TEXT, tag in ("html", "body"))
    return Element(tag, here, path, here.link or tag == "a")


def text_nodes(page: str) -> Iterator[Node]:
    """The page's text in order; what is not closed is closed by what follows, as browsers do."""
    root = Element("", None, Path(page=True))
    at, here, block = 0, root, 0
    lower = None

    def climbed(e: Element, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> Element | None:
        while e.parent is not None and e.tag not in stop:
            if e.tag in tags:
                return e
            e = e.parent
        return None

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            yield Node(here, block, page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield Node(here, block, html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if tag in BLOCKS or tag == "br":
            block += tag != "br"
        if m[1]:
            if (found := climbed(here, {tag})) is not None:
                here = found.parent
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "hr", "img", "input"):
                yield Node(here, block, " " if tag != "wbr" else "")
            continue
        if tag in ("html", "body") and climbed(here, {tag}) is not None:
            continue
        if tag in _P_ENDS and (found := climbed(here, {"p"}, {"td", "th", "button", "li", "dd", "table"})) is not None:
            # formatting elements left open in the paragraph end with it here
            here = found.parent
        if tag in _SIBLINGS and (found := climbed(here, _SIBLINGS[tag], _LIST_ENDS[tag])) is not None:
            here = found.parent
        name, side = _marks(tag, m[3].removesuffix("/"))
        here = _opened(here, tag, name, side)
        if tag in _RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else page
            end = lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
    if at < len(page):
        yield Node(here, block, page[at:])


def ratios(path: Path) -> tuple[float, float]:
    """Text length and punctuation for each block of the path."""
    n = max(len(path.blocks), 1)
    return path.chars / n, path.punctuation / n


def _smoothed(paths: list[Path]) -> list[tuple[float, float]]:
    """Both ratios' means over the paths within REACH steps, weighed by the kernel.

    Sums by how far paths end below a node of the tree are made once, so that the work is that of
    the paths and not of their pairs.
    """
    below: dict[Path, list[list[float]]] = {}
    for p in paths:
        t, u = ratios(p)
        a: Path | None = p
        for d in range(REACH + 1):
            if a is None:
                break
            sums = below.setdefault(a, [[0.0, 0.0, 0.0] for _ in range(REACH + 1)])[d]
            sums[0] += t
            sums[1] += u
            sums[2] += 1
            a = a.parent
    out = []
    for p in paths:
        t = u = n = 0.0
        a, came = p, None
        for up in range(REACH + 1):
            if a is None:
                break
            rows = below[a]
            for d in range(REACH + 1 - up):
                x, y, z = rows[d]
                if came is not None and d:
                    x, y, z = (v - w for v, w in zip((x, y, z), came[d - 1], strict=True))
                w = KERNEL[up + d]
                t, u, n = t + w * x, u + w * y, n + w * z
            a, came = a.parent, rows
        out.append((t / n, u / n))
    return out


def path_scores(paths: list[Path]) -> list[float]:
    """Fused scores: the mean of both smoothed ratios, each as a share of the largest, less by what part of the path's text is links.

    A marked path has its own ratios' mean, below zero.
    """
    open_ = [p for p in paths if not p.side]
    smooth = dict(zip(open_, _smoothed(open_), strict=True))
    pairs = [smooth.get(p) or ratios(p) for p in paths]
    most = [max((smooth[p][i] for p in open_), default=0.0) or 1.0 for i in (0, 1)]
    fused = [(t / most[0] + u / most[1]) / 2 for t, u in pairs]
    return [-f if p.side else f * p.chars / p.plain for p, f in zip(paths, fused, strict=True)]


def _filled(paths: list[Path], chosen: set[Path]) -> set[Path]:
    """Unmarked paths within elements of selected text.

    A path is taken if half or more of the text of its lowest element with selected text is
    selected; the whole page is such an element only where selected text stands directly in it. Of
    mostly links it is taken only beside selected blocks.
    """
    total: dict[Path, int] = {}
    selected: dict[Path, int] = {}
    for p in paths:
        if not p.side:
            a: Path | None = p
            while a is not None:
                total[a] = total.get(a, 0) + p.plain
                if p in chosen:
                    selected[a] = selected.get(a, 0) + p.plain
                a = a.parent
    direct = chosen | {p.parent for p in chosen}
    more = set()
    for p in paths:
        if p in chosen or p.side:
            continue
        if p.chars < p.plain / 2:
            if p.parent in direct and not p.parent.page:
                more.add(p)
            continue
        a = p
        while a.parent is not None and a not in selected:
            a = a.parent
        if a in selected and 2 * selected[a] >= total[a] and (not a.page or a in direct):
            more.add(p)
    return more


def main_text(page: str | None) -> str:
    """The article's blocks joined by two line feeds; empty if there is none."""
    nodes = [n for n in text_nodes((page or "").replace("\0", "")) if n.text and n.element.path.text]
    paths: dict[Path, None] = {}
    for n in nodes:
        n.text = html.unescape(n.text) if "&" in n.text else n.text
        if size := len(n.text.strip()):
            p = n.element.path
            paths[p] = None
            p.blocks.add(n.block)
            p.plain += size
            p.chars += size * LINK if n.element.link else size
            p.punctuation += sum(map(n.text.count, PUNCTUATION))
    ordered = list(paths)
    scores = path_scores(ordered)
    least = CUT * max(scores, default=0.0)
    chosen = {p for p, s in zip(ordered, scores, strict=True) if s > 0 and s >= least}
    chosen |= _filled(ordered, chosen)
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if n.element.path in chosen:
            blocks.setdefault(n.block, []).append(n.text)
    joined = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """The input's rows and columns plus text and n_chars; columns of these names are replaced.

    Null or textless html, and a page of marked elements only, have an empty text. Each row is read
    by itself and whole, so that repeated rows have equal texts and a page of any length is one
    task's row; no rows give none.
    """
    pages = pages.drop(*({"text", "n_chars"} - {column}))

    def run(batches):
        for part, (found,) in rows_of(batches, column):
            texts = [main_text(x) for x in found]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, plus(plus(pages.schema, "text", T.StringType()), "n_chars", T.LongType()))


def extraction_digest(pages: DataFrame) -> DataFrame:
    """The query's rows: page_id, url, text, n_chars."""
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
