"""Main text of web pages by tag-path ratios.

A page becomes its text blocks in page order, each with its root-to-leaf path
of block-level tags.  Blocks inside menus, site headers, footers, sidebars,
forms, scripts and styles (by tag or role) and hidden ones take no part.  An
element with a listed word in its class or id (adverts, notices, comments, ...)
is left out too unless it stands by itself: it contains a ``main``, or all
articles and a quarter of the page's text, or on a page without either
``MOST`` of it; or its own ratios overrule the word, being those of text that
isn't mostly links, of at least ``OVERRULE`` of the best path's product and of
``LEAST_INSIDE`` characters inside an article or main, ``LEAST_OUTSIDE``
elsewhere.  An ``h1`` inside an article or main is never left out for a word.

For every path the text length and the
punctuation of all its blocks are summed and divided by the number of blocks
(path ratios).  The ratios are laid along the page, smoothed with a short
Gaussian, averaged per path again and fused by their product; paths with at
least ``SHARE`` of the best path's value are content; paths whose text is
mostly links count for nothing.  Content nodes are the blocks of content
paths, on every page.

``article`` and ``main`` are a prior: where a page has them, the value of a
path outside them counts ``1 / PRIOR``.  Every outermost ``article`` or
``main`` that holds content paths keeps all its blocks, however short, but
those that are links in a path of links (headings stay).  Where
most of the content lies outside them, the smallest element below the body
that holds ``MOST`` of its text keeps each block that isn't a run of links.

Character references are decoded, white space inside a block is one space,
blocks are trimmed and joined by a line feed.  Null, empty and text-free
pages give the empty text.  Repeated pages are extracted each by itself.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import out, slices

SHARE = 0.15
SIGMA = 1.0
MOST = 0.8
#: How much more a path counts inside an article or main than outside, on pages that have one.
PRIOR = 4.0
#: From which share of the best path's ratios, and how many characters, the text of an element overrules a listed word.
OVERRULE = 0.25
LEAST_INSIDE, LEAST_OUTSIDE = 50, 200
#: Share of link text from which a path or block is links.
LINKS = 0.6

RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64())])

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody "
    "tfoot tr td th figure figcaption address details summary center hr nav header footer aside form fieldset "
    "legend menu dialog search option".split())
CLOSES_P = BLOCK - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "option", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
            "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("html body article section main div table ul ol dl td th blockquote".split())
LEFT_OUT = frozenset(
    "head nav footer aside form menu dialog search template svg math canvas object select button datalist audio video".split()) | RAW
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar footer header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist disqus respond reply replies reactions discussion guestbook widget widgets pagination pager skip "
    "adslot adbox adunit adcontainer adwrapper teaser teasers popular trending outbrain taboola alert announcement disclaimer "
    "paywall register feedback searchbox".split())
HOLDERS = frozenset("div section main article td center details dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)(?:((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>|([^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCT = re.compile(r"[.,;:!?…、。，！？¡¿—–()\"“”«»]")


def _left_out(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """(left out by tag, role or hiding; a listed word in class or id)."""
    if tag in LEFT_OUT or tag == "header" and not inside_article:
        return True, False
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, False
    listed = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "role" and value.lower() in LEFT_OUT_ROLES:
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if name in ("class", "id") and tag not in HEADINGS and any(w.lower() in LEFT_OUT_WORDS for w in _NAME.findall(value)):
            listed = True
    return False, listed


class Block(NamedTuple):
    path: str
    text: str
    box: int  # the outermost article or main, -1: none
    inside: tuple[int, ...]  # numbers of the elements around it that hold blocks, below the body
    links: float  # share of link text
    listed: tuple[int, ...] = ()  # numbers of the elements around it with a listed word


def blocks(page: str) -> list[Block]:
    """Each block outside what is left out."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, bool, int, tuple[int, ...]]] = []  # tag, left out, container, in an article's header, number, listed
    tops: list[tuple[str, tuple[int, ...]]] = []  # tag of each container, listed elements around it
    containers = elements = linked = 0
    text: list[str] = []
    at, end = 0, len(page)

    def state():
        return stack[-1][:4] if stack else ("", False, -1, False)

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            joined = " ".join(_html.unescape(raw).split())
            if joined:
                found.append(Block("/".join(x[0] for x in stack if x[0] in BLOCK), joined, state()[2],
                                   tuple(x[4] for x in stack if x[0] in HOLDERS), linked / len(raw),
                                   stack[-1][5] if stack else ()))
            text.clear()
        linked = 0

    def pop(i: int) -> None:
        if any(t in BLOCK for t, *_ in stack[i:]):
            flush()
        del stack[i:]

    def add(piece: str) -> None:
        nonlocal linked
        _, gone, _, head = state()
        if piece and not gone and not (head and not any(t in HEADINGS for t, *_ in stack)):
            text.append(piece)
            if any(t == "a" for t, *_ in stack):
                linked += len(piece)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set()) | (HEADINGS if tag in HEADINGS else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    if tag not in SIBLINGS:
                        break
                elif stack[i][0] in SCOPES:
                    break
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        attrs = m[3] if m[3] is not None else m[4] or ""
        if attrs.endswith("/") and tag in ("svg", "path", "g"):
            continue
        _, gone, box, head = state()
        listed = stack[-1][5] if stack else ()
        if tag == "body":
            gone, listed = False, ()
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        out_of_it, word = _left_out(tag, attrs, box >= 0)
        gone = gone or out_of_it
        if tag in ("article", "main") and not gone and box < 0:
            box, containers = containers, containers + 1
            tops.append((tag, listed))
        elements += 1
        if word and not gone:
            listed = (*listed, elements)
        stack.append((tag, gone, box, head or tag == "header" and box >= 0, elements, listed))
    flush()
    return _standing(found, tops)


def _ratios(found: list[Block]) -> float:
    """Product of the ratios of some blocks' text outside links, 0 if most of it is links."""
    chars = sum(len(x.text) for x in found)
    own = sum(len(x.text) * (1 - x.links) for x in found)
    if own < (1 - LINKS) * chars:
        return 0.0
    return own / len(found) * (1 + sum(len(_PUNCT.findall(x.text)) for x in found) / len(found))


def _standing(found: list[Block], tops: list[tuple[str, tuple[int, ...]]]) -> list[Block]:
    """Without the blocks of elements with a listed word that don't stand by themselves."""
    held: dict[int, list[Block]] = {}
    for x in found:
        for e in x.listed:
            held.setdefault(e, []).append(x)
    if not held:
        return found

    def chars(some: list[Block]) -> float:
        return sum(len(x.text) * (1 - x.links) for x in some)

    total = chars(found)
    stands = set()
    for e, own in held.items():
        tops_in = [t for t, around in tops if e in around]
        if ("main" in tops_in or tops_in and len(tops_in) == len(tops) and 4 * chars(own) >= total
                or not tops and chars(own) >= MOST * total):
            stands.add(e)
    paths: dict[str, list[Block]] = {}
    for x in found:
        if stands.issuperset(x.listed):
            paths.setdefault(x.path, []).append(x)
    boxed = any(x.box >= 0 for own in paths.values() for x in own)

    def value(own: list[Block]) -> float:
        return _ratios(own) / (PRIOR if boxed and own[0].box < 0 else 1.0)

    best = max(map(value, paths.values()), default=0.0)
    for e, own in held.items():
        if chars(own) >= (LEAST_INSIDE if own[0].box >= 0 else LEAST_OUTSIDE) and value(own) >= max(OVERRULE * best, 1e-9):
            stands.add(e)
    return [x for x in found if stands.issuperset(x.listed)
            or x.box >= 0 and x.path.endswith("/h1") and stands.issuperset(tops[x.box][1])]


def path_values(found: list[Block], sigma: float = SIGMA, prior: float = PRIOR) -> dict[str, float]:
    """Fused ratio of each path; paths of links have none (0)."""
    length: dict[str, float] = {}
    points: dict[str, float] = {}
    links: dict[str, float] = {}
    n: dict[str, int] = {}
    for x in found:
        length[x.path] = length.get(x.path, 0) + len(x.text)
        points[x.path] = points.get(x.path, 0) + len(_PUNCT.findall(x.text))
        links[x.path] = links.get(x.path, 0) + len(x.text) * x.links
        n[x.path] = n.get(x.path, 0) + 1
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    line = [(0.0, 0.0) if links[x.path] > LINKS * length[x.path] else (length[x.path] / n[x.path], points[x.path] / n[x.path]) for x in found]
    boxed = any(x.box >= 0 for x in found)
    fused: dict[str, float] = {}
    for i, x in enumerate(found):
        near = [(kernel[d + reach], line[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(line)]
        weight = sum(k for k, _ in near)
        r = sum(k * y[0] for k, y in near) / weight
        q = sum(k * y[1] for k, y in near) / weight
        value = r * (1 + q) / n[x.path] if line[i][0] else 0.0
        fused[x.path] = fused.get(x.path, 0) + (value / prior if boxed and x.box < 0 else value)
    return fused


def extract(page: str | None, share: float = SHARE) -> tuple[str, int]:
    """(main text, blocks)."""
    found = blocks(page or "")
    if not found:
        return "", 0
    values = path_values(found)
    best = max(values.values())
    content = [values[x.path] >= share * best for x in found]
    held: dict[int, int] = {}
    total = boxed = 0
    for x, c in zip(found, content, strict=True):
        if c:
            total += len(x.text)
            boxed += len(x.text) if x.box >= 0 else 0
            for e in x.inside:
                held[e] = held.get(e, 0) + len(x.text)
    boxes = {x.box for x, c in zip(found, content, strict=True) if c and x.box >= 0}
    near = None
    if 2 * boxed < total:
        near = max((e for e, v in held.items() if v >= MOST * total), default=None)  # the last opened is the innermost
    kept = []
    for x, c in zip(found, content, strict=True):
        if x.box in boxes:
            stays = values[x.path] > 0 or x.links <= LINKS or c or x.path.rpartition("/")[2] in HEADINGS
        else:
            stays = c if near is None else near in x.inside and x.links <= LINKS
        if stays:
            kept.append(x.text)
    return "\n".join(kept), len(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            got = [extract(h) for h in b.column(2).to_pylist()]
            yield out(RESULT, page_id=b.column(0), url=b.column(1), text=[g[0] for g in got],
                      n_chars=[len(g[0]) for g in got], n_blocks=[g[1] for g in got])

    rows = pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"cast(`{url_col}` as string) as url", f"cast(`{html_col}` as string) as html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
