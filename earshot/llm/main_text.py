"""Main text of web pages by tag-path ratios.

A page is read into blocks, each with its path of tags and classes from the root.  Text length and
punctuation are summed over the blocks of a path and divided by their number; both series are smoothed
over neighbouring paths in page order and fused with the share of text outside links.  Paths above a
fraction of the best fused ratio are content.  The content region is the deepest element that holds all
of their blocks, or the article or main around it.  Of an article or main all blocks are the result, so
that a short heading, a list of links or a lesser section stays.  Of another region, the children that
hold a chosen path are kept whole; a child without one is kept between them unless it is links only, and
headings just before the first are kept; what else stands before or after them is dropped.  Menus, headers outside an article, footers, asides, forms, notices, adverts and reader
comments, known by tag, role or class, are never part of it.  A form, role or class only hints: it does not
take out an article or main, nor what wraps them or nearly all of the page's text.

Defined results: null and empty pages, and pages without text, give an empty string; a page of nothing
but links gives their text.  Tags are closed
where HTML implies it; unknown end tags are ignored; a comment or script that never ends takes the rest
of the page.  Repeated rows are read one by one and other columns stay as they are.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from earshot.llm.common import annotated

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|(?P<text>[^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
# fixed values: tag names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe svg math canvas object select textarea button title head".split())
RAW = frozenset("script style textarea title noscript iframe template select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "body": ("head",),
}
LIMITS = frozenset("ul ol dl table div section article td th body blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FURNITURE = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer comment comments disqus respond cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share"
    " sharing social related recommended widget toolbar pagination pager login signup".split()
)
HEADER_HINTS = frozenset("header masthead topbar banner".split())
COMMENT_HINTS = frozenset("comment comments disqus respond".split())
#: Last parts of a class that say how a hint before them is laid out, and first parts that say what an element has or lacks.
LAYOUT = frozenset(
    "area bar block box button buttons column container content group holder inner item items left link links list outer panel right row section"
    " slot top bottom wrap wrapper unit".split()
)
ABOUT = frozenset("has no not with without hide show".split())
#: An element with this part of a page's text wraps the page.
WRAPS = 0.8


@dataclass(slots=True)
class Element:
    """An open element.  Ancestors are links, so that a page may be nested as deep as it likes."""

    number: int
    tag: str
    path: int
    out: bool
    link: bool
    block: Element | None  # the block element it is, or is in
    up: Element | None  # the block element around that
    depth: int  # block elements around it
    holds_blocks: bool = False
    hint: str = ""
    hinted: Element | None = None  # the nearest element with a hint, itself included
    outer: Element | None = None  # the element with a hint around a hinted one
    around: int = 0  # articles and mains around it
    in_article: bool = False
    size: int = 0  # of a hinted element: text inside it, and articles and mains
    anchors: int = 0
    gone: bool = False


@dataclass(slots=True)
class Block:
    path: int
    place: Element
    parts: list[tuple[str, bool, Element | None]] = field(default_factory=list)  # text, whether linked, the nearest element with a hint
    linked: int = 0
    text: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _hints(names: str) -> set[str]:
    """Words of classes and ids that may be hints: each whole token, and its last part that is not layout."""
    found = set()
    for token in names.split():
        parts = [x.lower() for x in HINT.findall(token) if len(x) > 1]
        found.add(token.lower())
        if not ABOUT & set(parts):
            while len(parts) > 1 and parts[-1] in LAYOUT:
                parts.pop()
            found.update(parts[-1:])
    return found


def _is_furniture(tag: str, raw: str, in_article: bool) -> tuple[bool, str, str]:
    """Whether an element is page furniture, its kind of hint (empty for none), and its class as part of the path."""
    if tag in FURNITURE or tag in SKIPPED or (tag == "header" and not in_article):
        return True, "", ""
    hint = "form" if tag == "form" else ""
    if not raw.strip():
        return False, hint, ""
    attrs = _attributes(raw)
    label = ".".join(sorted(attrs.get("class", "").split()))
    if tag in ("html", "body"):
        return False, "", label
    hints = _hints(f"{attrs.get('class', '')} {attrs.get('id', '')}")
    hidden = "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None
    if hints & COMMENT_HINTS:
        hint = "comment"
    elif attrs.get("role", "").lower() in ROLES or hints & HINTS or (not in_article and hints & HEADER_HINTS):
        hint = hint or "class"
    return hidden, hint, label


def _take_out(hinted: list[Element], anchors: list[Element], found: list[Block]) -> None:
    """Mark the elements that their hints take out.  Wrappers of the page or its article stay."""
    total = 0
    for text, _, around in (part for b in found for part in b.parts):
        total += len(text.strip())
        if around:
            around.size += len(text.strip())
    for a in anchors:
        if a.hinted:
            a.hinted.anchors += 1
    for e in reversed(hinted):  # inner ones first
        if e.outer:
            e.outer.size += e.size
            e.outer.anchors += e.anchors
    live = len(anchors)  # articles and mains outside what is taken out so far
    for e in hinted:  # outer ones first
        if e.outer and e.outer.gone:
            e.gone = True
            continue
        big = e.size >= WRAPS * total
        apart = live > e.anchors + e.around
        if e.in_article:
            stays = big and e.hint != "comment"
        elif e.tag in ("article", "main"):
            stays = True
        else:
            stays = (e.anchors > 0 or big) and not apart and not (e.around and e.hint == "comment")
        if not stays:
            e.gone = True
            live -= e.anchors
    if not any(text.strip() and not (around and around.gone) for b in found for text, _, around in b.parts):
        for e in hinted:
            e.gone = False


def blocks_of(page: str) -> list[Block]:
    """Text blocks outside furniture, in page order."""
    root = Element(0, "#", 0, False, False, None, None, 0)
    root.block = root
    stack: list[Element] = [root]
    opened: Counter[str] = Counter()
    paths: dict[tuple[int, str], int] = {}
    found: list[Block] = []
    hinted: list[Element] = []
    anchors: list[Element] = []
    current: Block | None = None
    number, at = 0, 0
    while at < len(page):
        token = TOKEN.match(page, at)
        at = token.end()
        top = stack[-1]
        if text := token["text"]:
            if not top.out:
                if current is None:
                    current = Block(top.block.path, top.block)
                    found.append(current)
                current.parts.append((entities.unescape(text), top.link, top.hinted))
            continue
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            continue
        if token["end"] or token["end2"]:
            if opened[tag]:
                _close(stack, opened, next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            if tag in BLOCK:
                current = None
            continue
        raw = token["attrs"] or token["attrs2"] or ""
        if tag in RAW and not raw.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br" and current is not None:
            current.parts.append((" ", False, top.hinted))
        if tag in BLOCK:
            current = None
            _close_implied(stack, opened, tag)
            for e in reversed(stack):  # whatever holds an element that holds blocks is marked already
                if e.holds_blocks:
                    break
                e.holds_blocks = True
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        number += 1
        up = stack[-1]
        anchor = up.tag in ("article", "main")
        around, in_article = up.around + anchor, up.in_article or up.tag == "article"
        out, hint, label = (True, "", "") if up.out else _is_furniture(tag, raw, bool(around))
        element = Element(number, tag, up.path, out, tag == "a" or up.link, up.block, up.up, up.depth, False, hint, up.hinted, None, around, in_article)
        if tag in BLOCK:
            key = (up.block.path, f"{tag}.{label}" if label else tag)
            element.path = paths.setdefault(key, len(paths) + 1)
            element.block, element.up, element.depth = element, up.block, up.block.depth + 1
        if hint and not out:
            element.outer, element.hinted = up.hinted, element
            hinted.append(element)
        if tag in ("article", "main") and not out:
            anchors.append(element)
        stack.append(element)
        opened[tag] += 1
    if hinted:
        _take_out(hinted, anchors, found)
    for block in found:
        parts = [(text, link) for text, link, around in block.parts if not (around and around.gone)]
        block.text = " ".join("".join(text for text, _ in parts).split())
        block.linked = sum(len(text.strip()) for text, link in parts if link)
    return [b for b in found if b.text]


def _close(stack: list[Element], opened: Counter[str], depth: int) -> None:
    for e in stack[depth:]:
        opened[e.tag] -= 1
    del stack[depth:]


def _close_implied(stack: list[Element], opened: Counter[str], tag: str) -> None:
    """A block start tag closes an open paragraph, a list item the item before, and so on."""
    for names, limits in ((("p",), LIMITS - {"blockquote"}), (CLOSES.get(tag, ()), LIMITS - {"td", "th"} if tag in ("tr", "td", "th", "tbody") else LIMITS)):
        if not any(opened[name] for name in names):
            continue
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                _close(stack, opened, i)
                if names == ("p",) or tag not in ("tr", "tbody"):
                    break
            elif i < len(stack) and stack[i].tag in limits:
                break


def smoothed(values: np.ndarray) -> np.ndarray:
    """Each value with half the weight of its neighbours on either side."""
    if len(values) < 2:
        return values
    framed = np.pad(values, 1, mode="edge")
    return (framed[:-2] + 2 * framed[1:-1] + framed[2:]) / 4


def content_paths(blocks: list[Block], share: float) -> set[int]:
    """Paths whose fused ratio reaches `share` of the best."""
    paths: dict[int, list[float]] = {}
    for b in blocks:
        held = paths.setdefault(b.path, [0, 0, 0, 0])
        for i, x in enumerate((len(b.text), len(PUNCTUATION.findall(b.text)), 1, min(b.linked, len(b.text)))):
            held[i] += x
    length, marks, count, linked = np.array(list(paths.values()), float).T
    text_ratio, mark_ratio = length / count, marks / count
    plain = 1 - linked / length
    own = text_ratio * (1 + mark_ratio) * plain
    fused = np.maximum(own, smoothed(text_ratio) * (1 + smoothed(mark_ratio)) * plain**2)
    return {p for p, x in zip(paths, fused, strict=True) if x >= share * fused.max() and x > 0}


def _region(picked: list[Block]) -> Element:
    """The deepest element that holds all chosen blocks, or the outermost article or main around them all, as far as it holds blocks."""
    region = picked[0].place
    inside = {region.number}  # elements known to lie in the region: none is walked over twice
    for b in picked[1:]:
        at = b.place
        while at.number not in inside:
            if at.depth >= region.depth:
                inside.add(at.number)
                at = at.up
            else:
                region = region.up
                inside.add(region.number)
    while region.up and not region.holds_blocks:
        region = region.up
    above = region
    while above := above.up:
        if above.tag in ("article", "main"):
            region = above
    return region


def _parts(blocks: list[Block], region: Element) -> list[int | None]:
    """The number of the child of `region` that each block is in: 0 for its own text, None for blocks outside it."""
    known: dict[int, int | None] = {region.number: 0}

    def part(place: Element) -> int | None:
        way = []
        while place.number not in known and place.depth > region.depth:
            way.append(place)
            place = place.up
        found = known.get(place.number)
        for e in reversed(way):
            found = e.number if found == 0 else found
            known[e.number] = found
        return found

    return [part(b.place) for b in blocks]


def extract(page: str | None, share: float = 0.3) -> str:
    """The main text of one page: blocks in page order, joined by line ends."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    chosen = content_paths(blocks, share)
    picked = [b for b in blocks if b.path in chosen] or blocks
    region = _region(picked)
    parts = _parts(blocks, region)
    held = [i for i, part in enumerate(parts) if part is not None]
    if region.tag not in ("article", "main") and chosen:
        keep = {parts[i] for i in held if blocks[i].path in chosen}
        hits = [i for i in held if blocks[i].path in chosen]
        first, last = hits[0], hits[-1]
        length, linked = Counter(), Counter()
        for i in held:
            length[parts[i]] += len(blocks[i].text)
            linked[parts[i]] += min(blocks[i].linked, len(blocks[i].text))
        # a part without a chosen path stays if it lies between chosen ones and is not links only, or is a heading just before
        head = first
        while head and parts[head - 1] is not None and blocks[head - 1].place.tag in HEADINGS:
            head -= 1
        held = [i for i in held if parts[i] in keep or head <= i < first or (first < i < last and linked[parts[i]] < WRAPS * length[parts[i]])]
    return "\n".join(blocks[i].text for i in held)


def with_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the main text of the column `html` in the column `out`, in place of `html` and of an own column `out`."""

    def read(batches: Iterator[list]) -> Iterator[dict]:
        for texts in batches:
            yield {out: [extract(x) for x in texts]}

    return annotated(pages, html, f"`{out}` string", read, [html])
