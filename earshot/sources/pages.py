"""Tables of saved HTML pages: page summaries, page state, pictures, cards."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions import text as T
from earshot.functions.rules import contains_any

# the helpers that run in tasks are shipped with the job; executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- fixed values: page states ------------------------------------------------------

CHALLENGE_TEXTS = ("Checking your browser", "Just a moment")
CHALLENGE_FRAME = "challenges.cloudflare.com"
SIGN_IN_LINKS = ("/ap/signin", "/ap/cvf/", "/ap/mfa", "/errors/validateCaptcha", "/captcha")
SIGN_IN_TITLE = (
    "(?i)Sign-In|Authentication required|Solve this puzzle|Enter the characters|Verify|验证码"
    "|输入手机号码或邮箱|登入|登录"
)
SIGN_IN_TEXT = (
    "(?i)Sign in|create account|Enter mobile number or email|Authentication required|Solve this puzzle"
    "|Enter the characters you see below|Verify your identity|输入手机号码或邮箱|登入|登录|验证码"
)

# ---- fixed values: where a page names its main picture, best first ------------------

MAIN_IMAGE = (
    r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+name=["']twitter:image["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)"large":"([^"]+)\"""",
    r"""(?i)"mainUrl":"([^"]+)\"""",
)
PRODUCT_IMAGE_TAG = (
    r"""(?is)(<[a-z]+[^>]*(?:id=["'](?:landingImage|imgBlkFront)["']|data-old-hires=|class=["'][^"']*a-dynamic-image)[^>]*>)"""
)

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c) -> Column:
    c = T.col(c)
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def page_title(html) -> Column:
    return T.collapse(unescape(F.regexp_extract(T.text_of(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_text(html) -> Column:
    """Visible text of the body, white space collapsed."""
    t = F.regexp_replace(T.text_of(html), r"(?is)<head[^>]*>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return T.collapse(unescape(F.regexp_replace(t, r"<[^>]*>", " ")))


def meta_description(html) -> Column:
    return unescape(F.regexp_extract(T.text_of(html), r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""", 1))


def thread_links(html, limit: int = 10) -> Column:
    """First links to threads (``tid=``) with at most 100 characters of text."""
    pattern = r"""(?is)<a[^>]+href=["']([^"']*tid=[^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.zip_with(
        F.regexp_extract_all(T.text_of(html), F.lit(pattern), F.lit(1)),
        F.regexp_extract_all(T.text_of(html), F.lit(pattern), F.lit(2)),
        lambda h, t: F.struct(F.substring(T.collapse(unescape(F.regexp_replace(t, r"<[^>]*>", ""))), 1, 100).alias("text"), unescape(h).alias("href")),
    )
    return F.slice(pairs, 1, limit)


def page_summary(pages: DataFrame) -> DataFrame:
    """Title, description, opening text, length and thread links of each page."""
    d = pages.withColumn("_text", page_text("html"))
    return d.select(
        "page_id", "url", page_title("html").alias("title"), meta_description("html").alias("meta_description"),
        F.substring("_text", 1, 5000).alias("content"), F.substring("_text", 1, 1000).alias("content_preview"),
        F.length("html").alias("html_length"), thread_links("html").alias("links"),
    )


def page_state(url, title, text, html) -> Column:
    """``challenge``, ``sign_in`` or ``content``."""
    challenge = contains_any(text, CHALLENGE_TEXTS) | T.col(html).rlike(f"(?is)<iframe[^>]+src=[^>]*{re.escape(CHALLENGE_FRAME)}")
    sign_in = contains_any(url, SIGN_IN_LINKS) | T.col(title).rlike(SIGN_IN_TITLE) | T.col(text).rlike(SIGN_IN_TEXT)
    return F.when(challenge, "challenge").when(sign_in, "sign_in").otherwise("content")


def with_state(pages: DataFrame) -> DataFrame:
    d = pages.withColumn("_title", page_title("html")).withColumn("_text", page_text("html"))
    return d.withColumn("state", page_state("url", "_title", "_text", "html")).drop("_title", "_text")


def content_pages(pages: DataFrame) -> DataFrame:
    return with_state(pages).filter(F.col("state") == "content").drop("state")


def main_image(html) -> Column:
    found = T.first_filled(*[F.regexp_extract(T.text_of(html), p, 1) for p in MAIN_IMAGE])
    return F.replace(F.replace(found, F.lit("\\u0026"), F.lit("&")), F.lit("\\/"), F.lit("/"))


def product_image_url(html) -> Column:
    tag = F.regexp_extract(T.text_of(html), PRODUCT_IMAGE_TAG, 1)
    return T.first_filled(
        F.regexp_extract(tag, r"""data-old-hires=["']([^"']+)["']""", 1), F.regexp_extract(tag, r"""[\s"']src=["']([^"']+)["']""", 1)
    )


# ---- cards inside a page ----------------------------------------------------------------
# Nested markup cannot be read with patterns.  The helper below reads one page at a
# time inside the task; pages are spread over tasks by Spark.

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    """An element.  ``marks`` are the marks (bits) of its place that it has itself, ``under`` those of its ancestors."""

    __slots__ = ("tag", "attrs", "classes", "children", "parent", "marks", "under")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = frozenset((attrs.get("class") or "").split())
        self.marks, self.under = 0, parent.under | parent.marks if parent is not None else 0

    def walk(self) -> Iterator[_Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return " ".join("".join(out).split())

    def has(self, name, *values) -> bool:
        return self.attrs.get(name) in values


class _Tree(HTMLParser):
    """The tree of a page.  Marks are decided once an element, when it opens, so no test climbs the tree."""

    def __init__(self, marks):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.open = Counter()
        self.marks = marks

    def _add(self, tag, attrs) -> _Node:
        node = _Node(tag, dict(attrs), self.at)
        for mark, test in self.marks.items():
            if test(node):
                node.marks |= mark
        self.at.children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        while True:
            node, self.at = self.at, self.at.parent
            self.open[node.tag] -= 1
            if node.tag == tag:
                return

    def handle_data(self, data):
        self.at.children.append(data)


def _tree(html: str | None, marks: dict) -> _Node:
    parser = _Tree(marks)
    parser.feed(html or "")
    parser.close()
    return parser.root


def _fields(root: _Node, first: dict, every: dict) -> dict:
    """One walk below ``root``: the first node of each test in ``first``, all nodes of those in ``every``."""
    found, wanted = dict.fromkeys(first) | {k: [] for k in every}, list(first.items())
    for node in root.walk():
        if node is root:
            continue
        met = [name for name, test in wanted if test(node)]
        if met:
            found |= dict.fromkeys(met, node)
            wanted = [w for w in wanted if w[0] not in met]
        for name, test in every.items():
            if test(node):
                found[name].append(node)
    return found


def _text(node: _Node | None) -> str:
    return node.text() if node is not None else ""


def _first_number(text: str) -> float | None:
    found = re.search(r"([0-9.]+)", text)
    try:
        return float(found.group(1)) if found else None
    except ValueError:
        return None


def _is_review(n: _Node) -> bool:
    return n.has("data-hook", "mobley-review-content", "review")


def _hook(*names):
    return lambda n: n.attrs.get("data-hook") in names


def _classed(name: str, under: int = 0):
    """Test for a class, below an element with the mark ``under`` if one is given."""
    return lambda n: name in n.classes and (not under or n.under & under)


def _tagged(tag: str, under: int):
    return lambda n: n.tag == tag and n.under & under


# ---- reviews -------------------------------------------------------------------------------

_IN_REVIEW, _IN_HOOK_STARS, _IN_STARS = 1, 2, 4
_REVIEW_MARKS = {_IN_REVIEW: _is_review, _IN_HOOK_STARS: _hook("review-star-rating"), _IN_STARS: _classed("review-rating")}
_REVIEW_FIRST = {
    "hook_stars": _classed("a-icon-alt", _IN_HOOK_STARS), "stars": _classed("a-icon-alt", _IN_STARS),
    "name": _classed("a-profile-name"), "widget": _hook("genome-widget"), "title": _hook("review-title"),
    "body": _hook("review-body"), "content": _classed("cr-full-content"), "date": _hook("review-date"),
    "badge": _hook("avp-badge", "msrp-avp-badge-linkless"),
}
_REVIEW_EVERY = {"thumbs": lambda n: n.tag == "button" and "review-image-thumbnail" in n.classes}


def _image(button: _Node) -> dict:
    thumb = re.search(r"url\((.+?)\)", button.attrs.get("style") or "")
    index = re.match(r"\s*\d+", button.attrs.get("data-image-index") or "0")
    return {
        "imageIndex": min(int(index.group()), 2**31 - 1) if index else 0, "originalUrl": button.attrs.get("data-image-source") or "",
        "thumbnailUrl": thumb.group(1) if thumb else "", "localPath": "",
    }


def _review(root: _Node) -> dict:
    f = _fields(root, _REVIEW_FIRST, _REVIEW_EVERY)
    rating = _text(f["hook_stars"]) or _text(f["stars"])
    return {
        "author": _text(f["name"]) or _text(f["widget"]), "title": _text(f["title"]), "body": _text(f["body"]) or _text(f["content"]),
        "ratingText": rating, "rating": _first_number(rating), "dateText": _text(f["date"]),
        "verifiedPurchase": f["badge"] is not None, "images": [_image(b) for b in f["thumbs"]],
    }


def _page_reviews(html: str) -> Iterator[dict]:
    """Records of a page; a listed node inside a review stands for that review, which comes before it."""
    seen = set()
    for node in _tree(html, _REVIEW_MARKS).walk():
        if not node.marks & _IN_REVIEW:
            node_id = node.attrs.get("id") or ""
            if node.under & _IN_REVIEW or not (node_id.startswith("customer_review-") or (node_id.startswith("R") and "data-hook" in node.attrs)):
                continue
        review_id = node.attrs.get("id")
        if not review_id:
            review_id = next((n.attrs["id"] for n in node.walk() if n is not node and (n.attrs.get("id") or "").startswith("R")), None)
        if review_id and review_id not in seen:
            seen.add(review_id)
            yield {"reviewId": review_id, **_review(node)}


# ---- search cards --------------------------------------------------------------------------

_IN_H2, _IN_H2_LINK, _IN_PLAIN, _IN_BRAND, _IN_LINE, _IN_PRICE = 1, 2, 4, 8, 16, 32


def _plain(n: _Node) -> bool:
    return n.tag == "a" and {"a-link-normal", "s-no-outline"} <= n.classes


_CARD_MARKS = {
    _IN_H2: lambda n: n.tag == "h2", _IN_H2_LINK: _tagged("a", _IN_H2), _IN_PLAIN: _plain,
    _IN_BRAND: lambda n: n.tag == "h5" and "s-line-clamp-1" in n.classes, _IN_LINE: _classed("s-line-clamp-1"), _IN_PRICE: _classed("a-price"),
}
_CARD_FIRST = {
    "h2_link_span": _tagged("span", _IN_H2_LINK), "plain_span": _tagged("span", _IN_PLAIN), "h2_span": _tagged("span", _IN_H2),
    "h2_link": _tagged("a", _IN_H2), "plain": _plain, "brand": _tagged("span", _IN_BRAND), "line": _classed("a-size-base-plus", _IN_LINE),
    "image": lambda n: n.tag == "img" and "s-image" in n.classes, "rating": _classed("a-icon-alt"), "price": _classed("a-offscreen", _IN_PRICE),
}
_CARD_EVERY = {"counts": lambda n: n.tag == "a" and "customerReviews" in (n.attrs.get("href") or "")}


def _page_cards(html: str) -> Iterator[dict]:
    for card in _tree(html, _CARD_MARKS).walk():
        if not (card.has("data-component-type", "s-search-result") and "data-asin" in card.attrs):
            continue
        f = _fields(card, _CARD_FIRST, _CARD_EVERY)
        link, image = f["h2_link"] or f["plain"], f["image"]
        yield {
            "asin": card.attrs.get("data-asin") or "", "title": _text(f["h2_link_span"] or f["plain_span"] or f["h2_span"]),
            "productUrl": (link.attrs.get("href") or "") if link is not None else "",
            "ratingText": _text(f["rating"]), "ratingCountText": " ".join(n.text() for n in f["counts"]).strip(),
            "priceText": _text(f["price"]), "brand": _text(f["brand"] or f["line"]),
            "imageUrl": (image.attrs.get("src") or "") if image is not None else "",
        }


IMAGES = "array<struct<imageIndex:int,originalUrl:string,thumbnailUrl:string,localPath:string>>"
REVIEW_SCHEMA = (
    "page_id bigint, url string, reviewId string, author string, title string, body string, ratingText string, "
    f"rating double, dateText string, verifiedPurchase boolean, images {IMAGES}"
)
CARD_SCHEMA = (
    "page_id bigint, url string, asin string, title string, productUrl string, ratingText string, "
    "ratingCountText string, priceText string, brand string, imageUrl string"
)
_IMAGE = pa.struct([("imageIndex", pa.int32()), *[(c, pa.string()) for c in ("originalUrl", "thumbnailUrl", "localPath")]])
_ARROW = {"rating": pa.float64(), "verifiedPurchase": pa.bool_(), "images": pa.list_(_IMAGE)}


def _names(schema: str) -> list[str]:
    return [p.strip().split(" ")[0] for p in re.sub(r"<.*>", "", schema).split(",")]


def _records(pages: DataFrame, marker: str, read, schema: str) -> DataFrame:
    """Records that ``read`` finds in each page; pages without ``marker``, a pattern, never reach Python.

    Page numbers and links are taken over as they are, large and null ones too.
    """
    names = _names(schema)[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, html in enumerate(batch.column("html")):
                found = list(read(html.as_py()))
                rows += found
                at += [i] * len(found)
            head = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("page_id", "url")]
            cells = [pa.array([r[c] for r in rows], _ARROW.get(c, pa.string())) for c in names]
            yield pa.RecordBatch.from_arrays(head + cells, names=["page_id", "url", *names])

    kept = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").filter(F.col("html").rlike(marker))
    return kept.mapInArrow(run, schema)


def reviews_of_pages(pages: DataFrame) -> DataFrame:
    """Review records of saved review pages: pages with a hook, a review's id, or an id written with references."""
    return _records(pages, r"(?i)data-hook|customer_review-|\bid\s*=\s*[\"']?[^\s\"'>]*&", _page_reviews, REVIEW_SCHEMA)


def cards_of_pages(pages: DataFrame) -> DataFrame:
    """Raw search cards of saved result pages; see ``listings.parse_hits``."""
    return _records(pages, "(?i)data-component-type", _page_cards, CARD_SCHEMA)
