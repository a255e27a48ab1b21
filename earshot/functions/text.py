"""Text, number, date and URL helpers: ``Column`` in, ``Column`` out.

All of them are built from native expressions, so they stay inside the JVM and
work the same on a batch or a streaming DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Java's \s is ASCII only.  This class is every Unicode white-space character,
# written so that other regular-expression engines read it too.
SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# the same characters for trimming, which only looks at the ends of a text
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NON_KEY = r"[^0-9a-z\x{4e00}-\x{9fff}]+"
# The same characters for expressions: Java looks those below 256 that are listed one by one up in a
# table, and reads the others only where one comparison does not rule them out.
_NON_KEY_LOW = "".join(f"\\x{{{i:x}}}" for i in range(256) if chr(i) not in "0123456789abcdefghijklmnopqrstuvwxyz")
NON_KEY_CHAR = rf"[{_NON_KEY_LOW}[\x{{100}}-\x{{10ffff}}&&[\x{{100}}-\x{{4dff}}\x{{a000}}-\x{{10ffff}}]]]"
# The characters of SPACE for expressions: Java looks characters below 256 that are listed one by one
# up in a table, and the others only where one comparison does not rule them out.
SPACE_CHAR = (
    r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
# a run of them other than one plain space, which collapsing leaves as it is
SPACE_RUN = f"{SPACE_CHAR}(?:(?<! )|(?={SPACE_CHAR})){SPACE_CHAR}*+"
NUMBER = r"(\d+(?:\.\d+)?)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(word: str) -> str:
    """SQL literal of a word."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(*items: str) -> Column:
    """Literal array of words, made in one step (long lists are frequent here)."""
    return F.expr("array(" + ", ".join(map(quoted, dict.fromkeys(items))) + ")")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Column expressions are copied wherever they are used, also by the optimizer when
    it moves a filter; binding the value keeps long rules on a long text small.
    """
    return F.transform(F.array(value), body)[0]


def text_of(c) -> Column:
    """The value as text; a missing value is the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def blank(c) -> Column:
    return text_of(c) == ""


def first_filled(*cs) -> Column:
    """First argument that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in cs], F.lit(""))


def strip(c) -> Column:
    return F.btrim(text_of(c), F.lit(SPACES))


def collapse(c) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), SPACE_RUN, " "))


def normalize(c) -> Column:
    """Lower case with collapsed white space."""
    return collapse(F.lower(text_of(c)))


def key(c) -> Column:
    """Comparison key: only ``0-9a-z`` and CJK characters are kept."""
    return F.regexp_replace(F.lower(text_of(c)), f"{NON_KEY_CHAR}++", "")


def key_length(c, enough: int) -> Column:
    """Number of key characters of a lower-case text; exact below ``enough``, else at least ``enough``.

    The beginning of a long text mostly has ``enough`` of them, and the rest is not read then.
    """
    c, head = col(c), 4 * enough
    return (
        F.when(F.length(c) <= head, F.length(key(c)))
        .when(F.length(key(F.substring(c, 1, head))) >= enough, enough)
        .otherwise(F.length(key(c)))
    )


def normalize_header(c) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), f"{SPACE}+", "")


def joined_text(sep: str, *cs) -> Column:
    """Join the filled arguments."""
    return F.concat_ws(sep, *[F.nullif(text_of(c), F.lit("")) for c in cs])


def list_text(c, sep: str = ", ") -> Column:
    return F.coalesce(F.array_join(col(c), sep), F.lit(""))


def review_text(translated_title, translated, raw_title, raw) -> Column:
    """Translated title and body if either is there, else the original pair."""
    def pair(a, b):
        return F.btrim(joined_text("。", a, b), F.lit("。"))

    has_translation = ~(blank(translated_title) & blank(translated))
    return F.when(has_translation, pair(translated_title, translated)).otherwise(pair(raw_title, raw))


def number(c) -> Column:
    """Rating-like value: a number, else the first number in the text, else 0."""
    c = col(c)
    text = c.cast("string")
    return F.coalesce(
        text.try_cast("double"), F.regexp_extract(text, NUMBER, 1).try_cast("double"), F.lit(0.0)
    )


def price(c) -> Column:
    return F.regexp_extract(F.replace(collapse(c), F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def rating_average(c) -> Column:
    return F.regexp_extract(collapse(c), r"([0-9.]+)", 1).try_cast("double")


def rating_count(c) -> Column:
    digits = F.regexp_extract(F.replace(collapse(c), F.lit(","), F.lit("")), r"([0-9]+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def after_on(c) -> Column:
    """Text behind the first " on ", unchanged when there is none."""
    c = text_of(c)
    at = F.locate(" on ", c)
    return F.when(at > 0, strip(F.substring(c, at + 4, F.length(c)))).otherwise(c)


def review_date(c) -> Column:
    """``... on 5 March 2024`` becomes ``2024-03-05``; other texts stay."""
    raw = after_on(c)
    plain = F.when(raw.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), raw)
    parsed = F.try_to_timestamp(F.initcap(plain), F.lit("d MMMM yyyy"))
    return F.when(
        F.locate(" on ", text_of(c)) > 0, F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), raw)
    ).otherwise(raw)


def timestamp(c) -> Column:
    """Dates as ``2024-1-5`` or ``2024/1/5``, with or without a time, or ISO text, whose offset is left out: the written day counts."""
    c = strip(c)
    formats = [
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
        (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
        (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy/M/d H:m:s"),
    ]
    tries = [F.try_to_timestamp(F.when(c.rlike(p), c), F.lit(f)) for p, f in formats]
    local = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*?)(?:Z|[+-]\d{2}:?\d{2})$", "$1")
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), local).try_cast("timestamp")
    return F.coalesce(*tries, iso)


def product_code(c) -> Column:
    """Ten-character product id found in a link or text, upper case."""
    c = text_of(c)
    patterns = (r"(?i)/dp/([A-Z0-9]{10})", r"(?i)/gp/product/([A-Z0-9]{10})", r"(?i)\b([A-Z0-9]{10})\b")
    return F.upper(first_filled(*[F.regexp_extract(c, p, 1) for p in patterns]))


def review_product_code(c) -> Column:
    """Product id of a product or review link, null when absent."""
    return F.nullif(F.upper(F.regexp_extract(text_of(c), r"(?i)/(?:dp|product-reviews)/([A-Z0-9]{10})", 1)), F.lit(""))


def product_link(c) -> Column:
    """``scheme://host/dp/ID`` when all three are known, else the link itself."""
    link = strip(c)
    origin = F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    code = product_code(link)
    scheme = F.lower(F.regexp_extract(origin, r"^([^:]+):", 1))
    host = F.regexp_extract(origin, r"://(.+)$", 1)
    return F.when((code != "") & (origin != ""), F.concat(scheme, F.lit("://"), host, F.lit("/dp/"), code)).otherwise(link)


def image_refs(c) -> Column:
    """References written one per line or between pipes."""
    parts = F.split(text_of(c), rf"{SPACE}*\|{SPACE}*|\n+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def shorten(c, limit: int) -> Column:
    c = col(c)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def percent(share) -> Column:
    return F.format_string("%.2f%%", F.bround(share.cast("double") * 100, 2))


def pairs_text(pairs: Column, total: Column, sep: str = "、") -> Column:
    """``name12.34%`` for an array of ``struct<name, n>``, or a note when empty."""
    parts = F.transform(pairs, lambda p: F.concat(p["name"], percent(p["n"] / total)))
    return F.when(F.size(pairs) > 0, F.array_join(parts, sep)).otherwise(F.lit("暂无"))


def category_tokens(c) -> Column:
    parts = F.split(F.lower(collapse(c)), rf"(?:{SPACE}|[,，/|_-])+")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 2))


def keyword_list(c) -> Column:
    return F.filter(F.transform(F.split(text_of(c), "[,\n，]"), collapse), lambda x: x != "")


def numbers_in(c) -> Column:
    """Every whole number in a reply, distinct, in order."""
    found = F.regexp_extract_all(collapse(c), F.lit(r"(\d+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull()))


def count_text(n) -> Column:
    """Rounded-down count.  Ten thousands are counted in units of 10,000."""
    n = col(n).cast("bigint")
    return (
        F.when(n >= 10000, F.concat(F.floor(n / 10000).cast("string"), F.lit("万+")))
        .when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("000+")))
        .otherwise(n.cast("string"))
    )


def search_url(marketplace, keyword, category, page) -> Column:
    query = joined_text(" ", collapse(keyword), collapse(category))
    base = F.concat(F.lit("https://"), text_of(marketplace), F.lit("/s?k="), F.url_encode(query))
    return F.when(col(page) > 1, F.concat(base, F.lit("&page="), col(page).cast("string"))).otherwise(base)


def cache_key(c) -> Column:
    return F.substring(F.sha1(text_of(c)), 1, 20)


def json_part(c) -> Column:
    """Outermost list, else outermost object, of an answer that may be fenced."""
    body = strip(c)
    body = F.when(
        body.startswith("```"),
        F.regexp_replace(F.regexp_replace(body, rf"^```(?:json)?{SPACE}*", ""), rf"{SPACE}*```$", ""),
    ).otherwise(body)
    return first_filled(
        F.regexp_extract(body, r"(?s)(\[.*\])", 1), F.regexp_extract(body, r"(?s)(\{.*\})", 1), body
    )


def url_extension(c) -> Column:
    """``.png`` of a URL path; ``.jpg`` when it has none."""
    path = F.regexp_extract(text_of(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    ext = F.lower(F.regexp_extract(path, r"\.([a-zA-Z0-9]+)$", 1))
    return F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit(".jpg"))


def image_extension(content_type, url) -> Column:
    """By content type, else by the end of the URL, else ``.jpg``."""
    kind = F.lower(text_of(content_type))
    by_type = F.coalesce(*[F.when(kind.contains(k), F.lit("." + k)) for k in ("png", "webp", "gif", "bmp")])
    ext = F.lower(F.regexp_extract(text_of(url), r"(?i)\.(png|jpg|jpeg|webp|gif|bmp)(?:$|\?)", 1))
    return F.coalesce(by_type, F.when(ext != "", F.concat(F.lit("."), ext)), F.lit(".jpg"))


def safe_segment(c) -> Column:
    return F.regexp_replace(text_of(c), r"[^a-zA-Z0-9._-]+", "_")


def mapped(c, table: dict, default=None) -> Column:
    """Look a label up in a small fixed table; unknown labels give ``default``."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    pairs = [quoted(x) if isinstance(x, str) else str(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.expr(f"map({', '.join(pairs)})"), col(c)), fallback)


def add(*cs: Column) -> Column:
    return reduce(lambda a, b: a + b, cs)
