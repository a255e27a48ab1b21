"""Registered queries over saved pages and plain text functions, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators import listings as L
from earshot.showcase import base as B
from earshot.sources import files as FI, pages as PG

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _unescape(x: str) -> str:
    for name, char in PG.ENTITIES:
        x = f"replace({x}, {B.q(name)}, {B.q(char)})"
    return x


_TITLE = B.s_collapse(_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
_STRIPPED = "regexp_replace(html, '(?is)<head[^>]*>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
_TEXT = B.s_collapse(_unescape(f"regexp_replace({_STRIPPED}, '<[^>]*>', ' ', 'g')"))


@query("page_summaries", f"SELECT page_id, url, {_TITLE} AS title, '' AS meta_description, substr({_TEXT}, 1, 5000) AS content, substr({_TEXT}, 1, 1000) AS content_preview, CAST(length(html) AS INTEGER) AS html_length FROM pages")
def _(spark, d):
    return PG.page_summary(B.read(spark, d, "pages")).drop("links")


def _with_links(pages):
    link = lambda n: F.concat(F.lit(f'<a class="x" href="/forum?tid={n}&amp;p='), F.col("page_id").cast("string"), F.lit(f'">Topic <b>{n}</b> &gt; '), F.col("url"), F.lit("</a>"))
    return pages.withColumn("html", F.concat("html", *[link(n) for n in range(12)]))


@query("page_thread_links", "SELECT page_id, CAST(n AS INTEGER) AS n, '/forum?tid=' || n || '&p=' || page_id AS href, substr('Topic ' || n || ' > ' || url, 1, 100) AS text FROM pages, range(10) r(n)")
def _(spark, d):
    p = PG.page_summary(_with_links(B.read(spark, d, "pages")))
    return p.select("page_id", F.posexplode("links").alias("n", "l")).select("page_id", "n", "l.href", "l.text")


def _states(spark, d):
    c = F.col
    extra = F.when(c("page_id") % 5 == 0, "<p>Just a moment</p>").when(c("page_id") % 5 == 1, "<p>Please sign in</p>").otherwise("")
    return B.read(spark, d, "pages").withColumn("html", F.concat("html", extra)).withColumn("url", F.when(c("page_id") % 5 == 2, F.concat("url", F.lit("/captcha"))).otherwise(c("url")))


@query("page_states", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'challenge' WHEN 1 THEN 'sign_in' WHEN 2 THEN 'sign_in' ELSE 'content' END AS state FROM pages")
def _(spark, d):
    return PG.with_state(_states(spark, d)).select("page_id", "state")


@query("content_pages", "SELECT page_id FROM pages WHERE page_id % 5 >= 3")
def _(spark, d):
    return PG.content_pages(_states(spark, d)).select("page_id")


@query("page_main_image", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://i.example.com/og-' || page_id || '.png' WHEN 1 THEN 'https://i.example.com/tw-' || page_id || '.png?a=1&b=2'
  WHEN 2 THEN 'https://i.example.com/large.jpg' WHEN 3 THEN 'https://i.example.com/main.jpg' ELSE '' END AS image FROM pages""")
def _(spark, d):
    n, m = F.col("page_id").cast("string"), F.col("page_id") % 5
    late = F.lit('"mainUrl":"https:\\/\\/i.example.com\\/main.jpg"')
    extra = (
        F.when(m == 0, F.concat(late, F.lit('<META data-x="1" property="og:image" content="https://i.example.com/og-'), n, F.lit('.png">')))
        .when(m == 1, F.concat(late, F.lit("<meta name='twitter:image' content='https://i.example.com/tw-"), n, F.lit(".png?a=1\\u0026b=2'>")))
        .when(m == 2, F.concat(late, F.lit('"large":"https://i.example.com/large.jpg"'))).when(m == 3, late).otherwise("")
    )
    return B.read(spark, d, "pages").select("page_id", PG.main_image(F.concat("html", extra)).alias("image"))


@query("page_product_image", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://i.example.com/hi.jpg' WHEN 1 THEN 'https://i.example.com/lo.jpg' ELSE '' END AS image FROM pages")
def _(spark, d):
    m = F.col("page_id") % 3
    extra = (
        F.when(m == 0, '<img src="https://i.example.com/lo.jpg" id="landingImage" data-old-hires="https://i.example.com/hi.jpg">')
        .when(m == 1, '<img class="big a-dynamic-image" src="https://i.example.com/lo.jpg">').otherwise('<img src="x.jpg">')
    )
    return B.read(spark, d, "pages").select("page_id", PG.product_image_url(F.concat("html", extra)).alias("image"))


# ---- cards inside pages: documents written as review pages, parts as result pages --------------

def _escaped(c):
    return F.replace(F.replace(F.replace(T.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def review_pages(spark, d):
    c, n = F.col, F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<html><body><div class="list"><div data-hook="review" id="R'), n, F.lit('"><div><span class="a-profile-name"> '), c("source"),
        F.lit(' </span></div><i data-hook="review-star-rating" class="a"><span class="a-icon-alt">'), (1 + c("doc_id") % 5).cast("string"),
        F.lit('.0 out of 5 stars</span></i><a data-hook="review-title"><span>Title <b>of</b></span>\n<span>'), c("lang"),
        F.lit('</span></a><span data-hook="review-date">Reviewed in Singapore on 5 March 2024</span>'),
        F.when(c("doc_id") % 2 == 0, '<span data-hook="avp-badge">Verified Purchase</span>').otherwise(""),
        F.when(c("doc_id") % 3 == 0, F.concat(F.lit('<span class="cr-full-content">'), _escaped("text"), F.lit("</span>"))).otherwise(F.concat(F.lit('<div data-hook="review-body"><span>'), _escaped("text"), F.lit("</span></div>"))),
        F.lit('<button class="review-image-thumbnail" data-image-index="2" data-image-source="https://i.example.com/o.jpg" style="background:url(https://i.example.com/t.jpg)"></button>'),
        F.lit('</div><div data-hook="review" id="R'), n, F.lit('"><span data-hook="review-title">again</span></div></div></body></html>'),
    )
    return B.read(spark, d, "documents").select(c("doc_id").alias("page_id"), F.lit("https://shop.example.com/r").alias("url"), html.alias("html"))


@query("page_reviews", f"""SELECT doc_id AS page_id, 'R' || doc_id AS reviewId, source AS author, 'Title of ' || lang AS title, {B.s_collapse('text')} AS body, (1 + doc_id % 5) || '.0 out of 5 stars' AS ratingText,
  CAST(1 + doc_id % 5 AS DOUBLE) AS rating, 'Reviewed in Singapore on 5 March 2024' AS dateText, doc_id % 2 = 0 AS verifiedPurchase, 'https://i.example.com/o.jpg' AS original, 'https://i.example.com/t.jpg' AS thumb FROM documents""")
def _(spark, d):
    r = PG.reviews_of_pages(review_pages(spark, d))
    return r.select("page_id", "reviewId", "author", "title", "body", "ratingText", "rating", "dateText", "verifiedPurchase", F.col("images")[0]["originalUrl"].alias("original"), F.col("images")[0]["thumbnailUrl"].alias("thumb"))


def result_pages(spark, d):
    c, n = F.col, F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit('<div data-component-type="s-search-result" data-asin="P'), n, F.lit('"><img class="s-image" src="https://i.example.com/'), n,
        F.lit('.jpg"><h2><a href="/dp/P'), n, F.lit('"><span>'), c("p_name"), F.lit(' &amp; more</span></a></h2><h5 class="s-line-clamp-1"><span>'), c("p_brand"),
        F.lit('</span></h5><span class="a-icon-alt">4.5 out of 5 stars</span><a href="/x#customerReviews">1,'), F.lpad(c("p_size").cast("string"), 3, "0"),
        F.lit('</a><span class="a-price"><span class="a-offscreen">S$'), c("p_retailprice").cast("string"), F.lit("</span></span></div>"),
        F.lit('<div data-component-type="s-search-result" data-asin=""><h2><span>no id</span></h2></div>'),
    )
    return B.read(spark, d, "part").select(c("p_partkey").alias("page_id"), F.lit("https://shop.example.com/s").alias("url"), html.alias("html"))


@query("page_search_cards", """SELECT p_partkey AS page_id, 'P' || p_partkey AS asin, p_name || ' & more' AS title, '/dp/P' || p_partkey AS productUrl, p_retailprice AS price, CAST(4.5 AS DOUBLE) AS ratingAverage,
  CAST(1000 + p_size AS BIGINT) AS ratingCount, p_brand AS brand, 'https://i.example.com/' || p_partkey || '.jpg' AS imageUrl FROM part""")
def _(spark, d):
    return L.parse_hits(PG.cards_of_pages(result_pages(spark, d))).select("page_id", "asin", "title", "productUrl", "price", "ratingAverage", "ratingCount", "brand", "imageUrl")


# ---- text functions ------------------------------------------------------------------------------

_FULL = B.s_collapse("text")


@query("text_keys", f"SELECT doc_id, {B.s_norm('text')} AS normal, {B.s_key('text')} AS key, {_FULL} AS collapsed, {B.s_strip('text')} AS stripped FROM documents")
def _(spark, d):
    return B.read(spark, d, "documents").select("doc_id", T.normalize("text").alias("normal"), T.key("text").alias("key"), T.collapse("text").alias("collapsed"), T.strip("text").alias("stripped"))


@query("text_shortened", f"""SELECT doc_id, CASE WHEN length(text) <= 56 THEN text ELSE substr(text, 1, 55) || '…' END AS s56, CASE WHEN length({_FULL}) <= 100 THEN {_FULL} ELSE substr({_FULL}, 1, 99) || '…' END AS s100,
  substr(sha1(text), 1, 20) AS cache_key, regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g') AS segment FROM documents JOIN pages ON doc_id = page_id""")
def _(spark, d):
    docs = B.read(spark, d, "documents").join(B.read(spark, d, "pages"), F.col("doc_id") == F.col("page_id"))
    return docs.select("doc_id", T.shorten("text", 56).alias("s56"), T.shorten(T.collapse("text"), 100).alias("s100"), T.cache_key("text").alias("cache_key"), T.safe_segment("url").alias("segment"))


@query("text_numbers", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS rating, CAST(l_partkey AS DOUBLE) + 0.5 AS price, CAST(l_orderkey % 100000 AS BIGINT) AS cnt FROM lineitem""")
def _(spark, d):
    c = F.col
    li = B.read(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.number(F.concat(c("l_quantity").cast("string"), F.lit(" out of 50"))).alias("rating"),
        T.price(F.concat(F.lit("US$ "), F.regexp_replace(c("l_partkey").cast("string"), r"(\d)(?=(\d{3})+$)", "$1,"), F.lit(".50 incl. tax 9"))).alias("price"),
        T.rating_count(F.concat((c("l_orderkey") % 100000).cast("string"), F.lit(" ratings"))).alias("cnt"),
    )


@query("text_links", """SELECT p_partkey, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code, 'https://shop.example.com/dp/B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS link, CASE WHEN p_size % 2 = 0 THEN '.png' ELSE '.jpg' END AS ext,
  'https://m.example/s?k=' || replace(p_name, ' ', '+') || '+' || p_type || CASE WHEN p_size > 1 THEN '&page=' || p_size ELSE '' END AS search, p_type || ',' || lower(p_brand) AS words FROM part""")
def _(spark, d):
    c = F.col
    code = F.concat(F.lit("b"), F.lpad(c("p_partkey").cast("string"), 9, "0"))
    link = F.when(c("p_size") % 2 == 0, F.concat(F.lit("HTTPS://shop.example.com/gp/product/"), code, F.lit("/ref=x?y=1"))).otherwise(F.concat(F.lit("https://shop.example.com/a-b/dp/"), code))
    picture = F.when(c("p_size") % 2 == 0, "https://i.example.com/a.b/c.PNG?x=1.gif").otherwise("https://i.example.com/abc")
    return B.read(spark, d, "part").select(
        "p_partkey", T.product_code(link).alias("code"), T.product_link(link).alias("link"), T.url_extension(picture).alias("ext"),
        T.search_url(F.lit("m.example"), F.col("p_name"), F.col("p_type"), F.col("p_size")).alias("search"),
        F.array_join(T.keyword_list(F.concat(c("p_type"), F.lit(" ，, \n"), F.lower("p_brand"))), ",").alias("words"),
    )


@query("text_choice", """SELECT event_id, event_id % 1000 AS a, CAST(event_id % 7 AS VARCHAR) || ',' || CAST(10 + event_id % 5 AS VARCHAR) AS ids, CASE WHEN event_id * 37 >= 10000 THEN (event_id * 37 // 10000) || '万+' WHEN event_id * 37 >= 1000 THEN (event_id * 37 // 1000) || '000+' ELSE CAST(event_id * 37 AS VARCHAR) END AS about,
  '[{"a": ' || event_id || '}]' AS json, props AS refs, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def _(spark, d):
    c, n = F.col, F.col("event_id").cast("string")
    reply = F.concat(F.lit("不搜索：编号"), (c("event_id") % 7).cast("string"), F.lit("、"), (10 + c("event_id") % 5).cast("string"), F.lit("、"), (c("event_id") % 7).cast("string"))
    return B.read(spark, d, "events").select(
        "event_id", T.number((c("event_id") % 1000).cast("string")).cast("bigint").alias("a"),
        F.array_join(F.transform(T.numbers_in(reply), lambda x: x.cast("string")), ",").alias("ids"), T.count_text(c("event_id") * 37).alias("about"),
        T.json_part(F.concat(F.lit('```json\n[{"a": '), n, F.lit("}]\n```"))).alias("json"), F.array_join(T.image_refs(F.concat(F.lit(" | "), c("props"), F.lit(" \n"))), ",").alias("refs"),
        T.review_date(F.concat(F.lit("Reviewed in X on "), F.date_format("ts", "d MMMM yyyy"))).alias("day"),
    )


_CHUNKS = r"""WITH RECURSIVE cuts AS (
  SELECT doc_id, 0 AS n, CASE WHEN length(text) <= 3500 THEN text END AS chunk, CASE WHEN length(text) > 3500 THEN text END AS rest FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, n + 1, CASE WHEN length(rest) <= 3500 THEN rest ELSE trim(substr(rest, 1, pos), {sp}) END,
    CASE WHEN length(rest) > 3500 THEN trim(substr(rest, pos + 1), {sp}) END
  FROM (SELECT *, CASE WHEN line >= 1750 THEN line WHEN stop >= 1750 THEN stop ELSE 3500 END AS pos FROM (
    SELECT *, 3500 - coalesce(nullif(strpos(reverse(substr(rest, 1, 3500)), chr(10)), 0), 3501) AS line,
      3500 - coalesce(nullif(strpos(reverse(substr(rest, 1, 3500)), ' .'), 0), 3500) - 1 AS stop FROM cuts WHERE rest IS NOT NULL)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS part, chunk FROM cuts WHERE chunk IS NOT NULL AND (chunk <> '' OR n = 0)"""


@query("text_chunks", _CHUNKS.replace("{sp}", " || ".join(f"chr({ord(x)})" for x in T.SPACES)))
def _(spark, d):
    return FI.chunks(B.read(spark, d, "documents"), "doc_id", "text")


@query("text_chunk_totals", f"SELECT doc_id, length(regexp_replace(text, {B.q(T.SPACE)}, '', 'g')) AS chars, true AS fits FROM documents")
def _(spark, d):
    parts = FI.chunks(B.read(spark, d, "documents"), "doc_id", "text")
    return parts.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("chunk", T.SPACE, ""))).alias("chars"), F.bool_and(F.length("chunk") <= 3500).alias("fits"))
