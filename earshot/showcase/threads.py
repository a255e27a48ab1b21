"""Registered queries over forum threads, each with its check in SQL.

Conversations are written as thread lines (a turn is a post) and read back; the
documents serve as whole markdown files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators import threads as TH
from earshot.packs import threads as P
from earshot.showcase import base as B

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


STEP = 100000  # line positions per turn


def lines(spark, d):
    """Each turn as the lines of a saved thread page."""
    c = F.col
    n = (c("turn") + 1).cast("string")
    link = F.concat(F.lit("https://forum.example.com/threads/t."), c("conv_id").cast("string"), F.lit("/post-"), n)
    some = lambda condition, value: F.when(condition, value)
    head = F.array(
        some(c("turn") % 2 == 0, F.concat(F.lit("#### ["), c("role"), F.lit("](https://forum.example.com/members/1/)"))),
        some(c("turn") == 0, F.lit("##### Active Member")),
        some(c("turn") % 3 != 2, F.concat(F.lit("*   [Jan "), n, F.lit(", 2024]("), link, F.lit(")"))),
        some(c("turn") == 2, F.lit("Thread Starter")),
        F.concat(F.lit("*   [#"), n, F.lit("]("), link, F.lit(")")),
    )
    tail = F.array(
        F.lit("> quoted  words"), F.lit("Reactions:[a](https://x)"), F.lit("OP"),
        F.concat(F.lit("see [the page](https://p.example.com) ![Image 3: pic]("), F.lit("https://img.example.com/"), c("conv_id").cast("string"), F.lit(".png) ![:)](https://img.example.com/s.png)")),
    )
    all_lines = F.concat(F.array_compact(head), F.split("text", TH.LINE_BREAK), tail)
    return B.read(spark, d, "conversations").select(
        c("conv_id").cast("string").alias("thread_id"), F.col("turn"), F.posexplode(all_lines).alias("i", "line")
    ).select("thread_id", (F.col("turn") * STEP + F.col("i")).cast("bigint").alias("pos"), "line")


def posts(spark, d):
    return TH.parse_posts(lines(spark, d))


_BADGES = B.s_in(P.BADGE_LINES)


def _posts_sql() -> str:
    clean = B.s_strip("u.line")
    clean = f"regexp_replace({clean}, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g')"
    clean = f"regexp_replace({clean}, '\\[\\]\\([^)]+\\)', '', 'g')"
    clean = f"regexp_replace({clean}, '^\\*\\s+', '')"
    return f"""WITH c AS (SELECT * FROM conversations),
body AS (SELECT conv_id, turn, u.i AS i, {B.s_collapse(clean)} AS t FROM c, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) WITH ORDINALITY AS u(line, i)),
texts AS (SELECT conv_id, turn, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> '' AND t NOT IN {_BADGES} AND NOT starts_with(t, '>')), '') AS body,
  coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> '' AND t NOT IN {_BADGES}), '') AS raw FROM body GROUP BY conv_id, turn),
a AS (SELECT c.*, last_value(CASE WHEN turn % 2 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS author,
  bool_or(turn = 0) OVER (PARTITION BY conv_id ORDER BY turn) AS has_role FROM c),
posts AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(turn + 1 AS INTEGER) AS post_no, coalesce(author, 'Unknown') AS author,
  CASE WHEN has_role THEN 'Active Member' ELSE '' END AS author_role,
  CASE WHEN turn % 3 <> 2 AND NOT swallowed THEN 'Jan ' || (turn + 1) || ', 2024' ELSE '' END AS post_date,
  CASE WHEN turn = 0 OR (turn = 2) THEN '是' ELSE '否' END AS is_thread_starter, 'quoted words' || '' AS quote_text,
  CASE WHEN body = '' THEN '' ELSE body || chr(10) END || 'see the page' || late AS post_text,
  CASE WHEN raw = '' THEN '' ELSE raw || chr(10) END || '> quoted words' || chr(10) || 'see the page' || late AS raw_text,
  'https://img.example.com/' || conv_id || '.png' AS image_urls
  FROM (SELECT a.*, texts.body, texts.raw,
    -- without an author heading the head of the next turn still belongs to this post
    turn % 2 = 1 AND turn > 0 AS swallowed,
    CASE WHEN lead(turn) OVER w IS NOT NULL AND lead(turn) OVER w % 2 = 1 AND lead(turn) OVER w % 3 <> 2 THEN chr(10) || 'Jan ' || (lead(turn) OVER w + 1) || ', 2024' ELSE '' END AS late
    FROM a JOIN texts USING (conv_id, turn) WINDOW w AS (PARTITION BY a.conv_id ORDER BY a.turn)))"""


POSTS = _posts_sql()


@query("posts_parsed", POSTS + " SELECT thread_id, post_no, author, author_role, post_date, is_thread_starter, quote_text, post_text, raw_text, image_urls FROM posts")
def _(spark, d):
    return posts(spark, d).select(
        "thread_id", "post_no", "author", "author_role", "post_date", "is_thread_starter", "quote_text", "post_text", "raw_text",
        F.array_join(F.transform("image_items", lambda i: i["url"]), ",").alias("image_urls"),
    )


# ---- documents as thread files ------------------------------------------------------------

URLS = ("https://forum.example.com/threads/rca-switcher-test.", "https://forum.example.com/threads/optical-audio-hub.", "https://forum.example.com/threads/My Preamp AVR.", "https://forum.example.com/other/")


def files(spark, d):
    c = F.col
    i = c("doc_id")
    number = i.cast("string")
    tail = F.when(i % 4 == 3, "").otherwise("/")
    return B.read(spark, d, "documents").select(
        F.concat(B.pick(URLS, i), number, tail).alias("url"), F.concat(F.lit("raw/01_"), number, F.lit("_x.md")).alias("file"),
        F.when(i % 10 == 9, "error: 404").otherwise("ok").alias("status"),
        F.concat(F.when(i % 2 == 0, F.concat(F.lit("Title: Selector "), c("lang"), F.lit("\n"))).otherwise(""), F.lit("Markdown Content:\n*   [#1](https://x)\n"), c("text")).alias("markdown"),
    )


_FILES = f"""WITH f AS (SELECT doc_id, {B.sql_pick(URLS, 'doc_id')} || doc_id || CASE WHEN doc_id % 4 = 3 THEN '' ELSE '/' END AS url, CASE WHEN doc_id % 10 = 9 THEN 'error: 404' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 4 = 3 THEN 'unknown' ELSE CAST(doc_id AS VARCHAR) END AS thread_id,
  CASE doc_id % 4 WHEN 0 THEN 'rca-switcher-test' WHEN 1 THEN 'optical-audio-hub' WHEN 2 THEN 'my-preamp-avr' ELSE 'https-forum-example-com-other-' || doc_id END AS slug, lang, text FROM documents),
t AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Selector ' || lang ELSE slug END AS title, 1 + len(regexp_extract_all(chr(10) || text, '\\n\\*\\s+\\[#\\d+\\]')) AS estimated_posts FROM f),
kw(prio, label, keyword) AS (SELECT * FROM {B.values([(i, label, k) for i, (label, ks) in enumerate(P.TOPIC_RULES) for k in ks])}),
hit AS (SELECT DISTINCT doc_id, prio, label FROM t JOIN kw ON contains(lower(url || ' ' || title), keyword)),
idx AS MATERIALIZED (SELECT t.*, coalesce(l.labels, []) AS labels FROM t LEFT JOIN (SELECT doc_id, list(label ORDER BY prio) AS labels FROM hit GROUP BY doc_id) l USING (doc_id))"""


@query("thread_index", _FILES + " SELECT url, thread_id, slug, title, status, CAST(estimated_posts AS INTEGER) AS estimated_posts, array_to_string(labels, ',') AS labels FROM idx")
def _(spark, d):
    return TH.index_threads(files(spark, d)).select("url", "thread_id", "slug", "title", "status", "estimated_posts", F.array_join("labels", ",").alias("labels"))


@query("thread_topic_counts", _FILES + """ SELECT label, count(*) AS threads, CAST(sum(estimated_posts) AS BIGINT) AS posts FROM
  (SELECT unnest(CASE WHEN len(labels) = 0 THEN ['unclassified'] ELSE labels END) AS label, estimated_posts FROM idx) GROUP BY label""")
def _(spark, d):
    return TH.topic_counts(TH.index_threads(files(spark, d)))


def _dims(spark, d):
    """Themes given by hand exist for the labelled documents."""
    c = F.col
    return B.read(spark, d, "labels").filter("quality = 1").select(c("doc_id").cast("string").alias("thread_id"), F.lit("模拟切换器").alias("primary_theme"), F.concat(F.lit("product "), c("doc_id").cast("string")).alias("product_name")).distinct()


_THEMES = "CASE l WHEN " + " WHEN ".join(f"{B.q(k)} THEN {B.q(v)}" for k, v in P.TOPIC_THEMES.items()) + " END"


@query("thread_themes", _FILES + f""", dim AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS thread_id FROM labels WHERE quality = 1),
  j AS (SELECT idx.*, dim.thread_id IS NOT NULL AS known FROM idx LEFT JOIN dim USING (thread_id)),
  k AS (SELECT *, CASE WHEN known THEN '模拟切换器' ELSE '待判断' END AS primary_theme,
    coalesce(array_to_string(list_filter(list_transform(labels, lambda l: {_THEMES}), lambda x: NOT (known AND x = '模拟切换器')), '、'), '') AS secondary_themes FROM j)
  SELECT url, primary_theme, secondary_themes, concat_ws('、', primary_theme, nullif(secondary_themes, '')) AS topic_labels, CASE WHEN known THEN 'product ' || thread_id ELSE title END AS product_name FROM k""")
def _(spark, d):
    return TH.with_themes(TH.index_threads(files(spark, d)), _dims(spark, d)).select("url", "primary_theme", "secondary_themes", "topic_labels", "product_name")


@query("thread_lines", """WITH f AS (SELECT doc_id, text FROM documents) SELECT CAST(doc_id AS VARCHAR) AS thread_id, count(*) + 1 AS n, CAST(sum(length(l)) AS BIGINT) + 19 AS chars
  FROM f, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS u(l) GROUP BY doc_id""")
def _(spark, d):
    docs = files(spark, d).withColumn("thread_id", TH.thread_id_of_file("file"))
    return TH.lines_of(docs).groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@query("post_table", POSTS + """ SELECT thread_id || '-' || post_no AS post_uid, '待判断' AS primary_theme, '' AS secondary_themes, '待判断' AS topic_labels, 'thread ' || thread_id AS product_name,
  'thread ' || thread_id AS thread_title, 'https://forum.example.com/t/' || thread_id AS thread_url, post_no, author, author_role, post_date, is_thread_starter, quote_text, post_text, '' AS "中文翻译",
  raw_text, CAST(1 AS INTEGER) AS image_count, image_urls, '' AS "评论图片预览", 'x.md' AS local_file, '' AS "一级标签", '' AS "二级标签", '' AS "三级标签", '' AS "情绪倾向", '' AS "备注" FROM posts""")
def _(spark, d):
    t = B.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("thread_id")).distinct()
    t = t.select(
        "thread_id", F.concat(F.lit("thread "), "thread_id").alias("title"), F.concat(F.lit("https://forum.example.com/t/"), "thread_id").alias("url"),
        F.lit("x.md").alias("file"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("labels"),
    )
    return TH.post_table(posts(spark, d), TH.with_themes(t))


@query("image_captions", """SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), ''), regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS caption,
  false AS decorative FROM pages""")
def _(spark, d):
    return B.read(spark, d, "pages").select("page_id", TH.image_caption(F.lit("Image 12: "), F.col("url")).alias("caption"), TH.is_decorative(F.lit(""), F.col("url")).alias("decorative"))
