"""Forum threads as markdown documents: index fields, posts, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions import text as T
from earshot.functions.rules import contains_any
from earshot.operators.skew import carry_forward, settle, spread_join
from earshot.packs import threads as TP

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


# ---- index fields -----------------------------------------------------------------

def thread_id_and_slug(url) -> tuple[Column, Column]:
    """Id and slug of a thread link; other links are ``unknown`` with a short slug."""
    url = T.text_of(url)
    pattern = r"threads/([^./]+(?:\.[^/]+)?)\.(\d+)/?$"

    def slug(c):
        return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))

    name, number = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    known = number != ""
    return (
        F.when(known, number).otherwise("unknown"),
        F.when(known, T.first_filled(slug(name), F.lit("thread"))).otherwise(F.substring(slug(url), 1, 80)),
    )


def thread_id_of_file(path) -> Column:
    """Second part of the file name ``nn_id_slug.md``."""
    return F.split(F.regexp_extract(T.text_of(path), r"([^/]*)$", 1), "_", 3)[1]


def title(markdown, fallback) -> Column:
    """First ``Title:`` line, else the first heading, else the fallback."""
    md = T.text_of(markdown)
    named = F.regexp_substr(md, F.lit(r"(?m)^Title: .*$"))
    head = F.regexp_substr(md, F.lit(r"(?m)^# .*$"))
    return F.coalesce(
        F.when(named.isNotNull(), T.strip(F.regexp_replace(named, "^Title: ", ""))),
        F.when(head.isNotNull(), T.strip(F.regexp_replace(head, "^# ", ""))),
        fallback,
    )


def post_estimate(markdown) -> Column:
    return F.regexp_count(T.text_of(markdown), F.lit(r"(?m)^\*\s+\[#\d+\]"))


def topic_labels(url, thread_title, pack=TP) -> Column:
    """Every topic with a keyword in link or title."""
    t = F.lower(F.concat_ws(" ", url, thread_title))
    return F.array_compact(F.array(*[F.when(contains_any(t, ks), F.lit(label)) for label, ks in pack.TOPIC_RULES]))


def index_threads(docs: DataFrame) -> DataFrame:
    """Index of ``(url, file, status, markdown)``: id, slug, title, labels, estimate."""
    tid, slug = thread_id_and_slug("url")
    d = docs.withColumn("thread_id", tid).withColumn("slug", slug)
    d = d.withColumn("title", title("markdown", F.col("slug")))
    return d.withColumn("labels", topic_labels("url", F.col("title"))).withColumn("estimated_posts", post_estimate("markdown"))


def threads_by_topic(index: DataFrame, pack=TP) -> DataFrame:
    """(label, thread): a thread is listed under each of its labels."""
    labels = F.when(F.size("labels") == 0, F.array(F.lit(pack.TOPIC_DEFAULT))).otherwise(F.col("labels"))
    return index.withColumn("label", F.explode(labels))


def topic_counts(index: DataFrame) -> DataFrame:
    return threads_by_topic(index).groupBy("label").agg(
        F.count(F.lit(1)).alias("threads"), F.sum("estimated_posts").alias("posts")
    )


# ---- lines ------------------------------------------------------------------------------

def trim_to_posts(markdown, pack=TP) -> Column:
    """Only the posts of a saved page: no page head, no footer."""
    md = T.text_of(markdown)
    marker = "Markdown Content:\n"
    at = F.locate(marker, md)
    md = F.when(at > 0, F.substring(md, at + len(marker), F.length(md))).otherwise(md)
    for end in pack.END_OF_POSTS:
        md = F.substring_index(md, end, 1)
    first = F.locate("*   [#1](", md)
    before = F.substring(md, F.lit(1), first - 1)
    heads = F.length(before) - F.length(F.substring_index(before, "\n#### ", -1))
    # position behind the line break of the last heading before the first post
    start = F.when((first > 0) & F.contains(before, F.lit("\n#### ")), heads - 4).otherwise(1)
    return F.substring(md, start, F.length(md))


def lines_of(docs: DataFrame, pack=TP) -> DataFrame:
    """(thread_id, pos, line) of the posts of each document."""
    return docs.select("thread_id", F.posexplode(F.split(trim_to_posts("markdown", pack), LINE_BREAK)).alias("pos", "line")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def clean_line(c) -> Column:
    """Line without pictures and empty links, links replaced by their text."""
    t = T.strip(c)
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]+\)", "")
    t = F.regexp_replace(t, r"\[\]\([^)]+\)", "")
    t = F.regexp_replace(t, r"\[(?!http)([^\]]+)\]\([^)]+\)", "$1")
    t = F.regexp_replace(t, r"\[http[^\]]*\]\(([^)]+)\)", "$1")
    t = F.regexp_replace(t, rf"^\*{T.SPACE}+", "")
    return T.collapse(t)


def image_caption(alt, url) -> Column:
    """Caption without its running number; else file name, host or the link."""
    alt = F.regexp_replace(T.strip(alt), rf"(?i)^Image{T.SPACE}+\d+:{T.SPACE}*", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return T.first_filled(alt, F.regexp_extract(path, r"([^/]+)/*$", 1), host, url)


def is_decorative(alt, url, pack=TP) -> Column:
    label = F.lower(T.strip(image_caption(alt, url)))
    return (
        contains_any(url, pack.IMAGE_URL_FURNITURE)
        | (label == "") | label.isin(*pack.IMAGE_CAPTION_FURNITURE)
        | label.rlike(r"^[:;=8xX][-()DPp/|]+$") | label.rlike(r"^:[a-z0-9_+\-]+:$")
    )


def images_of(line, pack=TP) -> Column:
    """``array<struct<url, alt>>`` of the pictures in a line that carry content."""
    pattern = r"!\[([^\]]*)\]\((https://[^)]+)\)"
    alts = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    urls = F.regexp_extract_all(line, F.lit(pattern), F.lit(2))
    pairs = F.zip_with(alts, urls, lambda a, u: F.struct(u.alias("url"), a.alias("alt")))
    real = F.filter(pairs, lambda p: ~is_decorative(p["alt"], p["url"], pack))
    return F.transform(real, lambda p: F.struct(p["url"].alias("url"), image_caption(p["alt"], p["url"]).alias("alt")))


# ---- posts -----------------------------------------------------------------------------------

MARKER = r"^\*\s+\[#(\d+)\]\(([^)]+)\)"


def parse_posts(lines: DataFrame, pack=TP) -> DataFrame:
    """Posts of ``(thread_id, pos, line)``.

    A line is inside a post after a post marker and until the next heading or
    footer.  Author and role carry forward to later posts; a date is cleared by an
    author heading and by a post, the starter mark by a post.

    The changes of state are few and short: they are stored without the lines, and the values
    that each post sees are found among them alone.  So lines are read twice, once for the
    changes and once for the text, and only the text of posts is gathered by post.
    """
    c = F.col
    marks = settle(lines.select("thread_id", "pos", *_changes(T.strip("line"))))
    heads = _heads(marks)
    state = marks.select("thread_id", "pos", "state", "post")
    marked = lines.select("thread_id", "pos", "line", T.strip("line").alias("s"))
    state_of, post_of = _states(c("s"))
    marked = marked.withColumns({"state": state_of, "post": post_of})
    inside = carry_forward(marked, "thread_id", "pos", ["state", "post"], narrow=state).filter((c("state") == 1) & (c("pos") != c("post")))
    return _assemble(inside, heads, pack)


def _states(s: Column) -> tuple[Column, Column]:
    """Whether a stripped line opens (1) or closes (0) a post, and the position of the post it opens."""
    is_marker = s.rlike(MARKER)
    is_footer = s.startswith("### Similar threads") | F.contains(s, F.lit("[You must log in or register to reply here.]"))
    closes = s.startswith("#### ") | is_footer | s.rlike(r"^\*\s+\[#\d+\]\(")
    return F.when(is_marker, 1).when(closes, 0), F.when(is_marker, F.col("pos"))


def _changes(s: Column) -> list[Column]:
    """What a stripped line changes; null is no change.  Role, date and starter count outside of posts only."""
    state, post = _states(s)
    heading = F.coalesce(F.nullif(F.regexp_extract(s, r"^#### \[([^\]]+)\]", 1), F.lit("")), F.regexp_extract(s, r"^#### (.+)$", 1))
    is_author = s.startswith("#### ") & (s.rlike(r"^#### \[[^\]]+\]") | ~s.startswith("#### Go to page")) & (F.length(s) > 5)
    is_role = s.rlike(r"^##### .+$")
    date_line = r"^\*\s+\[([^\]#][^\]]*)\]\(([^)]+/post-\d+[^)]*)\)"
    is_date = s.rlike(date_line)
    is_starter = ~is_role & ~is_date & ~is_author & F.contains(s, F.lit("Thread Starter"))
    return [
        state.alias("state"), post.alias("post"), F.when(is_author, T.strip(heading)).alias("author"),
        F.when(is_role, T.strip(F.regexp_extract(s, r"^##### (.+)$", 1))).alias("role"),
        F.when(is_date, T.strip(F.regexp_extract(s, date_line, 1))).alias("date"), F.when(is_starter, "1").alias("starter"),
        F.when(s.rlike(MARKER), F.regexp_extract(s, MARKER, 1).cast("int")).alias("post_no"),
        F.when(s.rlike(MARKER), F.regexp_extract(s, MARKER, 2)).alias("post_url"),
    ]


HEAD = ("post_no", "post_url", "author", "role", "date", "starter")


def _heads(marks: DataFrame) -> DataFrame:
    """Per post: the values it sees.  Only lines that change something take part."""
    c = F.col
    some = marks.filter("state IS NOT NULL OR role IS NOT NULL OR date IS NOT NULL OR starter IS NOT NULL")
    some = carry_forward(some.withColumn("now", c("state")), "thread_id", "pos", ["now"])
    outside = F.coalesce(c("now"), F.lit(0)) == 0
    is_marker = c("post").isNotNull()
    # a cleared value is the empty text
    seen = some.select(
        "thread_id", (c("pos") * 2).alias("at"), "post", "post_no", "post_url", "author", F.when(outside, c("role")).alias("role"),
        F.when(c("author").isNotNull(), "").when(outside, c("date")).alias("date"), F.when(outside, c("starter")).alias("starter"),
    )
    # a post clears date and starter only after it has seen them
    after = {"at": c("pos") * 2 + 1, "post": F.lit(None).cast("bigint"), "date": F.lit(""), "starter": F.lit("0")}
    clears = marks.filter(is_marker).select("thread_id", *[after.get(n, F.lit(None).cast(seen.schema[n].dataType)).alias(n) for n in seen.columns[1:]])
    return carry_forward(seen.unionByName(clears), "thread_id", "at", ["author", "role", "date", "starter"]).filter(is_marker).select("thread_id", "post", *HEAD)


def _assemble(inside: DataFrame, heads: DataFrame, pack) -> DataFrame:
    c = F.col
    noise = c("s").startswith("Reactions:") | c("s").startswith("[You must log in")
    text = F.when(~noise, clean_line("line"))
    text = F.when((text != "") & ~text.isin(*pack.BADGE_LINES), text)
    quote = text.startswith(">")
    body = ~quote & ~text.isin("OP", "D", "Thread Starter")
    d = inside.select(
        "thread_id", "post", "pos", text.alias("t"), F.when(quote, T.strip(F.regexp_replace(text, "^>+", ""))).alias("q"), F.when(body, text).alias("b"),
        F.when(~noise, images_of(c("line"), pack)).alias("i"),
    ).unionByName(heads, allowMissingColumns=True)  # posts without a line stay

    def lines(name):
        # the lines of one post become one text value
        rows = F.array_sort(F.collect_list(F.when(c(name).isNotNull(), F.struct("pos", c(name).alias("v")))))
        return T.strip(F.array_join(F.transform(rows, lambda r: r["v"]), "\n"))

    posts = d.groupBy("thread_id", "post").agg(
        *[F.max(n).alias(n) for n in HEAD], lines("q").alias("quote_text"), lines("b").alias("post_text"), lines("t").alias("raw_text"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("i") > 0, F.struct("pos", "i")))), lambda r: r["i"])).alias("_images"),
    )
    return posts.select(
        "thread_id", "post", "post_no", "post_url", T.first_filled("author", F.lit("Unknown")).alias("author"),
        T.text_of("role").alias("author_role"), T.text_of("date").alias("post_date"),
        F.when((c("starter") == "1") | (c("post_no") == 1), "是").otherwise("否").alias("is_thread_starter"),
        "quote_text", "post_text", "raw_text", distinct_images(c("_images")).alias("image_items"),
    )


def distinct_images(images: Column) -> Column:
    """By link: place of the first one, caption of the last one."""
    urls = F.array_distinct(F.transform(images, lambda i: i["url"]))
    return F.transform(urls, lambda u: F.struct(
        u.alias("url"), F.element_at(F.filter(images, lambda i: i["url"] == u), -1)["alt"].alias("alt")))


# ---- post table ----------------------------------------------------------------------------------

def with_themes(index: DataFrame, dims: DataFrame | None = None, pack=TP) -> DataFrame:
    """Primary and secondary themes and product of each thread.

    ``dims`` has ``thread_id, primary_theme, product_name``, one row per thread that
    a person has looked at.
    """
    d = index if dims is None else index.join(dims.select("thread_id", "primary_theme", "product_name"), "thread_id", "left")
    if dims is None:
        d = d.withColumn("primary_theme", F.lit(None).cast("string")).withColumn("product_name", F.lit(None).cast("string"))
    themes = F.array_compact(F.transform("labels", lambda x: T.mapped(x, pack.TOPIC_THEMES)))
    d = d.withColumn("primary_theme", F.coalesce("primary_theme", F.lit(pack.THEME_DEFAULT)))
    others = F.filter(themes, lambda x: x != F.col("primary_theme"))
    d = d.withColumn("secondary_themes", F.array_join(others, "、"))
    return d.withColumn("topic_labels", T.joined_text("、", "primary_theme", "secondary_themes")).withColumn(
        "product_name", F.coalesce("product_name", "title")
    )


def post_table(posts: DataFrame, threads: DataFrame, pack=TP) -> DataFrame:
    """Published post table; threads that could not be read have no posts.

    Add the translation with ``enrich.apply_cache(..., fallback="blank")`` on
    ``post_text`` first, as column ``translation``.
    """
    t = threads.filter(F.col("status") == "ok").select(
        "thread_id", "primary_theme", "secondary_themes", "topic_labels", "product_name", "title", "url", "file"
    )
    d = spread_join(posts, t, ["thread_id"], "inner")
    translation = F.col("translation") if "translation" in d.columns else F.lit("")
    values = {
        "post_uid": F.concat_ws("-", "thread_id", "post_no"), "thread_title": F.col("title"), "thread_url": F.col("url"),
        "中文翻译": translation, "image_count": F.size("image_items"),
        "image_urls": F.array_join(F.transform("image_items", lambda i: i["url"]), "\n"), "local_file": F.col("file"),
    }
    blank = ("评论图片预览", "一级标签", "二级标签", "三级标签", "情绪倾向", "备注")
    return d.select(*[(values.get(n) if n in values else F.lit("") if n in blank else F.col(n)).alias(n) for n in pack.POST_COLUMNS])
