"""Registered queries over the cell grid, each with its check in SQL.

Events are laid out as sheets (one per event type) with loosely named headers at
different heights, then mapped back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators.skew import settle
from earshot.showcase import base as B
from earshot.sources import cells as CE

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


SHEETS = ("view", "click", "purchase", "signup", "error")
HEAD_ROW = {"view": 2, "click": 3, "purchase": 1, "signup": 1, "error": 1}
REVIEW_HEAD = ("ASIN", "Product Title", "评论内容", " Rating ", "评论标题", "图片1", "image 2", "店 铺", "Product Image", "notes", "sku")
CATALOG_HEAD = ("asin", "产品", "主图", "商品链接")
TITLES = {"view": {1: ("Customer reviews", "2024")}, "click": {1: ("Reviews",), 2: ("", "review")}}


def _layout(spark, d, heads, titles, row_values):
    """Grid of title cells, header cells and data cells."""
    c = F.col
    e = B.read(spark, d, "events").withColumn("sheet_idx", (F.array_position(T.words(*SHEETS), c("event_type")) - 1).cast("int"))
    sheets = e.select("event_type", "sheet_idx").distinct()

    def cells(values):
        return F.posexplode(F.expr("array(" + ", ".join(map(T.quoted, values)) + ")")).alias("pos", "value")

    parts = []
    for name, head in heads.items():
        one = sheets.filter(c("event_type") == name)
        rows = {**titles.get(name, {}), HEAD_ROW[name]: head}
        for r, values in rows.items():
            parts.append(one.select("event_type", "sheet_idx", F.lit(r).alias("row"), cells(values)))
    data = e.select("event_type", "sheet_idx", (c("event_id") + 10).cast("int").alias("row"), F.posexplode(row_values(c)).alias("pos", "value"))
    for p in parts:
        data = data.unionByName(p)
    # a grid is a stored table
    return settle(data.filter(c("value") != "").select(
        F.lit("book LC30.xlsx").alias("workbook"), c("event_type").alias("sheet"), "sheet_idx", "row", (c("pos") + 1).alias("col"), "value"
    ))


def review_grid(spark, d):
    def values(c):
        i, u = c("event_id"), c("user_id").cast("string")
        asin, product = F.concat(F.lit("B"), u), F.concat(F.lit(" Prod "), (c("user_id") % 7).cast("string"))
        review = F.array(
            F.when(i % 3 == 0, "").otherwise(asin), product, B.pick(B.SENTENCES, i * 7), (1 + i % 5).cast("string"), B.pick(B.TITLES, i),
            F.when(c("value") > 40, "a.jpg").otherwise(""), F.when(c("value") > 80, " b.jpg").otherwise(""), F.when(i % 2 == 0, "S1").otherwise(""),
            F.when(i % 5 == 0, F.concat(F.lit("own"), i.cast("string"))).otherwise(""), F.lit("x"), F.lit("later column"),
        )
        catalog = F.array(asin, product, F.when(i % 2 == 0, F.concat(F.lit("c"), i.cast("string"))).otherwise(""), F.concat(F.lit("https://l.example.com/"), i.cast("string")))
        return F.when(c("event_type") == "error", catalog).otherwise(review)

    heads = {s: (CATALOG_HEAD if s == "error" else REVIEW_HEAD) for s in SHEETS}
    return _layout(spark, d, heads, TITLES, values)


_S = ", ".join(f"({B.q(s)}, {i}, {HEAD_ROW[s]})" for i, s in enumerate(SHEETS))
_BASE = f"""WITH s(sheet, sheet_idx, header_row) AS (SELECT v.* FROM (VALUES {_S}) v(a, b, c) WHERE v.a IN (SELECT DISTINCT event_type FROM events)),
e AS (SELECT *, event_type AS sheet, event_id + 10 AS row, 'B' || user_id AS code, 'Prod ' || (user_id % 7) AS product FROM events)"""


@query("sheet_header_rows", _BASE + " SELECT 'book LC30.xlsx' AS workbook, sheet, header_row, CASE WHEN sheet = 'error' THEN 5 ELSE 11 END AS score FROM s")
def _(spark, d):
    return CE.header_rows(review_grid(spark, d), CE.REVIEW_HEADERS).select("workbook", "sheet", "header_row", "score")


_MAP = {"asin": 1, "product_name": 2, "raw_comment": 3, "rating": 4, "raw_title": 5, "store": 8, "product_image": 9}
_CMAP = {"asin": 1, "product_name": 2, "product_image": 3, "product_link": 4}
_MAPS = B.values([(0, k, v) for k, v in _MAP.items()] + [(1, k, v) for k, v in _CMAP.items()])


@query("sheet_column_map", _BASE + f" SELECT s.sheet, m.semantic, m.col FROM s JOIN {_MAPS} m(catalog, semantic, col) ON m.catalog = CASE WHEN s.sheet = 'error' THEN 1 ELSE 0 END")
def _(spark, d):
    return CE.column_map(review_grid(spark, d), CE.REVIEW_HEADERS).select("sheet", "semantic", "col")


@query("sheet_profiles", _BASE + """ SELECT sheet, sheet_idx, header_row, CASE WHEN sheet = 'error' THEN 'unknown' ELSE 'review' END AS source_type, sheet <> 'error' AS candidate,
  CASE WHEN sheet = 'error' THEN '' ELSE '6,7' END AS image_columns FROM s""")
def _(spark, d):
    p = CE.review_profile(review_grid(spark, d))
    return p.select("sheet", "sheet_idx", "header_row", "source_type", "candidate", F.array_join(F.transform("image_columns", lambda x: x.cast("string")), ",").alias("image_columns"))


_LOOKUP = _BASE + """, own AS (SELECT s.sheet_idx, row, CASE WHEN sheet = 'error' OR event_id % 3 <> 0 THEN code ELSE '' END AS asin, product,
    CASE WHEN sheet = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'c' || event_id ELSE '' END WHEN event_id % 5 = 0 THEN 'own' || event_id ELSE '' END AS image,
    CASE WHEN sheet = 'error' THEN 'https://l.example.com/' || event_id ELSE '' END AS link FROM e JOIN s USING (sheet)),
keyed AS (SELECT 'asin' AS kind, lower(asin) AS key, * FROM own WHERE asin <> '' AND (image <> '' OR link <> '')
  UNION ALL SELECT 'product_name', lower(replace(product, ' ', '')), * FROM own WHERE image <> '' OR link <> ''),
lookup AS MATERIALIZED (SELECT kind, key, image, link FROM keyed QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY sheet_idx, row) = 1)"""


@query("product_lookup", _LOOKUP + " SELECT kind, key, image AS product_image, link AS product_link FROM lookup")
def _(spark, d):
    return CE.product_lookup(review_grid(spark, d))


_TITLE = B.sql_pick(B.TITLES, "event_id")
_BODY = B.s_strip(B.sql_pick(B.SENTENCES, "event_id * 7"))


@query("collected_reviews", _LOOKUP + f""", r AS (SELECT e.*, s.sheet_idx, CASE WHEN event_id % 3 = 0 THEN '' ELSE code END AS asin0, CASE WHEN event_id % 5 = 0 THEN 'own' || event_id ELSE '' END AS img0 FROM e JOIN s USING (sheet) WHERE sheet <> 'error')
  SELECT sheet || '-' || row AS record_id, (sheet_idx::BIGINT * 1073741824 + row) AS ord, asin0 AS asin, product AS product_name, CAST(1 + event_id % 5 AS VARCHAR) AS rating, CASE WHEN event_id % 2 = 0 THEN 'S1' ELSE '未提供' END AS store, '未提供' AS country,
    CAST(CASE WHEN value > 80 THEN 2 WHEN value > 40 THEN 1 ELSE 0 END AS INTEGER) AS image_count, CASE WHEN value > 80 THEN 'a.jpg | b.jpg' WHEN value > 40 THEN 'a.jpg' ELSE '' END AS image_refs,
    trim(concat_ws('。', nullif({_TITLE}, ''), nullif({_BODY}, '')), '。') AS cleaned_comment,
    CASE WHEN img0 <> '' THEN img0 WHEN a.key IS NOT NULL THEN a.image WHEN p.key IS NOT NULL THEN p.image ELSE '' END AS product_image,
    CASE WHEN img0 <> '' THEN '' WHEN a.key IS NOT NULL THEN a.link WHEN p.key IS NOT NULL THEN p.link ELSE '' END AS product_link
  FROM r LEFT JOIN lookup a ON a.kind = 'asin' AND a.key = lower(asin0) AND asin0 <> '' LEFT JOIN lookup p ON p.kind = 'product_name' AND p.key = lower(replace(product, ' ', ''))""")
def _(spark, d):
    return CE.collect_reviews(review_grid(spark, d)).select(
        "record_id", "ord", "asin", "product_name", "rating", "store", "country", "image_count", "image_refs", "cleaned_comment", "product_image", "product_link"
    )


@query("collected_reviews_of_sheet", _BASE + f" SELECT sheet || '-' || row AS record_id, {_BODY} AS raw_comment FROM e WHERE sheet = 'click' AND contains({B.s_key('product')}, 'prod3')")
def _(spark, d):
    return CE.collect_reviews(review_grid(spark, d), focus="Prod 3", sheet="click").select("record_id", "raw_comment")


@query("focus_candidates", _BASE + """, n AS (SELECT product AS name, count(*) AS n, min(sheet_idx::BIGINT * 10000000000 + row) AS seen FROM e JOIN s USING (sheet) WHERE sheet <> 'error' AND row > header_row GROUP BY product
  UNION ALL SELECT sheet, 1, sheet_idx::BIGINT * 10000000000 + 9999999999 FROM s WHERE sheet <> 'error') SELECT name, n, CAST(row_number() OVER (ORDER BY n DESC, seen) AS INTEGER) AS position FROM n ORDER BY n DESC, seen LIMIT 20""")
def _(spark, d):
    return CE.focus_candidates(review_grid(spark, d))


# ---- return workbooks ---------------------------------------------------------------------

RETURN_HEAD = {
    "view": ("SKU", "买家备注", "退货原因", "退货时间", "一级分类"),
    "click": ("买家备注", "一级分类"),  # no product column: matched by the names
    "purchase": ("产品", "退货原因"),
    "signup": ("型号", "原文", "中文翻译"),
    "error": ("人工标签", "细分"),  # labels only: no feedback
}


def return_grid(spark, d):
    def values(c):
        i = c("event_id")
        model, remark, reason, label = B.pick(B.MODELS, c("user_id")), B.pick(B.REMARKS, i * 3), B.pick(B.REASONS, F.floor(i / 2)), B.pick(B.MANUAL, F.floor(i / 11))
        rows = {
            "view": F.array(model, remark, reason, F.date_format("ts", "yyyy/M/d"), label), "click": F.array(remark, label), "purchase": F.array(model, reason),
            "signup": F.array(model, F.lit("NA"), remark), "error": F.array(label, F.lit("x")),
        }
        return F.coalesce(*[F.when(c("event_type") == s, v) for s, v in rows.items()])

    return _layout(spark, d, RETURN_HEAD, {}, values)


@query("return_sheet_profiles", _BASE + """ SELECT sheet, header_row, CASE sheet WHEN 'view' THEN 'return' WHEN 'purchase' THEN 'return' WHEN 'signup' THEN 'unknown' ELSE 'review' END AS source_type,
  true AS candidate, sheet <> 'error' AS has_text, 'LC30' AS workbook_products FROM s""")
def _(spark, d):
    return CE.return_profile(return_grid(spark, d)).select("sheet", "header_row", "source_type", "candidate", "has_text", F.array_join("workbook_products", ",").alias("workbook_products"))


_REMARK, _REASON = B.sql_pick(B.REMARKS, "event_id * 3"), B.sql_pick(B.REASONS, "event_id // 2")


@query("collected_feedback", _BASE + f""", r AS (SELECT *, {B.sql_pick(B.MODELS, 'user_id')} AS model, {_REMARK} AS remark, {_REASON} AS reason FROM e WHERE sheet <> 'error'),
  f AS (SELECT *, CASE WHEN sheet = 'purchase' THEN '' ELSE remark END AS txt, CASE WHEN sheet IN ('view', 'purchase') THEN reason ELSE '' END AS rs FROM r WHERE sheet = 'click' OR contains(upper(model), 'LC30')),
  g AS (SELECT *, CASE WHEN {B.s_key('txt')} NOT IN ('', 'na', 'none', 'null', '同上', '未提供') THEN {B.s_strip('txt')} WHEN sheet = 'purchase' AND {B.s_key('rs')} NOT IN ('', 'na') THEN rs ELSE '' END AS cleaned_comment FROM f
    WHERE NOT (sheet = 'click' AND remark = '' AND {B.sql_pick(B.MANUAL, 'event_id // 11')} = ''))
  SELECT 'LC30-' || sheet || '-' || row AS record_id, CASE sheet WHEN 'view' THEN 'return' WHEN 'purchase' THEN 'return' WHEN 'signup' THEN 'unknown' ELSE 'review' END AS source_type,
    rs AS return_reason, cleaned_comment, cleaned_comment <> '' AS is_valid_feedback FROM g""")
def _(spark, d):
    return CE.collect_feedback(return_grid(spark, d), "lc30").select("record_id", "source_type", "return_reason", "cleaned_comment", "is_valid_feedback")


@query("product_candidates", _BASE + f""", t AS (SELECT s.sheet_idx, row, {B.sql_pick(B.MODELS, 'user_id')} AS model FROM e JOIN s USING (sheet) WHERE sheet IN ('view', 'purchase', 'signup')),
  p AS (SELECT DISTINCT CASE WHEN contains(upper(model), 'BOX') THEN 'BOX X2' WHEN contains(upper(model), 'P4') THEN 'P4' WHEN contains(upper(model), 'ZD3') THEN 'ZD3' END AS product FROM t)
  SELECT 'LC30' AS product, 0 AS stage UNION SELECT product, 2 FROM p WHERE product IS NOT NULL""")
def _(spark, d):
    return CE.product_candidates(return_grid(spark, d))
