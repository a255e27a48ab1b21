"""Registered queries over the file sources and sinks: written to the shared folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators import clean as CL, threads as TH, trends as TR
from earshot.operators.skew import new_path, settle
from earshot.showcase import base as B, cells as SC, listings as SL, returns as SR, reviews as SV, threads as ST
from earshot.sources import cells as CE, files as FS

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---- sheets ----------------------------------------------------------------------------

@query("file_grid", SC.ORACLES["sheet_header_rows"])
def _(spark, d):
    path = new_path(spark)
    SC.review_grid(spark, d).write.parquet(path)
    return CE.header_rows(CE.read_grid(spark, path), CE.REVIEW_HEADERS).select("workbook", "sheet", "header_row", "score")


@query("csv_grid", """SELECT row_key, col, value FROM (SELECT CAST(doc_id AS VARCHAR) AS row_key, unnest([1, 2, 3, 4]) AS col,
  unnest([CAST(doc_id AS VARCHAR), lang, text, source]) AS value FROM documents) WHERE value <> ''""")
def _(spark, d):
    path, c = new_path(spark), F.col
    texts = B.read(spark, d, "documents").select(c("doc_id").cast("string"), "lang", "text", "source")
    texts.write.options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    grid = CE.read_csv_grid(spark, path, columns=4, multiline=True)
    keys = grid.filter("col = 1").select("workbook", "row", c("value").alias("row_key"))
    return grid.join(keys, ["workbook", "row"]).select("row_key", "col", "value")


@query("sheet_rows", """SELECT a, b, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS a,
  CASE WHEN event_id % 2 = 0 THEN user_id END AS b FROM events) WHERE a <> '' OR b IS NOT NULL GROUP BY a, b""")
def _(spark, d):
    c = F.col
    sheet = B.read(spark, d, "events").select(F.when(c("event_id") % 3 == 0, "").otherwise(c("event_type")).alias("a"), F.when(c("event_id") % 2 == 0, c("user_id")).alias("b"))
    return CE.rows_of(sheet).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("sheet_renamed", """SELECT event_type AS "一级功能", count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def _(spark, d):
    path, c = new_path(spark), F.col
    B.read(spark, d, "events").select(c("event_type").alias("主要功能/主题"), "user_id").write.parquet(path)
    table = CE.current_headings(spark.read.parquet(path))
    return table.groupBy("一级功能").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("sheet_picked", SV.ORACLES["clean_kept_rows"])
def _(spark, d):
    path, rows = new_path(spark), settle(SV.cleaned(spark, d))
    tables = {"Raw": rows, "CleanedComments": CL.kept(rows)}
    FS.write_tables(tables, path)
    return spark.read.parquet(f"{path}/{CE.pick_sheet(list(tables))}").select("ord", "record_id", "product_name", "cleaned_comment")


@query("sheet_metadata", f"SELECT CAST(matched_rows_before_cleaning AS VARCHAR) AS matched, CAST(clean_rows AS VARCHAR) AS clean, drop_reasons FROM ({SV.ORACLES['clean_funnel']})")
def _(spark, d):
    funnel = CL.review_funnel(SV.cleaned(spark, d))
    pairs = [F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in funnel.columns]
    sheet = funnel.select(F.inline(F.array(*pairs, F.struct(F.lit(" ").alias("field"), F.lit("x").alias("value")))))
    m = F.col("metadata")
    return CE.metadata(sheet).select(m["matched_rows_before_cleaning"].alias("matched"), m["clean_rows"].alias("clean"), m["drop_reasons"].alias("drop_reasons"))


# ---- cleaned and tagged tables -------------------------------------------------------------

def _cleaned(spark, d):
    path = new_path(spark)
    FS.write_cleaned(settle(SV.cleaned(spark, d)), path, {"focus": "all"})
    return path


@query("file_cleaned", SV.ORACLES["clean_kept_rows"])
def _(spark, d):
    return spark.read.parquet(f"{_cleaned(spark, d)}/cleaned").select("ord", "record_id", "product_name", "cleaned_comment")


@query("file_dropped", SV.ORACLES["clean_dropped_rows"])
def _(spark, d):
    return spark.read.parquet(f"{_cleaned(spark, d)}/dropped").select("ord", "record_id", "cleaned_comment", "drop_reason")


@query("file_counters", f"SELECT *, 'all' AS focus FROM ({SV.ORACLES['clean_funnel']})")
def _(spark, d):
    kind = "matched_rows_before_cleaning bigint, clean_rows bigint, dropped_rows bigint, drop_reasons string, focus string"
    return spark.read.schema(kind).json(f"{_cleaned(spark, d)}/metadata")


@query("file_tagged", SV.ORACLES["tag_contract"])
def _(spark, d):
    path = new_path(spark)
    FS.write_tagged(SV.tagged(spark, d), path)
    return spark.read.parquet(f"{path}/tagged")


@query("file_tagged_dropped", SV.ORACLES["clean_dropped_rows"])
def _(spark, d):
    path, rows = new_path(spark), settle(SV.cleaned(spark, d))
    FS.write_tagged(SV.TG.tag(rows), path, rows)
    return spark.read.parquet(f"{path}/dropped").select("ord", "record_id", "cleaned_comment", "drop_reason")


# ---- saved reviews, states and link lists ----------------------------------------------------

@query("file_payloads", SL.ORACLES["reviews_merged"])
def _(spark, d):
    path = new_path(spark)
    rows = SL.merged(spark, d)
    rows.select("asin", F.array(F.struct(*[c for c in rows.columns if c != "asin"])).alias("reviews")).write.json(path)
    out = FS.payload_reviews(FS.read_payloads(spark, path, lines=True)).withColumn("images", F.size("images")).withColumn("views", T.list_text("sourceViews"))
    return out.select("asin", "reviewId", "body", "title", "author", "dateText", "images", "rating", "ratingText", "verifiedPurchase", "views")


@query("file_state", SL.ORACLES["candidates_passing"])
def _(spark, d):
    """Half of the candidates stand in a state, half in a manifest's selected products."""
    path = new_path(spark)
    one = F.array(F.struct("asin", "scenarioLabel"))
    SL.passing(spark, d).select(F.when(F.col("ord") % 2 == 0, one).alias("candidates"), F.when(F.col("ord") % 2 == 1, one).alias("selectedProducts")).write.json(path)
    return FS.state_candidates(FS.read_state(spark, path, lines=True)).select("asin", "scenarioLabel")


@query("file_manifest", "SELECT 'B' || p_partkey AS asin, p_name AS title, p_type AS \"scenarioLabel\" FROM part")
def _(spark, d):
    path = new_path(spark)
    SL.products(spark, d).select(F.array(F.struct("asin", "title", "scenarioLabel")).alias("products")).write.json(path)
    return FS.manifest_products(FS.read_state(spark, path, lines=True)).select("asin", "title", "scenarioLabel")


@query("file_links", f"SELECT {B.s_strip('url')} AS url FROM pages WHERE page_id % 3 <> 0 AND {B.s_strip('url')} <> ''")
def _(spark, d):
    path, url, i = new_path(spark), F.coalesce("url", F.lit("")), F.col("page_id")
    B.read(spark, d, "pages").select(F.when(i % 3 == 0, F.concat(F.lit(" # "), url)).when(i % 3 == 1, F.concat(F.lit("  "), url, F.lit("\n"))).otherwise(url)).write.text(path)
    return FS.read_links(spark, path)


# ---- threads ------------------------------------------------------------------------------------

def _index(spark, d):
    path = new_path(spark)
    FS.write_thread_index(settle(TH.index_threads(ST.files(spark, d))), path)
    return path


@query("file_thread_index", f"SELECT url, title, status, estimated_posts, labels FROM ({ST.ORACLES['thread_index']})")
def _(spark, d):
    kind = "url string, title string, status string, estimated_posts int, labels array<string>"
    return spark.read.schema(kind).json(f"{_index(spark, d)}/index").withColumn("labels", F.array_join("labels", ","))


@query("file_thread_topics", ST.ORACLES["thread_topic_counts"])
def _(spark, d):
    listed = spark.read.schema("label string, estimated_posts int").json(f"{_index(spark, d)}/by_topic")
    return listed.groupBy("label").agg(F.count(F.lit(1)).alias("threads"), F.sum("estimated_posts").alias("posts"))


# ---- report tables --------------------------------------------------------------------------------

def _table(module, part: str, *names: str):
    """Write several tables of a report and read one of them."""
    def run(spark, d):
        path = new_path(spark)
        FS.write_tables({n: module.QUERIES[n](spark, d) for n in names}, path)
        return spark.read.parquet(f"{path}/{part}")
    return run


for _part in ("review_product_summary", "review_image_table"):
    query(f"file_{_part}", SL.ORACLES[_part])(_table(SL, _part, "review_product_summary", "review_table", "review_image_table"))
for _part in ("candidate_table", "run_table"):
    query(f"file_{_part}", SL.ORACLES[_part])(_table(SL, _part, "candidate_table", "run_review_details", "run_table"))


def _examples(spark, d):
    path = new_path(spark)
    FS.write_examples(settle(TR.taxonomy_examples(settle(SR.labelled(spark, d)))), path)
    return path


@query("file_examples", SR.ORACLES["taxonomy_examples"])
def _(spark, d):
    levels = [f"level_{i}" for i in (1, 2, 3, 4)]
    kind = ", ".join(f"{x} string" for x in levels) + ", n bigint, examples array<struct<workbook:string,sheet:string,row:bigint,text:string>>"
    lines = F.transform("examples", lambda e: F.concat(e["workbook"], F.lit("::"), e["sheet"], F.lit("#"), e["row"].cast("string"), F.lit(" "), e["text"]))
    return spark.read.schema(kind).json(f"{_examples(spark, d)}/json").select(*levels, "n", F.array_join(lines, "\n").alias("examples"))


@query("file_examples_text", f"SELECT '- Count: ' || n AS line, count(*) AS chains FROM ({SR.ORACLES['taxonomy_examples']}) GROUP BY n")
def _(spark, d):
    text = spark.read.text(f"{_examples(spark, d)}/markdown")
    return text.filter(F.col("value").startswith("- Count: ")).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("chains"))
