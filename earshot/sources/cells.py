"""Sheets as a long grid of cells, and the mapping of loose headers to columns.

The grid has ``workbook, sheet, sheet_idx, row, col, value``; one table may hold
the sheets of any number of workbooks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from earshot.functions import text as T
from earshot.operators.clean import filter_focus, has_key, is_invalid_feedback
from earshot.operators.returns import is_quality_risk, is_user_reason, severity
from earshot.operators.skew import number_read, settle, spread_join
from earshot.packs import headers as H, returns as RP, reviews as VP

GRID = "workbook string, sheet string, sheet_idx int, row int, col int, value string"
SHEET = ["workbook", "sheet"]
MISSING = "未提供"

# ord = number of the sheet over all workbooks (24 bits), row (30 bits); larger ones are refused
SHEET_BITS, ROW_BITS = 24, 30


@dataclass(frozen=True)
class HeaderPack:
    """How headers are recognised: alias names, weights and rows searched."""

    aliases: dict[str, tuple[str, ...]]
    weights: dict[str, int] = field(default_factory=dict)
    scan_rows: int = 8
    images: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, a, self.weights.get(s, 1)) for s, names in self.aliases.items() for a in names]
        named = spark.createDataFrame(rows, "semantic string, alias string, weight int")
        return named.select("semantic", T.normalize_header("alias").alias("header"), "weight").distinct()


REVIEW_HEADERS = HeaderPack(H.REVIEW_ALIASES, H.REVIEW_WEIGHTS, H.REVIEW_SCAN_ROWS, images=True)
RETURN_HEADERS = HeaderPack(H.RETURN_ALIASES, H.RETURN_WEIGHTS, H.RETURN_SCAN_ROWS)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A stored grid of cells."""
    return spark.read.schema(GRID).parquet(path)


def read_csv_grid(spark: SparkSession, path: str, columns: int = 256, multiline: bool = False) -> DataFrame:
    """The cells of csv files as a grid: a file is a workbook with one sheet, named like the file.

    Files are split and read in parallel; rows are numbered over all blocks of their file.  Blank
    lines are no rows and empty cells no cells.  A record of more than ``columns`` fields is an error.
    With ``multiline`` a quoted cell may hold line breaks, and a file is read by one task.
    """
    names = [f"c{i}" for i in range(1, columns + 1)]
    # the reader itself refuses records of more fields than ``maxColumns``
    options = {"quote": '"', "escape": '"', "multiLine": multiline, "maxColumns": columns}
    raw = spark.read.schema(StructType([StructField(n, StringType()) for n in names])).options(**options).csv(path)
    cells = F.filter(F.array(*[F.struct(F.lit(i).alias("col"), F.col(n).alias("value")) for i, n in enumerate(names, 1)]), lambda x: x["value"] != "")
    rows = raw.select(F.col("_metadata.file_path").alias("workbook"), F.col("_metadata.file_block_start").alias("block"), cells.alias("cells"))
    numbered = number_read(rows, "workbook", "row", part=F.col("block"))
    row = F.when(F.col("row") < 1 << ROW_BITS, F.col("row")).otherwise(F.raise_error(F.lit(f"a sheet of more than 2^{ROW_BITS} rows")).cast("bigint"))
    sheet = F.regexp_replace(F.url_decode(F.replace(F.regexp_extract("workbook", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")
    return numbered.select("workbook", sheet.alias("sheet"), F.lit(0).alias("sheet_idx"), row.cast("int").alias("row"), F.inline("cells"))


# ---- plain tabular sheets -------------------------------------------------------

def rows_of(df: DataFrame) -> DataFrame:
    """Rows with at least one filled cell."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    return df.filter(F.exists(cells, lambda x: x.isNotNull() & (x != "")))


def current_headings(df: DataFrame, pack=VP) -> DataFrame:
    """Columns under older headings get today's; of columns that then share a heading the last one counts."""
    last = {pack.LEGACY_HEADERS.get(c, c): c for c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in last.items()])


def pick_sheet(names: list[str], requested: str | None = None) -> str:
    """Name of the table to read: the requested one, else tagged, cleaned, first."""
    if requested:
        if requested not in names:
            raise ValueError(f"no sheet named {requested!r}")
        return requested
    return next((n for n in ("TaggedComments", "CleanedComments") if n in names), names[0])


def metadata(df: DataFrame) -> DataFrame:
    """One row with the key/value pairs of a small metadata table."""
    filled = df.filter(~T.blank("field")).select(F.struct("field", F.col("value").cast("string").alias("value")).alias("kv"))
    return filled.agg(F.map_from_entries(F.array_sort(F.collect_set("kv"))).alias("metadata"))


# ---- header detection --------------------------------------------------------------

def _is_image_header(h: Column) -> Column:
    return h.rlike("(?i)" + H.IMAGE_HEADER) | h.isin(*H.IMAGE_HEADER_NAMES)


def header_cells(grid: DataFrame, pack: HeaderPack) -> DataFrame:
    """Non-empty cells of the rows in which the header is searched."""
    return (
        grid.filter((F.col("row") >= 1) & (F.col("row") <= pack.scan_rows))
        .select(*SHEET, "sheet_idx", "row", "col", T.normalize_header("value").alias("header"))
        .filter(F.col("header") != "")
    )


def header_matches(grid: DataFrame, pack: HeaderPack) -> DataFrame:
    """(sheet, row, semantic) with the lowest column that carries an alias of it."""
    aliases = pack.table(grid.sparkSession)  # fixed list of names
    return (
        header_cells(grid, pack)
        .join(F.broadcast(aliases), "header")
        .groupBy(*SHEET, "row", "semantic")
        .agg(F.min("col").alias("col"), F.max("weight").alias("weight"))
    )


def header_rows(grid: DataFrame, pack: HeaderPack) -> DataFrame:
    """The header row of every sheet: best score, earliest on ties, else row 1."""
    scores = header_matches(grid, pack).select(*SHEET, "row", "weight")
    if pack.images:
        images = header_cells(grid, pack).filter(_is_image_header(F.col("header")))
        scores = scores.unionByName(images.select(*SHEET, "row", F.lit(1).alias("weight")))
    best = (
        scores.groupBy(*SHEET, "row").agg(F.sum("weight").alias("score"))
        .groupBy(*SHEET).agg(F.max(F.col("score") * 1000 - F.col("row")).alias("_best"), F.max("score").alias("score"))
        .select(*SHEET, "score", (F.col("score") * 1000 - F.col("_best")).cast("int").alias("header_row"))
    )
    sheets = grid.groupBy(*SHEET).agg(F.min("sheet_idx").alias("sheet_idx"))
    return sheets.join(best, SHEET, "left").select(
        *SHEET, "sheet_idx", F.coalesce("header_row", F.lit(1)).alias("header_row"),
        F.coalesce("score", F.lit(0)).cast("int").alias("score"),
    )


def column_map(grid: DataFrame, pack: HeaderPack) -> DataFrame:
    """(sheet, semantic, col) of the detected header row."""
    heads = header_rows(grid, pack).select(*SHEET, F.col("header_row").alias("row"))
    return header_matches(grid, pack).join(heads, [*SHEET, "row"], "left_semi").select(*SHEET, "semantic", "col")


def image_columns(grid: DataFrame, pack: HeaderPack) -> DataFrame:
    heads = header_rows(grid, pack).select(*SHEET, F.col("header_row").alias("row"))
    return (
        header_cells(grid, pack).filter(_is_image_header(F.col("header")))
        .join(heads, [*SHEET, "row"], "left_semi").select(*SHEET, "col")
    )


# ---- sheet profiles ----------------------------------------------------------------------

REVIEW_TEXT = ("raw_comment", "translated_comment", "raw_title", "translated_title")
RETURN_TEXT = ("translated_comment", "raw_comment", "return_reason")
LEVELS = ("level_1", "level_2", "level_3", "level_4")


def _has(*names: str) -> Column:
    return F.arrays_overlap("semantics", T.words(*names))


def review_source_type(sheet: Column) -> Column:
    low = F.lower(sheet)
    return (
        F.when(low.contains("review") | sheet.contains("评论"), "review")
        .when(low.contains("feedback") | sheet.contains("反馈"), "feedback")
        .when(_has("raw_comment", "translated_comment"), "review")
        .otherwise("unknown")
    )


def return_source_type(sheet: Column) -> Column:
    low = F.lower(sheet)
    return (
        F.when(sheet.contains("售后") | low.contains("after"), "after_sales")
        .when(_has("return_reason"), "return")
        .when(sheet.contains("退货") | low.contains("refund") | low.contains("return"), "return")
        .when(sheet.contains("评论") | low.contains("review"), "review")
        .when(_has(*LEVELS), "review")
        .otherwise("unknown")
    )


def _mapped_sheets(grid: DataFrame, pack: HeaderPack) -> DataFrame:
    by_sheet = column_map(grid, pack).groupBy(*SHEET).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("semantic", "col")))).alias("column_map")
    )
    none = F.create_map().cast("map<string,int>")
    return (
        header_rows(grid, pack).join(by_sheet, SHEET, "left")
        .withColumn("column_map", F.coalesce("column_map", none))
        .withColumn("semantics", F.map_keys("column_map"))
    )


def review_profile(grid: DataFrame, pack: HeaderPack = REVIEW_HEADERS) -> DataFrame:
    """One row per sheet of review workbooks."""
    images = image_columns(grid, pack).groupBy(*SHEET).agg(F.array_sort(F.collect_list("col")).alias("image_columns"))
    has_text = _has(*REVIEW_TEXT)
    return _mapped_sheets(grid, pack).join(images, SHEET, "left").select(
        *SHEET, "sheet_idx", "header_row", "score", "column_map",
        F.coalesce("image_columns", F.array().cast("array<int>")).alias("image_columns"),
        review_source_type(F.col("sheet")).alias("source_type"),
        has_text.alias("candidate"),
    )


def return_profile(grid: DataFrame, pack: HeaderPack = RETURN_HEADERS) -> DataFrame:
    """One row per sheet of return and after-sales workbooks."""
    return _mapped_sheets(grid, pack).select(
        *SHEET, "sheet_idx", "header_row", "score", "column_map",
        return_source_type(F.col("sheet")).alias("source_type"),
        product_tokens(F.col("sheet")).alias("sheet_products"),
        product_tokens(F.col("workbook")).alias("workbook_products"),
        (_has(*RETURN_TEXT) | _has(*LEVELS)).alias("candidate"),
        _has(*RETURN_TEXT).alias("has_text"),
    )


# ---- product tokens --------------------------------------------------------------------------

def product_tokens(c, pattern: str = RP.MODEL_CODE) -> Column:
    """Model codes in a text, upper case, distinct, in order; no word borders."""
    found = F.regexp_extract_all(F.upper(T.text_of(c)), F.lit(f"({pattern})"), F.lit(1))
    return F.array_distinct(F.transform(found, T.collapse))


def product_name(c) -> Column:
    return F.upper(T.collapse(c))


# ---- row projection ----------------------------------------------------------------------------

def sheet_order(profile: DataFrame) -> DataFrame:
    """Number of each workbook's first sheet, with workbooks in order of name.

    A workbook takes as many numbers as its highest sheet index asks for.  Workbooks are
    cut into ranges of names, whose totals are added up first, so that no task numbers all.
    """
    books = settle(
        profile.groupBy("workbook").agg((F.max("sheet_idx") + 1).cast("bigint").alias("_n"))
        .repartitionByRange("workbook").withColumn("_part", F.spark_partition_id())
    )
    parts = books.groupBy("_part").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("workbook").rowsBetween(Window.unboundedPreceding, -1)
    return books.join(F.broadcast(starts), "_part").select("workbook", (F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("book"))


def ordinal(book: Column, sheet_idx: Column, row: Column) -> Column:
    """Sequence number of a row; a number beyond its bits is an error, never another row's."""
    number = book + sheet_idx
    fits = number.between(0, (1 << SHEET_BITS) - 1) & row.between(0, (1 << ROW_BITS) - 1)
    return F.when(fits, F.shiftleft(number, ROW_BITS) + row).otherwise(F.raise_error("a sheet or row number has too many bits").cast("bigint"))


def project_rows(grid: DataFrame, profile: DataFrame, semantics: list[str]) -> DataFrame:
    """Data rows of the profiled sheets as columns named by meaning.

    Blank and missing cells are the empty text.  Rows are shuffled by row, so one
    very long sheet spreads over all tasks.
    """
    sheets = profile.select(*SHEET, "sheet_idx", "header_row", "column_map", "source_type", *(["image_columns"] if "image_columns" in profile.columns else []))
    sheets = sheets.join(sheet_order(profile), "workbook")
    if "image_columns" not in sheets.columns:
        sheets = sheets.withColumn("image_columns", F.array().cast("array<int>"))
    cells = spread_join(grid.drop("sheet_idx"), sheets, SHEET, "inner").filter(F.col("row") > F.col("header_row"))
    value = T.strip("value")
    picked = [
        F.coalesce(F.max(F.when(F.col("column_map")[s] == F.col("col"), value)), F.lit("")).alias(s) for s in semantics
    ]
    is_image = F.array_contains("image_columns", F.col("col")) & (value != "")
    refs = F.array_sort(F.collect_list(F.when(is_image, F.struct("col", value.alias("v")))))
    return (
        cells.groupBy(*SHEET, "row")
        .agg(
            F.first("sheet_idx").alias("sheet_idx"), F.first("book").alias("book"),
            F.first("source_type").alias("source_type"), F.first("column_map").alias("column_map"),
            *picked, refs.alias("_refs"),
        )
        .withColumn("ord", ordinal(F.col("book"), F.col("sheet_idx"), F.col("row")))
        .withColumn("image_count", F.size("_refs"))
        .withColumn("image_refs", F.array_join(F.transform("_refs", lambda r: r["v"]), " | "))
        .drop("_refs", "book", "sheet_idx")
    )


REVIEW_FIELDS = [s for s in H.REVIEW_ALIASES if s != "image_count"]


def product_lookup(grid: DataFrame, pack: HeaderPack = REVIEW_HEADERS) -> DataFrame:
    """(kind, key) -> image and link of the first row that carries it."""
    return _lookup(grid, settle(review_profile(grid, pack)))


def _lookup(grid: DataFrame, profile: DataFrame) -> DataFrame:
    profile = profile.filter(
        F.map_contains_key("column_map", F.lit("product_image")) | F.map_contains_key("column_map", F.lit("product_link"))
    )
    kinds = ("asin", "product_name", "scene_name", "keyword_source")
    rows = project_rows(grid, profile, [*kinds, "product_image", "product_link"]).filter(
        (F.col("product_image") != "") | (F.col("product_link") != "")
    )
    return lookup_from_rows(settle(rows), kinds)


def lookup_from_rows(rows: DataFrame, kinds=("asin", "product_name", "scene_name", "keyword_source")) -> DataFrame:
    """First row per (kind, key): the winner's number is found first, then its values."""
    long = rows.select(
        "ord", "product_image", "product_link",
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])).alias("e"),
    ).filter(F.col("e.value") != "").select("ord", "product_image", "product_link", F.col("e.kind").alias("kind"), T.key("e.value").alias("key"))
    first = long.groupBy("kind", "key").agg(F.min("ord").alias("ord"))
    return first.join(rows.select("ord", "product_image", "product_link"), "ord").select("kind", "key", "product_image", "product_link")


def fill_products(rows: DataFrame, lookup: DataFrame, kinds=("asin", "product_name", "scene_name", "keyword_source")) -> DataFrame:
    """Fill blank product images (and links) from the lookup, best kind first.

    Only rows without an image are looked up.  The kinds of a row are probed as
    separate narrow rows, so wide rows are shuffled once and hot keys are handled
    by ``spread_join``.
    """
    probe = (
        rows.filter(F.col("product_image") == "")
        .select("ord", F.posexplode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])).alias("prio", "e"))
        .filter(F.col("e.value") != "")
        .select("ord", "prio", F.col("e.kind").alias("kind"), T.key("e.value").alias("key"))
    )
    found = spread_join(probe, lookup.select("kind", "key", F.col("product_image").alias("_image"), F.col("product_link").alias("_link")), ["kind", "key"], "inner")
    best = found.groupBy("ord").agg(F.min(F.struct("prio", "_image", "_link")).alias("_hit")).select("ord", "_hit._image", "_hit._link")
    return (
        rows.join(best, "ord", "left")
        .withColumn("product_image", F.when(F.col("product_image") == "", F.coalesce("_image", F.lit(""))).otherwise(F.col("product_image")))
        .withColumn("product_link", T.first_filled("product_link", "_link"))
        .drop("_image", "_link")
    )


def collect_reviews(grid: DataFrame, focus: str | None = None, sheet: str | None = None, pack: HeaderPack = REVIEW_HEADERS) -> DataFrame:
    """Review records of all candidate sheets.

    The sheet profiles (one small row per sheet) and the mapped rows are stored on the
    way, because the product lookup reads them again.
    """
    profiles = settle(review_profile(grid, pack))
    profile = profiles.filter("candidate")
    if sheet:
        profile = profile.filter(F.col("sheet") == sheet)
    rows = project_rows(grid, profile, REVIEW_FIELDS)
    rows = (
        rows.withColumn("record_id", F.concat_ws("-", "sheet", "row"))
        .withColumn("focus_name", F.lit(focus or ""))
        .withColumnsRenamed({"sheet": "source_sheet", "row": "source_row"})
        .withColumn("store", T.first_filled("store", F.lit(MISSING)))
        .withColumn("country", T.first_filled("country", F.lit(MISSING)))
        .withColumn("cleaned_comment", T.review_text("translated_title", "translated_comment", "raw_title", "raw_comment"))
        .drop("column_map")
    )
    return filter_focus(fill_products(settle(rows), _lookup(grid, profiles)), focus)


def collect_feedback(grid: DataFrame, product: str, sheet: str | None = None, pack: HeaderPack = RETURN_HEADERS) -> DataFrame:
    """Return and after-sales records of one product."""
    target = product_name(F.lit(product))
    profile = settle(return_profile(grid, pack)).filter("candidate AND has_text")
    if sheet:
        profile = profile.filter(F.col("sheet") == sheet)
    by_name = F.array_contains(F.array_union("sheet_products", "workbook_products"), target) | F.contains(
        F.replace(F.upper("sheet"), F.lit(" "), F.lit("")), F.replace(target, F.lit(" "), F.lit(""))
    )
    profile = profile.withColumn("sheet_match", by_name)
    fields = [s for s in pack.aliases if s not in ("source_row_id", "order_id")]
    rows = project_rows(grid, profile, fields).join(profile.select(*SHEET, "sheet_match"), SHEET)
    has_column = F.map_contains_key("column_map", F.lit("product_name"))
    rows = rows.filter(F.when(has_column, F.array_contains(product_tokens("product_name"), target)).otherwise(F.col("sheet_match")))
    return feedback_fields(
        rows.withColumn("product_name", target)
        .withColumn("record_id", F.concat_ws("-", target, "sheet", "row"))
        .withColumnsRenamed({"sheet": "source_sheet", "row": "source_row"})
        .withColumn("store", T.first_filled("store", F.lit(MISSING)))
        .withColumn("country", T.first_filled("country", F.lit(MISSING)))
        .withColumn(
            "text_expected",
            (F.col("source_type") == "return")
            & (F.map_contains_key("column_map", F.lit("raw_comment")) | F.map_contains_key("column_map", F.lit("translated_comment"))),
        )
        .drop("column_map", "sheet_match", "image_count", "image_refs")
    ).drop("text_expected")


def feedback_text(translated, raw, reason) -> Column:
    """First valid one of the texts, stripped; pass null for one not to be used."""
    tries = [F.when(~is_invalid_feedback(c), T.strip(c)) for c in (translated, raw, reason) if c is not None]
    return F.coalesce(*tries, F.lit(""))


def feedback_fields(df: DataFrame) -> DataFrame:
    """Comment choice, validity and risk flags.

    Where a return sheet has a comment column (``text_expected``), a row needs free
    text: its reason code alone does not count.
    """
    free = has_key("translated_comment") | has_key("raw_comment")
    with_reason = feedback_text("translated_comment", "raw_comment", "return_reason")
    without = feedback_text("translated_comment", "raw_comment", None)
    d = df.withColumn("cleaned_comment", F.when(F.col("text_expected"), without).otherwise(with_reason))
    valid = ~is_invalid_feedback("cleaned_comment")
    return (
        d.withColumn("is_valid_feedback", F.when(F.col("text_expected"), free & valid).otherwise(valid))
        .withColumn("severity", severity("cleaned_comment", *LEVELS))
        .withColumn("is_user_reason", is_user_reason(*LEVELS[:3]))
        .withColumn("is_quality_risk", is_quality_risk("cleaned_comment", *LEVELS[:3]))
    )


# ---- candidates for a focus or a product --------------------------------------------------

def _within(rows: int | None) -> Column:
    """Data rows of a sheet: all, or the first ``rows`` as a sample."""
    below = F.col("row") > F.col("header_row")
    return below if rows is None else below & (F.col("row") <= F.col("header_row") + rows)


def focus_candidates(grid: DataFrame, pack: HeaderPack = REVIEW_HEADERS, rows: int | None = None, top: int = 20) -> DataFrame:
    """The ``top`` most frequent product, scene and keyword values, with their position.

    ``rows`` reads only so many rows of each sheet; all, when it is not given.
    """
    profiles = settle(review_profile(grid, pack))
    profile = profiles.filter("candidate").join(sheet_order(profiles), "workbook")
    names = ("product_name", "scene_name", "keyword_source")
    entries = profile.select(*SHEET, "book", "sheet_idx", "header_row", F.explode("column_map").alias("semantic", "col"))
    entries = entries.filter(F.col("semantic").isin(*names))
    step = F.when(F.col("semantic") == names[0], 0).when(F.col("semantic") == names[1], 1).otherwise(2)
    entries = entries.groupBy(*SHEET, "col").agg(  # unique: two meanings may share a column
        F.first("book").alias("book"), F.first("sheet_idx").alias("idx"), F.first("header_row").alias("header_row"),
        F.collect_list(step).alias("steps"),
    )
    values = (
        spread_join(grid.select(*SHEET, "row", "col", "value"), entries, [*SHEET, "col"], "inner").filter(_within(rows))
        .select(T.strip("value").alias("name"), "book", "idx", "row", F.explode("steps").alias("step"))
        .filter(F.col("name") != "")
        .select("name", F.struct("book", F.col("idx").alias("sheet_idx"), "step", "row").alias("seen"))
    )
    titles = profile.select(F.col("sheet").alias("name"), F.struct("book", "sheet_idx", F.lit(3).alias("step"), F.lit(0).alias("row")).alias("seen"))
    counts = values.unionByName(titles).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    first = counts.orderBy(F.desc("n"), "seen").limit(top)
    return first.select("name", "n", F.row_number().over(Window.orderBy(F.desc("n"), "seen")).alias("position"))  # ``top`` rows


def product_candidates(grid: DataFrame, pack: HeaderPack = RETURN_HEADERS, rows: int | None = None) -> DataFrame:
    """Model codes by where they are seen: workbook name, sheet names, product columns.

    ``rows`` reads only so many rows of each sheet; all, when it is not given.
    """
    profiles = settle(return_profile(grid, pack))
    profile = profiles.join(sheet_order(profiles), "workbook")

    def rank(stage, sheet_idx, freq, row, pos):
        return F.struct(
            F.col("book"), sheet_idx.cast("int").alias("s"), F.lit(stage).alias("stage"), (-freq).cast("bigint").alias("freq"),
            F.struct(row.cast("bigint").alias("row"), pos.cast("int").alias("p")).alias("pos"),
        )

    none = F.lit(0)
    books = profile.groupBy("workbook", "book").agg(F.first("workbook_products").alias("t"))
    from_books = books.select(F.posexplode("t").alias("pos", "product"), "book").select("product", rank(0, F.lit(-1), none, none, F.col("pos")).alias("r"))
    from_names = profile.filter("candidate").select("book", "sheet_idx", F.posexplode("sheet_products").alias("pos", "product")).select("product", rank(1, F.col("sheet_idx"), none, none, F.col("pos")).alias("r"))
    entries = profile.filter("has_text").select(*SHEET, "book", F.col("sheet_idx").alias("idx"), "header_row", F.col("column_map")["product_name"].alias("col")).filter(F.col("col").isNotNull())
    tokens = (
        spread_join(grid.select(*SHEET, "row", "col", "value"), entries, [*SHEET, "col"], "inner").filter(_within(rows))
        .select("book", "idx", "row", F.posexplode(product_tokens("value")).alias("p", "product"))
        .groupBy("book", "idx", "product").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "p")).alias("at"))
        .select("product", rank(2, F.col("idx"), F.col("n"), F.col("at.row"), F.col("at.p")).alias("r"))
    )
    merged = from_books.unionByName(from_names).unionByName(tokens)
    return merged.groupBy("product").agg(F.min("r").alias("seen")).orderBy("seen").select("product", F.col("seen.stage").alias("stage"))
