"""Product listings and their reviews, collected from several searches and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions import text as T
from earshot.operators.skew import label_join, number_read, settle, spread_join
from earshot.packs import listings as LP

LOCALE = "UNICODE"

# ---- reviews seen in several views ---------------------------------------------

def merge_reviews(views: DataFrame) -> DataFrame:
    """One row per (asin, reviewId): longest texts, most pictures, first other values.

    ``ord`` is the order of reading: view by view, top to bottom.  Ties keep what
    was read first.
    """
    def best(c, size):
        return F.max_by(c, F.struct(F.coalesce(size, F.lit(0)), -F.col("ord"))).alias(c)

    def first(c):
        return F.min_by(c, "ord").alias(c)

    seen = F.array_sort(F.collect_set(F.struct("view_ord", "view_label")))  # at most one per view
    return (
        views.filter(~T.blank("reviewId"))
        .groupBy("asin", "reviewId")
        .agg(
            *[best(c, F.length(c)) for c in ("body", "title", "author", "dateText")],
            best("images", F.size("images")),
            *[first(c) for c in ("rating", "ratingText", "verifiedPurchase")],
            F.transform(seen, lambda s: s["view_label"]).alias("sourceViews"),
        )
    )


def review_order() -> list[Column]:
    """Sorting of a product's reviews: rating, then id in locale order."""
    return [F.desc(F.coalesce("rating", F.lit(0.0))), F.collate("reviewId", "UNICODE")]


def order_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with their ``position`` in their product's output order, from 1.

    One sort over all products: ranges are cut by the whole order, so a product with a third
    of the reviews lies in many tasks.
    """
    return number_read(reviews.orderBy("asin", *review_order()), "asin", "position")


def reviews_per_view(views: DataFrame) -> DataFrame:
    return views.groupBy("asin", "view_label").agg(F.count(F.lit(1)).alias("n"))


# ---- candidates seen for several keywords and pages -------------------------------

def parse_hits(raw: DataFrame) -> DataFrame:
    """Numbers of raw search cards; cards without id, title or link are left out."""
    texts = ("asin", "title", "productUrl", "priceText", "ratingText", "ratingCountText", "brand", "imageUrl")
    d = raw.withColumns({c: T.collapse(c) for c in texts})
    d = d.withColumns({
        "price": T.price("priceText"), "ratingAverage": T.rating_average("ratingText"), "ratingCount": T.rating_count("ratingCountText"),
    })
    return d.filter((F.col("asin") != "") & (F.col("title") != "") & (F.col("productUrl") != ""))


def merge_candidates(hits: DataFrame) -> DataFrame:
    """One row per product; ``ord`` is the order in which the hits were seen."""
    def first_where(c, condition):
        return F.min_by(c, F.when(condition, F.col("ord"))).alias(c)

    # keywords are reduced first, so a product seen endlessly often stays small
    words = hits.groupBy("asin", "keyword").agg(F.min("ord").alias("ord")).groupBy("asin").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "keyword"))), lambda x: x["keyword"]).alias("matchedKeywords")
    )
    merged = hits.groupBy("asin").agg(
        F.min("ord").alias("ord"),
        F.max(F.coalesce("ratingCount", F.lit(0))).alias("ratingCount"),
        first_where("ratingAverage", F.coalesce("ratingAverage", F.lit(0.0)) != 0),
        first_where("price", F.col("price").isNotNull()),
        *[first_where(c, F.coalesce(F.col(c), F.lit("")) != "") for c in ("priceText", "brand", "categoryHint")],
        *[F.min_by(c, "ord").alias(c) for c in ("title", "productUrl", "imageUrl", "marketplace", "searchPage")],
    )
    return merged.join(words, "asin")


def hits_per_page(hits: DataFrame) -> DataFrame:
    return hits.groupBy("keyword", "searchPage").agg(F.count(F.lit(1)).alias("n"))


def passes(min_rating: float | None = None, price_min: float | None = None, price_max: float | None = None, category: str | None = None) -> Column:
    """Limits of a search; an unknown rating or price passes."""
    tests = [
        (F.col("ratingAverage") >= min_rating) if min_rating is not None else None,
        (F.col("price") >= price_min) if price_min is not None else None,
        (F.col("price") <= price_max) if price_max is not None else None,
    ]
    out = F.lit(True)
    for t in tests:
        if t is not None:
            out = out & F.coalesce(t, F.lit(True))
    if category:
        tokens = T.category_tokens(F.lit(category))
        title = F.lower(T.collapse("title"))
        out = out & ((F.size(tokens) == 0) | F.exists(tokens, lambda k: F.contains(title, k)))
    return out


def candidate_order(collation: str = LOCALE) -> list[Column]:
    """Most reviews, best rating, then title by ``collation``: locale order, or ``UTF8_BINARY`` for code points."""
    return [F.desc(F.coalesce("ratingCount", F.lit(0))), F.desc(F.coalesce("ratingAverage", F.lit(0.0))), F.collate(T.text_of("title"), collation), F.col("ord")]


# ---- scenarios ------------------------------------------------------------------------

def keyword_label(c, pack=LP) -> Column:
    """Label of a search keyword; CJK keywords stand for themselves."""
    source = T.collapse(c)
    label = F.lower(source)
    for pattern, word in pack.KEYWORD_WORDS:
        label = F.regexp_replace(label, pattern, word)
    label = T.collapse(F.regexp_replace(F.regexp_replace(label, r"\band\b", " "), r"[()]", " "))
    return (
        F.when(source == "", pack.KEYWORD_DEFAULT)
        .when(source.rlike(r"[\x{4e00}-\x{9fff}]"), source)
        .otherwise(T.first_filled(label, source))
    )


def scenario_label(title, keywords, pack=LP) -> Column:
    """First scenario pattern found in the title, else the first keyword's label."""
    hay = F.lower(T.collapse(title))
    out = None
    for pattern, label in pack.SCENARIO_PATTERNS:
        out = F.when(hay.rlike(pattern), label) if out is None else out.when(hay.rlike(pattern), label)
    return out.otherwise(keyword_label(T.first_filled(F.get(keywords, F.lit(0)), T.col(title)), pack))


def with_scenario(candidates: DataFrame, pack=LP) -> DataFrame:
    return candidates.withColumn("scenarioLabel", scenario_label("title", F.col("matchedKeywords"), pack))


def scenarios(candidates: DataFrame, excluded: DataFrame | None = None, collation: str = LOCALE) -> DataFrame:
    """Numbered scenarios: most products first, then label by ``collation``, then by its characters.

    Search keywords become labels, so their number is open: the counts are sorted over
    ranges, and a range is numbered from the sizes of those before it.  The members of
    a scenario are ``scenario_members``.
    """
    counted = settle(candidates.groupBy("scenarioLabel").agg(F.count_distinct("asin").alias("candidateCount")))
    ranked = counted.orderBy(F.desc("candidateCount"), F.collate("scenarioLabel", collation), "scenarioLabel")
    d = number_read(ranked.withColumn("_all", F.lit(0)), "_all", "scenarioId")
    d = d.select(F.col("scenarioId").cast("int"), "scenarioLabel", "candidateCount")
    if excluded is None:
        return d.withColumn("kept", F.lit(True))
    out = excluded.select(F.col("scenario_id").alias("scenarioId")).distinct().withColumn("_out", F.lit(True))
    return d.join(out, "scenarioId", "left").withColumn("kept", F.col("_out").isNull()).drop("_out")


def scenario_members(candidates: DataFrame, numbered: DataFrame) -> DataFrame:
    """(scenarioId, scenarioLabel, asin), one row per product: no list grows with the data."""
    return label_join(candidates.select("scenarioLabel", "asin").distinct(), numbered.select("scenarioLabel", "scenarioId"), "scenarioLabel", "asin", "inner")


def add_exclusions(numbered: DataFrame, earlier: DataFrame, wanted: DataFrame) -> DataFrame:
    """Earlier exclusions and those of the wanted numbers that exist."""
    known = numbered.select(F.col("scenarioId").alias("scenario_id"))
    return earlier.select("scenario_id").union(wanted.select("scenario_id").intersect(known)).distinct().orderBy("scenario_id")


def select_products(candidates: DataFrame, numbered: DataFrame, top_n: int = 5, collation: str = LOCALE) -> DataFrame:
    """All candidates with scenario, ``kept``, ``selectedForExecution`` and rank."""
    d = label_join(candidates, numbered.select("scenarioLabel", "scenarioId", "kept"), "scenarioLabel", "asin")
    order = candidate_order(collation)
    best = d.filter("kept").orderBy(*order).limit(top_n)
    ranks = best.select("asin", F.row_number().over(Window.orderBy(*order)).alias("executionRank"))  # top_n rows
    return (
        d.join(ranks, "asin", "left")
        .withColumn("selectedForExecution", F.col("executionRank").isNotNull())
    )


def kept_candidates(selected: DataFrame, collation: str = LOCALE) -> DataFrame:
    return selected.filter("kept").orderBy(*candidate_order(collation))


def estimate(selected: DataFrame, numbered: DataFrame) -> DataFrame:
    """One row with the size of the planned run."""
    return selected.agg(
        F.count_if(F.col("kept")).alias("candidateCount"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.coalesce("ratingCount", F.lit(0)))), F.lit(0)).alias("estimatedReviewCount"),
        F.count_if(F.col("selectedForExecution")).alias("executionProductCount"),
    ).withColumn("keptScenarioCount", numbered.agg(F.count_if(F.col("kept"))).scalar())


# ---- runs ------------------------------------------------------------------------------

def attach_reviews(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of the successful products with the product's fields."""
    p = products.filter(F.col("status") == "success").select("asin", "title", "productUrl", "scenarioLabel", "matchedKeywords")
    p = p.withColumnsRenamed({"title": "productTitle"})
    return spread_join(reviews, p, ["asin"], "inner")


def review_totals(reviews: DataFrame, *by: str) -> DataFrame:
    size = F.coalesce(F.size("images"), F.lit(0))
    return reviews.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reviewCount"), F.count_if(size > 0).alias("imageReviewCount"),
        F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).cast("bigint").alias("imageCount"),
    )


def run_status(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Planned products with what their run brought; no reviews means failed."""
    d = products.join(review_totals(reviews, "asin"), "asin", "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("reviewCount", "imageReviewCount", "imageCount")})
    return d.withColumn("status", F.when(F.col("reviewCount") > 0, "success").otherwise("failed"))


def run_outcome(status: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return status.agg(F.count_if(ok).alias("successfulProducts"), F.count_if(~ok).alias("failedProducts"))


def still_to_do(planned: DataFrame, earlier: DataFrame) -> DataFrame:
    """Planned products that no earlier run has reviews for."""
    return planned.join(earlier.filter("reviewCount > 0").select("asin"), "asin", "left_anti")


def rating_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.filter("rating IS NOT NULL").groupBy("rating").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("rating"))


def image_columns_needed(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.coalesce(F.max(F.size("images")), F.lit(0)).alias("max_images"))


def image_rows(reviews: DataFrame) -> DataFrame:
    """One row per picture of a review."""
    return reviews.withColumn("image", F.explode("images"))


def image_cells(count: int) -> list[Column]:
    """``图片1..n`` and the joined local paths."""
    paths = F.filter(F.transform("images", lambda i: T.text_of(i["localPath"])), lambda p: p != "")
    cells = [T.text_of(F.get("images", F.lit(i))["localPath"]).alias(f"图片{i + 1}") for i in range(count)]
    return [F.coalesce(F.array_join(paths, "\n"), F.lit("")).alias("图片路径"), *cells]


def product_image(products: DataFrame, files: DataFrame) -> DataFrame:
    """Picture file named after the product; jpg before jpeg, png and webp."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kinds = T.words("jpg", "jpeg", "png", "webp")
    f = files.select(
        F.regexp_extract(name, r"^(.+)\.[^.]+$", 1).alias("asin"), "path",
        F.array_position(kinds, F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("_rank"),
    ).filter(F.col("_rank") > 0)
    # a product may have pictures in several folders: the smallest path of the first kind
    best = f.groupBy("asin").agg(F.min(F.struct("_rank", "path"))["path"].alias("image_path"))
    return spread_join(products, best, ["asin"])


def picture_plan(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates with ``status`` of their picture, the file they have and the one to write.

    ``failed`` without a product number or link; ``skipped`` if a file of an earlier run is named
    after the product (``image_path``); else ``fetch``, into ``destination``, which is null while
    the picture's address is unknown and the product's page has to be opened first.
    """
    known = product_image(candidates, files)
    unusable = (T.text_of("asin") == "") | (T.text_of("productUrl") == "")
    status = F.when(unusable, "failed").when(F.col("image_path").isNotNull(), "skipped").otherwise("fetch")
    named = (F.col("status") == "fetch") & (T.text_of("imageUrl") != "")
    return known.withColumn("status", status).withColumn("destination", F.when(named, F.concat("asin", T.url_extension("imageUrl"))))


def pictures_to_fetch(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates without a picture from an earlier run."""
    return picture_plan(candidates, files).filter("status = 'fetch'").select(*candidates.columns, "destination")
