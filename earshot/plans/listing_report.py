"""Report tables over listings, reviews and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from earshot.functions import text as T
from earshot.operators import listings as L


def _yes(c):
    return F.when(c, "是").otherwise("否")


def review_table(reviews: DataFrame, images: int | None = None) -> DataFrame:
    """Reviews of a product, ready to be read; ``images`` picture columns, as many as the data need if not given."""
    images = _picture_columns(reviews) if images is None else images
    return reviews.select(
        F.col("reviewId").alias("评论ID"), T.text_of("author").alias("用户名称"), F.col("rating").alias("评分"),
        T.text_of("ratingText").alias("评分文本"), T.text_of("title").alias("评论标题"), T.text_of("body").alias("评论内容"),
        T.review_date("dateText").alias("评论时间"), T.text_of("dateText").alias("原始时间文本"),
        _yes(F.col("verifiedPurchase")).alias("是否认证购买"), F.size("images").alias("图片数量"),
        T.list_text("sourceViews").alias("来源视图"), *L.image_cells(images),
    )


def image_table(reviews: DataFrame) -> DataFrame:
    return L.image_rows(reviews).select(
        F.col("reviewId").alias("评论ID"), T.text_of("author").alias("用户名称"), F.col("rating").alias("评分"),
        T.text_of("title").alias("评论标题"), T.review_date("dateText").alias("评论时间"),
        F.col("image.imageIndex").alias("图片序号"), T.text_of("image.localPath").alias("图片路径"),
    )


def product_summary(reviews: DataFrame) -> DataFrame:
    return L.review_totals(reviews, "asin")


def candidate_table(selected: DataFrame) -> DataFrame:
    return selected.select(
        F.col("scenarioId").alias("场景编号"), F.col("scenarioLabel").alias("场景名称"), _yes(F.col("kept")).alias("是否保留"),
        T.list_text("matchedKeywords").alias("关键词来源"), F.col("asin").alias("ASIN"), F.col("title").alias("商品标题"),
        T.text_of("imageUrl").alias("商品图片"), F.col("productUrl").alias("商品链接"), F.col("price").alias("价格"),
        F.col("ratingAverage").alias("星级"), F.col("ratingCount").alias("评论数"), T.text_of("brand").alias("品牌"),
        _yes(F.col("selectedForExecution")).alias("是否入选执行"), F.col("executionRank").alias("执行排序"),
    )


def _picture_columns(reviews: DataFrame) -> int:
    return L.image_columns_needed(reviews).first()["max_images"]


def review_details(attached: DataFrame, images: int | None = None) -> DataFrame:
    images = _picture_columns(attached) if images is None else images
    return attached.select(
        F.col("scenarioLabel").alias("场景名称"), T.list_text("matchedKeywords").alias("关键词来源"),
        F.col("productTitle").alias("商品标题"), F.col("asin").alias("ASIN"), T.text_of("author").alias("用户名称"),
        F.col("rating").alias("评分"), T.text_of("ratingText").alias("评分文本"), T.text_of("title").alias("评论标题"),
        T.text_of("body").alias("评论内容"), T.after_on("dateText").alias("评论时间"),
        _yes(F.col("verifiedPurchase")).alias("是否认证购买"), T.list_text("sourceViews").alias("来源视图"),
        F.size("images").alias("图片数量"), *L.image_cells(images),
    )


def run_table(status: DataFrame) -> DataFrame:
    return status.select(
        F.col("scenarioLabel").alias("场景名称"), F.col("title").alias("商品标题"), F.col("asin").alias("ASIN"),
        F.col("productUrl").alias("商品链接"), F.col("price").alias("价格"), F.col("ratingAverage").alias("星级"),
        F.col("ratingCount").alias("搜索页评论数"), F.col("reviewCount").alias("实际抓取评论数"),
        F.col("imageReviewCount").alias("带图评论数"), F.col("imageCount").alias("图片总数"),
        T.text_of("jsonPath").alias("JSON 路径"), T.text_of("mediaDir").alias("图片目录"), F.col("status").alias("抓取状态"),
    )


def preview(selected: DataFrame, top_n: int = 5, collation: str = L.LOCALE) -> DataFrame:
    """Kept products with most reviews, at most ten."""
    order = [F.desc(F.coalesce("ratingCount", F.lit(0))), *L.candidate_order(collation)]
    best = selected.filter("kept").orderBy(*order).limit(min(top_n, 10))
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "title", "asin", "ratingCount", "scenarioLabel")


def preflight(selected: DataFrame, numbered: DataFrame, top_n: int = 5, collation: str = L.LOCALE) -> DataFrame:
    """One row: the text in which a run is confirmed.

    Scenarios are few (fixed patterns and the keywords of the run); the preview has
    at most ten products.
    """
    lines = numbered.agg(F.array_sort(F.collect_list(F.struct("scenarioId", "scenarioLabel", "candidateCount", "kept"))).alias("s"))
    prev = preview(selected, top_n, collation).agg(F.array_sort(F.collect_list(F.struct("pos", "title", "asin", "ratingCount", "scenarioLabel"))).alias("p"))
    d = L.estimate(selected, numbered).withColumn("s", lines.scalar()).withColumn("p", prev.scalar())
    text = lambda c: c.cast("string")
    scenario_lines = F.array_join(F.transform("s", lambda x: F.concat(
        text(x["scenarioId"]), F.when(x["kept"], ". ").otherwise(". [已排除] "), x["scenarioLabel"], F.lit(" ("), text(x["candidateCount"]), F.lit("个候选商品)"),
    )), "\n")
    kept_ids = F.array_join(F.transform(F.filter("s", lambda x: x["kept"]), lambda x: text(x["scenarioId"])), "、")
    preview_lines = F.array_join(F.transform("p", lambda x: F.concat(
        text(x["pos"]), F.lit(". "), x["title"], F.lit(" | ASIN "), x["asin"], F.lit(" | 评论数 "), text(F.coalesce(x["ratingCount"], F.lit(0))), F.lit(" | 场景 "), x["scenarioLabel"],
    )), "\n")
    full = F.concat_ws(
        "\n", F.lit("编号场景清单："), scenario_lines, F.lit(""),
        F.concat(F.lit("当前范围共覆盖 "), text(F.col("keptScenarioCount")), F.lit(" 个品类")),
        F.concat(F.lit("预计需抓取 "), text(F.col("candidateCount")), F.lit(" 个商品")),
        F.concat(F.lit("预计涉及 "), T.count_text("estimatedReviewCount"), F.lit(" 条评论")),
        F.lit(f"正式执行默认抓取评论数最高的 Top {top_n} 商品"), F.lit(""),
        F.concat(F.lit("当前保留场景："), F.when(kept_ids != "", kept_ids).otherwise("无")),
        F.lit("如需继续排除，请回复：不搜索：编号1、编号2"), F.lit("确认无误后，请回复：开始执行"),
        F.when(F.size("p") > 0, F.concat(F.lit("\n当前入选执行商品预览：\n"), preview_lines)),
    )
    return d.select("keptScenarioCount", "candidateCount", "estimatedReviewCount", "executionProductCount", full.alias("text"))
