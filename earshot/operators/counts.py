"""Counting tagged reviews.

All label layers come from finite packs, so their combinations form a small table:
``label_counts`` reads the tagged rows once and every count, share, matrix and
narrative is taken from its result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions import text as T
from earshot.operators.skew import small_side
from earshot.packs import reviews as VP

DIMS = ("feature", "secondary_need", "need", "scene", "signal", "polarity", "intensity", "emotion", "aha")


def label_counts(tagged: DataFrame, dims=DIMS) -> DataFrame:
    """Rows and first sequence number per combination of labels, of all or of those named."""
    return tagged.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def total(counts: DataFrame) -> Column:
    """Number of tagged rows, at least 1, as a scalar."""
    return counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).scalar()


def fold(counts: DataFrame, *dims) -> DataFrame:
    """Counts over some of the dimensions."""
    return counts.groupBy(*dims).agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))


def with_share(df: DataFrame, counts: DataFrame) -> DataFrame:
    return df.withColumn("share", F.col("n") / total(counts))



def blocks(counts: DataFrame) -> DataFrame:
    """(block, name, parent, n, first_ord) for all one- and two-label rankings.

    One pass: every combination row is listed under each block it counts for.
    """
    c = F.col

    def entry(block, name, parent=None, condition=None):
        e = F.struct(F.lit(block).alias("block"), c(name).alias("name"), (c(parent) if parent else F.lit("")).alias("parent"))
        return e if condition is None else F.when(condition, e)

    entries = [
        entry("feature", "feature"),
        entry("secondary", "secondary_need"),
        entry("need", "need"),
        entry("scene", "scene"),
        entry("feature_secondary", "secondary_need", "feature"),
        entry("feature_scene", "scene", "feature"),
        entry("likes", "secondary_need", condition=c("signal") == "喜欢什么"),
        entry("churn", "secondary_need", condition=c("signal") == "放弃采用"),
        entry("requests", "secondary_need", condition=c("signal") == "合理增配"),
        entry("negative_emotion", "emotion", condition=c("polarity") == "负向"),
        entry("positive_emotion", "emotion", condition=c("polarity") == "正向"),
        entry("aha_scene", "scene", condition=c("aha") == "是"),
        entry("aha_secondary", "secondary_need", condition=c("aha") == "是"),
    ]
    long = counts.select(F.explode(F.array_compact(F.array(*entries))).alias("e"), "n", "first_ord")
    return fold(long.select("e.block", "e.name", "e.parent", "n", "first_ord"), "block", "name", "parent")


def ranked(block_rows: DataFrame, k: int | None = None) -> DataFrame:
    """Rank inside each block: most rows first, then first seen."""
    w = Window.partitionBy("block").orderBy(F.desc("n"), "first_ord", "parent", "name")
    d = block_rows.withColumn("rank", F.row_number().over(w))
    return d if k is None else d.filter(F.col("rank") <= k)


def top(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("n"), "first_ord").limit(k)


def modal(counts: DataFrame, by: str, value: str) -> DataFrame:
    """Most frequent value per group; on ties the one seen first."""
    return fold(counts, by, value).groupBy(by).agg(
        F.max_by(value, F.struct(F.col("n"), -F.col("first_ord"))).alias(value)
    )


def grouped_listing(counts: DataFrame, parent: str, child: str) -> DataFrame:
    """Parents by total (then first seen), children by count, then name."""
    pairs = fold(counts, parent, child)
    w = Window.partitionBy(parent)
    return (
        pairs.withColumn("parent_n", F.sum("n").over(w))
        .withColumn("parent_first", F.min("first_ord").over(w))
        .orderBy(F.desc("parent_n"), "parent_first", F.desc("n"), child)
    )


# ---- emotions --------------------------------------------------------------------

def top_emotions(counts: DataFrame, limit: int) -> Column:
    """Scalar array of the most frequent non-neutral emotions.

    On ties a negative label precedes a positive one, then the first seen.
    """
    seen = fold(counts.filter(F.col("polarity") != "中性"), "emotion", "polarity")
    best = seen.orderBy(F.desc("n"), (F.col("polarity") == "正向").cast("int"), "first_ord").limit(limit)
    key = F.struct((-F.col("n")).alias("n"), (F.col("polarity") == "正向").cast("int").alias("p"), "first_ord", "emotion")
    listed = best.agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["emotion"]).alias("l"))
    return listed.select(F.when(F.size("l") > 0, F.col("l")).otherwise(F.array(F.lit("满意认可")))).scalar()


def emotion_matrix(counts: DataFrame, dim: str, limit: int = 8, rows: int | None = None) -> DataFrame:
    """(row, emotion, n) with zeros: rows by frequency, columns by ``top_emotions``."""
    by = (
        fold(counts, dim, "emotion")
        .groupBy(dim)
        .agg(
            F.sum("n").alias("row_n"), F.min("first_ord").alias("row_first"),
            F.map_from_entries(F.collect_list(F.struct("emotion", "n"))).alias("cells"),  # at most one per label
        )
    )
    if rows is not None:
        by = by.orderBy(F.desc("row_n"), "row_first").limit(rows)
    return by.select(dim, "row_n", "row_first", "cells", F.posexplode(top_emotions(counts, limit)).alias("emotion_pos", "emotion")).select(
        dim, "emotion", "emotion_pos", F.coalesce(F.col("cells")[F.col("emotion")], F.lit(0)).alias("n"), "row_n", "row_first"
    )


def emotion_details(counts: DataFrame) -> DataFrame:
    """Every feature and emotion with its polarity, count, share and heat note."""
    d = counts.groupBy("feature", "emotion").agg(F.min("polarity").alias("polarity"), F.sum("n").alias("n"))
    d = with_share(d, counts)
    hot = (F.col("polarity") == "负向") & (F.col("share") >= 0.03)
    return d.withColumn("note", F.when(hot, "高热负向").otherwise("重点观察")).orderBy(F.desc("n"), "feature", "emotion")


def feature_polarity(counts: DataFrame) -> DataFrame:
    def n_of(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    p, i = F.col("polarity"), F.col("intensity")
    return counts.groupBy("feature").agg(
        n_of(p == "正向").alias("positive"), n_of(p == "中性").alias("neutral"), n_of(p == "负向").alias("negative"),
        n_of((p == "负向") & (i == "强烈")).alias("strong_negative"),
    )


# ---- choosing rows ----------------------------------------------------------------

ORD_BITS = 54  # sequence numbers are below 2**54, scores (9 bits) are packed above them


AHA_SCORES, RANK_SCORES = 10, 13  # aha scores are 0..9, rank scores 0..12


def packed(high: Column, ord_col: Column) -> Column:
    """One bigint that orders by ``high`` descending, then by sequence ascending; a sequence number beyond its bits is an error."""
    fits = ord_col.isNull() | ord_col.between(0, (1 << ORD_BITS) - 1)
    refused = F.raise_error(F.lit(f"a sequence number is not between 0 and 2^{ORD_BITS}")).cast("bigint")
    return F.when(fits, F.shiftleft(high.cast("bigint"), ORD_BITS) - ord_col).otherwise(refused)


def image_score(pack=None) -> Column:
    """2 for own pictures, 1 for a product picture or link, else 0."""
    return (
        F.when(F.size(T.image_refs("image_refs")) > 0, 2)
        .when((F.size(T.image_refs("product_image")) > 0) | (T.strip("product_link") != ""), 1)
        .otherwise(0)
    )


def image_evidence() -> Column:
    """Own pictures, else the product picture, else a marked product link."""
    link = T.product_link("product_link")
    return (
        F.when(F.size(T.image_refs("image_refs")) > 0, T.text_of("image_refs"))
        .when(F.size(T.image_refs("product_image")) > 0, T.text_of("product_image"))
        .when(T.strip("product_link") != "", F.concat(F.lit("产品图回退 | "), link))
        .otherwise("")
    )


def representatives(tagged: DataFrame, by: str = "scene") -> DataFrame:
    """The row with the best picture, aha and rank score per label.

    The winner is found as a packed number by hash aggregation; its wide row is
    fetched by sequence number afterwards.
    """
    score = (image_score() * AHA_SCORES + F.col("aha_score")) * RANK_SCORES + F.col("rank_score")
    best = tagged.groupBy(by).agg(F.max(packed(score, F.col("ord"))).alias("_best"))
    # undo the packing: ord = -best modulo 2**ORD_BITS
    winners = best.select(F.pmod(-F.col("_best"), F.lit(1 << ORD_BITS)).alias("ord"))
    return tagged.join(small_side(winners), "ord", "left_semi")


def quotable(tagged: DataFrame, limit: int = 100) -> DataFrame:
    """What need profiles read of a tagged table, the comments already cut to quotes: narrow enough to be stored."""
    text = T.shorten(T.collapse(T.first_filled("translated_comment", "cleaned_comment", "raw_comment")), limit)
    return tagged.select("ord", *DIMS, "rank_score", "aha_score", text.alias("quote"))


def evidence(tagged: DataFrame, k: int = 3, limit: int = 100, shortest: int = 18) -> DataFrame:
    """Up to ``k`` different comments per need, best ranked first; takes a ``quotable`` table too, cut as it is."""
    if "quote" not in tagged.columns:
        tagged = quotable(tagged, limit)
    text = F.col("quote")
    worth = F.col("rank_score") * AHA_SCORES + F.col("aha_score")
    d = tagged.select("need", "ord", text.alias("text"), packed(worth, F.col("ord")).alias("_p")).filter(F.length("text") >= shortest)
    distinct = d.groupBy("need", F.sha2(F.lower("text"), 256).alias("_k")).agg(F.max("_p").alias("_p"))
    # the rank limit is applied map-side before the shuffle by need
    w = Window.partitionBy("need").orderBy(F.desc("_p"))
    best = distinct.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select(
        F.pmod(-F.col("_p"), F.lit(1 << ORD_BITS)).alias("ord"), "pos"
    )
    return d.select("need", "ord", "text").join(small_side(best), "ord").select("need", "pos", "text")


def need_profiles(tagged: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per need: rows, modal feature, secondary need and scene, and evidence."""
    counts = label_counts(tagged) if counts is None else counts
    quotes = evidence(tagged).groupBy("need").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("evidence")
    )
    parts = [fold(counts, "need").select("need", "n"), *[modal(counts, "need", v) for v in ("feature", "secondary_need", "scene")]]
    d = reduce(lambda a, b: a.join(b, "need"), parts).join(quotes, "need", "left")
    return d.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def aha_takeaway(pack=VP) -> Column:
    c = F.col
    product = T.first_filled(T.strip("product_name"), F.lit("该产品"))
    return (
        F.when((c("polarity") == "负向") | (c("signal") == "放弃采用"),
               F.format_string("%s 在%s里必须把%s做稳，否则用户不会继续采用。", product, c("scene"), c("secondary_need")))
        .when(c("signal") == "喜欢什么", F.format_string("%s 在%s里把%s做得更顺，用户最看重的是%s。", product, c("scene"), c("feature"), c("secondary_need")))
        .when(c("signal") == "合理增配", F.format_string("%s 的方向被认可，但用户仍明确希望它把%s做完整。", product, c("secondary_need")))
        .otherwise(F.format_string("%s用户需要一台把%s做清楚的%s产品。", c("scene"), c("secondary_need"), c("feature")))
    )


def representative_phrase() -> Column:
    c = F.col
    return (
        F.when(c("signal") == "喜欢什么", F.format_string("用户看重 %s 带来的 %s", c("feature"), c("need")))
        .when(c("signal") == "放弃采用", F.format_string("用户在 %s 上无法获得 %s", c("feature"), c("need")))
        .when(c("signal") == "合理增配", F.format_string("用户希望进一步补足 %s 以强化 %s", c("feature"), c("need")))
        .otherwise(T.shorten(T.strip("cleaned_comment"), 56))
    )


def source_text() -> Column:
    return T.first_filled(T.joined_text("\n", T.strip("raw_title"), T.strip("raw_comment")), T.strip("cleaned_comment"))
