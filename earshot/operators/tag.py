"""Tagging: every layer of labels for a cleaned review.

The comment is read once by the keyword index; the layers are decided on the
resulting small array.  Everything is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions import text as T
from earshot.functions.rules import KeywordIndex, first_label, hit, hit_count, keywords_of
from earshot.operators.skew import border
from earshot.packs import reviews as VP

LAYER_COLUMNS = tuple(VP.TAG_HEADINGS)


# what the layers made of other layers are made of
MADE_OF = {
    "aha": ("aha_score",), "relation": ("aha_score",), "originality": ("_closed", "aha_score", "need"),
    **dict.fromkeys(("persona", "place", "motivation", "chain"), ("scene", "feature", "need")),
    **dict.fromkeys(("pain", "hint", "analysis"), ("signal", "feature", "need", "scene")),
}


def comment_index(pack=VP, layers=LAYER_COLUMNS) -> KeywordIndex:
    """Keywords looked up in the comment (and in its context) for the ``layers``."""
    own = {
        "feature": keywords_of(pack.FEATURE_RULES), "scene": keywords_of(pack.SCENE_RULES),
        "secondary_need": keywords_of(pack.FEATURE_RULES, *pack.SECONDARY_RULES.values()),
    }
    if set(layers) <= set(own):
        return KeywordIndex(k for layer in layers for k in own[layer])
    words = keywords_of(
        pack.FEATURE_RULES, pack.NEED_RULES, pack.SCENE_RULES, *pack.SECONDARY_RULES.values()
    )
    for ks in (
        pack.STRONG_POSITIVE, pack.POSITIVE, pack.STRONG_NEGATIVE, pack.NEGATIVE, pack.CONVENIENCE,
        pack.NOISE, pack.CONTROL, pack.CONNECT, pack.VALUE, pack.SURPRISE, pack.DEFECT,
        pack.SUGGESTION, pack.COMPARE, pack.EXPECTATION, pack.HYPE, pack.AHA_PHRASES,
    ):
        words |= set(ks)
    return KeywordIndex(words)


def source_index(pack=VP) -> KeywordIndex:
    return KeywordIndex(keywords_of(pack.SOURCE_FEATURE_RULES, pack.SOURCE_SECONDARY_RULES))


# ---- layers, as functions of the hit arrays ---------------------------------------

def viewpoint(hits: Column, key_length: Column, rating: Column, pack=VP) -> Column:
    return (
        F.when(hit(hits, pack.HYPE) & (key_length < 50), "疑似灌水")
        .when(hit(hits, pack.DEFECT), "缺陷复现")
        .when(hit(hits, pack.SUGGESTION), "建议")
        .when(hit(hits, pack.COMPARE), "对比")
        .when(hit(hits, pack.EXPECTATION), "期望落差")
        .when((rating != 0) & (rating <= 2), "抱怨")
        .when(hit(hits, pack.STRONG_NEGATIVE, pack.NEGATIVE), "抱怨")
        .when(rating >= 4, "优点")
        .when(hit(hits, pack.STRONG_POSITIVE, pack.POSITIVE), "优点")
        .otherwise("观点其他")
    )


def feature(hits: Column, source_hits: Column, context_hits: Column, pack=VP) -> Column:
    """Comment first, then the themes of its source, then the whole context."""
    return F.coalesce(
        first_label(hits, pack.FEATURE_RULES),
        first_label(source_hits, pack.SOURCE_FEATURE_RULES),
        first_label(context_hits, pack.FEATURE_RULES, pack.FEATURE_DEFAULT),
    )


def secondary_need(hits: Column, feature_col: Column, source_hits: Column, pack=VP) -> Column:
    hint = first_label(source_hits, pack.SOURCE_SECONDARY_RULES)
    allowed = F.coalesce(
        *[F.when((hint == h) & feature_col.isin(*fs), hint) for h, fs in pack.SOURCE_SECONDARY_GUARD.items()]
    )
    rules = [F.when(feature_col == f, first_label(hits, rs)) for f, rs in pack.SECONDARY_RULES.items()]
    return F.coalesce(allowed, *rules, T.mapped(feature_col, pack.SECONDARY_BY_FEATURE, pack.SECONDARY_DEFAULT))


def need(hits: Column, feature_col: Column, pack=VP) -> Column:
    return first_label(hits, pack.NEED_RULES, T.mapped(feature_col, pack.NEED_BY_FEATURE, pack.NEED_DEFAULT))


def emotion_scores(hits: Column, rating: Column, pack=VP) -> tuple[Column, Column]:
    """Distinct emotion words found, strong ones twice, plus one for the rating."""
    low = (rating > 0) & (rating <= 2)
    positive = hit_count(hits, pack.POSITIVE) + 2 * hit_count(hits, pack.STRONG_POSITIVE) + F.when(rating >= 4, 1).otherwise(0)
    negative = hit_count(hits, pack.NEGATIVE) + 2 * hit_count(hits, pack.STRONG_NEGATIVE) + F.when(low, 1).otherwise(0)
    return positive, negative


def polarity(positive: Column, negative: Column) -> Column:
    return F.when(positive > negative, "正向").when(negative > positive, "负向").otherwise("中性")


def intensity(hits: Column, comment: Column, rating: Column, positive: Column, negative: Column, pack=VP) -> Column:
    marks = comment.rlike("[!！][^!！]*+[!！]")  # at least two
    return (
        F.when(rating.isin(1.0, 5.0) | marks | hit(hits, pack.STRONG_POSITIVE, pack.STRONG_NEGATIVE), "强烈")
        .when(rating.isin(2.0, 4.0) | (positive > 0) | (negative > 0), "中等")
        .otherwise("轻微")
    )


def emotion(hits: Column, polarity_col: Column, intensity_col: Column, viewpoint_col: Column, feature_col: Column, pack=VP) -> Column:
    positive = (
        F.when(hit(hits, pack.SURPRISE), "惊喜超预期")
        .when(hit(hits, pack.CONVENIENCE), "顺手便利")
        .when(feature_col.isin("连接", "做工"), "放心省心")
        .when((feature_col == "价格") | hit(hits, pack.VALUE), "值回票价")
        .when(feature_col == "场景", "灵感打开")
        .otherwise("满意认可")
    )
    negative = (
        F.when(hit(hits, pack.NOISE), "被噪音打断")
        .when(hit(hits, pack.CONTROL), "失控难调")
        .when(hit(hits, pack.CONNECT), "焦虑不确定")
        .when(viewpoint_col.isin("期望落差", "对比") | hit(hits, pack.EXPECTATION), "失望落差")
        .when(intensity_col == "强烈", "愤怒拒绝")
        .otherwise("烦躁麻烦")
    )
    neutral = F.when(viewpoint_col == "建议", "理性期待").when(viewpoint_col == "对比", "理性对比").otherwise("观察确认")
    return F.when(polarity_col == "正向", positive).when(polarity_col == "负向", negative).otherwise(neutral)


def trigger(emotion_col: Column, feature_col: Column) -> Column:
    return (
        F.when(emotion_col == "被噪音打断", "音质")
        .when(emotion_col == "失控难调", "音量")
        .when(emotion_col == "焦虑不确定", "连接")
        .otherwise(feature_col)
    )


def scene(context_hits: Column, pack=VP) -> Column:
    return first_label(context_hits, pack.SCENE_RULES, pack.SCENE_DEFAULT)


def signal(viewpoint_col: Column, polarity_col: Column) -> Column:
    return (
        F.when(viewpoint_col == "疑似灌水", "噪声样本")
        .when(viewpoint_col == "建议", "合理增配")
        .when(viewpoint_col.isin("抱怨", "缺陷复现", "期望落差") | (polarity_col == "负向"), "放弃采用")
        .when(viewpoint_col.isin("优点", "对比") & (polarity_col == "正向"), "喜欢什么")
        .otherwise("待归纳")
    )


def aha_closed(v: Column, s: Column, p: Column) -> Column:
    """The two gates behind which a comment gets no points."""
    return ((p == "负向") & ~v.isin("建议", "对比")) | (~s.isin("喜欢什么", "合理增配") & (v != "对比"))


def aha_points(hits: Column, key_length: Column, images: Column, v: Column, sc: Column, n: Column, pack=VP) -> Column:
    def point(condition, points=1):
        return F.when(condition, points).otherwise(0)

    return T.add(
        point(hit(hits, pack.STRONG_POSITIVE), 2),
        point(hit(hits, pack.AHA_PHRASES), 2),
        point(sc != pack.SCENE_DEFAULT),
        point(n.isin(*pack.AHA_NEEDS)),
        point(v.isin("对比", "建议")),
        point(images > 0),
        point(key_length >= 50),
    )


def ranking_score(v: Column, p: Column, i: Column, images: Column, key_length: Column, pack=VP) -> Column:
    return T.add(
        T.mapped(v, pack.VIEWPOINT_SCORE, 1),
        T.mapped(p, pack.POLARITY_SCORE, 0),
        T.mapped(i, pack.INTENSITY_SCORE, 0),
        F.when(images > 0, 1).otherwise(0),
        F.when(key_length >= 80, 2).when(key_length >= 40, 1).otherwise(0),
    )


def scene_card(scene_col: Column, feature_col: Column, need_col: Column, pack=VP) -> dict[str, Column]:
    """Template of the scene with a closing sentence."""
    default = pack.SCENE_TEMPLATES[pack.SCENE_DEFAULT]
    field = [
        T.mapped(scene_col, {k: v[i] for k, v in pack.SCENE_TEMPLATES.items()}, default[i]) for i in range(4)
    ]
    tail = F.format_string("，核心希望是通过%s获得%s。", feature_col, need_col)
    return dict(zip(("persona", "place", "motivation"), field)) | {"chain": F.concat(field[3], tail)}


def opportunity(s: Column, f: Column, n: Column, sc: Column) -> dict[str, Column]:
    pain = (
        F.when(s == "喜欢什么", F.format_string("用户原本在 %s 中要用额外步骤解决 %s，该产品把这段摩擦显著降低。", sc, n))
        .when(s == "放弃采用", F.format_string("用户在 %s 上无法稳定获得 %s，因此宁可放弃或更换方案。", f, n))
        .when(s == "合理增配", F.format_string("用户已认可主链路，但希望在 %s 上进一步补足 %s。", f, n))
        .otherwise(F.format_string("该评论仍与 %s 和 %s 相关，需要结合上下文再判断决策意义。", f, n))
    )
    hint = F.format_string("产品定义可优先强化 %s，面向 %s 用户把 %s 做成更明确的能力承诺。", f, sc, n)
    return {"pain": pain, "hint": hint}


# ---- the whole row -----------------------------------------------------------------

def with_hits(df: DataFrame, pack=VP, layers=LAYER_COLUMNS) -> DataFrame:
    """Add the normalised texts and the hit arrays the ``layers`` are decided on."""
    index, sources = comment_index(pack, layers), source_index(pack)
    theme = T.normalize(F.concat_ws(" ", *[T.text_of(c) for c in ("source_primary_theme", "source_secondary_theme", "source_topic_labels")]))
    lead = T.normalize(F.concat_ws(" ", *[T.text_of(c) for c in (
        "source_primary_theme", "source_secondary_theme", "source_topic_labels", "product_name",
        "scene_name", "keyword_source")]))
    d = df.select(
        "*",
        T.normalize("cleaned_comment").alias("_text"),
        lead.alias("_lead"),
        theme.alias("_theme"),
        T.number("rating").alias("_rating"),
        T.number("image_count").cast("int").alias("_images"),
    )
    # The context is the lead followed by the comment.  A keyword in it lies in the
    # comment, whose hits are known, or starts in the lead and then reaches at most
    # ``longest - 1`` characters into the comment; so only that seam is read again.
    seam = T.joined_text(" ", F.col("_lead"), F.substring(F.col("_text"), 1, index.longest - 1))
    d = d.select(
        "*",
        T.key_length("_text", 80).alias("_key_length"),  # no layer asks for more
        index.hits(F.col("_text")).alias("_hits"),
        F.when(F.col("_lead") == "", F.array().cast("array<string>")).otherwise(index.hits(seam)).alias("_lead_hits"),
        F.when(F.col("_theme") == "", F.array().cast("array<string>")).otherwise(sources.hits(F.col("_theme"))).alias("_source_hits"),
    )
    return d.withColumn("_context_hits", F.array_union("_hits", "_lead_hits"))


def tag(df: DataFrame, pack=VP, layers=LAYER_COLUMNS) -> DataFrame:
    """All label layers, or those named, for the valid rows of a cleaned review table.

    Layers that are not named are not decided, and only keywords of the others are looked up.
    """
    c = F.col
    d = with_hits(df.filter("is_valid"), pack, layers)
    d = d.select(
        "*",
        viewpoint(c("_hits"), c("_key_length"), c("_rating"), pack).alias("viewpoint"),
        feature(c("_hits"), c("_source_hits"), c("_context_hits"), pack).alias("feature"),
        scene(c("_context_hits"), pack).alias("scene"),
        *[e.alias(n) for n, e in zip(("_pos", "_neg"), emotion_scores(c("_hits"), c("_rating"), pack))],
    )
    need_hits = F.when(c("_text") != "", c("_hits")).otherwise(c("_context_hits"))
    d = d.select(
        "*",
        secondary_need(need_hits, c("feature"), c("_source_hits"), pack).alias("secondary_need"),
        need(c("_hits"), c("feature"), pack).alias("need"),
        polarity(c("_pos"), c("_neg")).alias("polarity"),
        intensity(c("_hits"), c("_text"), c("_rating"), c("_pos"), c("_neg"), pack).alias("intensity"),
    )
    d = d.select(
        "*",
        signal(c("viewpoint"), c("polarity")).alias("signal"),
        emotion(c("_hits"), c("polarity"), c("intensity"), c("viewpoint"), c("feature"), pack).alias("emotion"),
    )
    closed = aha_closed(c("viewpoint"), c("signal"), c("polarity"))
    d = d.select(
        *df.columns, "viewpoint", "feature", "scene", "secondary_need", "need", "polarity", "intensity", "signal", "emotion",
        trigger(c("emotion"), c("feature")).alias("trigger"),
        closed.alias("_closed"),
        F.when(closed, 0).otherwise(
            aha_points(c("_hits"), c("_key_length"), c("_images"), c("viewpoint"), c("scene"), c("need"), pack)
        ).alias("aha_score"),
        ranking_score(c("viewpoint"), c("polarity"), c("intensity"), c("_images"), c("_key_length"), pack).alias("rank_score"),
    )
    needed = {*layers, *(n for layer in layers for n in MADE_OF.get(layer, ()))}
    d = border(d, [n for n in d.columns if n not in df.columns and n in needed])
    score = c("aha_score")
    texts = scene_card(c("scene"), c("feature"), c("need"), pack) | opportunity(c("signal"), c("feature"), c("need"), c("scene"))
    made = {
        "aha": F.when(score >= 4, "是").otherwise("否"),
        "relation": F.when(score >= 6, "高").when(score >= 4, "中").otherwise("低"),
        "originality": F.when(c("_closed"), "低").when((score >= 7) | c("need").isin(*pack.ORIGINAL_NEEDS), "高")
        .when(score >= 4, "中").otherwise("低"),
        **texts, "analysis": F.concat_ws(" ", texts["pain"], texts["hint"]),
    }
    return d.withColumns({n: e for n, e in made.items() if n in layers}).select(*df.columns, *layers)


def tag_contract(tagged: DataFrame, pack=VP) -> DataFrame:
    """Tagged table with its published columns and headings."""
    return tagged.select(*pack.RECORD_COLUMNS, *[F.col(n).alias(h) for n, h in pack.TAG_HEADINGS.items()])


def normalize_labels(tagged: DataFrame, pack=VP) -> DataFrame:
    """Bring labels of older or hand-edited tables to the current names."""
    c = F.col
    current = T.mapped(T.strip("feature"), pack.LEGACY_FEATURES, T.first_filled(T.strip("feature"), F.lit(pack.FEATURE_DEFAULT)))
    view = T.strip("viewpoint")
    d = tagged.withColumn("feature", current).withColumn("viewpoint", T.mapped(view, pack.LEGACY_VIEWPOINTS, view))
    trig = T.first_filled(T.strip("trigger"), c("feature"))
    return d.withColumn("trigger", T.mapped(trig, pack.LEGACY_FEATURES, trig)).withColumn(
        "secondary_need",
        T.first_filled(
            T.strip("secondary_need"), T.mapped(c("feature"), pack.SECONDARY_BY_FEATURE), T.strip("need"), F.lit(pack.SECONDARY_DEFAULT)
        ),
    )
