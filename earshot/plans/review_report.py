"""Report tables over tagged reviews.

Every function takes the tagged table and, where counts are needed, the small
``label_counts`` table; pass a settled one to share it between reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from earshot.functions import text as T
from earshot.operators import counts as C
from earshot.operators.enrich import resolve_layers
from earshot.operators.skew import number_by
from earshot.packs import reviews as VP


def _counts(tagged: DataFrame, counts: DataFrame | None) -> DataFrame:
    return C.label_counts(tagged) if counts is None else counts


# ---- needs -----------------------------------------------------------------------

def layers(spark: SparkSession, pack=VP) -> DataFrame:
    rows = [(i, x, pack.LAYER_DESCRIPTIONS[x]) for i, x in enumerate(pack.LAYERS)]
    return spark.createDataFrame(rows, "pos int, layer string, description string")


def layer_totals(need_layers: DataFrame, pack=VP) -> DataFrame:
    """Rows per layer in fixed order; a layer without needs has 0."""
    totals = need_layers.groupBy("layer").agg(F.sum("n").alias("n"))
    whole = need_layers.agg(F.greatest(F.sum("n"), F.lit(1))).scalar()
    d = layers(need_layers.sparkSession, pack).join(totals, "layer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select("pos", "layer", "n", (F.col("n") / whole).alias("share"), "description").orderBy("pos")


def need_clusters(need_layers: DataFrame) -> DataFrame:
    whole = need_layers.agg(F.greatest(F.sum("n"), F.lit(1))).scalar()
    hint = F.format_string("产品定义可优先强化 %s，先把 %s 做成对 %s 用户更明确的能力承诺。", "feature", "secondary_need", "scene")
    return need_layers.select(
        "layer", "need", "feature", "secondary_need", "scene", "n", (F.col("n") / whole).alias("share"), hint.alias("hint")
    ).orderBy(F.desc("n"), "need")


def need_layers(tagged: DataFrame, counts: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Need profiles with their layer, reason and source."""
    return resolve_layers(C.need_profiles(tagged, _counts(tagged, counts)), cache)


# ---- aha moments and scenes ----------------------------------------------------------

def aha_ranking(tagged: DataFrame) -> DataFrame:
    """All aha rows with their rank."""
    aha = tagged.filter(F.col("aha") == "是")
    levels = [
        -F.col("aha_score"),
        F.when(F.col("relation") == "高", 0).otherwise(1),
        F.when(F.col("originality") == "高", 0).otherwise(1),
        -F.col("rank_score"),
    ]
    return number_by(aha, levels, "ord", "rank")


def _aha_columns() -> list:
    return [
        "aha_score", "relation", "originality", "product_name", "product_link", "scene", "feature", "secondary_need",
        C.aha_takeaway().alias("takeaway"), C.source_text().alias("source_text"), "pain", "hint",
        C.image_evidence().alias("image_evidence"),
    ]


def aha_moments(tagged: DataFrame) -> DataFrame:
    return aha_ranking(tagged).select("rank", *_aha_columns())


def aha_top(tagged: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` aha rows, without ranking the others."""
    order = [
        F.desc("aha_score"), (F.col("relation") != "高").cast("int"), (F.col("originality") != "高").cast("int"),
        F.desc("rank_score"), "ord",
    ]
    best = tagged.filter(F.col("aha") == "是").orderBy(*order).limit(k)
    w = Window.orderBy(*order)  # k rows
    return best.withColumn("rank", F.row_number().over(w)).select(
        "rank", "product_name", "scene", "feature", "secondary_need", C.aha_takeaway().alias("takeaway")
    )


def scene_cards(tagged: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    counts = _counts(tagged, counts)
    chosen = C.representatives(tagged).select(
        "scene", "product_name", "persona", "place", "motivation", "chain",
        C.representative_phrase().alias("phrase"), C.image_evidence().alias("image_evidence"),
    )
    d = C.with_share(C.fold(counts, "scene"), counts).join(chosen, "scene")
    return d.orderBy(F.desc("n"), "first_ord").select(
        "scene", "product_name", "n", "share", "persona", "place", "motivation", "chain", "phrase", "image_evidence"
    )


def emotion_top(counts: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent emotions with the feature and scene they come with most."""
    seen = C.fold(counts.filter(F.col("polarity") != "中性"), "emotion", "polarity")
    best = seen.orderBy(F.desc("n"), (F.col("polarity") == "正向").cast("int"), "first_ord").limit(k)
    d = C.with_share(best, counts).join(C.modal(counts, "emotion", "feature"), "emotion").join(C.modal(counts, "emotion", "scene"), "emotion")
    note = F.when(F.col("polarity") == "负向", "高热负向").otherwise("稳定正向")
    return d.select("emotion", "n", "share", "feature", "scene", note.alias("note"))


# ---- summary blocks -------------------------------------------------------------------

def feature_listing(counts: DataFrame) -> DataFrame:
    d = C.with_share(C.grouped_listing(counts, "feature", "secondary_need"), counts)
    return d.select("feature", "secondary_need", "n", "share", "parent_n")


def chart_series(counts: DataFrame) -> DataFrame:
    """Series of the four charts: 8 features, 6 scenes, 8 needs, 6 aha scenes."""
    size = F.when(F.col("block").isin("feature", "secondary"), 8).otherwise(6)
    d = C.ranked(C.blocks(counts).filter(F.col("block").isin("feature", "scene", "secondary", "aha_scene")))
    return C.with_share(d.filter(F.col("rank") <= size), counts).select("block", "rank", "name", "n", "share")


NARRATIVE = """总结：
本次聚焦 {focus}，共清洗 {raw} 条评论，保留 {kept} 条有效观点。高频一级功能集中在 {feature}，一级功能下最聚焦的二级需求是 {feature_secondary}。主要流失信号集中在 {churn}。

1、用户喜欢什么
用户稳定偏好主要收敛在 {likes}。这类评论更像是在说：只要把一级功能做清楚，并把对应的二级需求落到真实手感与链路细节上，用户就愿意长期采用。

2、为什么放弃采用
主要流失信号集中在 {churn}。流失信号主要不是配置不够多，而是一级功能没把关键二级需求做稳。

3、一级功能与二级需求
高频一级功能集中在 {feature}，对应最密集的二级需求是 {feature_secondary}。这说明产品定义阶段更适合先锁一级功能，再补清二级需求，而不是直接堆抽象卖点。

4、嘿哈时刻
本次共识别 {aha} 条高价值嘿哈评论，最集中的启发方向是 {aha_secondary}。这些评论更接近产品定义灵感，而不是泛泛好评。

5、情绪热力图
负向情绪最集中的标签是 {negative_emotion}。这类情绪通常直接对应用户的拒买、弃用或不推荐行为，容错率最低。

6、场景机会与图片证据
高频场景主要集中在 {scene}。场景卡和嘿哈板块中的图片证据可以直接还原真实使用环境，帮助判断需求是不是高频刚需。

7、底层需求归纳
高频底层需求集中在 {need}。底层需求依然要看，但更适合放在一级功能和二级需求之后，用来解释为什么这些功能会成为刚需。

8、合理增配
较集中的增配诉求集中在 {requests}。更好的做法不是泛化堆功能，而是把这些诉求转成更明确的接口、调节逻辑、切换动作或反馈设计。"""

_NARRATED = ("likes", "churn", "requests", "need", "feature", "feature_secondary", "scene", "aha_secondary", "negative_emotion")


def fill(template: str, values: dict[str, Column]) -> Column:
    """Template text with ``{name}`` places as one string expression."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _top_pairs(counts: DataFrame) -> DataFrame:
    """One row: the top 3 of every narrated block, the totals and the aha count."""
    name = F.when(F.col("parent") != "", F.concat_ws("-", "parent", "name")).otherwise(F.col("name"))
    best = C.ranked(C.blocks(counts).filter(F.col("block").isin(*_NARRATED)), 3)
    listed = best.agg(*[
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("block") == b, F.struct("rank", name.alias("name"), "n", F.col("name").alias("short"))))),
            lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"), x["short"].alias("short")),
        ).alias(b) for b in _NARRATED  # at most three per block
    ])
    sums = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("aha") == "是", F.col("n"))), F.lit(0)).alias("aha"),
    )
    return listed.withColumn("kept", sums.select("kept").scalar()).withColumn("aha", sums.select("aha").scalar())


def narrative(counts: DataFrame, focus: str, dropped: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """One row: the summary text and the terms to be emphasised in it.

    The rows lost by cleaning are the ``dropped`` ones, or what the ``reviews`` before
    cleaning have more than ``counts``; these are only counted, so no text is read.
    """
    d = _top_pairs(counts)
    if reviews is not None:
        lost = reviews.agg(F.count(F.lit(1))).scalar() - F.col("kept")
    else:
        lost = F.lit(0) if dropped is None else dropped.agg(F.count(F.lit(1))).scalar()
    whole = F.greatest(F.col("kept"), F.lit(1))
    values = {b: T.pairs_text(F.col(b), whole) for b in _NARRATED}
    values |= {"focus": F.lit(focus), "raw": F.col("kept") + lost, "kept": F.col("kept"), "aha": F.col("aha")}

    def names(b):
        return F.transform(b, lambda p: p["short"])

    def shares(b):
        return F.transform(b, lambda p: T.percent(p["n"] / whole))

    terms = F.flatten(F.array(
        F.array(F.lit(focus), F.concat(F.col("kept").cast("string"), F.lit(" 条"))),
        *[x for b in ("feature", "likes", "churn", "need") for x in (names(b), shares(b))],
        names("feature_secondary"),
        *[x for b in ("negative_emotion", "requests") for x in (names(b), shares(b))],
    ))
    return d.select(
        F.lit(focus).alias("focus"), (F.col("kept") + lost).alias("raw_rows"), F.col("kept").alias("kept_rows"),
        F.col("aha").alias("aha_rows"), fill(NARRATIVE, values).alias("narrative"),
        F.array_distinct(F.filter(terms, lambda t: t != "")).alias("emphasis"),
    )
