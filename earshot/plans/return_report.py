"""Report tables over labelled return and after-sales remarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from earshot.functions import text as T
from earshot.operators import trends as R
from earshot.operators.returns import macro_theme
from earshot.packs import returns as RP


def source_block(chains: DataFrame) -> DataFrame:
    """Label chains: categories by total, then name; chains by count, then name."""
    d = R.fold(chains, "level_1", "level_2", "level_3")
    w = Window.partitionBy("level_1")
    return (
        d.withColumn("level_1_n", F.sum("n").over(w)).withColumn("share", F.col("n") / R.valid_total(chains))
        .orderBy(F.desc("level_1_n"), "level_1", F.desc("n"), "level_2", "level_3")
        .select("level_1", "level_2", "level_3", "n", "share", "level_1_n")
    )


def sorted_block(chains: DataFrame) -> DataFrame:
    d = R.sub_issues(chains).withColumn("share", F.col("n") / R.valid_total(chains))
    return d.orderBy(F.desc("n"), "level_1", "level_2").select("level_1", "level_2", "n", "share")


def converged_block(chains: DataFrame) -> DataFrame:
    d = R.fold(chains, "level_1").withColumn("macro", macro_theme("level_1"))
    return d.orderBy(F.desc("n"), "first_ord").select(
        "level_1", "macro", "n", (F.col("n") / R.valid_total(chains)).alias("share"),
        F.concat(F.lit("归并到 "), "macro").alias("note"),
    )


def macro_top(chains: DataFrame, k: int = 4) -> DataFrame:
    d = R.macro_counts(chains).orderBy(F.desc("n"), "first_ord").limit(k)
    return d.select("macro", "n", (F.col("n") / R.valid_total(chains)).alias("share"))


def _pairs(df: DataFrame, name: str, *order) -> DataFrame:
    """One row with an ordered array of ``struct<name, n>``; ``df`` is a top-k."""
    d = df.withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    return d.agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(name).alias("name"), "n"))), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("a"))


def narrative(chains: DataFrame, days: DataFrame, product: str, funnel: DataFrame, pack=RP) -> DataFrame:
    """One row: the summary text and its emphasised terms.

    ``funnel`` has one row with ``matched_rows_before_dedupe``,
    ``invalid_rows_dropped``, ``duplicate_rows_dropped`` and ``clean_rows``.
    """
    order = [F.desc("n"), "first_ord"]
    types = R.fold(chains, "level_1")
    issues = R.ranked_issues(chains, pack)
    trend = R.trend(days).orderBy(*order).limit(1)
    listed_issues = issues.agg(F.array_sort(F.collect_list(F.struct("rank", "level_1", "n", "sub_issues")))).scalar()
    # every part is a single small row
    d = funnel.select(
        F.col("matched_rows_before_dedupe").alias("matched"), F.col("invalid_rows_dropped").alias("invalid"),
        F.col("duplicate_rows_dropped").alias("dup"), F.col("clean_rows").alias("rows"),
        F.coalesce(chains.agg(F.sum("n")).scalar(), F.lit(0)).alias("valid"),
        _pairs(types.orderBy(*order).limit(3), "level_1", *order).scalar().alias("top"),
        _pairs(R.macro_counts(chains).orderBy(*order).limit(4), "macro", *order).scalar().alias("macros"),
        listed_issues.alias("issues"),
        trend.select(F.struct("grain", "period", "n")).scalar().alias("peak"),
        types.agg(F.bool_or(F.col("level_1").isin(*pack.RISK_CATEGORIES))).scalar().alias("risk"),
    )
    c = F.col
    product_text = F.lit(product)
    whole = F.greatest(c("valid"), F.lit(1))
    text = lambda x: x.cast("string")
    share = lambda n: T.percent(n / whole)
    tops = F.array_join(F.transform("top", lambda p: F.concat(p["name"], share(p["n"]))), "、")
    focus = F.array_join(F.transform(F.slice("top", 1, 2), lambda p: p["name"]), " 和 ")
    overview = F.concat(
        F.lit("本次聚焦 "), product_text, F.lit("，共匹配到 "), text(c("matched")), F.lit(" 条记录，去重清洗后保留 "), text(c("rows")),
        F.lit(" 条，其中有效反馈 "), text(c("valid")), F.lit(" 条。综合来看，当前用户对 "), product_text,
        F.lit(" 的核心问题主要集中在 "), focus, F.lit("。Top3 为 "), tops, F.lit("。"),
    )
    lost = F.when(
        c("invalid") > 0,
        F.concat(F.lit("说明：无评论或无效评论 "), text(c("invalid")), F.lit(" 条未纳入有效反馈统计，重复记录额外剔除 "), text(c("dup")), F.lit(" 条。")),
    ).when(c("dup") > 0, F.concat(F.lit("说明：重复记录剔除 "), text(c("dup")), F.lit(" 条。")))
    unit = F.when(c("peak.grain") == "month", "月份").otherwise("日期")
    peak = F.when(
        c("peak").isNotNull(),
        F.concat(F.lit("时间趋势上，"), c("peak.period"), F.lit(" 为有效反馈峰值"), unit, F.lit("，占全部有效反馈 "), share(c("peak.n")), F.lit("。")),
    )
    issue_text = F.array_join(F.transform("issues", lambda i: F.concat(
        text(i["rank"]), F.lit("、"), i["level_1"], F.lit("（"), share(i["n"]), F.lit("）\n主要问题集中在 "),
        F.when(F.size(i["sub_issues"]) > 0, F.array_join(i["sub_issues"], "、")).otherwise("需结合原评论进一步复核"), F.lit("。\n"),
    )), "\n")
    converged = F.concat(F.lit("收敛归纳：可以进一步归并为 "), F.array_join(F.transform("macros", lambda p: F.concat(p["name"], share(p["n"]))), "、"))
    risk = F.when(c("risk"), F.lit("风险提示：优先排查故障 兼容性 功率 噪音等高风险问题。"))
    head = F.concat_ws("\n", F.lit("总结："), overview, lost, peak, F.lit(""))
    body = F.when(F.size("issues") > 0, issue_text)
    full = F.concat_ws("\n", head, body, converged, risk)
    empty = F.concat(F.lit("总结：\n本次聚焦 "), product_text, F.lit("，共匹配到 "), text(c("matched")), F.lit(" 条记录，但当前口径下暂无可用于汇总的有效用户反馈。"))

    def some(condition, *terms):
        return F.when(condition, F.array(*terms)).otherwise(F.array().cast("array<string>"))

    terms = F.flatten(F.array(
        F.array(product_text, F.lit("有效反馈")),
        F.transform("top", lambda p: p["name"]), F.transform("top", lambda p: share(p["n"])),
        some(c("invalid") > 0, F.lit("无评论或无效评论"), F.lit("未纳入有效反馈统计")),
        some(c("peak").isNotNull(), c("peak.period"), F.lit("峰值"), share(c("peak.n"))),
        F.flatten(F.transform("issues", lambda i: F.concat(F.array(i["level_1"], share(i["n"])), i["sub_issues"]))),
        F.transform("macros", lambda p: p["name"]),
        some(c("risk"), F.lit("风险提示"), F.lit("故障"), F.lit("兼容性"), F.lit("功率"), F.lit("噪音")),
    ))
    none = F.array(product_text, F.lit("有效用户反馈"))
    return d.select(
        F.lit(product).alias("product"), c("matched").alias("matched_rows"), c("valid").alias("valid_rows"),
        F.when(c("valid") > 0, full).otherwise(empty).alias("narrative"),
        F.when(c("valid") > 0, F.array_distinct(F.filter(terms, lambda t: t != ""))).otherwise(none).alias("emphasis"),
    )
