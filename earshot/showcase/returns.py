"""Registered queries over return remarks, each with its check in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators import clean as CL, returns as RT, trends as TR
from earshot.operators.skew import settle
from earshot.packs import returns as P
from earshot.plans import return_report as R
from earshot.showcase import base as B
from earshot.sources.cells import feedback_fields, product_tokens

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def cleaned(spark, d):
    return CL.clean_feedback(feedback_fields(B.feedback(spark, d)))


def labelled(spark, d):
    """Cleaned remarks with current level-1 names, chains and fresh flags."""
    kept = CL.kept_feedback(cleaned(spark, d)).withColumn("level_1", RT.current_level_1("level_1"))
    return RT.flag_risks(RT.tag_chain(kept))


def chains(spark, d):
    return settle(TR.chain_counts(TR.valid_rows(labelled(spark, d))))


# ---- SQL ---------------------------------------------------------------------------

def _base_sql() -> str:
    bad = B.s_in(P.INVALID_MARKERS)
    kt, kr, kn = (B.s_key(x) for x in ("translated_comment", "raw_comment", "return_reason"))
    return f"""remarks AS MATERIALIZED ({B.SQL_FEEDBACK}),
ks AS (SELECT *, {kt} AS kt, {kr} AS kr, {kn} AS kn FROM remarks),
chosen AS (SELECT *, CASE WHEN kt NOT IN {bad} THEN {B.s_strip('translated_comment')} WHEN kr NOT IN {bad} THEN {B.s_strip('raw_comment')}
  WHEN NOT text_expected AND kn NOT IN {bad} THEN {B.s_strip('return_reason')} ELSE '' END AS cleaned_comment FROM ks),
checked AS (SELECT *, {B.s_key('cleaned_comment')} AS kc, {B.s_key('cleaned_comment')} NOT IN {bad} AND (NOT text_expected OR kt <> '' OR kr <> '') AS is_valid_feedback FROM chosen),
deduped AS MATERIALIZED (SELECT *, is_valid_feedback AND NOT (kt = '' AND kr = '' AND kn <> '') AND row_number() OVER (
  PARTITION BY is_valid_feedback AND NOT (kt = '' AND kr = '' AND kn <> ''), product_name, kc ORDER BY ord) > 1 AS is_duplicate FROM checked)"""


def _flags_sql() -> str:
    five = "concat_ws(' ', cleaned_comment, level_1, level_2, level_3, level_4)"
    four = "concat_ws(' ', cleaned_comment, level_1, level_2, level_3)"
    three = "concat_ws(' ', level_1, level_2, level_3)"
    return (
        f"CASE WHEN {B.s_any(f'lower({five})', P.HIGH_RISK)} THEN 'high' WHEN {B.s_any(f'lower({five})', P.MEDIUM_RISK)} THEN 'medium' ELSE 'low' END AS severity, "
        f"{B.s_any(three, P.USER_REASONS)} AS is_user_reason, {B.s_any(four, P.QUALITY_RISK)} AS is_quality_risk"
    )


def _map(x: str, table: dict, default: str) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN {B.q(k)} THEN {B.q(v)}" for k, v in table.items()) + f" ELSE {default} END)"


def _chain_sql() -> str:
    rows = [(i, k) for i, (*_, ks) in enumerate(P.CHAIN_RULES) for k in ks]
    names = [(i, *levels) for i, (*levels, _) in enumerate(P.CHAIN_RULES)]
    return f""", rk(prio, keyword) AS (SELECT * FROM {B.values(rows)}),
rn(prio, l1, l2, l3, l4) AS (SELECT * FROM {B.values(names)}),
kept AS (SELECT * REPLACE ({_map('level_1', P.LEGACY_LEVEL_1, 'level_1')} AS level_1), {B.s_norm('cleaned_comment')} AS t FROM deduped WHERE is_valid_feedback AND NOT is_duplicate),
best AS (SELECT ord, min(prio) AS prio FROM kept JOIN rk ON contains(t, keyword) GROUP BY ord),
chained AS (SELECT kept.* REPLACE (CASE WHEN level_1 <> '' THEN level_1 ELSE coalesce(l1, '待人工判定') END AS level_1, CASE WHEN level_1 <> '' THEN level_2 ELSE coalesce(l2, '') END AS level_2,
  CASE WHEN level_1 <> '' THEN level_3 ELSE coalesce(l3, '') END AS level_3, CASE WHEN level_1 <> '' THEN level_4 ELSE coalesce(l4, '暂无法判断') END AS level_4)
  FROM kept LEFT JOIN best USING (ord) LEFT JOIN rn USING (prio)),
labelled AS MATERIALIZED (SELECT *, {_flags_sql()}, {_map('level_1', P.MACRO_THEMES, 'level_1')} AS macro FROM chained)"""


CLEANED = "WITH " + _base_sql()
LABELLED = CLEANED + _chain_sql()
TOTAL = "(SELECT greatest(count(*), 1) FROM labelled)"


@query("feedback_validity", CLEANED + " SELECT record_id, cleaned_comment, is_valid_feedback, is_duplicate FROM deduped")
def _(spark, d):
    return cleaned(spark, d).select("record_id", "cleaned_comment", "is_valid_feedback", "is_duplicate")


@query("feedback_flags", CLEANED + f" SELECT record_id, {_flags_sql()} FROM deduped")
def _(spark, d):
    return feedback_fields(B.feedback(spark, d)).select("record_id", "severity", "is_user_reason", "is_quality_risk")


@query("feedback_funnel", CLEANED + """ SELECT count(*) AS matched_rows_before_dedupe, count(*) FILTER (NOT is_valid_feedback) AS invalid_rows_dropped,
  count(*) FILTER (is_duplicate) AS duplicate_rows_dropped, count(*) FILTER (is_valid_feedback AND NOT is_duplicate) AS clean_rows FROM deduped""")
def _(spark, d):
    return CL.feedback_funnel(cleaned(spark, d))


@query("feedback_by_sheet", CLEANED + " SELECT source_sheet, count(*) AS n FROM deduped WHERE is_valid_feedback AND NOT is_duplicate GROUP BY source_sheet")
def _(spark, d):
    return CL.feedback_by_sheet(cleaned(spark, d))


@query("feedback_chains", LABELLED + " SELECT record_id, level_1, level_2, level_3, level_4, severity, is_user_reason, is_quality_risk FROM labelled")
def _(spark, d):
    return labelled(spark, d).select("record_id", "level_1", "level_2", "level_3", "level_4", "severity", "is_user_reason", "is_quality_risk")


@query("feedback_review_queue", LABELLED + f" SELECT record_id, level_1, level_4 FROM labelled WHERE level_1 IN {B.s_in(P.REVIEW_LABELS)}")
def _(spark, d):
    return RT.review_queue(labelled(spark, d)).select("record_id", "level_1", "level_4")


@query("feedback_decided_counts", LABELLED + f" SELECT level_1, count(*) AS n FROM labelled WHERE level_1 NOT IN {B.s_in(P.REVIEW_LABELS)} GROUP BY level_1")
def _(spark, d):
    return RT.decided(labelled(spark, d)).groupBy("level_1").agg(F.count(F.lit(1)).alias("n"))


@query("feedback_macro_theme", LABELLED + f" SELECT record_id, macro, {_map('level_1', P.DISPLAY_LEVEL_1, 'level_1')} AS display FROM labelled")
def _(spark, d):
    return labelled(spark, d).select("record_id", RT.macro_theme("level_1").alias("macro"), RT.display_level_1("level_1").alias("display"))


@query("chain_counts", LABELLED + " SELECT level_1, level_2, level_3, severity, count(*) AS n, min(ord) AS first_ord FROM labelled GROUP BY ALL")
def _(spark, d):
    return TR.chain_counts(TR.valid_rows(labelled(spark, d)))


@query("severity_counts", LABELLED + " SELECT severity, count(*) AS n FROM labelled GROUP BY severity")
def _(spark, d):
    return TR.fold(TR.chain_counts(TR.valid_rows(labelled(spark, d))), "severity").select("severity", "n")


@query("returns_source_block", LABELLED + f""" SELECT level_1, level_2, level_3, count(*) AS n, count(*) / {TOTAL} AS share,
  CAST(sum(count(*)) OVER (PARTITION BY level_1) AS BIGINT) AS level_1_n FROM labelled GROUP BY level_1, level_2, level_3""")
def _(spark, d):
    return R.source_block(chains(spark, d))


@query("returns_sorted_block", LABELLED + f" SELECT level_1, level_2, count(*) AS n, count(*) / {TOTAL} AS share FROM labelled WHERE level_2 <> '' GROUP BY level_1, level_2")
def _(spark, d):
    return R.sorted_block(chains(spark, d))


@query("returns_converged_block", LABELLED + f" SELECT level_1, macro, count(*) AS n, count(*) / {TOTAL} AS share, '归并到 ' || macro AS note FROM labelled GROUP BY level_1, macro")
def _(spark, d):
    return R.converged_block(chains(spark, d))


@query("returns_macro_top", LABELLED + f" SELECT macro, count(*) AS n, count(*) / {TOTAL} AS share FROM labelled GROUP BY macro ORDER BY n DESC, min(ord) LIMIT 4")
def _(spark, d):
    return R.macro_top(chains(spark, d))


_ISSUES = f""", issue AS (SELECT level_1, count(*) AS n, row_number() OVER (ORDER BY CASE WHEN level_1 IN {B.s_in(P.RISK_CATEGORIES)} THEN 0 ELSE 1 END, count(*) DESC, level_1) AS rank FROM labelled GROUP BY level_1),
sub AS (SELECT level_1, level_2, row_number() OVER (PARTITION BY level_1 ORDER BY count(*) DESC, min(ord)) AS pos FROM labelled WHERE level_2 <> '' GROUP BY level_1, level_2),
subs AS (SELECT level_1, string_agg(level_2, '、' ORDER BY pos) AS sub_issues FROM sub WHERE pos <= 3 GROUP BY level_1)"""


@query("returns_ranked_issues", LABELLED + _ISSUES + " SELECT CAST(rank AS INTEGER) AS rank, level_1, n, coalesce(sub_issues, '') AS sub_issues FROM issue LEFT JOIN subs USING (level_1) WHERE rank <= 4")
def _(spark, d):
    return TR.ranked_issues(chains(spark, d)).withColumn("sub_issues", F.array_join("sub_issues", "、"))


_DAYS = """, per_day AS (SELECT iso_day AS day, count(*) AS n, min(ord) AS first_ord FROM labelled WHERE iso_day NOT IN ('', 'soon') GROUP BY iso_day),
grain AS (SELECT count(DISTINCT substr(day, 1, 7)) >= 3 AS monthly FROM per_day),
trend AS (SELECT CASE WHEN monthly THEN substr(day, 1, 7) ELSE day END AS period, CASE WHEN monthly THEN 'month' ELSE 'day' END AS grain,
  CAST(sum(n) AS BIGINT) AS n, min(first_ord) AS first_ord FROM per_day, grain GROUP BY 1, 2)"""


@query("returns_trend", LABELLED + _DAYS + f" SELECT grain, period, n, n / {TOTAL} AS share, n = max(n) OVER () AS is_peak FROM trend WHERE (SELECT count(*) FROM trend) >= 2")
def _(spark, d):
    rows = labelled(spark, d)
    return _trend(rows)


def _trend(rows):
    days = settle(TR.day_counts(TR.valid_rows(rows)))
    return TR.trend_table(days, rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar())


@query("orders_trend_by_month", """SELECT 'month' AS grain, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n,
  count(*) / (SELECT count(*) FROM orders) AS share, count(*) = max(count(*)) OVER () AS is_peak FROM orders GROUP BY 2""")
def _(spark, d):
    orders = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.date_format("o_orderdate", "yyyy/M/d").alias("return_time"))
    days = settle(TR.day_counts(orders))
    return TR.trend_table(days, days.agg(F.sum("n")).scalar())


def _narrative_sql() -> str:
    pct = f"printf('%.2f%%', 100.0 * n / {TOTAL})"
    return LABELLED + _ISSUES + _DAYS + f""",
type3 AS (SELECT level_1, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(ord)) AS rk FROM labelled GROUP BY level_1),
macro4 AS (SELECT macro, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(ord)) AS rk FROM labelled GROUP BY macro),
f AS (SELECT count(*) AS matched, count(*) FILTER (NOT is_valid_feedback) AS invalid, count(*) FILTER (is_duplicate) AS dup FROM deduped)
SELECT 'LC30' AS product, matched AS matched_rows, (SELECT count(*) FROM labelled) AS valid_rows,
  '总结：' || chr(10) || '本次聚焦 LC30，共匹配到 ' || matched || ' 条记录，去重清洗后保留 ' || (matched - invalid - dup) || ' 条，其中有效反馈 ' || (SELECT count(*) FROM labelled)
  || ' 条。综合来看，当前用户对 LC30 的核心问题主要集中在 ' || (SELECT string_agg(level_1, ' 和 ' ORDER BY rk) FROM type3 WHERE rk <= 2) || '。Top3 为 '
  || (SELECT string_agg(level_1 || {pct}, '、' ORDER BY rk) FROM type3 WHERE rk <= 3) || '。' || chr(10)
  || CASE WHEN invalid > 0 THEN '说明：无评论或无效评论 ' || invalid || ' 条未纳入有效反馈统计，重复记录额外剔除 ' || dup || ' 条。' || chr(10)
       WHEN dup > 0 THEN '说明：重复记录剔除 ' || dup || ' 条。' || chr(10) ELSE '' END
  || coalesce((SELECT '时间趋势上，' || period || ' 为有效反馈峰值' || CASE grain WHEN 'month' THEN '月份' ELSE '日期' END || '，占全部有效反馈 ' || {pct} || '。' || chr(10) FROM trend ORDER BY n DESC, first_ord LIMIT 1), '')
  || chr(10) || (SELECT string_agg(rank || '、' || level_1 || '（' || {pct} || '）' || chr(10) || '主要问题集中在 ' || coalesce(sub_issues, '需结合原评论进一步复核') || '。' || chr(10), chr(10) ORDER BY rank)
       FROM issue LEFT JOIN subs USING (level_1) WHERE rank <= 4)
  || chr(10) || '收敛归纳：可以进一步归并为 ' || (SELECT string_agg(macro || {pct}, '、' ORDER BY rk) FROM macro4 WHERE rk <= 4)
  || CASE WHEN (SELECT bool_or(level_1 IN {B.s_in(P.RISK_CATEGORIES)}) FROM labelled) THEN chr(10) || '风险提示：优先排查故障 兼容性 功率 噪音等高风险问题。' ELSE '' END AS narrative FROM f"""


@query("returns_narrative", _narrative_sql())
def _(spark, d):
    rows = settle(cleaned(spark, d))
    kept = CL.kept_feedback(rows).withColumn("level_1", RT.current_level_1("level_1"))
    tagged = settle(RT.flag_risks(RT.tag_chain(kept)))
    days = TR.day_counts(TR.valid_rows(tagged))
    return R.narrative(TR.chain_counts(TR.valid_rows(tagged)), days, "LC30", CL.feedback_funnel(rows)).drop("emphasis")


@query("taxonomy_examples", LABELLED + """, ex AS (SELECT *, coalesce(nullif(translated_comment, ''), nullif(raw_comment, ''), return_reason) AS text,
    row_number() OVER (PARTITION BY level_1, level_2, level_3, level_4 ORDER BY ord) AS pos FROM labelled)
  SELECT level_1, level_2, level_3, level_4, count(*) AS n, string_agg(workbook || '::' || source_sheet || '#' || source_row || ' ' || text, chr(10) ORDER BY pos) FILTER (pos <= 3) AS examples
  FROM ex GROUP BY ALL""")
def _(spark, d):
    ex = TR.taxonomy_examples(settle(labelled(spark, d)))
    lines = F.transform("examples", lambda e: F.concat(e["workbook"], F.lit("::"), e["sheet"], F.lit("#"), e["row"].cast("string"), F.lit(" "), e["text"]))
    return ex.select("level_1", "level_2", "level_3", "level_4", "n", F.array_join(lines, "\n").alias("examples"))


_CODE = P.MODEL_CODE


@query("product_tokens", f"""WITH r AS ({B.SQL_FEEDBACK}), t AS (SELECT record_id, product_name, upper(product_name || ' ' || raw_comment) AS u FROM r)
  SELECT record_id, array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(regexp_extract_all(u, {B.q(_CODE)}), lambda x: [regexp_replace(trim(x), '\\s+', ' ', 'g')])),
    lambda a, b: CASE WHEN list_has_all(a, b) THEN a ELSE list_concat(a, b) END), ',') AS products FROM t""")
def _(spark, d):
    r = B.feedback(spark, d)
    return r.select("record_id", F.array_join(product_tokens(F.concat_ws(" ", "product_name", "raw_comment")), ",").alias("products"))


@query("product_rows", f"""WITH r AS ({B.SQL_FEEDBACK}) SELECT record_id FROM r
  WHERE list_contains(list_transform(regexp_extract_all(upper(product_name), {B.q(_CODE)}), lambda x: regexp_replace(trim(x), '\\s+', ' ', 'g')), 'BOX X2')""")
def _(spark, d):
    return B.feedback(spark, d).filter(F.array_contains(product_tokens("product_name"), F.lit("BOX X2"))).select("record_id")


_TS = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END"


@query("return_date_parsing", f"SELECT o_orderkey, {_TS} AS day FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy/M/d"))
        .when(k % 4 == 2, F.date_format("o_orderdate", "yyyy-M-d HH:mm:ss")).otherwise(F.lit("soon"))
    )
    return B.read(spark, d, "orders").select("o_orderkey", F.date_format(T.timestamp(text), "yyyy-MM-dd").alias("day"))
