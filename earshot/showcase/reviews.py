"""Registered queries over reviews, each with its check in SQL.

The SQL takes another road than the Spark plan: keywords are a VALUES table that
is joined by ``contains`` and reduced to the smallest priority, duplicates are
found by a window, rankings by ``row_number``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import clean as CL, counts as C, enrich as E, tag as TG
from earshot.operators.skew import settle
from earshot.packs import reviews as P
from earshot.plans import review_report as R
from earshot.showcase import base as B

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---- inputs in Spark -------------------------------------------------------------

def cleaned(spark, d):
    return CL.clean_reviews(B.reviews(spark, d))


def tagged(spark, d, *layers):
    """The tagged table with all layers, or with those a query reads."""
    return TG.tag(cleaned(spark, d), layers=layers or TG.LAYER_COLUMNS)


def stored(spark, d, *columns):
    """The tagged table, or the ``columns`` a report reads, written once, as reports with several parts want it."""
    return settle(tagged(spark, d).select(*columns or "*"))


def quotable(spark, d):
    return settle(C.quotable(tagged(spark, d)))


def counts(spark, d, *dims):
    """Settled: it is small, and several parts of a report read it.  ``dims`` are the labels read, all unless named."""
    dims = dims or C.DIMS
    return settle(C.label_counts(tagged(spark, d, *dims), dims))


# ---- inputs in SQL -----------------------------------------------------------------

def _flag_sql() -> str:
    reason = (
        f"CASE WHEN t IN {B.s_in(P.EMPTY_MARKERS)} THEN 'empty_or_na' "
        f"WHEN k = '' THEN 'emoji_or_punctuation_only' "
        f"WHEN k IN {B.s_in(P.FILLERS)} THEN 'low_information' "
        f"WHEN {B.s_any('t', P.SPAM)} THEN 'spam_or_ad' "
        f"WHEN {B.s_any('t', P.SERVICE)} AND NOT {B.s_any('t', P.PRODUCT_SIGNALS)} THEN 'logistics_or_seller_only' ELSE '' END"
    )
    name = B.s_key("coalesce(nullif(focus_name, ''), nullif(product_name, ''), scene_name)")
    return f"""reviews AS MATERIALIZED ({B.SQL_REVIEWS}),
keyed AS (SELECT *, {B.s_norm('cleaned_comment')} AS t, {B.s_key('cleaned_comment')} AS k, {name} AS nk FROM reviews),
reasoned AS (SELECT *, {reason} AS reason0 FROM keyed),
flagged AS MATERIALIZED (SELECT *, CASE WHEN reason0 <> '' THEN reason0
  WHEN row_number() OVER (PARTITION BY reason0 = '', nk, k ORDER BY ord) > 1 THEN 'duplicate' ELSE '' END AS drop_reason FROM reasoned)"""


WORD_LISTS = {
    "hype": P.HYPE, "defect": P.DEFECT, "suggestion": P.SUGGESTION, "compare": P.COMPARE, "expectation": P.EXPECTATION,
    "pos": P.POSITIVE, "spos": P.STRONG_POSITIVE, "neg": P.NEGATIVE, "sneg": P.STRONG_NEGATIVE,
    "convenience": P.CONVENIENCE, "noise": P.NOISE, "control": P.CONTROL, "connect": P.CONNECT, "value": P.VALUE,
    "surprise": P.SURPRISE, "ahaphrase": P.AHA_PHRASES,
}
RULES = {
    ("c", "feature"): P.FEATURE_RULES, ("x", "xfeature"): P.FEATURE_RULES, ("s", "sfeature"): P.SOURCE_FEATURE_RULES,
    ("s", "ssecondary"): P.SOURCE_SECONDARY_RULES, ("c", "need"): P.NEED_RULES, ("x", "scene"): P.SCENE_RULES,
    **{("c", f"sec{i}"): rs for i, rs in enumerate(P.SECONDARY_RULES.values())},
}


def _map_sql(x: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {B.q(k)} THEN {B.q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"(CASE {x} {whens} ELSE {default} END)"


def _label_sql(layer: str, rules) -> str:
    return f"[{', '.join(B.q(label) for label, _ in rules)}][p_{layer} + 1]"


def _tag_sql() -> str:
    rows = [(src, layer, i, k) for (src, layer), rs in RULES.items() for i, (_, ks) in enumerate(rs) for k in ks]
    rows += [("c", layer, 0, k) for layer, ks in WORD_LISTS.items() for k in ks]
    ctx = ", ".join(f"coalesce({n}, '')" for n in ("source_primary_theme", "source_secondary_theme", "source_topic_labels", "product_name", "scene_name", "keyword_source", "cleaned_comment"))
    src = ", ".join(f"coalesce({n}, '')" for n in ("source_primary_theme", "source_secondary_theme", "source_topic_labels"))
    prios = ", ".join(f"min(p) FILTER (layer = '{layer}') AS p_{layer}" for _, layer in RULES)
    sizes = ", ".join(f"coalesce(max(n) FILTER (layer = '{layer}'), 0) AS n_{layer}" for layer in WORD_LISTS)
    guard = " ".join(
        f"WHEN p_ssecondary = {i} AND feature IN {B.s_in(P.SOURCE_SECONDARY_GUARD[label])} THEN {B.q(label)}"
        for i, (label, _) in enumerate(P.SOURCE_SECONDARY_RULES)
    )
    by_feature = " ".join(f"WHEN feature = {B.q(f)} AND p_sec{i} IS NOT NULL THEN {_label_sql(f'sec{i}', rs)}" for i, (f, rs) in enumerate(P.SECONDARY_RULES.items()))
    card = {n: _map_sql("scene", {k: v[i] for k, v in P.SCENE_TEMPLATES.items()}, "''") for i, n in enumerate(("persona", "place", "motivation", "chain0"))}
    return f"""kw(src, layer, prio, keyword) AS (SELECT * FROM {B.values(rows)}),
valid AS (SELECT * FROM flagged WHERE drop_reason = ''),
texts AS (SELECT ord, 'c' AS src, t AS text FROM valid
  UNION ALL SELECT ord, 'x', {B.s_norm(f"concat_ws(' ', {ctx})")} FROM valid
  UNION ALL SELECT ord, 's', {B.s_norm(f"concat_ws(' ', {src})")} FROM valid),
hits AS MATERIALIZED (SELECT ord, layer, min(prio) AS p, count(DISTINCT keyword) AS n FROM texts JOIN kw ON texts.src = kw.src AND contains(texts.text, kw.keyword) GROUP BY ord, layer),
wide AS (SELECT ord, {prios}, {sizes} FROM hits GROUP BY ord),
g0 AS (SELECT v.*, {', '.join(f'p_{layer}' for _, layer in RULES)}, {', '.join(f'coalesce(n_{layer}, 0) AS n_{layer}' for layer in WORD_LISTS)},
  length(k) AS kl, coalesce(rating, 0) AS r FROM valid v LEFT JOIN wide USING (ord)),
g1 AS (SELECT *,
  CASE WHEN n_hype > 0 AND kl < 50 THEN '疑似灌水' WHEN n_defect > 0 THEN '缺陷复现' WHEN n_suggestion > 0 THEN '建议'
    WHEN n_compare > 0 THEN '对比' WHEN n_expectation > 0 THEN '期望落差' WHEN r > 0 AND r <= 2 THEN '抱怨'
    WHEN n_neg + n_sneg > 0 THEN '抱怨' WHEN r >= 4 THEN '优点' WHEN n_pos + n_spos > 0 THEN '优点' ELSE '观点其他' END AS viewpoint,
  coalesce({_label_sql('feature', P.FEATURE_RULES)}, {_label_sql('sfeature', P.SOURCE_FEATURE_RULES)}, {_label_sql('xfeature', P.FEATURE_RULES)}, '基础') AS feature,
  coalesce({_label_sql('scene', P.SCENE_RULES)}, '通用补洞') AS scene,
  n_pos + 2 * n_spos + CASE WHEN r >= 4 THEN 1 ELSE 0 END AS ps,
  n_neg + 2 * n_sneg + CASE WHEN r > 0 AND r <= 2 THEN 1 ELSE 0 END AS ns FROM g0),
g2 AS (SELECT *,
  CASE {guard} {by_feature} ELSE {_map_sql('feature', P.SECONDARY_BY_FEATURE, "'把基础链路补齐'")} END AS secondary_need,
  coalesce({_label_sql('need', P.NEED_RULES)}, {_map_sql('feature', P.NEED_BY_FEATURE, "'场景适配'")}) AS need,
  CASE WHEN ps > ns THEN '正向' WHEN ns > ps THEN '负向' ELSE '中性' END AS polarity,
  CASE WHEN r IN (1, 5) OR length(regexp_replace(t, '[^!！]', '', 'g')) >= 2 OR n_spos + n_sneg > 0 THEN '强烈'
    WHEN r IN (2, 4) OR ps > 0 OR ns > 0 THEN '中等' ELSE '轻微' END AS intensity FROM g1),
g3 AS (SELECT *,
  CASE WHEN viewpoint = '疑似灌水' THEN '噪声样本' WHEN viewpoint = '建议' THEN '合理增配'
    WHEN viewpoint IN ('抱怨', '缺陷复现', '期望落差') OR polarity = '负向' THEN '放弃采用'
    WHEN viewpoint IN ('优点', '对比') AND polarity = '正向' THEN '喜欢什么' ELSE '待归纳' END AS signal,
  CASE polarity WHEN '正向' THEN CASE WHEN n_surprise > 0 THEN '惊喜超预期' WHEN n_convenience > 0 THEN '顺手便利'
      WHEN feature IN ('连接', '做工') THEN '放心省心' WHEN feature = '价格' OR n_value > 0 THEN '值回票价'
      WHEN feature = '场景' THEN '灵感打开' ELSE '满意认可' END
    WHEN '负向' THEN CASE WHEN n_noise > 0 THEN '被噪音打断' WHEN n_control > 0 THEN '失控难调' WHEN n_connect > 0 THEN '焦虑不确定'
      WHEN viewpoint IN ('期望落差', '对比') OR n_expectation > 0 THEN '失望落差' WHEN intensity = '强烈' THEN '愤怒拒绝' ELSE '烦躁麻烦' END
    ELSE CASE viewpoint WHEN '建议' THEN '理性期待' WHEN '对比' THEN '理性对比' ELSE '观察确认' END END AS emotion FROM g2),
g4 AS (SELECT *,
  CASE emotion WHEN '被噪音打断' THEN '音质' WHEN '失控难调' THEN '音量' WHEN '焦虑不确定' THEN '连接' ELSE feature END AS trigger,
  (polarity = '负向' AND viewpoint NOT IN ('建议', '对比')) OR (signal NOT IN ('喜欢什么', '合理增配') AND viewpoint <> '对比') AS closed,
  CAST({_map_sql('viewpoint', P.VIEWPOINT_SCORE, '1')} + {_map_sql('polarity', P.POLARITY_SCORE, '0')} + {_map_sql('intensity', P.INTENSITY_SCORE, '0')}
    + CASE WHEN image_count > 0 THEN 1 ELSE 0 END + CASE WHEN kl >= 80 THEN 2 WHEN kl >= 40 THEN 1 ELSE 0 END AS INTEGER) AS rank_score,
  {', '.join(f'{e} AS {n}' for n, e in card.items())},
  CASE signal WHEN '喜欢什么' THEN '用户原本在 ' || scene || ' 中要用额外步骤解决 ' || need || '，该产品把这段摩擦显著降低。'
    WHEN '放弃采用' THEN '用户在 ' || feature || ' 上无法稳定获得 ' || need || '，因此宁可放弃或更换方案。'
    WHEN '合理增配' THEN '用户已认可主链路，但希望在 ' || feature || ' 上进一步补足 ' || need || '。'
    ELSE '该评论仍与 ' || feature || ' 和 ' || need || ' 相关，需要结合上下文再判断决策意义。' END AS pain,
  '产品定义可优先强化 ' || feature || '，面向 ' || scene || ' 用户把 ' || need || ' 做成更明确的能力承诺。' AS hint FROM g3),
g5 AS (SELECT *, chain0 || '，核心希望是通过' || feature || '获得' || need || '。' AS chain, pain || ' ' || hint AS analysis,
  CAST(CASE WHEN closed THEN 0 ELSE CASE WHEN n_spos > 0 THEN 2 ELSE 0 END + CASE WHEN n_ahaphrase > 0 THEN 2 ELSE 0 END
    + CASE WHEN scene <> '通用补洞' THEN 1 ELSE 0 END + CASE WHEN need IN {B.s_in(P.AHA_NEEDS)} THEN 1 ELSE 0 END
    + CASE WHEN viewpoint IN ('对比', '建议') THEN 1 ELSE 0 END + CASE WHEN image_count > 0 THEN 1 ELSE 0 END
    + CASE WHEN kl >= 50 THEN 1 ELSE 0 END END AS INTEGER) AS aha_score FROM g4),
tagged AS MATERIALIZED (SELECT *, CASE WHEN aha_score >= 4 THEN '是' ELSE '否' END AS aha,
  CASE WHEN aha_score >= 6 THEN '高' WHEN aha_score >= 4 THEN '中' ELSE '低' END AS relation,
  CASE WHEN closed THEN '低' WHEN aha_score >= 7 OR need IN {B.s_in(P.ORIGINAL_NEEDS)} THEN '高' WHEN aha_score >= 4 THEN '中' ELSE '低' END AS originality FROM g5)"""


FLAGGED = "WITH " + _flag_sql()
TAGGED = FLAGGED + ",\n" + _tag_sql()
TOTAL = "(SELECT greatest(count(*), 1) FROM tagged)"


# ---- cleaning -------------------------------------------------------------------------

@query("clean_drop_reasons", FLAGGED + " SELECT record_id, drop_reason, drop_reason = '' AS is_valid FROM flagged")
def _(spark, d):
    return cleaned(spark, d).select("record_id", "drop_reason", "is_valid")


@query("clean_kept_rows", FLAGGED + " SELECT ord, record_id, product_name, cleaned_comment FROM flagged WHERE drop_reason = ''")
def _(spark, d):
    return CL.kept(cleaned(spark, d)).select("ord", "record_id", "product_name", "cleaned_comment")


@query("clean_dropped_rows", FLAGGED + " SELECT ord, record_id, cleaned_comment, drop_reason FROM flagged WHERE drop_reason <> ''")
def _(spark, d):
    return CL.dropped(cleaned(spark, d)).select("ord", "record_id", "cleaned_comment", "drop_reason")


@query("clean_drop_counts", FLAGGED + " SELECT drop_reason, count(*) AS n FROM flagged GROUP BY drop_reason")
def _(spark, d):
    return CL.review_drop_counts(B.reviews(spark, d))


@query("clean_funnel", FLAGGED + """ SELECT count(*) AS matched_rows_before_cleaning, count(*) FILTER (drop_reason = '') AS clean_rows,
  count(*) FILTER (drop_reason <> '') AS dropped_rows,
  (SELECT '{' || string_agg('"' || drop_reason || '":' || n, ',' ORDER BY drop_reason) || '}' FROM
    (SELECT drop_reason, count(*) AS n FROM flagged WHERE drop_reason <> '' GROUP BY drop_reason)) AS drop_reasons FROM flagged""")
def _(spark, d):
    return CL.review_funnel(cleaned(spark, d))


_DOC_KEY = B.s_key("text")


@query("clean_document_duplicates", f"""WITH k AS (SELECT doc_id, md5({_DOC_KEY}) AS k FROM documents),
  f AS (SELECT k, min(doc_id) AS first_id, count(*) AS copies FROM k GROUP BY k)
  SELECT doc_id, first_id, copies FROM k JOIN f USING (k) WHERE doc_id <> first_id""")
def _(spark, d):
    from earshot.functions import text as T
    docs = B.read(spark, d, "documents").select("doc_id", F.sha2(T.key("text"), 256).alias("k"))
    firsts = docs.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    from earshot.operators.skew import spread_join
    return spread_join(docs, firsts, ["k"], "inner").filter("doc_id <> first_id").select("doc_id", "first_id", "copies")


@query("clean_focus_filter", f"""WITH reviews AS ({B.SQL_REVIEWS}), j AS (SELECT record_id, concat_ws(' ', {', '.join(CL.FOCUS_FIELDS)}) AS t FROM reviews)
  SELECT record_id FROM j WHERE contains({B.s_key('t')}, 'livingroom') OR contains({B.s_norm('t')}, 'living-room')""")
def _(spark, d):
    return CL.filter_focus(B.reviews(spark, d), "Living-Room").select("record_id")


# ---- tag layers --------------------------------------------------------------------------

def _layer(name: str, *columns: str):
    @query(name, TAGGED + f" SELECT record_id, {', '.join(columns)} FROM tagged")
    def run(spark, d):
        return tagged(spark, d, *columns).select("record_id", *columns)


_layer("tag_viewpoint", "viewpoint")
_layer("tag_feature", "feature")
_layer("tag_secondary_need", "feature", "secondary_need")
_layer("tag_need", "need")
_layer("tag_polarity", "polarity", "intensity")
_layer("tag_emotion", "emotion", "trigger")
_layer("tag_scene", "scene")
_layer("tag_scene_card", "scene", "persona", "place", "motivation", "chain")
_layer("tag_signal", "signal")
_layer("tag_aha", "aha", "aha_score", "relation", "originality")
_layer("tag_opportunity", "pain", "hint", "analysis")
_layer("tag_rank_score", "rank_score")


@query("tag_contract", TAGGED + " SELECT " + ", ".join([*P.RECORD_COLUMNS, *[f'{n} AS "{h}"' for n, h in P.TAG_HEADINGS.items()]]) + " FROM tagged")
def _(spark, d):
    return TG.tag_contract(tagged(spark, d))


_OLD = {v: k for k, v in P.LEGACY_FEATURES.items()}


@query("tag_legacy_labels", TAGGED + " SELECT record_id, viewpoint, feature, trigger, secondary_need FROM tagged")
def _(spark, d):
    from earshot.functions import text as T
    t = tagged(spark, d)
    old = t.withColumn("feature", T.mapped("feature", _OLD, F.col("feature"))).withColumn("trigger", T.mapped("trigger", _OLD, F.col("trigger")))
    old = old.withColumn("viewpoint", F.when(F.col("viewpoint") == "疑似灌水", "夸张/疑似灌水").otherwise(F.col("viewpoint")))
    return TG.normalize_labels(old).select("record_id", "viewpoint", "feature", "trigger", "secondary_need")


# ---- counts ---------------------------------------------------------------------------------

def _pair(name: str, a: str, b: str):
    @query(name, TAGGED + f" SELECT {a}, {b}, count(*) AS n, count(*) / {TOTAL} AS share FROM tagged GROUP BY {a}, {b}")
    def run(spark, d):
        c = counts(spark, d, a, b)
        return C.with_share(C.fold(c, a, b), c).select(a, b, "n", "share")


_pair("count_feature_secondary", "feature", "secondary_need")
_pair("count_feature_scene", "feature", "scene")


@query("share_feature_viewpoint", TAGGED + f" SELECT feature, viewpoint, count(*) AS n, count(*) / {TOTAL} AS share FROM tagged GROUP BY feature, viewpoint")
def feature_viewpoint(spark, d):
    t = settle(tagged(spark, d, "feature", "viewpoint").groupBy("feature", "viewpoint").agg(F.count(F.lit(1)).alias("n")))
    return t.withColumn("share", F.col("n") / t.agg(F.sum("n")).scalar())


_BLOCK_SQL = TAGGED + """, long AS (
  SELECT ord, 'feature' AS block, feature AS name, '' AS parent FROM tagged UNION ALL SELECT ord, 'secondary', secondary_need, '' FROM tagged
  UNION ALL SELECT ord, 'need', need, '' FROM tagged UNION ALL SELECT ord, 'scene', scene, '' FROM tagged
  UNION ALL SELECT ord, 'feature_secondary', secondary_need, feature FROM tagged UNION ALL SELECT ord, 'feature_scene', scene, feature FROM tagged
  UNION ALL SELECT ord, CASE signal WHEN '喜欢什么' THEN 'likes' WHEN '放弃采用' THEN 'churn' ELSE 'requests' END, secondary_need, '' FROM tagged
    WHERE signal IN ('喜欢什么', '放弃采用', '合理增配')
  UNION ALL SELECT ord, CASE polarity WHEN '负向' THEN 'negative_emotion' ELSE 'positive_emotion' END, emotion, '' FROM tagged WHERE polarity <> '中性'
  UNION ALL SELECT ord, 'aha_scene', scene, '' FROM tagged WHERE aha = '是' UNION ALL SELECT ord, 'aha_secondary', secondary_need, '' FROM tagged WHERE aha = '是'),
blocks AS (SELECT block, name, parent, count(*) AS n, min(ord) AS first_ord FROM long GROUP BY block, name, parent)"""


@query("count_all_blocks", _BLOCK_SQL + " SELECT block, name, parent, n, first_ord FROM blocks")
def _(spark, d):
    return C.blocks(C.label_counts(tagged(spark, d))).select("block", "name", "parent", "n", "first_ord")


@query("top_per_block", _BLOCK_SQL + f""" SELECT block, rank, parent, name, n, n / {TOTAL} AS share FROM
  (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, first_ord) AS rank FROM blocks) WHERE rank <= 3""")
def _(spark, d):
    c = counts(spark, d)
    return C.with_share(C.ranked(C.blocks(c), 3), c).select("block", "rank", "parent", "name", "n", "share")


def _top12(name: str, block: str, child: str):
    @query(name, _BLOCK_SQL + f" SELECT parent AS feature, name AS {child}, n, n / {TOTAL} AS share FROM blocks WHERE block = '{block}' ORDER BY n DESC, first_ord LIMIT 12")
    def run(spark, d):
        c = counts(spark, d, "feature", child)
        return C.with_share(C.top(C.fold(c, "feature", child), 12), c).select("feature", child, "n", "share")


_top12("top12_feature_secondary", "feature_secondary", "secondary_need")
_top12("top12_feature_scene", "feature_scene", "scene")


@query("feature_listing", TAGGED + f""" SELECT feature, secondary_need, count(*) AS n, count(*) / {TOTAL} AS share,
  CAST(sum(count(*)) OVER (PARTITION BY feature) AS BIGINT) AS parent_n FROM tagged GROUP BY feature, secondary_need""")
def _(spark, d):
    return R.feature_listing(counts(spark, d, "feature", "secondary_need"))


@query("chart_series", _BLOCK_SQL + f""" SELECT block, rank, name, n, n / {TOTAL} AS share FROM
  (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, first_ord) AS rank FROM blocks WHERE block IN ('feature', 'scene', 'secondary', 'aha_scene'))
  WHERE rank <= CASE WHEN block IN ('feature', 'secondary') THEN 8 ELSE 6 END""")
def _(spark, d):
    return R.chart_series(counts(spark, d))


# ---- emotions ----------------------------------------------------------------------------------

_TOP_EMOTIONS = """, top AS (SELECT emotion, row_number() OVER (ORDER BY count(*) DESC, min(CASE polarity WHEN '负向' THEN 0 ELSE 1 END), min(ord)) AS pos
  FROM tagged WHERE polarity <> '中性' GROUP BY emotion)"""


def _matrix(name: str, dim: str, limit: int, rows: int | None):
    keep = f"QUALIFY row_number() OVER (ORDER BY count(*) DESC, min(ord)) <= {rows}" if rows else ""
    @query(name, TAGGED + _TOP_EMOTIONS + f""", names AS (SELECT {dim} FROM tagged GROUP BY {dim} {keep}),
  cells AS (SELECT {dim}, emotion, count(*) AS n FROM tagged GROUP BY {dim}, emotion)
  SELECT names.{dim}, top.emotion, CAST(top.pos - 1 AS INTEGER) AS emotion_pos, coalesce(cells.n, 0) AS n
  FROM names JOIN top ON top.pos <= {limit} LEFT JOIN cells ON cells.{dim} = names.{dim} AND cells.emotion = top.emotion""")
    def run(spark, d):
        return C.emotion_matrix(counts(spark, d, dim, "emotion", "polarity"), dim, limit, rows).select(dim, "emotion", "emotion_pos", "n")


_matrix("emotion_matrix_feature", "feature", 8, None)
_matrix("emotion_matrix_scene", "scene", 8, None)
_matrix("emotion_matrix_summary", "feature", 6, 6)


@query("emotion_details", TAGGED + f""", e AS (SELECT feature, emotion, min(polarity) AS polarity, count(*) AS n, count(*) / {TOTAL} AS share FROM tagged GROUP BY feature, emotion)
  SELECT *, CASE WHEN polarity = '负向' AND share >= 0.03 THEN '高热负向' ELSE '重点观察' END AS note FROM e""")
def _(spark, d):
    return C.emotion_details(counts(spark, d))


@query("emotion_top", TAGGED + _TOP_EMOTIONS + f""",
  f AS (SELECT emotion, feature, row_number() OVER (PARTITION BY emotion ORDER BY count(*) DESC, min(ord)) AS rk FROM tagged GROUP BY emotion, feature),
  s AS (SELECT emotion, scene, row_number() OVER (PARTITION BY emotion ORDER BY count(*) DESC, min(ord)) AS rk FROM tagged GROUP BY emotion, scene),
  c AS (SELECT emotion, count(*) AS n, min(polarity) AS polarity FROM tagged GROUP BY emotion)
  SELECT top.emotion, c.n, c.n / {TOTAL} AS share, f.feature, s.scene, CASE c.polarity WHEN '负向' THEN '高热负向' ELSE '稳定正向' END AS note
  FROM top JOIN c USING (emotion) JOIN f ON f.emotion = top.emotion AND f.rk = 1 JOIN s ON s.emotion = top.emotion AND s.rk = 1 WHERE pos <= 5""")
def _(spark, d):
    return R.emotion_top(counts(spark, d))


@query("feature_polarity", TAGGED + """ SELECT feature, count(*) FILTER (polarity = '正向') AS positive, count(*) FILTER (polarity = '中性') AS neutral,
  count(*) FILTER (polarity = '负向') AS negative, count(*) FILTER (polarity = '负向' AND intensity = '强烈') AS strong_negative FROM tagged GROUP BY feature""")
def _(spark, d):
    return C.feature_polarity(C.label_counts(tagged(spark, d)))


# ---- needs ------------------------------------------------------------------------------------------

def _need_sql() -> str:
    hints = " ".join(f"WHEN {B.s_any('profile', hs)} THEN {B.q(layer)}" for layer, hs in P.LAYER_HINTS)
    modal = ", ".join(
        f"{v}_m AS (SELECT need, {v}, row_number() OVER (PARTITION BY need ORDER BY count(*) DESC, min(ord)) AS rk FROM tagged GROUP BY need, {v})"
        for v in ("feature", "secondary_need", "scene")
    )
    full = B.s_collapse("coalesce(nullif(translated_comment, ''), nullif(cleaned_comment, ''), raw_comment)")
    return f""", {modal},
cand AS (SELECT need, ord, rank_score, aha_score, {full} AS full_text FROM tagged),
cut AS (SELECT need, ord, rank_score, aha_score, CASE WHEN length(full_text) <= 100 THEN full_text ELSE substr(full_text, 1, 99) || '…' END AS text FROM cand),
uniq AS (SELECT *, row_number() OVER (PARTITION BY need, lower(text) ORDER BY rank_score DESC, aha_score DESC, ord) AS u FROM cut WHERE length(text) >= 18),
quote AS (SELECT need, text, row_number() OVER (PARTITION BY need ORDER BY rank_score DESC, aha_score DESC, ord) AS pos FROM uniq WHERE u = 1),
quotes AS (SELECT need, list(text ORDER BY pos) AS evidence FROM quote WHERE pos <= 3 GROUP BY need),
needs AS (SELECT t.need, count(*) AS n, any_value(f.feature) AS feature, any_value(s.secondary_need) AS secondary_need, any_value(c.scene) AS scene,
  coalesce(any_value(q.evidence), []) AS evidence FROM tagged t JOIN feature_m f ON f.need = t.need AND f.rk = 1 JOIN secondary_need_m s ON s.need = t.need AND s.rk = 1
  JOIN scene_m c ON c.need = t.need AND c.rk = 1 LEFT JOIN quotes q ON q.need = t.need GROUP BY t.need),
profiled AS (SELECT *, lower(concat_ws(' ', need, feature, secondary_need, scene, array_to_string(evidence, ' '))) AS profile FROM needs),
layered AS (SELECT *, CASE {hints} ELSE {_map_sql('need', P.LAYER_BY_NEED, "'安全层'")} END AS layer FROM profiled)"""


NEEDS = TAGGED + _need_sql()


@query("need_evidence", NEEDS + " SELECT need, CAST(pos AS INTEGER) AS pos, text FROM quote WHERE pos <= 3")
def _(spark, d):
    return C.evidence(quotable(spark, d))


@query("need_profiles", NEEDS + " SELECT need, n, feature, secondary_need, scene, array_to_string(evidence, ' / ') AS evidence FROM needs")
def _(spark, d):
    return C.need_profiles(quotable(spark, d)).withColumn("evidence", F.array_join("evidence", " / "))


@query("need_layers", NEEDS + " SELECT need, layer, '回退分层：需求语义更接近' || layer || '。' AS reason, 'fallback' AS source FROM layered")
def _(spark, d):
    return R.need_layers(quotable(spark, d)).select("need", "layer", "reason", "source")


@query("need_layers_cached", NEEDS + """ SELECT need, CASE WHEN n >= 100 THEN '自我实现层' ELSE layer END AS layer, CASE WHEN n >= 100 THEN 'seen' ELSE '回退分层：需求语义更接近' || layer || '。' END AS reason,
  CASE WHEN n >= 100 THEN 'cache' ELSE 'fallback' END AS source FROM layered""")
def _(spark, d):
    """The answers for frequent needs come from the cache of an earlier run."""
    profiles = settle(C.need_profiles(quotable(spark, d)))
    cache = profiles.filter("n >= 100").select(E.profile_signature().alias("signature"), F.lit("自我实现层").alias("layer"), F.lit("seen").alias("reason"), F.lit("cache").alias("source"))
    return E.resolve_layers(profiles, cache).select("need", "layer", "reason", "source")


_LAYERS = B.values([(i, x, P.LAYER_DESCRIPTIONS[x]) for i, x in enumerate(P.LAYERS)])


@query("need_layer_totals", NEEDS + f""" SELECT l.pos, l.layer, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(sum(n), 0) / {TOTAL} AS share, l.description
  FROM {_LAYERS} l(pos, layer, description) LEFT JOIN layered USING (layer) GROUP BY l.pos, l.layer, l.description""")
def _(spark, d):
    return R.layer_totals(settle(R.need_layers(quotable(spark, d))))


@query("need_clusters", NEEDS + f""" SELECT layer, need, feature, secondary_need, scene, n, n / {TOTAL} AS share,
  '产品定义可优先强化 ' || feature || '，先把 ' || secondary_need || ' 做成对 ' || scene || ' 用户更明确的能力承诺。' AS hint FROM layered""")
def _(spark, d):
    return R.need_clusters(settle(R.need_layers(quotable(spark, d))))


# ---- aha moments and scenes ---------------------------------------------------------------------------

_TAKEAWAY = """CASE WHEN polarity = '负向' OR signal = '放弃采用' THEN coalesce(nullif(trim(product_name), ''), '该产品') || ' 在' || scene || '里必须把' || secondary_need || '做稳，否则用户不会继续采用。'
  WHEN signal = '喜欢什么' THEN coalesce(nullif(trim(product_name), ''), '该产品') || ' 在' || scene || '里把' || feature || '做得更顺，用户最看重的是' || secondary_need || '。'
  WHEN signal = '合理增配' THEN coalesce(nullif(trim(product_name), ''), '该产品') || ' 的方向被认可，但用户仍明确希望它把' || secondary_need || '做完整。'
  ELSE scene || '用户需要一台把' || secondary_need || '做清楚的' || feature || '产品。' END"""
_LINK = "'https://shop.example.com/dp/' || asin"  # all derived links have this form
_IMAGE = f"CASE WHEN image_refs <> '' THEN image_refs WHEN product_image <> '' THEN product_image WHEN product_link <> '' THEN '产品图回退 | ' || {_LINK} ELSE '' END"
_SOURCE = f"coalesce(nullif(concat_ws(chr(10), nullif({B.s_strip('raw_title')}, ''), nullif({B.s_strip('raw_comment')}, '')), ''), {B.s_strip('cleaned_comment')})"
_AHA = TAGGED + """, aha AS (SELECT *, row_number() OVER (ORDER BY aha_score DESC, CASE relation WHEN '高' THEN 0 ELSE 1 END,
  CASE originality WHEN '高' THEN 0 ELSE 1 END, rank_score DESC, ord) AS rank FROM tagged WHERE aha = '是')"""


@query("aha_ranking", _AHA + " SELECT rank, record_id, aha_score, relation, originality, rank_score FROM aha")
def _(spark, d):
    narrow = stored(spark, d, "ord", "record_id", "aha", "aha_score", "relation", "originality", "rank_score")
    return R.aha_ranking(narrow).select("rank", "record_id", "aha_score", "relation", "originality", "rank_score")


@query("aha_moments", _AHA + f""" SELECT rank, aha_score, relation, originality, product_name, product_link, scene, feature, secondary_need, {_TAKEAWAY} AS takeaway,
  {_SOURCE} AS source_text, pain, hint, {_IMAGE} AS image_evidence FROM aha""")
def _(spark, d):
    return R.aha_moments(stored(spark, d))


@query("aha_top", _AHA + f" SELECT CAST(rank AS INTEGER) AS rank, product_name, scene, feature, secondary_need, {_TAKEAWAY} AS takeaway FROM aha WHERE rank <= 5")
def _(spark, d):
    return R.aha_top(tagged(spark, d))


_PHRASE = f"""CASE signal WHEN '喜欢什么' THEN '用户看重 ' || feature || ' 带来的 ' || need WHEN '放弃采用' THEN '用户在 ' || feature || ' 上无法获得 ' || need
  WHEN '合理增配' THEN '用户希望进一步补足 ' || feature || ' 以强化 ' || need
  ELSE CASE WHEN length({B.s_strip('cleaned_comment')}) <= 56 THEN {B.s_strip('cleaned_comment')} ELSE substr({B.s_strip('cleaned_comment')}, 1, 55) || '…' END END"""
_SCENE = TAGGED + """, scored AS (SELECT *, CASE WHEN image_refs <> '' THEN 2 WHEN product_image <> '' OR product_link <> '' THEN 1 ELSE 0 END AS img FROM tagged),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY img DESC, aha_score DESC, rank_score DESC, ord) AS rk FROM scored)"""


@query("scene_representatives", _SCENE + " SELECT scene, record_id, img AS image_score FROM chosen WHERE rk = 1")
def _(spark, d):
    narrow = stored(spark, d, "ord", "record_id", "scene", "aha_score", "rank_score", "image_refs", "product_image", "product_link")
    return C.representatives(narrow).select("scene", "record_id", C.image_score().alias("image_score"))


@query("scene_cards", _SCENE + f""" SELECT c.scene, product_name, s.n, s.n / {TOTAL} AS share, persona, place, motivation, chain, {_PHRASE} AS phrase, {_IMAGE} AS image_evidence
  FROM chosen c JOIN (SELECT scene, count(*) AS n FROM tagged GROUP BY scene) s USING (scene) WHERE rk = 1""")
def _(spark, d):
    return R.scene_cards(stored(spark, d))


# ---- narrative -------------------------------------------------------------------------------------------

def _narrative_sql() -> str:
    parts = [f"(SELECT coalesce(string_agg(CASE WHEN parent <> '' THEN parent || '-' ELSE '' END || name || printf('%.2f%%', 100.0 * n / {TOTAL}), '、' ORDER BY rank), '暂无') FROM best WHERE block = '{b}') AS x_{b}" for b in R._NARRATED]
    text, rest = [], R.NARRATIVE
    columns = {b: f"x_{b}" for b in R._NARRATED} | {"focus": "'TestFocus'", "raw": "raw_rows", "kept": "kept_rows", "aha": "aha_rows"}
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        text += [B.q(head), columns[name]]
    text.append(B.q(rest))
    return _BLOCK_SQL + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, first_ord) AS rank FROM blocks) WHERE rank <= 3),
  parts AS (SELECT {', '.join(parts)}, (SELECT count(*) FROM flagged) AS raw_rows, (SELECT count(*) FROM tagged) AS kept_rows, (SELECT count(*) FROM tagged WHERE aha = '是') AS aha_rows)
  SELECT 'TestFocus' AS focus, raw_rows, kept_rows, aha_rows, {' || '.join(text)} AS narrative FROM parts"""


@query("review_narrative", _narrative_sql())
def _(spark, d):
    return R.narrative(counts(spark, d), "TestFocus", reviews=B.reviews(spark, d)).drop("emphasis")


@query("review_emphasis", _BLOCK_SQL + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, first_ord) AS rank FROM blocks) WHERE rank <= 3
    AND block IN ('feature', 'likes', 'churn', 'need', 'feature_secondary', 'negative_emotion', 'requests'))
  SELECT 'TestFocus' AS term UNION SELECT (SELECT count(*) FROM tagged) || ' 条' UNION SELECT name FROM best
  UNION SELECT printf('%.2f%%', 100.0 * n / {TOTAL}) FROM best WHERE block <> 'feature_secondary'""")
def _(spark, d):
    return R.narrative(counts(spark, d), "TestFocus").select(F.explode("emphasis").alias("term"))


# ---- joins -------------------------------------------------------------------------------------------------

_CACHE_SQL = f"SELECT DISTINCT {B.s_collapse('text')} AS text FROM documents JOIN labels USING (doc_id)"


def _cache(spark, d):
    """Translations exist for the documents that have been labelled."""
    from earshot.functions import text as T
    docs = B.read(spark, d, "documents").join(B.read(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return docs.select(T.collapse("text").alias("text")).distinct().withColumn("translated", F.concat(F.lit("译："), "text"))


@query("translation_pending", f"WITH cache AS ({_CACHE_SQL}) SELECT DISTINCT t AS text FROM (SELECT {B.s_collapse('text')} AS t FROM documents) WHERE t <> '' AND t NOT IN (SELECT text FROM cache)")
def _(spark, d):
    return E.pending_texts(B.read(spark, d, "documents"), ["text"], _cache(spark, d))


@query("translation_applied", f"""WITH cache AS ({_CACHE_SQL}) SELECT doc_id, CASE WHEN c.text IS NULL THEN d.text ELSE '译：' || c.text END AS translated
  FROM documents d LEFT JOIN cache c ON {B.s_collapse('d.text')} = c.text""")
def _(spark, d):
    return E.apply_cache(B.read(spark, d, "documents"), _cache(spark, d), "text", "translated").select("doc_id", "translated")


@query("translation_applied_or_blank", f"""WITH cache AS ({_CACHE_SQL}) SELECT doc_id, CASE WHEN c.text IS NULL THEN '' ELSE '译：' || c.text END AS translated
  FROM documents d LEFT JOIN cache c ON {B.s_collapse('d.text')} = c.text""")
def _(spark, d):
    return E.apply_cache(B.read(spark, d, "documents"), _cache(spark, d), "text", "translated", fallback="blank").select("doc_id", "translated")
