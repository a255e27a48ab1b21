"""Inputs of the registered queries, derived from the given tables.

No review table is given, so one is derived from ``events``, ``part`` and
``documents``: events become short reviews made of fixed sentences, every document
becomes one review with its whole text.  Each input exists twice, as a Spark
DataFrame and as SQL text for the check engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earshot.functions import text as T

# ---- sentences ------------------------------------------------------------------

SENTENCES = (
    "Great sound and easy to switch between my headphones and speakers.",
    "No sound after a week, should add a remote.",
    "Finally! I use this to switch between my headphones and speakers, perfect.",
    "Volume knob feels cheap and the button stopped working.",
    "good", "N/A", "", "👍👍", "Отлично", "Love it",
    "Use my coupon today and get a discount code.",
    "Fast shipping, arrived on time.",
    "Fast shipping and great sound!!",
    "There is a hum and some static noise, very annoying.",
    "Better than the other RCA selector I had before.",
    "Not as described, the description is misleading.",
    "The best ever, must buy.",
    "The best ever switch box, must buy for anyone who owns two amplifiers and several pairs of passive loudspeakers.",
    "I expected more from this preamp, the phono stage is weak.",
    "Works with my turntable and the old receiver in the living room.",
    "Compact and small, hides on my desk next to the computer.",
    "The metal build is sturdy and durable.",
    "Price is worth it, cheap and solid value.",
    "I wish it had HDMI and more USB outputs!",
    "Arrived broken, one channel is dead.",
    "The LED indicator label is hard to read.",
    "Would be better with a mute button for late night TV.",
    "Perfect for my Xbox and PS5 console, game audio is clear.",
    "Used it in an Arduino project with a relay, never thought it would be this simple.",
    "Latency and delay make it useless with my synth and DAW.",
    "Compared to the old one it has less distortion.",
    "Compatible with every XLR and toslink adapter I own.",
    "Connection is intermittent, the left speaker drops out.",
    "It does what it says.",
    "Instead of unplugging cables I press one button, exactly what I needed.",
    "Trash. Garbage. Do not buy!",
    "Headphone gain is too low, needs to be louder.",
    "Nice design and look, premium quality feel.",
    "ok", "works",
    "I was surprised by the creative ways to route between multiple devices.",
    "Useful little box", "Amazing! Brilliant! Excellent value.",
    "Poor packaging and a bad smell.",
    "The  seller   was great\tand customer service too.",
    "Sample rate and format support is limited, s/pdif only.",
    "Clean sound quality, no noise at all in my bedroom setup.",
    "Meh.",
    "Contact issue in the input selector after failed after two months.",
    "i hope they add a remote, the couch is far away from the receiver",
    "Record player and guitar amp both connected without issue.",
    "Level match between inputs is off, balance is wrong.",
    "Auto switching is quick and convenient.",
)
CHINESE = (
    "很好用", "建议增加遥控器，音量旋钮很好用", "一键切换很方便，终于不再反复插拔", "没声音，坏了，要退货", "底噪和电流声太大",
    "比之前的切换器好用", "性价比很高，值这个价格", "物流很快，包装完好", "物流很快，音质也清晰！！", "与描述不符，误导人",
    "黑胶转盘接前级正好补足旧系统", "桌面小巧，外观精致有质感", "加微信返现", "接口兼容电视和客厅音箱", "没想到还能这样玩，惊喜的新玩法",
    "希望多设备场景更灵活", "", "失真严重，无法使用", "绝对必买，吹爆",
)
TITLES = ("", "", "Good", "", "Not what I thought", "", "五星", "")
THEMES = ("", "", "", "模拟切换器", "Audio Hub 方案", "数字切换器", "切换前级", "AVR 接入", "")
SCENES = ("", "", "living room", "", "办公", "", "")

DOC_BASE = 10**12
HEAVY = ("documents", "events", "pages", "conversations")  # tables with texts to work on


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one that lies in fewer files than there are cores is spread.

    Splits of a file say nothing: a file of one row group has its rows in one of them,
    whatever its size.  A table of many files is read as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name not in HEAVY or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, df.rdd.getNumPartitions()))


def pick(words, index: Column) -> Column:
    """Word number ``index`` modulo the length of the list."""
    listed = F.expr("array(" + ", ".join(map(T.quoted, words)) + ")")
    return F.element_at(listed, (F.pmod(index, F.lit(len(words))) + 1).cast("int"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_pick(words, index: str) -> str:
    return f"[{', '.join(map(q, words))}][CAST(({index}) % {len(words)} AS BIGINT) + 1]"


# ---- text helpers in SQL ----------------------------------------------------------------

def s_collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(T.SPACE + '+')}, ' ', 'g'))"


def s_norm(x: str) -> str:
    return s_collapse(f"lower(coalesce({x}, ''))")


def s_key(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), {q(T.NON_KEY)}, '', 'g')"


def s_strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"


def s_any(x: str, words) -> str:
    return f"list_bool_or(list_transform([{', '.join(map(q, words))}], lambda k: contains({x}, k)))"


def s_in(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def values(rows) -> str:
    def one(v):
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


# ---- reviews -----------------------------------------------------------------------------------

def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p, d = (read(spark, sf_dir, n) for n in ("events", "part", "documents"))
    c = F.col
    i = c("event_id")
    code = F.concat(F.lit("B"), F.lpad(c("user_id").cast("string"), 9, "0"))
    second = F.floor(i / len(SENTENCES))
    body = F.when(
        c("event_type").isin("view", "click"), F.concat(pick(SENTENCES, i * 7), F.lit(" "), pick(SENTENCES, second))
    ).otherwise(pick(SENTENCES, i * 7))
    blank = F.lit("")
    short = e.join(p, e["user_id"] == p["p_partkey"], "left").select(
        i.alias("ord"), F.concat(F.lit("ev-"), i.cast("string")).alias("record_id"), blank.alias("focus_name"), code.alias("asin"),
        F.when(i % 13 == 0, "").otherwise(T.text_of("p_name")).alias("product_name"),
        F.when(i % 5 == 0, F.concat(F.lit("img/"), c("user_id").cast("string"), F.lit(".jpg"))).otherwise("").alias("product_image"),
        F.when(i % 3 == 0, F.concat(F.lit("https://shop.example.com/x/dp/"), code, F.lit("?ref=1"))).otherwise("").alias("product_link"),
        blank.alias("thread_url"), pick(THEMES, F.floor(i / 7)).alias("source_primary_theme"),
        blank.alias("source_secondary_theme"), blank.alias("source_topic_labels"), pick(SCENES, i).alias("scene_name"),
        F.lower(T.text_of("p_type")).alias("keyword_source"), F.lit("review").alias("source_type"),
        c("event_type").alias("source_sheet"), i.cast("int").alias("source_row"),
        T.first_filled("p_brand", F.lit("未提供")).alias("store"), F.lit("未提供").alias("country"),
        F.when(i % 17 == 0, None).otherwise((1 + i % 5).cast("double")).alias("rating"), blank.alias("rating_text"),
        F.date_format("ts", "yyyy-MM-dd").alias("review_date"), pick(TITLES, i).alias("raw_title"),
        blank.alias("translated_title"), body.alias("raw_comment"),
        F.when(c("event_type") == "signup", pick(CHINESE, i * 5)).otherwise("").alias("translated_comment"),
        F.when(c("value") > 40, 2).otherwise(0).alias("image_count"),
        F.when(c("value") > 40, "a.jpg | b.jpg").otherwise("").alias("image_refs"),
    )
    whole = d.select(
        (F.lit(DOC_BASE) + c("doc_id")).alias("ord"), F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("record_id"),
        *[blank.alias(n) for n in ("focus_name", "asin")], c("source").alias("product_name"),
        *[blank.alias(n) for n in ("product_image", "product_link", "thread_url", "source_primary_theme",
                                   "source_secondary_theme", "source_topic_labels", "scene_name")],
        c("lang").alias("keyword_source"), F.lit("review").alias("source_type"), F.lit("documents").alias("source_sheet"),
        c("doc_id").cast("int").alias("source_row"), F.lit("未提供").alias("store"), F.lit("未提供").alias("country"),
        F.lit(None).cast("double").alias("rating"), *[blank.alias(n) for n in ("rating_text", "review_date", "raw_title", "translated_title")],
        c("text").alias("raw_comment"), blank.alias("translated_comment"), F.lit(0).alias("image_count"), blank.alias("image_refs"),
    )
    return short.unionByName(whole).withColumn(
        "cleaned_comment", T.review_text("translated_title", "translated_comment", "raw_title", "raw_comment")
    )


def _sql_reviews() -> str:
    code = "'B' || lpad(CAST(user_id AS VARCHAR), 9, '0')"
    body = f"{sql_pick(SENTENCES, 'event_id * 7')}"
    more = f"{sql_pick(SENTENCES, f'event_id // {len(SENTENCES)}')}"
    events = f"""
SELECT event_id AS ord, 'ev-' || event_id AS record_id, '' AS focus_name, {code} AS asin,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE coalesce(p_name, '') END AS product_name,
  CASE WHEN event_id % 5 = 0 THEN 'img/' || user_id || '.jpg' ELSE '' END AS product_image,
  CASE WHEN event_id % 3 = 0 THEN 'https://shop.example.com/x/dp/' || {code} || '?ref=1' ELSE '' END AS product_link,
  '' AS thread_url, {sql_pick(THEMES, 'event_id // 7')} AS source_primary_theme, '' AS source_secondary_theme,
  '' AS source_topic_labels, {sql_pick(SCENES, 'event_id')} AS scene_name, lower(coalesce(p_type, '')) AS keyword_source,
  'review' AS source_type, event_type AS source_sheet, CAST(event_id AS INTEGER) AS source_row,
  coalesce(nullif(p_brand, ''), '未提供') AS store, '未提供' AS country,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS DOUBLE) END AS rating, '' AS rating_text,
  strftime(ts, '%Y-%m-%d') AS review_date, {sql_pick(TITLES, 'event_id')} AS raw_title, '' AS translated_title,
  CASE WHEN event_type IN ('view', 'click') THEN {body} || ' ' || {more} ELSE {body} END AS raw_comment,
  CASE WHEN event_type = 'signup' THEN {sql_pick(CHINESE, 'event_id * 5')} ELSE '' END AS translated_comment,
  CASE WHEN value > 40 THEN 2 ELSE 0 END AS image_count, CASE WHEN value > 40 THEN 'a.jpg | b.jpg' ELSE '' END AS image_refs
FROM events LEFT JOIN part ON user_id = p_partkey"""
    docs = f"""
SELECT {DOC_BASE} + doc_id, 'doc-' || doc_id, '', '', source, '', '', '', '', '', '', '', lang, 'review', 'documents',
  CAST(doc_id AS INTEGER), '未提供', '未提供', NULL, '', '', '', '', text, '', 0, '' FROM documents"""
    pair = "trim(concat_ws('。', nullif({0}, ''), nullif({1}, '')), '。')"
    chosen = (
        f"CASE WHEN translated_title <> '' OR translated_comment <> '' THEN {pair.format('translated_title', 'translated_comment')} "
        f"ELSE {pair.format('raw_title', 'raw_comment')} END"
    )
    return f"SELECT *, {chosen} AS cleaned_comment FROM ({events} UNION ALL {docs}) AS r"


SQL_REVIEWS = _sql_reviews()


# ---- return remarks ------------------------------------------------------------------------------

REMARKS = (
    "", "无法开机，电源异常", "只有单声道出声音，疑似故障", "连接HDMI后无声音", "HDMI CEC 不支持", "底噪很大，有电流声", "播放时失真破音",
    "买错型号了", "不再需要", "缺少 AirPlay", "音量增益不合理", "与描述不符，页面误导", "收到的像二手商品", "刚买就降价了", "包装损坏，缺少配件",
    "音质未达到预期", "同上", "N/A", "The unit is dead, no sound", "Ordered the wrong model", "Loud hum and noise from the left channel",
    "Not compatible with my receiver", "Found another one, cheaper elsewhere", "I was disappointed", "Fine but not for me",
    "Subwoofer output is missing", "接口不兼容，光纤播放断续", "not as described",
)
REASONS = ("不再需要", "质量问题", "", "买错", "NA")
MODELS = ("LC30 amplifier", "BOX  X2 dac", "p4 preamp", "LC30 and BOX X2", "ZD3", "cable")
MANUAL = ("", "", "", "故障", "用户问题", "", "噪音", "")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remarks from events (short) and documents (whole texts), before any choice."""
    e, d = read(spark, sf_dir, "events"), read(spark, sf_dir, "documents")
    c, blank = F.col, F.lit("")
    i = c("event_id")
    when = (
        F.when(i % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(i % 4 == 1, F.date_format("ts", "yyyy/M/d"))
        .when(i % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("soon"))
    )
    short = e.select(
        i.alias("ord"), F.concat(F.lit("ev-"), i.cast("string")).alias("record_id"), pick(MODELS, c("user_id")).alias("product_name"),
        F.when(c("event_type").isin("error", "view"), "return").when(c("event_type") == "click", "after_sales").otherwise("review").alias("source_type"),
        c("event_type").alias("source_sheet"), i.cast("int").alias("source_row"), when.alias("return_time"),
        F.lit("未提供").alias("store"), F.lit("未提供").alias("country"),
        F.when(c("event_type") == "signup", "").otherwise(pick(REMARKS, i * 3)).alias("raw_comment"),
        F.when(c("event_type") == "signup", pick(REMARKS, F.floor(i / 3))).otherwise("").alias("translated_comment"),
        pick(REASONS, F.floor(i / 2)).alias("return_reason"),
        pick(MANUAL, F.floor(i / 11)).alias("level_1"), blank.alias("level_2"), blank.alias("level_3"), blank.alias("level_4"),
        (c("event_type") == "error").alias("text_expected"), F.lit("events.xlsx").alias("workbook"),
    )
    whole = d.select(
        (F.lit(DOC_BASE) + c("doc_id")).alias("ord"), F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("record_id"),
        c("source").alias("product_name"), F.lit("review").alias("source_type"), F.lit("documents").alias("source_sheet"),
        c("doc_id").cast("int").alias("source_row"), blank.alias("return_time"), F.lit("未提供").alias("store"), F.lit("未提供").alias("country"),
        c("text").alias("raw_comment"), blank.alias("translated_comment"), blank.alias("return_reason"),
        *[blank.alias(f"level_{k}") for k in (1, 2, 3, 4)], F.lit(False).alias("text_expected"), F.lit("documents.xlsx").alias("workbook"),
    )
    return short.unionByName(whole)


def _sql_feedback() -> str:
    remark = sql_pick(REMARKS, "event_id * 3")
    other = sql_pick(REMARKS, "event_id // 3")
    return f"""
SELECT event_id AS ord, 'ev-' || event_id AS record_id, {sql_pick(MODELS, 'user_id')} AS product_name,
  CASE WHEN event_type IN ('error', 'view') THEN 'return' WHEN event_type = 'click' THEN 'after_sales' ELSE 'review' END AS source_type,
  event_type AS source_sheet, CAST(event_id AS INTEGER) AS source_row,
  CASE event_id % 4 WHEN 3 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS iso_day,
  '未提供' AS store, '未提供' AS country,
  CASE WHEN event_type = 'signup' THEN '' ELSE {remark} END AS raw_comment,
  CASE WHEN event_type = 'signup' THEN {other} ELSE '' END AS translated_comment,
  {sql_pick(REASONS, 'event_id // 2')} AS return_reason, {sql_pick(MANUAL, 'event_id // 11')} AS level_1,
  '' AS level_2, '' AS level_3, '' AS level_4, event_type = 'error' AS text_expected, 'events.xlsx' AS workbook
FROM events
UNION ALL
SELECT {DOC_BASE} + doc_id, 'doc-' || doc_id, source, 'review', 'documents', CAST(doc_id AS INTEGER), '', '未提供', '未提供',
  text, '', '', '', '', '', '', false, 'documents.xlsx' FROM documents"""


SQL_FEEDBACK = _sql_feedback()
