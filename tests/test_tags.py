import random

from pyspark.sql import functions as F

from earshot.functions.rules import KeywordIndex
from earshot.operators import clean as CL, counts as C, tag as TG
from earshot.operators.skew import carry_forward, number_by, spread_join
from earshot.packs import reviews as P


def records(spark, rows):
    """(ord, focus, product, comment, rating, images) as review records."""
    df = spark.createDataFrame(rows, "ord bigint, focus_name string, product_name string, cleaned_comment string, rating double, image_count int")
    missing = [c for c in P.RECORD_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit("") for c in missing})


CASES = [
    (1, "", "", "no sound after a week, should add a remote", 2.0, 0),
    (2, "", "", "Finally! I use this to switch between my headphones and speakers, perfect.", 5.0, 1),
    (3, "", "", "建议增加遥控器，音量旋钮很好用", None, 0),
]
COLUMNS = ("viewpoint", "feature", "secondary_need", "need", "signal", "polarity", "intensity", "emotion", "trigger", "scene", "aha", "aha_score", "relation", "originality", "rank_score")
EXPECTED = [
    ("缺陷复现", "音量", "远程调节更方便", "控制确定性", "放弃采用", "负向", "中等", "烦躁麻烦", "音量", "通用补洞", "否", 0, "低", "低", 8),
    ("优点", "场景", "一机多用更顺手", "降摩擦", "喜欢什么", "正向", "强烈", "惊喜超预期", "场景", "耳机音箱切换", "是", 8, "高", "高", 7),
    ("建议", "音量", "远程调节更方便", "控制确定性", "合理增配", "正向", "中等", "满意认可", "音量", "通用补洞", "否", 1, "低", "低", 6),
]


def test_hand_cases(spark):
    tagged = TG.tag(CL.clean_reviews(records(spark, CASES)))
    assert [tuple(r) for r in tagged.orderBy("ord").select(*COLUMNS).collect()] == EXPECTED


def test_plan_is_native(spark):
    tagged = TG.tag(CL.clean_reviews(records(spark, CASES)))
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "EvalPython" not in plan and "CartesianProduct" not in plan


def test_hits_equal_contains(spark):
    index = TG.comment_index()
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(index.keywords) + rnd.choice(["", "x", "，"]) for _ in range(rnd.randint(0, 9))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", index.hits_by_scan(F.col("t")).alias("h")).collect()
    assert all(set(r.h) == {k for k in index.keywords if k in r.t} for r in rows)


def test_duplicates_keep_the_first(spark):
    rows = [(5, "f", "a", "great  SOUND", 1.0, 0), (2, "f", "b", "Great sound!", 1.0, 0), (3, "", "a", "Great sound", 1.0, 0), (4, "", "b", "Great sound", 1.0, 0)]
    got = {r.ord: r.drop_reason for r in CL.clean_reviews(records(spark, rows).repartition(3)).collect()}
    assert got == {2: "", 5: "duplicate", 3: "", 4: ""}


def test_number_by_is_a_global_order(spark):
    rnd = random.Random(2)
    rows = [(o, rnd.randint(0, 2)) for o in rnd.sample(range(1 << 20), 500)]
    got = number_by(spark.createDataFrame(rows, "ord bigint, s int"), [-F.col("s")], "ord", "rank").collect()
    want = {o: i + 1 for i, (o, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert {r.ord: r.rank for r in got} == want


def test_carry_forward_over_blocks(spark):
    rows = [("a", 1, "x"), ("a", 70000, None), ("a", 200000, None), ("a", 200001, "y"), ("a", 400000, None), ("b", 5, None)]
    got = carry_forward(spark.createDataFrame(rows, "g string, p bigint, v string"), "g", "p", ["v"]).orderBy("g", "p").collect()
    assert [r.v for r in got] == ["x", "x", "x", "y", "y", None]


def test_spread_join_with_a_hot_key(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(900, None), (901, "lost")], "i int, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 900, 6)], "k string, v int")
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, "k", how).select("i", "k", "v").collect()), key=lambda r: r[0])
        got = sorted(map(tuple, spread_join(left, right, ["k"], how).select("i", "k", "v").collect()), key=lambda r: r[0])
        assert got == want


def test_shares_sum_to_one(spark):
    counts = C.label_counts(TG.tag(CL.clean_reviews(records(spark, CASES))))
    shares = C.with_share(C.fold(counts, "feature"), counts).agg(F.sum("share")).first()[0]
    assert abs(shares - 1) < 1e-9


def test_reasons_are_decided_once_and_labels_by_the_number_of_their_first_rule(spark):
    from pyspark.sql import functions as F

    from earshot.functions import rules
    from earshot.operators import clean

    rows = spark.createDataFrame([(1, "", "p", "", "great sound"), (2, "", "p", "", "great  sound"), (3, "", "p", "", "ok")], "ord bigint, focus_name string, product_name string, scene_name string, cleaned_comment string")
    valid = clean.kept(clean.clean_reviews(rows))
    assert [r.ord for r in valid.collect()] == [1]
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("logistics_or_seller_only") == 1
    order = [("x", ("a", "b")), ("y", ("b", "c")), ("z", ())]
    hits = spark.createDataFrame([(["c"],), (["c", "b"],), (["d"],), ([],)], "h array<string>")
    assert [r[0] for r in hits.select(rules.first_label(F.col("h"), order, "none")).collect()] == ["y", "x", "none", "none"]
    assert str(rules.first_label(F.col("h"), order)).count("arrays_overlap") == 0


def test_copies_are_marked_without_moving_rows_or_by_number(spark):
    rnd = random.Random(3)
    rows = [(o, rnd.choice("abcdefgh"), rnd.random() < 0.7) for o in [*range(300), 1 << 40, (1 << 53) + 63, (1 << 53) + 64]]
    df = spark.createDataFrame(rows, "ord bigint, k string, c boolean").repartition(3)
    first = {}
    for o, k, c in rows:
        if c:
            first.setdefault(k, o)
    want = {o: c and first[k] != o for o, k, c in rows}
    for most in (CL.MOST_WORDS, 0):
        marked = CL._marked(df, F.col("c"), F.col("k"), most)
        assert {r.ord: r._copy for r in marked.collect()} == want
        plan = marked._jdf.queryExecution().optimizedPlan().toString()
        assert ("_word" in plan) == (most > 0)


def test_profiles_from_stored_quotes(spark):
    tagged = TG.tag(CL.clean_reviews(records(spark, CASES)))
    narrow = C.quotable(tagged)
    assert "cleaned_comment" not in narrow.columns and "raw_comment" not in narrow.columns
    profiles = [sorted(map(tuple, C.need_profiles(t).withColumn("evidence", F.to_json("evidence")).collect())) for t in (tagged, narrow)]
    assert profiles[0] == profiles[1] and len(profiles[0]) == 2


def test_narrative_counts_lost_rows_without_cleaning_again(spark):
    from earshot.plans import review_report as R
    rows = records(spark, [*CASES, (4, "", "", "ok", None, 0)])
    cleaned = CL.clean_reviews(rows)
    counts = C.label_counts(TG.tag(cleaned))
    old, new = R.narrative(counts, "f", CL.dropped(cleaned)), R.narrative(counts, "f", reviews=rows)
    assert old.collect() == new.collect() and new.first().raw_rows == 4


def test_layers_asked_for_equal_those_of_the_whole_table_and_others_are_not_decided(spark):
    cleaned = CL.clean_reviews(records(spark, CASES))
    whole = TG.tag(cleaned)
    for layers in (("scene",), ("feature", "secondary_need"), ("emotion", "polarity", "scene"), ("originality",), ("analysis", "chain")):
        some = TG.tag(cleaned, layers=layers)
        assert some.columns == [*cleaned.columns, *layers]
        assert some.select("ord", *layers).orderBy("ord").collect() == whole.select("ord", *layers).orderBy("ord").collect()
    plan = TG.tag(cleaned, layers=("scene",)).select("scene")._jdf.queryExecution().optimizedPlan().toString()
    assert "疑似灌水" not in plan and "被噪音打断" not in plan
    counts = C.label_counts(TG.tag(cleaned, layers=("feature",)), ("feature",))
    assert sorted(map(tuple, counts.select("feature", "n").collect())) == [("场景", 1), ("音量", 2)]


def test_reasons_are_decided_behind_the_spreading_and_not_again_for_kept_rows(spark):
    rows = records(spark, [*CASES, (4, "", "", "ok", None, 0), (5, "", "", "No sound after a week; should add a remote!", 1.0, 0)])
    cleaned = CL.clean_reviews(rows.repartition(3))
    assert {r.ord: (r.drop_reason, r.is_valid) for r in cleaned.collect()} == {
        1: ("", True), 2: ("", True), 3: ("", True), 4: ("low_information", False), 5: ("duplicate", False)}
    plan = CL.kept(cleaned).select("ord", "cleaned_comment")._jdf.queryExecution().optimizedPlan().toString()
    assert "logistics_or_seller_only" not in plan


def test_places_without_keywords_are_left_early(spark):
    for words in (TG.comment_index().keywords, TG.comment_index(layers=("scene",)).keywords, ["ab", "abc", "bcd", "9", "比", "比较", "x.y"]):
        texts = [f"{a}{w}{b}" for w in words for a, b in (("", ""), ("x", "e "), ("比", "9"))]
        index = KeywordIndex(words)
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", index.hits_by_scan(F.col("t")).alias("h")).collect()
        assert all(set(r.h) == {k for k in words if k in r.t} for r in got)
