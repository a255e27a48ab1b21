from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators.clean import drop_reason
from earshot.operators.listings import scenario_label
from earshot.operators.returns import is_quality_risk, severity
from earshot.sources.cells import product_tokens
from earshot.sources.files import chunks


def values(spark, inputs, fn):
    rows = list(enumerate(inputs))
    df = spark.createDataFrame(rows, "i int, x string")
    return [r.v for r in df.select("i", fn("x").alias("v")).orderBy("i").collect()]


def test_normalise_and_key(spark):
    assert values(spark, ["  A  b　C ", None], T.normalize) == ["a b c", ""]
    assert values(spark, ["Great  SOUND!", "Отлично", "音质 ok"], T.key) == ["greatsound", "", "音质ok"]
    assert values(spark, ["　 x  "], T.strip) == ["x"]


def test_drop_reason(spark):
    cases = {
        "": "empty_or_na", "N/A": "empty_or_na", "👍👍": "emoji_or_punctuation_only", "Отлично": "emoji_or_punctuation_only",
        "Love it": "low_information", "很好用": "low_information", "g . o . o . d" + "." * 50: "low_information", "good good": "",
        "Use my coupon today": "spam_or_ad", "Fast shipping, arrived on time": "logistics_or_seller_only",
        "Fast shipping and great sound": "", "Fast shipping, huge benefit": "",
    }
    assert values(spark, list(cases), drop_reason) == list(cases.values())


def test_numbers_and_dates(spark):
    assert values(spark, ["4.0 out of 5 stars", "", "n/a", None], T.number) == [4.0, 0.0, 0.0, 0.0]
    dates = ["Reviewed in Singapore on 5 March 2024", "x on March 5, 2024", "yesterday", None]
    assert values(spark, dates, T.review_date) == ["2024-03-05", "March 5, 2024", "yesterday", ""]
    times = values(spark, ["2024/1/5", "2024-01-05 10:00:00", "soon", "2024-13-01"], T.timestamp)
    assert [str(t) if t else None for t in times] == ["2024-01-05 00:00:00", "2024-01-05 10:00:00", None, None]
    assert values(spark, ["不搜索：1、8、11、1"], T.numbers_in) == [[1, 8, 11]]


def test_comment_choice(spark):
    pick = lambda *a: spark.range(1).select(T.review_text(*map(F.lit, a))).first()[0]
    assert pick("好", "", "Good", "Works") == "好"
    assert pick("", "", "Good", "Works。") == "Good。Works"


def test_product_tokens(spark):
    assert values(spark, ["LC30 and BOX  X2 p4"], product_tokens) == [["LC30", "BOX X2", "P4"]]


def test_risks(spark):
    assert values(spark, ["连接HDMI后无声音"], severity) == ["high"]
    assert values(spark, ["连接HDMI后无声音"], is_quality_risk) == [False]


def test_scenario_label(spark):
    fn = lambda c: scenario_label(c, F.array().cast("array<string>"))
    assert values(spark, ["Ampoule holder", "RCA audio switch"], fn) == ["功放切换器", "RCA切换器"]


def test_chunks_match_brute_force(spark):
    texts = ["a" * 10, ("word. " * 30).strip(), "line one\n" * 12, "x" * 95]

    def brute(text, size):
        if len(text) <= size:
            return [text]
        out = []
        while text:
            cut = len(text)
            if cut > size:
                cut = next((p for p in (text.rfind("\n", 0, size), text.rfind(". ", 0, size)) if p >= size / 2), size)
            out.append(text[:cut].strip())
            text = text[cut:].strip()
        return [p for p in out if p]

    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = {}
    for r in chunks(df, "k", "t", size=40).orderBy("k", "part").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert [got[i] for i in range(len(texts))] == [brute(t, 40) for t in texts]


def test_chunks_of_random_texts(spark):
    """Native cuts against the definition, with white space at the ends and around cuts."""
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("aab. \n") for _ in range(rng.randint(0, 150))) for _ in range(1500)]

    def brute(text, size):
        if len(text) <= size:
            return [text]
        out = []
        while len(text) > size:
            cut = next((p for p in (text.rfind("\n", 0, size), text.rfind(". ", 0, size)) if p >= size / 2), size)
            out.append(text[:cut].strip())
            text = text[cut:].strip()
        return [p for p in [*out, text] if p]

    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = {}
    for r in chunks(df, "k", "t", size=40).orderBy("k", "part").collect():
        got.setdefault(r.k, []).append(r.chunk)
    wrong = [(t, got.get(i, []), brute(t, 40)) for i, t in enumerate(texts) if got.get(i, []) != brute(t, 40)]
    assert not wrong, (len(wrong), wrong[0])


def test_written_day_and_large_counts(spark):
    assert [str(x) for x in values(spark, ["2024-01-05T23:30:00-08:00", "2024-01-05 10:00:00Z"], T.timestamp)] == ["2024-01-05 23:30:00", "2024-01-05 10:00:00"]
    assert values(spark, ["3,000,000,000 ratings"], T.rating_count) == [3000000000]


def test_keys_are_cut_by_a_plain_class_that_holds_the_characters_of_the_negated_one(spark):
    points = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("u"))
    d = points.select(F.concat(F.lit("x "), "u", F.lit("Y"), "u", "u", F.lit("z")).alias("v"))
    assert d.filter(T.key("v") != F.regexp_replace(F.lower("v"), T.NON_KEY, "")).count() == 0
    plan = d.select(T.key("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^" not in plan


def test_white_space_class_lists_the_same_characters(spark):
    points = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    differ = points.filter(F.regexp_replace("c", T.SPACE, "") != F.regexp_replace("c", T.SPACE_CHAR, ""))
    assert T.SPACE_CHAR != T.SPACE and differ.count() == 0
    assert "&&" in str(T.normalize("c"))


def test_runs_of_white_space_are_replaced_and_single_spaces_left(spark):
    gaps = ["", " ", "  ", "\t", " \t", "\n ", "\u3000", " \u00a0 ", "\u2003\u2003"]
    texts = [f"{a}x{b}y{c}" for a in gaps for b in gaps for c in gaps[:4]]
    assert values(spark, texts, T.collapse) == [" ".join(t.split()) for t in texts]
    assert values(spark, ["a b c"], lambda c: F.size(F.regexp_extract_all(c, F.lit(f"({T.SPACE_RUN})"), F.lit(1)))) == [0]


def test_key_length_reads_the_beginning_of_a_long_text(spark):
    texts = ["", "a b", "ab " * 30, "." * 500 + "x" * 79, "." * 500 + "x" * 90, "x" * 79 + "." * 900, "音" * 81]
    assert [min(n, 80) for n in values(spark, texts, lambda c: T.key_length(c, 80))] == [0, 2, 60, 79, 80, 79, 80]
    assert values(spark, ["ab " * 5000], lambda c: T.key_length(c, 80)) == [80]
