"""Order of reviews, numbers beyond their bits, caches that hold several answers."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from earshot.operators import counts, enrich, listings
from earshot.packs import reviews


def test_reviews_of_a_large_product_are_numbered_over_many_tasks(spark):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.5 else draw.choice("abc"), f"R{i:05d}", draw.choice([None, 1.0, 2.0, 5.0])) for i in range(4000)]
    rows += [(None, "R9", 1.0), (None, "R8", 2.0)]
    draw.shuffle(rows)
    got = listings.order_reviews(spark.createDataFrame(rows, "asin string, reviewId string, rating double").repartition(3)).collect()
    want = []
    for asin in {a for a, _, _ in rows}:
        mine = sorted((r for r in rows if r[0] == asin), key=lambda r: (-(r[2] or 0), r[1]))
        want += [(a, i, r, n) for n, (a, i, r) in enumerate(mine, 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_the_longest_text_wins_at_any_sequence_number(spark):
    base = 1 << 60
    rows = [(base, "a", "r", "long text"), (base - 1, "a", "r", "long text too"), (base + 1, "a", "r", None)]
    views = spark.createDataFrame(rows, "ord bigint, asin string, reviewId string, body string")
    for c in ("title", "author", "dateText", "ratingText", "view_label"):
        views = views.withColumn(c, F.lit(""))
    views = views.withColumn("images", F.array().cast("array<string>")).withColumn("rating", F.lit(1.0)).withColumn("verifiedPurchase", F.lit(True)).withColumn("view_ord", F.lit(0))
    assert [r.body for r in listings.merge_reviews(views).collect()] == ["long text too"]


def test_a_sequence_number_beyond_its_bits_is_an_error(spark):
    with pytest.raises(PySparkException, match="sequence number"):
        spark.range(1).select(counts.packed(F.lit(1), F.lit(1 << 54))).collect()


def test_of_several_cached_answers_one_counts(spark):
    texts = spark.createDataFrame([(1, "hello  there"), (2, "unknown"), (3, "failed")], "id int, text string")
    cache = spark.createDataFrame([("hello there", "a"), ("hello there", "b"), (" hello there", None), ("failed", None)], "text string, translated string")
    got = {r.id: r.out for r in enrich.apply_cache(texts, cache, "text", "out").collect()}
    assert got == {1: "b", 2: "unknown", 3: "failed"}


def test_a_profile_stays_one_row_beside_several_cached_layers(spark):
    profiles = spark.sql("SELECT 'n' AS need, 1L AS n, 'f' AS feature, 's' AS secondary_need, 'x' AS scene, array('e') AS evidence")
    signature = profiles.select(enrich.profile_signature()).first()[0]
    first, second = sorted(reviews.LAYERS)[:2]
    rows = [(signature, first, "r", "model"), (signature, second, "q", "model"), (signature, "none", "z", "model")]
    cache = spark.createDataFrame(rows, "signature string, layer string, reason string, source string")
    got = enrich.resolve_layers(profiles, cache).collect()
    assert [(r.layer, r.reason, r.source) for r in got] == [(second, "q", "model")]


def test_tied_products_are_in_code_point_order_in_the_queries_and_in_locale_order_by_default(spark, tmp_path):
    from earshot.showcase import listings as showcase

    # all ratings and counts are alike: only titles, RCA, speaker, line and mixer among them, and the order of reading decide
    keys = [k for i in range(1, 60) if 100 <= (k := 38102 + 58620 * i) % 1000 <= 899]
    spark.createDataFrame([(k, i, "O", "5-LOW") for i, k in enumerate(keys)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, "old rod", "b") for i in range(60)], "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    passing = showcase.passing(spark, str(tmp_path)).collect()
    assert len({(r.ratingCount, r.ratingAverage) for r in passing}) == 1 and len({r.title for r in passing}) > 5
    got = showcase.QUERIES["selected_without_exclusions"](spark, str(tmp_path)).orderBy("executionRank").collect()
    assert [r.asin for r in got] == [r.asin for r in sorted(passing, key=lambda r: (r.title, r.ord))[:20]]
    chosen = showcase.passing(spark, str(tmp_path)).orderBy(*listings.candidate_order()).collect()
    assert [r.ord for r in chosen] == [r.ord for r in sorted(passing, key=lambda r: (r.title.lower(), r.ord))]
