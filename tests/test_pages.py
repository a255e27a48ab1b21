"""Readers of saved pages, the plan of pictures, label joins and numbered labels."""

import time

from pyspark.sql import functions as F

from earshot.operators import listings as L
from earshot.operators import skew
from earshot.sources import pages as P

BIG = 2**60 + 1
REVIEW = (
    "<div data-hook='review' id='{id}'><span class='a-profile-name'>Ann</span><i data-hook='review-star-rating'><span class='a-icon-alt'>4.0 out of 5</span></i>"
    "<b id='{id}-in' data-hook='review-title'>T &amp; t</b><p data-hook='review-body'>one <br>two</p>"
    "<button class='review-image-thumbnail' data-image-index='99999999999' data-image-source='s' style='background:url(x.png)'></button></div>"
)


def read(spark, rows, reader=P.reviews_of_pages):
    return reader(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()


def test_page_numbers_stay_beside_null_ones(spark):
    rows = read(spark, [(BIG, "u", REVIEW.format(id="R1")), (None, None, REVIEW.format(id="R2")), (3, "v", None), (4, "w", ""), (5, "x", "<p>nothing</p>")])
    assert {(r.page_id, r.url, r.reviewId) for r in rows} == {(BIG, "u", "R1"), (None, None, "R2")}
    one = next(r for r in rows if r.reviewId == "R1")
    assert (one.author, one.title, one.body, one.rating, one.verifiedPurchase) == ("Ann", "T & t", "one two", 4.0, False)
    assert [tuple(i) for i in one.images] == [(2**31 - 1, "s", "x.png", "")]


def test_listed_nodes_inside_a_review_and_repeats_are_one_record(spark):
    html = "<div><p id='customer_review-1'>a</p>" + REVIEW.format(id="R1") * 2 + "<p id='customer&#95;review-2'>b</p><p id='R9'>no hook</p>"
    assert [r.reviewId for r in read(spark, [(1, "u", html)])] == ["customer_review-1", "R1", "customer_review-2"]
    nameless = "<div data-hook='review'><i><b id='R7'></b></i></div><div data-hook='review'><b id='x'></b></div>"
    assert [r.reviewId for r in read(spark, [(1, "u", nameless)])] == ["R7"]


def test_an_id_written_with_references_is_found_without_a_hook(spark):
    assert [r.reviewId for r in read(spark, [(1, "u", "<p id='c&#117;stomer_review-2'>b</p>")])] == ["customer_review-2"]


def test_cards_take_their_fields_from_the_right_places(spark):
    card = (
        "<div data-component-type='s-search-result' data-asin='B1'><span>no</span><a class='a-link-normal s-no-outline' href='/plain'><span>plain</span></a>"
        "<h2><a href='/h2'><span>Title</span></a></h2><h5 class='s-line-clamp-1'><span>Brand</span></h5><span class='a-price'><span class='a-offscreen'>$5</span></span>"
        "<span class='a-offscreen'>$9</span><a href='#customerReviews'>12</a><a href='/x#customerReviews'>ratings</a><img class='s-image' src='i.png'></div>"
    )
    (one,) = read(spark, [(BIG, "u", card), (None, "u", "<div data-asin='B2'></div>")], P.cards_of_pages)
    assert tuple(one) == (BIG, "u", "B1", "Title", "/h2", "", "12 ratings", "$5", "Brand", "i.png")
    (bare,) = read(spark, [(1, "u", "<div data-component-type='s-search-result' data-asin></div>")], P.cards_of_pages)
    assert tuple(bare)[2:] == ("",) * 8


def test_reading_is_linear_in_depth():
    took = []
    for depth in (5_000, 20_000):
        html = "<div data-hook='review' id='R1'>" + "<span class='a-icon-alt a-offscreen'></b>" * depth + "x"
        began = time.perf_counter()
        assert len(list(P._page_reviews(html))) == 1 and not list(P._page_cards(html))
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_pictures_of_an_earlier_run_are_skipped(spark):
    wanted = spark.createDataFrame(
        [("A", "p", "http://h/x.WEBP?q=1"), ("A", "p", ""), ("B", "p", "http://h/x"), ("C", "p", None), ("D", "", "http://h/x.png"), ("", "p", ""), (None, "p", ""), ("E", "p", "no address.gif")],
        "asin string, productUrl string, imageUrl string",
    )
    files = spark.createDataFrame([("d/A.gif",), ("d/B.webp",), ("d/B.jpg",), ("c/B.jpg",), ("d/D.png",), ("d/C.png.txt",), (None,)], "path string")
    rows = {(r.asin, r.imageUrl): (r.status, r.image_path, r.destination) for r in L.picture_plan(wanted, files).collect()}
    assert rows == {
        ("A", "http://h/x.WEBP?q=1"): ("fetch", None, "A.webp"), ("A", ""): ("fetch", None, None), ("B", "http://h/x"): ("skipped", "c/B.jpg", None),
        ("C", None): ("fetch", None, None), ("D", "http://h/x.png"): ("failed", "d/D.png", None), ("", ""): ("failed", None, None), (None, ""): ("failed", None, None),
        ("E", "no address.gif"): ("fetch", None, "E.jpg"),
    }
    assert L.pictures_to_fetch(wanted, files).count() == 4 and L.picture_plan(wanted, files.limit(0)).count() == wanted.count()


def test_rows_of_a_hot_label_lie_in_many_tasks(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("label"))
    labels = rows.filter("label is not null").groupBy("label").agg(F.min("id").alias("first"))
    for how in ("left", "inner"):
        few, many = (skew.label_join(rows, labels, "label", "id", how, most) for most in (10**6, 10))
        assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
        assert many.count() == (20_000 if how == "left" else rows.filter("label is not null").count())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.label_join(rows, labels, "label", "id", "left", 10).filter("label = 'hot'")
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_labels_are_numbered_without_a_window_over_all_of_them(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("L"), (F.col("id") % 7_001).cast("string")).alias("scenarioLabel"), F.col("id").cast("string").alias("asin"))
    got = [tuple(r) for r in L.scenarios(rows).orderBy("scenarioId").collect()]
    counts = {}
    for i in range(30_000):
        counts[f"L{i % 7_001}"] = counts.get(f"L{i % 7_001}", 0) + 1
    expected = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert got == [(i + 1, label, n, True) for i, (label, n) in enumerate(expected)]
    assert L.scenarios(rows.limit(0)).count() == 0
