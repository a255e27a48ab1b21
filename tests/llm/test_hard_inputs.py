"""Inputs that earlier versions got wrong: large ids beside nulls, one-text samples, unlinked families, deep pages."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from earshot.llm import common, language, main_text, mixing, near_copies, packing, personal_data, quality, queries, urls
from tests.llm.test_operators import DATA, DOC, documents, groups, hard, shingles  # noqa: F401

BIG = 1 << 60


@pytest.fixture(scope="module")
def large(spark):
    rows = [(BIG + 1, "the house by the river is old", "en", 1), (None, "das haus am fluss ist alt", "de", None), (BIG + 3, "the bridge over the river is new", "en", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality bigint").coalesce(1)


def test_large_ids_beside_null(large):
    want = [None, BIG + 1, BIG + 3]
    of = lambda df, name="doc_id": sorted((r[0] for r in df.select(name).collect()), key=lambda x: x or 0)
    assert of(near_copies.signatures(large, "doc_id", "text", 2)) == want
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(large, width=2).collect()}
    assert found == {None: None, BIG + 1: BIG + 1, BIG + 3: BIG + 3}
    tagged = language.tag(large, language.train(large))
    assert of(tagged) == want and tagged.columns == [*large.columns, "lang_pred", "score", "spans"]
    scored = quality.scored(large, quality.train(large))
    assert of(scored) == want and sorted((r.quality for r in scored.collect()), key=str) == [0, 1, None]
    pages = large.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://example.net/"), "text").alias("url"), F.col("text").alias("html"), "quality")
    assert of(urls.judged(pages, queries.RULES), "page_id") == want
    assert of(main_text.with_main_text(pages), "page_id") == want
    assert of(packing.packed(large, queries.encoder())) == want


def test_new_columns_replace_columns_of_their_names(large):
    rows = large.withColumns({"lang_pred": F.lit(1), "Score": F.lit(2), "predicted": F.lit(3), "host": F.lit(4), "url_score": F.lit(5)})
    assert language.tag(rows, language.train(rows)).columns == ["doc_id", "text", "lang", "quality", "predicted", "host", "url_score", "lang_pred", "score", "spans"]
    assert [type(r.predicted) for r in quality.scored(rows, quality.train(rows)).collect()] == [int] * 3
    pii = personal_data.with_spans(rows.withColumn("pii", F.lit("x")))
    assert pii.schema["pii"].dataType.typeName() == "array" and pii.columns.count("pii") == 1


def test_samples_of_one_text_are_bounded_and_full(spark):
    one = spark.range(20_000).select("id", F.lit("the same text").alias("text"))
    few = spark.range(12_000).select("id", F.when(F.col("id") < 9000, "copy").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    for rows in (one, few):
        got = common.bounded_sample(rows, ["id", "text"], 4000).collect()
        assert len(got) == 4000 and len({r.id for r in got}) == 4000
    assert 2500 < sum(r.text == "copy" for r in got) < 3500
    same = spark.range(9000).select(F.lit(None).cast("bigint").alias("id"), F.lit("x").alias("text"))
    assert common.bounded_sample(same, ["id", "text"], 4000).count() == 4000
    assert common.bounded_sample(one.limit(7), ["id", "text"], 4000).count() == 7 and common.bounded_sample(one.limit(0), ["id", "text"], 9).count() == 0


def test_numerals_are_no_letters(spark, documents):  # noqa: F811
    rows = spark.createDataFrame([(1, "½"), (2, "²³ ⅷ"), (3, "12 ٣"), (4, "ª"), (5, "x²")], "id int, text string")
    got = {r.id: r.lang_pred for r in language.tag(rows, language.train(documents)).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and "und" not in (got[4], got[5])


# near copies


def family(rng: np.random.Generator, size: int, share: float) -> list[str]:
    """Texts that share this part of their words, in one place, and nothing else."""
    common_part = [f"c{i}" for i in range(int(100 * share))]
    return [" ".join([*common_part, *(f"r{rng.integers(1 << 40)}" for _ in range(100 - len(common_part)))]) for _ in range(size)]


@pytest.mark.parametrize("chunk", [16, 1024])
def test_near_copies_of_a_family_without_links(spark, monkeypatch, chunk):
    """Many texts of about 0.7 similarity share bands and are not linked; a few real links stand among them."""
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    texts = family(rng, 150, 0.85)
    texts += [t.replace("c3 ", "x3 ", 1).replace("c9 ", "x9 ", 1) for t in texts[:12]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2, rounds=1).collect()}
    assert got == groups(rows, 2)
    assert len(set(got.values())) == 150


def test_near_copies_of_the_larger_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text, 2) for r in rows}
    parent = {i: i for i in sets}

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted((len(s), i) for i, s in sets.items() if s)
    for at, (n, i) in enumerate(order):
        for m, j in order[at + 1 :]:
            if 80 * m > 100 * n:
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (n + m - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    got = near_copies.near_copies(docs, width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets}
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


# mix


def test_selected_rows_are_those_with_copies(spark, documents):  # noqa: F811
    rows = mixing.mixed(documents, queries.mix_levels(), queries.WEIGHTS, 0.6, epochs=1).filter("copies > 0")
    got = mixing.selected(documents, queries.mix_levels(), queries.WEIGHTS, 0.6)
    assert got.columns == documents.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in rows.collect())


def test_selected_on_hard_rows(hard):  # noqa: F811
    levels, every = queries.mix_levels(), mixing.selected(hard, queries.mix_levels(), {}, 1.0)
    assert sorted(map(str, every.collect())) == sorted(map(str, hard.collect()))
    some = mixing.selected(hard, levels, {}, 0.5)
    tokens = lambda df: df.agg(F.sum(mixing.words(F.col("text")))).first()[0] or 0
    assert tokens(some) <= 0.5 * tokens(hard)
    ties = hard.sparkSession.createDataFrame([(None if i < 40 else 7, "one two three", "en", "src1", 13, "a", "b", i) for i in range(90)], DOC).repartition(5)
    for share in (0.2, 0.5, 0.9):  # equal rows are parted where the budget ends
        want = mixing.mixed(ties, levels, {}, share, epochs=1).filter("copies > 0")
        assert sorted(map(str, (r.doc_id for r in mixing.selected(ties, levels, {}, share).collect()))) == sorted(str(r.doc_id) for r in want.collect())
    assert mixing.selected(hard.limit(0), levels, {}, 0.5).count() == 0


# pages


def test_threshold_takes_out_what_stands_around_the_article():
    part = "<div class=\"part\"><p>" + "A long sentence, with words and marks. " * 20 + "</p></div>"
    page = f"<body><div class='brand'>Site name</div>{part}<div class='links'><a href='a'>One</a> <a href='b'>Two</a></div>{part}<div class='legal'>Copyright</div></body>"
    assert main_text.extract(page).split("\n") == [("A long sentence, with words and marks. " * 20).strip()] * 2


@pytest.mark.parametrize("piece", ["<div>x ", "<div class='ad'>x ", "<span>", "<article>x ", "<ul><li>x "])
def test_reading_is_linear_in_depth(piece):
    start = time.perf_counter()
    main_text.extract(piece * 20_000 + "<p>" + "end, of it all. " * 9)
    assert time.perf_counter() - start < 5


# personal data


def test_account_numbers_end_where_their_country_says(spark):
    texts = [
        "IBAN DE89370400440532013000 EUR", "iban GB82 WEST 1234 5698 7654 32 OK", "account DE89 3704 0044 0532 0130 00 2024", "iban DE89370400440532013001 EUR",
        "bank NL91 ABNA 0417 1643 00", "IBAN DE89370400440532013000X",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = personal_data.with_spans(rows)
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.pii if s.kind == "iban"] for r in rows.collect()}
    want = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", None, "NL91 ABNA 0417 1643 00", None]
    assert got == {i: [w] if w else [] for i, w in enumerate(want)}
    assert "<IBAN> EUR" in rows.select(personal_data.masked(F.col("text"), F.col("pii")).alias("m")).first().m


def test_the_stage_drops_near_copies_of_five_words(spark, documents):  # noqa: F811
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents, DATA).collect()}
    assert got == set(groups([(r.doc_id, r.text) for r in documents.collect()], 5).values())



def test_the_labelled_sample_is_that_of_the_join(spark):
    docs = spark.createDataFrame([(i % 90 if i else None, f"text {i % 100}") for i in range(300)] + [(5, None), (5, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 70, i % 2) for i in range(100)] + [(5, None), (6, 2), (None, 1)], "doc_id bigint, quality int")
    keys = ["doc_id", "text", "quality"]
    for most in (40, 10_000):
        want = common.bounded_sample(docs.join(labels, "doc_id").filter("quality in (0, 1)").select(*keys), keys, most)
        got = quality.labelled_sample(docs, labels, most)
        assert sorted(map(repr, map(tuple, got.select(*keys).collect()))) == sorted(map(repr, map(tuple, want.collect())))
