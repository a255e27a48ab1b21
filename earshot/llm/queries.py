"""One registered query for each operator of this folder, over whole tables, with SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import (
    exact_copies, inner_products, language, main_text, mixing, near_copies, nearest, packing, personal_data, quality, repeats, spelling, urls,
)
from earshot.llm.common import held_out, table

RULES = [urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/")]
#: Target weights of the mix, by level and value; others weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 1.0, 4, 17
LEVELS = ("domain", "lang", "source")


def encoder() -> packing.Encoder:
    """The public vocabulary; its files lie in the same place on every machine that has them installed."""
    import public_tokenizers as public

    return packing.Encoder(str(public.path("byte_bpe_50k.json")), str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


def mix_levels() -> dict[str, Column]:
    """Domain (by the source's number), language and source of a document."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).try_cast("bigint")
    return dict(zip(LEVELS, (F.concat(F.lit("d"), (number % 4).cast("string")), F.col("lang"), F.col("source")), strict=True))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.op1_language(docs, held=held_out(F.col("doc_id"), 3, 1))
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"), width=2)


def op3_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return inner_products.top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mix_levels(), WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "url_score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out(F.col("doc_id"), 4, 2))
    model = quality.train(quality.labelled_sample(docs.filter("not held_out"), labels))
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def _number(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(personal_data.BASE))
    counts = [_number(k).alias(f"n_{k}") for k in personal_data.BASE]
    digest = F.sha2(personal_data.listed(base).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, personal_data.listed(F.col("pii")).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), encoder())


def op11_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_copies.exact_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), one_in=97))


def repeated(doc_id: Column, text: Column) -> Column:
    """The text of a tenth of all documents, by crc32 of the id, as words that repeat from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # an array of one array, so that the words are found once and not for each word
    words = F.array(F.regexp_extract_all(text, F.lit(mixing.WORD), 0))
    return F.when(h % 10 == 0, F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, again(w))), 0)).otherwise(text)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text"))
    rows = repeats.with_runs(docs)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    best = repeats.most_repeated(F.col("runs"))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *(best[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_near_copies, op3_inner_products, op4_main_text, op5_nearest, op6_mixing, op7_urls, op8_quality,
        op9_personal_data, op10_packing, op11_exact_copies, op12_spelling, op13_repeats,
    )
}


def _weights_sql(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    return f"CASE {cases} ELSE 1 END" if cases else "1"


def _mix_sql() -> str:
    """The same budgets level by level, and running sums over each leaf's rows at once."""
    levels, steps = list(LEVELS), []
    keys: list[str] = []
    for n, level in enumerate(levels):
        by, here = ", ".join(["root", *keys]), ", ".join(["root", *keys, level])
        steps.append(f"""
n{n} AS (SELECT {here}, sum(tokens) * {MIX_EPOCHS} AS cap, {_weights_sql(level)} AS w FROM leaves GROUP BY {here}),
o{n} AS (SELECT n.*, b.budget,
    sum(w) OVER (PARTITION BY {by}) - coalesce(sum(w) OVER (PARTITION BY {by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w,
    b.budget - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_b
    FROM n{n} n JOIN b{n} b USING ({by})),
f{n} AS (SELECT *, cap * rest_w <= rest_b * w AS is_full FROM o{n}),
g{n} AS (SELECT *, min(CASE WHEN NOT is_full THEN {{'r': cap / w, 'l': {level}, 'b': rest_b, 'w': rest_w}} END) OVER (PARTITION BY {by}) AS open FROM f{n}),
b{n + 1} AS (SELECT {here}, CASE WHEN is_full THEN cap ELSE (w * open.b) // open.w END AS budget FROM g{n})""")
        keys.append(level)
    leaf = ", ".join(keys)
    return f"""
WITH d AS (SELECT doc_id, coalesce('d' || CAST(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT) % 4 AS VARCHAR), '~') AS domain,
    coalesce(lang, '~') AS lang, coalesce(source, '~') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT 0 AS root, {leaf}, CAST(sum(tokens) AS HUGEINT) AS tokens FROM d GROUP BY {leaf}),
b0 AS (SELECT 0 AS root, least(CAST(floor(sum(tokens) * {MIX_SHARE}) AS HUGEINT), sum(tokens) * {MIX_EPOCHS}) AS budget FROM leaves),
{",".join(steps)},
plan AS (SELECT {leaf}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
    FROM leaves JOIN b{len(levels)} USING (root, {leaf})),
r AS (SELECT d.*, whole, rest, sum(tokens) OVER (PARTITION BY {leaf} ORDER BY md5('{MIX_SEED}:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN plan USING ({leaf}))
SELECT doc_id, nullif(domain, '~') AS domain, nullif(lang, '~') AS lang, nullif(source, '~') AS source, tokens,
    CAST(least(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END, {MIX_EPOCHS}) AS INTEGER) AS copies FROM r"""


ORACLES = {
    "op3_inner_products": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_mixing": _mix_sql(),
    "op11_exact_copies": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
}
