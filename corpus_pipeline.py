"""A corpus pipeline over `documents`: language, near copies, personal data, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as
Parquet in the session's shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import language, mixing, near_copies, packing, personal_data
from earshot.llm.common import free_name, held_out, ship, staged, table
from earshot.llm.queries import WEIGHTS, encoder, mix_levels

#: Least share of a document's letters in its language; others, and texts without letters, are rejected.
LEAST_LANGUAGE = 0.5
#: The mix takes this part of the tokens that earlier stages kept, each document once at most.
SHARE = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language.  Learns from the labels that the held-out split leaves."""
    ship(spark)
    kept = list(docs.columns)
    model = language.train(docs.filter(~held_out(F.col("doc_id"), 3, 1)))
    names = {c: free_name(kept, f"own_{c}") for c in kept if c in ("lang_pred", "score", "spans")}
    rows = language.tag(docs.withColumnsRenamed(names), model)
    good = rows.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))
    return good.drop("lang_pred", "score", "spans").withColumnsRenamed({v: k for k, v in names.items()}).select(*(F.col(f"`{c}`") for c in kept))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id.

    A document is an id and a text: rows that repeat both are one document, of which one row stays; other
    texts under the same id are documents of their own.  Rows without an id all stay.
    """
    ship(spark)
    # the same from the same content on every read, unlike a row number
    row = free_name(docs.columns, "row")
    rows = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.col("text").isNull(), F.coalesce("text", F.lit("")))))
    found = near_copies.near_copies(rows.filter(F.col(row).isNotNull()), key=row).select(F.col("doc_id").alias(row), "component_id").distinct()
    first = found.join(rows.select(row, "doc_id").distinct(), row).groupBy("component_id").agg(F.min(F.struct("doc_id", row))[row].alias(row))
    stays, lone = free_name([*docs.columns, row], "stays"), free_name(docs.columns, "lone")  # rows without an id are never repeats of each other
    rest = rows.join(first.select(row, F.lit(True).alias(stays)), row, "left").filter(F.col(stays) | F.col("doc_id").isNull())
    rest = rest.withColumn(lone, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return rest.dropDuplicates([row, lone]).select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars follows the new text."""
    name = free_name(docs.columns, "pii")
    rows = personal_data.with_spans(docs, out=name)
    rows = rows.withColumn("text", personal_data.masked(F.col("text"), F.col(name))).drop(name)
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).select(*(F.col(f"`{c}`") for c in docs.columns)) if "n_chars" in docs.columns else rows


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, by target weights of domain, language and source.

    Texts are neither copied nor shuffled: each leaf's cut is found from ids and counts of tokens, and the
    documents are filtered by it.  Rows with null and repeated ids are rows of their own.
    """
    return mixing.selected(docs, mix_levels(), WEIGHTS, SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.packed(docs, encoder())


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the pieces of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


#: Models and random groups are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
