"""Joins with dimensions and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions import text as T
from earshot.functions.rules import contains_any
from earshot.operators.skew import spread_join
from earshot.packs import reviews as VP


def pending_texts(df: DataFrame, columns: list[str], cache: DataFrame) -> DataFrame:
    """Distinct texts of the columns that the cache does not know yet."""
    texts = df.select(F.explode(F.array(*[T.collapse(c) for c in columns])).alias("text")).filter(F.col("text") != "")
    keyed = texts.withColumn("_k", F.sha2("text", 256))
    known = cache.select(F.sha2("text", 256).alias("_k"))
    return keyed.join(known, "_k", "left_anti").dropDuplicates(["_k"]).drop("_k")


def apply_cache(df: DataFrame, cache: DataFrame, column: str, out: str, fallback: str = "original") -> DataFrame:
    """Add the cached translation of a column.

    Texts are met by digest, so the shuffle carries no long keys; a text that fills
    much of the table is handled by ``spread_join``.  Without a cache entry the
    original text (or, with ``fallback="blank"``, nothing) is used.  Of several answers
    to a text the largest counts, the same one in every run.
    """
    known = cache.groupBy(F.sha2(T.collapse("text"), 256).alias("_k")).agg(F.max("translated").alias("_v"))
    d = spread_join(df.withColumn("_k", F.sha2(T.collapse(column), 256)), known, ["_k"])
    rest = T.text_of(column) if fallback == "original" else F.lit("")
    return d.withColumn(out, F.coalesce("_v", rest)).drop("_k", "_v")


def merge_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache plus new answers, which replace old ones; a failed answer stores the original text."""
    digest = F.sha2(T.collapse("text"), 256)
    answers = new.select("text", F.coalesce("translated", "text").alias("translated"))
    old = cache.select("text", "translated", digest.alias("_k")).join(answers.select(digest.alias("_k")), "_k", "left_anti")
    return old.select("text", "translated").unionByName(answers)


# ---- need layers -----------------------------------------------------------------

def layer_fallback(need, feature, secondary, scene, evidence, pack=VP) -> Column:
    """Layer of a need profile by hint words, from the top layer down."""
    joined = F.lower(F.concat_ws(" ", need, feature, secondary, scene, F.concat_ws(" ", evidence)))
    out = None
    for layer, hints in pack.LAYER_HINTS:
        test = contains_any(joined, hints)
        out = F.when(test, layer) if out is None else out.when(test, layer)
    return out.otherwise(T.mapped(T.strip(need), pack.LAYER_BY_NEED, pack.LAYER_DEFAULT))


def profile_signature(version: str = "1") -> Column:
    """Digest of a need profile, the key of the layer cache."""
    profile = F.to_json(F.struct("need", "n", "feature", "secondary_need", "scene", "evidence"))
    return F.sha1(F.concat_ws("|", F.lit(version), profile))


def resolve_layers(profiles: DataFrame, cache: DataFrame | None = None, version: str = "1", pack=VP) -> DataFrame:
    """Layer of every need: from the cache (of several entries the largest), else by ``layer_fallback``."""
    d = profiles.withColumn("signature", profile_signature(version))
    own = layer_fallback("need", "feature", "secondary_need", "scene", "evidence", pack)
    if cache is None:
        known = F.lit(None).cast("string")
    else:
        entry = F.max(F.struct(F.col("layer").alias("_layer"), F.col("reason").alias("_reason"), F.col("source").alias("_source")))
        valid = cache.filter(F.col("layer").isin(*pack.LAYERS)).groupBy("signature").agg(entry.alias("_entry")).select("signature", "_entry.*")
        d = d.join(valid, "signature", "left")
        known = F.col("_layer")
    d = d.withColumn("layer", F.coalesce(known, own))
    fresh = F.format_string("回退分层：需求语义更接近%s。", F.col("layer"))
    d = d.withColumn("reason", F.coalesce("_reason", fresh) if cache is not None else fresh)
    d = d.withColumn("source", F.coalesce("_source", F.lit("fallback")) if cache is not None else F.lit("fallback"))
    return d.drop("_layer", "_reason", "_source")
