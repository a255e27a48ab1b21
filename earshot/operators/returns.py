"""Labels for return and after-sales remarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions import text as T
from earshot.functions.rules import KeywordIndex, contains_any, hit
from earshot.operators.skew import border
from earshot.packs import returns as RP

LEVELS = ("level_1", "level_2", "level_3", "level_4")


def _joined(*cs) -> Column:
    return F.concat_ws(" ", *[T.text_of(c) for c in cs])


def risk_index(pack=RP) -> KeywordIndex:
    """Keywords of risks and reasons; none holds white space, so none crosses from one field into another."""
    return KeywordIndex({*pack.HIGH_RISK, *pack.MEDIUM_RISK, *pack.USER_REASONS, *pack.QUALITY_RISK})


def remark_index(pack=RP) -> KeywordIndex:
    """Keywords looked up in a remark: those of the chain rules and of the risks."""
    return KeywordIndex({*(k for *_, ks in pack.CHAIN_RULES for k in ks), *risk_index(pack).keywords})


def _risk_hits(*cs, pack=RP) -> Column:
    return risk_index(pack).hits_by_scan(F.lower(_joined(*cs)))


def severity(*cs, pack=RP) -> Column:
    """``high`` beats ``medium`` beats ``low``, over the comment and its labels."""
    return T.let(_risk_hits(*cs, pack=pack), lambda h: _severity(h, pack))


def _severity(hits: Column, pack=RP) -> Column:
    return F.when(hit(hits, pack.HIGH_RISK), "high").when(hit(hits, pack.MEDIUM_RISK), "medium").otherwise("low")


def is_user_reason(*levels, pack=RP) -> Column:
    return contains_any(_joined(*levels), pack.USER_REASONS)


def is_quality_risk(*cs, pack=RP) -> Column:
    return T.let(_risk_hits(*cs, pack=pack), lambda h: hit(h, pack.QUALITY_RISK))


def macro_theme(c, pack=RP) -> Column:
    """Wider theme of a level-1 label; an unknown label is its own theme."""
    c = T.text_of(c)
    return F.when(c == "", pack.MACRO_DEFAULT).otherwise(T.mapped(c, pack.MACRO_THEMES, c))


def current_level_1(c, pack=RP) -> Column:
    c = T.strip(c)
    return T.mapped(c, pack.LEGACY_LEVEL_1, c)


def display_level_1(c, pack=RP) -> Column:
    c = current_level_1(c, pack)
    return T.mapped(c, pack.DISPLAY_LEVEL_1, c)


def tag_chain(df: DataFrame, comment: str = "cleaned_comment", pack=RP) -> DataFrame:
    """Fill the four levels of rows without manual labels.

    The remark is read once by an index of all keywords; each keyword has the number
    of the first rule that names it, and the smallest number decides.  A remark
    without any is marked for a person to decide.  Rows that carry a label keep all
    levels.
    """
    d = df.withColumn("_chain", F.when(T.blank("level_1"), T.let(_remark_hits(comment, pack), lambda h: _chain(h, pack))).otherwise(F.array(*[T.text_of(n) for n in LEVELS])))
    return _with_levels(d, df, pack)


def _remark_hits(comment: str, pack=RP) -> Column:
    return remark_index(pack).hits_by_scan(T.normalize(comment))


def _chain(hits: Column, pack=RP) -> Column:
    rule: dict[str, int] = {}
    for i, (*_, keywords) in enumerate(pack.CHAIN_RULES):
        for k in keywords:
            rule.setdefault(k, i)
    rows = [levels for *levels, _ in pack.CHAIN_RULES] + [[pack.UNSURE_LABEL, "", "", pack.UNSURE_CAUSE]]
    table = F.expr("array(" + ", ".join("array(" + ", ".join(map(T.quoted, levels)) + ")" for levels in rows) + ")")
    number = F.array_min(F.transform(hits, lambda k: T.mapped(k, rule)))
    return F.get(table, F.coalesce(number, F.lit(len(rows) - 1)))


def _with_levels(d: DataFrame, df: DataFrame, pack=RP) -> DataFrame:
    rest = [c for c in d.columns if c not in (*LEVELS, "_chain")]
    d = d.select(*rest, *[F.col("_chain")[i].alias(n) for i, n in enumerate(LEVELS)])
    return border(d, list(LEVELS)).select(*df.columns)


def flag_risks(df: DataFrame, pack=RP) -> DataFrame:
    """Severity and risk flags, to be computed again after labels have changed.

    The comment and its labels are read once; ``level_4`` counts for the severity only.
    """
    both = F.struct(_risk_hits("cleaned_comment", *LEVELS[:3], pack=pack).alias("h"), _risk_hits("level_4", pack=pack).alias("last"))
    flags = T.let(both, lambda x: F.struct(
        _severity(F.array_union(x["h"], x["last"]), pack).alias("severity"), is_user_reason(*LEVELS[:3], pack=pack).alias("is_user_reason"),
        hit(x["h"], pack.QUALITY_RISK).alias("is_quality_risk"),
    ))
    d = df.withColumn("_flags", flags)
    return d.withColumns({n: F.col("_flags")[n] for n in ("severity", "is_user_reason", "is_quality_risk")}).drop("_flags")


def needs_review(pack=RP) -> Column:
    return T.text_of("level_1").isin(*pack.REVIEW_LABELS)


def review_queue(df: DataFrame, pack=RP) -> DataFrame:
    """Rows whose label a person has to decide."""
    return df.filter(needs_review(pack))


def decided(df: DataFrame, pack=RP) -> DataFrame:
    """Rows that may be counted."""
    return df.filter(~needs_review(pack))
