"""Counting label chains, themes and periods of return remarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions import text as T
from earshot.operators.clean import is_true
from earshot.operators.returns import macro_theme
from earshot.packs import returns as RP


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows not marked invalid; where there is no mark every row counts."""
    if "is_valid_feedback" not in df.columns:
        return df
    return df.filter(is_true(F.coalesce(F.col("is_valid_feedback").cast("string"), F.lit("true"))))


def chain_counts(valid: DataFrame) -> DataFrame:
    """Rows per level-1..3 chain; rows without level 1 are kept under a blank."""
    cols = [T.text_of(f"level_{i}").alias(f"level_{i}") for i in (1, 2, 3)]
    sev = T.first_filled("severity", F.lit("unknown")).alias("severity")
    return (
        valid.select(*cols, sev, "ord").groupBy("level_1", "level_2", "level_3", "severity")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    )


def valid_total(chains: DataFrame) -> Column:
    return chains.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).scalar()


def labelled(chains: DataFrame) -> DataFrame:
    return chains.filter(F.col("level_1") != "")


def fold(chains: DataFrame, *dims) -> DataFrame:
    return labelled(chains).groupBy(*dims).agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))


def macro_counts(chains: DataFrame) -> DataFrame:
    return fold(chains.withColumn("macro", macro_theme("level_1")), "macro")


def sub_issues(chains: DataFrame) -> DataFrame:
    return fold(chains.filter(F.col("level_2") != ""), "level_1", "level_2")


def ranked_issues(chains: DataFrame, pack=RP, k: int = 4) -> DataFrame:
    """Risk categories first, then by count and name; the best ``k``."""
    types = fold(chains, "level_1")
    order = [(~F.col("level_1").isin(*pack.RISK_CATEGORIES)).cast("int"), F.desc("n"), "level_1"]
    best = types.orderBy(*order).limit(k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    w = Window.partitionBy("level_1").orderBy(F.desc("n"), "first_ord")
    subs = sub_issues(chains).withColumn("pos", F.row_number().over(w)).filter("pos <= 3")
    subs = subs.groupBy("level_1").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("level_2").alias("name")))).alias("s"))
    return best.join(subs, "level_1", "left").select(
        "rank", "level_1", "n", F.coalesce(F.transform("s", lambda x: x["name"]), F.array().cast("array<string>")).alias("sub_issues")
    )


def time_value(df: DataFrame, columns=("return_time", "退货时间", "return_date", "date")) -> Column:
    """First filled time column that the table has."""
    here = [F.col(c).cast("string") for c in columns if c in df.columns]
    return T.first_filled(*here) if here else F.lit("")


def day_counts(valid: DataFrame, time: Column | None = None) -> DataFrame:
    """Rows per day; dates that cannot be read are left out."""
    ts = T.timestamp(time_value(valid) if time is None else time)
    return (
        valid.select(F.to_date(ts).alias("day"), "ord").filter(F.col("day").isNotNull())
        .groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    )


def trend(days: DataFrame) -> DataFrame:
    """Counts per month when there are at least three months, else per day."""
    months = days.agg(F.count_distinct(F.date_format("day", "yyyy-MM"))).scalar()
    grain = F.when(months >= 3, "month").otherwise("day")
    period = F.when(months >= 3, F.date_format("day", "yyyy-MM")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    return (
        days.select(grain.alias("grain"), period.alias("period"), "n", "first_ord")
        .groupBy("grain", "period").agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))
    )


def trend_table(days: DataFrame, whole: Column) -> DataFrame:
    """Trend with shares and peak mark; empty for fewer than two periods."""
    t = trend(days)
    peak = t.agg(F.max("n")).scalar()
    periods = t.agg(F.count(F.lit(1))).scalar()
    return (
        t.filter(periods >= 2)
        .select("grain", "period", "n", (F.col("n") / whole).alias("share"), (F.col("n") == peak).alias("is_peak"))
        .orderBy("period")
    )


def taxonomy_examples(df: DataFrame, k: int = 3) -> DataFrame:
    """Full chains with their count and the first ``k`` texts, over all workbooks."""
    levels = [f"level_{i}" for i in (1, 2, 3, 4)]
    d = df.select(
        *[T.text_of(x).alias(x) for x in levels], "ord", "workbook", F.col("source_sheet").alias("sheet"),
        F.col("source_row").alias("row"), T.first_filled("translated_comment", "raw_comment", "return_reason").alias("text"),
    ).filter(F.concat(*levels) != "")
    counts = d.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    # only k rows per chain and task reach the shuffle
    w = Window.partitionBy(*levels).orderBy("ord")
    best = d.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    examples = best.groupBy(*levels).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "workbook", "sheet", "row", "text"))), lambda x: x.dropFields("pos")).alias("examples")
    )
    return counts.join(examples, levels).orderBy(F.desc("n"), "first_ord")


def examples_markdown(examples: DataFrame) -> DataFrame:
    """One text block per chain."""
    chain = F.array_join(F.filter(F.array("level_1", "level_2", "level_3", "level_4"), lambda x: x != ""), " -> ")
    lines = F.transform(
        "examples",
        lambda e: F.concat(F.lit("- Example: `"), e["workbook"], F.lit("::"), e["sheet"], F.lit("#"), e["row"].cast("string"), F.lit("` "), T.first_filled(e["text"], F.lit("[no text]"))),
    )
    body = F.concat(F.lit("## "), chain, F.lit("\n- Count: "), F.col("n").cast("string"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return examples.select("n", "first_ord", body.alias("value"))
