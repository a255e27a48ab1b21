"""Mixing sources to target weights: budgets down a tree, then a prefix of each leaf's seeded epochs.

Native expressions only.  The tree is given by columns, from the root's children to the leaves (domain,
language, source).  Each node has a whole-number weight (1 to `MOST_WEIGHT`, 1 if not given) and a
capacity: the tokens below it times `epochs`.  A node's budget is shared among its children in
proportion to weight; children that would get more than their capacity get just that, and what they
leave goes to their siblings by weight.  Since a node never gets more than its capacity, a shortage
reaches an ancestor only when all siblings are full.  The shares are found at once, not step by step:
children in order of capacity over weight are full as long as capacity * rest of weights <= weight * rest
of budget.  Shares are rounded down, so at most one token for each child remains unused.

A leaf with budget b and t tokens gives all its documents b // t times, and for the rest a prefix of the
next epoch: documents in the order of md5(seed:epoch:id) whose running sum of tokens stays within it.
Running sums go over ranges of that order: tokens are summed by leaf and range, then within ranges, so a
leaf with a third of all rows is never in one task.

`selected` returns the documents themselves.  It needs no second copy of their texts and no row numbers:
a leaf's prefix is a cut in the order of its documents, so the documents are read again and compared with
the cut of their leaf, one row a leaf.

Defined results: null branch values are a branch of their own.  Documents without tokens (null or empty
text) belong to the prefix when its sum has been within the budget before them.  Rows with a null or
repeated id are rows of their own: they have equal places, and ties go by fewer tokens first.  `selected` takes as many
rows that tie in both as fit.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import free_name, staged

#: Weight times tokens must fit 63 bits.
MOST_WEIGHT = 10_000
#: Parts of a leaf in the join with its plan.
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null: the measure of tokens used here."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _name(level: Column) -> Column:
    return F.coalesce(level, F.lit("\0"))


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        if not 1 <= weight <= MOST_WEIGHT:
            raise ValueError(f"weight of {name} must be from 1 to {MOST_WEIGHT}")
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("bigint")


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], share: float, epochs: int) -> DataFrame:
    """The levels, tokens and budget of each leaf.  `leaves` has one row a leaf, with its tokens."""
    caps = leaves.select(*(F.col(x) for x in levels), "tokens", (F.col("tokens") * epochs).alias("cap"))
    total = caps.agg(F.sum("tokens").alias("all"))
    given = total.select(F.least(F.floor(F.coalesce("all", F.lit(0)) * share), F.coalesce("all", F.lit(0)) * epochs).cast("bigint").alias("budget"), F.lit(0).alias("root"))
    keys = ["root"]
    caps = caps.withColumn("root", F.lit(0))
    for level in levels:
        nodes = caps.groupBy(*keys, level).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights.get(level, {})))
        nodes = nodes.join(given, keys)
        order = Window.partitionBy(*keys).orderBy(F.col("cap") / F.col("w"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rest_w = F.sum("w").over(Window.partitionBy(*keys)) - F.coalesce(F.sum("w").over(before), F.lit(0))
        rest_b = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
        nodes = nodes.withColumns({"rest_w": rest_w, "rest_b": rest_b})
        nodes = nodes.withColumn("full", F.col("cap").cast("decimal(20,0)") * F.col("rest_w") <= F.col("rest_b").cast("decimal(20,0)") * F.col("w"))
        # full children come first; the others share what was left before the first of them
        nodes = nodes.withColumn("open", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), level, "rest_b", "rest_w"))).over(Window.partitionBy(*keys)))
        part = F.expr("(w * open.rest_b) div open.rest_w")
        keys = [*keys, level]
        given = nodes.select(*keys, F.when(F.col("full"), F.col("cap")).otherwise(part).alias("budget"))
    return caps.drop("cap").join(given, keys).select(*levels, "tokens", "budget")


def placed_rows(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share: float, epochs: int, seed: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, levels, tokens, whole, left, place, upto) without texts, and the plan (levels, whole, left) of each leaf."""
    names = list(levels)
    rows = docs.select(F.col(key).alias("doc_id"), *(_name(c.cast("string")).alias(n) for n, c in levels.items()), words(F.col(text)).alias("tokens"))
    rows = staged(rows, "tokens")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, names, weights, share, epochs)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = staged(plan.select(*names, "whole", "left"), "plan")
    # a leaf may hold a third of all rows: its plan is repeated over salts, so that the join spreads them
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(SALTS)).cast("int"))
    placed = rows.join(plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*names, "salt"]).drop("salt")
    placed = staged(placed.withColumn("place", _place(seed, F.col("whole"), F.col("doc_id"))).withColumn("range", F.substring("place", 1, 3)), "placed")
    sums = placed.groupBy(*names, "range").agg(F.sum("tokens").alias("sum"))
    ahead = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*names, "range", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*names, "range").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(starts, [*names, "range"]).withColumn("upto", F.col("ahead") + F.sum("tokens").over(inside)), plan


def _place(seed: int, whole: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), whole, F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mixed(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share: float, epochs: int = 4,
    seed: int = 17, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row of `docs`: the key, the levels, tokens and copies (how often the mix contains it).

    `levels` names the columns of the tree, root first; `weights` gives target weights by level and
    value; `share` is the size of the mix as a part of all tokens; no document occurs in more than
    `epochs` epochs.
    """
    done, _ = placed_rows(docs, levels, weights, share, epochs, seed, key, text)
    copies = F.col("whole") + F.when(F.col("upto") <= F.col("left"), 1).otherwise(0)
    return done.select("doc_id", *(F.when(F.col(n) != "\0", F.col(n)).alias(n) for n in levels), "tokens", F.least(copies, F.lit(epochs)).cast("int").alias("copies"))


def selected(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share: float,
    seed: int = 17, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of `docs` that a mix of one epoch contains, with all their columns."""
    done, plan = placed_rows(docs, levels, weights, share, 1, seed, key, text)
    names = list(levels)
    # sums never fall along the order, so what comes before the first row that does not fit is the prefix
    at, fits = F.struct("place", "tokens"), F.col("upto") <= F.col("left")
    done = staged(done.filter("whole = 0").select(*names, "place", "tokens", "upto", "left"), "done")
    cuts = done.groupBy(*names).agg(F.min(F.when(~fits, at)).alias("cut"), F.max(F.when(fits, at)).alias("last"))
    split = cuts.filter("last = cut").select(*names, "cut")  # rows that tie lie on both sides
    part = done.filter(fits).join(split, names).filter(at == F.col("cut")).groupBy(*names).agg(F.count("*").alias("some"))
    cuts = plan.join(cuts.join(part, names, "left"), names, "left").select(*names, "whole", "cut", F.coalesce("some", F.lit(0)).alias("some"))
    cuts = staged(cuts, "cuts")
    inner = [*names, "whole", "cut", "some", "salt"]
    own = dict(zip(inner, (free_name(docs.columns, f"mix_{n}") for n in inner), strict=True))
    salted = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed(own)
    rows = docs.withColumns({own[n]: _name(c.cast("string")) for n, c in levels.items()})
    rows = rows.withColumn(own["salt"], F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(SALTS)).cast("int"))
    rows = rows.join(salted, [own["salt"], *(own[n] for n in names)])
    place, cut = _place(seed, F.col(own["whole"]), F.col(key)), F.col(own["cut"])
    tokens = words(F.col(text))
    before = F.when(cut.isNull() | (F.col(own["whole"]) > 0) | (place < cut["place"]), True).when(place > cut["place"], False).otherwise(tokens < cut["tokens"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = rows.filter(before).select(*columns)
    if not cuts.filter("some > 0").limit(1).count():
        return out
    tied = F.when((F.col(own["some"]) > 0) & (place == cut["place"]), tokens == cut["tokens"]).otherwise(False)
    return out.union(_first_of(rows.filter(tied), [own[n] for n in names], own["some"]).select(*columns))


def _first_of(rows: DataFrame, names: list[str], some: str) -> DataFrame:
    """As many rows of each leaf as the column `some` says, in the order of the written rows.

    Rows are counted by leaf and part of the written table, so that equal rows of a leaf are numbered in parts.
    """
    number, part, ahead = (free_name(rows.columns, n) for n in ("number", "part", "ahead"))
    rows = staged(rows.withColumn(number, F.monotonically_increasing_id()), "tied").withColumn(part, F.shiftright(number, 33))
    before = Window.partitionBy(*names).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*names, part).agg(F.count("*").alias(ahead)).withColumn(ahead, F.coalesce(F.sum(ahead).over(before), F.lit(0)))
    inside = Window.partitionBy(*names, part).orderBy(number)
    return rows.join(starts, [*names, part]).withColumn(number, F.col(ahead) + F.row_number().over(inside)).filter(F.col(number) <= F.col(some))
