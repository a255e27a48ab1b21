"""Building blocks that keep working when one key holds much of the data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Rows of a narrow side that may be broadcast, and parts into which a label's rows are cut beyond that.
BROADCAST_ROWS, SALTS = 100_000, 32

# Sequence numbers are cut into blocks of 2**BLOCK_BITS, which bounds the rows of
# one block.
BLOCK_BITS = 16


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large side with a side that is unique on ``on``; the left side is evaluated once.

    A plain join: only its own shuffle lies below it, so Spark splits the partitions of
    hot keys while it runs (``spark.sql.adaptive.skewJoin.enabled``, on by default).
    ``how`` is ``left`` or ``inner``.
    """
    names = [c for c in right.columns if c not in on]
    return left.join(right, on, how).select(*left.columns, *names)


def new_path(spark: SparkSession) -> str:
    """A new path in the folder all executors share, which the session names in ``spark.checkpoint.dir``.

    Only a local session without one, as in tests, gets its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return f"{folder}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a result once, as Parquet, to the shared folder and read it from there.

    For results that several later steps use: later reads take only the columns they
    need, and a lost executor loses nothing.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow side of a join on unique numbers: stored and counted, broadcast up to ``most`` rows, else left to a plain join."""
    held = settle(df)
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held


def label_join(left: DataFrame, labels: DataFrame, on: str, spread_by: str, how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows with a narrow table that is unique on the label ``on``; a label may hold any share of the rows.

    Up to ``most`` labels are broadcast.  Beyond that every label is repeated ``SALTS`` times and its rows
    are dealt over the copies by a hash of ``spread_by``, so no task takes all rows of a label.  The result
    is the same.  Rows with a null label match nothing; ``how`` is ``left`` or ``inner``.
    """
    names = [c for c in labels.columns if c != on]
    held = settle(labels)
    if held.limit(most + 1).count() <= most:
        return left.join(F.broadcast(held), on, how).select(*left.columns, *names)
    copies = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [on, "_salt"], how).select(*left.columns, *names)


def border(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep the optimizer from copying the rules of labels into later filters.

    A filter on a label would otherwise be moved below the rules with all their
    inputs written out, again and again; rows produced by a generator stay a border.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def number_by(df: DataFrame, levels: list[Column], ord_col: str, out: str) -> DataFrame:
    """Global row number by small-integer ``levels``, then by the unique ``ord_col``.

    No task sees more than one block of rows: rows are counted per level and block
    of sequence numbers, the counts are summed up to offsets, and rows are numbered
    inside their block only.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    d = df.select("*", *[c.cast("int").alias(n) for c, n in zip(levels, names)],
                  F.shiftright(F.col(ord_col), BLOCK_BITS).alias("_blk"))
    counts = d.groupBy(*names, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*names).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    # the level totals are at most as many rows as there are level combinations
    over = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        counts.groupBy(*names).agg(F.sum("_n").alias("_t"))
        .select(*names, F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_before"))
    )
    offsets = (
        counts.select(*names, "_blk", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_in"))
        .join(totals, names)
        .select(*names, "_blk", (F.col("_in") + F.col("_before")).alias("_off"))
    )
    w = Window.partitionBy(*names, "_blk").orderBy(ord_col)
    return (
        d.join(offsets, [*names, "_blk"])
        .withColumn(out, (F.row_number().over(w) + F.col("_off")).cast("bigint"))
        .select(*df.columns, out)
    )


def number_read(df: DataFrame, group: str, out: str, part: Column | None = None) -> DataFrame:
    """Number the rows of each ``group`` from 1 in the order in which they stand in ``df``.

    Rows of a group must stand together within a ``part``, and parts must follow each other in the
    group's order; a part is a partition unless given.  So a sorted table, or the blocks of a file,
    are numbered without a window over rows: only the parts of a group are summed up.
    """
    part = F.spark_partition_id() if part is None else part
    held = settle(df.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_id")))
    parts = held.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_g", "_p", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    return held.join(offsets, same).select(*df.columns, (F.col("_id") + F.col("_off")).alias(out))


def carry_forward(df: DataFrame, group: str, pos: str, columns: list[str], narrow: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the latest earlier value of the group, in ``pos`` order.

    A group of any size is cut into blocks of positions: the last value of each
    block is handed to the following blocks, then blocks are filled on their own.
    ``narrow`` may hold ``group``, ``pos`` and ``columns`` of the same rows, stored: the
    last values are then read from it and ``df`` is evaluated once.
    """
    block = F.shiftright(F.col(pos), BLOCK_BITS)
    d = df.withColumn("_blk", block)
    tails = (d if narrow is None else narrow.withColumn("_blk", block)).groupBy(group, "_blk").agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).alias("v"))))["v"].alias(f"_t_{c}") for c in columns]
    )
    earlier = Window.partitionBy(group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        group, "_blk", *[F.last(f"_t_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns]
    )
    here = Window.partitionBy(group, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    keep = [F.col(c) for c in df.columns if c not in columns]
    filled = [F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"_c_{c}")).alias(c) for c in columns]
    return d.join(carried, [group, "_blk"], "left").select(*keep, *filled)
