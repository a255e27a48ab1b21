"""Exact copies: frequent digests are found by Misra-Gries and taken out before the shuffle.

A document's digest is the SHA-256 of its text with A-Z lower-cased.  Each task keeps `counters` digests
with their Misra-Gries counts; the summaries are added up and cut to `counters` again, which loses no
digest that has more than rows / (counters + 1) rows.  Those candidates are counted exactly, reduced
map-side, and the verified ones (at most `counters` rows, whatever the input) are broadcast with their
winner, so that the rows of a frequent text are settled where they lie.  All other digests have at most
that many rows each and are grouped by an ordinary shuffle of digests, never of texts.

Defined results: null and empty texts are equal.  The row with the largest id stays; a null id is smaller
than any other.  Of rows that repeat both id and text, one stays, `kept` on the others is false.  Other
columns are never looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import free_name, ship, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counters of a summary, and so the most digests that are broadcast: 32 bytes and a winner each.
COUNTERS = 1023


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def reduced(counts: dict[bytes, int], most: int) -> dict[bytes, int]:
    """Misra-Gries: what exceeds the largest counter beyond the `most` greatest."""
    if len(counts) <= most:
        return counts
    edge = sorted(counts.values(), reverse=True)[most]
    return {k: n - edge for k, n in counts.items() if n > edge}


def summaries(rows: DataFrame, counters: int) -> DataFrame:
    """(digest, n): one Misra-Gries summary of each task's digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column("digest")).to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            held = reduced(held, counters)
        if held:
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    ship(rows.sparkSession)
    return rows.select("digest").mapInArrow(run, "digest binary, n bigint")


def frequent(rows: DataFrame, counters: int) -> DataFrame:
    """digest, top (id and row that stay), n of every digest with more than rows / (counters + 1) rows."""
    total = rows.count()
    merged = summaries(rows, counters).groupBy("digest").agg(F.sum("n").alias("n"))
    likely = merged.orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    exact = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("n"))
    return staged(exact.filter(F.col("n") * (counters + 1) > total), "frequent")


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Per row of `docs`: doc_id, digest (binary), keep_id, group_size, kept."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.unhex(digest(F.col(f"`{text}`"))).alias("digest"))
    # numbers are written, so that later reads repeat them: they settle rows that repeat id and text
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    hot = frequent(rows, counters)
    settled = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    same = Window.partitionBy("digest")
    rest = rest.withColumns({"top": F.max(F.struct("doc_id", "row")).over(same), "n": F.count("*").over(same)})
    return settled.unionByName(rest).select(
        "doc_id", "digest", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("top.row")).alias("kept")
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    mark, own = free_name(docs.columns, "digest"), free_name([*docs.columns, "digest"], "own_id")
    keep = exact_copies(docs, key, text, counters).filter("kept").select(F.col("digest").alias(mark), F.col("keep_id").alias(own))
    rows = docs.withColumns({mark: F.unhex(digest(F.col(f"`{text}`"))), own: F.col(f"`{key}`").cast("bigint")})
    # null-safe on the id; rows that repeat id and text then differ in nothing that the operator looks at
    kept = rows.alias("r").join(keep.alias("k"), (F.col(f"r.{mark}") == F.col(f"k.{mark}")) & F.col(f"r.{own}").eqNullSafe(F.col(f"k.{own}")), "left_semi")
    return kept.dropDuplicates([mark, own]).drop(mark, own)
