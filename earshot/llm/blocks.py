"""Vectors packed into blocks, and the grid in which query blocks meet data blocks.

A block is one row holding vectors as bytes, so a task compares small matrices.  Blocks are dealt over
strips of bounded size, and every strip of queries meets every strip of data once, in a cell of a grid: a
query block is copied once per strip of data and a data block once per strip of queries.  Cells are groups
of both sides, so copies go through the shuffle only; a join of them would be broadcast through the driver
where the blocks alone look small, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import staged

#: Most bytes of vectors in a block, and about as many in a strip, with OWN numbers more for each vector.
BLOCK, STRIP, OWN = 1 << 21, 1 << 24, 16


@dataclass
class Blocks:
    """block, ids, mat and further columns of `rows`; the number of blocks, and bytes of their vectors."""

    rows: DataFrame
    count: int
    size: int


def usable(vectors: DataFrame, key: str, column: str, zero: bool) -> DataFrame:
    """vec_id and vec (array<double>) of rows that take part; `zero` tells whether zero vectors do."""
    vec = F.col("vec")
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(vec.isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows if zero else rows.filter(F.exists(vec, lambda x: x != 0))


def width_of(rows: DataFrame) -> int:
    """Largest number of components; shorter vectors count as followed by zeros."""
    return int(rows.agg(F.max(F.size("vec"))).first()[0] or 0)


def matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def packed(rows: DataFrame, width: int, most: int, name: str) -> Blocks:
    """Rows in their order, at most `most` to a block; blocks of all partitions numbered from 0."""
    size = max(1, min(most, BLOCK // (8 * max(width, 1))))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mats, held = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                ids.append(part["vec_id"].to_numpy(np.int64)), mats.append(matrix(part["vec"], width))
                held += len(part)
                while held >= size:
                    i, m = np.concatenate(ids), np.concatenate(mats)
                    yield pd.DataFrame({"ids": [i[:size].tobytes()], "mat": [m[:size].tobytes()]})
                    ids, mats, held = [i[size:]], [m[size:]], held - size
        if held:
            yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()], "mat": [np.concatenate(mats).tobytes()]})

    blocks = staged(rows.select("vec_id", "vec").mapInPandas(pack, "ids binary, mat binary").withColumn("at", F.monotonically_increasing_id()), name)
    # the upper bits of `at` are the partition, the lower 33 its own count: only counts of partitions are added up here
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    starts, total, held = [], 0, 0
    for row in blocks.groupBy(part.alias("part")).agg(F.count("*").alias("blocks"), F.sum(F.octet_length("ids")).alias("bytes")).orderBy("part").collect():
        starts += [F.lit(row["part"]), F.lit(total)]
        total, held = total + row["blocks"], held + row["bytes"]
    number = F.create_map(*starts)[part] + place if starts else place
    return Blocks(blocks.select(number.cast("int").alias("block"), "ids", "mat"), total, held * (width + OWN))


def grid(queries: Blocks, data: Blocks) -> tuple[int, int]:
    """Numbers of strips of queries and of data: as few as their size allows, more where cores would wait."""
    rows, columns = (max(1, -(-x.size // STRIP)) for x in (queries, data))
    cells = 4 * data.rows.sparkSession.sparkContext.defaultParallelism
    columns = max(columns, min(data.count, -(-cells // rows)))
    return max(rows, min(queries.count, -(-cells // columns))), columns


def unpacked(strip: pa.Table, width: int, *more: str) -> list[tuple[np.ndarray, ...]]:
    """ids, mat and further columns of numbers of a strip's blocks, in their order."""
    found = []
    for at in np.argsort(strip["block"].to_numpy()):
        ids, mat, *rest = (np.frombuffer(strip[c][at].as_buffer(), np.int64 if c == "ids" else float) for c in ("ids", "mat", *more))
        found.append((ids, mat.reshape(len(ids), width), *rest))
    return found


def crossed(queries: DataFrame, data: DataFrame, strips: tuple[int, int], compare: Callable[[pa.Table, pa.Table], pa.Table], kind: str) -> DataFrame:
    """Run `compare` on each pair of a strip of query blocks and a strip of data blocks."""
    rows, columns = strips
    left = queries.withColumn("row", F.col("block") % rows).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = data.withColumn("column", F.col("block") % columns).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    # more tasks than cells, so that few cells share one; the planner would put cells together by their bytes, which do not tell what they cost
    tasks = min(8 * rows * columns, 32 * data.sparkSession.sparkContext.defaultParallelism)
    left, right = (x.repartition(tasks, "row", "column").groupBy("row", "column") for x in (left, right))
    return left.cogroup(right).applyInArrow(compare, kind)


def answers(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Table:
    """Arrays query_id, vec_id, score of each query block as one table."""
    names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": kind}
    return pa.table({n: pa.chunked_array([pa.array(f[i], t) for f in found], t) for i, (n, t) in enumerate(names.items())})


def best_of(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The `k` best rows of each query, numbered; cells have already kept only their own `k` best."""
    ranked = Window.partitionBy("query_id").orderBy(order, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(k: int, score: np.ndarray, vec_id: np.ndarray) -> np.ndarray:
    """Places of the `k` best, ties to the smaller id, best first."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((vec_id[at], -score[at]))][:k]
