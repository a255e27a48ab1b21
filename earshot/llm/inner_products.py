"""Exact search for the largest inner products of integer vectors.

Vectors become floor(scale * x).  They are ordered by descending length over the whole table and packed
into blocks; a rotation by the singular vectors of the table (from its d x d matrix of products, summed
in tasks) moves most of each inner product into the first coordinates.  A task takes a strip of query
blocks and a strip of data blocks and walks each data block in descending length: it stops a query where
length times length cannot reach that query's k-th best, skips vectors whose partial sum plus the product
of the residual lengths (Cauchy-Schwarz) cannot, and computes the others in integers, a whole sub-block in
one matrix product where few are skipped.  Each query starts from the k-th best score among the longest
vectors, and its k-th best rises over the blocks of a strip.

Defined results: vectors that are null, or hold null, NaN or infinite components, and rows with null ids
take no part; zero vectors do.  A vector shorter than others counts as followed by zeros.  Rows that
repeat an id are candidates each; a query never finds a row of its own id.  Repeated query rows are
answered once.  Ties go to the smaller id.  Scores beyond 64 bits are cut to its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import blocks

QUERY_BLOCK, DATA_BLOCK, SUB_BLOCK, HEAD = 512, 4096, 256, 1024
#: Integers below this are exact in the floating-point products used here.
EXACT = float(1 << 52)
#: From this share of a sub-block on, products are computed for all of it; below, components are gathered, so many at once.
DENSE, GATHER = 1 / 32, 1 << 22


def integers(column: pd.Series, width: int, scale: int) -> np.ndarray:
    return np.floor(blocks.matrix(column, width) * scale)


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, largest singular value first."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            m = blocks.matrix(batch["vec"], width)
            m /= np.maximum(np.abs(m).max(1, keepdims=True, initial=0), 1)  # no overflow; only the directions matter
            total += m.T @ m
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    cells = rows.select("vec").mapInPandas(products, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((width, width))
    gram[cells["i"], cells["j"]] = cells["x"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy() if width else np.zeros((0, 0))


@dataclass
class Part:
    """A block in the forms that bounds need: lengths, first rotated coordinates and lengths of the others."""

    ids: np.ndarray
    ints: np.ndarray
    length: np.ndarray
    first: np.ndarray
    rest: np.ndarray
    most: float


def measured(ids: np.ndarray, ints: np.ndarray, basis: np.ndarray, part: int) -> Part:
    with np.errstate(over="ignore"):
        turned = ints @ basis
        length, rest = (np.sqrt((x * x).sum(1)) for x in (ints, turned[:, part:]))
    return Part(ids, ints, length, turned[:, :part].copy(), rest, float(np.abs(ints).max(initial=0)))


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row, as integers (int64), beyond what floating point holds."""
    ends = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), ends[0]), ends[1]) for q, v in zip(queries, vectors, strict=True)], np.int64)


def scored(q: np.ndarray, d: np.ndarray, wanted: np.ndarray, floor: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of wanted pairs; where floating point is exact, of those that reach the floor."""
    if exact and wanted.mean() > DENSE:
        product = q @ d.T
        x, y = np.nonzero(wanted & (product >= floor[:, None]))
        return x, y, product[x, y].astype(np.int64)
    x, y = np.nonzero(wanted)
    step = max(1, GATHER // max(q.shape[1], 1))
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(x), step):
        one, other = q[x[at : at + step]], d[y[at : at + step]]
        found.append((one * other).sum(1).astype(np.int64) if exact else exact_scores(one, other))
    score = np.concatenate(found)
    if exact:
        good = score >= floor[x]
        x, y, score = x[good], y[good], score[good]
    return x, y, score


def compare(q: Part, data: list[Part], floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, id and score of the `k` best over the data blocks that reach its `floor`; blocks in descending length."""
    floor = floor.astype(float).copy()
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    for d in data:
        exact = q.most * d.most * q.ints.shape[1] < EXACT
        for at in range(0, len(d.ids), SUB_BLOCK):
            sub = slice(at, at + SUB_BLOCK)
            # rounding of these floating-point bounds is far below one part in 1e9 of the lengths' product
            slack = 1e-9 * q.length * d.length[at] + 1e-6
            live = np.flatnonzero(~(q.length * d.length[at] + slack < floor))
            if not len(live):
                break  # later vectors of the block are shorter still
            bound = q.first[live] @ d.first[sub].T + q.rest[live, None] * d.rest[sub]
            wanted = ~(bound < (floor - slack)[live, None]) & (q.ids[live, None] != d.ids[sub])
            x, y, score = scored(q.ints[live], d.ints[sub], wanted, floor[live], exact)
            if not len(x):
                continue
            place, ids, score = (np.concatenate(z) for z in zip(best, (live[x], d.ids[sub][y], score), strict=True))
            order = np.lexsort((ids, ~score, place))  # ~ turns the order round without overflow
            place, ids, score = place[order], ids[order], score[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            best = tuple(z[rank < k] for z in (place, ids, score))
            full = rank == k - 1
            floor[place[full]] = np.maximum(floor[place[full]], score[full])
    return best


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", column: str = "embedding", part: int = 16
) -> DataFrame:
    """query_id, rank, vec_id, score of the `k` largest inner products for each row of `queries`.

    `part` rotated coordinates are summed before the bound is tested.
    """
    rows = blocks.usable(vectors, key, column, zero=True)
    asked = blocks.usable(queries, key, column, zero=True).dropDuplicates(["vec_id"])
    width = max(blocks.width_of(rows), blocks.width_of(asked))
    basis = rotation(rows, width)

    def floored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = integers(batch["vec"], width, scale)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vec": list(m), "length": np.sqrt((m * m).sum(1))})

    kind = "vec_id bigint, vec array<double>, length double"
    ints = rows.mapInPandas(floored, kind)
    data = blocks.packed(ints.repartitionByRange(F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), F.col("vec_id")), width, DATA_BLOCK, "products")
    asked = blocks.packed(asked.mapInPandas(floored, kind), width, QUERY_BLOCK, "queries")
    part = min(part, width)

    def start(left: pa.Table, right: pa.Table) -> pa.Table:
        head = [measured(ids[:HEAD], d[:HEAD], basis, part) for ids, d in blocks.unpacked(right, width)]
        floors = []
        for ids, q in blocks.unpacked(left, width):
            place, _, score = compare(measured(ids, q, basis, part), head, np.full(len(q), -np.inf), k)
            last = np.arange(len(place)) - np.searchsorted(place, place) == k - 1
            floor = np.full(len(q), -np.inf)
            floor[place[last]] = score[last]
            floors.append(floor.tobytes())
        left = left.select(["block", "ids", "mat"]).sort_by("block")
        return left.append_column("floor", pa.array(floors, pa.binary()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        strip = [measured(ids, d, basis, part) for ids, d in blocks.unpacked(right, width)]
        found = []
        for ids, q, floor in blocks.unpacked(left, width, "floor"):
            place, near, score = compare(measured(ids, q, basis, part), strip, floor, k)
            found.append((ids[place], near, score))
        return blocks.answers(found, pa.int64())

    # a start for every query: its k-th best among the vectors of the first block, which are the longest
    strips = blocks.grid(asked, data)
    started = blocks.crossed(asked.rows, data.rows.filter("block = 0"), (strips[0], 1), start, "block int, ids binary, mat binary, floor binary")
    found = blocks.crossed(started, data.rows, strips, run, "query_id bigint, vec_id bigint, score bigint")
    return blocks.best_of(found, k, F.desc("score"))
