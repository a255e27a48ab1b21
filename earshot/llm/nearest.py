"""Nearest neighbours by cosine: int8 tiles with error bounds, then exact recomputation.

Unit vectors are rounded to int8 with a scale of their own.  The product of two tiles gives approximate
cosines; the rounding errors' lengths bound each one's distance from the truth, so that every candidate
whose upper bound reaches a query's k-th best lower bound survives, and no other can be among the
nearest.  Survivors are recomputed from the original vectors in double precision, and each query's heap
of k keeps the best over the tiles of a strip of data.  Since the bounds are strict, recall is 1.

Defined results: vectors that are null, zero, or hold null, NaN or infinite components, and rows with
null ids take no part.  A vector shorter than others counts as followed by zeros.  Rows that repeat an
id are candidates each; a query never finds a row of its own id; repeated query rows are answered once.
Ties go to the smaller id; identical vectors get identical scores.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import blocks

QUERY_BLOCK, DATA_BLOCK, TILE = 512, 4096, 1024
#: Components of survivors that are gathered at once.
GATHER = 1 << 22


def cosines(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Cosine of each row of one with the same row of the other."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1]) for x in (one, other))  # by powers of two: exact
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, for fast exact products), each row's scale, and the length of its rounding error."""
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1, keepdims=True) / 127
    small = np.rint(unit / scale).astype(np.int8)
    error = np.sqrt(((unit - small * scale) ** 2).sum(1))
    return small.astype(np.float32 if vectors.shape[1] <= 1024 else float), scale[:, 0], error


def compare(q_ids: np.ndarray, q: np.ndarray, data: list[tuple], k: int) -> tuple:
    """The `k` nearest of the data blocks (ids, vectors, their `quantised`) for each query."""
    q8, q_scale, q_err = quantised(q)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q]
    floor = np.full(len(q), -np.inf)
    step = max(1, GATHER // max(q.shape[1], 1))
    for ids, d, (d8, d_scale, d_err) in data:
        for at in range(0, len(d), TILE):
            tile = slice(at, at + TILE)
            near = (q8 @ d8[tile].T) * q_scale[:, None] * d_scale[tile]
            # |q.d - q'.d'| <= |q - q'| |d| + |q'| |d - d'|, with |q'| <= 1 + |q - q'|
            bound = q_err[:, None] + (1 + q_err)[:, None] * d_err[tile] + 1e-6
            own = q_ids[:, None] == ids[tile]
            low = np.where(own, -np.inf, near - bound)
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            x, y = np.nonzero((near + bound >= floor[:, None]) & ~own)
            for lo in range(0, len(x), step):  # survivors may be many where vectors repeat
                i, j = x[lo : lo + step], y[lo : lo + step] + at
                score = cosines(q[i], d[j])
                cut = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    own_heap = heaps[i[a]]
                    for n in blocks.top(k, score[a:b], ids[j[a:b]]) + a:
                        item = (float(score[n]), -int(ids[j[n]]))
                        if len(own_heap) < k:
                            heapq.heappush(own_heap, item)
                        elif item > own_heap[0]:
                            heapq.heapreplace(own_heap, item)
                    if len(own_heap) == k:
                        floor[i[a]] = max(floor[i[a]], own_heap[0][0] - 1e-12)
    sizes = [len(h) for h in heaps]
    flat = [item for h in heaps for item in h]
    return np.repeat(q_ids, sizes), np.array([-v for _, v in flat], np.int64), np.array([s for s, _ in flat], float)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the `k` largest cosines for each row of `queries`."""
    rows = blocks.usable(vectors, key, column, zero=False)
    asked = blocks.usable(queries, key, column, zero=False).dropDuplicates(["vec_id"])
    width = max(blocks.width_of(rows), blocks.width_of(asked))
    data = blocks.packed(rows, width, DATA_BLOCK, "vectors")
    asked = blocks.packed(asked, width, QUERY_BLOCK, "queries")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        strip = [(ids, d, quantised(d)) for ids, d in blocks.unpacked(right, width)]
        return blocks.answers([compare(q_ids, q, strip, k) for q_ids, q in blocks.unpacked(left, width)], pa.float64())

    found = blocks.crossed(asked.rows, data.rows, blocks.grid(asked, data), run, "query_id bigint, vec_id bigint, score double")
    return blocks.best_of(found, k, F.desc("score"))
