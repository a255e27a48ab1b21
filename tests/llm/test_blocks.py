"""Searches over a grid of blocks: nothing is broadcast, and no number of blocks and strips changes the result."""

from __future__ import annotations

import numpy as np
import pytest

from earshot.llm import blocks, inner_products, nearest
from tests.llm.test_operators import DATA, answers


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet")


@pytest.fixture(scope="module")
def matrix(vectors):
    rows = vectors.select("vec_id", "embedding").toPandas()
    return rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)


@pytest.fixture
def small(monkeypatch):
    """16 vectors of 64 components a block, about three blocks a strip."""
    monkeypatch.setattr(blocks, "BLOCK", 16 * 64 * 8)
    monkeypatch.setattr(blocks, "STRIP", 50 * (64 + blocks.OWN) * 8)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def best(ids: np.ndarray, score: np.ndarray, at: int) -> list:
    return [(ids[i], score[i]) for i in np.lexsort((ids, -score)) if i != at][:5]


def test_nearest_broadcasts_no_copies_of_blocks(vectors):
    found = nearest.nearest(vectors, vectors.filter("vec_id % 50 = 0"))
    assert "Broadcast" not in plan(found) and "CoGroup" in plan(found)


def test_nearest_over_many_strips(vectors, matrix, small):
    ids, m = matrix
    asked = vectors.filter("vec_id % 5 = 0")
    got = answers(nearest.nearest(vectors, asked))
    length = np.sqrt((m * m).sum(1))
    assert len(got) == 100
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        want = best(ids, (m * m[at]).sum(1) / (length * length[at]), at)
        assert [i for i, _ in found] == [i for i, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-12)


def test_inner_products_broadcast_no_copies_of_blocks(vectors):
    found = inner_products.top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"))
    assert "Broadcast" not in plan(found) and plan(found).count("CoGroup") >= 2


@pytest.mark.parametrize("scale", [1.0, 1e5])  # products fit floating point, or do not
def test_inner_products_over_many_strips(spark, matrix, small, scale):
    """Lengths differ, so that whole blocks are refused; a vector is repeated under many ids."""
    ids, m = matrix
    m = m * np.random.default_rng(3).lognormal(0, 1, len(m))[:, None] * scale
    m[100:160] = m[np.argmax((m * m).sum(1))]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)], "vec_id bigint, embedding array<double>")
    got = answers(inner_products.top_inner_products(rows, rows.filter("vec_id % 5 = 0")))
    ints = [[int(x) for x in v] for v in np.floor(m * 256)]
    whole = np.array(ints, dtype=object)
    assert len(got) == 100
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        order = sorted((i for i in range(len(ids)) if i != at), key=lambda i, s=whole @ whole[at]: (-s[i], ids[i]))[:5]
        assert found == [(ids[i], sum(a * b for a, b in zip(ints[at], ints[i], strict=True))) for i in order]


def test_few_and_many_survivors_give_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    q, d = (np.floor(rng.normal(0, 100, (n, 24))) for n in (40, 700))
    d = d[np.argsort(-(d * d).sum(1), kind="stable")]
    basis = np.linalg.eigh(d.T @ d)[1][:, ::-1].copy()
    ask, data = (inner_products.measured(np.arange(len(x)) + at, x, basis, 6) for x, at in ((q, 10_000), (d, 0)))
    found = []
    for dense in (0.0, 2.0):
        monkeypatch.setattr(inner_products, "DENSE", dense)
        found.append([z.tolist() for z in inner_products.compare(ask, [data], np.full(40, -np.inf), 5)])
    score = (q @ d.T).astype(int)
    want = [(p, int(i), int(score[p, i])) for p in range(40) for i in np.lexsort((np.arange(700), -score[p]))[:5]]
    assert found[0] == found[1] and list(zip(*found[0], strict=True)) == want


def test_the_grid_is_bounded_by_size_and_fills_the_cores(spark):
    side = lambda count, size: blocks.Blocks(spark.range(0), count, size)
    cells = 4 * spark.sparkContext.defaultParallelism
    assert blocks.grid(side(0, 0), side(0, 0)) == (1, 1)
    assert blocks.grid(side(1, 1000), side(3, 5000)) == (1, 3)
    assert blocks.grid(side(30, 8 << 20), side(1000, 100 << 20)) == (1, cells)
    assert blocks.grid(side(90, 40 << 20), side(9000, 10_000 << 20)) == (3, 625)
