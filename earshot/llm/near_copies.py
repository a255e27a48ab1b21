"""Near copies by b-bit MinHash.

A document's set is its distinct word shingles, hashed to 64 bits.  `HASHES` minima are cut into bands;
equal bands make candidates.  Of each minimum only the low `BITS` bits are kept, packed into longs: bit
counts of two packed signatures give the share of agreeing minima, which is corrected for chance
agreement (2^-BITS) to an estimate of the similarity.  Candidates whose estimate is not far below the
threshold are confirmed on their full sets.

Groups are never expanded into all pairs.  Equal sets are one node.  Each node is first compared with one
pivot of its buckets.  Then, while components still merge, each node outside the largest component of a
bucket meets a new pivot of that component, one pair a node and round.  What is left, buckets of several
components, is compared whole, in blocks: a row holds up to `CHUNK` nodes of a bucket with their
signatures, and pairs are tried inside the task.  A pair is looked at only in the first bucket it shares.
Nodes with a likely partner there come again with their full sets, and a block returns the links that
join its components, at most one less than it has components.  A bucket of more nodes has several blocks;
those of nodes outside the largest component meet all of them.  So pairs of blocks become rows, pairs of
documents never do, and every link between components that shares a band is confirmed or refused.  With
40 bands of 5 rows a pair of similarity 0.8 shares no band with probability 1e-7.

Defined results: null and empty texts and texts without words have no set (n_shingles 0), are linked with
nothing and are kept.  A text of fewer words than the width is one shingle.  Rows with a null id take no
part and are kept, with a null component_id.  Rows are judged one by one; rows that repeat an id share
its component.  Ties do not matter: a component's id is its smallest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import ship, staged

BANDS, ROWS, BITS = 40, 5, 4
HASHES = BANDS * ROWS
#: Standard deviations that an estimate may fall below the threshold.
SLACK = 5.2
#: Nodes of a block, and hashes of their sets (8 bytes each).
CHUNK, ELEMENTS = 1024, 1 << 20
MEMBER = ("doc_id", "comp", "n", "sig", "bands")
SPACE = re.compile(rb"[\x20\x09-\x0D]")

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_BYTE = np.random.default_rng(11).integers(0, 1 << 62, 256, np.uint64)
_BAND = np.random.default_rng(12).integers(0, 1 << 62, (BANDS, ROWS), np.uint64) | np.uint64(1)
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word; A-Z count as a-z.  Bytes are weighted by random factors of their place."""
    raw = np.frombuffer(text, np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    inside = ~_SPACES[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))[: len(raw)] if starts[0] == 0 else None
    if place is None:
        raw, inside = raw[starts[0] :], inside[starts[0] :]
        ends, starts = ends - starts[0], starts - starts[0]
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    value = _mixed(_BYTE[raw] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value[~inside] = 0
    return _mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (uint64)."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    n = min(width, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return np.unique(out)


def signature(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64) and packed low bits of the minima (int64) of a non-empty set."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    small = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 2048):
        np.minimum(least, (small[at : at + 2048, None] * _A + _B).min(0), out=least)
    bands = _mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(1) + np.arange(BANDS, dtype=np.uint64))
    bits = (least[:, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    # BITS planes, so that agreement of a minimum is a bit of the planes' combined difference
    packed = np.packbits(bits.T.astype(np.uint8), axis=1)
    return bands.astype(np.int64), np.frombuffer(packed.tobytes(), np.uint8)


def agreement(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (rows of bytes), by bit counts."""
    diff = one.reshape(*one.shape[:-1], BITS, HASHES // 8) ^ other.reshape(*other.shape[:-1], BITS, HASHES // 8)
    differing = np.bitwise_count(np.bitwise_or.reduce(diff, axis=-2)).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((1 - differing / HASHES) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Estimates below this are refused without a look at the sets."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, n, k1, k2 (hash of the whole set), sig, bands of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sigs, bands = [], [], [], [], []
            for row in batch.column("text"):
                items = shingle_set(row.as_py(), width)
                n.append(len(items))
                k1.append(int(items.sum(dtype=np.uint64).astype(np.int64)))
                k2.append(int(_mixed(items * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64)))
                band, sig = signature(items) if len(items) else (None, None)
                sigs.append(None if sig is None else sig.tobytes()), bands.append(band)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                    pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "k1", "k2", "sig", "bands"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(make, "doc_id bigint, n bigint, k1 bigint, k2 bigint, sig binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id and items (the whole set as bytes) of the documents in `ids`: the only texts that are read again."""
    # always by a merge join: ids may be many, and the plan is then the same at every size
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(ids.hint("merge"), "doc_id", "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "items": [shingle_set(t, width).tobytes() for t in batch["text"]]})

    return rows.mapInPandas(sets, "doc_id bigint, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets are similar enough."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(compare, "a bigint, b bigint").distinct()


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    if percent * max(len(one), len(other)) > 100 * min(len(one), len(other)) or not len(one):
        return False
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def components(links: DataFrame) -> DataFrame:
    """(doc_id, comp) of every linked node: the smallest id reachable over links (a, b).

    Every node takes the smallest label among itself and its neighbours, then the label of its label,
    until nothing changes; both halves are aggregations and joins, staged in the shared folder.
    """
    edges = staged(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("doc_id").alias("b"), "comp"), "b").select(F.col("a").alias("doc_id"), "comp")
        near = seen.union(labels).groupBy("doc_id").agg(F.min("comp").alias("comp"))
        far = near.join(labels.select(F.col("doc_id").alias("comp"), F.col("comp").alias("next")), "comp")
        new = staged(
            far.join(labels.select("doc_id", F.col("comp").alias("old")), "doc_id").select("doc_id", F.least("comp", "next").alias("comp"), "old"), "labels"
        )
        if new.filter("comp <> old").limit(1).count() == 0:
            return new.select("doc_id", "comp")
        labels = new.select("doc_id", "comp")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """`comp` (doc_id, comp) after more links between its components; only their labels are joined up."""
    ends = links.join(comp.select(F.col("doc_id").alias("a"), F.col("comp").alias("x")), "a").join(comp.select(F.col("doc_id").alias("b"), F.col("comp").alias("y")), "b")
    labels = components(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    labels = labels.select(F.col("doc_id").alias("comp"), F.col("comp").alias("new"))
    return staged(comp.join(labels, "comp", "left").select("doc_id", F.coalesce("new", "comp").alias("comp")), "comp")


def unsettled(placed: DataFrame, comp: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members (bucket, doc_id, n, comp) and the buckets (major, pivot, size and hashes of all and of the rest) that hold several components."""
    where = placed.select("bucket", "doc_id", "n").join(comp, "doc_id")
    pivot = F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)), "doc_id"))["doc_id"]
    parts = where.groupBy("bucket", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("sum"), pivot.alias("pivot"))
    top = F.max(F.struct("size", "comp", "pivot", "sum"))
    stats = parts.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("sum").alias("sum"), F.count("*").alias("parts"), top.alias("top")).filter("parts > 1")
    return where, stats.select(
        "bucket", "size", "sum", F.col("top.comp").alias("major"), F.col("top.pivot").alias("pivot"),
        (F.col("size") - F.col("top.size")).alias("rest"), (F.col("sum") - F.col("top.sum")).alias("rest_sum"),
    )


def pivot_pairs(where: DataFrame, buckets: DataFrame, nodes: DataFrame, tried: DataFrame) -> DataFrame:
    """(a, b): each node outside a bucket's largest component with the likeliest of the pivots it has not met."""
    pairs = where.join(buckets.select("bucket", "major", "pivot"), "bucket").filter("comp <> major")
    pairs = pairs.select("doc_id", "pivot", F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("x", "y"))
            yield batch[["doc_id", "a", "b"]].assign(est=agreement(x, y) if len(batch) else [])

    both = pairs.join(nodes.select("doc_id", F.col("sig").alias("x")), "doc_id").join(nodes.select(F.col("doc_id").alias("pivot"), F.col("sig").alias("y")), "pivot")
    found = both.select("doc_id", "a", "b", "x", "y").mapInPandas(guess, "doc_id bigint, a bigint, b bigint, est double")
    best = found.groupBy("doc_id").agg(F.max(F.struct("est", "a", "b")).alias("top"))
    return best.select("top.*").distinct()


class Block:
    """Nodes of a bucket as arrays."""

    def __init__(self, members: pa.StructArray, bucket: int) -> None:
        self.ids, self.comp, self.n = (members.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "comp", "n"))
        self.sigs = np.frombuffer(b"".join(members.field("sig").to_pylist()), np.uint8).reshape(len(members), -1)
        self.bands = members.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(members), -1)
        self.band = int(np.flatnonzero(self.bands[0] == bucket)[0])
        if "items" in [f.name for f in members.type]:
            self.items = [np.frombuffer(x, np.uint64) for x in members.field("items").to_pylist()]

    def likely(self, other: Block, major: int, percent: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and estimates of likely pairs of a node outside `major` here and one of another component there.

        A pair that shares an earlier band is left to that bucket; of a pair outside `major` one order is enough.
        """
        out = []
        guests = np.flatnonzero(self.comp != major)
        for part in np.array_split(guests, -(-len(guests) // 64) or 1):
            ok = self.comp[part][:, None] != other.comp
            ok &= (other.comp == major) | (self.ids[part][:, None] < other.ids)
            sizes = np.minimum(self.n[part][:, None], other.n), np.maximum(self.n[part][:, None], other.n)
            x, y = np.nonzero(ok & (100 * sizes[0] >= percent * sizes[1]))
            est = agreement(self.sigs[part[x]], other.sigs[y])
            x, y, est = part[x[est >= least]], y[est >= least], est[est >= least]
            first = (self.bands[x] == other.bands[y]).argmax(1) == self.band
            out.append((x[first], y[first], est[first]))
        x, y, est = (np.concatenate(v) for v in zip(*out, strict=True))
        return x, y, est


def joining(one: Block, other: Block, major: int, percent: int, least: float) -> list[tuple[int, int]]:
    """Confirmed links between two blocks that join their components, likeliest pairs first; no two join the same."""
    parent: dict[int, int] = {}

    def top(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = c = parent.get(parent[c], parent[c])
        return c

    links = []
    x, y, est = one.likely(other, major, percent, least)
    for at in np.argsort(-est, kind="stable").tolist():
        i, j = int(x[at]), int(y[at])
        p, q = top(int(one.comp[i])), top(int(other.comp[j]))
        if p != q and similar(one.items[i], other.items[j], percent):
            parent[p] = q
            links.append((int(one.ids[i]), int(other.ids[j])))
    return links


def _blocks(rows: DataFrame, fields: tuple[str, ...], *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("members"))


def _parts(column: pa.ListArray, buckets: list[int]) -> Iterator[Block]:
    """A block for each row; batches hold few rows, each with its own nodes."""
    for i, bucket in enumerate(buckets):
        yield Block(column[i].values, bucket)


def links_in_blocks(where: DataFrame, buckets: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of the members of each bucket; see the module's text."""
    least = least_estimate(percent)
    split = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("sum") / ELEMENTS))
    groups = F.greatest(F.ceil(F.col("rest") / CHUNK), F.ceil(F.col("rest_sum") / ELEMENTS))
    buckets = buckets.select("bucket", "major", split.alias("chunks"), groups.alias("groups"))
    full = (*MEMBER, "items")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("bucket").to_pylist()
            for bucket, major, block in zip(names, batch.column("major").to_pylist(), _parts(batch.column("members"), names), strict=True):
                x, y, _ = block.likely(block, major, percent, least)
                ids = block.ids[np.union1d(x, y).astype(int)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.full(len(ids), bucket)), "doc_id": pa.array(ids)})

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("bucket").to_pylist()
            for major, block in zip(batch.column("major").to_pylist(), _parts(batch.column("members"), names), strict=True):
                yield _links(joining(block, block, major, percent, least))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("bucket").to_pylist()
            both = zip(_parts(batch.column("left"), names), _parts(batch.column("members"), names), strict=True)
            for major, (left, right) in zip(batch.column("major").to_pylist(), both, strict=True):
                yield _links(joining(left, right, major, percent, least))

    members = staged(where.join(buckets, "bucket").join(nodes.select("doc_id", "sig", "bands"), "doc_id"), "members")
    small = members.filter("chunks = 1")
    shown = _blocks(small, MEMBER, "bucket", "major").mapInArrow(likely, "bucket bigint, doc_id bigint")
    shown = small.join(staged(shown, "likely"), ["bucket", "doc_id"]).join(sets, "doc_id")
    links = _blocks(shown, full, "bucket", "major").mapInArrow(inside, "a bigint, b bigint")
    large = members.filter("chunks > 1").join(sets, "doc_id").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks"))
    right = _blocks(large, full, "bucket", "major", "chunk")
    left = large.filter("comp <> major").withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(1)), "groups"))
    left = _blocks(left, full, "bucket", "chunks", "group").withColumnRenamed("members", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = left.join(right, ["bucket", "chunk"]).select("bucket", "major", "left", "members")
    return links.union(pairs.mapInArrow(across, "a bigint, b bigint")).distinct()


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    `width` words make a shingle; `percent` is the least similarity.  At most `rounds` of pivots come
    before the full comparison; their number changes the work, not the result.
    """
    ship(docs.sparkSession)
    rows = staged(signatures(docs, key, text, width), "signatures")
    live = rows.filter("doc_id is not null and n > 0")
    copies = staged(live.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "copies")
    nodes = live.join(copies.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "n", "k1", "k2"])
    nodes = staged(nodes.select("doc_id", "n", "sig", "bands"), "nodes")
    placed = nodes.select("doc_id", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    placed = staged(placed.join(shared.select("bucket", "pivot"), "bucket"), "placed")
    pairs = placed.filter("doc_id <> pivot").groupBy("doc_id").agg(F.min("pivot").alias("pivot"))
    pairs = pairs.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))

    least = least_estimate(percent)

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("x", "y"))
            yield batch.loc[agreement(x, y) >= least, ["a", "b"]] if len(batch) else batch[["a", "b"]]

    both = pairs.join(nodes.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a")
    both = both.join(nodes.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b")
    pairs = staged(both.select("a", "b", "x", "y").mapInPandas(likely, "a bigint, b bigint").distinct(), "pairs")
    sets = staged(shingle_sets(docs, placed.select("doc_id").distinct(), key, text, width), "sets")
    links = staged(confirmed(pairs, sets, percent), "links")
    alone = placed.select("doc_id", F.col("doc_id").alias("comp")).distinct()
    comp, tried = merged(alone, links), pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn in range(rounds):
        pairs = staged(pivot_pairs(*unsettled(placed, comp, turn), nodes, tried), "pairs")
        links = staged(confirmed(pairs.filter(F.col("est") >= least).select("a", "b"), sets, percent), "links")
        if not links.limit(1).count():
            break
        comp, tried = merged(comp, links), tried.union(pairs.select("a", "b"))
    where, buckets = unsettled(placed, comp, rounds)
    comp = merged(comp, staged(links_in_blocks(where, buckets, nodes, sets, percent), "links"))
    named = copies.join(comp.withColumnRenamed("doc_id", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("comp", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    comp_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == comp_id, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), kept.alias("kept"))
