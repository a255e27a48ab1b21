"""Spelling variants: generated edits probe Bloom filters, and only hits meet the vocabulary itself.

`vocabulary` counts the words of all documents, reduced in each task before the shuffle.  Words that
differ by one inserted, deleted or replaced code point are near.  Of each such pair one word generates
the other: the longer one by a deletion, of two equally long ones the one whose replaced code point is
smaller.  Generated words are never spelled out: a word's hash is a polynomial over its code points, so
the hashes of all its deletions and replacements follow from those of its beginnings and ends.  Each is
probed in the blocked Bloom filter of its length; what hits is spelled out and shuffled to an exact join
with the vocabulary, which removes false positives.

Filters take `BLOCK_WORDS` words to a block of 64 bytes.  A length with more than `SHARD` words is split
by hash into shards, each built in one task; at most `AT_ONCE` shards (a proven 64 MB) are broadcast at
once, and a larger vocabulary is probed in as many passes as it needs.

Defined results: null texts have no words.  In a word's neighbours ties go to the smaller word in the
order of code points.  Counts of forms at least double from word to form, so following forms ends.
Rows are read one by one, repeated ids and rows count as often as they occur; other columns are never
looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import ship, staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words a task holds before it hands its counts on.
HELD = 200_000
BLOCK_WORDS, BITS = 24, 6
SHARD, AT_ONCE = 1 << 18, 64
#: Hashes of generated words that are probed at once.
PROBES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def damaged(doc_id: int | None, word: str, one_in: int) -> str:
    """`word` without one code point for one in so many (id, word), by their crc32; unchanged without an id."""
    if not one_in or doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, fewest: int = 3, one_in: int = 0) -> DataFrame:
    """(word, n): words of at least `shortest` code points that occur `fewest` times or more over all documents.

    A word is a run of Latin letters with A-Z lower-cased.  `one_in` plants misspellings: see `damaged`.
    """

    def counts(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, body in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                low = (body.as_py() or "").translate(LOW) if body.is_valid else ""
                own = Counter(m[0] for m in RUN.finditer(low))
                number = doc_id.as_py()
                for word, n in own.items():
                    word = damaged(number, word, one_in)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield counts(held)
                    held = Counter()
        yield counts(held)

    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)


def powers(length: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(length, _BASE)), dtype=np.uint64)


def hashes(table: np.ndarray) -> np.ndarray:
    """The polynomial of each row: the last code point counts once, each one before it _BASE times more."""
    return (table * powers(table.shape[1])[:-1][::-1]).sum(1, dtype=np.uint64)


def places(value: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the bits it sets there as eight 64-bit lanes' numbers (BITS columns)."""
    x = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    block = ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    y = x * np.uint64(0xD6E8FEB86659FD93)
    return block.astype(np.int64), np.stack([(y >> np.uint64(10 + 9 * i)) & np.uint64(511) for i in range(BITS)], -1)


def shard_of(value: np.ndarray, shards: int) -> np.ndarray:
    return ((value * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(shards)


def build(value: np.ndarray) -> np.ndarray:
    """The blocked filter (blocks by 8 lanes) of distinct hashes."""
    blocks = -(-len(value) // BLOCK_WORDS)
    out = np.zeros((blocks, 8), np.uint64)
    block, bits = places(value, blocks)
    for i in range(BITS):
        np.bitwise_or.at(out, (block, (bits[:, i] >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bits[:, i] & np.uint64(63)))
    return out


def probe(value: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    block, bits = places(value, len(blocks))
    lanes = blocks[block[..., None], (bits >> np.uint64(6)).astype(np.int64)]
    return ((lanes >> (bits & np.uint64(63))) & np.uint64(1)).all(-1)


def filters(words: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(len, shard, blocks) of every shard.  `sizes` has the number of words of each length."""
    shards = {n: -(-count // SHARD) for n, count in sizes.items()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[str]] = {}
            for w in batch.column("word").to_pylist():
                by.setdefault(len(w), []).append(w)
            for n, own in by.items():
                value = hashes(points(own, n))
                yield pa.RecordBatch.from_pydict({
                    "len": pa.array(np.full(len(own), n, np.int32)), "shard": pa.array(shard_of(value, shards[n]).astype(np.int32)),
                    "h": pa.array(value.astype(np.int64)),
                })

    def built(key: tuple, part: pa.Table) -> pa.Table:
        value = np.unique(part.column("h").to_numpy().astype(np.uint64))
        return pa.table({"len": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "blocks": pa.array([build(value).tobytes()], pa.binary())})

    placed = words.select("word").mapInArrow(hashed, "len int, shard int, h bigint")
    return placed.groupBy("len", "shard").applyInArrow(built, "len int, shard int, blocks binary")


def edits(table: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """(kind, place, code point, hashes) of each edit of words of one length, for all words at once.

    Replacements go from a smaller code point to a larger one; the others come from the larger word.
    """
    n = table.shape[1]
    power = powers(n)
    whole = hashes(table)
    tail = np.zeros((len(table), n + 1), np.uint64)
    head = np.zeros((len(table), n + 1), np.uint64)
    for i in range(n):
        head[:, i + 1] = head[:, i] * _BASE + table[:, i]
        tail[:, n - i - 1] = tail[:, n - i] + table[:, n - i - 1] * power[i]
    for i in range(n):
        yield "cut", i, 0, head[:, i] * power[n - 1 - i] + tail[:, i + 1]
        for c in alphabet:
            yield "swap", i, int(c), whole + (c - table[:, i]) * power[n - 1 - i]


def candidates(words: DataFrame, shards: dict[tuple[int, int], bytes], count: dict[int, int], alphabet: list[int]) -> DataFrame:
    """(word, near): generated words that these shards may hold.  `count` has the number of shards of each length."""
    held = words.sparkSession.sparkContext.broadcast(shards)
    letters = np.array(alphabet, np.uint64)

    def hits(own: list[str], n: int) -> Iterator[tuple[str, str]]:
        table = points(own, n)
        seen = {key: np.frombuffer(raw, np.uint64).reshape(-1, 8) for key, raw in held.value.items() if key[0] in (n, n - 1)}
        for kind, i, c, value in edits(table, letters):
            length = n - (kind == "cut")
            if length not in count:
                continue
            fits = np.flatnonzero(table[:, i] < c) if kind == "swap" else np.arange(len(own))
            shard = shard_of(value[fits], count[length])
            for (size, number), blocks in seen.items():
                if size == length:
                    part = fits[shard == number] if count[length] > 1 else fits
                    for at in part[probe(value[part], blocks)].tolist():
                        w = own[at]
                        yield w, w[:i] + (chr(c) if kind == "swap" else "") + w[i + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[str]] = {}
            for w in batch.column("word").to_pylist():
                by.setdefault(len(w), []).append(w)
            for n, own in by.items():
                step = max(1, PROBES // BITS // 8)
                for at in range(0, len(own), step):
                    found = set(hits(own[at : at + step], n))  # a doubled letter can be cut in two ways
                    yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in found], pa.string()), "near": pa.array([v for _, v in found], pa.string())})

    return words.select("word").mapInArrow(run, "word string, near string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every two near words, in both directions.  `words` (word, n) is read several times."""
    stats = words.groupBy(F.length("word").alias("len")).count().collect()  # a row for each length of a word
    sizes = {r["len"]: r["count"] for r in stats}
    # a row for each letter in use
    alphabet = [r[0] for r in words.select(F.explode(F.split("word", ""))).distinct().select(F.ascii("col")).collect()]
    count = {n: -(-size // SHARD) for n, size in sizes.items()}
    built = staged(filters(words, sizes), "filters")
    names = [(r["len"], r["shard"]) for r in built.select("len", "shard").orderBy("len", "shard").collect()]
    found = None
    for at in range(0, len(names), AT_ONCE):
        low, high = names[at], names[min(at + AT_ONCE, len(names)) - 1]
        order = F.struct("len", "shard")
        part = built.filter((order >= F.struct(*map(F.lit, low))) & (order <= F.struct(*map(F.lit, high)))).collect()
        hit = candidates(words, {(r["len"], r["shard"]): bytes(r["blocks"]) for r in part}, count, alphabet)
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = found.join(known, "near").join(words, "word")  # exact: what the vocabulary does not hold falls out
    both = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the last word reached.  Each round doubles the steps taken."""
    reached = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = staged(reached.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not new.filter("moved").limit(1).count():
            return new.select("word", "root")
        reached = new.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Per word of `words` (word, n): form, root, n, n_near, form_n.

    The form is the most frequent near word, if it occurs at least `times` as often as the word.
    """
    ship(words.sparkSession)
    words = staged(words.select("word", "n"), "words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left").withColumn("near_n", -F.col("best.less"))
    fits = F.col("near_n") >= times * F.col("n")
    rows = staged(
        rows.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near_n")).alias("form_n")),
        "forms",
    )
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
