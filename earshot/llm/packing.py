"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups.

A document's ids are those of the tokenizer, followed by an end id.  It is cut into pieces of `SIZE` ids
and a rest.  Pieces are dealt at random into groups of about `group` pieces; each group is packed on its
own: pieces in order of falling length go to the first bin with room, found by a descent in a tournament
tree whose nodes hold the largest free capacity below them.  A bin is a sequence.

Ids are the tokenizer's.  Texts of ordinary Latin characters, blanks and line ends are encoded from the
same vocabulary by a faster library when its file is given; texts with any other character, or with the
name of a special token, go to the tokenizer itself.

Defined results: a null or empty text is one piece of one id, the end id.  Rows with null or repeated ids
are documents of their own.  Ties in length go by row.  An empty table gives no sequence.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import ship, staged

SIZE = 2048
END = 1
#: Texts without these are read alike by both libraries.
UNUSUAL = re.compile("[^\n\x20-\x7e\u00a1-\u00ac\u00ae-\u024f]|<\\|")
#: Texts given to the tokenizer at once; its results are many times their size.
AT_ONCE = 16
#: Bits of a bin's number within its group.
BIN_BITS = 32
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@functools.cache
def _tokenizer(path: str):  # noqa: ANN202
    """Loaded once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _ranks(path: str, pattern: str):  # noqa: ANN202
    """The same vocabulary as ranks, loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Encoder:
    """Ids of texts as bytes (little-endian, 32 bits each).

    `tokenizer` is the tokenizer's file; `ranks` and `pattern`, if given, are the same vocabulary as ranks
    and its pattern of words.
    """

    tokenizer: str
    ranks: str | None = None
    pattern: str = ""

    def documents(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), AT_ONCE):
            part = texts[at : at + AT_ONCE]
            slow = [i for i, t in enumerate(part) if self.ranks is None or UNUSUAL.search(t)]
            ids = {}
            if slow:
                found = _tokenizer(self.tokenizer).encode_batch([part[i] for i in slow], add_special_tokens=False)
                ids = {i: np.array(e.ids, "<u4").tobytes() for i, e in zip(slow, found, strict=True)}
            for i, text in enumerate(part):
                yield ids[i] if i in ids else np.array(_ranks(self.ranks, self.pattern).encode_ordinary(text), "<u4").tobytes()


def pieces(docs: DataFrame, encoder: Encoder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for at, ids in enumerate(encoder.documents([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, SIZE):
                    part = ids[4 * start : 4 * (start + SIZE)]
                    rows.append((at, start, len(part) // 4, zlib.crc32(part), total))
            owner, *columns = zip(*rows, strict=True) if rows else [()] * 5
            ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE)


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths are at most `size`."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    free = [size] * (2 * leaves)  # node i has children 2i and 2i + 1; the leaves are bins
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, size - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def packed(docs: DataFrame, encoder: Encoder, key: str = "doc_id", text: str = "text", group: int = 4096, seed: int = 3) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    # rows get numbers in the written table, which later reads repeat: equal rows still part at random
    rows = staged(pieces(docs, encoder, key, text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by("row")
        bins, offsets = first_fit_decreasing(part.column("length").to_numpy(), SIZE)
        sequence = (part.column("group").to_numpy() << BIN_BITS) + bins
        return part.drop_columns(["row", "group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("group").applyInArrow(fill, f"{PIECE}, sequence_id bigint, offset bigint")
