"""Periodic runs of words, by an enhanced suffix array and the branching-tandem test.

A run is a longest stretch of words that repeats with its smallest period, at least `TIMES` times and
`LEAST` words long.  Documents of a batch are laid end to end as numbers; a word has another number in
each document, so no suffix is like one of another document and no run crosses an end.  Suffixes are
sorted by doubling, looking only at those that are not yet alone; the ranks of each step give the longest
common prefixes (LCP).  An LCP interval is the stretch of the suffix array between the nearest smaller
values, found for every boundary without building a tree.

Every run of period q ends with a square whose halves go on differently: its two suffixes have a common
prefix of exactly q words, so they lie in different children of an interval of depth q, and one of them is
not in the largest child.  Hence, for each interval, only the suffixes i of the smaller children are
tested: do i + depth or i - depth lie in the interval, outside the child?  That is n log n tests in all.
A square found so is rotated to the left as long as words agree; the stretch is the run.  Multiples of a
period give the same stretch, which keeps its smallest period.

Defined results: null and empty texts have no words and no runs.  Rows are read one by one, so repeated
rows, repeated ids and null ids are rows of their own.  Texts are read whole; a batch's arrays take about
150 bytes a word.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import ship

TIMES, LEAST = 3, 24
#: Words whose suffixes are sorted at once, and suffixes tested at once.
AT_ONCE, TESTS = 1 << 17, 1 << 20
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks by the first 1, 2, 4, ... symbols (a rank past the end is -1).

    Equal ranks mean equal beginnings; the last ranks are the inverse of the order.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.diff(symbols[order], prepend=-1) != 0
    rank = np.full(n + 1, -1)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, step = [rank], 1
    while True:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            return order, ranks
        live = order[places]
        pair = rank[live] * (n + 2) + rank[np.minimum(live + step, n)] + 1
        by = np.argsort(pair, kind="stable")
        order[places], pair = live[by], pair[by]
        first = np.diff(pair, prepend=-1) != 0
        new[places] = first
        rank = rank.copy()
        rank[live[by]] = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
        ranks.append(rank)
        step *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in order; 0 for the first."""
    n = len(order)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    one, other, shared = order[at - 1], order[at], np.zeros(len(at), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = ranks[level][np.minimum(one + shared, n)] == ranks[level][np.minimum(other + shared, n)]
        shared += same << level
    out[at] = shared
    return out


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary with a common prefix, the first and the end of its interval: the nearest smaller values."""
    n = len(lcp)
    values = lcp.tolist()
    left, right = [0] * n, [n] * n
    stack: list[int] = []
    base = -1  # the boundary without a common word before the present stretch
    for t in np.flatnonzero((lcp > 0) | np.append(False, lcp[:-1] > 0)).tolist():
        value = values[t]
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = t
        if not value:
            base = -1
            continue
        if base < 0:
            base = t - 1
        if not stack:
            left[t] = base
        else:
            left[t] = stack[-1] if values[stack[-1]] < value else left[stack[-1]]
        stack.append(t)
    return np.array(left), np.array(right)


def branching_squares(order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose two halves go on differently."""
    n = len(order)
    left, right = intervals(lcp)
    cuts = np.flatnonzero(lcp > 0)
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = cuts[np.lexsort((cuts, lcp[cuts], left[cuts]))]
    lo, hi, depth = left[cuts], right[cuts], lcp[cuts]
    head = np.append(True, (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1]))
    # an interval with m cuts has m + 1 children: the stretch before its first cut, and one after each
    place = np.arange(len(cuts)) + np.cumsum(head)
    count = len(cuts) + int(head.sum())
    start, end, owner = np.empty(count, np.int64), np.empty(count, np.int64), np.empty(count, np.int64)
    start[place], owner[place] = cuts, np.arange(len(cuts))
    first = place[head] - 1
    start[first], owner[first] = lo[head], np.flatnonzero(head)
    end[:-1] = start[1:]
    last = np.append(first[1:] - 1, count - 1)
    end[last] = hi[owner[last]]
    size = end - start
    group = np.cumsum(np.isin(np.arange(count), first)) - 1
    # the largest child of each interval, the first of equal ones, is left out
    by = np.lexsort((np.arange(count), -size, group))
    small = np.ones(count, bool)
    small[by[np.append(True, group[by][1:] != group[by][:-1])]] = False
    start, end, owner = start[small], end[small], owner[small]
    upto = np.cumsum(end - start)
    found: list[np.ndarray] = []
    at = 0
    while at < len(start):
        # children until the suffixes of one step are TESTS, one child at least
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TESTS, side="right")))
        size = end[at:stop] - start[at:stop]
        child = np.repeat(np.arange(at, stop), size)
        suffix = order[np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + start[child]]
        ell = depth[owner[child]]
        for other, begin in ((suffix + ell, suffix), (suffix - ell, suffix - ell)):
            here = np.flatnonzero((other >= 0) & (other < n))
            rank, c = inverse[other[here]], child[here]
            inside = (rank >= lo[owner[c]]) & (rank < hi[owner[c]]) & ~((rank >= start[c]) & (rank < end[c]))
            found.append(np.stack([begin[here[inside]], ell[here[inside]]]))
        at = stop
    starts, periods = np.unique(np.concatenate(found, axis=1), axis=1)
    return starts, periods


def find_runs(symbols: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of whole numbers, by start and period."""
    if len(symbols) < least:
        return []
    order, ranks = suffix_array(symbols)
    starts, periods = branching_squares(order, ranks[-1], common_prefixes(order, ranks))
    # what a run needs to the left of its last square, looked at a word at a time for all squares at once
    need = np.maximum(least - 2 * periods, (times - 2) * periods)
    for back in range(1, 9):
        fits = (need < back) | ((starts >= back) & (symbols[starts - back] == symbols[starts - back + periods]))
        starts, periods, need = starts[fits], periods[fits], need[fits]
    found: dict[int, list[tuple[int, int]]] = {}
    by = np.argsort(periods, kind="stable")
    for i, q in zip(starts[by].tolist(), periods[by].tolist(), strict=True):
        here = found.setdefault(i + 2 * q, [])
        if any(q % period == 0 and start <= i for start, period in here):
            continue  # a multiple of a smaller period of the same stretch
        start = rotated(symbols, i, q)
        if i + 2 * q - start >= max(least, times * q):
            here.append((start, q))
    return sorted((s, end - s, q) for end, here in found.items() for s, q in here)


def rotated(symbols: np.ndarray, start: int, period: int) -> int:
    """The first place from which words agree with those a period later, up to `start`."""
    width = 64
    while start:
        low = max(0, start - width)
        differ = np.flatnonzero(symbols[low:start] != symbols[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, width = low, width * 2
    return 0


def _batch_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each document, of all documents at once."""
    parts, held = [], 0
    for words in docs:
        own: dict[bytes, int] = {}
        parts.append(np.array([own.setdefault(w, len(own)) for w in words], np.int64) + held)
        held += len(own)
    ends = np.cumsum([len(p) for p in parts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for start, length, period in find_runs(np.concatenate(parts) if parts else np.zeros(0, np.int64)):
        doc = int(np.searchsorted(ends, start, side="right"))
        out[doc].append((start - int(ends[doc] - len(parts[doc])), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run contains after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [w for w, k in zip(words, keep, strict=True) if k]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def with_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, runs (start, length, period; by start, then period), text without repetition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                docs, ids, held = [], [], 0
                while at < batch.num_rows and (not docs or held < AT_ONCE):
                    body = batch.column("text")[at].as_py()
                    # bytes split at just the blanks that part words here: 0x20 and 0x09 to 0x0D
                    docs.append((body or "").encode("utf-8", "surrogatepass").split())
                    ids.append(at)
                    held += len(docs[-1])
                    at += 1
                runs = _batch_runs(docs)
                fields = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(ids[0], len(ids)), pa.array([len(d) for d in docs], pa.int64()),
                        pa.array(fields, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        pa.array([collapsed(d, r) for d, r in zip(docs, runs, strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "text"],
                )

    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs {RUN}, text string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; ties by start, then period; null if none."""

    def better(a: Column, b: Column) -> Column:  # runs come by start and period, so only a greater one replaces
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
