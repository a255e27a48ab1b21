"""Exact copies, spelling variants and periodic runs against brute force, and on hard inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import exact_copies, queries, repeats, spelling
from tests.llm.test_operators import DATA, ROWS, documents, hard  # noqa: F401

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return (text or "").translate(LOW)


# exact copies


def same_texts(rows: list[tuple]) -> dict:
    found: dict[str, list] = {}
    for doc_id, text in rows:
        found.setdefault(lower(text), []).append(doc_id)
    return found


@pytest.mark.parametrize("counters", [1, 3, 1023])
def test_exact_copies_match_brute_force(spark, documents, counters):  # noqa: F811
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = same_texts(rows)
    got = {r.doc_id: r for r in exact_copies.exact_copies(documents, counters=counters).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids, r = want[lower(text)], got[doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), doc_id == max(ids))
        assert bytes(r.digest).hex() == hashlib.sha256(lower(text).encode()).hexdigest()


def test_a_hot_text_is_settled_before_the_shuffle(spark):
    texts = [(i, "Copied TEXT" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    digests = docs.select("doc_id", F.unhex(exact_copies.digest(F.col("text"))).alias("digest"), F.col("doc_id").alias("row"))
    hot = exact_copies.frequent(digests, 20).collect()
    assert [(bytes(r.digest).hex(), r.top.doc_id, r.n) for r in hot] == [(hashlib.sha256(b"copied text").hexdigest(), 2997, 1000)]
    got = exact_copies.exact_copies(docs, counters=20)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {
        (i, max(ids), len(ids)) for ids in same_texts(texts).values() for i in ids
    }


def test_misra_gries_loses_no_frequent_item():
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randrange(rng.choice([3, 30, 300])) ** 2 for _ in range(rng.randrange(1, 400))]
        held: dict = {}
        most = rng.randrange(1, 12)
        for at in range(0, len(items), 37):
            for k, n in Counter(items[at : at + 37]).items():
                held[k] = held.get(k, 0) + n
            held = exact_copies.reduced(held, most)
        assert len(held) <= most
        assert {k for k, n in Counter(items).items() if n * (most + 1) > len(items)} <= set(held)


def test_exact_copies_on_hard_rows(hard, spark):  # noqa: F811
    got = exact_copies.exact_copies(hard).collect()
    assert len(got) == len(ROWS)
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert sorted(by[1]) == [(1, 2, False), (1, 2, True)]  # a repeated row stays once
    assert by[2] == [(3, 2, False)] and by[3] == [(3, 2, True)]
    assert by[None] == [(None, 1, True)]
    big = (1 << 60) + 1
    rows = spark.createDataFrame([(big, "a", 7), (None, "A", 8), (big + 2, "a", 9)], "doc_id bigint, text string, digest int")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_copies.exact_copies(rows).collect()} == {(big, big + 2, False), (None, big + 2, False), (big + 2, big + 2, True)}
    assert exact_copies.without_copies(rows).collect() == [(big + 2, "a", 9)]
    stay = exact_copies.without_copies(hard)
    assert stay.columns == hard.columns and stay.count() == len({lower(r[1]) for r in ROWS})
    assert exact_copies.exact_copies(hard.limit(0)).count() == 0


# spelling variants


def spelled(rows: list[tuple], one_in: int) -> dict[str, int]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if one_in and doc_id is not None and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_variants(words: dict[str, int]) -> dict:
    forms, out = {}, {}
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w, n in words.items():
        near = [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, []) if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * n else None
        out[w] = (n, len(near))
    for w in words:
        last = w
        while forms[last]:
            last = forms[last]
        out[w] = (forms[w], last, *out[w], words[forms[w]] if forms[w] else None)
    return out


def test_spelling_matches_brute_force(spark, documents):  # noqa: F811
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = spelled(rows, 97)
    vocabulary = spelling.vocabulary(documents, one_in=97)
    assert {r.word: r.n for r in vocabulary.collect()} == want
    got = queries.op12_spelling(spark, DATA)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == all_variants(want)


def test_spelling_in_several_shards_and_passes(spark, monkeypatch):
    """Small shards, so that lengths are split and filters are broadcast in several passes."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 500) for _ in range(700)}
    monkeypatch.setattr(spelling, "SHARD", 40)
    monkeypatch.setattr(spelling, "AT_ONCE", 3)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == all_variants(words)


def test_filters_hold_every_word_and_few_others():
    rng = np.random.default_rng(4)
    value = np.unique(rng.integers(0, 1 << 63, 20_000, np.uint64))
    blocks = spelling.build(value)
    assert spelling.probe(value, blocks).all()
    assert spelling.probe(rng.integers(0, 1 << 63, 50_000, np.uint64), blocks).mean() < 0.02


def test_spelling_on_hard_rows(hard, spark):  # noqa: F811
    want = spelled([r[:2] for r in ROWS], 97)
    got = spelling.variants(spelling.vocabulary(hard, one_in=97)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == all_variants(want)
    assert spelling.variants(spelling.vocabulary(hard.limit(0))).count() == 0
    # equal counts: the smaller word in code-point order; chains end at the last form; doubled letters are one pair
    words = {"zabcd": 4, "babcd": 4, "aabcd": 1, "xxabcd": 1, "xabcd": 9, "xabce": 40, "élmno": 7, "élmnoo": 3}
    got = spelling.variants(spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n bigint, near string")).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == all_variants(words)


# periodic runs


def all_runs(words: list, times: int = 3, least: int = 24) -> list[tuple]:
    out: dict = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                out.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        words: list[int] = []
        size = rng.choice([10, 40, 150, 300])
        while len(words) < size:
            k = rng.choice([1, 1, 2, 3, 4, 7, 9, 30])
            words += ([rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(k)] * rng.randrange(1, 12))[: size + rng.randrange(30)]
        assert repeats.find_runs(np.array(words)) == all_runs(words)
    for times, least in ((2, 4), (4, 10)):
        words = [rng.randrange(2) for _ in range(200)]
        if times > 2:
            assert repeats.find_runs(np.array(words), times, least) == all_runs(words, times, least)
    assert repeats.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def again(doc_id: int, words: list[str]) -> list[str]:
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_repeats_query_matches_brute_force(spark, documents):  # noqa: F811
    got = {r.doc_id: r for r in queries.op13_repeats(spark, DATA).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = again(doc_id, BLANK.findall(text or ""))
        if len(words) > 3000 and zlib.crc32(str(doc_id).encode()) % 10:
            continue  # brute force is quadratic
        runs = all_runs(words)
        planted += bool(runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted > 5


def test_repeats_on_hard_rows(hard, spark):  # noqa: F811
    got = repeats.with_runs(hard).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r.doc_id)
        words = BLANK.findall(text or "")
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert r.n_words == len(words)
        if r.doc_id in (5, 6):  # one sentence again and again
            assert [x[2] for x in runs] == [11] and len(r.text.split()) == 11 + (r.doc_id == 6)
        else:
            assert runs == all_runs(words) and r.text == " ".join(words)
    assert repeats.with_runs(hard.limit(0)).count() == 0
    big = (1 << 60) + 1
    rows = spark.createDataFrame([(big, "a " * 30, 1), (None, "b", 2), (big + 2, None, 3)], "doc_id bigint, text string, runs int")
    assert {(r.doc_id, r.text) for r in repeats.with_runs(rows).collect()} == {(big, "a"), (None, "b"), (big + 2, "")}
    # two runs of the same exponent: the earlier one
    two = spark.createDataFrame([(1, "x " * 24 + "y " * 24 + "z " * 23)], "doc_id bigint, text string")
    best = repeats.with_runs(two).select(repeats.most_repeated(F.col("runs")).alias("r")).first().r
    assert (best.start, best.length, best.period) == (0, 24, 1)
