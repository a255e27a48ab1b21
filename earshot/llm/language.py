"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts hashed character n-grams of words for each language.  A word's score for a language is
the mean smoothed log-probability of its n-grams, times its length up to a bound, so long words weigh
more.  Only languages whose training text uses the word's script are candidates.  The best path through
the words, with a fixed cost for each change of language, labels spans; the language with most letters
wins, and its share of the letters is the score.

Defined results: null text or text without a letter gives `und`, score 0 and no spans; with nothing to
learn from, every text does.  Letters are what `str.isalpha` says, so numerals such as ½ are none.
Repeated rows are labelled one by one, ties between languages go to the name that sorts first, texts are
read whole, and other columns of the input are never looked at; those named lang_pred, score or spans give
way to the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import annotated, bounded_sample, free_name, ship

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Script ranges (first code point, last, script number); letters outside are script 0.
SCRIPTS = (
    (0x41, 0x24F, 1), (0x1E00, 0x1EFF, 1), (0x370, 0x3FF, 2), (0x1F00, 0x1FFF, 2), (0x400, 0x52F, 3), (0x530, 0x58F, 4),
    (0x590, 0x5FF, 5), (0x600, 0x77F, 6), (0x900, 0x97F, 7), (0x980, 0x9FF, 8), (0xB80, 0xBFF, 9), (0xE00, 0xE7F, 10),
    (0x10A0, 0x10FF, 11), (0x1100, 0x11FF, 12), (0xAC00, 0xD7AF, 12), (0x3040, 0x309F, 13), (0x30A0, 0x30FF, 13),
    (0x3400, 0x9FFF, 14), (0x20000, 0x2FA1F, 14),
)
SCRIPT_COUNT = 15
WORD = re.compile(r"[^\W\d_]+")
#: Numerals that the class of word characters holds although they are no letters, as blanks.
NUMERALS = {i: " " for i, c in enumerate(map(chr, range(0x110000))) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
SPANS = "array<struct<start:bigint,end:bigint,lang:string>>"
CACHE = 150_000
#: Words whose n-grams are scored at once.
AT_ONCE = 8192
STEP_WORDS = 1 << 17
#: Tasks that count the sample.
PARTS = 16


def words_of(text: str) -> tuple[str, list[str]]:
    """The words of a text, and the text they keep their places in: blanks stand for numerals that are no letters."""
    found = WORD.findall(text)
    if not all(map(str.isalpha, found)):
        text = text.translate(NUMERALS)
        found = WORD.findall(text)
    return text, found


def script_of(word: str) -> int:
    """Script of a word, by its first letter."""
    point = ord(word[0])
    return next((s for a, b, s in SCRIPTS if a <= point <= b), 0)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the 1- to 4-grams of all words, framed by `<` and `>`, and the word each belongs to."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, owners = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        rolling = (rolling[: len(points) - n + 1] * np.uint64(0x100000001B3)) ^ points[n - 1 :]
        whole = owner[: len(rolling)] == owner[n - 1 :]
        mixed = (rolling[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(rolling)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 6000) -> DataFrame:
    """Counts (lang, kind, item, n) of a language model; kind 'gram' by bucket, 'script' by script number.

    `most` bounds the sample of labelled rows that is read, per fit and not per language; rows are drawn by
    a hash of id and text.
    """
    ship(docs.sparkSession)
    labelled = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sample = bounded_sample(labelled, ["id", "text", "lang"], most).select("text", "lang").repartition(PARTS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, rows in batch.groupby("lang"):
                held = grams.setdefault(name, np.zeros(BUCKETS + SCRIPT_COUNT, np.int64))
                words: dict[str, int] = {}
                for row in rows["text"]:
                    for word in words_of(row.lower())[1]:
                        words[word] = words.get(word, 0) + 1
                if not words:
                    continue
                times = np.array(list(words.values()))
                for word, n in words.items():
                    held[BUCKETS + script_of(word)] += n * len(word)
                at, owner = gram_buckets(list(words))
                np.add.at(held, at, times[owner])
        for name, held in grams.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"lang": name, "item": at, "n": held[at]})

    counts = sample.mapInPandas(count, "lang string, item bigint, n bigint")
    return counts.groupBy("lang", "item").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities by bucket and language, and the scripts each language is written in."""

    def __init__(self, counts: pd.DataFrame, script_share: float = 0.01) -> None:
        self.langs = sorted(counts["lang"].unique())
        table = np.zeros((BUCKETS + SCRIPT_COUNT, len(self.langs)))
        table[counts["item"].to_numpy(np.int64), np.searchsorted(self.langs, counts["lang"])] = counts["n"]
        grams, scripts = table[:BUCKETS], table[BUCKETS:]
        self.scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
        fits = scripts > script_share * scripts.sum(0)
        fits[~fits.any(1)] = True  # a script nobody learned: all stay candidates
        self.fits = fits


def tag(docs: DataFrame, model: DataFrame, text: str = "text", switch: float = 12.0) -> DataFrame:
    """`docs` with lang_pred string, score double and spans (code points, end exclusive).

    `model` is the result of `train`, whose size is bounded by languages times buckets.
    `switch` is the cost of a change of language, in units of log-probability of a word.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Model(model.toPandas()))

    def label(batches: Iterator[list]) -> Iterator[dict]:
        known, found = held.value, {}
        for texts in batches:
            yield _label_batch(texts, known, found, switch)

    own = free_name(docs.columns, "read")  # the text itself stays
    return annotated(docs.withColumn(own, F.col(f"`{text}`")), own, f"lang_pred string, score double, spans {SPANS}", label, [own])


def _label_batch(texts: list[str | None], model: Model, found: dict[str, np.ndarray], switch: float) -> dict:
    """Label a batch.  Documents of like length are taken together, so many words at a time that memory stays bounded."""
    texts = [t or "" for t in texts]
    out: list[tuple] = [(UNKNOWN, 0.0, [])] * len(texts)
    step: list[int] = []
    words: list[list[str]] = []
    held = 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        texts[i], own = words_of(texts[i]) if model.langs else ("", [])
        if own:
            step.append(i), words.append(own)
            held += len(own)
        if held >= STEP_WORDS:
            _label_step(step, words, texts, model, found, switch, out)
            step, words, held = [], [], 0
    _label_step(step, words, texts, model, found, switch, out)
    names, scores, spans = zip(*out, strict=True) if out else ((), (), ())
    return {"lang_pred": list(names), "score": list(scores), "spans": list(spans)}


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """A row of scores for each word; languages not written in its script fall far below the others."""
    lower = [w.lower() for w in words]
    at, owner = gram_buckets(lower)
    grams = np.bincount(owner, minlength=len(words))
    out = np.stack([np.bincount(owner, col[at], len(words)) / grams for col in model.scores.T], 1)
    out *= np.minimum([len(w) for w in words], 12)[:, None]
    fits = model.fits[[script_of(w) for w in lower]]
    return np.where(fits, out, out.min(1, keepdims=True) - 50).astype(np.float32)


def _label_step(
    step: list[int], docs: list[list[str]], texts: list[str], model: Model, found: dict, switch: float, out: list[tuple]
) -> None:
    if len(found) > CACHE:
        found.clear()
    if new := list({w for words in docs for w in words if w not in found}):
        for at in range(0, len(new), AT_ONCE):
            found.update(zip(new[at : at + AT_ONCE], word_scores(new[at : at + AT_ONCE], model), strict=True))
    paths = viterbi([np.array([found[w] for w in words]) for words in docs], switch)
    for i, words, path in zip(step, docs, paths, strict=True):
        letters = np.bincount(path, [len(w) for w in words], len(model.langs))
        best = int(letters.argmax())
        cut = np.flatnonzero(np.diff(path, prepend=-1))
        if len(cut) == 1:  # one span: from the first word to the end of the last
            at = [(WORD.search(texts[i]).start(), texts[i].rfind(words[-1]) + len(words[-1]))]
        else:
            places = [m.span() for m in WORD.finditer(texts[i])]
            at = [(places[a][0], places[b - 1][1]) for a, b in zip(cut, np.append(cut[1:], len(path)), strict=True)]
        spans = [{"start": a, "end": b, "lang": model.langs[path[c]]} for (a, b), c in zip(at, cut, strict=True)]
        out[i] = model.langs[best], float(letters[best] / letters.sum()), spans


def viterbi(docs: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best label of each word, for all documents at once: one step handles the n-th word of each."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lengths = np.array([len(docs[i]) for i in order], int)
    paths: list[np.ndarray] = [np.zeros(len(d), np.int64) for d in docs]
    if not len(lengths) or not lengths[0]:
        return paths
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")  # documents with an n-th word
    first = np.concatenate([[0], np.cumsum(live)])
    flat = np.empty((first[-1], next(d.shape[1] for d in docs if len(d))), np.float32)
    for rank, i in enumerate(order):
        if len(docs[i]):
            flat[first[: len(docs[i])] + rank] = docs[i]
    back = np.empty(flat.shape, np.int8 if flat.shape[1] < 127 else np.int32)
    own = np.arange(flat.shape[1])
    total = flat[: first[1]].astype(float)
    ends = np.empty((len(lengths), flat.shape[1]))
    ends[: len(total)] = total
    for n in range(1, lengths[0]):
        total = total[: live[n]]
        best = total.argmax(1)
        change = total[np.arange(len(total)), best][:, None] - switch
        moved = total < change
        back[first[n] : first[n + 1]] = np.where(moved, best[:, None], own)
        total = np.where(moved, change, total) + flat[first[n] : first[n + 1]]
        ends[: len(total)] = total
    state = ends.argmax(1)
    for n in range(lengths[0] - 1, -1, -1):
        at = first[n] + np.arange(live[n])
        flat[at, 0] = state[: live[n]]  # the scores are no longer needed: keep the label there
        if n:
            state[: live[n]] = back[at, state[: live[n]]]
    for rank, i in enumerate(order):
        paths[i] = flat[first[: len(docs[i])] + rank, 0].astype(np.int64)
    return paths


def op1_language(docs: DataFrame, key: str = "doc_id", held: Column | None = None) -> DataFrame:
    """Fit on the rows that are not held out and label all rows: the key, held_out, lang_pred, score, spans."""
    rows = docs.select(F.col(key), "text", "lang", held.alias("held_out"))
    fitted = train(rows.filter(~F.col("held_out")), key)
    return tag(rows.select(key, "text", "held_out"), fitted).drop("text")
