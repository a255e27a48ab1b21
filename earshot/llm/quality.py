"""Quality classifier: supervised subword embeddings.

Each word gives hashed features: itself and its character 3- and 4-grams; each pair of neighbouring words
gives one more, from the difference of their hashes, so that all words said twice in a row share one.
A document is the average of its features' learned vectors; a linear layer and softmax give the probability of label 1.  Vectors and
layer are trained by stochastic gradient descent in numpy, one document at a time, in one task over a
bounded sample of labelled rows.  Since the layers are linear up to the softmax, a fitted model is one
number per feature: a document's score is the logistic function of the mean of its features' numbers.

Defined results: null and empty texts and texts of white space have no feature and score by the layer's
bias alone.  Rows with null labels teach nothing.  With no labelled row every score is 0.5.  Repeated
rows are scored one by one; texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import annotated, bounded_sample, free_name, ship, staged

BUCKETS = 1 << 17
FEATURES = 2 * BUCKETS
DIMENSIONS, EPOCHS, RATE = 8, 6, 0.6
CACHE = 150_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of all words, the word each belongs to, and a 64-bit hash of each word."""
    framed = [f"<{w}>" for w in words]
    lengths = np.array([len(w) for w in framed])
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    buckets, owners = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        rolling = (rolling[: len(points) - n + 1] * np.uint64(0x100000001B3)) ^ points[n - 1 :]
        if n > 2:
            whole = owner[: len(rolling)] == owner[n - 1 :]
            buckets.append((rolling[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15))
            owners.append(owner[: len(rolling)][whole])
    place = (np.arange(len(points)) - np.repeat(starts, lengths)).astype(np.uint64)
    spread = (points + np.uint64(7)) * (place * np.uint64(2654435761) + np.uint64(0xD6E8FEB86659FD93))
    hashes = np.add.reduceat(spread ^ (spread >> np.uint64(31)), starts) * np.uint64(0x9E3779B97F4A7C15)
    buckets.append(hashes)
    owners.append(np.arange(len(words)))
    return (np.concatenate(buckets) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(owners), hashes


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Feature buckets of neighbouring words, in a range of their own."""
    return (((hashes[1:] - hashes[:-1]) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % BUCKETS + BUCKETS


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and each one's share of all its features."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    places = {w: i for i, w in enumerate(dict.fromkeys(words))}
    order = np.array([places[w] for w in words])
    at, owner, hashes = word_features(list(places))
    count = np.bincount(at, np.bincount(order)[owner], FEATURES)
    count += np.bincount(pair_features(hashes[order]), minlength=FEATURES)
    used = np.flatnonzero(count)
    return used, (count[used] / count.sum()).astype(np.float32)


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 5) -> np.ndarray:
    """A number for each feature, and the bias as the last."""
    rng = np.random.default_rng(seed)
    docs = [document_features(t) for t in texts]
    vectors = ((rng.random((FEATURES, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    layer, bias = ((rng.random((2, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, share = docs[i]
            mean = share @ vectors[at]
            raw = layer @ mean + bias
            wrong = np.exp(raw - raw.max())
            wrong /= wrong.sum()
            wrong[int(labels[i])] -= 1
            back = wrong @ layer
            layer -= rate * np.outer(wrong, mean)
            bias -= rate * 0.1 * wrong
            # a feature is updated by its share times the number of features, as if each were averaged in turn
            vectors[at] -= (rate * len(at) ** 0.5) * share[:, None] * back
    toward = layer[1] - layer[0]
    return np.append(vectors @ toward, bias[1] - bias[0]).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = 4000, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """The rows (key, text, quality) that `train` draws from `docs` joined with `labels` on `key`.

    Texts are not shuffled: ids meet labels with the hashes their rows would have, the sample is drawn from
    these numbers, and only its rows are fetched from `docs`.
    """
    labels = labels.filter("quality in (0, 1)").select(key, "quality")
    kind = labels.schema["quality"].dataType
    if_0, if_1 = (F.xxhash64(F.lit(seed), key, "text", F.lit(q).cast(kind)) for q in (0, 1))
    draw = F.when(F.col("quality") == 0, F.col("_if_0")).otherwise(F.col("_if_1"))
    narrow = staged(docs.select(key, if_0.alias("_if_0"), if_1.alias("_if_1")).join(labels, key).select(key, "quality", draw.alias("_draw")), "draws")
    drawn = bounded_sample(narrow, [key, "quality"], most, value=F.col("_draw"))
    # rows alike in all columns are fetched once and repeated
    drawn = drawn.groupBy(key, "quality", "_draw").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    fetched = docs.select(key, "text", if_0.alias("_if_0"), if_1.alias("_if_1")).join(F.broadcast(drawn), key).filter(draw == F.col("_draw"))
    once = fetched.dropDuplicates([key, "quality", "_draw"])
    again = once.select(key, "text", "quality", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_again")).drop("_again")
    return staged(again, "labelled_sample")  # bounded by `most`, and read several times


def train(labelled: DataFrame, most: int = 4000, key: str = "doc_id") -> DataFrame:
    """One row `weights` (binary) fitted to (text, quality).

    `most` bounds the sample of labelled rows, drawn by a hash of id (if there is one) and text, so that copies
    of a text are drawn one by one.
    """
    ship(labelled.sparkSession)
    keys = [key, "text", "quality"] if key in labelled.columns else ["text", "quality"]
    sample = bounded_sample(labelled.filter("quality in (0, 1)").select(*keys), keys, most).select("text", "quality")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "quality": []}), *batches])
        rows = rows.sort_values(["text", "quality"])  # the same order whatever the partitions
        if len(rows):
            yield pd.DataFrame({"weights": [fit(list(rows["text"]), rows["quality"].to_numpy()).tobytes()]})

    return sample.repartition(1).mapInPandas(run, "weights binary")  # bounded by `most`


def scored(docs: DataFrame, model: DataFrame, text: str = "text", least: float = 0.7) -> DataFrame:
    """`docs` with score and predicted, in place of own columns of these names; `model` is the one row that `train` returns."""
    row = model.first()
    weights = np.frombuffer(row["weights"], np.float32) if row else np.zeros(FEATURES + 1, np.float32)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[list]) -> Iterator[dict]:
        found: dict[str, tuple[float, int, int]] = {}
        for texts in batches:
            value = np.array([_mean(t, held.value, found) for t in texts], float)
            score = 1 / (1 + np.exp(-(value + float(held.value[-1]))))
            yield {"score": score, "predicted": (score >= least).astype(np.int32)}

    own = free_name(docs.columns, "read")  # the text itself stays
    return annotated(docs.withColumn(own, F.col(f"`{text}`")), own, "score double, predicted int", run, [own])


def _mean(text: str | None, weights: np.ndarray, found: dict[str, tuple[float, int, int]]) -> float:
    words = (text or "").split()
    if not words:
        return 0.0
    if len(found) > CACHE:
        found.clear()
    if new := [w for w in set(words) if w not in found]:
        at, owner, hashes = word_features(new)
        sums, sizes = np.bincount(owner, weights[at], len(new)), np.bincount(owner, minlength=len(new))
        found.update(zip(new, zip(sums.tolist(), sizes.tolist(), hashes.tolist(), strict=True), strict=True))
    sums, sizes, hashes = zip(*(found[w] for w in words), strict=True)
    pairs = pair_features(np.array(hashes, np.uint64))
    return (sum(sums) + float(weights[pairs].sum())) / (sum(sizes) + len(pairs))
