"""URL filter: rules by host and path, then a ratio of two character language models.

Two smoothed variable-order Markov models are counted over all URLs that a rule accepts or rejects.  A
character's probability after its context of up to `ORDER` bytes is interpolated down to the shortest
context: (count + k * shorter) / (context count + k), so unseen contexts fall back by themselves.  The
score of a URL is the difference of log-likelihoods, accepted minus rejected, divided by its length.  The
threshold is calibrated on a fifth of the labelled URLs that is kept out of the counts: the score that
balances the two kinds of error.

Defined results: a null URL, or one without `://`, has empty host and path and fits no rule; its text (or
the empty text) is scored like any other.  Where rules give only one kind, or none, to learn from, the
method accepts.  Repeated rows are judged one by one.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import annotated, free_name, ship

ORDER = 4
#: Hash buckets of the counts of one model: the bound of its size.
BUCKETS = 1 << 18
PRIOR = 1.0
KEPT_OUT = 5
BINS, BIN = 400, 0.02


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str  # host/path

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # later ones win
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(urls: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of every n-gram ending at each byte, for n from 0 to ORDER + 1, and the URL of each byte.

    Each URL ends with a byte 0.  An n-gram never reaches back over the start of its URL.
    """
    raw = [u.encode("utf-8", "surrogatepass").replace(b"\0", b"\1") + b"\0" for u in urls]
    points = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    place = np.arange(len(points)) - np.repeat(np.cumsum([0] + [len(r) for r in raw])[:-1], [len(r) for r in raw])
    out = [np.zeros(len(points), np.int64)]
    rolling = np.zeros(len(points), np.uint64)
    for n in range(ORDER + 1):
        back = np.concatenate([np.full(n, 1, np.uint64), points[: len(points) - n]]) if n <= len(points) else np.ones(len(points), np.uint64)
        back = np.where(place >= n, back, np.uint64(1))  # places before the start count as byte 1
        rolling = (rolling + back + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rolling ^= rolling >> np.uint64(29)
        out.append(((rolling + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64) % (BUCKETS - 1) + 1)
    return out, owner


def log_likelihood(found: list[np.ndarray], model: np.ndarray) -> np.ndarray:
    """Log-probability of each byte.  found[n + 1] holds the byte with n bytes before it."""
    chance = np.full(len(found[0]), 1 / 256)
    for n in range(ORDER + 1):
        # the context of n bytes is the n-gram that ends one byte earlier
        context = np.concatenate([[0], found[n][:-1]]) if n else found[0]
        chance = (model[found[n + 1]] + PRIOR * chance) / (np.maximum(model[context], model[found[n + 1]]) + PRIOR)
    return np.log(chance)


def count(labelled: DataFrame) -> DataFrame:
    """Counts (accepted, bucket, n) over labelled (url, accepted)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bool, np.ndarray] = {}
        for batch in batches:
            for accepted, rows in batch.groupby("accepted"):
                held = total.setdefault(bool(accepted), np.zeros(BUCKETS, np.int64))
                for g in grams(list(rows["url"]))[0]:
                    held += np.bincount(g, minlength=BUCKETS)
        for accepted, held in total.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"accepted": accepted, "bucket": at, "n": held[at]})

    parts = labelled.mapInPandas(run, "accepted boolean, bucket int, n bigint")
    return parts.groupBy("accepted", "bucket").agg(F.sum("n").alias("n"))


def scores(urls: list[str], models: dict[bool, np.ndarray]) -> np.ndarray:
    if not urls:
        return np.zeros(0)
    found, owner = grams(urls)
    gain = log_likelihood(found, models[True]) - log_likelihood(found, models[False])
    return np.bincount(owner, gain, len(urls)) / np.bincount(owner, minlength=len(urls))


def judged(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, url_score, verdict, in place of own columns of these names."""
    spark = pages.sparkSession
    ship(spark)
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "url_score")]
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    labelled = rows.filter("verdict is not null").select(F.col(url).alias("url"), (F.col("verdict") == "allow").alias("accepted"))
    out = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(KEPT_OUT)) == 0
    counts = count(labelled.filter(~out)).toPandas()
    models = {side: np.zeros(BUCKETS) for side in (True, False)}
    for side, part in counts.groupby("accepted"):
        models[bool(side)][part["bucket"].to_numpy()] = part["n"]
    both = counts["accepted"].nunique() == 2
    held = spark.sparkContext.broadcast(models)

    def score(df: DataFrame, column: str) -> DataFrame:
        def run(batches: Iterator[list]) -> Iterator[dict]:
            for part in batches:
                yield {"url_score": scores([u or "" for u in part], held.value)}

        own = free_name(df.columns, "read")  # the url itself stays
        return annotated(df.withColumn(own, F.col(f"`{column}`")), own, "url_score double", run, [own])

    limit = _threshold(score(labelled.filter(out), "url")) if both else float("-inf")
    final = F.coalesce("verdict", F.when(F.col("url_score") >= limit, "allow").otherwise("block"))
    return score(rows, url).withColumn("verdict", final)


def _threshold(scored: DataFrame) -> float:
    """The bin edge with the least sum of both error rates, nearest to the middle of the best edges."""
    place = F.least(F.greatest(F.floor(F.col("url_score") / BIN), F.lit(-BINS)), F.lit(BINS)).alias("bin")
    rows = scored.groupBy(place, "accepted").count().collect()  # two rows a bin at most
    hist = np.zeros((2, 2 * BINS + 2))
    for r in rows:
        hist[int(r["accepted"]), int(r["bin"]) + BINS] += r["count"]
    if not hist.sum(1).all():
        return 0.0
    missed = np.concatenate([[0], np.cumsum(hist[1])]) / hist[1].sum()
    passed = 1 - np.concatenate([[0], np.cumsum(hist[0])]) / hist[0].sum()
    best = np.flatnonzero(missed + passed <= (missed + passed).min() + 1e-12)
    return float((best[len(best) // 2] - BINS) * BIN)
