"""Keyword rules as column expressions.

A text is read once: ``KeywordIndex.hits`` returns the array of all known
keywords it contains (plain substrings, not words).  Every layer then asks that
small array instead of reading the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earshot.functions.text import col, let, mapped, quoted, words

# Above this many keywords one pass with a prefix-tree pattern is faster than a
# substring search per keyword (see bench notes in the README).
SCAN_FROM = 60
FAN_OUT = 5
# Letters are told apart by these groups and the rest before a position is looked up in the tree.
LETTER_GROUPS = ("aeiou", "tnsrhl")


def _pattern(words: list[str]) -> str:
    """Prefix-tree pattern matching the longest of ``words`` at a position.

    A node with many children is split into ranges guarded by a character-class
    look-ahead, so that a position is rejected after a few tests.
    """
    ends = "" in words
    branches: dict[str, list[str]] = {}
    for w in words:
        if w:
            branches.setdefault(w[0], []).append(w[1:])
    parts = [(c, re.escape(c) + _pattern(rest)) for c, rest in sorted(branches.items())]
    if not parts:
        return ""
    body = _split(parts)
    if len(parts) == 1 and not ends:
        return body
    return f"(?:{body})?" if ends else f"(?:{body})"


def _split(parts: list[tuple[str, str]]) -> str:
    if len(parts) <= FAN_OUT:
        return "|".join(p for _, p in parts)
    size = -(-len(parts) // FAN_OUT)
    groups = [parts[i:i + size] for i in range(0, len(parts), size)]
    return "|".join(f"(?=[{re.escape(g[0][0])}-{re.escape(g[-1][0])}])(?:{_split(g)})" for g in groups)


def _class(chars: Iterable[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


def _likely(words: list[str]) -> str:
    """Pattern of all places where a keyword may start, by its first three characters.

    Characters are only told apart by group, so most places of a text are rejected after
    a few tests of small character classes; the tree asks far more of them.
    """
    def group(c: str) -> int:
        return next((i for i, g in enumerate(LETTER_GROUPS) if c in g), len(LETTER_GROUPS))

    narrow = [w for w in words if ord(w[0]) < 256]
    groups: dict[int, dict[int, list[str]]] = {}
    for w in narrow:
        if len(w) > 2:
            groups.setdefault(group(w[0]), {}).setdefault(group(w[1]), []).append(w)
    parts = []
    for _, by_second in sorted(groups.items(), reverse=True):
        rest = [_class({w[1] for w in ws}) + _class({w[2] for w in ws}) for _, ws in sorted(by_second.items())]
        parts.append(_class({w[0] for ws in by_second.values() for w in ws}) + f"(?:{'|'.join(rest)})")
    parts += [re.escape(w) for w in narrow if len(w) < 3]
    wide = sorted(w[0] for w in words if ord(w[0]) >= 256)
    return "|".join(parts + ([f"[{wide[0]}-{wide[-1]}]"] if wide else []))


def scan_pattern(words: list[str]) -> str:
    """Pattern that captures the longest keyword at each place; matches may overlap."""
    sides = [[w for w in words if (ord(w[0]) >= 256) == wide] for wide in (False, True)]
    trees = "|".join(f"(?:{_pattern(side)})" for side in sides if side)
    return f"(?={_likely(words)})(?=({trees}))"


class KeywordIndex:
    """A set of keywords that are looked up together."""

    def __init__(self, keywords: Iterable[str]):
        self.keywords = sorted(set(keywords) - {""})
        self.longest = max(map(len, self.keywords), default=0)
        known = set(self.keywords)
        self.inner = {
            w: [w[:i] for i in range(1, len(w)) if w[:i] in known]
            for w in self.keywords
            if any(w[:i] in known for i in range(1, len(w)))
        }

    def hits(self, text) -> Column:
        """``array<string>`` of the distinct keywords contained in ``text``."""
        text = col(text)
        if len(self.keywords) < SCAN_FROM:
            return self.hits_by_search(text)
        return self.hits_by_scan(text)

    def hits_by_search(self, text: Column) -> Column:
        return F.filter(words(*self.keywords), lambda k: F.contains(text, k))

    def hits_by_scan(self, text: Column) -> Column:
        # the look-ahead lets matches overlap; at one position only the longest
        # keyword is found, its prefixes that are keywords are added afterwards
        found = F.array_distinct(
            F.regexp_extract_all(text, F.lit(scan_pattern(self.keywords)), F.lit(1))
        )
        if not self.inner:
            return found
        pairs = ", ".join(f"{quoted(w)}, array({', '.join(map(quoted, ps))})" for w, ps in self.inner.items())

        def with_prefixes(hits):
            longer = F.array_intersect(hits, words(*self.inner))
            extra = F.flatten(F.transform(longer, lambda w: F.element_at(F.expr(f"map({pairs})"), w)))
            return F.when(F.arrays_overlap(hits, words(*self.inner)), F.array_union(hits, extra)).otherwise(hits)

        return let(found, with_prefixes)  # the scan itself runs once


def contains_any(text, keywords: Iterable[str]) -> Column:
    """Substring test of a few keywords on one text."""
    text = col(text)
    return F.exists(words(*keywords), lambda k: F.contains(text, k))


def hit(hits: Column, *lists: Iterable[str]) -> Column:
    """Whether any keyword of the lists was found."""
    return F.arrays_overlap(hits, words(*[k for ks in lists for k in ks]))


def hit_count(hits: Column, keywords: Iterable[str]) -> Column:
    return F.size(F.array_intersect(hits, words(*keywords)))


def first_label(hits: Column, rules, default=None) -> Column:
    """Label of the first rule with a keyword among the hits.

    Each keyword has the number of the first rule that names it and the smallest number
    decides, so the hits are read once whatever the number of rules.
    """
    fallback = default if isinstance(default, Column) else F.lit(default)
    number: dict[str, int] = {}
    for i, (_, keywords) in enumerate(rules):
        for k in keywords:
            number.setdefault(k, i)
    if not number:
        return fallback
    labels = F.expr("array(" + ", ".join(quoted(label) for label, _ in rules) + ")")
    return F.coalesce(F.get(labels, F.array_min(F.transform(hits, lambda k: mapped(k, number)))), fallback)


def keywords_of(*rule_lists) -> set[str]:
    """All keywords of ordered rules ``(label, keywords)``."""
    return {k for rules in rule_lists for _, ks in rules for k in ks}


def rules_table(spark: SparkSession, layer: str, rules) -> DataFrame:
    """Ordered rules as rows, for review or for joining in SQL."""
    rows = [(layer, i, label, k) for i, (label, ks) in enumerate(rules) for k in ks]
    return spark.createDataFrame(rows, "layer string, priority int, label string, keyword string")
