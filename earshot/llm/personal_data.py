"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Native expressions only.  A text is split at a pattern and its matches are extracted, so that running
sums of lengths give each match's place in code points.  Base kinds (email, ip, card, phone) are kept
when their checks hold: parts of an address up to 255, card numbers by Luhn's rule, digits of a phone
number.  The method adds bank account numbers (checked by remainder 97) and national numbers, which need
support from a word nearby.  Every span gets a score: the kind's own, raised or lowered by words within
`NEAR` code points; added spans below `LEAST` are dropped, base spans never are.

Patterns are possessive, so that a run that cannot match is not tried again from each of its places.

Defined results: null and empty texts have no spans (counts 0, the digest of the empty text).  Spans of
different kinds may overlap; those of one kind never do.  Ties in the start go by the order of kinds.
Repeated rows are read one by one, texts are read whole, other columns stay as they are; an own column
named like `out` gives way to the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import free_name

# fixed values: characters of a bank account number without blanks, by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    """A number is as long as its country says, so that a word after it is no part of it; other countries go by the longest run."""
    by: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by.setdefault(length, []).append(country)
    known = "|".join(rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, names in sorted(by.items()))
    other = rf"(?!{'|'.join(IBAN_LENGTHS)})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})(?![A-Za-z0-9])"


# fixed values: the patterns of the base kinds, in possessive form
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Whether a text can hold the kind at all: a cheap test before the pattern.
MARKS = {"email": "@", "ip": ".", "phone": "+", "national": "-"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "national": 0.4}
#: Words that make a kind likelier, and words that make it less likely.
FOR = {
    "email": "e-?mail|contact|write to|reach", "ip": "\\bip\\b|host|server|login|address", "card": "card|visa|master|credit|payment",
    "phone": "phone|\\btel\\b|call|mobile|fax|contact", "iban": "iban|account|bank|transfer", "national": "\\bssn\\b|social security|national|tax id",
}
AGAINST = {
    "email": "example|noreply", "ip": "version|release|section", "card": "isbn|order|tracking|serial", "phone": "order|invoice|serial",
    "iban": "serial|product", "national": "part|item|serial",
}
RAISE, LOWER, NEAR, LEAST = 0.3, 0.2, 40, 0.45
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def running(values: Column, block: int = 256) -> Column:
    """Running sums of an array, in two levels so that long arrays cost little more than their length."""

    def prefix(array: Column, start: Column) -> Column:
        return F.aggregate(
            array, F.struct(start.cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out")),
        )["out"]

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda i: F.slice(values, i * block + 1, block))
    ends = prefix(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.transform(parts, lambda p, i: prefix(p, F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1)))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's rule."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks leaves remainder 1: letters count 10 to 35, first four characters go last."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97),
    ) == 1


def holds(kind: str, match: Column) -> Column:
    """The check of a kind on a matched string."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.translate(match, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _spans(kind: str, hits: Column, gaps: Column) -> Column:
    """Confirmed spans of a kind from its matches and the text between them."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("bigint"))
    with_end = F.arrays_zip(hits.alias("hit"), running(lengths).alias("end"), F.slice(gaps, 1, F.size(hits)).alias("before"), F.slice(gaps, 2, F.size(hits)).alias("after"))
    good = F.filter(with_end, lambda m: holds(kind, m["hit"]))

    def span(m: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.right(m["before"], F.lit(NEAR)), F.left(m["after"], F.lit(NEAR))))
        score = SCORES[kind] + F.when(near.rlike(FOR[kind]), RAISE).otherwise(0.0) - F.when(near.rlike(AGAINST[kind]), LOWER).otherwise(0.0)
        return F.struct(
            (m["end"] - F.length(m["hit"])).cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].cast("int").alias("end"),
            F.lit(kind).alias("kind"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"),
        )

    found = F.transform(good, span)
    return found if kind in BASE else F.filter(found, lambda x: x["score"] >= LEAST)


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """`docs` with `out`: all spans (start, rank, end, kind, score) in order."""
    taken, held = list(docs.columns), {}
    body = F.coalesce(F.col(text), F.lit(""))
    hits = {}
    for kind, pattern in PATTERNS.items():
        hits[kind] = free_name(taken, f"{kind}_hits")
        possible = body.contains(MARKS[kind]) if kind in MARKS else F.lit(True)
        held[hits[kind]] = F.when(possible, F.regexp_extract_all(body, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumns(held)
    none = F.array().cast(SPAN)
    spans = [
        F.when(F.size(hits[kind]) > 0, _spans(kind, F.col(hits[kind]), F.split(body, pattern, -1)).cast(SPAN)).otherwise(none)
        for kind, pattern in PATTERNS.items()
    ]
    return rows.withColumn(out, F.array_sort(F.concat(*spans))).drop(*hits.values())


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in angle brackets; spans that overlap become one."""
    united = F.aggregate(
        spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(-1)) > s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(
                    F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"),
                    F.get(acc, F.size(acc) - 1)["kind"].alias("kind"),
                )),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
    )

    def replaced(u: Column) -> Column:
        pieces = F.transform(
            u,
            lambda s, i: F.concat(
                F.substr(text, F.when(i == 0, 0).otherwise(F.get(u, i - 1)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get(u, i - 1)["end"])),
                F.lit("<"), F.upper(s["kind"]), F.lit(">"),
            ),
        )
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(u, -1)["end"] + 1))

    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(united), replaced), 1)).otherwise(text)
