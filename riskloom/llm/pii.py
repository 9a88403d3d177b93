"""Personal data in whole texts (operator 10), with DataFrame functions only.

Method: a regular expression per kind proposes spans, a validator confirms
them (Luhn for cards, mod-97 for IBANs, value and digit counts for addresses
and phones), and words in front of a span adjust its score.  Spans of the
four base kinds count whenever their validator confirms them, whatever the
score; the other kinds need ``KEEP_FROM``.

Positions come from splitting the text at the matches: the lengths of the
parts and of the matches add up to each start, in code points, in one pass
per row.  Nothing is shuffled, so a hot source or a group of copies costs
what its rows cost.

The patterns are the base ones made safe for long texts: where the original
could start anywhere inside a run of its first characters, ours starts at the
run's head or behind the previous match (``\\G``), which is where the leftmost
match starts anyway; repeated groups are possessive, since nothing after them
can use what they give back.  So no text makes the matcher quadratic or
overflow its stack, and the matches are the same.

Defined results: a null text is the empty text and has no spans; repeated rows
are judged each on their own; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Kinds in the order of the output, their patterns, and how spans of a kind begin to score.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
START_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|address|kontakt|correo|courriel",
    "ip": "ip|address|server|host|login|adresse",
    "card": "card|visa|mastercard|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|llame|appelez",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security|taxpayer|tax id",
}
CONTEXT_CHARS, CONTEXT_BONUS, KEEP_FROM = 48, 0.2, 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def mod_97(match: Column) -> Column:
    """Whether an IBAN's digits, letters as 10 to 35 and the first four behind, leave 1 modulo 97."""
    s = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.length(s).between(15, 34) & (
        F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1)


def iban_in(match: Column) -> Column:
    """The longest run of a match's first groups that passes mod-97 (null if none does): capitals or
    digits that follow an IBAN are no part of it."""
    groups = F.split(match, " ")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    return F.try_element_at(F.filter(runs, mod_97), F.lit(1))


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind, on the matched text."""
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind: array<struct<start, end, match>> in code points, end exclusive."""
    p = PATTERNS[kind]
    at = "array<struct<start:int,end:int,match:string>>"
    empty = F.array().cast(at)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["part"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["found"].alias("match")))).alias("out"))

    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    pairs = F.arrays_zip(F.split(text, p, -1).alias("part"), found.alias("found"))
    spans = F.aggregate(F.slice(pairs, F.lit(1), F.size(found)),
                        F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)["out"]
    has = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(has, spans).otherwise(empty)


def _spans_of_kind(text: Column, kind: str) -> Column:
    def scored(x: Column) -> Column:
        a = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, a + 1, x["start"] - a))
        bonus = F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"),
                        (F.lit(START_SCORE[kind]) + bonus).alias("score"))

    def cut(x: Column) -> Column:
        inner = iban_in(x["match"])
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(inner)).alias("end"), inner.alias("match"))

    proposed = _matches(text, kind)
    if kind == "iban":
        proposed = F.filter(F.transform(proposed, cut), lambda x: x["match"].isNotNull())
    else:
        proposed = F.filter(proposed, lambda x: confirmed(kind, x["match"]))
    found = F.transform(proposed, scored)
    return found if kind in BASE else F.filter(found, lambda x: x["score"] >= KEEP_FROM)


def spans_of(text: Column) -> Column:
    """array<struct<start, kind, end, score>> by start, then kind (its place in ``KINDS``)."""
    return F.array_sort(F.concat(*[_spans_of_kind(text, kind) for kind in KINDS]))


def find_pii(df: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """``df`` with ``to``: all its spans (see ``spans_of``)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.withColumn(to, spans_of(body))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def joined_scores(spans: Column) -> Column:
    """Scores of spans, with two decimals, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.format_number(x["score"], 2)), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of its text replaced by its kind, like ``[EMAIL]``.

    Spans that overlap become one mark, that of the first.  Texts without spans stay as they are
    (null stays null).
    """
    spans = fresh(df.columns, "spans")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        inside = x["start"] < acc["pos"]
        piece = F.concat(F.substring(body, acc["pos"] + 1, x["start"] - acc["pos"]),
                         F.element_at(marks, x["kind"] + 1))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"),
                        F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    done = F.aggregate(F.col(spans), F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
                       step, lambda acc: F.concat(F.array_join(acc["out"], ""),
                                                  F.substring(body, acc["pos"] + 1, F.length(body))))
    return (df.withColumn(spans, spans_of(body))
            .withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(f"`{text}`")))
            .drop(spans))
