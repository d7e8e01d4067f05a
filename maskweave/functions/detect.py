"""Spans of identifiers in text: where each one starts and ends, in characters, and what it is.

A null span array means "not examined", an empty one means "examined and clean". The difference is
kept everywhere, because unexamined text is masked whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.batches import answered
from maskweave.functions.tokens import REDACTED

SPAN_TYPE = "struct<start: int, end: int, type: string, score: double>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
SPANS_DATATYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("type", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
SPANS_IN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64())]))

# Word boundaries over ASCII only, so that all regular expression engines agree.
_BEFORE, _AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Entity:
    """One kind of identifier.

    ``word`` entities stand alone, ``valid`` checks a matched text, and ``hint`` is a short string
    without which a text cannot hold a match: searching for it first is far cheaper. ``starts`` is the class of characters
    that a match can start with: seeing that first saves an engine the rest at nearly all places of a text.
    """

    name: str
    pattern: str
    word: bool = True
    valid: Callable[[Column], Column] | None = None
    score: float = 1.0
    hint: str = ""
    starts: str = ""
    #: The same matches for Java's and for Python's engine, where these need it said otherwise to stay linear. In
    #: Python's, the first group is a match.
    in_java: str = ""
    in_python: str = ""

    def matches(self, text: str) -> list[tuple[int, int]]:
        """Places of all matches in one text."""
        if self.in_python:
            return [m.span(1) for m in re.finditer(self.in_python, text) if m.group(1)]
        return [m.span() for m in re.finditer(self.java, text)]

    def found_in(self, text: Column) -> Column:
        hit = text.rlike(self.java)
        return text.contains(self.hint) & hit if self.hint else hit

    @property
    def java(self) -> str:
        if self.in_java:
            return self.in_java
        first = f"(?={self.starts})" if self.starts else ""
        return first + (f"{_BEFORE}(?:{self.pattern}){_AFTER}" if self.word else self.pattern)

    @property
    def sql(self) -> str:
        """The same pattern for engines without look-around."""
        return rf"\b(?:{self.pattern})\b" if self.word else self.pattern


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(text: Column) -> Column:
    """Luhn checksum of the digits in a text."""
    return once(F.regexp_replace(text, "[^0-9]", ""), _luhn_digits)


def _luhn_digits(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i))
    return (n > 0) & (total % 10 == 0)


def iban_valid(text: Column) -> Column:
    """ISO 13616 check: country code and check digits to the end, letters as numbers, modulo 97 is 1."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + (code - 55)) % 97).otherwise((acc * 10 + (code - 48)) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch))) == 1


_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", r"@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"

# No group is repeated, since Java's engine goes one call deeper for each repeat and a long name would end the JVM. A
# match starts only where a run of local characters does, or where the last match ended, so that a run is read once.
EMAIL = Entity(
    "email_address",
    f"{_LOCAL}+{_DOMAIN}",
    word=False,
    hint="@",
    in_java=rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++{_DOMAIN}",
    in_python=f"({_LOCAL}++{_DOMAIN})|{_LOCAL}++",
)
PHONE = Entity("phone_number", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", word=False, starts="[+(0-9]")
SSN = Entity("us_ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", starts="[0-9]")
CARD = Entity("credit_card", r"[0-9](?:[ -]?[0-9]){12,18}", valid=luhn, starts="[0-9]")
IP = Entity("ip_address", rf"(?:{_OCTET}\.){{3}}{_OCTET}", starts="[0-9]")
IBAN = Entity("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", valid=iban_valid, starts="[A-Z]")

ENTITIES = (EMAIL, PHONE, SSN, CARD, IP, IBAN)

# The same forms with no check and no word boundary. Every text that is an identifier of ENTITIES overlaps a match of these
# wherever it stands: after another number, inside a longer one, next to an underscore, an account number in small letters.
STRICT = (EMAIL, PHONE, *(replace(e, word=False, valid=None) for e in (SSN, CARD, IP)), replace(IBAN, pattern=f"(?i:{IBAN.pattern})", word=False, valid=None, starts=""))

DETECTOR_NAME, DETECTOR_VERSION, DETECTOR_NETWORK = "maskweave-patterns", "1", "none"


def matched(text: Column, entity: Entity) -> Column:
    """All texts of one entity that pass its check, in order."""
    found = F.regexp_extract_all(text, F.lit(entity.java), F.lit(0))
    if entity.hint:
        found = F.when(~text.contains(entity.hint), F.array().cast("array<string>")).otherwise(found)
    return F.filter(found, entity.valid) if entity.valid else found


def values(text: Column, label: str) -> Column:
    """Matches of all entities as (label, value), entity by entity; null for a null text. Only an address can do without a
    digit, and most texts have none, so that one look for a digit stands before the other searches."""

    def found(entities: tuple[Entity, ...]) -> Column:
        return F.flatten(F.array(*(named(e) for e in entities)))

    def named(e: Entity) -> Column:
        return F.transform(matched(text, e), lambda m: F.struct(F.lit(e.name).alias(label), m.alias("value")))

    return F.when(text.rlike("[0-9]"), found(ENTITIES)).otherwise(found((EMAIL,)))


def entity_spans(text: Column, entity: Entity) -> Column:
    """Spans of one entity.

    The matches and the gaps between them come from the same expression, so adding up their lengths
    gives each position. Texts without a match, nearly all of them, pay for one search only.
    """
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(entity.java), F.lit(0)).alias("m"),
        F.split(text, entity.java).alias("gap"),
    )
    empty = F.array().cast(SPANS_TYPE)
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.coalesce(F.length(p["m"]), F.lit(0))
        span = F.struct(
            begin.cast("int").alias("start"), end.cast("int").alias("end"),
            F.lit(entity.name).alias("type"), F.lit(entity.score).alias("score"),
        )
        keep = p["m"].isNotNull()
        if entity.valid:
            keep = keep & entity.valid(p["m"])
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(entity.found_in(text), spans).otherwise(F.when(text.isNotNull(), empty))


def all_spans(text: Column, entities: tuple[Entity, ...] = ENTITIES) -> Column:
    """Spans of all entities in a text, overlapping ones too; null for a null text."""
    return F.flatten(F.array(*(entity_spans(text, e) for e in entities)))


def spans(text: Column, entities: tuple[Entity, ...] = ENTITIES) -> Column:
    """Merged spans of all entities in a text; null for a null text. For what a text holds, see :func:`all_spans`."""
    return once(all_spans(text, entities), merge_spans)


def strict_spans(text: Column) -> Column:
    """Merged spans of everything that has the form of an identifier: a detector for masks where a missed one costs more than
    one too many. :func:`spans` leaves a card number in clear that follows another number, as they fail the check as one."""
    return spans(text, STRICT)


def merge_spans(found: Column) -> Column:
    """Overlapping spans become one; the earliest start keeps its label; touching spans stay apart."""
    empty = F.array().cast(SPANS_TYPE)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
            last["type"].alias("type"), last["score"].alias("score"),
        )
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        overlaps = (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(overlaps, F.array_append(head, grown)).otherwise(F.array_append(acc, s))

    return F.when(F.size(found) < 2, found).otherwise(F.aggregate(F.array_sort(found), empty, step))


def span_marker(kind: Column) -> Column:
    return F.when(kind == "", F.lit(REDACTED)).otherwise(F.concat(F.lit("⟨redacted:"), kind, F.lit("⟩")))


def redact_spans(text: Column, found: Column) -> Column:
    """Text with each span replaced by its marker.

    Text that nobody examined, and text with a span that does not fit it, is masked whole.
    """
    return once(found, lambda f: _replace_spans(text, f))


def _replace_spans(text: Column, found: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(False).alias("bad"))

    def step(acc: Column, s: Column) -> Column:
        bad = acc["bad"] | (s["start"] < acc["at"]) | (s["end"] > F.length(text)) | (s["end"] <= s["start"])
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], gap, span_marker(s["type"])).alias("out"),
            F.coalesce(bad, F.lit(True)).alias("bad"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["bad"], F.lit(REDACTED)).otherwise(F.concat(acc["out"], F.substr(text, acc["at"] + 1)))

    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(text == "", text)
        .when(found.isNull(), F.lit(REDACTED))
        .when(F.size(found) == 0, text)
        .otherwise(F.aggregate(F.array_sort(found), start, step, finish))
    )


def spans_unusable(text: Column, found: Column) -> Column:
    """Whether :func:`redact_spans` had to mask the whole text."""
    return text.isNotNull() & (text != "") & (found.isNull() | ((F.size(found) > 0) & (redact_spans(text, found) == REDACTED)))


def kinds(found: Column) -> Column:
    """Kinds of identifier found, sorted, each once."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: s["type"])))


def replace_entity(text: Column, entity: Entity) -> Column:
    """Marker for every match of one unchecked entity in a single replacement, inside generated code."""
    if entity.valid:
        raise ValueError(f"{entity.name} needs its check: use redact_spans")
    return F.regexp_replace(text, entity.java, f"⟨redacted:{entity.name}⟩")


def custom_detector(find: Callable[[str], list[tuple[int, int, str, float]] | None]) -> Callable[[Column], Column]:
    """A column function from a user's own recogniser of one text.

    It runs in Arrow batches and examines a text that repeats inside a batch once. A text for which it
    returns None, or raises, counts as not examined.
    """

    def one(text):
        try:
            return find(text)
        except Exception:  # noqa: BLE001 - a failing recogniser must mask, never pass
            return None

    def answer(text):
        got = None if text is None else one(text)
        return None if got is None else [dict(zip(("start", "end", "type", "score"), s)) for s in got]

    @F.arrow_udf(SPANS_DATATYPE)
    def examine(texts: pa.Array) -> pa.Array:
        return answered(texts, answer, SPANS_IN_ARROW)

    examine.one = one
    return examine


def redact_found(text: str, found: list[tuple[int, int, str, float]] | None) -> str:
    """:func:`redact_spans` of one text, for a user's own recogniser of leaves inside an Arrow batch."""
    if not text or found is None:
        return text and REDACTED
    out, at = [], 0
    for start, end, kind, _ in sorted(found):
        if start < at or end > len(text) or end <= start:
            return REDACTED
        out += [text[at:start], f"⟨redacted:{kind}⟩" if kind else REDACTED]
        at = end
    return "".join(out) + text[at:]


def _luhn_text(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return bool(digits) and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _iban_text(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


_TEXT_CHECKS = {luhn: _luhn_text, iban_valid: _iban_text}


def redact_text(text: str, entities: tuple[Entity, ...] = ENTITIES) -> str:
    """:func:`redact_spans` of one text, for leaves met inside an Arrow batch."""
    found = []
    for e in entities:
        check = _TEXT_CHECKS.get(e.valid, lambda _: True)
        found += [(start, end, e.name) for start, end in e.matches(text) if check(text[start:end])]
    merged: list[list] = []
    for start, end, kind in sorted(found):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out += [text[at:start], f"⟨redacted:{kind}⟩"]
        at = end
    return "".join(out) + text[at:]


def detection_reach(setting: str | None) -> str:
    """``off``, ``scan`` or ``all``; anything else, and nothing, is ``scan``."""
    return setting if setting in ("off", "scan", "all") else "scan"


def examines(policy: str, family_is_text: bool, setting: str | None) -> bool:
    """Whether a column's text goes through the detector at all."""
    reach = detection_reach(setting)
    return policy == "scan" or (policy == "allow" and reach == "all" and family_is_text)

