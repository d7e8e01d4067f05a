"""Text as a person reads it: hidden characters, mixed scripts, short ages, pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bidirectional controls, by code point.
BIDI = (0x061C, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)

LINE_CAP = 72

LATIN, CYRILLIC, GREEK = "[a-zA-Z]", "[Ѐ-ӿ]", "[Ͱ-Ͽ]"


def hidden_class() -> str:
    """Character class of everything that is shown as its code point: controls but not newline and tab."""
    return "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F" + "".join(f"\\u{c:04X}" for c in BIDI) + "]"


def show_hidden(text: Column) -> Column:
    """Hidden characters as ``[U+202E]``. Text without any, nearly all of it, costs one search."""
    pattern = hidden_class()
    # Each hidden character becomes its own piece of the split, wherever it stands.
    pieces = F.split(text, f"(?={pattern})|(?<={pattern})")

    def shown(piece: Column) -> Column:
        code = F.lpad(F.hex(F.conv(F.hex(F.encode(piece, "UTF-16BE")), 16, 10).cast("long")), 4, "0")
        return F.when(piece.rlike(f"^{pattern}$"), F.concat(F.lit("[U+"), code, F.lit("]"))).otherwise(piece)

    return F.when(text.rlike(pattern), F.array_join(F.transform(pieces, shown), "")).otherwise(text)


def mixed_script(identifier: Column) -> Column:
    """Whether a name mixes Latin, Cyrillic and Greek letters."""
    scripts = sum((identifier.rlike(s).cast("int") for s in (LATIN, CYRILLIC, GREEK)), F.lit(0))
    return scripts > 1


def cap_line(text: Column, cap: int = LINE_CAP) -> Column:
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap - 1), F.lit("…"))).otherwise(text)


def short_duration(milliseconds: Column) -> Column:
    """40s, 12m, 3h, 2d; never below zero. Halves round up."""
    s = F.greatest(F.lit(0), F.floor(milliseconds / 1000 + F.lit(0.5))).cast("long")

    def unit(size: int, letter: str) -> Column:
        return F.concat(F.floor(s / size + F.lit(0.5)).cast("long").cast("string"), F.lit(letter))

    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, unit(60, "m"))
        .when(s < 86400, unit(3600, "h"))
        .otherwise(unit(86400, "d"))
    )


def age(moment: Column, now: Column) -> Column:
    """Short time since a moment; a dash where there is none."""
    return F.coalesce(short_duration(F.unix_millis(now) - F.unix_millis(moment)), F.lit("—"))


def until(moment: Column, now: Column) -> Column:
    return F.coalesce(short_duration(F.unix_millis(moment) - F.unix_millis(now)), F.lit("—"))


def page_count(total: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def range_text(page: Column, size: Column, total: Column) -> Column:
    """``51–100 of 312``; an empty list is ``0 of 0``."""
    first = ((page - 1) * size + 1).cast("long").cast("string")
    last = F.least(total, page * size).cast("long").cast("string")
    return F.when(total == 0, F.lit("0 of 0")).otherwise(
        F.concat(first, F.lit("–"), last, F.lit(" of "), total.cast("string"))
    )


def value_text(value: Column, dtype: str) -> Column:
    """A value for a reader: NULL, bytes as hex, times in RFC 3339."""
    if dtype == "binary":
        shown = F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    elif dtype in ("timestamp", "timestamp_ntz"):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.regexp_replace(F.date_format(value, ".SSSSSS"), "\\.?0+$", "")
        shown = F.concat(whole, fraction, F.lit("Z"))
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("NULL"))


def unique_names(names: list[str]) -> list[str]:
    """Output names: an empty one becomes ``column_N``, a repeated one gets ``_2``, ``_3``."""
    used: set[str] = set()
    out = []
    for i, name in enumerate(names, start=1):
        base = name or f"column_{i}"
        candidate, n = base, 2
        while candidate in used:
            candidate, n = f"{base}_{n}", n + 1
        used.add(candidate)
        out.append(candidate)
    return out
