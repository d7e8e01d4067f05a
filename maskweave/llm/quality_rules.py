"""Line-first cleaning: rules per line, lines that fail go, then documents that lost too much text.

Native column expressions only. The text is read in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import SPACES, split_words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of lines that belong to a site or a licence, not to a text.
BOILERPLATE = (
    "(?i)all rights reserved|privacy policy|terms of (use|service)|cookie policy|(uses?|accept) cookies|enable javascript|"
    "lorem ipsum|licensed under|work is licensed|subscribe to our|sign up for|click here|share on (facebook|twitter)|read more"
)


#: The same word four times or more.
STUTTER = r"(?<!\S)(\S++)(?: \1){3,}(?!\S)"
@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules and of the verdict. Shares are of a line's words or characters."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    bars: float = 0.2
    symbols: float = 0.08
    shouts: float = 0.2
    caps_words: int = 5
    stutter: float = 0.5
    boilerplate_chars: int = 200
    max_lost: float = 0.6


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _n(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def _times(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """Whether one line fails: navigation, noisy or shouted punctuation, one word over and over, or boilerplate.

    Each rule first looks for the characters it needs, so that an ordinary line costs a few searches.
    """
    words = _n(line, " \t") + 1
    links = _times(line, "|") + _times(line, "»") + _times(line, " > ")
    navigation = (links >= 2) & (links >= words * rules.bars)
    symbols = _n(line, SYMBOLS)
    noise = (symbols >= 3) & (symbols >= F.length(line) * rules.symbols)
    shouts = _times(line, "!!") + _times(line, "??")
    shouted = line.rlike(r"!!|\?\?") & (shouts >= 2) & (shouts >= words * rules.shouts)
    caps = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}{2}") & (words >= rules.caps_words)
    stutter = line.rlike(STUTTER) & (F.length(F.regexp_replace(line, STUTTER, "")) < F.length(line) * rules.stutter)
    boilerplate = (F.length(line) <= rules.boilerplate_chars) & line.rlike(BOILERPLATE)
    return (line.rlike(r"[#*$%&|<>»]") & (navigation | noise)) | shouted | caps | stutter | boilerplate


def may_fail(text: Column) -> Column:
    """Whether any line of a text can fail: one look at the whole text, which most texts pass."""
    return text.rlike(r"[#*$%&|<>»]|!!|\?\?") | text.rlike(r"(?m)^[^\p{Ll}\n]{9}") | text.rlike(STUTTER) | text.rlike(BOILERPLATE)


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included.

    Most texts repeat no window, and one distinct over 64-bit window hashes shows that. Only the rest sort
    their windows to find where the repeated ones start. ``window`` is even.
    """
    # One-element arrays bind a value once, where a lambda would work an expression out for each element.
    bound = lambda value, then: F.get(F.transform(F.array(value), then), 0)
    n = F.size(words) - (window - 1)

    def covered(ranked: Column) -> Column:
        starts = F.transform(
            F.filter(
                ranked,
                lambda x, j: (F.get(ranked, j - 1)["k"] == x["k"]) | (F.get(ranked, j + 1)["k"] == x["k"]),
            ),
            lambda x: x["i"],
        )
        # Each start adds the words of its window that the start before it has not covered.
        return F.aggregate(
            F.sort_array(starts),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")),
            lambda a, s: F.struct((a["n"] + F.least(s - a["at"], F.lit(window))).alias("n"), s.alias("at")),
            lambda a: a["n"],
        )

    def repeats(keys: Column) -> Column:
        ranked = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(bound(ranked, covered))

    half = window // 2

    def in_hashes(hashes: Column) -> Column:
        return bound(
            F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, half)])), in_halves
        )

    # A repeated window repeats half + 1 of its halves, so a text with fewer repeats of these has none.
    def in_halves(halves: Column) -> Column:
        wide = F.transform(halves, lambda h, i: F.xxhash64(h, F.get(halves, i + half)))
        return F.when(F.size(halves) - F.size(F.array_distinct(halves)) <= half, F.lit(0)).otherwise(
            bound(F.slice(wide, 1, n), repeats)
        )

    return F.when(n < 2, F.lit(0)).otherwise(bound(F.transform(words, lambda w: F.xxhash64(w)), in_hashes))


def measure(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with the base counts, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost (share of the
    text's characters on failed lines) and kept. Columns of ``docs`` with these names are replaced. A null or
    empty text has no words: its counts are 0, it fails, and its clean text is empty. Repeated rows are judged alike.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    spaces = F.lit(SPACES)
    good = F.filter(F.split("_whole", "\n"), lambda x: ~line_fails(x, rules))
    out = (
        docs.withColumn("_whole", whole)
        .withColumn("_words", split_words(F.col("_whole")))
        .withColumn("_worded", F.filter(F.split("_whole", "\n"), lambda x: F.btrim(x, spaces) != ""))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn(
            "n_symbols",
            F.when(F.col("_whole").rlike(f"[{SYMBOLS}]"), _n(F.col("_whole"), SYMBOLS)).otherwise(0).cast("long"),
        )
        .withColumn("n_dup_lines", (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words"), rules.window).cast("long"))
        .withColumn("clean_text", F.when(may_fail(F.col("_whole")), F.array_join(good, "\n")).otherwise(F.col("_whole")))
    )
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    left = F.length(F.array_join(split_words(F.col("clean_text")), ""))
    return (
        out.withColumn("base_failed", failed)
        .withColumn(
            "lost",
            F.when(F.length("clean_text") == F.length("_whole"), F.lit(0.0)).otherwise(
                1 - left / F.greatest(F.col("word_chars"), F.lit(1))
            ),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= rules.max_lost))
        .drop("_whole", "_words", "_worded")
    )
