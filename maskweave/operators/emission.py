"""Known values in output text: every bound value is replaced by its token wherever it turns up.

Two exact ways give the same answer. A dictionary measured to be small is sent to all executors and
searched with one automaton per worker. A larger one stays a table: texts are cut into windows of the
lengths that occur in it, and the windows meet the dictionary in an ordinary equi-join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from maskweave.functions.batches import answered
from maskweave.functions.tokens import OPEN, REDACTED, SPACE_CHARS, trim_space
from maskweave.session import cut_lineage, fits_broadcast, written

try:
    import ahocorasick
except ImportError:  # looking up each length at each place gives the same answer, slower
    ahocorasick = None

MIN_MATCH_BYTES = 4
#: Lengths of grams: an entry goes by the longest that fits.
GRAMS = (8, 4, 3, 2, 1)
#: Classes that grams are counted by, as a power of two, and characters of a text that are read at once.
CLASS_BITS = 18
BLOCK = 1 << 20
#: Grams that are worked out at once, and where in a gram its second class in a gate starts.
STRIDE = 1 << 16
SECOND = 8
#: Largest dictionary that each Python worker holds, in entries and bytes of text. An entry takes about half a kilobyte there.
DICTIONARY_ROWS = 250_000
DICTIONARY_BYTES = 16 * 1024 * 1024
#: Ids that a task remembers, so as not to search one text over and over.
MET = 1 << 17
#: Largest chunk of rows, in bytes as they are in memory, that travels as one compressed value.
CHUNK_BYTES = 8 * 1024 * 1024
#: Rows that lie side by side in a chunk: few enough that compression still reaches from one column to the next.
CHUNK_STEP = 1024
#: What a list of texts becomes: those that held a value.
CHANGES = "array<struct<was: string, text: string, hits: int>>"
#: What a chunk of rows asks the dictionary for: entries by a gram, own tokens, words that are values, values of a whole cell.
GRAM, TOKEN, WORD, WHOLE = range(4)
_BIT = np.left_shift(1, np.arange(8)).astype(np.uint8)
_BRACKETED = re.compile("⟨[^⟨⟩]*⟩")
_MARKER = re.compile("^⟨redacted:([a-z][a-z_]*)⟩$")
BRACKETED = "⟨[^⟨⟩]*⟩"
MARKER = "^⟨redacted:([a-z][a-z_]*)⟩$"


def fold(text: str) -> str:
    """Lower case, character by character: a folded text has the length of the original."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("Σ", "σ").lower()


def fold_column(text: Column) -> Column:
    return F.lower(F.translate(text, "İΣ", "iσ"))


def patterns(bindings: DataFrame, min_bytes: int = MIN_MATCH_BYTES) -> DataFrame:
    """Search entries of bindings, (pattern, token, seq, short), folded, first bound wins.

    A binding gives its value and its normalised form. ``short`` ones match a whole cell only.
    """
    forms = F.array(F.struct(F.col("value").alias("form"), F.lit(0).alias("k")), F.struct(F.col("normalised").alias("form"), F.lit(1).alias("k")))
    rows = bindings.select("token", "seq", F.inline(forms)).where(F.coalesce(F.length("form"), F.lit(0)) > 0)
    short = F.octet_length("form") < min_bytes
    folded = F.when(short, F.lower("form")).otherwise(fold_column(F.col("form")))
    return (
        rows.select(folded.alias("pattern"), "token", "seq", "k", short.alias("short"))
        .groupBy("pattern", "short")
        .agg(F.min_by("token", F.struct("seq", "k", "token")).alias("token"), F.min("seq").alias("seq"))
    )


def fits_dictionary(entries: DataFrame) -> bool:
    """Whether all workers of an executor can hold the entries, each its own copy."""
    return fits_broadcast(entries, "pattern", "token", rows=DICTIONARY_ROWS, size=DICTIONARY_BYTES)


class Index:
    """Search structure of one worker. Matches are leftmost-longest and do not overlap.

    For some texts the entries that occur in them are enough, with the ``tokens`` and the values among the ``words`` of
    markers that stand there.
    """

    def __init__(self, entries: list[tuple[str, str, bool]], tokens: Iterable[str] = (), words: Iterable[str] = ()):
        self.short = {p: t for p, t, short in entries if short}
        self.long = {p: t for p, t, short in entries if not short}
        self.tokens = {t for _, t, _ in entries}.union(tokens)
        self.words = frozenset(words)
        self.lengths = sorted({len(p) for p in self.long})
        self.automaton = None
        if self.long and ahocorasick:
            self.automaton = ahocorasick.Automaton()
            for p, t in self.long.items():
                self.automaton.add_word(p, (len(p), t))
            self.automaton.make_automaton()

    def all_hits(self, folded: str) -> Iterator[tuple[int, int, str]]:
        """Every match, nested ones included."""
        if self.automaton:
            for end, (n, t) in self.automaton.iter(folded):
                yield end + 1 - n, end + 1, t
        else:
            for start in range(len(folded)):
                for n in self.lengths:
                    if t := self.long.get(folded[start : start + n]):
                        if start + n <= len(folded):
                            yield start, start + n, t

    def hits(self, folded: str) -> list[tuple[int, int, str]]:
        out, last = [], 0
        for start, end, t in sorted(self.all_hits(folded), key=lambda h: (h[0], -h[1])):
            if start >= last:
                out.append((start, end, t))
                last = end
        return out

    def covers(self, text: str) -> bool:
        return text in self.short or fold(text) in self.long or text in self.words

    def protected(self, text: str) -> list[tuple[int, int]]:
        """Where the engine's own tokens and markers stand. A look-alike is data, and so is a marker
        whose kind is a bound value."""
        out = []
        for m in _BRACKETED.finditer(text):
            kind = _MARKER.match(m.group())
            own = m.group() in self.tokens or m.group() == REDACTED
            if own or (kind and not self.covers(kind.group(1))):
                out.append(m.span())
        return out

    def replace(self, text: str) -> tuple[str, int]:
        if not text:
            return text, 0
        keep = self.protected(text) if OPEN in text else []
        if not keep and self.short:
            low = text.lower()
            for form in (low, low.strip(SPACE_CHARS)):
                if form in self.short:
                    return self.short[form], 1
        out, at, n = [], 0, 0
        for start, end in [*keep, (len(text), len(text))]:
            piece, found = self._piece(text[at:start])
            out += [piece, text[start:end]]
            at, n = end, n + found
        return "".join(out), n

    def _piece(self, text: str) -> tuple[str, int]:
        hits = self.hits(fold(text))
        out, at = [], 0
        for start, end, t in hits:
            out += [text[at:start], t]
            at = end
        return "".join(out) + text[at:], len(hits)


def _index(shared) -> Index:
    """The worker's index of a broadcast dictionary, built once and kept with the broadcast."""
    if not hasattr(shared, "search_index"):
        shared.search_index = Index(shared.value)
    return shared.search_index


def _changes(lists: pa.Array, index: Index) -> pa.Array:
    """The texts of each list that hold a value, as :data:`CHANGES`. A text that repeats is searched once."""
    coded = lists.flatten().dictionary_encode()
    texts, at = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    kind = pa.struct([("text", texts.type), ("hits", pa.int32())])
    found = answered(texts, lambda t: dict(zip(("text", "hits"), index.replace(t))), kind)
    hits = np.append(found.field("hits").to_numpy(zero_copy_only=False), 0)  # the last is that of null
    held = hits[at] > 0
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    offsets = np.append(0, np.append(0, np.cumsum(held))[ends])
    mine = pa.array(at[held])
    parts = [texts.take(mine), found.field("text").take(mine), found.field("hits").take(mine)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["was", "text", "hits"]))


def replacer(df: DataFrame, entries: DataFrame, lists: bool = False):
    """Column function text → struct(text, hits), or list of texts → :data:`CHANGES`, over a dictionary small enough to
    send around; None for an empty one, so that no column goes through Python for nothing."""
    rows = [(r.pattern, r.token, r.short) for r in entries.select("pattern", "token", "short").collect()]
    if not rows:
        return None
    shared = df.sparkSession.sparkContext.broadcast(rows)

    if lists:
        return F.arrow_udf(CHANGES)(lambda column: _changes(column, _index(shared)))

    kind = pa.struct([("text", pa.string()), ("hits", pa.int32())])

    @F.arrow_udf("text string, hits int")
    def run(texts: pa.Array) -> pa.Array:
        index = _index(shared)
        return answered(texts, lambda t: dict(zip(("text", "hits"), (None, 0) if t is None else index.replace(t))), kind)

    return run


def replace_known(df: DataFrame, columns: list[str], entries: DataFrame, counts: bool = False, small: bool | None = None) -> DataFrame:
    """``df`` with every known value in the given text columns replaced by its token.

    ``counts`` adds ``<column>_hits``. ``small`` overrides the measured choice, for tests. Columns may all be lists of texts:
    then each becomes the list of those that held a value, as :data:`CHANGES`.
    """
    entries = entries.persist()
    if small is None:
        small = fits_dictionary(entries)
    if any(isinstance(df.schema[c].dataType, T.ArrayType) for c in columns):
        return _replace_in_lists(df, columns, entries, small)
    if not small:
        return _replace_by_join(df, columns, entries, counts)
    run = replacer(df, entries)
    entries.unpersist()
    if run is None:
        return df.select("*", *(F.lit(0).alias(f"{c}_hits") for c in columns)) if counts else df
    out = df.select("*", *(run(F.col(c)).alias(f"_r_{c}") for c in columns))
    picked = [F.col(f"_r_{c}.text").alias(c) if c in columns else F.col(c) for c in df.columns]
    if counts:
        picked += [F.col(f"_r_{c}.hits").alias(f"{c}_hits") for c in columns]
    return out.select(*picked)


def _replace_in_lists(df: DataFrame, columns: list[str], entries: DataFrame, small: bool) -> DataFrame:
    if not small:
        kept = written(entries.select("pattern", "token", "short"), "entries")
        entries.unpersist()
        return _replace_in_lists_by_join(df, columns, kept)
    run = replacer(df, entries, lists=True) or (lambda _: F.array().cast(CHANGES))
    entries.unpersist()
    return df.select(*(run(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def _points(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A number of 64 bits for the ``q`` characters from each place of a text on."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    h, k, power = points.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while 2 * k <= q:  # two halves of a gram make a gram
        h = h[:-k] * np.uint64(power) + h[k:]
        k, power = 2 * k, power * power & 0xFFFFFFFFFFFFFFFF
    for j in range(k, q):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[j:]
    h = h * np.uint64(2 * q + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _joined(texts: pa.Array) -> str:
    """Texts one after the other, made in Arrow, so that they are one Python object and not one each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py()


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _entry_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Every place of entries, a few entries at a time: the entries, their lengths, and for each place its entry, its place
    there and its gram; an entry is cut by the longest of :data:`GRAMS` that fits."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            sizes = _sizes(some.column("pattern"))
            begins = np.cumsum(sizes) - sizes
            points = _points(_joined(some.column("pattern")))
            longer = np.iinfo(np.int64).max
            for q in GRAMS:
                mine = np.flatnonzero((sizes >= q) & (sizes < longer))
                longer = q
                if len(mine):
                    places = sizes[mine] - q + 1
                    firsts = np.cumsum(places) - places
                    entry = np.repeat(mine, places)
                    off = np.arange(len(entry)) - np.repeat(firsts, places)
                    yield some, sizes, entry, off, _grams(points, q)[begins[entry] + off]


def _classes(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CLASS_BITS)).view(np.int64)


def _class_of(gram: Column, bits: int) -> Column:
    return F.shiftrightunsigned(gram, 64 - bits)


def _second_class_of(gram: Column, bits: int) -> Column:
    return F.shiftrightunsigned(gram, SECOND).bitwiseAND((1 << bits) - 1)


def _bitmap(numbers: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which of 2^bits numbers occur: at most 2^bits / 8 bytes, put together from pieces of 4 KB."""
    number = F.col(column).cast("long")
    pieces = numbers.groupBy(F.bitmap_bucket_number(number + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number + 1)).alias("bits")
    )
    out = np.zeros(max(1, (1 << bits) // 32768) * 4096, np.uint8)
    for r in pieces.collect():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _set(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return bitmap[numbers >> 3] & _BIT[numbers & 7] != 0


class _Block:
    """Texts side by side, at most :data:`BLOCK` characters, or a piece of one that is longer: one array for many short texts."""

    def __init__(self, batch: pa.RecordBatch, rows: np.ndarray, sizes: np.ndarray, text: str, at: int | None = None):
        #: Row, place where the piece starts in its text, and where that text is among the texts as they were.
        self.batch, self.rows, self.text = batch, rows, text
        self.starts = np.full(len(rows), at or 0)
        self.froms = np.cumsum(sizes) - sizes
        self.ends = self.froms + sizes
        low = fold(text if at is None else text[at : at + BLOCK + GRAMS[0] - 1])
        self.sizes = sizes if at is None else np.array([len(low)])
        self.begins = self.froms
        self.points = _points(low)

    def _grams(self, q: int) -> Iterator[tuple[int, np.ndarray]]:
        """Grams of the whole array, as many at a time as stay in a core's cache."""
        for at in range(0, len(self.points) - q + 1, STRIDE):
            yield at, _grams(self.points[at : at + STRIDE + q - 1], q)

    def passing(self, q: int, bitmap: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grams in a gate by both their classes: the gram, its piece, its place in the piece. None reaches from one piece
        into the next."""
        found, hits = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for at, grams in self._grams(q):
            hit = np.flatnonzero(_set(bitmap, (grams >> np.uint64(64 - bits)).view(np.int64)))
            some = grams[hit]
            both = _set(bitmap, ((some >> np.uint64(SECOND)) & np.uint64((1 << bits) - 1)).view(np.int64))
            found.append(some[both])
            hits.append(hit[both] + at)
        found, hits = np.concatenate(found), np.concatenate(hits)
        piece = np.searchsorted(self.begins, hits, "right") - 1
        place = hits - self.begins[piece]
        whole = (place + q <= self.sizes[piece]) & (place < BLOCK)
        return found[whole], piece[whole], place[whole]

    def counted(self, q: int) -> np.ndarray:
        """How often each class of grams is in the texts."""
        if len(self.points) < q:
            return np.zeros(1 << CLASS_BITS, np.int64)
        classes = np.concatenate([_classes(grams) for _, grams in self._grams(q)])[:BLOCK]
        over = (self.begins[1:, None] - np.arange(1, q)).ravel()  # these reach into the next text
        classes[over[(over >= 0) & (over < len(classes))]] = 1 << CLASS_BITS
        return np.bincount(classes, minlength=1 << CLASS_BITS)[: 1 << CLASS_BITS]


def _blocks(batches: Iterator[pa.RecordBatch], repeated: bool = False) -> Iterator[_Block]:
    """Texts in blocks; pieces of one text overlap by a gram. Of ``repeated`` ids, one that was just met is left out."""
    met: set = set()
    for batch in batches:
        texts = batch.column("text")
        rows, sizes = np.arange(batch.num_rows), _sizes(texts)
        if repeated:
            new = []
            for k, known in enumerate(batch.column("id").to_pylist()):
                if known not in met:
                    if len(met) >= MET:
                        met.clear()
                    met.add(known)
                    new.append(k)
            rows, sizes = rows[new], sizes[new]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(rows):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BLOCK, "right")))
            some, size = rows[at:upto], sizes[at:upto]
            text = _joined(texts.take(pa.array(some)))
            if len(text) <= BLOCK:
                yield _Block(batch, some, size, text)
            else:
                for part in range(0, len(text), BLOCK):
                    yield _Block(batch, some, size, text, part)
            at = upto


def _frequencies(texts: DataFrame, long: DataFrame, sizes: list[int], repeated: bool) -> np.ndarray:
    """How often each class of the entries' grams is in the texts: one number for each of 2^18 classes."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << CLASS_BITS, bool)
        for *_, grams in _entry_grams(batches):
            seen[_classes(grams)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["class"])

    bitmap = _bitmap(long.mapInArrow(own, "class bigint"), "class", CLASS_BITS)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CLASS_BITS, np.int64)
        for block in _blocks(batches, repeated):
            for q in sizes:
                total += block.counted(q)
        hit = np.flatnonzero(total * np.unpackbits(shared.value, count=1 << CLASS_BITS, bitorder="little"))
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["class", "times"])

    read = texts if repeated else texts.select("text")
    counts = read.mapInArrow(counted, "class bigint, times bigint").groupBy("class").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(1 << CLASS_BITS, np.int64)
    out[counts.column("class").to_numpy()] = counts.column("times").to_numpy()
    return out


def _rarest_keys(texts: DataFrame, long: DataFrame, repeated: bool = False):
    """Per entry that gram of its own that is rarest in the texts, (pattern, token, n, off, gram), the lengths of grams, the
    longest entry, and the gate: how many bits number a gram there, and the bitmap on all executors.

    An entry's grams are cut and compared where the entry lies; they are never a table of their own.
    """
    long = cut_lineage(long.select("pattern", "token").distinct())
    size = F.length("pattern")
    longest = F.coalesce(*(F.when(size >= q, F.lit(q)) for q in GRAMS))
    n, reach, sizes = long.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0)), F.array_sort(F.collect_set(longest))).first()
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, long, sizes, repeated))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, lengths, entry, off, grams in _entry_grams(batches):
            order = np.lexsort((off, shared.value[_classes(grams)], entry))
            best = order[np.unique(entry[order], return_index=True)[1]]
            rows = some.take(pa.array(entry[best]))
            found = [lengths[entry[best]].astype(np.int32), off[best].astype(np.int32), grams[best].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, found)], names=["pattern", "token", "n", "off", "gram"])

    keys = cut_lineage(long.mapInArrow(rarest, "pattern string, token string, n int, off int, gram bigint"))
    bits = min(27, max(16, n.bit_length() + 6))
    classes = F.explode(F.array(_class_of(F.col("gram"), bits), _second_class_of(F.col("gram"), bits)))
    gate = _bitmap(keys.select(classes.alias("class")), "class", bits)
    return keys, sizes, reach, bits, texts.sparkSession.sparkContext.broadcast(gate)


def surroundings(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """Where entries occur in any text, as (token, folded, start, end): a piece of the folded text that holds the entry and a
    character on either side, and its place there. Equal pieces are one row.

    For searches that ask whether an entry shows, not in which rows: texts are neither numbered, compared nor shuffled,
    only the pieces around places that pass the gate of :func:`window_hits`.
    """
    texts = texts.select("text").where(F.length("text") > 0)
    keys, sizes, reach, bits, shared = _rarest_keys(texts, entries.where(~F.col("short")))
    at_once = max(16, (1 << 22) // (2 * reach + 2))

    def gated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: set[tuple[int, int, str]] = set()

        def told():
            columns = zip(*waiting, strict=True) if waiting else ((), (), ())
            types = (pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["gram", "at", "piece"])

        for block in _blocks(batches):
            for q in sizes:
                grams, pieces, places = block.passing(q, shared.value, bits)
                places += block.starts[pieces]
                ats = np.minimum(places, reach + 1)
                froms = block.froms[pieces] + places - ats
                untils = np.minimum(block.ends[pieces], froms + ats + reach + 1)
                for gram, at, first, until in zip(*(x.tolist() for x in (grams.view(np.int64), ats, froms, untils)), strict=True):
                    waiting.add((gram, at, block.text[first:until]))
                    if len(waiting) >= at_once:
                        yield told()
                        waiting.clear()
        yield told()

    places = texts.mapInArrow(gated, "gram bigint, at int, piece string").distinct().join(keys, "gram")
    start, end = F.col("at") - F.col("off"), F.col("at") - F.col("off") + F.col("n")
    places = places.select("token", "pattern", "n", fold_column(F.col("piece")).alias("folded"), start.alias("start"), end.alias("end"))
    same = (F.col("start") >= 0) & (F.substr("folded", F.col("start") + 1, F.col("n")) == F.col("pattern"))
    return places.where(same).select("token", "folded", "start", "end")


def _sent_if_small(side: DataFrame) -> DataFrame:
    """One side of a join, marked to be sent to all executors if it is measured to fit, so that the texts on the other side
    stay where they lie; a larger one is left to a shuffle."""
    shown = side.select(F.to_json(F.struct("*")).alias("row"))
    return F.broadcast(side) if fits_broadcast(shown, "row") else side


def window_hits(texts: DataFrame, entries: DataFrame, repeated: bool = False) -> DataFrame:
    """All places where an entry occurs: (id, start, end, token), from (id, text) with distinct ids, or with ids that
    stand for the same text wherever they are ``repeated``.

    The same plan for ten entries and for millions. Each entry is found by that gram of its own that is rarest in the
    texts. A text gives a row for each place whose gram is in a gate, a bitmap of the entries' grams that is sized by
    their number and never over 16 MB; these rows meet the entries in an equi-join on the gram, and what is left is
    compared with the text itself. The dictionary is gathered nowhere, and only texts with such a place are shuffled.
    """
    texts = texts.select("id", "text").where(F.length("text") > 0)
    keys, sizes, _, bits, shared = _rarest_keys(texts, entries.where(~F.col("short")), repeated)
    kind = texts.schema["id"].dataType.simpleString()

    def gated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, repeated):
            for q in sizes:
                grams, pieces, places = block.passing(q, shared.value, bits)
                for at in range(0, len(grams), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    ids = block.batch.column("id").take(pa.array(block.rows[pieces[some]]))
                    found = [ids, pa.array(grams[some].view(np.int64)), pa.array(block.starts[pieces[some]] + places[some])]
                    yield pa.RecordBatch.from_arrays(found, names=["id", "gram", "at"])

    places = texts.mapInArrow(gated, f"id {kind}, gram bigint, at bigint").join(keys, "gram")
    start = (F.col("at") - F.col("off")).cast("int")
    places = places.select("id", start.alias("start"), "n", "pattern", "token").where("start >= 0")
    places = cut_lineage(places.distinct() if repeated else places)
    some = texts.join(_sent_if_small(places.select("id").distinct()), "id", "left_semi")
    some = (some.dropDuplicates(["id"]) if repeated else some).select("id", fold_column(F.col("text")).alias("folded"))
    same = F.substr("folded", F.col("start") + 1, F.col("n")) == F.col("pattern")
    return places.join(some, "id").where(same).select("id", "start", (F.col("start") + F.col("n")).alias("end"), "token")


def resolve_overlaps(hits: DataFrame, id_column: str = "id") -> DataFrame:
    """Leftmost-longest hits per text, as an array of spans. One text's hits are one group, bounded by
    the text itself."""
    empty = F.array().cast("array<struct<start: int, end: int, token: string>>")
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "token")))

    def step(acc: Column, h: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        span = F.struct(h["start"].cast("int").alias("start"), (-h["back"]).cast("int").alias("end"), h["token"].alias("token"))
        return F.when(h["start"] >= last, F.array_append(acc, span)).otherwise(acc)

    return hits.groupBy(id_column).agg(ordered.alias("h")).select(id_column, F.aggregate("h", empty, step).alias("spans"))


def _bracket_spans(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """Protected places, (id, from, to): own tokens, own markers, by position."""
    found = F.regexp_extract_all("text", F.lit(BRACKETED), F.lit(0))
    pieces = F.arrays_zip(found.alias("m"), F.split("text", BRACKETED).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from: int, to: int, m: string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.coalesce(F.length(p["m"]), F.lit(0))
        span = F.struct(begin.cast("int").alias("from"), end.cast("int").alias("to"), p["m"].alias("m"))
        return F.struct(end.alias("at"), F.when(p["m"].isNotNull(), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    rows = texts.where(F.contains("text", F.lit(OPEN))).select("id", F.inline(spans))
    kind = F.when(F.col("m").rlike(MARKER), F.regexp_extract("m", MARKER, 1))
    rows = rows.withColumn("kind", kind)
    tokens = entries.select(F.col("token").alias("m")).distinct().withColumn("own", F.lit(True))
    words = entries.select(F.col("pattern").alias("kind")).distinct().withColumn("bound", F.lit(True))
    rows = rows.join(tokens, "m", "left").join(words, "kind", "left")
    keep = F.col("own") | (F.col("m") == REDACTED) | (F.col("kind").isNotNull() & F.col("bound").isNull())
    return rows.where(keep).select("id", "from", "to")


def _replace_by_join(df: DataFrame, columns: list[str], entries: DataFrame, counts: bool) -> DataFrame:
    out = df
    for c in columns:
        out = _replace_column_by_join(out, c, entries, counts)
    return out


def _replace_column_by_join(df: DataFrame, column: str, entries: DataFrame, counts: bool) -> DataFrame:
    """Texts go by their digest, and the answers are joined back; a text that is repeated has one answer.

    Texts with nothing to replace have no answer row. Where the answers are few they go to the texts. Else the join back is
    skewed when one text is repeated a great deal; the answer side has one row per text, so it can be split freely.
    """
    keyed = df.withColumn("_id", F.sha2(F.col(column), 256))
    texts = keyed.where(F.col("_id").isNotNull()).select(F.col("_id").alias("id"), F.col(column).alias("text"))
    bracketed = texts.where(F.contains("text", F.lit(OPEN))).distinct()
    protected = _bracket_spans(bracketed, entries)
    ranges = protected.groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    hits = window_hits(texts, entries, repeated=True).join(ranges, "id", "left")
    clash = F.exists("ranges", lambda r: (F.col("start") < r["to"]) & (F.col("end") > r["from"]))
    spans = resolve_overlaps(hits.where(~F.coalesce(clash, F.lit(False))))
    short = entries.where("short").select("pattern", F.col("token").alias("whole"))
    # A value of less than four bytes has at most this many characters in lower case.
    brief = texts.where(F.col("text").rlike(rf"(?Us)^\s*+(?:\S.{{0,{3 * MIN_MATCH_BYTES}}}?)?\s*+\z")).distinct()
    low = brief.join(ranges.select("id"), "id", "left_anti").select("id", F.lower("text").alias("low"))
    cells = low.select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("low").alias("pattern")), F.struct(F.lit(1).alias("k"), trim_space(F.col("low")).alias("pattern")))).alias("c"))
    whole = cells.select("id", "c.k", "c.pattern").join(short, "pattern").groupBy("id").agg(F.min_by("whole", "k").alias("whole"))
    answers = cut_lineage(spans.join(whole, "id", "full").withColumnRenamed("id", "_id"))
    joined = keyed.join(_sent_if_small(answers), "_id", "left")
    text = F.col(column)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, s["token"]).alias("out"))

    rebuilt = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    shown = F.coalesce(F.col("whole"), rebuilt, text)
    n = F.when(F.col("whole").isNotNull(), F.lit(1)).otherwise(F.coalesce(F.size("spans"), F.lit(0)))
    picked = [shown.alias(c) if c == column else F.col(c) for c in df.columns]
    if counts:
        picked.append(n.cast("int").alias(f"{column}_hits"))
    return joined.select(*picked)


def _travels(kind: T.DataType) -> bool:
    """Whether Arrow has a form for values of a type."""
    try:
        return to_arrow_type(kind) is not None
    except Exception:  # the error's class differs by type
        return False


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in chunks, each a compressed value in Arrow's stream form."""
    codec = pa.Codec("zstd", compression_level=9)
    for batch in batches:
        waiting = [batch] if batch.num_rows else []
        while waiting:
            some = waiting.pop()
            if some.num_rows > 1 and some.nbytes > CHUNK_BYTES:
                half = some.num_rows // 2
                waiting += [some.slice(half), some.slice(0, half)]
                continue
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, some.schema) as stream:
                stream.write_table(pa.Table.from_batches([some]), max_chunksize=CHUNK_STEP)
            plain = out.getvalue()
            yield pa.RecordBatch.from_arrays([pa.array([codec.compress(plain, asbytes=True)], pa.binary()), pa.array([plain.size])], names=["data", "size"])


def _unpacked(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    plain = pa.decompress(batch.column("data")[k].as_buffer(), batch.column("size")[k].as_py(), "zstd")
    with pa.ipc.open_stream(plain) as stream:
        return stream.read_all().combine_chunks().to_batches()[0]


def _texts_of(rows: pa.RecordBatch, columns: list[str]) -> pa.Array:
    """The texts in lists of a chunk, each once."""
    return pa.chunked_array([rows.column(c).flatten() for c in columns]).unique().drop_null()


def _number(text: str) -> int:
    return int(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


def _number_column(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _words_asked(texts: pa.Array, held: np.ndarray) -> set[tuple[int, int]]:
    """What a chunk asks for besides grams: the tokens and markers in texts that may hold a value, and texts so short that
    they can be a value of less than four bytes as a whole."""
    asked = set()
    for t in texts.filter(pc.and_(pa.array(held), pc.match_substring(texts, OPEN))):
        for m in _BRACKETED.findall(t.as_py()):
            asked.add((TOKEN, _number(m)))
            if kind := _MARKER.match(m):
                asked.add((WORD, _number(kind.group(1))))
    for t in texts.filter(pc.less(pc.utf8_length(pc.utf8_trim(texts, SPACE_CHARS)), MIN_MATCH_BYTES)):
        low = t.as_py().lower()
        asked.update((WHOLE, _number(form)) for form in (low, low.strip(SPACE_CHARS)) if form)
    return asked


def _replace_in_lists_by_join(df: DataFrame, columns: list[str], entries: DataFrame) -> DataFrame:
    """Rows go in compressed chunks, and the entries that occur in a chunk come to it.

    A chunk asks for each gram in the gate of :func:`window_hits` once, however often it stands there, and gets the entries
    that have it as their rarest; these find in its texts whatever the whole dictionary would find. So only grams and
    entries are rows of a shuffle; texts stay in their chunk, which is written once and moved once.
    """
    odd = [f.name for f in df.schema.fields if not _travels(f.dataType)]
    if odd:  # these stay with Spark and are joined by number
        rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("_n"), *df.columns))
        done = _replace_in_lists_by_join(rows.drop(*odd), columns, entries)
        return rows.select("_n", *odd).join(done, "_n").select(*df.columns)
    chunks = df.mapInArrow(_packed, "data binary, size bigint")
    chunks = cut_lineage(chunks.select(F.monotonically_increasing_id().alias("chunk"), "data", "size"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([_texts_of(_unpacked(batch, k), columns)], names=["text"])

    keys, sizes, _, bits, shared = _rarest_keys(chunks.mapInArrow(texts, "text string"), entries.where(~F.col("short")))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine = _texts_of(_unpacked(batch, k), columns)
                held, grams = np.zeros(len(mine), bool), [np.empty(0, np.uint64)]
                for block in _blocks([pa.RecordBatch.from_arrays([mine], names=["text"])]):
                    for q in sizes:
                        found, pieces, _ = block.passing(q, shared.value, bits)
                        held[block.rows[pieces]] = True
                        grams.append(np.unique(found))
                grams = np.unique(np.concatenate(grams)).view(np.int64)
                words = np.array(sorted(_words_asked(mine, held)), np.int64).reshape(-1, 2)
                kinds = np.append(np.full(len(grams), GRAM), words[:, 0]).astype(np.int32)
                chunk = pa.array(np.full(len(kinds), batch.column("chunk")[k].as_py()))
                yield pa.RecordBatch.from_arrays([chunk, pa.array(kinds), pa.array(np.append(grams, words[:, 1]))], names=["chunk", "kind", "key"])

    none, pattern, token = F.lit(None).cast("string"), F.col("pattern"), F.col("token")
    known = [
        (keys, GRAM, F.col("gram"), pattern, token),
        (entries, TOKEN, _number_column(token), none, token),
        (entries.where(pattern.rlike("^[a-z][a-z_]*$")), WORD, _number_column(pattern), pattern, none),
        (entries.where("short"), WHOLE, _number_column(pattern), pattern, token),
    ]
    tables = [f.select(F.lit(kind).alias("kind"), key.alias("key"), p.alias("pattern"), t.alias("token")) for f, kind, key, p, t in known]
    answers = chunks.mapInArrow(asked, "chunk bigint, kind int, key bigint").join(reduce(DataFrame.unionAll, tables), ["kind", "key"])
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "pattern", "token")).alias("found"))
    kind = T.StructType([T.StructField(f.name, T._parse_datatype_string(CHANGES)) if f.name in columns else f for f in df.schema.fields])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, found = _unpacked(batch, k), batch.column("found")[k].values
                answer = [()] * 3 if found is None else [found.field(f).to_pylist() for f in ("kind", "pattern", "token")]
                said = {which: [a[1:] for a in zip(*answer, strict=True) if a[0] == which] for which in (GRAM, TOKEN, WORD, WHOLE)}
                own = [(p, t, which == WHOLE) for which in (GRAM, WHOLE) for p, t in said[which]]
                index = Index(own, (t for _, t in said[TOKEN]), (p for p, _ in said[WORD]))
                cells = [_changes(rows.column(c), index) if c in columns else rows.column(c) for c in rows.schema.names]
                yield pa.RecordBatch.from_arrays(cells, names=rows.schema.names)

    return chunks.join(answers, "chunk", "left").select("data", "size", "found").mapInArrow(finished, kind)


def occurrences(df: DataFrame, id_column: str, column: str, entries: DataFrame, overlapping: bool = False) -> DataFrame:
    """Places of known values in a text column, (id, start, end, token), by the dictionary in memory
    where it is small and by windows where it is not."""
    if not fits_dictionary(entries):
        hits = window_hits(df.select(F.col(id_column).alias("id"), F.col(column).alias("text")), entries)
        if not overlapping:
            hits = resolve_overlaps(hits).select("id", F.inline("spans"))
        return hits.withColumnRenamed("id", id_column)
    rows = [(r.pattern, r.token, False) for r in entries.where(~F.col("short")).collect()]
    shared = df.sparkSession.sparkContext.broadcast(rows)

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))

    @F.arrow_udf("array<struct<start: int, end: int, token: string>>")
    def find(texts: pa.Array) -> pa.Array:
        index = _index(shared)
        search = index.all_hits if overlapping else index.hits
        return answered(texts, lambda t: [] if t is None else [dict(zip(("start", "end", "token"), h)) for h in search(fold(t))], kind)

    return df.select(id_column, F.inline(find(F.col(column))))


def overlaps_by_window(hits: DataFrame, id_column: str = "id") -> DataFrame:
    """Hits that start before an earlier hit of their text has ended, flagged; a relational view of
    what leftmost-longest drops first."""
    w = W.partitionBy(id_column).orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    return hits.withColumn("covered", F.coalesce(F.col("start") < F.max("end").over(w), F.lit(False)))
