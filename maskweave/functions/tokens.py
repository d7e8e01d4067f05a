"""Keyed tokens: equal values get equal tokens, and nothing else of the value is left.

All of it is native Spark SQL, so tokens are made inside generated code. The key never appears in a
plan: it is read from a key table by a scalar subquery, and only column names are printed.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "⟨", "⟩"
REDACTED = "⟨redacted⟩"
TAG_HEX = 16
TEST_TAG_HEX = 4
SESSION_LABEL = b"maskweave session token 1\x00"
TOKEN_PATTERN = "^⟨([^:]*[^0-9:])([0-9]+):([0-9a-fA-F]+)⟩$"

KEY_SCHEMA = "conn string, session string, version int, current boolean, ipad binary, opad binary"


_short_tags: ContextVar[bool] = ContextVar("short_tags", default=False)


@contextmanager
def short_tags():
    """Tags of fewer than ``TAG_HEX`` digits are allowed inside: for tests of collisions, never for data."""
    before = _short_tags.set(True)
    try:
        yield
    finally:
        _short_tags.reset(before)


def tag_length(hex_len: int) -> int:
    """``hex_len`` if a tag may have it. Short tags make unlike values share tokens, so they are refused."""
    if not 1 <= hex_len <= 64:
        raise ValueError(f"a tag has 1 to 64 hex digits, not {hex_len}")
    if hex_len < TAG_HEX and not _short_tags.get():
        raise ValueError(f"a tag of {hex_len} hex digits is for tests only")
    return hex_len


def session_key(connection_key: bytes, session: str) -> bytes:
    """Key of one session. The same value gets another token in another session."""
    return hmac.new(connection_key, SESSION_LABEL + session.encode(), hashlib.sha256).digest()


def key_pads(key: bytes) -> tuple[bytes, bytes]:
    """The two padded keys of HMAC-SHA256, as RFC 2104 defines them."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def key_rows(conn: str, session: str, versions: dict[int, bytes]) -> list[tuple]:
    """Key table rows of one session; the highest version is the current one, the others only read."""
    newest = max(versions)
    return [
        (conn, session, v, v == newest, *(bytearray(p) for p in key_pads(session_key(k, session))))
        for v, k in sorted(versions.items())
    ]


def key_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A key table made from rows. It is local to the driver's plan, which shows its columns only."""
    frame = pd.DataFrame([(*r[:4], *map(bytes, r[4:])) for r in rows], columns=[c.split()[0] for c in KEY_SCHEMA.split(", ")])
    return spark.createDataFrame(frame, KEY_SCHEMA)


@dataclass(frozen=True)
class Key:
    """Columns that hold one token key and its version."""

    ipad: Column
    opad: Column
    version: Column


def current_key(keys: DataFrame, conn: str, session: str) -> Key:
    """The current key of a session as a scalar subquery: no join, and no key bytes in the plan.

    More than one current key for a session is an error at run time.
    """
    return key_of(keys.where((F.col("conn") == conn) & (F.col("session") == session) & F.col("current")))


def key_of(rows: DataFrame) -> Key:
    """Key of a table with a single row, read once as a whole."""
    row = rows.select(F.struct("ipad", "opad", "version").alias("key")).scalar()
    return Key(row["ipad"], row["opad"], row["version"])


def joined_key() -> Key:
    """Key columns already present in the row, for data of many sessions joined to the key table."""
    return Key(F.col("ipad"), F.col("opad"), F.col("version"))


def hmac_tag(key: Key, message: Column, hex_len: int = TAG_HEX) -> Column:
    """First hex digits of HMAC-SHA256 over the message's UTF-8 bytes."""
    inner = F.unhex(F.sha2(F.concat(key.ipad, message.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(key.opad, inner), 256), 1, hex_len)


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


# ASCII, Latin-1 letters and Latin Extended-A are already composed: only other text can change.
_MAY_COMPOSE = "[^\\x00-\\u017F]"


#: The characters of Unicode's White_Space property, for trimming in Python as trim_space does.
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(value: Column) -> Column:
    """Trim every Unicode space, where the built-in trim only knows U+0020."""
    return F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")


def normalise(value: Column, fold: bool = False, compose: bool = True) -> Column:
    """NFC, then trim, then lower case where the namespace asks for it.

    NFC has no built-in. Text that cannot change is never sent to Python: the Python side only sees
    rows with characters beyond Latin Extended-A, and null for all others. ``compose=False`` leaves
    the step out of the plan, for values that are numbers or known to be ASCII.
    """
    if compose:
        risky = value.rlike(_MAY_COMPOSE)
        value = F.when(risky, _nfc(F.when(risky, value))).otherwise(value)
    value = trim_space(value)
    return F.lower(value) if fold else value


def format_token(namespace: Column, version: Column, tag: Column) -> Column:
    return F.concat(F.lit(OPEN), namespace, version.cast("string"), F.lit(":"), tag, F.lit(CLOSE))


def token(key: Key, namespace: str | Column, normalised: Column, hex_len: int = TAG_HEX) -> Column:
    """Token of a normalised value; null stays null."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    return format_token(ns, key.version, hmac_tag(key, F.concat(ns, normalised), tag_length(hex_len)))


def parse_token(value: Column) -> Column:
    """Struct of namespace, version and tag; null for anything that is not exactly a token."""
    part = [F.regexp_extract(value, TOKEN_PATTERN, i) for i in (1, 2, 3)]
    version = part[1].try_cast("bigint")
    return F.when(
        value.rlike(TOKEN_PATTERN) & version.isNotNull(),
        F.struct(part[0].alias("namespace"), version.alias("version"), part[2].alias("tag")),
    )
