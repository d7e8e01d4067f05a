"""Policies inside JSON documents, by path: ``$.customer.email``, ``$.items[*].sku``.

A path with no policy is redacted, and so is the name of a member that leads to none. The document
keeps its member order and the text of its numbers, which no built-in JSON function does, so the
walk runs in Arrow batches. For a flat document of known members :func:`mask_known_members` stays
native.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable
from itertools import zip_longest
from json.encoder import encode_basestring as _quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.detect import detection_reach, examines, redact_found, redact_spans, redact_text, spans
from maskweave.functions.policy import ALLOW, POLICIES, REDACT, SCAN, TOKEN
from maskweave.functions.tokens import CLOSE, OPEN, REDACTED, SPACE_CHARS, TAG_HEX, Key, tag_length

MAX_DEPTH = 64
#: Where an examined leaf goes into a document; a written document holds no control character.
_HOLE = "\x00"
PIECES = T.ArrayType(T.StructType([T.StructField("fixed", T.StringType()), T.StructField("leaf", T.StringType())]))


class Raw(str):
    """Text of a number, kept as written."""


class Members(list):
    """Members of an object, in order."""


def _strict(text: str):
    """Not-a-number and infinities are no JSON."""
    raise ValueError(text)


def _parser() -> Callable[[str], object]:
    """Reads one document after another. Made in the worker, since it doesn't travel."""
    return json.JSONDecoder(object_pairs_hook=Members, parse_int=Raw, parse_float=Raw, parse_constant=_strict).decode


def _leading(paths: dict) -> frozenset[str]:
    """The paths and all that lead to them."""
    return frozenset(p[:i] for p in paths for i in range(len(p) + 1) if i == len(p) or p[i] in ".[")


def _write(node, path: str, leading: frozenset[str], leaf, depth: int) -> str:
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    if isinstance(node, Members):
        hidden, parts = 0, []
        for name, child in node:
            at, shown = f"{path}.{name}", name
            if at not in leading:
                hidden += 1
                shown = REDACTED if hidden == 1 else f"⟨redacted:{hidden}⟩"
            parts.append(f"{_quote(shown)}:{_write(child, at, leading, leaf, depth + 1)}")
        if len({p for p, _ in node}) != len(node):
            raise ValueError("repeated member")
        return "{" + ",".join(parts) + "}"
    if isinstance(node, list):
        return "[" + ",".join(_write(v, path + "[*]", leading, leaf, depth + 1) for v in node) + "]"
    return leaf(path, node)


def _raw(node) -> str:
    if isinstance(node, Raw):
        return str(node)
    return _quote(node) if isinstance(node, str) else json.dumps(node)


def mask_document(
    text: str, paths: dict[str, tuple[str, str]], make_token, scan, leading: frozenset[str] | None = None, parse: Callable[[str], object] | None = None
) -> str:
    """One document; anything that is not an object or array is masked whole. ``leading`` and ``parse`` save making them for
    each document."""
    leading = _leading(paths) if leading is None else leading

    def leaf(path, node):
        policy, namespace = paths.get(path, (REDACT, ""))
        if node is None and path in paths:
            return "null"
        is_text = isinstance(node, str) and not isinstance(node, Raw)
        if policy == TOKEN and namespace:
            return _quote(make_token(namespace, node if is_text else _raw(node)))
        if policy in (ALLOW, SCAN):
            return scan(policy, node) if is_text else _raw(node)
        return _quote(REDACTED)

    try:
        node = (parse or _parser())(text)
        if not isinstance(node, list):
            return REDACTED
        return _write(node, "$", leading, leaf, 0)
    except (ValueError, RecursionError):
        return REDACTED


def _resolved(paths: dict[str, tuple[str, str]], floor: str) -> dict[str, tuple[str, str]]:
    """Paths with unknown policies and the floor applied."""
    out = {}
    rank = POLICIES.index
    for path, (policy, namespace) in paths.items():
        policy = policy if policy in POLICIES else REDACT
        if rank(floor) > rank(policy):
            policy = floor
        out[path] = (policy, namespace)
    return out


def mask_paths(
    value: Column,
    paths: dict[str, tuple[str, str]],
    key: Key | None,
    detection: str = "scan",
    floor: str = ALLOW,
    fold: frozenset[str] = frozenset(),
    detector: Callable[[Column], Column] | None = spans,
    hex_len: int = TAG_HEX,
) -> Column:
    """JSON text with each path masked by its policy. The key arrives as columns, never in a closure.

    Texts that are examined go through ``detector``: one that is a column function gets them as a column, between
    the pieces of the document, which needs a key that is not a subquery. Without a detector, or where it gives no
    answer, they are masked whole.
    """
    resolved, hex_len = _resolved(paths, floor), tag_length(hex_len)
    reach = detection_reach(detection)
    unseen = detector is None or reach == "off"
    # The built-in patterns, and a recogniser written in Python, are called where the leaves are.
    find = None if unseen else getattr(detector, "one", None)
    own = redact_text if detector is spans else find and (lambda leaf: redact_found(leaf, find(leaf)))
    leading = _leading(resolved)

    @F.pandas_udf(PIECES)
    def walk(texts: pd.Series, ipad: pd.Series, opad: pd.Series, version: pd.Series) -> pd.Series:
        # What is examined or made a token again and again inside a batch is so once.
        examined, made, parse = {}, {}, _parser()

        def one(text, i, o, v):
            found: list[str] = []

            def scan(policy: str, leaf: str) -> str:
                if not leaf or not examines(policy, True, reach):
                    return _quote(leaf)
                if unseen:
                    return _quote(REDACTED)
                if own is not None:
                    if leaf not in examined:
                        examined[leaf] = _quote(own(leaf))
                    return examined[leaf]
                found.append(leaf)
                return _HOLE

            def make_token(namespace: str, raw: str) -> str:
                if i is None or o is None:
                    return REDACTED
                known = made.get((namespace, raw, i, o, v))
                if known is not None:
                    return known
                normal = unicodedata.normalize("NFC", raw).strip(SPACE_CHARS)
                normal = normal.lower() if namespace in fold else normal
                inner = hashlib.sha256(bytes(i) + (namespace + normal).encode()).digest()
                tag = hashlib.sha256(bytes(o) + inner).hexdigest()[:hex_len]
                return made.setdefault((namespace, raw, i, o, v), f"{OPEN}{namespace}{int(v)}:{tag}{CLOSE}")

            if text is None:
                return None
            fixed = mask_document(text, resolved, make_token, scan, leading, parse).split(_HOLE)
            leaves = found if len(fixed) == len(found) + 1 else []
            return [{"fixed": f, "leaf": x} for f, x in zip_longest(fixed, leaves)]

        return pd.Series([one(*row) for row in zip(texts, ipad, opad, version)], dtype=object)

    def shown(piece: Column) -> Column:
        masked = F.to_json(F.array(redact_spans(piece["leaf"], detector(piece["leaf"]))))
        quoted = F.substr(masked, F.lit(2), F.length(masked) - 2)
        return F.concat(piece["fixed"], F.when(piece["leaf"].isNull(), F.lit("")).otherwise(quoted))

    none = F.lit(None)
    k = key or Key(none.cast("binary"), none.cast("binary"), none.cast("int"))
    pieces = walk(value, k.ipad, k.opad, k.version)
    if unseen or own is not None:
        return F.get(pieces, F.lit(0))["fixed"]
    return F.array_join(F.transform(pieces, shown), "")


def examined_leaves(value: Column, paths: dict[str, tuple[str, str]], detection: str = "scan", floor: str = ALLOW) -> Column:
    """Texts of a JSON document that :func:`mask_paths` has examined, in an array; none for what it masks whole."""
    resolved, reach = _resolved(paths, floor), detection_reach(detection)
    leading = _leading(resolved)

    @F.pandas_udf("array<string>")
    def gather(texts: pd.Series) -> pd.Series:
        parse = _parser()

        def one(text):
            found: list[str] = []

            def scan(policy: str, leaf: str) -> str:
                if leaf and examines(policy, True, reach):
                    found.append(leaf)
                return _quote("")

            shown = REDACTED if text is None else mask_document(text, resolved, lambda *_: "", scan, leading, parse)
            return [] if shown == REDACTED else found

        return pd.Series([one(t) for t in texts], dtype=object)

    return gather(value)


def _walk_strings(node, fn) -> str:
    if isinstance(node, Members):
        return "{" + ",".join(f"{_quote(fn(name))}:{_walk_strings(child, fn)}" for name, child in node) + "}"
    if isinstance(node, list):
        return "[" + ",".join(_walk_strings(v, fn) for v in node) + "]"
    return _quote(fn(node)) if isinstance(node, str) and not isinstance(node, Raw) else _raw(node)


def _document(text: str):
    """A text as a JSON object or array; None if it is none."""
    try:
        node = _parser()(text)
    except (ValueError, RecursionError):
        return None
    return node if isinstance(node, list) else None


def document_strings(value: Column) -> Column:
    """All strings of a JSON document, member names included; a text that is no object or array is one string."""

    @F.pandas_udf("array<string>")
    def gather(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return []
            found: list[str] = []
            node = _document(text)
            if node is None:
                return [text]
            _walk_strings(node, lambda s: found.append(s) or s)
            return found

        return pd.Series([one(t) for t in texts], dtype=object)

    return gather(value)


def put_strings(value: Column, old: Column, new: Column) -> Column:
    """A JSON document with each string that is in ``old`` replaced by its partner in ``new``. Numbers, their spelling and
    the order of members stay; a document without any of them stays as it is written. Members that come out alike are
    numbered, so none is lost."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
        def one(text, old, new):
            if text is None or old is None or not len(old):
                return text
            partner = dict(zip(old, new))
            node = _document(text)
            return partner.get(text, text) if node is None else _walk_strings(_apart(node, partner), lambda s: partner.get(s, s))

        return pd.Series([one(*row) for row in zip(texts, olds, news)], dtype=object)

    return put(value, old, new)


def _apart(node, partner: dict[str, str]):
    """A document whose member names stay apart when they are replaced."""
    if isinstance(node, Members):
        taken, out = {name for name, _ in node if name not in partner}, Members()
        for name, child in node:
            shown, n = partner.get(name, name), 1
            while name in partner and (shown in taken):
                n += 1
                shown = f"⟨redacted:{n}⟩"
            taken.add(shown)
            out.append((shown, _apart(child, partner)))
        return out
    return [_apart(v, partner) for v in node] if isinstance(node, list) else node


def mask_known_members(value: Column, members: dict[str, Callable[[Column], Column]], hidden: str = REDACTED) -> Column:
    """Flat object with exactly the given members, rebuilt natively with each one's rule applied.

    A cell that is not an object is masked whole. Members outside the list are left out of the output
    object, so nothing undeclared can show.
    """
    parsed = F.from_json(value, "map<string, string>")
    fields = [rule(F.try_element_at(parsed, F.lit(name))).alias(name) for name, rule in members.items()]
    is_object = value.rlike(r"^\s*\{") & parsed.isNotNull()
    return F.when(value.isNotNull(), F.when(is_object, F.to_json(F.struct(*fields))).otherwise(F.lit(hidden)))


def is_container(value: Column) -> Column:
    """Whether a text is exactly one JSON object or array.

    Spark's parser stops after the first value and ignores what follows. A text with something behind
    its value cannot be well formed inside both an array of one and an object of one.
    """
    in_array, in_object = F.concat(F.lit("["), value, F.lit("]")), F.concat(F.lit('{"v":'), value, F.lit("}"))
    alone = F.try_parse_json(in_array).isNotNull() & F.try_parse_json(in_object).isNotNull()
    return value.rlike(r"^\s*[\[{]") & alone & (F.json_array_length(in_array) == 1)


def mask_unless_container(value: Column) -> Column:
    """Cells that are not a JSON object or array, or are invalid, masked whole."""
    kept = F.coalesce(is_container(value), F.lit(False))
    return F.when(value.isNotNull(), F.when(kept, value).otherwise(F.lit(REDACTED)))
