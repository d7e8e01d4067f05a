"""Texts of an Arrow batch, a few at a time, so that a worker never holds a whole batch as Python objects."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa

#: Characters, and answers, that are held before they go into an Arrow array.
HELD = 1 << 20
ANSWERS = 1024


def answered(texts: pa.Array, answer: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """The answer to each text, in order. A text that repeats inside the batch is asked for once."""
    first: dict[bytes | None, int] = {}
    places, parts, some, size = [], [], [], 0
    for value in texts:
        text = value.as_py()
        known = None if text is None else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if known not in first:
            first[known] = len(first)
            some.append(answer(text))
            size += len(text or "")
            if size >= HELD or len(some) >= ANSWERS:
                parts.append(pa.array(some, kind))
                some, size = [], 0
        places.append(first[known])
    parts.append(pa.array(some, kind))
    out = pa.concat_arrays(parts)
    return out if len(first) == len(places) else out.take(pa.array(places, pa.int32()))
