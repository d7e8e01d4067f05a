"""Rewrite every string inside a nested value, map keys included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.detect import once
from maskweave.functions.tokens import REDACTED

MAX_DEPTH = 64


def depth(dtype: T.DataType) -> int:
    """How many containers lie above the deepest leaf."""
    if isinstance(dtype, T.ArrayType):
        return 1 + depth(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return 1 + max(depth(dtype.keyType), depth(dtype.valueType))
    if isinstance(dtype, T.StructType):
        return 1 + max((depth(f.dataType) for f in dtype.fields), default=0)
    return 0


def has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return has_text(dtype.keyType) or has_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(has_text(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.StringType, T.BinaryType))


def leaves(value: Column, dtype: T.DataType) -> Column:
    """All texts inside a value that are not null, in an array: those that :func:`map_strings` hands to its function."""
    if depth(dtype) > MAX_DEPTH:
        return F.array().cast("array<string>")
    return F.filter(_leaves(value, dtype), lambda s: s.isNotNull())


def _leaves(value: Column, dtype: T.DataType) -> Column:
    none = F.array().cast("array<string>")
    if not has_text(dtype):
        return none
    if isinstance(dtype, T.StringType):
        return F.array(value)
    if isinstance(dtype, T.BinaryType):
        return F.array(F.decode(value, "UTF-8"))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda v: _leaves(v, dtype.elementType))), none)
    if isinstance(dtype, T.MapType):
        sides = [_leaves(F.map_keys(value), T.ArrayType(dtype.keyType)), _leaves(F.map_values(value), T.ArrayType(dtype.valueType))]
        return F.coalesce(F.concat(*sides), none)
    return F.concat(*(_leaves(value[f.name], f.dataType) for f in dtype.fields))


def map_strings(value: Column, dtype: T.DataType, fn: Callable[[Column], Column]) -> Column:
    """``value`` with ``fn`` applied to each string leaf; bytes are read as UTF-8 text.

    The expression follows the schema, so it stays native. A value nested deeper than 64 levels is
    masked whole. No map entry is lost: where several keys of a map come out alike, the texts of those after
    the first become markers with a number that no key of the map has.
    """
    if depth(dtype) > MAX_DEPTH:
        return F.when(value.isNotNull(), F.lit(REDACTED))
    return _rewrite(value, dtype, fn)


def _told_apart(keys: Column, dtype: T.DataType) -> Column:
    """Keys with each repeat of an earlier one told apart by a numbered marker. Numbers go by the place, on from the
    highest that stands in a marker among the keys."""
    numbers = F.transform(
        leaves(keys, T.ArrayType(dtype)), lambda s: F.coalesce(F.regexp_extract(s, "^⟨redacted:([0-9]{1,9})⟩$", 1).try_cast("long"), F.lit(0))
    )

    def numbered(k: Column, i: Column) -> Column:
        number = F.coalesce(F.array_max(numbers), F.lit(0)) + i + 1
        marker = F.concat(F.lit("⟨redacted:"), number.cast("string"), F.lit("⟩"))
        return F.when(F.array_position(keys, k) == i + 1, k).otherwise(_rewrite(k, dtype, lambda _: marker))

    return F.transform(keys, numbered)


def _rewrite(value: Column, dtype: T.DataType, fn: Callable[[Column], Column]) -> Column:
    if not has_text(dtype):
        return value
    if isinstance(dtype, T.StringType):
        return fn(value)
    if isinstance(dtype, T.BinaryType):
        return fn(F.decode(value, "UTF-8")).cast("binary")
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: _rewrite(v, dtype.elementType, fn))
    if isinstance(dtype, T.MapType):
        out = value
        if has_text(dtype.valueType):
            out = F.transform_values(out, lambda _, v: _rewrite(v, dtype.valueType, fn))
        if has_text(dtype.keyType):
            keys = F.transform(F.map_keys(out), lambda k: _rewrite(k, dtype.keyType, fn))
            keys = once(keys, lambda k: _told_apart(k, dtype.keyType))
            out = F.map_from_arrays(keys, F.map_values(out))
        return out
    fields = [_rewrite(value[f.name], f.dataType, fn).alias(f.name) for f in dtype.fields]
    return F.when(value.isNotNull(), F.struct(*fields))
