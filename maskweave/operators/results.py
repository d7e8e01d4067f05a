"""A masked result in two passes: policies first, then known values wherever else they show.

A value that is a token in one column may stand in a free text, an array, a map, a row or a JSON document of another.
Texts inside a value are taken out as a list beside their row and searched there, and only those that changed come back:
what a text becomes depends on the text alone, so a row needs no places, only its changed texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions import policy as P
from maskweave.functions import tokens as K
from maskweave.functions.nested import has_text, leaves, map_strings
from maskweave.operators.emission import patterns, replace_known
from maskweave.operators.jsonpaths import document_strings, put_strings
from maskweave.operators.masking import Masking, mask, mask_column, resolve, value_text


def _is_json(f: T.StructField, json: frozenset[str]) -> bool:
    return isinstance(f.dataType, T.StringType) and (f.name in json or (f.metadata or {}).get("family") == "json")


def replace_in_leaves(
    df: DataFrame, entries: DataFrame, json: frozenset[str] = frozenset(), counts: bool = False, small: bool | None = None
) -> DataFrame:
    """``df`` with every known value replaced by its token in all texts, however deep they lie.

    Map keys, bytes read as UTF-8 and the strings of JSON documents are texts too; numbers and all else stay. JSON columns
    are those in ``json`` and those whose metadata say so. ``counts`` adds a column ``<name>_hits`` of replacements for
    each column with texts. Null stays null; a repeated row is a row each time; an empty table or no entries change
    nothing.
    """
    fields = [f for f in df.schema.fields if has_text(f.dataType)]
    if not fields:
        return df
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))

    def texts_of(f: T.StructField) -> Column:
        value = F.col("row").getField(f.name)
        return F.filter(document_strings(value) if _is_json(f, json) else leaves(value, f.dataType), lambda s: s != "")

    lists = [f"texts{at}" for at in range(len(fields))]
    rows = rows.select("row", *(texts_of(f).alias(c) for f, c in zip(fields, lists, strict=True)))
    known = replace_known(rows, lists, entries, small=small)
    changes = [F.transform(c, lambda c: F.struct(c["was"].alias("was"), c["text"].alias("text"))) for c in lists]
    known = known.select("*", F.array_distinct(F.concat(*changes)).alias("pairs")).select("*", F.map_from_entries("pairs").alias("partner"))

    def shown(f: T.StructField) -> Column:
        value = F.col("row").getField(f.name)
        if not has_text(f.dataType):
            return value
        if _is_json(f, json):
            return put_strings(value, F.col("pairs.was"), F.col("pairs.text"))
        partner = F.col("partner")
        return map_strings(value, f.dataType, lambda s: F.coalesce(F.try_element_at(partner, s), s))

    def hits(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda n, c: n + c["hits"])

    out = [shown(f).alias(f.name, metadata=f.metadata or {}) for f in df.schema.fields]
    if counts:
        out += [hits(c).alias(f"{f.name}_hits") for f, c in zip(fields, lists, strict=True)]
    return known.select(*out)


def own_bindings(df: DataFrame, settings: Masking) -> DataFrame | None:
    """What the token columns of a result bind: (value, normalised, token, seq), each once. Where two columns give a value
    different tokens, the first column's counts. None without a token column."""
    found = []
    for at, f in enumerate(df.schema.fields):
        p = resolve(settings, f.name, f.dataType, f.metadata)
        if p.policy != P.TOKEN or p.paths or settings.key is None or has_text(f.dataType) != isinstance(f.dataType, T.StringType):
            continue
        value = F.col(f"`{f.name}`")
        text = value_text(value, f.dataType)
        normal = K.normalise(text, p.namespace in settings.fold) if isinstance(f.dataType, T.StringType) else text
        token = mask_column(value, f.dataType, p, settings)
        found.append(F.struct(text.alias("value"), normal.alias("normalised"), token.alias("token"), F.lit(at).cast("long").alias("seq")))
    if not found:
        return None
    rows = df.select(F.explode(F.array(*found)).alias("b")).select("b.*")
    return rows.where("value is not null AND token != '" + K.REDACTED + "'").groupBy("value", "normalised", "token").agg(F.min("seq").alias("seq"))


def apply_result(
    df: DataFrame, settings: Masking, bindings: DataFrame | None = None, json: frozenset[str] = frozenset(), counts: bool = False
) -> DataFrame:
    """``df`` masked by its policies, then searched for every value that became a token, in this result or, by
    ``bindings (value, normalised, token, seq)``, before it. Own tokens and markers stay. See :func:`replace_in_leaves`."""
    own = own_bindings(df, settings)
    if own is not None and bindings is not None:
        # Earlier bindings come first.
        before = bindings.select("value", "normalised", "token", F.lit(-1).cast("long").alias("seq"))
        own = before.unionByName(own)
    known = own if own is not None else bindings
    masked = mask(df, settings)
    return masked if known is None else replace_in_leaves(masked, patterns(known), json, counts)
