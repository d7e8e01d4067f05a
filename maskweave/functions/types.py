"""Type families. Policies are decided by family, never by the exact type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, BOOLEAN, DATETIME, UUID, TEXT, UNKNOWN = "numeric", "boolean", "datetime", "uuid", "text", "unknown"

_BY_TYPE = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType), NUMERIC),
    ((T.BooleanType,), BOOLEAN),
    ((T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType), DATETIME),
    ((T.StringType, T.CharType, T.VarcharType, T.VariantType), TEXT),
)


def family(dtype: T.DataType, metadata: dict | None = None, *, elements: bool = False) -> str:
    """Family of a Spark type.

    A string column may declare ``{"family": "uuid"}`` in its metadata, because Spark has no such
    type. With ``elements`` an array takes the family of its elements, as masking wants it; without,
    an array is unknown, as classification wants it.
    """
    declared = (metadata or {}).get("family")
    if declared:
        return declared
    if elements and isinstance(dtype, T.ArrayType):
        return family(dtype.elementType, elements=True)
    for types, name in _BY_TYPE:
        if isinstance(dtype, types):
            return name
    return UNKNOWN


def text_like(name: str) -> bool:
    """Families that can carry a text value. Unknown counts, so it masks more."""
    return name in (TEXT, UNKNOWN)


def text_like_column(family_column: Column) -> Column:
    return F.coalesce(family_column.isin(TEXT, UNKNOWN), F.lit(True))
