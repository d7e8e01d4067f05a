"""Columns, statistics and samples of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.types import TEXT, family

KEY = ("schema", "relation", "column")
MAX_SAMPLE = 10_000

COLUMNS_SCHEMA = (
    "schema string, relation string, kind string, column string, position int, type string, family string, "
    "nullable boolean, is_pk boolean, is_fk boolean, has_default boolean, is_identity boolean"
)
STATS_SCHEMA = "schema string, relation string, column string, distinct double, avg_width double"

#: Primary and foreign keys, defaults and identities cannot be read from files: the user declares them.
NO_KEYS: dict[str, frozenset[str]] = {}


def columns_of(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    schema: str = "main",
    kinds: dict[str, str] | None = None,
    declared: dict[str, dict[str, set[str]]] | None = None,
) -> DataFrame:
    """One row per column of the given tables, from their schemas alone; no data is read.

    ``declared`` maps ``is_pk``, ``is_fk``, ``has_default`` and ``is_identity`` to the columns of each
    table that have the property.
    """
    declared = declared or {}

    def has(prop: str, table: str, column: str) -> bool:
        return column in declared.get(prop, {}).get(table, ())

    rows = [
        (
            schema, name, (kinds or {}).get(name, "r"), f.name, i, f.dataType.simpleString(),
            family(f.dataType, f.metadata), f.nullable,
            *(has(p, name, f.name) for p in ("is_pk", "is_fk", "has_default", "is_identity")),
        )
        for name, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def session_columns(spark: SparkSession, database: str) -> DataFrame:
    """:func:`columns_of` every table and view of a database in the session's catalog."""
    listed = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
    return columns_of(
        spark,
        {t.name: spark.table(f"`{database}`.`{t.name}`") for t in listed},
        schema=database,
        kinds={t.name: "v" if t.tableType == "VIEW" else "r" for t in listed},
    )


def text_stats(tables: dict[str, DataFrame], schema: str = "main", exact: bool = False) -> DataFrame:
    """Distinct count and average width in bytes of every text column.

    One aggregation per table covers all its text columns. The distinct count is a sketch of fixed
    size unless ``exact`` is set, so no column's values are shuffled.
    """
    parts = [_table_stats(df, schema, name, exact) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def _table_stats(df: DataFrame, schema: str, relation: str, exact: bool) -> DataFrame | None:
    names = [f.name for f in df.schema.fields if family(f.dataType, f.metadata) == TEXT]
    if not names:
        return None
    if exact:
        return exact_stats(df, schema, relation, names)
    aggs = []
    for i, n in enumerate(names):
        aggs += [
            F.approx_count_distinct(n).alias(f"d{i}"),
            F.avg(F.octet_length(n)).alias(f"w{i}"),
        ]
    wide = df.agg(*aggs)
    entries = F.array(
        *(
            F.struct(F.lit(n).alias("column"), F.col(f"d{i}").cast("double").alias("distinct"), F.col(f"w{i}").alias("avg_width"))
            for i, n in enumerate(names)
        )
    )
    return _labelled(wide.select(F.inline(entries)), schema, relation)


def exact_stats(df: DataFrame, schema: str, relation: str, names: list[str]) -> DataFrame:
    """Exact form: values are counted per column first, so a value held by a third of the rows is
    reduced before the shuffle, and long values travel as their digest."""
    values = F.array(
        *(
            F.struct(F.lit(n).alias("column"), F.sha2(F.col(f"`{n}`"), 256).alias("value"), F.octet_length(F.col(f"`{n}`")).alias("width"))
            for n in names
        )
    )
    counted = (
        df.select(F.inline(values))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"), F.first("width").alias("width"))
    )
    per_column = counted.groupBy("column").agg(
        F.count("*").cast("double").alias("distinct"),
        (F.sum(F.col("n") * F.col("width")) / F.sum("n")).alias("avg_width"),
    )
    return _labelled(per_column, schema, relation)


def _labelled(df: DataFrame, schema: str, relation: str) -> DataFrame:
    return df.select(
        F.lit(schema).alias("schema"), F.lit(relation).alias("relation"), "column", "distinct", "avg_width"
    )


def sample_columns(
    df: DataFrame, columns: list[str], n: int, schema: str = "main", relation: str = "", order: list[Column] | None = None
) -> DataFrame:
    """Up to ``n`` non-null values of each column as text, with their key. More than ``MAX_SAMPLE`` are refused.

    Each column is its own pruned scan with a top-n, so every task keeps at most ``n`` values. With an
    order the sample is repeatable; without, the first rows found are taken.
    """
    if n > MAX_SAMPLE:
        raise ValueError(f"a sample has at most {MAX_SAMPLE} values, not {n}")

    def one(name: str) -> DataFrame:
        picked = df.where(F.col(name).isNotNull())
        if order:
            picked = picked.orderBy(*order)
        return picked.limit(n).select(
            F.lit(schema).alias("schema"), F.lit(relation).alias("relation"), F.lit(name).alias("column"),
            F.col(name).cast("string").alias("value"),
        )

    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def schema_view(columns: DataFrame, policies: DataFrame, schema: str = "", table: str = "", readable: DataFrame | None = None) -> DataFrame:
    """Columns with their policies, filtered by schema and table; a table ending in ``*`` is a prefix.

    A column with no entry shows as redact. Unreadable columns keep a row with ``readable`` false, so
    they can be counted without being named by the caller.
    """
    out = columns
    if schema:
        out = out.where(F.lower("schema") == schema.lower())
    if table.endswith("*"):
        out = out.where(F.startswith(F.lower("relation"), F.lit(table[:-1].lower())))
    elif table:
        out = out.where(F.lower("relation") == table.lower())
    out = out.join(policies.select(*KEY, "policy", "namespace"), list(KEY), "left")
    if readable is None:
        out = out.withColumn("readable", F.lit(True))
    else:
        out = out.join(readable.select(*KEY).withColumn("granted", F.lit(True)), list(KEY), "left")
        out = out.withColumn("readable", F.col("granted").isNotNull()).drop("granted")
    return out.withColumn("policy", F.coalesce("policy", F.lit("redact"))).withColumn("namespace", F.coalesce("namespace", F.lit("")))


def readable_columns(columns: DataFrame, grants: DataFrame, role: str) -> DataFrame:
    """Columns a role may read, from a table of grants by relation and column."""
    granted = grants.where(F.col("role") == role).select(*KEY).distinct()
    return columns.join(granted, list(KEY), "left_semi")


def json_safe(df: DataFrame) -> DataFrame:
    """Not-a-number and the infinities as text, since JSON has no such numbers; arrays too."""

    def safe(value: Column) -> Column:
        return (
            F.when(F.isnan(value), "NaN")
            .when(value == float("inf"), "Infinity")
            .when(value == float("-inf"), "-Infinity")
            .otherwise(value.cast("string"))
        )

    def fix(field: T.StructField) -> Column:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return safe(col).alias(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.FloatType, T.DoubleType)):
            return F.transform(col, safe).alias(field.name)
        return col

    return df.select(*(fix(f) for f in df.schema.fields))
