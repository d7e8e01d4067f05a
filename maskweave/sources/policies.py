"""Policy files: JSON of the nesting schema, table, column, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions import policy as P

VERSION = 1
_ENTRY = "struct<policy: string, namespace: string, paths: map<string, struct<policy: string, namespace: string>>>"
FILE_SCHEMA = f"version int, schemas map<string, map<string, map<string, {_ENTRY}>>>"


def flatten(files: DataFrame) -> DataFrame:
    """One row per column of parsed policy files; a policy nobody knows becomes redact."""
    rows = (
        files.select(F.explode("schemas").alias("schema", "tables"))
        .select("schema", F.explode("tables").alias("relation", "columns"))
        .select("schema", "relation", F.explode("columns").alias("column", "entry"))
    )
    policy, namespace = F.col("entry.policy"), F.coalesce(F.col("entry.namespace"), F.lit(""))
    return rows.select(
        "schema", "relation", "column",
        P.known(policy).alias("policy"),
        P.known_namespace(policy, namespace).alias("namespace"),
        P.known_paths(F.col("entry.paths")).alias("paths"),
    )


def refuse_invalid(entries: DataFrame) -> DataFrame:
    """The same rows, failing the job on the first invalid entry: a bad file is refused whole."""
    reason = P.invalid_entry_reason(F.col("policy"), F.col("namespace"), F.col("paths"))
    name = F.concat_ws(".", "schema", "relation", "column")
    checked = F.when(reason.isNull(), F.col("policy")).otherwise(
        F.raise_error(F.concat(name, F.lit(": "), reason)).cast("string")
    )
    return entries.withColumn("policy", checked)


def load(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Entries of all policy files under a path: a document per line, or one per file with ``multi_line``."""
    files = spark.read.schema(FILE_SCHEMA).option("multiLine", multi_line).json(path)
    bad = F.coalesce(F.col("version"), F.lit(0)).isin(0, VERSION)
    version = F.when(bad, F.col("version")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported version "), F.col("version").cast("string"))).cast("int")
    )
    checked = files.where(F.coalesce(version, F.lit(0)) >= 0)
    return refuse_invalid(flatten(checked))


def nest(entries: DataFrame) -> DataFrame:
    """The file form of entries, one row per schema: a schema's catalog is the unit of a file."""
    entry = F.struct("policy", "namespace", "paths")
    tables = entries.groupBy("schema", "relation").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", F.to_json(entry).alias("e"))))).alias("columns")
    )
    entry_type = T._parse_datatype_string(_ENTRY)
    tables = tables.withColumn("columns", F.transform_values("columns", lambda _, e: F.from_json(e, entry_type)))
    per_table = tables.select("schema", F.lit(VERSION).alias("version"), F.create_map("relation", "columns").alias("tables"))
    return per_table.select("version", F.create_map("schema", "tables").alias("schemas"))


def save(entries: DataFrame, path: str) -> None:
    """Write to a new path; readers switch to it once the job has committed."""
    nest(refuse_invalid(entries)).write.mode("errorifexists").json(path)
