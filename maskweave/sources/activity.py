"""Activity log files: append, read with damaged lines counted, and encrypted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = (
    "id string, at timestamp, seq long, session_id string, connection string, statement string, "
    "statement_type string, relations array<struct<schema: string, relation: string>>, row_count long, "
    "decision string, approver string, error_code string, collisions int, duration_ms long"
)
BAD = "_bad"


def with_day(records: DataFrame) -> DataFrame:
    """Records with id and time filled where missing, and their UTC day."""
    return (
        records.withColumn("id", F.coalesce("id", F.expr("uuid()")))
        .withColumn("at", F.coalesce("at", F.current_timestamp()))
        .withColumn("day", F.to_date("at"))
    )


def append(records: DataFrame, path: str) -> None:
    """Append to the log, one folder per UTC day."""
    with_day(records).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A log kept as JSON lines. A damaged line stays as a row with its text in ``_bad``."""
    full = T._parse_datatype_string(schema).add(BAD, T.StringType())
    return (
        spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    )


def parse_lines(lines: DataFrame, schema: str = SCHEMA, column: str = "value") -> DataFrame:
    """:func:`read_lines` for lines that are already a column."""
    full = T._parse_datatype_string(schema).add(BAD, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return lines.select(F.from_json(column, full, options).alias("r")).select("r.*")


def readable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(BAD).isNull()).drop(BAD)


def unreadable_count(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count(BAD).alias("unreadable"))


def record_key(keys: DataFrame, name: str) -> Column:
    """An AES key from a key table, as a scalar subquery: its bytes never appear in a plan."""
    return keys.where(F.col("name") == name).select("key").scalar()


def encrypted(records: DataFrame, key: Column) -> DataFrame:
    """One encrypted text per record: AES-GCM with a fresh nonce, over the record as JSON."""
    text = F.to_json(F.struct(*records.columns))
    return records.select(F.base64(F.aes_encrypt(text, key, F.lit("GCM"))).alias("value"))


def decrypted(lines: DataFrame, key: Column, schema: str = SCHEMA) -> DataFrame:
    """Records of encrypted lines; a line that does not decrypt is kept as damaged, never guessed."""
    text = F.try_aes_decrypt(F.try_to_binary("value", F.lit("base64")), key, F.lit("GCM")).cast("string")
    full = T._parse_datatype_string(schema)
    parsed = lines.select(F.from_json(text, full).alias("r"), F.when(text.isNull(), F.col("value")).alias(BAD))
    return parsed.select("r.*", BAD)
