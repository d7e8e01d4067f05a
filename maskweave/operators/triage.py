"""What to do with each planned statement: run it, ask, or refuse, with the reasons why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import statements as S
from maskweave.session import fits_broadcast

READS = ("always", "uncertain", "never")
WRITES = ("ask", "allow")


def effective_reads(stored: Column) -> Column:
    """Nothing stored is the default, ``uncertain``; an unknown value asks on every read."""
    empty = F.coalesce(stored, F.lit("")) == ""
    return F.when(empty, "uncertain").when(stored.isin(*READS), stored).otherwise("always")


def effective_writes(stored: Column) -> Column:
    """Anything but ``ask`` and ``allow`` refuses writes."""
    return F.when(stored.isin(*WRITES), stored).otherwise("off")


def outcome(statement_type: Column, writes: Column, uncertain: Column, reads_setting: Column, writes_setting: Column) -> Column:
    reads, may_write = effective_reads(reads_setting), effective_writes(writes_setting)
    write = F.when(may_write == "ask", "ask").when(may_write == "allow", "run").otherwise("refuse")
    read = F.when(reads == "never", "run").when((reads == "uncertain") & ~uncertain, "run").otherwise("ask")
    return F.when(statement_type == "DDL", "refuse").when(writes, write).otherwise(read)


def reasons(
    statement_type: Column, writes: Column, uncertain: Column, reads_setting: Column, writes_setting: Column,
    masked: Column | None = None, unresolved: Column | None = None, stale: Column | None = None,
) -> Column:
    """Reason codes, each once, in the order they are found."""
    ddl = statement_type == "DDL"
    reads, may_write = effective_reads(reads_setting), effective_writes(writes_setting)
    read = ~ddl & ~writes
    flags = [
        (stale, "stale_catalog"),
        (ddl, "ddl"),
        (~ddl & writes, "write"),
        (~ddl & writes & (may_write == "off"), "writes_off"),
        (read & (reads == "uncertain") & uncertain, "volatile_call"),
        (read & (reads == "always"), "reads_ask"),
        (masked, "masked_output"),
        (unresolved, "unresolved_column"),
    ]
    found = [F.when(cond, code) for cond, code in flags if cond is not None]
    return F.array_distinct(F.array_compact(F.array(*found)))


def triage(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Facts of each statement with its outcome and reasons. ``profiles`` has one row per connection."""
    joined = facts.join(profiles.select(F.col("id").alias("connection"), "reads", "writes_setting"), "connection", "left")
    args = [F.col(c) for c in ("statement_type", "writes", "uncertain", "reads", "writes_setting")]
    return joined.select(*facts.columns, outcome(*args).alias("outcome"), reasons(*args).alias("reasons"))


def facts_of(statements: DataFrame, known: Column | None = None) -> DataFrame:
    """A facts row per statement of a log: normalised text, kind, risk, whether it writes."""
    n = statements.withColumn("_n", S.normalise(F.col("statement"), known))
    kind = F.col("_n.kind")
    return n.select(
        *statements.columns, F.col("_n.text").alias("normalised"), kind.alias("statement_type"),
        kind.isin("INSERT", "UPDATE", "DELETE", "MERGE").alias("writes"),
        S.risk(kind).alias("risk"), S.unreadable(kind).alias("unreadable"),
    )


#: Between the names of a relation, where they travel as one text; a name's own is written as two characters.
_BETWEEN, _ESCAPE = "\x00", "\x01"


def _escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_BETWEEN), F.lit(_ESCAPE + "a"))


def _unescaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(_ESCAPE + "a"), F.lit(_BETWEEN)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))


def known_names(statement_relations: DataFrame, columns: DataFrame, small: bool | None = None) -> DataFrame:
    """Quoted names that normalisation may keep, per statement: its relations and their columns.

    The result of one statement is bounded by the columns of the relations it names. Names travel as one text per relation.
    Where all of them are measured to fit, they are sent to the statements, which then shuffle only their relations; else
    they are joined. ``small`` overrides the measured choice, for tests.
    """
    listed = F.transform(F.concat(F.array("relation"), F.collect_set("column")), _escaped)
    per_relation = columns.groupBy("schema", "relation").agg(F.concat_ws(_BETWEEN, listed).alias("names"))
    if small is None:
        small = fits_broadcast(per_relation, "schema", "relation", "names")
    # As many tasks as were asked for: few bytes are shuffled by table, but each row gets all names of its relation.
    parts = int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if small:
        joined = statement_relations.repartition(parts, "id").join(F.broadcast(per_relation), ["schema", "relation"], "left")
    else:
        joined = statement_relations.join(per_relation, ["schema", "relation"], "left")
    told = joined.select("id", F.coalesce("names", _escaped(F.col("relation"))).alias("names"))
    told = told if small else told.repartition(parts, "id")
    texts = told.groupBy("id").agg(F.concat_ws(_BETWEEN, F.collect_list("names")).alias("names"), F.count("names").alias("n"))
    names = F.split("names", _BETWEEN)
    plain = F.when(F.contains("names", F.lit(_ESCAPE)), F.transform(names, _unescaped)).otherwise(names)
    return texts.select("id", F.when(F.col("n") > 0, F.array_sort(F.array_distinct(plain))).otherwise(F.array().cast("array<string>")).alias("known"))
