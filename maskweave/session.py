"""Session settings, checkpointing and the size check behind every broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows and in bytes of text, that is sent whole to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", app: str = "maskweave", **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, in four tasks for each, where the files give fewer splits than there are cores.

    For work that is heavy per row, such as searching text. A table of many files is left as it is, so
    no shuffle is added where it would cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read back.

    The folder is the one named in ``spark.checkpoint.dir``, which must be shared by all executors.
    Only a local session without that setting gets a temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """:func:`cut_lineage` for a large table: a compressed Parquet table in the checkpoint folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="maskweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fits_broadcast(df: DataFrame, *text_columns: str, rows: int | None = None, size: int | None = None) -> bool:
    """Whether ``df`` is small enough to broadcast: measured, never assumed.

    Reading stops at the row bound, so the check itself stays cheap on a table of any size.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    size = BROADCAST_BYTES if size is None else size
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in text_columns), F.lit(0))
    n, total = (
        df.select(width.cast("long").alias("width"))
        .limit(rows + 1)
        .agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0)))
        .first()
    )
    return n <= rows and total <= size
