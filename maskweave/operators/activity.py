"""The activity log: filters, the record that counts, pages, retention, and records in words."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGE, MAX_PAGE = 200, 500


def filtered(
    log: DataFrame, session: str = "", connection: str = "", decision: str = "", since: str | datetime | None = None
) -> DataFrame:
    """Records that match; an empty filter matches all. A log partitioned by day skips the days before."""
    out = log
    for column, value in (("session_id", session), ("connection", connection), ("decision", decision)):
        if value:
            out = out.where(F.col(column) == value)
    if since is not None:
        moment = F.lit(since).cast("timestamp")
        out = out.where(F.col("at") >= moment)
        if "day" in log.columns:
            out = out.where(F.col("day") >= F.to_date(moment))
    return out


def latest(log: DataFrame) -> DataFrame:
    """The last appended record of each id. An aggregate and no window: it combines map-side, so an id
    with very many records is never gathered in one task."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")


def page_limit(limit: int) -> int:
    return min(limit, MAX_PAGE) if limit > 0 else DEFAULT_PAGE


def page(log: DataFrame, offset: int = 0, limit: int = 0, **filters) -> DataFrame:
    """One page, newest first, with the total and the page's size on each row: the size is below the one asked for where that was
    over ``MAX_PAGE``. Filters apply before the latest record of an id is chosen."""
    rows = latest(filtered(log, **filters))
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(F.desc("at"), F.desc("seq")).offset(max(offset, 0)).limit(page_limit(limit)).withColumns({"total": total, "page_size": F.lit(page_limit(limit))})


def record(log: DataFrame, record_id: str) -> DataFrame:
    return latest(log.where(F.col("id") == record_id))


def kept(log: DataFrame, today: Column, days: int) -> DataFrame:
    """Records after pruning: a day goes once the whole of it lies more than ``days`` days back."""
    if days <= 0:
        raise ValueError("retention must be at least a day")
    return log.where(F.date_add(F.col("day"), 1) > F.date_sub(today, days))


def per_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("records"))
