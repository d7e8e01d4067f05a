"""A table of the latest record of each key, written batch by batch.

Each batch is a run, a folder named for the batches it covers. When ``fan`` runs of one width are complete they are
written again as one wider run, so a record is written about log_fan(batches) times, however large the table
gets. The latest record is chosen on reading. A run counts once its write is complete; a batch written again replaces its
run, and one that a wider run covers already is left out. So repeating a batch changes nothing.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = re.compile(r"run-(\d+)-(\d+)$")


def latest_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The record of each key with the greatest ``order``; a null is the smallest. It combines map-side, so a key with very
    many records costs a row per partition. Records of equal order are told apart by their other columns' hash."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(F.col(order).isNotNull(), order, F.xxhash64(F.to_json(F.struct(*rest))))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_latest")).select(*keys, "_latest.*").select(*df.columns)


class LatestLog:
    """Records by ``keys`` under ``path``; of one key, the record with the greatest ``order`` counts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, fan: int = 8):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.spark, self.path, self.keys, self.order, self.fan = spark, path.rstrip("/"), list(keys), order, fan

    def runs(self) -> list[tuple[int, int]]:
        """Complete runs as (first, last) batch, wide ones before those they cover."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = _RUN.search(status.getPath().getName())
            if name and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
                found.append((int(name[1]), int(name[2])))
        return sorted(found, key=lambda r: (r[0], -r[1]))

    def chosen(self, before: int | None = None) -> list[tuple[int, int]]:
        """The fewest complete runs that cover all batches, or those before one batch."""
        out: list[tuple[int, int]] = []
        for run in self.runs():
            if (before is None or run[1] < before) and (not out or run[1] > out[-1][1]):
                out.append(run)
        return out

    def superseded(self) -> list[str]:
        """Folders that neither a new reader nor a repeat of the newest batch needs; they may be deleted once older readers
        are done."""
        runs = self.runs()
        newest = max((last for _, last in runs), default=0)
        wanted = {*self.chosen(), *self.chosen(newest)}
        return [self._folder(*r) for r in runs if r not in wanted]

    def read(self, before: int | None = None) -> DataFrame | None:
        """The latest record of each key, of all batches or of those before one. None where there is no batch."""
        runs = self.chosen(before)
        return self._latest(runs) if runs else None

    def append(self, batch: DataFrame, number: int, keep: Column | None = None) -> None:
        """Write one batch, then the wider runs that it completes. ``keep`` names the records a wider run still carries."""
        if not any(first <= number <= last and first < last for first, last in self.runs()):
            latest_of(batch, self.keys, self.order).write.mode("overwrite").parquet(self._folder(number, number))
        width = self.fan
        while (number + 1) % width == 0:
            first = number + 1 - width
            if (first, number) not in self.runs():
                parts = [r for r in self.chosen() if first <= r[0] and r[1] <= number]
                merged = self._latest(parts)
                (merged if keep is None else merged.where(keep)).write.mode("overwrite").parquet(self._folder(first, number))
            width *= self.fan

    def _latest(self, runs: list[tuple[int, int]]) -> DataFrame:
        return latest_of(self.spark.read.parquet(*(self._folder(*r) for r in runs)), self.keys, self.order)

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/run-{first}-{last}"
