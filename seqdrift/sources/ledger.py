"""Partial results that come in shard by shard, each counted once.

A ledger is a folder with the data of shards and a log. Adding a shard writes its data to a folder of its own and then one
row of the log; only what the log names exists. So a merge that fails half-way leaves data that nobody reads, and a
shard that is handed in again, even by two jobs at once, counts once: of several rows for one shard the first by path is read.
Compacting writes the sum of all shards so far and logs it with the list of what it covers; readers take the sum that
covers most and the shards it does not cover, whatever ran side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("shard", T.StringType()), T.StructField("path", T.StringType()), T.StructField("covers", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class Ledger:
    """`merge` adds up rows of several shards, as `profile.merge`, `stats.merge_moments` or `stats.merge_sketches` do."""

    spark: SparkSession
    root: str
    merge: Callable[[DataFrame], DataFrame]

    def _log(self) -> list:
        """One row per shard and per compaction: as many as there were hand-ins."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return []
        return self.spark.read.schema(LOG).parquet(f"{self.root}/log").collect()

    def _commit(self, shard: str | None, path: str, covers: list[str] | None) -> None:
        self.spark.createDataFrame([(shard, path, covers)], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _current(self) -> tuple[str | None, set[str], dict[str, str]]:
        """The sum that covers most, what it covers, and the paths of the other shards."""
        rows = self._log()
        sums = sorted((r for r in rows if r["covers"] is not None), key=lambda r: (-len(r["covers"]), r["path"]))
        base, covered = (sums[0]["path"], set(sums[0]["covers"])) if sums else (None, set())
        left: dict[str, str] = {}
        for r in rows:
            if r["covers"] is None and r["shard"] not in covered:
                left[r["shard"]] = min(r["path"], left.get(r["shard"], r["path"]))
        return base, covered, left

    def shards(self) -> list[str]:
        _, covered, left = self._current()
        return sorted(covered | set(left))

    def add(self, shard: str, rows: DataFrame) -> bool:
        """Hands in a shard. False if it is in already; its rows are not computed then."""
        _, covered, left = self._current()
        if shard in covered or shard in left:
            return False
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._commit(shard, path, None)
        return True

    def total(self) -> DataFrame:
        """The sum of all shards handed in so far."""
        base, _, left = self._current()
        paths = [p for p in [base, *sorted(left.values())] if p is not None]
        if not paths:
            raise ValueError("the ledger is empty")
        return self.merge(self.spark.read.parquet(*paths))

    def compact(self) -> None:
        """One sum in place of the shards so far. What it replaces is left in place for those who still read it."""
        base, covered, left = self._current()
        if left:
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            paths = [p for p in [base, *sorted(left.values())] if p is not None]
            self.merge(self.spark.read.parquet(*paths)).write.parquet(path)
            self._commit(None, path, sorted(covered | set(left)))
