"""The first record of every key, kept in a table that outlives the stream.

The state is not in the stream but in a folder: every batch adds the first records of its own keys, in
crawl order, and a log of what has been added; after some batches these are merged into one base.  Whatever the
order of files, and however often the stream is stopped and started again, the table holds for each key
the record that ``dedup_products`` finds over all files: a record that lands later but is earlier in crawl order replaces the one known so far.
Nothing is forgotten and no record is too late.

A batch that is repeated after a crash writes its folder once more and changes nothing.  A merge is
written beside the old base and counts from its line in the log on.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.dedup import dedup_products
from ..session import work_path
from .live import _drain

LOG = "kind string, batch long, path string"
MERGE_EVERY = 16     # batches


class FirstRecords:
    """A table of first records below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str | Sequence[str], order: Sequence[str], merge_every: int = MERGE_EVERY):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.key, self.order, self.merge_every = key, order, merge_every

    def log(self) -> list:
        """The lines of the log: one per batch since the beginning, and one per merge."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log").distinct().collect()
        except Exception as problem:  # a folder that nothing was written to yet
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return []

    def _note(self, kind: str, batch: int, path: str) -> None:
        self.spark.createDataFrame([(kind, batch, path)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _parts(self) -> tuple[int, list[str]]:
        """The batch the newest base reaches to (-1 without one), and the paths that make up the table."""
        lines = self.log()
        bases = [line for line in lines if line["kind"] == "base"]
        base = max(bases, key=lambda line: (line["batch"], line["path"])) if bases else None
        upto = base["batch"] if base else -1
        added = sorted((line["batch"], line["path"]) for line in lines if line["kind"] == "batch" and line["batch"] > upto)
        return upto, [*([base["path"]] if base else []), *[path for _, path in added]]

    def read(self) -> DataFrame:
        _, paths = self._parts()
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        known = self.spark.read.schema(self.schema).parquet(*paths)
        return dedup_products(known, self.key, self.order)

    def add(self, rows: DataFrame, batch: int) -> None:
        """The first records of a batch; for ``foreachBatch``."""
        path = f"{self.folder}/batch-{batch}"
        dedup_products(rows, self.key, self.order).write.mode("overwrite").parquet(path)
        self._note("batch", batch, path)
        upto, _ = self._parts()
        if batch - upto >= self.merge_every:
            merged = f"{self.folder}/base-{batch}-{uuid.uuid4().hex}"
            self.read().write.parquet(merged)
            self._note("base", batch, merged)


def run_first_records(stream: DataFrame, key: str | Sequence[str], order: Sequence[str], folder: str | None = None,
                      merge_every: int = MERGE_EVERY, timeout_s: float | None = None) -> DataFrame:
    """Bring the table in ``folder`` up to all that has landed, and return it.

    Called again with the same folder, the stream goes on where it ended.
    """
    spark = stream.sparkSession
    folder = folder or work_path(spark, "first-records")
    table = FirstRecords(spark, folder, stream.schema, key, order, merge_every)
    query = (
        stream.writeStream.foreachBatch(table.add)
        .option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    )
    _drain(query, "first-records", timeout_s)
    return table.read()
