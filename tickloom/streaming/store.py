"""The bar table that streams write: micro-batches are merged into it so that a replay changes nothing.

The table is partitioned by timeframe and month. A commit works in three steps, each of which can be done again:
the merged rows of every touched partition are written to a staging folder, which is then declared ready; the staged
partitions are moved into the table one by one; the batch is marked as committed. A batch that comes again after a crash
goes on with the step that was not finished; once marked it is passed over. One writer at a time; a reader may
meet a table in which some partitions of a batch are there and others not yet.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tickloom.functions.windows import KEY
from tickloom.sources.merge import merged
from tickloom.sources.shared import Folder
from tickloom.sources.tables import resolved

NUMBERS = ("Open", "High", "Low", "Close", "Volume")
SCHEMA = StructType([StructField(c, StringType()) for c in ("symbol", "datetime")] + [StructField(c, DoubleType()) for c in NUMBERS] + [StructField(c, StringType()) for c in ("tf", "month")])


class BarStore:
    """Bars of many series below ``root``: tf=.../month=.../."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.folder = spark, root, Folder(spark, root)

    def raw(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.root) if self.folder.has() else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        """symbol, tf, ts, has_time, open..vol of all stored bars; no rows if nothing is stored yet."""
        return resolved(self.raw()).drop("amount")

    def last_days(self) -> DataFrame:
        """symbol, tf, ts: the last stored time of each series."""
        return self.read().groupBy(*KEY).agg(F.max("ts").alias("ts"))

    def merge_batch(self, batch: DataFrame, batch_id: int, stream: str = "bars") -> None:
        """Merges ``batch`` (symbol, tf, ts, has_time, open..vol) into the table, newest first, once for each ``batch_id`` of ``stream``."""
        mark, staging = f"_committed/{stream}/{batch_id}", f"_staging/{stream}-{batch_id}"
        if self.folder.has(mark):
            return
        if not self.folder.has(staging, "ready"):
            self._stage(batch, staging)
        self._swap(staging)
        self.folder.fs.mkdirs(self.folder.at("_committed", stream))
        self.folder.write(mark, "")
        self.folder.delete(staging)

    def _stage(self, batch: DataFrame, staging: str) -> None:
        self.folder.delete(staging)
        month = lambda ts: F.date_format(ts, "yyyy-MM")
        # written once: the batch is what a stream's state gives, and is not worked out again for each use
        arrived = batch.select(*KEY, "ts", "has_time", "open", "high", "low", "close", "vol")
        arrived.write.parquet(f"{self.root}/{staging}/arrived")
        arrived = self.spark.read.schema(arrived.schema).parquet(f"{self.root}/{staging}/arrived")
        # a series that gets its first times of day loses its rows without one, whatever their month
        timed = arrived.where("has_time").select(*KEY).distinct()
        losing = self.raw().where(F.length("datetime") <= 10).join(timed, KEY, "left_semi").select("tf", "month")
        touched = [tuple(r) for r in arrived.select("tf", month("ts").alias("month")).union(losing).distinct().collect()]  # partitions, not rows
        if touched:
            stored = self.raw().where(F.concat_ws("/", "tf", "month").isin([f"{t}/{m}" for t, m in touched]))
            rows = merged(resolved(stored), arrived)
            text = F.when(F.col("has_time"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
            out = rows.select("symbol", text.alias("datetime"), *[F.col(c.lower() if c != "Volume" else "vol").cast("double").alias(c) for c in NUMBERS], "tf", month("ts").alias("month"))
            dealt = out.repartition("tf", "month", F.pmod(F.xxhash64("symbol"), F.lit(16))).sortWithinPartitions("tf", "month", "symbol", "datetime")
            dealt.write.partitionBy("tf", "month").parquet(f"{self.root}/{staging}/data")
        filled = [[t, m, self.folder.has(staging, "data", f"tf={t}/month={m}")] for t, m in touched]
        self.folder.write(f"{staging}/ready", json.dumps(filled))

    def _swap(self, staging: str) -> None:
        for tf, month, filled in json.loads(self.folder.read(f"{staging}/ready")):
            part = f"tf={tf}/month={month}"
            if not filled:
                self.folder.delete(part)
            elif self.folder.has(staging, "data", part):  # else it was moved before a crash
                self.folder.move(f"{staging}/data/{part}", part)

    def sink(self, stream: str = "bars") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda batch, batch_id: self.merge_batch(batch, batch_id, stream)
