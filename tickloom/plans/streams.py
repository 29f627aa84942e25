"""The registered queries of the streaming operators: each runs a stream over rows that arrive in slices, to their end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.windows import KEY
from tickloom.sources import fixtures
from tickloom.sources.shared import Folder, shared_folder
from tickloom.streaming import bars as live
from tickloom.streaming import state
from tickloom.streaming.store import BarStore

Query = Callable[[SparkSession, str], DataFrame]


class Arrivals:
    """Runs a stream over rows that arrive in slices: after each slice the query stops, and goes on from its checkpoint with the next."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)

    def run(self, rows: DataFrame, slices: list[Column], told: Callable[[DataFrame], DataFrame], mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
        """All that ``told`` makes of the slices (conditions) of ``rows``: each micro-batch in a folder of its own, which a replay writes again."""
        source, out, dealt, folder = f"{self.folder}/in", f"{self.folder}/out", f"slices-{uuid.uuid4().hex}", Folder(self.spark, self.folder)
        keep = sink or (lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
        # the rows are worked out once, whatever the number of slices; a slice arrives when its files are moved to where the stream looks
        of = F.explode(F.array_compact(F.array(*[F.when(condition, k) for k, condition in enumerate(slices)])))
        rows.withColumn("_slice", of).write.partitionBy("_slice").parquet(f"{self.folder}/{dealt}")
        for k in range(len(slices)):
            if folder.has(dealt, f"_slice={k}"):
                folder.move(f"{dealt}/_slice={k}", f"in/{dealt}-{k}")
            else:
                self.spark.createDataFrame([], rows.schema).write.parquet(f"{source}/{dealt}-{k}")
            stream = told(self.spark.readStream.schema(rows.schema).parquet(f"{source}/*"))
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/checkpoint")
            writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
        return None if sink else self.spark.read.schema(stream.schema).parquet(f"{out}/*")


def by_position(*ends: int) -> list[Column]:
    """Slices of the rows up to each position, and of the rest."""
    starts = (-1, *ends)
    return [(F.col("idx") > a) & (F.col("idx") <= b) for a, b in zip(starts, (*ends, 1 << 30))]


def stream_merged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: inclusion removal of bars that arrive in three slices."""
    a = Arrivals(spark)
    told = a.run(fixtures.bars_walk(spark, sf_dir), by_position(70, 171), state.running_merged_bars, "update")
    rows = state.latest(told, *KEY, "pos")
    return rows.withColumn("amount", F.round("amount", 6)).select(*KEY, "pos", "idx", "ts", "high", "low", "members", "vol", "amount")


def stream_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: MACD of bars that arrive in three slices, the first shorter than the means need."""
    a = Arrivals(spark)
    told = a.run(fixtures.bars_walk(spark, sf_dir), by_position(10, 133), state.running_indicators, "update")
    return state.latest(told, *KEY, "idx").select(*KEY, "idx", *[F.round(c, 6).alias(c) for c in ("dif", "dea", "macd_hist")], F.col("obv").alias("obv"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored bars up to a day, and bars that arrive from an earlier day on with other closes."""
    bars = fixtures.bars_daily(spark, sf_dir).withColumn("has_time", F.lit(False)).drop("idx", "amount")
    return bars.where("ts < timestamp'1996-01-01'"), bars.where("ts >= timestamp'1995-01-01'").withColumn("close", F.col("close") + 1)


def by_day(*starts: str) -> list[Column]:
    ends = [*starts[1:], "2100-01-01"]
    return [F.col("ts").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz") - F.expr("interval 1 second")) for a, b in zip(starts, ends)]


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: bars that arrive in three slices merged into the stored table, newest first."""
    a = Arrivals(spark)
    store = BarStore(spark, f"{a.folder}/store")
    old, new = halves(spark, sf_dir)
    store.merge_batch(old, 0, "first load")
    a.run(new, by_day("1995-01-01", "1996-06-01", "1997-06-01"), lambda stream: stream, sink=store.sink())
    return store.read().drop("has_time")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: of rows that arrive, those not older than the day before the last stored day of their series."""
    a = Arrivals(spark)
    old, new = halves(spark, sf_dir)
    last = old.groupBy(*KEY).agg(F.max("ts").alias("ts"))
    # the last slice is older than all before it
    slices = by_day("1995-01-01", "1996-06-01", "1997-06-01")
    return a.run(new, [slices[1], slices[2], slices[0]], lambda stream: state.without_late_rows(stream, last)).drop("has_time")


def stream_live_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: half-hour bars of ticks that arrive in three slices, in update mode."""
    a = Arrivals(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("vol"))
    slices = [F.pmod(F.xxhash64("seq"), F.lit(3)) == k for k in range(3)]  # in no order at all: the watermark waits a year
    told = a.run(ticks, slices, lambda stream: live.live_bars(stream, 30, "366 days").withColumn("seen", F.col("vol")), "update")
    return state.latest(told, *KEY, "ts").select(*KEY, F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "vol")


QUERIES: dict[str, Query] = {
    "stream_live_bars": stream_live_bars,
    "stream_upsert": stream_upsert,
    "stream_late_rows": stream_late_rows,
    "stream_merged_bars": stream_merged_bars,
    "stream_indicators": stream_indicators,
}
