"""Live bars from ticks, and rows that arrive more than once. See ``state`` for what a series must remember and ``store`` for the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bars(ticks: DataFrame, minutes: int, delay: str = "1 day") -> DataFrame:
    """Bars of ticks (symbol, ts, seq, price, vol) in tumbling windows; ``seq`` orders ticks of one time.

    In update mode a bar is told each time it changes, and its state goes when the watermark passes its end by ``delay``: ticks later than that are dropped.
    """
    order = F.struct("ts", "seq")
    windowed = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    bars = windowed.groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("vol").alias("vol")
    )
    return bars.select("symbol", F.lit(f"f{minutes}").alias("tf"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "vol")


def without_late_repeats(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows within the watermark, each (symbol, tf, ts) once."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "tf", "ts"])
