"""Reading and writing bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.shared import Folder

BARS = "symbol string, tf string, ts timestamp_ntz, has_time boolean, open double, high double, low double, close double, vol double, amount double"
# Names a file may use for a column, the first that it has wins.
ALIASES = {
    "ts": ("dt", "datetime", "date", "time", "timestamp"),
    "open": ("open", "Open"),
    "close": ("close", "Close"),
    "high": ("high", "High"),
    "low": ("low", "Low"),
    "vol": ("vol", "volume", "Volume"),
    "amount": ("amount", "Amount", "turnover"),
}


def time_columns(column: str, kind: str) -> tuple[Column, Column]:
    """(ts, has_time): the time without a zone, and whether the source gave a time of day."""
    c = F.col(column)
    if kind == "string":
        text = F.regexp_replace(F.trim(c), "/", "-")
        return F.try_to_timestamp(text).cast("timestamp_ntz"), F.length(text) > 10
    if kind == "date":
        return c.cast("timestamp_ntz"), F.lit(False)
    return c.cast("timestamp_ntz"), F.lit(True)


def number(column: str | None) -> Column:
    return F.lit(0.0) if column is None else F.coalesce(F.expr(f"try_cast(`{column}` as double)"), F.lit(0.0))


def resolved(rows: DataFrame) -> DataFrame:
    """Bars from a table with any of the known column names: symbol, tf, ts, has_time, open..amount, ``amount`` 0.0 if missing.

    Missing or unreadable numbers are 0.0. A table without a time or price column raises.
    """
    found = {name: next((a for a in names if a in rows.columns), None) for name, names in ALIASES.items()}
    missing = [n for n, a in found.items() if a is None and n != "amount"]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    ts, has_time = time_columns(found["ts"], dict(rows.dtypes)[found["ts"]])
    numbers = [number(found[n]).alias(n) for n in ("open", "high", "low", "close", "vol", "amount")]
    return rows.select("symbol", "tf", ts.alias("ts"), has_time.alias("has_time"), *numbers)


def read_bars(spark: SparkSession, root: str, symbol: str | None = None, tf: str | None = None) -> DataFrame:
    """Bars below ``root``, partitioned by ``tf``; the filters reach the scan. A series that isn't there gives no rows, nor does a root."""
    if not Folder(spark, root).has():
        return spark.createDataFrame([], BARS)
    rows = spark.read.parquet(root)
    rows = rows.where(F.col("tf") == tf) if tf else rows
    return resolved(rows.where(F.col("symbol") == symbol) if symbol else rows)


def write_bars(bars: DataFrame, root: str) -> None:
    """Overwrites the partitions (timeframes) that ``bars`` has; sorted by symbol and time, for pruning by row groups."""
    stored = bars.select("symbol", "tf", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("vol").alias("Volume"))
    dealt = stored.repartition("tf", F.pmod(F.xxhash64("symbol"), F.lit(64))).sortWithinPartitions("tf", "symbol", "datetime")
    dealt.write.partitionBy("tf").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)
