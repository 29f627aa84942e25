"""Merging, patching, trimming and choosing between bar sources, as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import dims
from tickloom.functions.windows import KEY

# Sources by priority, for minute and for longer timeframes.
MINUTE_SOURCES = ("eastmoney", "sina", "tencent", "tushare")
DAY_SOURCES = ("tushare", "sina", "tencent", "eastmoney")
DAYS_A_MONTH = 30


def merged(old: DataFrame, new: DataFrame, prefer: str = "new") -> DataFrame:
    """Union by series and time, the newer row wins (or the older).

    Old rows without a time of day go where the series gets any new row with one. Of rows at one time in one
    batch, the one with the largest values stays, so reruns agree.
    """
    batch = lambda df, k: df.select(*KEY, "ts", "has_time", "open", "high", "low", "close", "vol").withColumn("batch", F.lit(k))
    rows = batch(old, 0).unionByName(batch(new, 1))
    timed = F.max((F.col("batch") == 1) & F.col("has_time")).over(Window.partitionBy(*KEY))
    rows = rows.withColumn("_timed", timed).where(~((F.col("batch") == 0) & ~F.col("has_time") & F.col("_timed")))
    first = F.col("batch").desc() if prefer == "new" else F.col("batch").asc()
    rank = Window.partitionBy(*KEY, "ts").orderBy(first, *[F.col(c).desc() for c in ("close", "open", "high", "low", "vol")])
    return rows.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k", "_timed", "batch")


def since(bars: DataFrame, start: str) -> DataFrame:
    return bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))


def next_starts(bars: DataFrame) -> DataFrame:
    """Where the next fetch of each series begins: the day before its last."""
    return bars.groupBy(*KEY).agg(F.date_sub(F.to_date(F.max("ts")), 1).alias("start_date"))


def priorities() -> tuple:
    of = lambda names: dims.mapping({n: k for k, n in enumerate(names)})
    return of(MINUTE_SOURCES), of(DAY_SOURCES)


def best_source(landed: DataFrame) -> DataFrame:
    """Rows of the first non-empty source of each series; ``landed`` has a column ``source``.

    One source has no monthly rows for this purpose and another only daily ones above minutes; concept boards
    take one source only.
    """
    minute, longer = priorities()
    rank = F.when(F.col("tf").startswith("f"), F.try_element_at(minute, F.col("source"))).otherwise(F.try_element_at(longer, F.col("source")))
    allowed = ~((F.col("source") == "sina") & (F.col("tf") == "m")) & ~((F.col("source") == "eastmoney") & F.col("tf").isin("w", "m"))
    concept = dims.is_concept_board(F.col("symbol"))
    rows = landed.withColumn("rank", rank).where(F.when(concept, F.col("source") == "eastmoney").otherwise(allowed & rank.isNotNull()))
    return rows.withColumn("_best", F.min("rank").over(Window.partitionBy(*KEY))).where("rank = _best").drop("rank", "_best")


def patched_today(bars: DataFrame, other: DataFrame, day: str) -> DataFrame:
    """Daily series that lack the bar of ``day`` get it from another source."""
    at = F.lit(day).cast("date")
    have = bars.where(F.to_date("ts") == at).select(*KEY).distinct()
    daily = bars.where("tf = 'd'").select(*KEY).distinct()
    extra = other.where((F.col("tf") == "d") & (F.to_date("ts") == at)).join(daily, KEY, "left_semi").join(have, KEY, "left_anti")
    return merged(bars, extra)


def sync_status(stored: DataFrame, fetched: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted series: ok with the number of fetched rows, skip if nothing newer came, fail if nothing came."""
    new = fetched.groupBy(*KEY).agg(F.count("*").alias("rows"), F.max("ts").alias("new_ts"))
    old = stored.groupBy(*KEY).agg(F.max("ts").alias("old_ts"))
    joined = wanted.join(new, KEY, "left").join(old, KEY, "left")
    status = F.when(F.col("new_ts").isNull(), "fail").when(F.col("old_ts") >= F.col("new_ts"), "skip").otherwise("ok")
    return joined.select(*KEY, status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), "old_ts", "new_ts")


def trimmed(bars: DataFrame, months: dict[str, int], as_of: str) -> DataFrame:
    """Rows within each timeframe's retention, counted in months of 30 days; 0 or no entry keeps all."""
    keep = F.coalesce(F.try_element_at(dims.mapping(months), F.col("tf")), F.lit(0))
    oldest = F.date_sub(F.lit(as_of).cast("date"), (keep * DAYS_A_MONTH).cast("int"))
    return bars.where((keep == 0) | (F.to_date("ts") >= oldest))


def trim_report(bars: DataFrame, months: dict[str, int], as_of: str) -> DataFrame:
    """Per timeframe: rows before and after, series that lose rows, series that lose all."""
    after = trimmed(bars, months, as_of).groupBy(*KEY).agg(F.count("*").alias("after"))
    per = bars.groupBy(*KEY).agg(F.count("*").alias("before")).join(after, KEY, "left").fillna(0, ["after"])
    return per.groupBy("tf").agg(F.sum("before").alias("rows_before"), F.sum("after").alias("rows_after"), F.count_if((F.col("after") < F.col("before")) & (F.col("after") > 0)).alias("trimmed"), F.count_if(F.col("after") == 0).alias("removed"))


def listed_codes(*listings: DataFrame) -> DataFrame:
    found = listings[0].select("symbol")
    for other in listings[1:]:
        found = found.unionByName(other.select("symbol"))
    return found.dropDuplicates(["symbol"])


def without_delisted(bars: DataFrame, listed: DataFrame) -> DataFrame:
    return bars.join(listed, "symbol", "left_semi")


def delisted(bars: DataFrame, listed: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().join(listed, "symbol", "left_anti")
