"""Windows over one series; every operator orders by ``idx`` inside (symbol, tf), so they share one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["symbol", "tf"]


def by_index(*more: str):
    return Window.partitionBy(*KEY, *more).orderBy("idx")


def whole(*more: str):
    return Window.partitionBy(*KEY, *more)


def with_index(bars: DataFrame, *order: str) -> DataFrame:
    """Position in the series, from 0, after any filter."""
    return bars.withColumn("idx", (F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) - 1).cast("int"))


def dealt(rows: DataFrame, *more: str) -> DataFrame:
    """Series dealt over all shuffle partitions for a fold in Python, whose work goes by rows: partitions of few bytes must not be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY, *more)
