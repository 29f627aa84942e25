"""Reading, writing and merging bars."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tickloom.functions import dims
from tickloom.operators import quality
from tickloom.sources import fixtures, merge, tables


def test_written_bars_come_back(spark, sf):
    bars = fixtures.bars_daily(spark, sf)
    root = tempfile.mkdtemp() + "/bars"
    tables.write_bars(bars, root)
    back = tables.read_bars(spark, root, tf="d")
    assert back.count() == bars.count()
    assert back.where("amount <> 0").count() == 0
    one = tables.read_bars(spark, root, symbol="nothing")
    assert one.count() == 0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="close"):
        tables.resolved(spark.createDataFrame([("s", "d", "2024-01-01", 1.0, 1.0, 1.0, 1.0)], "symbol string, tf string, date string, open double, high double, low double, vol double"))


def test_old_rows_without_time_go_when_new_ones_have_it(spark):
    rows = lambda *r: spark.createDataFrame([("s", "f60", t, h, 1.0, 1.0, 1.0, 1.0, 1.0) for t, h in r], "symbol string, tf string, t string, has_time boolean, open double, high double, low double, close double, vol double").withColumn("ts", F.to_timestamp("t").cast("timestamp_ntz"))
    found = merge.merged(rows(("2024-01-01", False), ("2024-01-02 10:00:00", True)), rows(("2024-01-03 10:00:00", True)))
    assert found.count() == 2


def test_dates(spark):
    rows = spark.createDataFrame([("2024-01-02",), ("2024/01/02 10:00",), ("x",), (None,)], "t string")
    assert [str(r[0]) for r in rows.select(quality.parsed_date(F.col("t"))).collect()] == ["2024-01-02", "2024-01-02", "None", "None"]


def test_timeframes(spark):
    rows = spark.createDataFrame([("60F",), ("周线",), ("Month",), ("1d",)], "t string")
    assert [r[0] for r in rows.select(dims.parse_timeframe(F.col("t"))).collect()] == ["f60", "w", "m", None]
    assert dims.timeframe_dimension(spark).count() == 8


def test_abbreviation(spark):
    rows = spark.createDataFrame([("平安A1银行",)], "t string")
    found = rows.select(dims.abbreviation(F.col("t"), {"平": "p", "安": "a", "银": "y", "行": "h"})).first()[0]
    assert found == "paa1yh"
