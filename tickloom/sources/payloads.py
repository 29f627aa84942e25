"""Bars from landed vendor payloads: one JSON text per series in column ``payload``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "vol")
# Where a keyed payload may hold its rows, the first that it has wins.
ROW_KEYS = ("qfqday", "day", "qfqweek", "week", "qfqmonth", "month")


def text_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def bars_of(rows: DataFrame, day: Column, **columns: Column) -> DataFrame:
    return rows.select("symbol", "tf", F.try_to_timestamp(day).cast("timestamp_ntz").alias("ts"), (F.length(day) > 10).alias("has_time"), *[text_number(columns[c]).alias(c) for c in PRICES])


def from_objects(payloads: DataFrame) -> DataFrame:
    """An array of objects with text fields day, open, high, low, close, volume; a bad number is 0."""
    schema = "array<struct<day string, open string, high string, low string, close string, volume string>>"
    rows = payloads.select("symbol", "tf", F.inline(F.from_json("payload", schema)))
    return bars_of(rows, F.col("day"), open=F.col("open"), high=F.col("high"), low=F.col("low"), close=F.col("close"), vol=F.col("volume"))


def from_keyed_rows(payloads: DataFrame) -> DataFrame:
    """data.<code>.<key>: rows [date, open, close, high, low, volume]; rows of fewer than six fields are skipped."""
    holder = F.from_json("payload", "data map<string, struct<" + ", ".join(f"{k}: array<array<string>>" for k in ROW_KEYS) + ">>")
    first = F.element_at(F.map_values(holder["data"]), 1)
    rows = payloads.select("symbol", "tf", F.explode(F.coalesce(*[first[k] for k in ROW_KEYS])).alias("r")).where(F.size("r") >= 6)
    at = lambda k: F.element_at("r", k)
    return bars_of(rows, at(1), open=at(2), close=at(3), high=at(4), low=at(5), vol=at(6))


def from_lines(payloads: DataFrame) -> DataFrame:
    """data.klines: texts "date,open,close,high,low,volume,...".."""
    lines = F.from_json("payload", "data struct<klines: array<string>>")["data"]["klines"]
    rows = payloads.select("symbol", "tf", F.explode(F.transform(lines, lambda x: F.split(x, ","))).alias("r")).where(F.size("r") >= 6)
    at = lambda k: F.element_at("r", k)
    return bars_of(rows, at(1), open=at(2), close=at(3), high=at(4), low=at(5), vol=at(6))


def from_table(payloads: DataFrame) -> DataFrame:
    """data.fields names the columns of data.items; dates are yyyyMMdd; a field that isn't there is 0, rows with open and close 0 are skipped."""
    parsed = payloads.select("symbol", "tf", F.from_json("payload", "data struct<fields: array<string>, items: array<array<string>>>")["data"].alias("data"))
    # the fields go into the generator with each item, else the text would be parsed anew for every row
    rows = parsed.select("symbol", "tf", F.inline(F.transform("data.items", lambda x: F.struct(F.col("data.fields").alias("f"), x.alias("r")))))
    at = lambda name: F.get("r", F.array_position("f", name).cast("int") - 1)
    day = F.regexp_replace(at("trade_date"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    found = bars_of(rows, day, open=at("open"), high=at("high"), low=at("low"), close=at("close"), vol=at("vol"))
    return found.where("open <> 0 or close <> 0")


READERS = {"objects": from_objects, "keyed_rows": from_keyed_rows, "lines": from_lines, "table": from_table}


def serialised(bars: DataFrame, layout: str) -> DataFrame:
    """One payload text per series in a vendor's layout, for landing zones and tests."""
    day = F.date_format("ts", "yyyy-MM-dd")
    s = {c: F.col(c).cast("string") for c in PRICES}
    ordered = lambda item: F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("x")))), lambda y: y["x"])
    per = bars.groupBy("symbol", "tf")
    if layout == "objects":
        item = F.struct(day.alias("day"), s["open"].alias("open"), s["high"].alias("high"), s["low"].alias("low"), s["close"].alias("close"), s["vol"].alias("volume"))
        return per.agg(F.to_json(ordered(item)).alias("payload"))
    row = F.array(day, s["open"], s["close"], s["high"], s["low"], s["vol"])
    if layout == "keyed_rows":
        held = per.agg(ordered(row).alias("x"))
        return held.select("symbol", "tf", F.to_json(F.struct(F.create_map("symbol", F.struct(F.col("x").alias("day"))).alias("data"))).alias("payload"))
    if layout == "lines":
        held = per.agg(ordered(F.array_join(row, ",")).alias("klines"))
        return held.select("symbol", "tf", F.to_json(F.struct(F.struct("klines").alias("data"))).alias("payload"))
    names = ("trade_date", "open", "high", "low", "close", "vol")
    held = per.agg(ordered(F.array(F.date_format("ts", "yyyyMMdd"), *[s[c] for c in PRICES])).alias("items"))
    return held.select("symbol", "tf", F.to_json(F.struct(F.struct(F.array(*map(F.lit, names)).alias("fields"), "items").alias("data"))).alias("payload"))
