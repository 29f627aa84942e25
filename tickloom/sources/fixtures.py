"""Bar tables that Spark derives from the given tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.windows import with_index

TRADES_PER_BAR, FIRST_PRICE = 2, 2000
PREFIXES = ("600", "000", "300", "688", "830")
#: A trade's place in its series; the tuple is unique.
TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def trades(spark: SparkSession, sf_dir: str, suppliers: int = 1) -> DataFrame:
    """symbol, tf, n, ts, move, price, vol, amount: a walk of integer prices per series, a series per so many suppliers."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.floor(F.col("l_suppkey") / suppliers)  # the number of series grows with the table, their length does not
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (k % len(PREFIXES) + 1).cast("int"))
    order = Window.partitionBy("symbol", "tf").orderBy(*TRADE_ORDER)
    rows = items.withColumn("symbol", F.concat(prefix, F.lpad(k.cast("string"), F.greatest(F.lit(3), F.length(k.cast("string"))), F.lit("0")))).withColumn("tf", F.lit("d"))
    rows = rows.withColumn("move", F.round(100 * F.col("l_discount")) - 5)
    return rows.select(
        "symbol", "tf", (F.row_number().over(order) - 1).alias("n"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), "move",
        (FIRST_PRICE + F.sum("move").over(order)).alias("price"), (F.col("l_quantity") * F.col("move") * F.col("move")).alias("vol"),
        F.col("l_extendedprice").alias("amount"),
    )


def rolled(rows: DataFrame, *bar: str) -> DataFrame:
    """Bars of trades that share ``bar``: the open is the price before the first trade."""
    before = F.col("price") - F.col("move")
    return rows.groupBy("symbol", "tf", *bar).agg(
        F.max_by("ts", "n").alias("last_ts"), F.min_by(before, "n").alias("open"),
        F.greatest(F.max("price"), F.min_by(before, "n")).alias("high"), F.least(F.min("price"), F.min_by(before, "n")).alias("low"),
        F.max_by("price", "n").alias("close"), F.sum("vol").alias("vol"), F.round(F.sum("amount"), 2).alias("amount"),
    )


def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, tf, idx, ts, open, high, low, close, vol, amount; two trades a bar, times may repeat."""
    rows = trades(spark, sf_dir).withColumn("idx", F.floor(F.col("n") / TRADES_PER_BAR).cast("int"))
    return rolled(rows, "idx").withColumnRenamed("last_ts", "ts").select("symbol", "tf", "idx", "ts", "open", "high", "low", "close", "vol", "amount")


def bars_fine(spark: SparkSession, sf_dir: str, suppliers: int = 1) -> DataFrame:
    """The same with a bar a trade."""
    rows = trades(spark, sf_dir, suppliers)
    before = F.col("price") - F.col("move")
    return rows.select(
        "symbol", "tf", F.col("n").cast("int").alias("idx"), "ts", before.alias("open"), F.greatest("price", before).alias("high"), F.least("price", before).alias("low"),
        F.col("price").alias("close"), "vol", F.round("amount", 2).alias("amount"),
    )


def bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest series, in which trend walks come about: a bar a trade of eight suppliers."""
    return bars_fine(spark, sf_dir, 8)


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a bar a day and series, so times are unique."""
    bars = rolled(trades(spark, sf_dir), "ts").drop("last_ts")
    return with_index(bars, "ts").select("symbol", "tf", "idx", "ts", "open", "high", "low", "close", "vol", "amount")


def bars_events(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Bars of the event values by time bucket; the symbol is the event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("at"), "value", "event_id")
    step = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("at").cast("timestamp")) / step) * step).cast("timestamp_ntz")
    key = F.struct("at", "event_id")
    bars = events.groupBy("symbol", F.lit(f"f{minutes}").alias("tf"), start.alias("ts")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"),
        F.count("*").cast("double").alias("vol"), F.lit(0.0).alias("amount"),
    )
    return with_index(bars, "ts").select("symbol", "tf", "idx", "ts", "open", "high", "low", "close", "vol", "amount")


def damaged(bars: DataFrame) -> DataFrame:
    """Daily bars with planted faults by row number: swapped, zero, repeated and missing rows; ``seq`` is the file order."""
    r = F.col("idx")
    rows = bars.where(r % 109 != 0)
    swap, zero = r % 101 == 0, r % 103 == 0
    price = lambda c, other: F.when(zero, 0.0).when(swap, F.col(other)).otherwise(F.col(c))
    rows = rows.select(
        "symbol", "tf", "idx", "ts", F.when(zero, 0.0).otherwise(F.col("open")).alias("open"), price("high", "low").alias("high"), price("low", "high").alias("low"),
        F.when(zero, 0.0).otherwise(F.col("close")).alias("close"), F.when(zero, 0.0).otherwise(F.col("vol")).alias("vol"), "amount",
    )
    copies = F.explode(F.when(F.col("idx") % 107 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).withColumn("seq", F.col("idx") * 2 + F.col("copy")).drop("copy", "idx")


#: What goes wrong in a landed payload: (pattern, replacement) of its text by layout. The price 2000 is no number,
#: and of each 13th of a month only the date is left, with one number at most.
PAYLOAD_DAMAGE = {
    "objects": ((r'"2000\.0"', '"--"'), (r'\{"day":"(\d{4}-\d{2}-13)"[^}]*\}', '{"day":"$1"}')),
    "keyed_rows": ((r'"2000\.0"', '"--"'), (r'\["(\d{4}-\d{2}-13)"[^\]]*\]', '["$1","1"]')),
    "lines": ((r'(?<=,)2000\.0(?=[,"])', "--"), (r'"(\d{4}-\d{2}-13),[^"]*"', '"$1,1"')),
    "table": ((r'"2000\.0"', '"--"'), (r'\["(\d{6}13)"[^\]]*\]', '["$1"]')),
}


def damaged_payloads(landed: DataFrame, layout: str) -> DataFrame:
    """Landed payloads with bad numbers and short rows; of every tenth series the text is ``null``, of another tenth it is empty."""
    text = F.col("payload")
    for pattern, replacement in PAYLOAD_DAMAGE[layout]:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    last = F.substring("symbol", -1, 1)
    return landed.withColumn("payload", F.when(last == "3", "null").when(last == "4", "").otherwise(text))


def trades_sql(suppliers: int = 1) -> str:
    return """
trades AS (
  SELECT ['600', '000', '300', '688', '830'][l_suppkey % 5 + 1] || lpad(l_suppkey::VARCHAR, greatest(3, length(l_suppkey::VARCHAR))::INTEGER, '0') AS symbol, 'd' AS tf,
    row_number() OVER w - 1 AS n, l_shipdate::TIMESTAMP AS ts, round(100 * l_discount) - 5 AS move,
    2000 + sum(round(100 * l_discount) - 5) OVER w AS price, l_quantity * (round(100 * l_discount) - 5) * (round(100 * l_discount) - 5) AS vol, l_extendedprice AS amount
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""".replace("l_suppkey %", f"(l_suppkey // {suppliers}) %").replace("l_suppkey::VARCHAR", f"(l_suppkey // {suppliers})::VARCHAR").replace(
        "PARTITION BY l_suppkey", f"PARTITION BY l_suppkey // {suppliers}"
    )


TRADES_SQL = trades_sql()
BARS_SQL = TRADES_SQL + """, bars AS (
  SELECT symbol, tf, (n // 2)::INTEGER AS idx, arg_max(ts, n) AS ts, arg_min(price - move, n) AS open, greatest(max(price), arg_min(price - move, n)) AS high,
    least(min(price), arg_min(price - move, n)) AS low, arg_max(price, n) AS close, sum(vol) AS vol, round(sum(amount), 2) AS amount
  FROM trades GROUP BY symbol, tf, n // 2)"""
DAILY_SQL = TRADES_SQL + """, daily AS (
  SELECT *, (row_number() OVER (PARTITION BY symbol, tf ORDER BY ts) - 1)::INTEGER AS idx FROM (
  SELECT symbol, tf, ts, arg_min(price - move, n) AS open, greatest(max(price), arg_min(price - move, n)) AS high,
    least(min(price), arg_min(price - move, n)) AS low, arg_max(price, n) AS close, sum(vol) AS vol, round(sum(amount), 2) AS amount
  FROM trades GROUP BY symbol, tf, ts))"""
DAMAGED_SQL = DAILY_SQL + """, damaged AS (
  SELECT symbol, tf, ts, CASE WHEN idx % 103 = 0 THEN 0 ELSE open END AS open,
    CASE WHEN idx % 103 = 0 THEN 0 WHEN idx % 101 = 0 THEN low ELSE high END AS high, CASE WHEN idx % 103 = 0 THEN 0 WHEN idx % 101 = 0 THEN high ELSE low END AS low,
    CASE WHEN idx % 103 = 0 THEN 0 ELSE close END AS close, CASE WHEN idx % 103 = 0 THEN 0 ELSE vol END AS vol, amount, idx * 2 + c AS seq
  FROM daily, (VALUES (0), (1)) t(c) WHERE idx % 109 <> 0 AND (c = 0 OR idx % 107 = 0))"""


def events_sql(minutes: int, name: str = "events_bars") -> str:
    return f"""
{name} AS (
  SELECT *, (row_number() OVER (PARTITION BY symbol, tf ORDER BY ts) - 1)::INTEGER AS idx FROM (
  SELECT event_type AS symbol, 'f{minutes}' AS tf, to_timestamp(floor(epoch(ts) / {60 * minutes}) * {60 * minutes}) AT TIME ZONE 'UTC' AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS vol, 0.0::DOUBLE AS amount
  FROM events GROUP BY ALL))"""


EVENTS_SQL = events_sql(30)
