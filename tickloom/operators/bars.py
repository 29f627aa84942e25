"""Bar features, resampling, catalog roll-ups and symbol search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import dims
from tickloom.functions.windows import KEY, by_index
from tickloom.operators.joins import spread_out

# Fixed value: bars of a series that a chart shows.
TAIL_BARS = 5000
#: Characters of the parts by which symbols are looked up.
GRAM = 3


def candle_features(bars: DataFrame) -> DataFrame:
    """Shape of each bar and its change against the previous close (null for the first bar)."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    before = F.lag("close").over(by_index())
    return bars.select(
        *KEY, "idx", (F.col("close") >= F.col("open")).alias("is_up"), F.abs(F.col("close") - F.col("open")).alias("body"),
        (F.col("high") - top).alias("upper_shadow"), (bottom - F.col("low")).alias("lower_shadow"),
        F.when(F.col("open") == 0, 0.0).otherwise((F.col("close") - F.col("open")) / F.col("open") * 100).alias("change_pct"),
        (F.col("close") - before).alias("change"), F.try_divide((F.col("close") - before) * 100, before).alias("change_vs_previous_pct"),
    )


def bars_between(bars: DataFrame, start: str | None = None, end: str | None = None, strict: bool = False) -> DataFrame:
    """Bars in an inclusive time range; minute levels lose rows without a time of day.

    A date-only end means the end of that day; ``strict`` compares it as midnight.
    """
    minute = F.col("tf").startswith("f")
    rows = bars.where(~minute | F.col("has_time")) if "has_time" in bars.columns else bars
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        last = F.lit(end).cast("timestamp_ntz")
        whole_day = len(end) <= 10 and not strict
        rows = rows.where(F.col("ts") < last + F.expr("interval 1 day")) if whole_day else rows.where(F.col("ts") <= last)
    return rows


def tail(bars: DataFrame, n: int = TAIL_BARS) -> DataFrame:
    """The last ``n`` bars of every series."""
    latest = Window.partitionBy(*KEY).orderBy(F.col("idx").desc())
    return bars.withColumn("_from_end", F.row_number().over(latest)).where(F.col("_from_end") <= n).drop("_from_end")


def resampled(bars: DataFrame, target: str) -> DataFrame:
    """Bars of a higher timeframe from every ``ratio`` consecutive bars; a short tail is kept, the first time is the label."""
    ratios = {tf: dims.MINUTES[target] // m for tf, m in dims.MINUTES.items() if m < dims.MINUTES[target] and dims.MINUTES[target] % m == 0}
    ratio = F.try_element_at(dims.mapping(ratios), F.col("tf"))
    checked = F.coalesce(ratio, F.raise_error(F.concat(F.lit(f"no whole number of bars of this timeframe makes one of {target}: "), F.col("tf"))).cast("int"))
    rows = bars.withColumn("chunk", F.floor(F.col("idx") / checked).cast("int"))
    return rows.groupBy("symbol", F.lit(target).alias("tf"), F.col("chunk").alias("idx")).agg(
        F.min_by("ts", "idx").alias("ts"), F.min_by("open", "idx").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "idx").alias("close"), F.sum("vol").alias("vol"), F.round(F.sum("amount"), 2).alias("amount"),
    )


def by_calendar(daily: DataFrame, unit: str) -> DataFrame:
    """Weekly (ISO weeks) or monthly bars from daily ones; the last date is the label."""
    return daily.groupBy("symbol", F.lit({"week": "w", "month": "m"}[unit]).alias("tf"), F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("period")).agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("vol").alias("vol"),
    )


def classified(symbols: DataFrame) -> DataFrame:
    """Board, market and vendor codes of symbols."""
    code = F.col("symbol")
    return symbols.select(
        "symbol", dims.board(code).alias("board"), dims.market(code).alias("market"), dims.prefixed_code(code).alias("prefixed"), dims.numeric_code(code).alias("numeric"),
        dims.suffixed_code(code).alias("suffixed"), dims.is_shanghai_index(code).alias("is_index"), dims.is_concept_board(code).alias("is_concept"),
        *[dims.listed_on(code, b).alias(f"on_{b}") for b in ("sh_main", "sz_main", "gem", "star", "bse")],
    )


def grams(text: Column, *sizes: int) -> Column:
    """The different parts of ``text`` of the given lengths."""
    parts = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[parts(n) if n else F.array(F.lit("")) for n in sizes])))


def searched(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """Symbols (symbol, name, abbreviation) that match each keyword, ranked: code prefix, abbreviation prefix, symbol.

    A keyword matches if the symbol, the name or, in lower case, the abbreviation contains it; the empty one matches all, null none.
    Every part of ``GRAM`` characters of the three texts is listed with its symbol, and every shorter one: a short keyword is looked up
    itself, a longer one by the rarest of its parts, and what is found is compared as a whole. Rows that repeat count once.
    """
    listed = names.select(F.struct("symbol", "name", "abbreviation").alias("row")).distinct()
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"row.{c}").alias("text")) for k, c in enumerate(("symbol", "name", "abbreviation"))])
    texts = listed.select("row", F.inline(fields)).where("text is not null")
    postings = texts.select("row", "field", "text", F.explode(grams(F.col("text"), *range(GRAM + 1))).alias("gram"))
    words = keywords.select("keyword").where("keyword is not null").distinct()
    asked = words.select("keyword", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("field"))
    asked = asked.withColumn("word", F.when(F.col("field") == 2, F.lower("keyword")).otherwise(F.col("keyword")))
    parts = asked.withColumn("gram", F.explode(F.when(F.length("word") < GRAM, F.array("word")).otherwise(grams(F.col("word"), GRAM))))
    often = postings.groupBy("field", "gram").agg(F.count("*").alias("n"))
    # a part that no text has makes an end of the keyword: of none there are fewest
    rarest = parts.join(often, ["field", "gram"], "left").groupBy("keyword", "field", "word").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    found = rarest.join(spread_out(postings), ["field", "gram"]).where(F.col("text").contains(F.col("word"))).select("keyword", "row.*").distinct()
    word = F.lower("keyword")
    rank = Window.partitionBy("keyword").orderBy(F.col("symbol").startswith(F.col("keyword")).desc(), F.col("abbreviation").startswith(word).desc(), "symbol")
    return found.select("keyword", "symbol", F.row_number().over(rank).alias("rank"))


def board_stats(bars: DataFrame) -> DataFrame:
    """Distinct symbols per board and over all, codes of no board included."""
    per = bars.select("symbol").distinct().groupBy(dims.board(F.col("symbol")).alias("board")).agg(F.count("*").alias("symbols"))
    return per.unionByName(per.agg(F.lit("all_a").alias("board"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols")))


def symbol_list(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().orderBy("symbol")


def series_ranges(bars: DataFrame) -> DataFrame:
    """Rows, first and last time of every series."""
    return bars.groupBy(*KEY).agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def data_status(bars: DataFrame) -> DataFrame:
    """Per timeframe the number of series, and the smallest symbol with its rows and range."""
    per = series_ranges(bars)
    sample = F.min_by(F.struct("symbol", "rows", "first_ts", "last_ts"), "symbol")
    return per.groupBy("tf").agg(F.count("*").alias("series"), sample.alias("s")).select("tf", "series", F.col("s.symbol").alias("sample"), "s.rows", "s.first_ts", "s.last_ts")


def board_coverage(bars: DataFrame) -> DataFrame:
    """Per board: symbols, series per timeframe, latest date, symbols that reach it; all_a sums the boards without "other"."""
    per = series_ranges(bars).withColumn("board", dims.board(F.col("symbol"))).withColumn("last_date", F.to_date("last_ts"))
    latest = F.max("last_date").over(Window.partitionBy("board"))
    per = per.withColumn("latest", latest)
    found = per.groupBy("board").agg(
        F.countDistinct("symbol").alias("symbols"), F.count("*").alias("series"), F.max("last_date").alias("latest_date"),
        F.countDistinct(F.when(F.col("last_date") == F.col("latest"), F.col("symbol"))).alias("at_latest"),
    )
    total = found.where("board <> 'other'").agg(
        F.lit("all_a").alias("board"), F.sum("symbols").alias("symbols"), F.sum("series").alias("series"), F.max("latest_date").alias("latest_date"),
        F.sum("at_latest").alias("at_latest"),
    )
    return found.unionByName(total)


def latest_weekday(as_of: str) -> Column:
    """The last Monday-to-Friday day on or before ``as_of``."""
    day = F.lit(as_of).cast("date")
    return F.date_sub(day, F.greatest(F.lit(0), F.weekday(day) - 4))


def fresh_series(bars: DataFrame, as_of: str) -> DataFrame:
    """Is each series up to date on the day ``as_of``?"""
    return series_ranges(bars).select(*KEY, "last_ts", (F.to_date("last_ts") >= latest_weekday(as_of)).alias("fresh"))


def fresh_symbols(bars: DataFrame, as_of: str, timeframes: list[str]) -> DataFrame:
    """Is each symbol up to date on all the given timeframes? A missing one is not."""
    wanted = bars.select("symbol").distinct().withColumn("tf", F.explode(F.array(*[F.lit(t) for t in timeframes])))
    joined = wanted.join(fresh_series(bars, as_of), KEY, "left")
    return joined.groupBy("symbol").agg(F.bool_and(F.coalesce("fresh", F.lit(False))).alias("fresh"), F.max("last_ts").alias("last_ts"))


def board_freshness(bars: DataFrame, as_of: str, timeframes: list[str]) -> DataFrame:
    per = fresh_symbols(bars, as_of, timeframes).groupBy(dims.board(F.col("symbol")).alias("board"))
    return per.agg(F.count("*").alias("symbols"), F.count_if("fresh").alias("fresh"), F.bool_and("fresh").alias("all_fresh"), F.max("last_ts").alias("latest_ts"))
