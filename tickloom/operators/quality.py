"""Data-quality checks of bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.windows import KEY

# Fixed values of the checks.
PRICE_TOLERANCE, IDLE_MOVE = 0.001, 0.01
GAP_DAYS = {"d": 5, "w": 14}
HOLIDAY_PARTS = ("-01-0", "-05-0", "-10-0")
BARS_A_YEAR_LOW, BARS_A_YEAR_HIGH = 200, 270
ERROR_COST, WARNING_COST = 0.1, 0.02
SOURCE_TOLERANCE = 0.005


def issue(test: Column, severity: str, category: str) -> Column:
    return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category")))


def row_issues(bars: DataFrame) -> DataFrame:
    """Issues of single rows and neighbours: one row per (row, issue). ``seq`` is the order in the file."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "vol"))
    in_file = Window.partitionBy(*KEY).orderBy("seq")
    same_time = Window.partitionBy(*KEY, "ts").orderBy("seq")
    before = F.lag("ts").over(in_file)
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in GAP_DAYS.items() for x in kv]), F.col("tf"))
    day = F.date_format(before, "yyyy-MM-dd")
    holiday = F.lit(False)
    for part in HOLIDAY_PARTS:
        holiday = holiday | day.contains(part)
    days = F.datediff(F.to_date("ts"), F.to_date(before))
    all_zero = (o == 0) & (h == 0) & (low == 0) & (c == 0)
    found = F.array(
        issue(h < F.greatest(o, c, low) - PRICE_TOLERANCE, "error", "ohlc_high"),
        issue(low > F.least(o, c, h) + PRICE_TOLERANCE, "error", "ohlc_low"),
        issue(F.least(o, h, low, c) < 0, "error", "negative_price"),
        issue(v < 0, "error", "negative_volume"),
        issue(all_zero, "warning", "all_zero"),
        issue((v == 0) & (F.abs(c - o) > IDLE_MOVE) & (o > 0), "warning", "idle_volume"),
        issue(days > limit * F.when(holiday, 2).otherwise(1), "warning", "gap"),
        issue(limit.isNotNull() & (before >= F.col("ts")), "error", "order"),
        issue(F.row_number().over(same_time) > 1, "error", "duplicate"),
    )
    return bars.select(*KEY, "seq", "ts", found.alias("found")).select(*KEY, "seq", "ts", F.inline(F.array_compact("found")))


def count_issues(bars: DataFrame) -> DataFrame:
    """Implausible numbers of daily bars a year, for series of more than half a year."""
    per = bars.where("tf = 'd'").groupBy(*KEY).agg(F.count("*").alias("rows"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    years = F.datediff(F.to_date("high"), F.to_date("low")) / 365.0
    rate = F.col("rows") / years
    found = F.array(issue(rate < BARS_A_YEAR_LOW, "warning", "few_bars"), issue(rate > BARS_A_YEAR_HIGH, "info", "many_bars"))
    return per.where(years > 0.5).select(*KEY, F.lit(None).cast("int").alias("seq"), F.col("high").alias("ts"), F.inline(F.array_compact(found)))


def issues(bars: DataFrame) -> DataFrame:
    return row_issues(bars).unionByName(count_issues(bars))


def series_scores(bars: DataFrame) -> DataFrame:
    """1 less 0.1 an error and 0.02 a warning, not below 0."""
    per = issues(bars).groupBy(*KEY).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    joined = bars.groupBy(*KEY).agg(F.count("*").alias("rows")).join(per, KEY, "left").fillna(0, ["errors", "warnings"])
    score = F.greatest(F.lit(0.0), 1 - ERROR_COST * F.col("errors") - WARNING_COST * F.col("warnings"))
    return joined.withColumn("score", F.round(score, 6))


def symbol_scores(bars: DataFrame) -> DataFrame:
    return series_scores(bars).groupBy("symbol").agg(F.round(F.avg("score"), 6).alias("score"))


def cross_source(a: DataFrame, b: DataFrame, listed: int = 10) -> DataFrame:
    """Two sources of the same series compared on common times.

    Per series: rows of either, common times, mismatches (close, high or low apart by more than 0.5 % of a's
    close), one-sided times, the first mismatching times, and the score.
    """
    pick = lambda df, s: df.select(*KEY, "ts", *[F.col(c).alias(f"{c}_{s}") for c in ("close", "high", "low")], F.lit(1).alias(f"in_{s}"))
    joined = pick(a, "a").join(pick(b, "b"), [*KEY, "ts"], "full_outer")
    common = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    apart = F.lit(False)
    for c in ("close", "high", "low"):
        apart = apart | (F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) > SOURCE_TOLERANCE * F.abs("close_a"))
    rows = joined.withColumn("common", common).withColumn("bad", common & apart)
    rank = F.row_number().over(Window.partitionBy(*KEY, "bad").orderBy("ts"))
    rows = rows.withColumn("first", F.when(F.col("bad") & (rank <= listed), F.col("ts")))
    per = rows.groupBy(*KEY).agg(
        F.count("in_a").alias("rows_a"), F.count("in_b").alias("rows_b"), F.count_if("common").alias("common"), F.count_if("bad").alias("mismatches"),
        F.count_if(~F.col("common")).alias("one_sided"), F.array_sort(F.collect_list("first")).alias("first_mismatches"),
    )
    both = 1 - F.least(F.lit(1.0), 0.5 * F.col("mismatches") / F.greatest("rows_a", "rows_b"))
    score = F.when((F.col("rows_a") == 0) | (F.col("rows_b") == 0), 0.5).otherwise(both)
    return per.withColumn("score", F.round(score, 6))


def parsed_date(text: Column) -> Column:
    """A date from the first ten characters, with dashes or slashes, else null."""
    head = F.substr(text, F.lit(1), F.lit(10))
    return F.coalesce(F.try_to_timestamp(head, F.lit("yyyy-MM-dd")), F.try_to_timestamp(head, F.lit("yyyy/MM/dd"))).cast("date")
