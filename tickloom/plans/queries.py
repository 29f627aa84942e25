"""The registered queries over bars derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import dims
from tickloom.functions.windows import KEY, with_index
from tickloom.operators import bars as B
from tickloom.operators import fusion, indicators, joins, quality, signals, structure, wyckoff
from tickloom.plans import streams
from tickloom.plans.oracle import ORACLE
from tickloom.sources import fixtures, merge, payloads, tables
from tickloom.sources.shared import Tables, shared_folder
from tickloom.streaming.state import fusion_alerts

Query = Callable[[SparkSession, str], DataFrame]
#: The day on which freshness and retention are judged: data ends a few months before it.
AS_OF = "1998-12-01"
walk, daily = fixtures.bars_walk, fixtures.bars_daily


class Chain:
    """The whole analysis of a bar table, step by step: a step is taken when it is first asked for.

    What several steps read is written to the shared folder, so that each is planned from tables of known size,
    small ones are joined without a shuffle, and a lost executor costs one step. ``release`` deletes it all, as does the session's end.
    """

    def __init__(self, bars: DataFrame) -> None:
        self.tables = Tables(bars.sparkSession)
        self.keep, self.release = self.tables.keep, self.tables.release
        self.bars = self.keep(bars)

    def beside(self, *steps: str) -> Chain:
        """Takes steps that don't need each other at once: each alone leaves cores idle at its small stages."""
        with ThreadPoolExecutor(len(steps)) as pool:
            list(pool.map(lambda step: getattr(self, step), steps))
        return self

    structures = cached_property(lambda self: self.keep(structure.structures(self.bars)))
    macd = cached_property(lambda self: self.keep(indicators.macd(self.bars)))
    legs = cached_property(lambda self: structure.legs(self.structures))
    zones = cached_property(lambda self: structure.zones(self.structures))
    powered = cached_property(lambda self: self.keep(signals.leg_power(self.legs, self.macd)))
    divergences = cached_property(lambda self: self.keep(signals.divergences(self.powered, self.zones, self.macd)))
    points = cached_property(lambda self: self.keep(signals.points(self.legs, self.zones, self.divergences)))
    walks = cached_property(lambda self: structure.walks(self.structures))
    walk_divergences = cached_property(lambda self: signals.walk_divergences(self.walks, self.powered, self.macd))
    events = cached_property(lambda self: self.keep(wyckoff.events(self.bars)))
    event_ranges = cached_property(lambda self: self.keep(wyckoff.ranges_from_events(self.bars, self.events)))
    ranges = cached_property(lambda self: self.keep(wyckoff.trading_ranges(self.bars, self.events, self.event_ranges)))
    phases = cached_property(lambda self: wyckoff.phases(self.bars, self.events, self.ranges))
    lines = cached_property(lambda self: wyckoff.supply_demand_lines(self.bars, self.ranges))
    fusion = cached_property(lambda self: fusion.fused(self.points, self.events))


def of_chain(step: Callable[[Chain], DataFrame], *round_to: str, source: Query = walk) -> Query:
    return lambda spark, sf_dir: rounded(step(Chain(source(spark, sf_dir))), *round_to)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns}) if columns else df


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.candle_features(walk(spark, sf_dir)), "change_pct", "change_vs_previous_pct")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.classified(walk(spark, sf_dir).select("symbol").distinct())


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name dimension of the traded symbols: the supplier with the smallest key of each series."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), "s_suppkey", "s_name")
    first = suppliers.groupBy("k").agg(F.min_by("s_name", "s_suppkey").alias("name"))
    prefix = F.element_at(F.array(*[F.lit(p) for p in fixtures.PREFIXES]), (F.col("k") % len(fixtures.PREFIXES) + 1).cast("int"))
    rows = first.select(F.concat(prefix, F.lpad(F.col("k").cast("string"), F.greatest(F.lit(3), F.length(F.col("k").cast("string"))), F.lit("0"))).alias("symbol"), "name")
    return rows.withColumn("abbreviation", dims.abbreviation(F.col("name"), {}))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each board prefix and the last digits of each name, searched as keywords."""
    dimension = names(spark, sf_dir)
    words = dimension.select(F.substring("symbol", 1, 3).alias("keyword")).unionByName(dimension.select(F.expr("right(name, 2)").alias("keyword"))).distinct()
    return B.searched(dimension, words)


def second_source(bars: DataFrame) -> DataFrame:
    """A copy that differs in every 50th close, lacks every 97th row and one whole series."""
    rows = bars.where((F.col("idx") % 97 != 0) & (F.col("symbol") != "600005"))
    return rows.withColumn("close", F.when(F.col("idx") % 50 == 0, F.col("close") * 1.01).otherwise(F.col("close")))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four sources, parsed from payloads; each source lacks some series."""
    bars = daily(spark, sf_dir)
    digit = F.substring("symbol", 6, 1).cast("int")
    kept = {"tushare": digit % 4 == 3, "sina": digit % 4 >= 2, "tencent": digit % 4 >= 1, "eastmoney": digit >= 0}
    layouts = {"tushare": "table", "sina": "objects", "tencent": "keyed_rows", "eastmoney": "lines"}
    out = None
    for source, layout in layouts.items():
        rows = payloads.READERS[layout](payloads.serialised(bars.where(kept[source]), layout)).withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows)
    return out


def payload_query(layout: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return payloads.READERS[layout](payloads.serialised(daily(spark, sf_dir), layout)).drop("has_time")

    return query


def damaged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of payloads of all layouts with bad numbers, short rows, missing keys, and no content."""
    out = None
    for layout, reader in payloads.READERS.items():
        landed_texts = fixtures.damaged_payloads(payloads.serialised(daily(spark, sf_dir), layout), layout)
        rows = reader(landed_texts).drop("has_time").withColumn("layout", F.lit(layout))
        out = rows if out is None else out.unionByName(rows)
    return out


def minute_bars_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour bars of some days, of which those at midnight came with a date alone."""
    timed = half_hours(spark, sf_dir).withColumn("has_time", (F.hour("ts") > 0) | (F.minute("ts") > 0))
    return B.bars_between(timed, "2024-01-03 10:00:00", "2024-01-06").drop("has_time")


def missing_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each stored timeframe and of one that isn't stored, and of a table that isn't there: rows by series."""
    root = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    nothing = tables.read_bars(spark, f"{root}-none")
    tables.write_bars(daily(spark, sf_dir), root)
    found = tables.read_bars(spark, root, tf="d").unionByName(tables.read_bars(spark, root, tf="w")).unionByName(nothing).unionByName(tables.read_bars(spark, root, symbol="none"))
    return found.groupBy("symbol", "tf").agg(F.count("*").alias("n"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored bars up to a day, and a batch that overlaps them with other closes."""
    bars = daily(spark, sf_dir).withColumn("has_time", F.lit(False))
    new = bars.where("ts >= timestamp'1995-01-01'").withColumn("close", F.col("close") + 1)
    return bars.where("ts < timestamp'1996-01-01'"), new


def merge_query(prefer: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return merge.merged(*halves(spark, sf_dir), prefer).drop("has_time")

    return query


def resolve_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a file with other column names and text times holds them, resolved again."""
    stored = daily(spark, sf_dir).select("symbol", "tf", F.date_format("ts", "yyyy/MM/dd").alias("datetime"), F.col("open").cast("string").alias("Open"), F.col("high").alias("High"), F.col("low").cast("float").alias("Low"), F.col("close").cast("long").alias("Close"), F.when(F.col("idx") % 7 != 0, F.col("vol")).alias("Volume"))
    return tables.resolved(stored)


def wanted_series(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().withColumn("tf", F.explode(F.array(F.lit("d"), F.lit("w"))))


def status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = halves(spark, sf_dir)
    return merge.sync_status(old, new.where(F.substring("symbol", 6, 1) != "3"), wanted_series(old))


def patch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily(spark, sf_dir).withColumn("has_time", F.lit(False))
    day = "1996-06-03"
    lacking = bars.where((F.to_date("ts") != F.lit(day).cast("date")) | (F.substring("symbol", 6, 1) == "1"))
    return merge.patched_today(lacking, bars, day).drop("has_time")


def slices_of_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-hour bars inside each stroke of hourly bars; one series per stroke, which becomes part of the key."""
    high, low = fixtures.bars_events(spark, sf_dir, 60), fixtures.bars_events(spark, sf_dir, 30)
    legs = structure.with_times(structure.legs(structure.structures(high)).where("level = 'bi'"), high, "start_idx", "end_idx")
    spans = legs.select("symbol", F.col("no").alias("leg"), "start_ts", "end_ts")
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    inside = joins.within(low, spans, ["symbol"], at("ts"), at("start_ts"), at("end_ts"), 86_400)
    rows = inside.withColumn("tf", F.concat("tf", F.lit("/"), F.col("leg").cast("string"))).drop("leg", "start_ts", "end_ts", "idx")
    return structure.long_enough(with_index(rows, "ts"))


def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure, divergences and points of the half-hour bars inside each stroke of hourly bars."""
    c = Chain(slices_of_strokes(spark, sf_dir))
    return fusion.marks(c.structures, c.points, c.divergences)


def drill_down_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.macd(slices_of_strokes(spark, sf_dir)), "dif", "dea", "macd_hist")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of daily bars confirmed by points of the same walk cut into single trades as hourly bars."""
    both = walk(spark, sf_dir).unionByName(fixtures.bars_fine(spark, sf_dir).withColumn("tf", F.lit("f60")))
    return signals.nested_signals(Chain(both).points)


def nested_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of daily bars confirmed by points of the finer bars at most ten days away."""
    both = walk(spark, sf_dir).unionByName(fixtures.bars_fine(spark, sf_dir).withColumn("tf", F.lit("f60")))
    c = Chain(both)
    return signals.nested_signals(structure.with_times(c.points, c.bars, "idx"), "10 days")


def chart(c: Chain) -> DataFrame:
    """Bars with indicators and phase: the series of a chart; what is drawn over them is :func:`chart_marks`."""
    return c.bars.join(c.macd, [*KEY, "idx"]).join(c.phases, [*KEY, "idx"], "left")


def chart_marks(c: Chain) -> DataFrame:
    """Strokes, segments, zones, points, divergences and fused signals over a chart's bars."""
    return fusion.marks(c.structures, c.points, c.divergences, c.fusion)


def joined_events(df: DataFrame) -> DataFrame:
    return df.withColumn("events", F.array_join("events", "/"))


def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every series' latest fused signal with its phase."""
    c = Chain(walk(spark, sf_dir)).beside("structures", "macd", "event_ranges").beside("points", "ranges")
    return joined_events(fusion.screened(c.fusion, c.phases))


def asked_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that ask for a timeframe by one of its names, in any case, counted by the name's storage."""
    names = [n for found in dims.TIMEFRAME_NAMES.values() for n in found] + ["F30", "Day", "f7", ""]
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_orderkey") % len(names) + 1).cast("int")).alias("name"))
    tf = dims.parse_timeframe(F.col("name"))
    return asked.groupBy("name", tf.alias("tf"), dims.storage_name(tf).alias("dir_name")).agg(F.count("*").alias("n"))


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traded series whose symbols are main indexes, with name and abbreviation."""
    return B.series_ranges(walk(spark, sf_dir)).join(F.broadcast(dims.index_dimension(spark)), "symbol")  # ten rows


def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates as text in several forms, read again."""
    day, k = F.col("l_shipdate").cast("date"), F.col("l_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, F.date_format(day, "yyyy-MM-dd 09:30:00")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(text.alias("text")).distinct()
    return rows.select("text", quality.parsed_date(F.col("text")).cast("string").alias("day"))


#: Characters of the names that are abbreviated, and their initials; the first has none.
DIGIT_NAMES, INITIALS = "零一二三四五六七八九", {"一": "y", "二": "e", "三": "s", "四": "s", "五": "w", "六": "l", "七": "q", "八": "b", "九": "j"}


def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names with their digits in characters, abbreviated by a character table and without one."""
    name = F.translate("s_name", "0123456789", DIGIT_NAMES)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", name.alias("name"))
    return rows.withColumns({"initials": dims.abbreviation(F.col("name"), INITIALS), "ascii_only": dims.abbreviation(F.col("name"), {})})


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written to a table and read again."""
    root = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    tables.write_bars(daily(spark, sf_dir), root)
    return tables.read_bars(spark, root, tf="d")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, events and bars that arrive in three slices; a bar decades later, of a series of its own, lets those that fall silent tell what they hold."""
    c = Chain(walk(spark, sf_dir))
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda df, kind, level, what, price, seq: structure.with_times(df.select(*KEY, "idx", F.lit(kind).alias("kind"), level.alias("level"), what.alias("type"), price.alias("price"), seq.alias("seq")), c.bars, "idx")
    rows = shape(c.points, "point", F.col("level"), F.col("bs_type"), F.col("price"), none("int"))
    rows = rows.unionByName(shape(c.events, "event", none("string"), F.col("event_type"), none("double"), F.col("seq").cast("int")))
    rows = rows.unionByName(shape(c.bars, "bar", none("string"), none("string"), none("double"), none("int")))
    later = c.bars.groupBy().agg((F.max("ts") + F.expr("interval 30 years")).alias("ts")).where("ts is not null")
    last = later.select(F.lit("").alias("symbol"), F.lit("d").alias("tf"), F.lit(1 << 29).alias("idx"), F.lit("bar").alias("kind"), none("string").alias("level"), none("string").alias("type"), none("double").alias("price"), none("int").alias("seq"), "ts")
    rows = c.keep(rows.unionByName(last))

    def told(stream: DataFrame) -> DataFrame:
        point, event = stream.where("kind = 'point'").withColumnRenamed("type", "bs_type"), stream.where("kind = 'event'").withColumnRenamed("type", "event_type")
        return fusion_alerts(point, event, stream.where("kind = 'bar'"), delay="10000 days")  # slices are by position: times of series differ

    a = streams.Arrivals(spark)
    return joined_events(fusion.fusion_feed(a.run(rows, streams.by_position(90, 201), told)))


def of(operator: Callable[..., DataFrame], source: Query = walk, *args, round_to: tuple = ()) -> Query:
    return lambda spark, sf_dir: rounded(operator(source(spark, sf_dir), *args), *round_to)


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.damaged(daily(spark, sf_dir))


def half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.bars_events(spark, sf_dir, 30)


QUERIES: dict[str, Query] = {
    "screener": screener,
    "bars_walk": walk,
    "bars_daily": daily,
    "bars_half_hour": half_hours,
    "bars_resolved": resolve_query,
    "bars_between": of(B.bars_between, daily, "1995-03-01", "1995-06-30"),
    "bars_tail": of(B.tail, walk, 50),
    "payload_objects": payload_query("objects"),
    "payload_keyed_rows": payload_query("keyed_rows"),
    "payload_lines": payload_query("lines"),
    "payload_table": payload_query("table"),
    "best_source": lambda s, d: merge.best_source(landed(s, d)).drop("has_time"),
    "merge_newest": merge_query("new"),
    "merge_oldest": merge_query("old"),
    "patch_today": patch_query,
    "since": of(merge.since, daily, "1997-01-01"),
    "next_starts": of(lambda b: as_text(merge.next_starts(b), "start_date"), daily),
    "sync_status": status_query,
    "trim_report": of(merge.trim_report, daily, {"d": 24}, AS_OF),
    "trimmed": of(merge.trimmed, daily, {"d": 24}, AS_OF),
    "delisted": lambda s, d: merge.delisted(walk(s, d), merge.listed_codes(names(s, d).where("symbol like '600%'"), names(s, d).where("symbol like '%1'"))),
    "without_delisted": lambda s, d: merge.without_delisted(walk(s, d), merge.listed_codes(names(s, d).where("symbol like '600%'"), names(s, d).where("symbol like '%1'"))),
    "candle_features": candles,
    "symbol_classes": symbols,
    "symbol_search": search,
    "symbol_list": of(B.symbol_list),
    "resample_chunks": of(B.resampled, half_hours, "f60"),
    "resample_weekly": of(B.by_calendar, daily, "week"),
    "resample_monthly": of(B.by_calendar, daily, "month"),
    "board_stats": of(B.board_stats),
    "data_status": of(B.data_status),
    "series_ranges": of(B.series_ranges),
    "board_coverage": of(lambda b: as_text(B.board_coverage(b), "latest_date")),
    "fresh_series": of(B.fresh_series, walk, AS_OF),
    "board_freshness": of(B.board_freshness, walk, AS_OF, ["d"]),
    "dq_issues": of(quality.issues, damaged),
    "dq_series_scores": of(quality.series_scores, damaged),
    "dq_symbol_scores": of(quality.symbol_scores, damaged),
    "cross_source": lambda s, d: quality.cross_source(daily(s, d), second_source(daily(s, d))).withColumn("first_mismatches", F.array_join(F.transform("first_mismatches", lambda x: x.cast("string")), "/")),
    "macd": of(indicators.macd, walk, round_to=("dif", "dea", "macd_hist")),
    "macd_by_blocks": of(lambda b: indicators.macd_by_blocks(b, block=512), fixtures.bars_long, round_to=("dif", "dea", "macd_hist")),
    "volume_scores": of(indicators.volume_scores, walk, round_to=("vp_score",)),
    "merged_bars": of(structure.merged_bars, walk, round_to=("amount",)),
    "fractals": of(lambda b: structure.fractals(structure.merged_bars(b))),
    "structures": of(structure.structures),
    "walks": of_chain(lambda c: c.walks.withColumn("zones", F.size("zs_list")).drop("zs_list"), source=fixtures.bars_long),
    "leg_power": of_chain(lambda c: c.powered, "area", "peak", "dif_peak"),
    "divergences": of_chain(lambda c: c.divergences),
    "walk_divergences": of_chain(lambda c: c.walk_divergences, source=fixtures.bars_long),
    "points": of_chain(lambda c: c.points),
    "nested_signals": nested,
    "drill_down": drill_down,
    "drill_down_macd": drill_down_macd,
    "wyckoff_events": of(wyckoff.events),
    "effort_result": of(wyckoff.effort_result, walk, round_to=("effort", "result")),
    "volume_trend": of(wyckoff.volume_trend, walk, round_to=("volume_trend",)),
    "appearances": of(wyckoff.appearances),
    "swings": of(wyckoff.swings),
    "significant_points": of(wyckoff.swings, walk, 5, 0.01),
    "trading_ranges": of_chain(lambda c: c.ranges, "upper", "lower", "ice"),
    "phases": of_chain(lambda c: c.phases),
    "current_phase": of_chain(lambda c: fusion.current_phase(c.phases)),
    "supply_demand_lines": of_chain(lambda c: c.lines, "start_price", "end_price", "slope"),
    "line_breaks": of_chain(lambda c: wyckoff.line_breaks(c.bars, c.lines)),
    "trend_lines": of(wyckoff.trend_lines, walk, round_to=("slope",)),
    "fusion_signals": of_chain(lambda c: joined_events(fusion.fusion_feed(c.fusion))),
    "structure_feed": of_chain(lambda c: fusion.structure_feed(c.points, c.divergences, c.bars)),
    "event_feed": of(lambda b: fusion.event_feed(wyckoff.events(b))),
    "analysis_report": of_chain(lambda c: fusion.report(c.structures, c.points, c.divergences)),
    "analysis_listing": of_chain(lambda c: fusion.listing(c.structures, c.points)),
    "chart": of_chain(chart, "dif", "dea", "macd_hist"),
    "chart_marks": of_chain(chart_marks),
    "volume_bundle": of_chain(lambda c: wyckoff.bundle(c.bars, c.events, c.ranges, c.phases, c.lines), "value"),
    "creeks": of_chain(lambda c: wyckoff.creeks(c.bars, c.events)),
    "asked_timeframes": asked_timeframes,
    "index_series": index_series,
    "parsed_dates": parsed_dates,
    "abbreviations": abbreviations,
    "stored_bars": stored_bars,
    "missing_bars": missing_bars,
    "payload_damaged": damaged_payloads,
    "bars_between_minutes": minute_bars_between,
    "segment_extremes": of_chain(lambda c: structure.segment_extremes(c.structures)),
    "nested_within": nested_within,
    "stream_alerts": stream_alerts,
    **streams.QUERIES,
}

__all__ = ["ORACLE", "QUERIES"]
