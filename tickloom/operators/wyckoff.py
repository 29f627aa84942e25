"""Volume/price analysis: effort and result, events, trading ranges, phases, supply and demand lines.

All events of a bar are flags computed by windows on (symbol, tf) ordered by idx; the windows share one
shuffle. "The last X within N" is the most recent X among the N bars before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import kernels
from tickloom.functions.windows import KEY, by_index, whole
from tickloom.operators import joins

# Detectors in the order in which a bar's events are listed.
EVENT_ORDER = ("PS", "SC", "AR", "ST", "Spring", "SOS", "LPS", "PSY", "BC", "UTAD", "SOW", "LPSY", "JOC")
LOOKBACK, FIRST_BAR, LAST_BARS = 10, 5, 3
MIN_BARS, MIN_EVENT_BARS, MIN_EFFORT_BARS, SWING = 20, 10, 5, 5
# Volumes and spreads against the series' means, places of the close in the bar, and shares of the bar an event follows.
PS_VOLUME, CLIMAX_VOLUME, CLIMAX_SPREAD, SOW_VOLUME, JOC_VOLUME, AR_VOLUME, SOS_VOLUME = 1.5, 2, 2, 1.5, 1.3, 0.8, 1.2
SC_CLOSE, BC_SHADOW, SPRING_CLOSE = 0.2, 0.3, 0.99
NEAR_LOW, ST_VOLUME, ST_SPREAD, QUIET_VOLUME = 0.03, 0.8, 0.7, 0.7
# Bars in which the event before may lie, by event.
AR_AFTER_SC, ST_AFTER_SC, SPRING_AFTER_SC, UTAD_AFTER_BC, LPSY_AFTER_SOW, SOS_AFTER_AR, LPS_AFTER_SOS = 10, 20, 30, 30, 15, 30, 15
# Gap and volume of a line's break, and how far outside a close leaves a range.
BREAK_GAP, BREAK_VOLUME, LEFT_ABOVE, LEFT_BELOW = 0.03, 1.3, 1.02, 0.98
#: Bars whose extremes are looked at before the bars themselves.
BLOCK = 64
BULLISH = ("PS", "SC", "AR", "ST", "Spring", "SOS", "LPS", "JOC")


def back(a: int, b: int):
    return by_index().rowsBetween(a, b)


def last_of(flag: Column, n: int) -> Column:
    """The most recent flagged bar among the ``n`` bars before, as a struct."""
    bar = F.struct("idx", "high", "low", "vol", (F.col("high") - F.col("low")).alias("spread"))
    return F.last(F.when(flag, bar), ignorenulls=True).over(back(-n, -1))


def event_flags(bars: DataFrame, baseline: str = "whole") -> DataFrame:
    """A flag column per event type and bar. ``baseline="trailing"`` takes means of the past only."""
    span = whole() if baseline == "whole" else back(Window.unboundedPreceding, 0)
    n = F.count("*").over(whole())
    spread, up = F.col("high") - F.col("low"), F.col("close") > F.col("open")
    body = F.abs(F.col("close") - F.col("open"))
    rows = bars.withColumn("mv", F.avg("vol").over(span)).withColumn("ms", F.avg(F.col("high") - F.col("low")).over(span))
    rows = rows.withColumn("_in", (n >= MIN_EVENT_BARS) & (F.col("idx") >= FIRST_BAR) & (F.col("idx") < n - LAST_BARS))
    rows = rows.withColumn("_far", F.first("close").over(back(-LOOKBACK, 0))).withColumn("_body", F.lag(body).over(by_index()))
    rows = rows.withColumn("_top5", F.max("high").over(back(-5, -1))).withColumn("_top", F.max("high").over(back(-LOOKBACK, -1))).withColumn("_low", F.min("low").over(back(-LOOKBACK, -1)))
    at = F.col("_in")
    falls, rises = F.col("close") < F.col("_far"), F.col("close") > F.col("_far")
    flag = lambda test: F.coalesce(at & test, F.lit(False))
    near = lambda value, base, share: F.coalesce(F.try_divide(F.abs(value - base), base) < share, F.lit(False))
    rows = rows.withColumns({
        "PS": flag(falls & (F.col("vol") > PS_VOLUME * F.col("mv")) & ((body < F.col("_body")) | (F.col("close") >= F.col("open")))),
        "SC": flag(falls & (spread > CLIMAX_SPREAD * F.col("ms")) & (F.col("vol") > CLIMAX_VOLUME * F.col("mv")) & (F.col("close") > F.col("low") + SC_CLOSE * spread)),
        "PSY": flag(rises & (F.col("vol") > PS_VOLUME * F.col("mv")) & ((body < F.col("_body")) | (F.col("close") <= F.col("open")))),
        "BC": flag(rises & (spread > CLIMAX_SPREAD * F.col("ms")) & (F.col("vol") > CLIMAX_VOLUME * F.col("mv")) & (F.col("high") - F.greatest("open", "close") > BC_SHADOW * spread)),
        "SOW": flag((F.col("close") < F.col("open")) & (F.col("vol") > SOW_VOLUME * F.col("mv")) & (F.col("close") < F.col("_low"))),
        "JOC": flag(up & (F.col("vol") > JOC_VOLUME * F.col("mv")) & (F.col("close") > F.col("_top"))),
    })
    rows = rows.withColumns({f"_sc_{e}": last_of(F.col("SC"), k) for e, k in (("ar", AR_AFTER_SC), ("st", ST_AFTER_SC), ("spring", SPRING_AFTER_SC))} | {"_bc": last_of(F.col("BC"), UTAD_AFTER_BC), "_sow": last_of(F.col("SOW"), LPSY_AFTER_SOW)})
    sc_st, sc_spring, bc, sow = F.col("_sc_st"), F.col("_sc_spring"), F.col("_bc"), F.col("_sow")
    rows = rows.withColumns({
        "AR": flag(up & F.col("_sc_ar").isNotNull() & (F.col("vol") > AR_VOLUME * F.col("mv")) & (F.col("high") > F.col("_top5"))),
        "ST": flag(near(F.col("low"), sc_st["low"], NEAR_LOW) & (F.col("vol") < ST_VOLUME * sc_st["vol"]) & (spread < ST_SPREAD * sc_st["spread"])),
        "Spring": flag((F.col("low") < sc_spring["low"]) & (F.col("close") > SPRING_CLOSE * sc_spring["low"])),
        "UTAD": flag((F.col("high") > bc["high"]) & (F.col("close") < bc["high"])),
        "LPSY": flag(sow.isNotNull() & up & ((sow["vol"] <= 0) | (F.col("vol") < QUIET_VOLUME * sow["vol"]))),
    })
    rows = rows.withColumn("_ar", last_of(F.col("AR"), SOS_AFTER_AR))
    rows = rows.withColumn("SOS", flag(up & (F.col("vol") > SOS_VOLUME * F.col("mv")) & (F.col("high") > F.col("_ar")["high"])))
    rows = rows.withColumn("_sos", last_of(F.col("SOS"), LPS_AFTER_SOS))
    sos = F.col("_sos")
    # a support is measured from the price of the strength it follows, its high
    rows = rows.withColumn("LPS", flag(near(F.col("low"), sos["high"], NEAR_LOW) & (F.col("vol") < QUIET_VOLUME * sos["vol"])))
    return rows.select(*KEY, "idx", "ts", "high", "low", *EVENT_ORDER)


def events(bars: DataFrame, baseline: str = "whole") -> DataFrame:
    """One row per event: idx, ts, event_type, price, seq (order within the bar)."""
    high = {"AR", "SOS", "PSY", "BC", "UTAD", "LPSY", "JOC"}
    listed = F.array(*[F.when(F.col(e), F.struct(F.lit(k).alias("seq"), F.lit(e).alias("event_type"), F.col("high" if e in high else "low").alias("price"))) for k, e in enumerate(EVENT_ORDER)])
    return event_flags(bars, baseline).select(*KEY, "idx", "ts", F.inline(F.array_compact(listed)))


def effort_result(bars: DataFrame) -> DataFrame:
    """Effort (share of the mean volume), result (relative body) and their reading, for series of five bars and more."""
    rows = bars.withColumn("_n", F.count("*").over(whole())).where(F.col("_n") >= MIN_EFFORT_BARS)
    effort = F.coalesce(F.try_divide(F.col("vol"), F.avg("vol").over(whole())), F.lit(0.0))
    result = F.coalesce(F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("open")), F.lit(0.0))
    rows = rows.select(*KEY, "idx", effort.alias("effort"), result.alias("result"), (F.col("close") >= F.col("open")).alias("up"))
    strong, wide = F.col("effort") > 1.3, F.col("result") > 0.015
    harmony = F.when(strong & wide, "harmonious").when(strong | wide, "divergent").otherwise("neutral")
    demand = F.col("up") == wide  # a wide rise, or a fall that volume does not widen
    side = F.when(demand, "demand").otherwise("supply")
    reading = F.when(wide, F.concat(side, F.lit("_dominant"))).when(strong, F.concat(side, F.lit("_appearing"))).otherwise("neutral")
    return rows.withColumn("harmony", harmony).withColumn("reading", reading)


def volume_trend(bars: DataFrame) -> DataFrame:
    """Relative change of the mean volume from the first to the second half; 0 for fewer than six bars."""
    rows = bars.withColumn("_n", F.count("*").over(whole()))
    half = F.floor(F.col("_n") / 2)
    per = rows.groupBy(*KEY).agg(F.first("_n").alias("n"), F.avg(F.when(F.col("idx") < half, F.col("vol"))).alias("a"), F.avg(F.when(F.col("idx") >= half, F.col("vol"))).alias("b"))
    trend = F.when(F.col("n") < 6, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.col("a")), F.lit(0.0)))
    return per.select(*KEY, F.round(trend, 9).alias("volume_trend"))


def appearances(bars: DataFrame) -> DataFrame:
    """Does demand or supply appear at a bar? Volume over 1.5 times the mean of six bars with little against it."""
    heavy = (F.col("idx") >= 5) & (F.col("vol") > 1.5 * F.avg("vol").over(back(-5, 0)))
    move = F.coalesce(F.try_divide(F.col("close") - F.col("open"), F.col("open")), F.lit(0.0))
    return bars.select(*KEY, "idx", (heavy & ((F.col("close") >= F.col("open")) | (move > -0.01))).alias("demand"), (heavy & ((F.col("close") <= F.col("open")) | (move < 0.01))).alias("supply"))


def swings(bars: DataFrame, n: int = SWING, tolerance: float | None = None) -> DataFrame:
    """Swing highs and lows over n bars either side; ties count and a bar can be both.

    With ``tolerance`` a bar within it of the extreme counts: the significant points.
    """
    full = (F.col("idx") >= n) & (F.col("idx") < F.count("*").over(whole()) - n)
    top, bottom = F.max("high").over(back(-n, n)), F.min("low").over(back(-n, n))
    is_top = F.col("high") >= top if tolerance is None else F.abs(F.col("high") - top) < tolerance
    is_bottom = F.col("low") <= bottom if tolerance is None else F.abs(F.col("low") - bottom) < tolerance
    point = lambda test, kind, c: F.when(full & test, F.struct(F.lit(kind).alias("kind"), F.col(c).alias("price")))
    found = bars.select(*KEY, "idx", "ts", F.array(point(is_top, "high", "high"), point(is_bottom, "low", "low")).alias("found"))
    return found.select(*KEY, "idx", "ts", F.inline(F.array_compact("found")))


def ranges_from_events(bars: DataFrame, found: DataFrame) -> DataFrame:
    """A range per climax and the first rally in the ten bars after it; its end is a sign, three closes outside, or the last bar.

    A buying climax's range lies between its high and the rally's high, as the rally's price is its high.
    """
    climax = found.where("event_type in ('SC', 'BC')").select(*KEY, F.col("idx").alias("start_idx"), F.col("event_type").alias("of"), F.col("price").alias("p"))
    rally = found.where("event_type = 'AR'").select(*KEY, F.col("idx").alias("ar"), F.col("price").alias("ar_price"))
    # a climax is spread over the ten bars after it and joined on them
    pairs = joins.spread_out(climax.withColumn("ar", F.explode(F.sequence(F.col("start_idx") + 1, F.col("start_idx") + 10)))).join(rally, [*KEY, "ar"]).groupBy(*KEY, "start_idx", "of", "p").agg(F.min(F.struct("ar", "ar_price")).alias("r"))
    sc = F.col("of") == "SC"
    found_ranges = pairs.select(*KEY, "start_idx", F.col("r.ar").alias("ar"), F.when(sc, F.col("r.ar_price")).otherwise(F.col("p")).alias("upper"), F.when(sc, F.col("p")).otherwise(F.col("r.ar_price")).alias("lower")).where("upper > lower")
    signs = found.where("event_type in ('SOS', 'SOW', 'UTAD')").select(*KEY, F.col("idx").alias("sign"))
    ended = joins.as_of(found_ranges, signs, KEY, F.col("ar"), F.col("sign"), F.col("sign"), "by_sign", forward=True, strict=True)
    left = ended.join(first_left(ended, bars), [*KEY, "start_idx", "upper", "lower"], "left").join(bars.groupBy(*KEY).agg(F.max("idx").alias("last")), KEY)
    return left.select(*KEY, "start_idx", F.coalesce("by_sign", "by_close", "last").alias("end_idx"), "upper", "lower")


def blocks(bars: DataFrame, *more: Column) -> DataFrame:
    """Lowest and highest close of every ``BLOCK`` bars of a series, so that what cannot happen in a block need not be looked for bar by bar."""
    rows = bars.groupBy(*KEY, F.floor(F.col("idx") / BLOCK).alias("block"))
    return rows.agg(F.min("close").alias("least"), F.max("close").alias("most"), F.min("idx").alias("from"), F.max("idx").alias("to"), *more)


def first_left(ranges: DataFrame, bars: DataFrame) -> DataFrame:
    """start_idx, upper, lower, by_close: the first of three closes in a row outside a range, from its rally (ar) on.

    Only blocks in which some close is outside are opened, up to the first that lies beyond one side as a whole.
    """
    top, bottom = LEFT_ABOVE * F.col("upper"), LEFT_BELOW * F.col("lower")
    pairs = ranges.select(*KEY, "start_idx", "ar", "upper", "lower").join(blocks(bars), KEY).where((F.col("to") >= F.col("ar")) & ((F.col("most") > top) | (F.col("least") < bottom)))
    whole_block = (F.col("from") >= F.col("ar")) & (F.col("to") - F.col("from") >= 2) & ((F.col("least") > top) | (F.col("most") < bottom))
    sure = Window.partitionBy(*KEY, "start_idx", "ar", "upper", "lower").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = pairs.withColumn("_sure", F.coalesce(F.bool_or(whole_block).over(sure), F.lit(False))).where("not _sure")
    w = by_index()
    closes = bars.select(*KEY, "idx", "close", F.lead("close", 1).over(w).alias("c1"), F.lead("close", 2).over(w).alias("c2"), F.floor(F.col("idx") / BLOCK).alias("block"))
    outside = lambda c: (F.col(c) > top) | (F.col(c) < bottom)
    hits = opened.join(closes, [*KEY, "block"]).where("idx >= ar").where(outside("close") & outside("c1") & outside("c2"))
    return hits.groupBy(*KEY, "start_idx", "upper", "lower").agg(F.min("idx").alias("by_close"))


def ranges_from_swings(bars: DataFrame) -> DataFrame:
    """Ranges of each group of near highs with each group of near lows, less than 20 % wide."""
    kinds = ("high", "low")
    # the swings lie by series already: each series becomes one row without a further shuffle, and both sides come from one fold
    listed = swings(bars).groupBy(*KEY).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("idx", "price")))).alias(k) for k in kinds])
    group = pa.list_(pa.struct([("price", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def grouped(idx: list[int], price: list[float]) -> list[tuple]:
        return [(sum(price[k] for k in g) / len(g), idx[g[0]], idx[g[-1]]) for g in kernels.price_groups(price, 0.05)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array([[dict(zip(("price", "first", "last"), g)) for g in grouped(i, p)] for i, p in zip(batch.column(f"{k}_idx").to_pylist(), batch.column(f"{k}_price").to_pylist())], group) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *found], names=[*KEY, *kinds])

    columns = [F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in kinds for c in ("idx", "price")]
    both = listed.select(*KEY, *columns).mapInArrow(fold, "symbol string, tf string, " + ", ".join(f"{k} array<struct<price: double, first: int, last: int>>" for k in kinds))
    both = both.select(*KEY, "low", F.inline("high").alias("upper", "f1", "l1")).select(*KEY, "upper", "f1", "l1", F.inline("low").alias("lower", "f2", "l2"))
    both = both.where((F.col("upper") > F.col("lower")) & (F.try_divide(F.col("upper") - F.col("lower"), F.col("lower")) < 0.2))
    return both.select(*KEY, F.least("f1", "f2").alias("start_idx"), F.greatest("l1", "l2").alias("end_idx"), "upper", "lower")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of a series that overlap become one; ``ice`` is the middle."""
    w = Window.partitionBy(*KEY).orderBy("start_idx", "end_idx", "upper", "lower")
    reach = F.max("end_idx").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.coalesce((F.col("start_idx") > reach).cast("int"), F.lit(1))).withColumn("no", F.sum("_new").over(w) - 1)
    per = marked.groupBy(*KEY, "no").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.max("upper").alias("upper"), F.min("lower").alias("lower"))
    return per.withColumn("ice", (F.col("upper") + F.col("lower")) / 2)


def trading_ranges(bars: DataFrame, found: DataFrame, of_events: DataFrame | None = None) -> DataFrame:
    """Ranges from events; for series that have none, from swings. ``of_events`` are the former, if they are known."""
    of_events = ranges_from_events(bars, found) if of_events is None else of_events
    of_swings = ranges_from_swings(bars.join(of_events.select(*KEY).distinct(), KEY, "left_anti"))
    return merged_ranges(of_events.unionByName(of_swings))


def phases(bars: DataFrame, found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Phase and sub-phase of every bar, for series of 20 bars and more.

    Inside a range: accumulation after a fall, else distribution, with a sub-phase by the events since its
    start. After a range: by the close against its bounds. Before any, or without ranges: by the trend.
    """
    # starts of ranges and events are laid onto their bars in series that are dealt and sorted once: every window below keeps that order
    begun = ranges.select(*KEY, F.col("start_idx").alias("idx"), F.struct(F.col("start_idx").alias("s"), F.col("end_idx").alias("e"), "upper", "lower").alias("r"))
    kinds = (("d", ("LPS", "LPSY", "SOS", "SOW")), ("c", ("Spring", "UTAD")), ("b", ("ST",)), ("a", ("AR", "SC", "BC")))
    flags = found.select(*KEY, "idx", *[F.col("event_type").isin(*names).alias(f"_{k}") for k, names in kinds])
    held = bars.select(*KEY, "idx", "close", "vol", F.lit(True).alias("bar"))
    every = held.unionByName(begun, allowMissingColumns=True).unionByName(flags, allowMissingColumns=True).repartition(*KEY)
    rows = every.groupBy(*KEY, "idx").agg(*[F.max(c).alias(c) for c in ("close", "vol", "bar", "r", *[f"_{k}" for k, _ in kinds])])
    rows = rows.where("bar").withColumn("_n", F.count("*").over(whole())).where(F.col("_n") >= MIN_BARS)
    rows = rows.withColumn("ago", F.first("close").over(back(-20, 0))).withColumn("mv", F.avg("vol").over(whole()))
    fell = F.coalesce(F.col("close") - F.col("ago"), F.lit(0.0)) < 0
    rows = rows.withColumn("r", F.when(F.col("r").isNotNull(), F.struct("r.*", fell.alias("fell"))))
    # ranges of a series don't overlap, so the range at or before a bar is the last one that has begun
    spread = rows.withColumn("range", F.last("r", ignorenulls=True).over(back(Window.unboundedPreceding, 0)))
    spread = spread.withColumn("any", F.max(F.col("r").isNotNull()).over(whole()))
    since = Window.partitionBy(*KEY, F.col("range.s")).orderBy("idx")
    seen = {k: F.coalesce(F.max(f"_{k}").over(since), F.lit(False)) for k in "dcba"}
    r = F.col("range")
    inside = r.isNotNull() & (F.col("idx") <= r["e"])
    sub_inside = F.when(seen["d"], "D").when(seen["c"], "C").when(seen["b"], "B").when(seen["a"], "A").otherwise("B")
    move, big = F.col("close") - F.col("ago"), F.col("vol") > 1.5 * F.col("mv")
    trend = F.when(F.col("idx") < 10, "Markdown").when(move > 0, F.when(big, "Markup").otherwise("Distribution")).when(move < 0, F.when(big, "Markdown").otherwise("Accumulation")).otherwise("Accumulation")
    early = F.when(F.col("idx") < 20, "Markdown").when(move > 0, "Markup").otherwise("Markdown")
    after = F.when(r["fell"], F.when(F.col("close") > r["upper"], "Markup").otherwise("Accumulation")).otherwise(F.when(F.col("close") < r["lower"], "Markdown").otherwise("Distribution"))
    left = F.when(r["fell"], F.col("close") > r["upper"]).otherwise(F.col("close") < r["lower"])
    phase = F.when(~F.col("any"), trend).when(r.isNull(), early).when(inside, F.when(r["fell"], "Accumulation").otherwise("Distribution")).otherwise(after)
    sub = F.when(~F.col("any") | r.isNull(), "").when(inside, sub_inside).otherwise(F.when(left, "E").otherwise("D"))
    return spread.select(*KEY, "idx", phase.alias("phase"), sub.alias("sub_phase"))


def lines(points: DataFrame, names: dict[str, str]) -> DataFrame:
    """A line per series and kind through the last two points: slope per bar."""
    latest = Window.partitionBy(*KEY, "kind").orderBy(F.col("idx").desc())
    two = points.withColumn("_k", F.row_number().over(latest)).where("_k <= 2").groupBy(*KEY, "kind").agg(F.min(F.struct("idx", "price")).alias("a"), F.max(F.struct("idx", "price")).alias("b"), F.count("*").alias("n")).where("n = 2")
    slope = (F.col("b.price") - F.col("a.price")) / (F.col("b.idx") - F.col("a.idx"))
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("kind")]
    return two.select(*KEY, kind.alias("line_type"), F.col("a.idx").alias("start_idx"), F.col("b.idx").alias("end_idx"), F.col("a.price").alias("start_price"), F.col("b.price").alias("end_price"), slope.alias("slope"))


def supply_demand_lines(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Supply and demand lines through the last two swings, and three flat lines per range."""
    sloped = lines(swings(bars), {"high": "supply", "low": "demand"})
    flat = F.array(*[F.struct(F.lit(n).alias("line_type"), F.col(c).alias("price")) for n, c in (("supply", "upper"), ("demand", "lower"), ("ice", "ice"))])
    of_ranges = ranges.select(*KEY, "start_idx", "end_idx", F.inline(flat)).select(*KEY, "line_type", "start_idx", "end_idx", F.col("price").alias("start_price"), F.col("price").alias("end_price"), F.lit(0.0).alias("slope"))
    return sloped.unionByName(of_ranges)


def trend_lines(bars: DataFrame) -> DataFrame:
    """Support and resistance through the last two significant points, for series of 20 bars and more."""
    rows = bars.withColumn("_n", F.count("*").over(whole())).where(F.col("_n") >= MIN_BARS).drop("_n")
    return lines(swings(rows, tolerance=0.01), {"high": "resistance", "low": "support"})


def line_at(idx: Column) -> Column:
    return F.col("start_price") + F.col("slope") * (idx - F.col("start_idx"))


def line_breaks(bars: DataFrame, found: DataFrame) -> DataFrame:
    """Bars that close 3 % beyond a supply line (breakout) or below a demand line (breakdown) on volume."""
    rows = bars.select(*KEY, "idx", "close", "vol", F.avg("vol").over(whole()).alias("mv"))
    # a block can hold a break only if its extreme close lies beyond the line's level at either end of it, on volume;
    # where a line has fallen to zero shares of it say nothing, and the block is looked at
    supply, mv = F.col("line_type") == "supply", F.col("mv")
    lines_ = found.where("line_type in ('supply', 'demand')")
    held = blocks(rows, F.max("vol").alias("most_vol"), F.first("mv").alias("mv"))
    pairs = lines_.join(held, KEY).where((F.col("to") > F.col("end_idx")) & (F.col("most_vol") > BREAK_VOLUME * mv))
    ends = [line_at(F.greatest(F.col("from"), F.col("end_idx") + 1)), line_at(F.col("to"))]
    low, high = F.least(*ends), F.greatest(*ends)
    slack = 1e-9
    may = (low <= 0) | F.when(supply, F.col("most") > (1 + BREAK_GAP - slack) * low).otherwise(F.col("least") < (1 - BREAK_GAP + slack) * high)
    opened = pairs.where(may).select(*KEY, "block", *[c for c in found.columns if c not in KEY])
    pairs = opened.join(rows.withColumn("block", F.floor(F.col("idx") / BLOCK)), [*KEY, "block"]).where("idx > end_idx").withColumn("level", line_at(F.col("idx")))
    gap = F.try_divide(F.col("close") - F.col("level"), F.col("level"))
    heavy = F.col("vol") > BREAK_VOLUME * F.col("mv")
    kind = F.when((F.col("line_type") == "supply") & (gap > BREAK_GAP) & heavy, "breakout").when((F.col("line_type") == "demand") & (gap < -BREAK_GAP) & heavy, "breakdown")
    return pairs.withColumn("break_type", kind).where("break_type is not null").select(*KEY, "idx", "line_type", "start_idx", "end_idx", F.round("level", 6).alias("level"), "break_type")


def bundle(bars: DataFrame, found: DataFrame, ranges: DataFrame, phase_rows: DataFrame, line_rows: DataFrame) -> DataFrame:
    """Everything of the analysis in one table, for series of 20 bars and more: part, idx, end_idx, label, value."""
    enough = bars.groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_BARS).select(*KEY)
    shape = lambda df, part, label, start, end, value: df.select(*KEY, F.lit(part).alias("part"), F.col(start).alias("idx"), F.col(end).alias("end_idx"), label.alias("label"), value.cast("double").alias("value"))
    effort = effort_result(bars).where("reading <> 'neutral'")
    rows = shape(found, "event", F.col("event_type"), "idx", "idx", F.col("price"))
    rows = rows.unionByName(shape(ranges, "range", F.lit("range"), "start_idx", "end_idx", F.col("ice")))
    rows = rows.unionByName(shape(line_rows, "line", F.col("line_type"), "start_idx", "end_idx", F.col("slope")))
    rows = rows.unionByName(shape(phase_rows, "phase", F.concat_ws(" ", "phase", "sub_phase"), "idx", "idx", F.lit(None)))
    rows = rows.unionByName(shape(effort, "effort", F.col("reading"), "idx", "idx", F.col("effort")))
    return rows.join(enough, KEY, "left_semi")


def creeks(bars: DataFrame, found: DataFrame) -> DataFrame:
    """Every jump over the creek with the creek's width: the highest high less the lowest low of the ten bars before."""
    rows = bars.select(*KEY, "idx", (F.max("high").over(back(-LOOKBACK, -1)) - F.min("low").over(back(-LOOKBACK, -1))).alias("creek_width"))
    return found.where("event_type = 'JOC'").select(*KEY, "idx", "price").join(rows, [*KEY, "idx"])
