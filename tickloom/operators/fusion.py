"""Structure points joined to volume/price events, signal feeds and the screener."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.windows import KEY
from tickloom.operators import joins
from tickloom.operators.wyckoff import BULLISH

# Bars between a point and an event, and the rules in order of precedence.
ALIGN_BARS = 5
RULES = (
    (("1buy",), "Spring", 5, "bullish", "a failed break below the range where a trend of falling zones ends"),
    (("1buy",), "SC", 4, "bullish", "panic selling where a trend of falling zones ends"),
    (("1buy",), "ST", 4, "bullish", "the low holds on little volume where a trend of falling zones ends"),
    (("2buy", "2+3buy"), "LPS", 4, "bullish", "the first pullback after the turn finds support on little volume"),
    (("2buy", "2+3buy"), "SOS", 4, "bullish", "strength shows while the first pullback after the turn holds"),
    (("3buy",), "JOC", 4, "bullish", "price leaves the zone on volume and stays above it"),
    (("1sell",), "UTAD", 5, "bearish", "a failed break above the range where a trend of rising zones ends"),
    (("1sell",), "BC", 4, "bearish", "buying dries up at a climax where a trend of rising zones ends"),
    (("2sell", "2+3sell"), "SOW", 4, "bearish", "weakness shows while the first rally after the turn fails"),
    (("3sell",), "LPSY", 4, "bearish", "a weak rally fails to return into the zone"),
    (("3sell",), "SOW", 4, "bearish", "price leaves the zone downwards on volume"),
    (("1buy", "2buy", "2+3buy"), "AR", 3, "bullish", "the first rally answers the turn"),
    (("1sell", "2sell", "2+3sell"), "PSY", 3, "bearish", "supply begins to meet the rise near the turn"),
)
NO_RULE = "a point with volume events nearby that no rule names"


def rules(spark: SparkSession) -> DataFrame:
    rows = [(k, t, event, strength, way, reading) for k, (types, event, strength, way, reading) in enumerate(RULES) for t in types]
    return spark.createDataFrame(rows, "rule int, bs_type string, event_type string, rule_strength int, rule_direction string, reading string")


def fused(points: DataFrame, events: DataFrame) -> DataFrame:
    """Points with events within five bars: the first rule that any of them meets, else strength 2; none near, no row."""
    # a point is spread over the bars near it and joined on them, so the work is that of points and events, not their product
    spread = points.withColumn("event_idx", F.explode(F.sequence(F.col("idx") - ALIGN_BARS, F.col("idx") + ALIGN_BARS)))
    near = joins.spread_out(spread).join(events.select(*KEY, F.col("idx").alias("event_idx"), "event_type", "seq"), [*KEY, "event_idx"])
    matched = near.join(F.broadcast(rules(points.sparkSession)), ["bs_type", "event_type"], "left")  # the rule table has 20 rows
    point = [*KEY, "level", "idx", "bs_type", "price"]
    best = F.min("rule").over(Window.partitionBy(*point))
    rows = matched.withColumn("best", best).where("best is null or rule = best")
    per = rows.groupBy(*point).agg(
        F.array_sort(F.collect_list(F.struct("event_idx", "seq", "event_type"))).alias("e"), F.first("best").alias("rule"),
        F.first("rule_strength").alias("s"), F.first("rule_direction").alias("d"), F.first("reading").alias("r"),
    )
    way = F.when(F.col("bs_type").contains("buy"), "bullish").otherwise("bearish")
    return per.select(*point, F.transform("e", lambda x: x["event_type"]).alias("events"), F.coalesce("s", F.lit(2)).alias("strength"), F.coalesce("d", way).alias("direction"), F.col("rule").alias("rule"), F.coalesce("r", F.lit(NO_RULE)).alias("reading"))


def ruled(near: DataFrame) -> DataFrame:
    """The fused signal of points whose events within five bars are an array ``near`` of (event_idx, seq, event_type), in order.

    Row by row, so it holds for streams as well; the same as :func:`fused`.
    """
    table = F.array(*[
        F.struct(F.lit(k).alias("rule"), F.array(*[F.lit(t) for t in types]).alias("types"), F.lit(event).alias("event_type"), F.lit(strength).alias("strength"), F.lit(way).alias("direction"), F.lit(text).alias("reading"))
        for k, (types, event, strength, way, text) in enumerate(RULES)
    ])
    names = F.transform("near", lambda x: x["event_type"])
    met = F.filter(table, lambda r: F.array_contains(r["types"], F.col("bs_type")) & F.array_contains(names, r["event_type"]))
    rows = near.withColumn("best", F.try_element_at(met, F.lit(1)))  # the rules stand in order of precedence
    events = F.filter(names, lambda x: F.col("best").isNull() | (x == F.col("best.event_type")))
    way = F.when(F.col("bs_type").contains("buy"), "bullish").otherwise("bearish")
    return rows.select(*KEY, "level", "idx", "bs_type", "price", events.alias("events"), F.coalesce("best.strength", F.lit(2)).alias("strength"), F.coalesce("best.direction", way).alias("direction"), F.col("best.rule").alias("rule"), F.coalesce("best.reading", F.lit(NO_RULE)).alias("reading"))


def structure_feed(points: DataFrame, divergences: DataFrame, bars: DataFrame) -> DataFrame:
    """Points and divergences in one feed; a divergence's price is its bar's high (up) or low (down)."""
    prices = bars.select(*KEY, "idx", "high", "low")
    d = divergences.join(prices, [*KEY, "idx"]).select(*KEY, "level", "idx", F.concat(F.lit("divergence_"), "sub_type").alias("signal"), F.when(F.col("direction") == "up", F.col("high")).otherwise(F.col("low")).alias("price"))
    return points.select(*KEY, "level", "idx", F.col("bs_type").alias("signal"), "price").unionByName(d)


def event_feed(events: DataFrame) -> DataFrame:
    return events.select(*KEY, "idx", "event_type", "price", F.when(F.col("event_type").isin(*BULLISH), "bullish").otherwise("bearish").alias("bias"))


def fusion_feed(found: DataFrame) -> DataFrame:
    return found.withColumn("stars", F.expr("repeat('★', strength)"))


def current_phase(phases: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("idx", "phase", "sub_phase"), "idx").alias("p")
    return phases.groupBy(*KEY).agg(last).select(*KEY, "p.*")


def screened(found: DataFrame, phases: DataFrame) -> DataFrame:
    """The latest fused signal of every series with its current phase, strongest first at one place."""
    latest = Window.partitionBy(*KEY).orderBy(F.col("idx").desc(), F.col("strength").desc(), "level", "bs_type")
    top = found.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")
    now = current_phase(phases).select(*KEY, "phase", "sub_phase")
    return top.join(now, KEY, "left").select(*KEY, "level", "idx", "bs_type", "price", "events", "strength", "direction", "reading", "phase", "sub_phase")


def report(found: DataFrame, points: DataFrame, divergences: DataFrame) -> DataFrame:
    """Counts per series and kind of structure."""
    kinds = found.select(*KEY, F.concat_ws("_", "level", "kind").alias("kind")).unionByName(points.select(*KEY, F.concat(F.lit("point_"), "bs_type").alias("kind")))
    kinds = kinds.unionByName(divergences.select(*KEY, F.concat(F.lit("divergence_"), "sub_type").alias("kind")))
    return kinds.groupBy(*KEY, "kind").agg(F.count("*").alias("n"))


def marks(found: DataFrame, points: DataFrame, divergences: DataFrame, fused_points: DataFrame | None = None) -> DataFrame:
    """What is drawn over a chart, one row each: layer, level, label, start_idx, end_idx, low, high, strength."""
    shape = lambda df, layer, label, start, end, low, high, strength=F.lit(None): df.select(
        *KEY, F.lit(layer).alias("layer"), "level", label.alias("label"), start.alias("start_idx"), end.alias("end_idx"), low.cast("double").alias("low"), high.cast("double").alias("high"), strength.cast("int").alias("strength"),
    )
    none, c = F.lit(None), F.col
    rows = shape(found.where("kind = 'leg'"), "leg", c("direction"), c("start_idx"), c("end_idx"), F.least("start_price", "end_price"), F.greatest("start_price", "end_price"))
    rows = rows.unionByName(shape(found.where("kind = 'zone'"), "zone", F.concat(F.lit("group "), "grp"), c("start_idx"), c("end_idx"), c("zd"), c("zg")))
    rows = rows.unionByName(shape(divergences, "divergence", F.concat_ws(" ", "sub_type", "direction"), c("idx"), c("idx"), none, none))
    rows = rows.unionByName(shape(points, "point", c("bs_type"), c("idx"), c("idx"), c("price"), c("price")))
    if fused_points is not None:
        rows = rows.unionByName(shape(fused_points, "signal", c("bs_type"), c("idx"), c("idx"), c("price"), c("price"), c("strength")))
    return rows


#: Order of the kinds of points in a listing.
POINT_ORDER = ("1buy", "2buy", "2buy_break", "3buy", "2+3buy", "2+3buy_break", "1sell", "2sell", "2sell_break", "3sell", "2+3sell", "2+3sell_break")


def listing(found: DataFrame, points: DataFrame) -> DataFrame:
    """The listings of a report per series: legs, then zones, then points by kind; ``no`` is the line."""
    rows = found.where("kind in ('leg', 'zone')").select(
        *KEY, F.when(F.col("kind") == "leg", 0).otherwise(1).alias("part"), F.lit(0).alias("kind_no"), "level", F.coalesce("direction", F.lit("zone")).alias("label"), "start_idx", "end_idx",
        F.coalesce("start_price", "zd").alias("first_price"), F.coalesce("end_price", "zg").alias("second_price"),
    )
    kind_no = F.array_position(F.array(*[F.lit(x) for x in POINT_ORDER]), F.col("bs_type")).cast("int")
    rows = rows.unionByName(points.select(*KEY, F.lit(2).alias("part"), kind_no.alias("kind_no"), "level", F.col("bs_type").alias("label"), F.col("idx").alias("start_idx"), F.col("idx").alias("end_idx"), F.col("price").alias("first_price"), F.col("price").alias("second_price")))
    order = Window.partitionBy(*KEY).orderBy("part", "kind_no", "level", "start_idx", "end_idx", "label")
    return rows.withColumn("no", F.row_number().over(order)).drop("part", "kind_no")
