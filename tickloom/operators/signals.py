"""Divergences, buy and sell points, nested signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import dims
from tickloom.functions.windows import KEY
from tickloom.operators import joins
from tickloom.operators.structure import zone_list

# Share of the range of dif that counts as near zero, legs below which nothing diverges.
NEAR_ZERO, MIN_LEGS = 0.15, 4
#: Bars of a bucket in which legs are looked up.
BUCKET = 64
SCOPE = [*KEY, "level", "scope"]


def leg_power(legs: DataFrame, macd: DataFrame) -> DataFrame:
    """Legs with area, peak and dif extreme of their bars; a down leg's peak looks at positive values too.

    A leg is spread over its positions and joined on them, so the work is the bars' and not bars times legs.
    """
    spread = legs.withColumn("idx", F.explode(F.sequence("start_idx", "end_idx")))
    rows = joins.spread_out(spread).join(macd, [*KEY, "idx"])
    up, hist = F.col("direction") == "up", F.col("macd_hist")
    power = rows.groupBy(*KEY, "level", "no").agg(
        F.sum(F.when(up & (hist > 0), hist).when(~up & (hist < 0), -hist).otherwise(0.0)).alias("area"),
        F.max(F.when(up, F.greatest(hist, F.lit(0.0))).otherwise(F.abs(hist))).alias("peak"),
        F.when(F.first("direction") == "up", F.max("dif")).otherwise(F.min("dif")).alias("dif_peak"),
    )
    return legs.join(power, [*KEY, "level", "no"], "left").fillna(0.0, ["area", "peak"]).withColumn("high", F.greatest("start_price", "end_price")).withColumn("low", F.least("start_price", "end_price"))


def direction(a: Column, b: Column) -> Column:
    """Direction from zone a to zone b."""
    return F.when(b["zd"] > a["zg"], "up").when(b["zg"] < a["zd"], "down").when(b["zd"] > a["zd"], "up").otherwise("down")


def near_zero(zones: DataFrame, macd: DataFrame) -> DataFrame:
    """Of zones (start_idx, end_idx): did dif come near zero inside?"""
    scale = macd.groupBy(*KEY).agg((F.max("dif") - F.min("dif")).alias("range"))
    spread = zones.select(*KEY, "start_idx", "end_idx").distinct().withColumn("idx", F.explode(F.sequence("start_idx", "end_idx")))
    least = joins.spread_out(spread).join(macd.select(*KEY, "idx", "dif"), [*KEY, "idx"]).groupBy(*KEY, "start_idx", "end_idx").agg(F.min(F.abs("dif")).alias("least"))
    near = (F.col("range") > 0) & (F.col("least") < NEAR_ZERO * F.col("range"))
    return least.join(scale, KEY).select(*KEY, "start_idx", "end_idx", F.coalesce(near, F.lit(False)).alias("near"))


LEG = ("no", "direction", "start_idx", "end_idx", "high", "low", "area", "peak", "dif_peak")


def weaker(later: Column, earlier: Column, way: Column) -> Column:
    return F.coalesce(F.when(way == "up", later["dif_peak"] < earlier["dif_peak"]).otherwise(later["dif_peak"] > earlier["dif_peak"]), F.lit(False))


def diverging(groups: DataFrame, legs: DataFrame, macd: DataFrame) -> DataFrame:
    """Divergences of zone groups (scope keys, grp, zs_list) among the legs of the same scope.

    Groups of two and more zones diverge as a trend; where they do not, and for single zones, each zone is
    tested as a consolidation. Scopes of fewer than four legs give none.
    """
    counted = legs.withColumn("_n", F.count("*").over(Window.partitionBy(*SCOPE))).where(F.col("_n") >= MIN_LEGS).drop("_n")
    leg = F.struct(*LEG)
    first, second, last, before = (F.element_at("zs_list", i) for i in (1, 2, -1, -2))
    steady = F.forall(
        F.sequence(F.lit(2), F.size("zs_list")),
        lambda i: F.when(direction(first, second) == "up", F.element_at("zs_list", i)["zd"] > F.element_at("zs_list", i - 1)["zg"]).otherwise(
            F.element_at("zs_list", i)["zg"] < F.element_at("zs_list", i - 1)["zd"]
        ),
    )
    trends = groups.where(F.size("zs_list") >= 2).withColumn("way", direction(first, second)).where(steady)
    reach = last["end_idx"] + F.greatest(F.lit(0), last["end_idx"] - last["start_idx"])
    l = F.col("leg")  # noqa: E741
    held = counted.select(*SCOPE, leg.alias("leg"))
    pairs = joins.within(held, trends, SCOPE, l["start_idx"], before["start_idx"], F.greatest(last["start_idx"], reach), BUCKET).where("leg.direction = way")
    as_b = (l["start_idx"] >= before["start_idx"]) & (l["start_idx"] < last["start_idx"]) & (l["area"] > 0)
    as_c = (l["start_idx"] >= last["start_idx"]) & (l["start_idx"] <= reach) & F.when(F.col("way") == "up", l["high"] > last["zg"]).otherwise(l["low"] < last["zd"])
    found = pairs.groupBy(*SCOPE, "grp", "way").agg(
        F.coalesce(F.min(F.when(as_b & (l["end_idx"] >= last["start_idx"]), l)), F.min(F.when(as_b, l))).alias("b"), F.max(F.when(as_c, l)).alias("c"), F.first(last).alias("z"),
    )
    b, c = F.col("b"), F.col("c")
    found = found.where("b is not null and c is not null").where(F.when(F.col("way") == "up", c["high"] > b["high"]).otherwise(c["low"] < b["low"]))
    zone_keys = groups.select(*KEY, F.explode("zs_list").alias("z")).select(*KEY, "z.start_idx", "z.end_idx")
    near = near_zero(zone_keys, macd).withColumnRenamed("start_idx", "zs").withColumnRenamed("end_idx", "ze")
    on_zone = lambda df: df.withColumn("zs", F.col("z.start_idx")).withColumn("ze", F.col("z.end_idx")).join(near, [*KEY, "zs", "ze"], "left")
    found = on_zone(found).withColumn("by_area", c["area"] < b["area"]).withColumn("by_dif", F.coalesce("near", F.lit(False)) & weaker(c, b, F.col("way")))
    trend = found.where("by_area or by_dif").select(*SCOPE, "grp", F.lit(-1).alias("zone"), c["end_idx"].alias("idx"), F.col("way").alias("direction"), F.lit("trend").alias("sub_type"), "by_area", "by_dif", F.lit(None).cast("boolean").alias("broken"))

    rest = groups.join(trend.select(*SCOPE, "grp"), [*SCOPE, "grp"], "left_anti").select(*SCOPE, "grp", F.explode("zs_list").alias("z"))
    # the last leg that ends by the zone's start, and the first that starts from its end on
    sides = joins.as_of(rest, held, SCOPE, F.col("z.start_idx"), l["end_idx"], l, "b", order=l["no"])
    sides = joins.as_of(sides, held, SCOPE, F.col("z.end_idx"), l["start_idx"], l, "c", order=l["no"], forward=True)
    sides = sides.where((b["direction"] == c["direction"]) & (b["area"] > 0) & (b["peak"] > 0))
    sides = on_zone(sides).withColumn("by_area", c["area"] < b["area"]).withColumn("by_dif", F.coalesce("near", F.lit(False)) & weaker(c, b, b["direction"]))
    broken = F.when(c["direction"] == "up", c["high"] > b["high"]).otherwise(c["low"] < b["low"])
    level = sides.where("by_area or by_dif").select(*SCOPE, "grp", F.col("z.no").alias("zone"), c["end_idx"].alias("idx"), c["direction"].alias("direction"), F.lit("panzheng").alias("sub_type"), "by_area", "by_dif", broken.alias("broken"))
    return trend.unionByName(level)


def divergences(powered: DataFrame, zones: DataFrame, macd: DataFrame) -> DataFrame:
    """Divergences of strokes (level bi) and segments (level xd)."""
    groups = zones.withColumn("scope", F.lit(0)).groupBy(*SCOPE, "grp").agg(zone_list().alias("zs_list"))
    return diverging(groups, powered.withColumn("scope", F.lit(0)), macd).drop("scope")


def walk_divergences(walks: DataFrame, powered: DataFrame, macd: DataFrame) -> DataFrame:
    """Divergences inside trend walks, by the segments inside; one row per position."""
    held = walks.select(*KEY, F.lit("walk").alias("level"), F.col("walk").cast("int").alias("scope"), "start_idx", "end_idx", "zs_list")
    spans = held.select(*KEY, "level", "scope", F.col("start_idx").alias("a"), F.col("end_idx").alias("b"))
    inside = joins.within(powered.where("level = 'xd'").drop("level"), spans, KEY, F.col("start_idx"), F.col("a"), F.col("b"), 16 * BUCKET)
    inside = inside.where("end_idx <= b").drop("a", "b")
    found = diverging(held.withColumn("grp", F.lit(0)).drop("start_idx", "end_idx"), inside, macd)
    first = Window.partitionBy(*KEY, "idx").orderBy("scope", "zone")
    return found.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "grp")


def first_points(legs: DataFrame, zones: DataFrame, found: DataFrame) -> DataFrame:
    """First points: a trend divergence and each group of two and more earlier zones of its direction."""

    keys = [*KEY, "level"]
    w = Window.partitionBy(*keys).orderBy("no")
    way = F.when(F.col("zd") > F.lag("zg").over(w), 1).when(F.col("zg") < F.lag("zd").over(w), -1).otherwise(0)
    # a zone stays in its group if it lies apart in the direction of the zone before; an overlap ends the direction
    z = zones.select(*keys, "no", "start_idx", "zg", "zd", way.alias("way")).withColumn("before", F.lag("way").over(w))
    onward = (F.col("way") != 0) & ((F.col("before") == F.col("way")) | (F.row_number().over(w) == 2))
    z = z.withColumn("_new", (~F.coalesce(onward, F.lit(False))).cast("int")).withColumn("group", F.sum("_new").over(w))
    trends = found.where("sub_type = 'trend'").select(*keys, "idx", "direction").distinct()
    # the direction a group has shown by each of its zones, and what groups that were complete before have shown
    begun = Window.partitionBy(*keys, "group").orderBy("no")
    first = F.first(F.struct("zg", "zd")).over(begun)
    z = z.withColumn("a", first).withColumn("place", F.row_number().over(begun))
    moved = F.when(F.col("place") >= 2, F.when(F.col("zd") > F.col("a.zg"), "up").when(F.col("zg") < F.col("a.zd"), "down"))
    z = z.withColumn("moved", moved).withColumn("closing", F.coalesce(F.lead("group").over(w) != F.col("group"), F.lit(False)))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    shown = lambda d: F.coalesce(F.bool_or(F.col("closing") & F.coalesce(F.col("moved") == d, F.lit(False))).over(earlier), F.lit(False)) | F.coalesce(F.col("moved") == d, F.lit(False))
    z = z.withColumn("shown", F.struct(shown("up").alias("up"), shown("down").alias("down")))
    seen = joins.as_of(trends, z, keys, F.col("idx"), F.col("start_idx"), F.col("shown"), "shown", order=F.col("no"))
    hits = seen.where(F.when(F.col("direction") == "up", F.col("shown.up")).otherwise(F.col("shown.down"))).drop("shown")
    end = legs.groupBy(*keys, F.col("end_idx").alias("idx")).agg(F.min_by("end_price", "no").alias("price"))
    return hits.join(end, [*keys, "idx"], "left").select(
        *keys, "idx", F.when(F.col("direction") == "down", "1buy").otherwise("1sell").alias("bs_type"), F.coalesce("price", F.lit(0.0)).alias("price")
    )


def second_points(legs: DataFrame, first: DataFrame) -> DataFrame:
    """After a first point, the first leg away and then the first leg back; it breaks where it passes the first price."""
    keys = [*KEY, "level"]
    first = first.select(*keys, F.col("idx").alias("at"), F.col("bs_type").alias("of"), F.col("price").alias("limit"), F.when(F.col("bs_type") == "1buy", "up").otherwise("down").alias("away"))
    ahead = Window.partitionBy(*keys).orderBy("no").rowsBetween(1, Window.unboundedFollowing)
    leg_back = lambda d: F.first(F.when(F.col("direction") == d, F.struct("end_idx", "end_price")), ignorenulls=True).over(ahead)
    out = legs.withColumn("back", F.when(F.col("direction") == "up", leg_back("down")).otherwise(leg_back("up"))).withColumn("away", F.col("direction"))
    # a leg away without a leg back yet is found as well, as the first leg away it is
    one = joins.as_of(first, out, [*keys, "away"], F.col("at"), F.col("start_idx"), F.struct("back"), "leg", order=F.col("no"), forward=True)
    rows = one.withColumn("back", F.col("leg.back")).where("back is not null")
    buy = F.col("of") == "1buy"
    holds = F.when(buy, F.col("back.end_price") >= F.col("limit")).otherwise(F.col("back.end_price") <= F.col("limit"))
    kind = F.concat(F.when(buy, "2buy").otherwise("2sell"), F.when(holds, "").otherwise("_break"))
    return rows.select(*keys, F.col("back.end_idx").alias("idx"), kind.alias("bs_type"), F.col("back.end_price").alias("price"))


def third_points(legs: DataFrame, zones: DataFrame) -> DataFrame:
    """Per zone every leg out and leg back that stays outside, unless a newer zone has begun by the leg out."""
    keys = [*KEY, "level"]
    w = Window.partitionBy(*keys).orderBy("no")
    high, low = F.greatest("start_price", "end_price"), F.least("start_price", "end_price")
    l = legs.select(*keys, "direction", F.col("start_idx").alias("out_start"), high.alias("h"), low.alias("lo"), "no")  # noqa: E741
    l = l.withColumn("back_h", F.lead("h").over(w)).withColumn("back_l", F.lead("lo").over(w)).withColumn("back_way", F.lead("direction").over(w))  # noqa: E741
    ends = legs.select(*keys, (F.col("no") - 1).alias("no"), F.col("end_idx").alias("idx"))
    l = l.join(ends, [*keys, "no"])  # noqa: E741
    z = zones.select(*keys, F.col("no").alias("zone"), "end_idx", "zg", "zd")
    # a zone counts until a newer one has begun, or to the last leg
    z = joins.as_of(z, zones, keys, F.col("end_idx"), F.col("start_idx"), F.col("start_idx"), "newer", forward=True, strict=True)
    z = z.join(l.groupBy(*keys).agg(F.max("out_start").alias("last_out")), keys)
    pairs = joins.within(l, z, keys, F.col("out_start"), F.col("end_idx"), F.coalesce(F.col("newer") - 1, F.col("last_out")), BUCKET)
    buy = (F.col("direction") == "up") & (F.col("back_way") == "down") & (F.col("h") > F.col("zg")) & (F.col("back_l") >= F.col("zg"))
    sell = (F.col("direction") == "down") & (F.col("back_way") == "up") & (F.col("lo") < F.col("zd")) & (F.col("back_h") <= F.col("zd"))
    hits = pairs.withColumn("bs_type", F.when(buy, "3buy").when(sell, "3sell")).where("bs_type is not null")
    return hits.select(*keys, "idx", "bs_type", F.when(F.col("bs_type") == "3buy", F.col("back_l")).otherwise(F.col("back_h")).alias("price"))


def points(legs: DataFrame, zones: DataFrame, found: DataFrame) -> DataFrame:
    """Buy and sell points of both levels; a second and a third point at one place and side make a 2+3 point.

    The side of a 2+3 point is the second point's, however many third points it meets. Points that several
    levels share are kept once, the stroke's.
    """
    keys = [*KEY, "level"]
    legs = legs.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n >= 3").drop("_n")
    first = first_points(legs, zones, found)
    second, third = second_points(legs, first), third_points(legs, zones)
    side = F.when(F.col("bs_type").contains("buy"), "buy").otherwise("sell")
    two = second.withColumn("side", side)
    three = third.withColumn("side", side).select(*keys, "idx", "side").distinct().withColumn("with_third", F.lit(True))
    merged = two.join(three, [*keys, "idx", "side"], "left").withColumn("bs_type", F.when(F.col("with_third"), F.concat(F.lit("2+3"), F.substring("bs_type", 2, 20))).otherwise(F.col("bs_type")))
    alone = third.withColumn("side", side).join(two.select(*keys, "idx", "side"), [*keys, "idx", "side"], "left_anti")
    every = first.unionByName(merged.select(first.columns)).unionByName(alone.select(first.columns))
    best = Window.partitionBy(*KEY, "idx", "bs_type").orderBy("level", "price")
    return every.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def nested_signals(points: DataFrame, tolerance: str | None = None) -> DataFrame:
    """Points of a timeframe confirmed by points of the next lower one on the same side; the strongest per place and type.

    With ``tolerance`` (an interval such as "3 days") ``points`` has a column ``ts``, and a point is confirmed only by points
    at most so far away in time.
    """
    side = F.when(F.col("bs_type").contains("buy"), "buy").otherwise("sell")
    p = points.withColumn("side", side).withColumn("kind", F.when(F.col("bs_type").startswith("1"), 1).otherwise(2))
    at = [] if tolerance is None else [F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")]
    lower = F.try_element_at(dims.mapping({t: l for t, l in dims.LOWER.items() if l}), F.col("tf"))
    high = p.select("symbol", "tf", lower.alias("low_tf"), "side", "idx", "price", F.col("bs_type").alias("high_type"), F.col("kind").alias("high_kind"), *at)
    keys = ["symbol", "low_tf", "side"]
    low = p.select("symbol", F.col("tf").alias("low_tf"), "side", F.struct("kind", F.col("idx").alias("low_idx"), F.col("bs_type").alias("low_type")).alias("low"), *[c.alias("low_at") for c in at])
    # a point of kind 1 confirms more strongly than one of kind 2, whatever it confirms: the best of a place is the least
    if tolerance is None:
        best = high.join(low.groupBy(*keys).agg(F.min("low").alias("low")), keys)
    else:
        seconds = points.sparkSession.sql(f"SELECT cast(interval {tolerance} AS interval day to second) AS t").first()["t"].total_seconds()
        pairs = joins.near(high, low, keys, F.col("at"), F.col("low_at"), int(seconds))
        best = pairs.groupBy(*keys, "tf", "idx", "high_type", "high_kind").agg(F.min_by("price", "low").alias("price"), F.min("low").alias("low"))
    high_kind, low_kind = F.col("high_kind"), F.col("low.kind")
    strength = F.when((high_kind == 1) & (low_kind == 1), "strong").when(high_kind != low_kind, "medium").otherwise("weak")
    way = F.when(F.col("side") == "buy", "down").otherwise("up")
    return best.select("symbol", "tf", "low_tf", "idx", "price", "high_type", "low.low_type", "low.low_idx", way.alias("direction"), strength.alias("strength"))
