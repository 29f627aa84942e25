"""Price structure: merged bars, fractals, strokes, segments, zones and trend walks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import kernels
from tickloom.functions.windows import KEY, dealt

# Fixed value: shorter series have no structure.
MIN_BARS = 5


def long_enough(bars: DataFrame, least: int = MIN_BARS) -> DataFrame:
    return bars.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("_n") >= least).drop("_n")


def merged_bars(bars: DataFrame) -> DataFrame:
    """Bars after inclusion removal: ``idx`` is the first raw bar's, ``ts`` the extreme bar's time, ``pos`` the place."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable").reset_index(drop=True)
        found = kernels.merge_inclusions(*(rows[c].to_numpy(float) for c in ("high", "low", "vol", "amount")))
        return pd.DataFrame({
            "symbol": rows["symbol"].iloc[0], "tf": rows["tf"].iloc[0], "pos": range(len(found)), "idx": rows["idx"].to_numpy()[[m.first for m in found]],
            "ts": rows["ts"].to_numpy()[[m.extreme for m in found]], "high": [m.high for m in found], "low": [m.low for m in found],
            "members": [m.members for m in found], "vol": [m.vol for m in found], "amount": [m.amount for m in found],
        })

    schema = "symbol string, tf string, pos int, idx int, ts timestamp_ntz, high double, low double, members int, vol double, amount double"
    return dealt(bars.select(*KEY, "idx", "ts", "high", "low", "vol", "amount")).groupBy(*KEY).applyInPandas(fold, schema)


def fractals(merged: DataFrame) -> DataFrame:
    """Alternating tops and bottoms of merged bars: of a run of one kind the most extreme, the earliest on ties."""
    w = Window.partitionBy(*KEY).orderBy("pos")
    around = [(F.lag(c).over(w), F.lead(c).over(w)) for c in ("high", "low")]
    above = [(F.col(c) > a) & (F.col(c) > b) for c, (a, b) in zip(("high", "low"), around)]
    below = [(F.col(c) < a) & (F.col(c) < b) for c, (a, b) in zip(("high", "low"), around)]
    kind = F.when(above[0] & above[1], "top").when(below[0] & below[1], "bottom")
    marks = merged.withColumn("fx_type", kind).where("fx_type is not null")
    marks = marks.withColumn("price", F.when(F.col("fx_type") == "top", F.col("high")).otherwise(F.col("low")))
    turned = marks.withColumn("_new", (~F.col("fx_type").eqNullSafe(F.lag("fx_type").over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    extreme = F.when(F.col("fx_type") == "top", -F.col("price")).otherwise(F.col("price"))
    best = Window.partitionBy(*KEY, "_run").orderBy(extreme, "pos")
    return turned.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*KEY, "pos", "idx", "ts", "fx_type", "price")


STRUCTURE = "symbol string, tf string, level string, kind string, no int, grp int, direction string, start_idx int, end_idx int, start_price double, end_price double, zg double, zd double, gg double, dd double, finished boolean"


def structures(bars: DataFrame) -> DataFrame:
    """Strokes and segments (kind leg, level bi or xd), zones of either, and the walks' zones (kind walk_zone).

    One fold per series, from bars to zones, because each step needs the one before as a whole; ``grp`` of a
    zone is its trend group. Times are joined back from the bars on their positions.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        raw = [rows[c].to_numpy(float) for c in ("high", "low", "vol", "amount")]
        merged = kernels.merge_inclusions(*raw)
        idx = rows["idx"].to_numpy()
        high, low = [m.high for m in merged], [m.low for m in merged]
        at = lambda p: int(idx[merged[p].first])
        price = lambda p, top: high[p] if top else low[p]
        bi = [(way, at(a), at(b), price(a, way < 0), price(b, way > 0), True) for a, b, way in kernels.strokes(high, low)]
        highs, lows = [max(x[3:5]) for x in bi], [min(x[3:5]) for x in bi]
        xd = []
        for s in kernels.segments([x[0] for x in bi], highs, lows):
            first, last, way = bi[s.legs[0]], bi[s.legs[-1]], 1 if s.up else -1
            xd.append((way, first[1], last[2], first[3] if first[0] == way else first[4], last[4] if last[0] == way else last[3], s.finished))
        out = []
        for level, legs in (("bi", bi), ("xd", xd)):
            out += [(level, "leg", k, None, "up" if w > 0 else "down", a, b, p, q, None, None, None, None, f) for k, (w, a, b, p, q, f) in enumerate(legs)]
            h, l = [max(x[3:5]) for x in legs], [min(x[3:5]) for x in legs]  # noqa: E741
            for kind, found in (("zone", kernels.zones(h, l) if len(legs) >= 3 else []), ("walk_zone", kernels.sliding_zones(h, l) if level == "xd" else [])):
                groups = kernels.trend_groups([z.top for z in found], [z.bottom for z in found])
                for k, (z, g) in enumerate(zip(found, groups)):
                    inside = slice(z.first, z.last + 1)
                    out.append((level, kind, k, g, None, legs[z.first][1], legs[z.last][2], None, None, z.top, z.bottom, max(h[inside]), min(l[inside]), None))
        names = [c.split()[0] for c in STRUCTURE.split(", ")][2:]
        frame = pd.DataFrame(out, columns=names, dtype=object)
        frame.insert(0, "tf", rows["tf"].iloc[0])
        frame.insert(0, "symbol", rows["symbol"].iloc[0])
        return frame

    return long_enough(dealt(bars.select(*KEY, "idx", "high", "low", "vol", "amount"))).groupBy(*KEY).applyInPandas(fold, STRUCTURE)


def with_times(rows: DataFrame, bars: DataFrame, *columns: str) -> DataFrame:
    """Adds ``ts`` columns for position columns: start_idx gives start_ts, idx gives ts."""
    for c in columns:
        times = bars.select(*KEY, F.col("idx").alias(c), F.col("ts").alias(c.replace("idx", "ts")))
        rows = rows.join(times, [*KEY, c], "left")
    return rows


def legs(found: DataFrame) -> DataFrame:
    return found.where("kind = 'leg'").select(*KEY, "level", "no", "direction", "start_idx", "end_idx", "start_price", "end_price", "finished")


def zones(found: DataFrame) -> DataFrame:
    return found.where("kind = 'zone'").select(*KEY, "level", "no", "grp", "start_idx", "end_idx", "zg", "zd", "gg", "dd")


def segment_extremes(found: DataFrame) -> DataFrame:
    """no, direction, end_idx, end_price, extreme_idx of every segment: where its end price stands.

    The last stroke of a segment may run against it. Then the end price is that stroke's start price, while the segment
    ends, as its structure says, where the stroke does; ``extreme_idx`` is the place of the price.
    """
    last = legs(found).where("level = 'bi'").select(*KEY, "end_idx", F.col("start_idx").alias("_start"), F.col("direction").alias("_way"))
    rows = legs(found).where("level = 'xd'").join(last, [*KEY, "end_idx"])
    extreme = F.when(F.col("_way") == F.col("direction"), F.col("end_idx")).otherwise(F.col("_start"))
    return rows.select(*KEY, "no", "direction", "end_idx", "end_price", extreme.alias("extreme_idx"))


def zone_list() -> Column:
    """The zones of a group in order, for an aggregation."""
    return F.array_sort(F.collect_list(F.struct("no", "start_idx", "end_idx", "zg", "zd")))


def walks(found: DataFrame) -> DataFrame:
    """Trend walks over segments: one zone makes an unfinished consolidation, else zones are grouped while they progress.

    A walk starts one leg before its first zone and ends one leg after its last; see ``zs_list`` for its zones.
    """
    z = found.where("kind = 'walk_zone'").select(*KEY, "no", "start_idx", "end_idx", "zg", "zd")
    w = Window.partitionBy(*KEY).orderBy("no")
    onward = (F.col("zd") > F.lag("zd").over(w)) | (F.col("zg") < F.lag("zg").over(w))
    z = z.withColumn("_new", (~F.coalesce(onward, F.lit(False))).cast("int")).withColumn("walk", F.sum("_new").over(w) - 1)
    z = z.withColumn("_zones", F.count("*").over(Window.partitionBy(*KEY)))
    groups = z.groupBy(*KEY, "walk").agg(zone_list().alias("zs_list"), F.first("_zones").alias("zones"))
    xd = legs(found).where("level = 'xd'")
    numbered = xd.select(*KEY, F.col("no").alias("leg"), F.col("start_idx").alias("s"), F.col("end_idx").alias("e"), "start_price", "end_price", F.count("*").over(Window.partitionBy(*KEY)).alias("n"))
    first, last = F.element_at("zs_list", 1), F.element_at("zs_list", -1)
    near = groups.join(numbered, KEY).groupBy(*KEY, "walk").agg(
        F.min(F.when((F.col("s") == first["start_idx"]) | (F.col("e") == first["start_idx"]), F.col("leg"))).alias("a"),
        F.min(F.when((F.col("s") == last["end_idx"]) | (F.col("e") == last["end_idx"]), F.col("leg"))).alias("b"), F.first("n").alias("n"),
    )
    near = near.select(*KEY, "walk", F.greatest(F.lit(0), F.coalesce("a", F.lit(0)) - 1).alias("a"), F.least(F.col("n") - 1, F.coalesce("b", F.col("n") - 1) + 1).alias("b"))
    start = numbered.select(*KEY, F.col("leg").alias("a"), F.col("s").alias("start_idx"), "start_price")
    end = numbered.select(*KEY, F.col("leg").alias("b"), F.col("e").alias("end_idx"), "end_price")
    rows = groups.join(near, [*KEY, "walk"]).join(start, [*KEY, "a"]).join(end, [*KEY, "b"])
    single = F.col("zones") == 1
    k = F.size("zs_list")
    rises = F.forall(F.when(k > 1, F.sequence(F.lit(2), k)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at("zs_list", i)["zd"] >= F.element_at("zs_list", i - 1)["zd"])
    up = F.when(single, F.col("start_price") < F.col("end_price")).otherwise(rises)
    return rows.select(
        *KEY, "walk", F.when(up, "up").otherwise("down").alias("direction"), F.when(k >= 2, "trend").otherwise("panzheng").alias("walk_type"),
        "start_idx", "end_idx", "start_price", "end_price", "zs_list", (~single).alias("finished"),
    )
