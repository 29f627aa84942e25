"""Ordered and bucketed joins against all pairs, and the operators that stand on them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels
from tickloom.functions.windows import KEY
from tickloom.operators import bars as B
from tickloom.operators import fusion, joins, signals, structure, wyckoff
from tickloom.sources import fixtures, payloads, shared, tables
from tickloom.sources.shared import Tables, shared_folder


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(5)
    place = lambda: rnd.choice([None, *range(-30, 60)]) if rnd.random() < 0.2 else rnd.randrange(-30, 60)
    left = [(rnd.choice("ab"), k, place()) for k in range(80)]
    right = [(rnd.choice("abc"), 100 + k, place()) for k in range(60)]
    return left, right, spark.createDataFrame(left, "s string, l int, at int"), spark.createDataFrame(right, "s string, r int, at int")


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of(sides, forward, strict):
    left, right, a, b = sides
    got = joins.as_of(a, b, ["s"], F.col("at"), F.col("at"), F.col("r"), "r", order=F.col("r"), forward=forward, strict=strict)
    want = []
    for s, k, at in left:
        fits = [(y, r) for t, r, y in right if t == s and None not in (y, at) and ((y > at if strict else y >= at) if forward else (y < at if strict else y <= at))]
        best = (min if forward else max)(fits, default=(None, None))
        want.append((s, k, at, best[1]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert joins.as_of(a.limit(0), b, ["s"], F.col("at"), F.col("at"), F.col("r"), "r").count() == 0
    assert joins.as_of(a, b.limit(0), ["s"], F.col("at"), F.col("at"), F.col("r"), "r").where("r is not null").count() == 0


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_within_and_near(sides, width):
    left, right, a, b = sides
    spans = b.withColumn("end", F.col("at") + F.pmod("r", F.lit(15)) - 2).withColumnRenamed("at", "start")
    got = joins.within(a, spans, ["s"], F.col("at"), F.col("start"), F.col("end"), width)
    want = [(s, k, r) for s, k, at in left for t, r, y in right if s == t and None not in (at, y) and y <= at <= y + r % 15 - 2]
    assert sorted(map(tuple, got.select("s", "l", "r").collect())) == sorted(want)
    pairs = joins.near(a, b.withColumnRenamed("at", "other"), ["s"], F.col("at"), F.col("other"), width - 1)
    want = [(s, k, r) for s, k, at in left for t, r, y in right if s == t and None not in (at, y) and abs(at - y) <= width - 1]
    assert sorted(map(tuple, pairs.select("s", "l", "r").collect())) == sorted(want)
    for df in (got, pairs):  # no side is paired as a whole
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_search_by_parts(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab浦发.") for _ in range(n))
    names = [(f"{rnd.randrange(20):02}{k:03}", word(rnd.randrange(0, 7)) if k % 9 else None, "".join(rnd.choice("pf") for _ in range(rnd.randrange(5)))) for k in range(120)]
    words = ["", "0", "1", "10", "000", "0001", "00011", "PF", "fpf", "浦", "发浦", "a.b", "a浦发", "zz", "zzz", "a", "pfpfpfpf", None] + [word(rnd.randrange(1, 6)) for _ in range(30)] + [names[5][0], names[7][1]]
    want = []
    for w in set(words) - {None}:
        hits = [(s, n, a) for s, n, a in names if w in s or (n is not None and w in n) or w.lower() in a]
        hits.sort(key=lambda x: (not x[0].startswith(w), not x[2].startswith(w.lower()), x[0]))
        want += [(w, s, k) for k, (s, _, _) in enumerate(hits, 1)]
    found = B.searched(spark.createDataFrame(names + names[:3], "symbol string, name string, abbreviation string"), spark.createDataFrame([(w, 1) for w in words + words[:4]], "keyword string, n int"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def series(spark, closes, vols=None):
    rows = [("s", "d", k, float(c), float((vols or [1.0] * len(closes))[k])) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, tf string, idx int, close double, vol double")


def test_ranges_end_at_the_first_three_closes_outside(spark):
    """Blocks are opened only where a close may be outside; the end is that of looking at every bar."""
    rnd = random.Random(12)
    closes, price = [], 100.0
    for k in range(900):
        price += rnd.choice([-3, -1, 0, 1, 3]) + (100 - price) * (0.05 if k < 500 else 0.0)
        closes.append(price)
    bars = series(spark, closes)
    ranges = [(a, a + 3, 100.0 + w, 100.0 - w) for a in range(0, 880, 17) for w in (0.5, 4.0, 9.0, 30.0)]
    got = wyckoff.first_left(spark.createDataFrame([("s", "d", *r) for r in ranges], "symbol string, tf string, start_idx int, ar int, upper double, lower double"), bars)
    want = set()
    for start, ar, up, low in ranges:
        out = [c > 1.02 * up or c < 0.98 * low for c in closes]
        first = next((k for k in range(ar, len(closes) - 2) if out[k] and out[k + 1] and out[k + 2]), None)
        if first is not None:
            want.add((start, up, low, first))
    assert {(r.start_idx, r.upper, r.lower, r.by_close) for r in got.collect()} == want and 20 < len(want) < len(ranges)


def test_line_breaks_are_those_of_every_bar(spark):
    rnd = random.Random(4)
    closes = [100 + 20 * rnd.random() + k / 20 for k in range(700)]
    vols = [rnd.choice([1.0, 1.0, 2.0]) for _ in closes]
    lines = [("supply", 5, 80, 118.0, 0.02), ("demand", 0, 60, 104.0, 0.01), ("supply", 3, 400, 120.0, -0.5), ("demand", 3, 10, 110.0, 0.4), ("supply", 1, 699, 1.0, 0.0), ("demand", 9, 300, -5.0, -0.1), ("ice", 0, 5, 1.0, 0.0)]
    rows = spark.createDataFrame([("s", "d", *x[:3], x[3], x[3], x[4]) for x in lines], "symbol string, tf string, line_type string, start_idx int, end_idx int, start_price double, end_price double, slope double")
    mv, want = sum(vols) / len(vols), set()
    for kind, start, end, price, slope in lines:
        for k in range(end + 1, len(closes)):
            level = price + slope * (k - start)
            gap = (closes[k] - level) / level if level else 0.0
            if vols[k] > 1.3 * mv and ((kind == "supply" and gap > 0.03) or (kind == "demand" and gap < -0.03)):
                want.add((k, kind, start))
    got = wyckoff.line_breaks(series(spark, closes, vols), rows).collect()
    assert {(r.idx, r.line_type, r.start_idx) for r in got} == want and len(got) == len(want) > 50


def test_nested_signals_within_a_tolerance(spark):
    rnd = random.Random(2)
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * k)
    points = [(rnd.choice("xy"), tf, k, f"{rnd.randrange(1, 4)}{rnd.choice(['buy', 'sell'])}", float(k), day(rnd.randrange(200))) for tf in ("d", "f60") for k in range(60)]
    df = spark.createDataFrame(points, "symbol string, tf string, idx int, bs_type string, price double, ts timestamp_ntz")
    for tolerance, reach in ((None, None), ("36 hours", 36), ("0 hours", 0)):
        want = set()
        for s, tf, k, kind, price, ts in points:
            if tf != "d":
                continue
            fits = [(p[3][0] != "1", p[2], p[3]) for p in points if p[1] == "f60" and p[0] == s and p[3][1:] == kind[1:] and (reach is None or abs(p[5] - ts) <= dt.timedelta(hours=reach))]
            if fits:
                weaker, low, low_type = min(fits)
                strength = "strong" if kind[0] == "1" and not weaker else "medium" if (kind[0] == "1") != (not weaker) else "weak"
                want.add((s, k, kind, low, low_type, strength, "down" if "buy" in kind else "up"))
        got = signals.nested_signals(df, tolerance) if tolerance else signals.nested_signals(df.drop("ts"))
        assert {(r.symbol, r.idx, r.high_type, r.low_idx, r.low_type, r.strength, r.direction) for r in got.collect()} == want
        assert bool(want)


def test_points_after_points(spark):
    """Second and third points on legs written by hand, against a plain reading of the rules."""
    rnd = random.Random(8)
    legs, price, at = [], 100.0, 0
    for no in range(60):
        end, to = at + rnd.randrange(4, 12), price + (1 if no % 2 == 0 else -1) * rnd.randrange(1, 12)
        legs.append(("s", "d", "bi", no, "up" if to > price else "down", at, end, price, float(to), True))
        price, at = float(to), end
    zones = [("s", "d", "bi", k, 0, legs[n][5], legs[n + 2][6], max(min(x[7:9]) for x in legs[n : n + 3]) + 3.0, max(min(x[7:9]) for x in legs[n : n + 3]), 0.0, 0.0) for k, n in enumerate(range(2, 55, 5))]
    l = spark.createDataFrame(legs, "symbol string, tf string, level string, no int, direction string, start_idx int, end_idx int, start_price double, end_price double, finished boolean")  # noqa: E741
    z = spark.createDataFrame(zones, "symbol string, tf string, level string, no int, grp int, start_idx int, end_idx int, zg double, zd double, gg double, dd double")
    first = [("s", "d", "bi", legs[n][6], kind, legs[n][8]) for n, kind in ((3, "1buy"), (20, "1sell"), (31, "1buy"), (57, "1buy"), (59, "1sell"))]
    want = set()
    for *_, idx, kind, limit in first:
        away = "up" if kind == "1buy" else "down"
        out = next((x for x in legs if x[5] >= idx and x[4] == away), None)
        back = next((x for x in legs if out and x[3] > out[3] and x[4] != away), None)
        if back:
            holds = back[8] >= limit if kind == "1buy" else back[8] <= limit
            want.add((back[6], ("2buy" if kind == "1buy" else "2sell") + ("" if holds else "_break"), back[8]))
    got = signals.second_points(l, spark.createDataFrame(first, "symbol string, tf string, level string, idx int, bs_type string, price double"))
    assert {(r.idx, r.bs_type, r.price) for r in got.collect()} == want
    want = set()
    for zone in zones:
        for a, b in zip(legs, legs[1:]):
            if a[5] < zone[6] or any(zone[6] < other[5] <= a[5] for other in zones):
                continue
            if a[4] == "up" and b[4] == "down" and max(a[7:9]) > zone[7] and min(b[7:9]) >= zone[7]:
                want.add((b[6], "3buy", min(b[7:9])))
            if a[4] == "down" and b[4] == "up" and min(a[7:9]) < zone[8] and max(b[7:9]) <= zone[8]:
                want.add((b[6], "3sell", max(b[7:9])))
    assert {(r.idx, r.bs_type, r.price) for r in signals.third_points(l, z).collect()} == want and want


def test_no_join_pairs_whole_series(spark, sf):
    """Every equi-join of the chain has a place among its keys, or one side has a row a series."""
    bars = fixtures.bars_walk(spark, sf).where("symbol = '600005'")
    found = structure.structures(bars)
    legs, zones = structure.legs(found), structure.zones(found)
    first = spark.createDataFrame([], "symbol string, tf string, level string, idx int, bs_type string, price double")
    for df in (signals.second_points(legs, first), signals.third_points(legs, zones)):
        assert "NestedLoop" not in df._jdf.queryExecution().toString()


def test_a_table_that_is_not_there_has_no_rows(spark):
    found = tables.read_bars(spark, f"{shared_folder(spark)}/none-at-all")
    assert found.count() == 0 and found.columns[:4] == ["symbol", "tf", "ts", "has_time"]


def test_damaged_payloads(spark):
    """Bad numbers are 0, short rows go, missing keys are 0; what holds no rows gives none."""
    rows = {
        "objects": ['[{"day":"2024-01-02","open":"x","high":"2","low":"","close":null,"volume":"5"},{"day":"2024-01-03"}]', "null", "", "[]", "{"],
        "keyed_rows": ['{"data":{"k":{"week":[["2024-01-02","1","2","3"],["2024-01-03","1","?","3","4","5"]]}}}', '{"data":{"k":{}}}', '{"data":null}', "", "null"],
        "lines": ['{"data":{"klines":["2024-01-02,1,2","2024-01-03,1,-,3,4,5,6"]}}', '{"data":{"klines":null}}', '{"data":null}', "", "["],
        "table": ['{"data":{"fields":["trade_date","close","open"],"items":[["20240102","0","0"],["20240103","4"],["20240104","1","2"]]}}', '{"data":{"fields":[],"items":[["20240102"]]}}', "null", ""],
    }
    want = {
        "objects": [("2024-01-02", 0.0, 2.0, 0.0, 0.0, 5.0), ("2024-01-03", 0.0, 0.0, 0.0, 0.0, 0.0)], "keyed_rows": [("2024-01-03", 1.0, 3.0, 4.0, 0.0, 5.0)],
        "lines": [("2024-01-03", 1.0, 3.0, 4.0, 0.0, 5.0)], "table": [("2024-01-03", 0.0, 0.0, 0.0, 4.0, 0.0), ("2024-01-04", 2.0, 0.0, 0.0, 1.0, 0.0)],
    }
    for layout, texts in rows.items():
        landed = spark.createDataFrame([("s", "d", t) for t in [*texts, None]], "symbol string, tf string, payload string")
        got = payloads.READERS[layout](landed).select(F.date_format("ts", "yyyy-MM-dd"), "open", "high", "low", "close", "vol")
        assert sorted(map(tuple, got.collect())) == want[layout], layout


def planned(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_spread_rows_are_not_broadcast(sides, spark):
    a, b = (Tables(spark).keep(x) for x in sides[2:])  # of tables in files the planner knows the size
    at = F.col("at")
    right = b.withColumnRenamed("at", "to")
    macd = a.select(F.col("s").alias("symbol"), F.lit("d").alias("tf"), F.col("l").alias("idx"), F.lit(1.0).alias("dif"), F.lit(1.0).alias("macd_hist"))
    zones = macd.select("symbol", "tf", F.lit(0).alias("start_idx"), F.lit(9).alias("end_idx"))
    legs = zones.select("*", F.lit("bi").alias("level"), F.lit(0).alias("no"), F.lit("up").alias("direction"), F.lit(1.0).alias("start_price"), F.lit(2.0).alias("end_price"))
    names = a.select(F.col("s").alias("symbol"), F.col("s").alias("name"), F.col("s").alias("abbreviation"))
    points = macd.select("symbol", "tf", F.lit("bi").alias("level"), "idx", F.lit("1buy").alias("bs_type"), F.lit(1.0).alias("price"))
    events = macd.select("symbol", "tf", "idx", F.lit("SC").alias("event_type"), F.lit(0).alias("seq"))
    spread = {
        "within": joins.within(a, right, ["s"], at, F.col("to"), F.col("to") + 9, 7), "near": joins.near(a, right, ["s"], at, F.col("to"), 7),
        "near_zero": signals.near_zero(zones, macd), "leg_power": signals.leg_power(legs, macd), "fused": fusion.fused(points, events),
        "searched": B.searched(names, names.select(F.col("name").alias("keyword"))),
    }
    for name, rows in spread.items():
        plan = planned(rows)
        below = [part for part in plan.split("BroadcastExchange")[1:] if "Generate explode" in part.split("Exchange hash")[0]]
        assert "SortMergeJoin" in plan and not below, name


def test_large_steps_are_not_broadcast(sides, spark, monkeypatch):
    _, _, a, b = sides
    kept = Tables(spark).keep(b).select("s", "r").where("r > 3")
    assert "BroadcastHashJoin" in planned(a.join(kept, "s"))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    kept = Tables(spark).keep(b).select("s", "r").where("r > 3")
    assert "BroadcastHashJoin" not in planned(a.join(kept, "s"))


def test_swings_are_grouped_once(spark, sf):
    """Highs and lows of a series come from one fold, after one shuffle; groups of both sides pair up."""
    bars = fixtures.bars_walk(spark, sf)
    plan = wyckoff.ranges_from_swings(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("FlatMapGroups") == 1 and "Join" not in plan
    got = sorted(tuple(r) for r in wyckoff.ranges_from_swings(bars).collect())
    points, want = sorted(tuple(r) for r in wyckoff.swings(bars).select(*KEY, "kind", "idx", "price").collect()), []
    for series in {p[:2] for p in points}:
        sides = []
        for kind in ("high", "low"):
            mine = [p[3:] for p in points if p[:3] == (*series, kind)]
            groups = kernels.price_groups([p for _, p in mine], 0.05)
            sides.append([(sum(mine[k][1] for k in g) / len(g), mine[g[0]][0], mine[g[-1]][0]) for g in groups])
        want += [(*series, min(a[1], b[1]), max(a[2], b[2]), a[0], b[0]) for a in sides[0] for b in sides[1] if a[0] > b[0] and (a[0] - b[0]) / b[0] < 0.2]
    assert got == sorted(want) and want


def test_phases_deal_series_once(spark, sf):
    bars = Tables(spark).keep(fixtures.bars_walk(spark, sf))
    found = Tables(spark).keep(wyckoff.events(bars))
    ranges = Tables(spark).keep(wyckoff.trading_ranges(bars, found))
    plan = planned(wyckoff.phases(bars, found, ranges))
    assert plan.count("Exchange") == 1 and "Join" not in plan
