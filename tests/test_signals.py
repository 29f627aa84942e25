"""Divergences, points and fusion on hand-made legs, zones and events."""

import pytest

from tickloom.operators import fusion, signals

LEGS = "symbol string, tf string, level string, no int, direction string, start_idx int, end_idx int, start_price double, end_price double, finished boolean"
ZONES = "symbol string, tf string, level string, no int, grp int, start_idx int, end_idx int, zg double, zd double, gg double, dd double"
POINTS = "symbol string, tf string, level string, idx int, bs_type string, price double"
FOUND = "symbol string, tf string, level string, idx int, direction string, sub_type string"


def legs(spark, prices, start=0, step=10):
    rows = [("s", "d", "bi", k, "up" if b > a else "down", start + k * step, start + (k + 1) * step, float(a), float(b), True) for k, (a, b) in enumerate(zip(prices, prices[1:]))]
    return spark.createDataFrame(rows, LEGS)


def zones(spark, *rows):
    return spark.createDataFrame([("s", "d", "bi", k, 0, a, b, float(zg), float(zd), float(zg) + 1, float(zd) - 1) for k, (a, b, zg, zd) in enumerate(rows)], ZONES)


def kinds(df):
    return sorted((r.idx, r.bs_type) for r in df.collect())


def test_leg_power(spark):
    hist = [1.0, 2.0, 3.0, -1.0, 2.0]
    macd = spark.createDataFrame([("s", "d", k, h, 0.0, h) for k, h in enumerate(hist)], "symbol string, tf string, idx int, dif double, dea double, macd_hist double")
    up = legs(spark, [1, 2], step=4)
    row = signals.leg_power(up, macd).first()
    assert (row.area, row.peak) == (8.0, 3.0)


@pytest.mark.parametrize("back,expected", [(36, "2buy"), (31, "2buy"), (29, "2buy_break")])
def test_second_point(spark, back, expected):
    first = spark.createDataFrame([("s", "d", "bi", 10, "1buy", 31.0)], POINTS)
    found = signals.second_points(legs(spark, [50, 31, 44, back]), first)
    assert kinds(found) == [(30, expected)]


@pytest.mark.parametrize("back,expected", [(37, 1), (33, 1), (30, 0)])
def test_third_point(spark, back, expected):
    found = signals.third_points(legs(spark, [21, 47, back], start=45), zones(spark, (3, 45, 33, 29)))
    assert len(kinds(found)) == expected


def test_newer_zone_takes_over(spark):
    found = signals.third_points(legs(spark, [21, 47, 37], start=52), zones(spark, (3, 45, 33, 29), (48, 51, 66, 61)))
    assert kinds(found) == []


def test_first_point_needs_two_zones_of_the_direction(spark):
    z = zones(spark, (2, 9, 71, 66), (14, 22, 52, 47))
    found = spark.createDataFrame([("s", "d", "bi", 34, "down", "trend"), ("s", "d", "bi", 34, "up", "trend"), ("s", "d", "bi", 12, "down", "trend")], FOUND)
    first = signals.first_points(legs(spark, [58, 39], start=24), z, found)
    assert [(r.idx, r.bs_type, r.price) for r in first.collect()] == [(34, "1buy", 39.0)]  # one zone, or another direction, makes none


def test_second_and_third_point_become_one_of_the_second_points_side(spark):
    z = zones(spark, (2, 9, 71, 66), (14, 22, 52, 47), (25, 33, 36, 31))
    found = spark.createDataFrame([("s", "d", "bi", 34, "down", "trend")], FOUND)
    points = signals.points(legs(spark, [58, 29, 49, 40], start=24), z, found)
    assert kinds(points) == [(34, "1buy"), (54, "2+3buy")]


def event(idx, name, seq=0):
    return ("s", "d", idx, name, seq)


EVENTS = "symbol string, tf string, idx int, event_type string, seq int"


@pytest.mark.parametrize("point,events,expected", [
    (("1buy", 100), [event(98, "Spring")], [(5, "bullish", "Spring")]),
    (("1sell", 200), [event(202, "UTAD")], [(5, "bearish", "UTAD")]),
    (("1buy", 100), [event(10, "BC")], []),
    (("2buy", 100), [event(102, "SC")], [(2, "bullish", "SC")]),
    (("1buy", 100), [event(101, "SC"), event(99, "Spring")], [(5, "bullish", "Spring")]),
    (("1buy", 100), [event(105, "ST"), event(106, "Spring")], [(4, "bullish", "ST")]),
])
def test_fusion(spark, point, events, expected):
    points = spark.createDataFrame([("s", "d", "bi", point[1], point[0], 1.0)], POINTS)
    found = fusion.fused(points, spark.createDataFrame(events, EVENTS))
    assert [(r.strength, r.direction, "/".join(r.events)) for r in found.collect()] == expected


@pytest.mark.parametrize("high,low,expected", [("1buy", "1buy", ["strong"]), ("1buy", "2buy", ["medium"]), ("2buy", "3buy", ["weak"]), ("1buy", "1sell", [])])
def test_nested_strength(spark, high, low, expected):
    points = spark.createDataFrame([("s", "d", "bi", 1, high, 1.0), ("s", "f60", "bi", 2, low, 1.0)], POINTS)
    assert [r.strength for r in signals.nested_signals(points).collect()] == expected
