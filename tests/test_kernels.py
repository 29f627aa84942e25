"""Small exact cases of the folds."""

import random

import numpy as np
import pytest

from tickloom.functions import kernels as K
from tickloom.operators import indicators
from tickloom.sources import fixtures


def merged(pairs):
    high, low = zip(*pairs)
    return [(m.high, m.low) for m in K.merge_inclusions(high, low, [1] * len(pairs), [1] * len(pairs))]


def test_inclusion_along_the_direction():
    up = merged([(11, 10), (12, 9.5), (11.5, 10.5)])
    assert len(up) == 2 and up[-1] == (12, 10.5)
    down = merged([(13, 11.5), (12, 9.5), (11, 10)])
    assert len(down) == 2 and down[-1] == (11, 9.5)


def test_equal_highs_before_are_not_merged():
    assert len(merged([(12, 10), (12, 11), (13, 9)])) == 3


def test_fractals_alternate():
    marks = K.fractals([10, 12, 11.5, 13, 10, 9, 11], [9, 11, 11.2, 12, 9, 8, 10])
    assert [k for _, k in marks] == [1, -1]
    assert marks[0][0] == 3


@pytest.mark.parametrize("apart,expected", [(3, 0), (4, 1)])
def test_free_bars_at_the_boundary(apart, expected):
    marks = [(1, 1), (1 + apart, -1)]
    high, low = [20] * 10, [5] * 10
    assert len(K.pair_up(marks, high, low, move_previous=False)) == expected


def test_features():
    assert K.merged_features([(10, 7), (9, 8)], True) == [(9, 7)]
    assert K.merged_features([(8, 5), (7, 6)], False) == [(8, 6)]
    assert K.feature_gap([(12, 10), (9, 7)], True)
    assert not K.feature_gap([(12, 8), (11, 7)], True)
    assert K.feature_gap([(7, 5), (12, 10)], False)


def legs(prices):
    way = [1 if b > a else -1 for a, b in zip(prices, prices[1:])]
    return way, [max(x) for x in zip(prices, prices[1:])], [min(x) for x in zip(prices, prices[1:])]


def test_first_segment_is_up_and_finished():
    found = K.segments(*legs([10, 15, 13, 18, 16, 17, 11]))
    assert found[0].up and found[0].finished


def test_zones():
    _, high, low = legs([10, 15, 12, 14])
    (z,) = K.zones(high, low)
    assert (z.top, z.bottom) == (14, 12)
    _, high, low = legs([10, 15, 12, 14, 13, 18, 16, 20, 17])
    assert [(z.bottom, z.top) for z in K.zones(high, low)] == [(13, 14), (17, 18)]
    _, high, low = legs([10, 20, 15, 18, 16, 17, 16.5])
    (z,) = K.zones(high, low)
    assert (z.top, z.bottom) == (17, 16.5)


def test_trend_groups():
    assert K.trend_groups([12, 15, 8], [10, 13, 6]) == [0, 0, 1]


def test_macd_lengths_at_the_boundary():
    assert K.macd(np.arange(25.0)) is None
    dif, dea, hist = K.macd(np.arange(26.0))
    assert len(dif) == len(dea) == len(hist) == 26 and dif[10] == 0 and dif[11] == 5.5


@pytest.mark.parametrize("seed", range(6))
def test_structure_invariants_on_random_walks(seed):
    rnd = random.Random(seed)
    price, high, low = 100.0, [], []
    for _ in range(500):
        price = max(5.0, price + rnd.uniform(-3, 3))
        high.append(price + rnd.random())
        low.append(price - rnd.random())
    m = K.merge_inclusions(high, low, high, high)
    strokes = K.strokes([x.high for x in m], [x.low for x in m])
    assert strokes and all(a[1] == b[0] and a[2] == -b[2] for a, b in zip(strokes, strokes[1:]))
    hs, ls = [x.high for x in m], [x.low for x in m]
    top = [max(hs[a], hs[b]) for a, b, _ in strokes]
    bottom = [min(ls[a], ls[b]) for a, b, _ in strokes]
    found = K.segments([w for *_, w in strokes], top, bottom)
    assert all(x.finished for x in found[:-1])
    assert all(z.bottom <= z.top for z in K.zones(top, bottom) + K.sliding_zones(top, bottom))


@pytest.mark.parametrize("block", [26, 64, 100])
@pytest.mark.parametrize("periods", [(12, 26, 9), (5, 9, 9), (9, 26, 9), (3, 4, 20)])
def test_means_by_blocks_are_those_of_the_whole(block, periods):
    rnd = np.random.default_rng(1)
    for n in (1, 25, 26, 27, 99, 500):
        close = 100 + rnd.normal(size=n).cumsum()
        parts = [close[k : k + block] for k in range(0, n, block)]
        ends = [tuple(x[-1] for x in K.macd_block(p, periods, (0.0, 0.0, 0.0) if k else None)) for k, p in enumerate(parts)]
        starts = [None, *K.macd_starts([len(p) for p in parts], ends, periods)]
        found = [np.concatenate(x) for x in zip(*(K.macd_block(p, periods, s) for p, s in zip(parts, starts)))]
        whole = K.macd_block(close, periods, None)
        assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(found, whole))


def test_macd_by_blocks_deals_a_series_over_tasks(spark, sf):
    bars = fixtures.bars_walk(spark, sf).where("symbol in ('600005', '000001') or (symbol = '300002' and idx < 20)")
    got = indicators.macd_by_blocks(bars, block=32)
    values = lambda df: {(r.symbol, r.idx): (r.dif, r.dea, r.macd_hist) for r in df.collect()}
    a, b = values(got), values(indicators.macd(bars))
    assert set(a) == set(b) and all(x == y or all(abs(p - q) < 1e-9 for p, q in zip(x, y)) for x, y in ((a[k], b[k]) for k in a))
    with pytest.raises(ValueError):
        indicators.macd_by_blocks(bars, block=20)


def test_price_groups_read_each_price_once():
    class Read(list):
        times = 0

        def __getitem__(self, k):
            self.times += 1
            return super().__getitem__(k)

    rnd = random.Random(3)
    prices = Read(rnd.choice([10.0, 20.0]) * (1 + 0.06 * rnd.random()) if rnd.random() < 0.1 else 10 * (1 + 0.06 * rnd.random()) for _ in range(2000))
    groups, of_all = K.price_groups(prices, 0.05), []
    assert prices.times <= len(prices)
    for k, price in enumerate(prices):  # means summed anew for every price
        mean = sum(list.__getitem__(prices, j) for j in of_all[-1]) / len(of_all[-1]) if of_all else 0
        if mean and abs(price - mean) / mean < 0.05:
            of_all[-1].append(k)
        else:
            of_all.append([k])
    assert groups == [g for g in of_all if len(g) >= 2] and len(groups) > 20
