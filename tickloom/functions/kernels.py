"""Folds over one series whose state no window can bound: plain functions over arrays, used inside grouped maps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Bars that must lie free between two fractals, strokes of a segment, legs of a zone.
FREE_BARS, SEGMENT_STROKES, ZONE_LEGS = 2, 3, 3


def ema(values: np.ndarray, period: int, warmup: float = 0.0) -> np.ndarray:
    """Exponential mean seeded with the simple mean of the first ``period`` values; ``warmup`` before that."""
    out = np.full(len(values), warmup)
    if len(values) < period:
        return out
    out[period - 1] = values[:period].mean()
    out[period:] = ema_on(values[period:], float(out[period - 1]), period)
    return out


def ema_on(values: np.ndarray, last: float, period: int) -> np.ndarray:
    """An exponential mean that has started carried on from its ``last`` value."""
    out, rate = np.empty(len(values)), 2.0 / (period + 1)
    for i, value in enumerate(values.tolist()):
        out[i] = last = last + (value - last) * rate
    return out


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """dif, dea and histogram; None for fewer than ``slow`` closes. The early zeros of the means are kept."""
    if len(close) < slow:
        return None
    dif = ema(close, fast) - ema(close, slow)
    dea = ema(dif, signal)
    return dif, dea, 2.0 * (dif - dea)


def macd_block(close: np.ndarray, periods: tuple[int, int, int], start: tuple[float, float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two means and the mean of their difference over a stretch of a series; ``start`` is what they were before it, None at the series' start."""
    fast, slow, signal = periods
    if start is None:
        a, b = ema(close, fast), ema(close, slow)
        return a, b, ema(a - b, signal)
    a, b = ema_on(close, start[0], fast), ema_on(close, start[1], slow)
    return a, b, ema_on(a - b, start[2], signal)


def macd_starts(counts: list[int], from_zero: list[tuple[float, float, float]], periods: tuple[int, int, int]) -> list[tuple[float, float, float]]:
    """What the means were before each block but the first, from where each block ends if it starts from zeros (the first: as the series does).

    The means are linear recursions, so n bars take a start v to M^n v + c: c is where they end from zeros. M^n is known in
    closed form: each mean keeps (1 - rate)^n of itself, and the third gathers what the two others keep on the way.
    """
    keep = [1 - 2.0 / (p + 1) for p in periods]
    rate = 1 - keep[2]

    def gathered(k: float, n: int) -> float:
        """Sum over j = 1..n of k^j keep[2]^(n-j)."""
        return n * k**n if k == keep[2] else k * (keep[2] ** n - k**n) / (keep[2] - k)

    out, at = [], from_zero[0]
    for n, c in zip(counts[1:], from_zero[1:]):
        out.append(at)
        a, b, d = at
        at = (keep[0] ** n * a + c[0], keep[1] ** n * b + c[1], keep[2] ** n * d + rate * (gathered(keep[0], n) * a - gathered(keep[1], n) * b) + c[2])
    return out


@dataclass
class Merged:
    first: int  # position of the first raw bar
    extreme: int  # position of the raw bar whose time the merged bar has
    high: float
    low: float
    members: int
    vol: float
    amount: float


def merged_onto(before: Merged, last: Merged, bar: Merged) -> Merged | None:
    """``last`` with ``bar`` merged into it along the direction from ``before``; None if neither lies inside the other or there is no direction."""
    if before.high == last.high:
        return None
    rising = before.high < last.high
    inside = last.high >= bar.high and last.low <= bar.low or last.high <= bar.high and last.low >= bar.low
    if not inside:
        return None
    keeps = last.high > bar.high if rising else last.low < bar.low
    pick = max if rising else min
    return Merged(last.first, last.extreme if keeps else bar.extreme, pick(last.high, bar.high), pick(last.low, bar.low), last.members + 1, last.vol + bar.vol, last.amount + bar.amount)


def merge_inclusions(high, low, vol, amount) -> list[Merged]:
    """Bars after inclusion removal: a bar inside its neighbour is merged into it along the direction before."""
    out: list[Merged] = []
    for i in range(len(high)):
        bar = Merged(i, i, high[i], low[i], 1, vol[i], amount[i])
        grown = merged_onto(out[-2], out[-1], bar) if len(out) >= 2 else None
        if grown:
            out[-1] = grown
        else:
            out.append(bar)
    return out


def fractals(high, low) -> list[tuple[int, int]]:
    """(position, +1 top or -1 bottom) over merged bars, alternating: of a run of one kind the most extreme stays."""
    out: list[tuple[int, int]] = []
    for p in range(1, len(high) - 1):
        top = high[p] > max(high[p - 1], high[p + 1]) and low[p] > max(low[p - 1], low[p + 1])
        bottom = high[p] < min(high[p - 1], high[p + 1]) and low[p] < min(low[p - 1], low[p + 1])
        if not (top or bottom):
            continue
        kind = 1 if top else -1
        if out and out[-1][1] == kind:
            better = high[p] > high[out[-1][0]] if top else low[p] < low[out[-1][0]]
            if better:
                out[-1] = (p, kind)
        else:
            out.append((p, kind))
    return out


def pair_up(marks: list[tuple[int, int]], high, low, move_previous: bool) -> list[tuple[int, int]]:
    """Pairs of indices into ``marks`` that make strokes; an end is the next start.

    A more extreme mark of the start's kind replaces the start, and with ``move_previous`` the end of the pair
    before as well. Marks that leave too few free bars or run against the direction are passed over.
    """
    value = lambda k: high[marks[k][0]] if marks[k][1] > 0 else low[marks[k][0]]
    pairs: list[tuple[int, int]] = []
    start = 0
    for k in range(1, len(marks)):
        if marks[k][1] == marks[start][1]:
            if (value(k) - value(start)) * marks[k][1] > 0:
                if move_previous and pairs and pairs[-1][1] == start:
                    pairs[-1] = (pairs[-1][0], k)
                start = k
            continue
        top, bottom = (k, start) if marks[k][1] > 0 else (start, k)
        if marks[k][0] - marks[start][0] >= FREE_BARS + 2 and value(top) > value(bottom):
            pairs.append((start, k))
            start = k
    return pairs


def strokes(high, low) -> list[tuple[int, int, int]]:
    """(start, end, +1 up or -1 down) in positions of merged bars.

    After a first pairing, a pair whose start is overrun before its end dies with both its marks; the marks
    that are left are paired once more.
    """
    marks = fractals(high, low)
    if len(marks) < 2:
        return []
    dead: set[int] = set()
    for a, b in pair_up(marks, high, low, move_previous=False):
        p, q = marks[a][0], marks[b][0]
        between = range(p + 1, q)
        over = any(high[m] > high[p] for m in between) if marks[a][1] > 0 else any(low[m] < low[p] for m in between)
        if over:
            dead |= {a, b}
    left = [m for k, m in enumerate(marks) if k not in dead]
    if len(left) < 2:
        return []
    return [(left[a][0], left[b][0], -left[a][1]) for a, b in pair_up(left, high, low, move_previous=True)]


def merged_features(features: list[tuple[float, float]], up: bool) -> list[tuple[float, float]]:
    """Feature elements (high, low) after inclusion removal along the segment's direction."""
    out = features[:1]
    pick = min if up else max
    for high, low in features[1:]:
        h, l = out[-1]  # noqa: E741
        if h >= high and l <= low or high >= h and low <= l:
            out[-1] = (pick(h, high), pick(l, low))
        else:
            out.append((high, low))
    return out


def feature_turns(features: list[tuple[float, float]], up: bool) -> bool:
    """Has any middle element strictly the highest high (up segment) or the lowest low (down segment) of three?"""
    value = [h if up else -l for h, l in features]
    return any(value[k] > value[k - 1] and value[k] > value[k + 1] for k in range(1, len(value) - 1))


def feature_gap(features: list[tuple[float, float]], up: bool) -> bool:
    """Do the last two elements leave a gap?"""
    if len(features) < 2:
        return False
    (h1, l1), (h2, l2) = features[-2:]
    return l1 > h2 if up else h1 < l2


@dataclass
class Segment:
    up: bool
    legs: list[int]
    features: list[tuple[float, float]]
    finished: bool = False


def segments(direction, high, low, min_strokes: int = SEGMENT_STROKES) -> list[Segment]:
    """Segments over strokes: ended at a feature fractal, at once without a gap, else when the opposite one confirms.

    Strokes that a pending opposite segment consumed before it was dropped are not given back.
    """
    n = len(direction)
    if n < min_strokes:
        return []
    done: list[Segment] = []
    new = lambda k: Segment(direction[k] > 0, [k], [])

    def add(seg: Segment, k: int) -> list[tuple[float, float]]:
        seg.legs.append(k)
        if (direction[k] > 0) != seg.up:
            seg.features.append((high[k], low[k]))
        return merged_features(seg.features, seg.up)

    now, pending = new(0), None
    for k in range(1, n):
        if pending:
            if feature_turns(add(pending, k), pending.up):
                now.finished = True
                done.append(now)
                now, pending = pending, None
            elif high[k] > high[now.legs[-1]] if now.up else low[k] < low[now.legs[-1]]:
                pending = None
            continue
        features = add(now, k)
        if not feature_turns(features, now.up):
            continue
        if feature_gap(features, now.up):
            pending = new(k)
            continue
        if len(now.legs) >= min_strokes:
            now.finished = True
            done.append(now)
        now = new(k)
    if not now.finished and len(now.legs) >= min_strokes:
        three = now.legs[:3]
        if max(low[k] for k in three) <= min(high[k] for k in three):
            done.append(now)
    return done


@dataclass
class Zone:
    first: int
    last: int
    top: float  # of the overlap
    bottom: float


def zones(high, low) -> list[Zone]:
    """Zones of three legs and more: legs are taken in threes, then join while they overlap what all share."""
    found: list[Zone] = []
    for k in range(len(high)):
        now = found[-1] if found else None
        if now and (now.last - now.first + 1 < ZONE_LEGS or low[k] <= now.top and high[k] >= now.bottom):
            now.last, now.top, now.bottom = k, min(now.top, high[k]), max(now.bottom, low[k])
        else:
            found.append(Zone(k, k, high[k], low[k]))
    return [z for z in found if z.last - z.first + 1 >= ZONE_LEGS and z.top >= z.bottom]


def sliding_zones(high, low) -> list[Zone]:
    """Zones for walks: the start slides by one leg until three overlap, then the zone extends while legs overlap."""
    found, k = [], 0
    while k + 2 < len(high):
        z = Zone(k, k + 2, min(high[k : k + 3]), max(low[k : k + 3]))
        if z.top < z.bottom:
            k += 1
            continue
        while z.last + 1 < len(high) and low[z.last + 1] <= z.top and high[z.last + 1] >= z.bottom:
            z.last += 1
            z.top, z.bottom = min(z.top, high[z.last]), max(z.bottom, low[z.last])
        found.append(z)
        k = z.last + 1
    return found


def pair_direction(top0: float, bottom0: float, top1: float, bottom1: float) -> int:
    """Direction from one zone to the next: apart first, then by the bottoms."""
    if bottom1 > top0:
        return 1
    if top1 < bottom0:
        return -1
    return 1 if bottom1 > bottom0 else -1


def trend_groups(top, bottom) -> list[int]:
    """Group number of every zone for divergences: zones apart from each other in the group's direction."""
    out: list[int] = []
    for k in range(len(top)):
        if not k:
            out.append(0)
            continue
        way = pair_direction(top[k - 1], bottom[k - 1], top[k], bottom[k])
        apart = bottom[k] > top[k - 1] or top[k] < bottom[k - 1]
        grown = k >= 2 and out[-1] == out[-2]
        group_way = pair_direction(top[k - 2], bottom[k - 2], top[k - 1], bottom[k - 1]) if grown else way
        out.append(out[-1] if apart and way == group_way else out[-1] + 1)
    return out


def price_groups(prices: list[float], within: float) -> list[list[int]]:
    """Successive prices while each lies within a share of the group's running mean; groups of two and more."""
    groups: list[list[int]] = []
    total = lost = 0.0  # of the last group, summed as sum() does: with what rounding loses
    for k, price in enumerate(prices):
        mean = (total + lost) / len(groups[-1]) if groups else 0.0
        if mean and abs(price - mean) / mean < within:
            groups[-1].append(k)
            more = total + price
            lost += (total - more) + price if abs(total) >= abs(price) else (price - more) + total
            total = more
        else:
            groups.append([k])
            total, lost = price, 0.0
    return [g for g in groups if len(g) >= 2]
