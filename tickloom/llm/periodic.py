"""Periodic runs of words: seeds on diagonals, extended both ways.

A run of period q and at least ``max(min_length, exponent * q)`` words is a stretch in which the words equal those q
further on; the two copies overlap by its length less q. For lags from w to 2w - 1 (w a power of two) the least such
overlap is the seed length k of that level. The k-grams of a text are indexed exactly (names of 2^t-grams by doubling,
no hashes), and of the places of one k-gram only neighbours make a pair: as k is at least q, two places of a k-gram
inside a run of smallest period q are never closer than q, and the run's first k-gram stands again exactly q further
on, so the pair of neighbours is never missed and a text that is one word over and over has n pairs, not n^2. A pair is a seed
on the diagonal of its lag; it is extended left and right until words differ. A table holds for every lag how far it
is covered, and seeds below that are not extended again. The lag of a pair of neighbours is the smallest period of the
stretch, so multiples of a period never come up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, text_or_empty

MIN_LENGTH, EXPONENT = 6, 4

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs only; below len(left)."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _repeats(codes: np.ndarray, k: int) -> bool:
    """May any k-gram stand twice? Equal k-grams have equal sums, so a no is certain."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        sums = sums * np.uint64(0x94D049BB133111EB) + mixed[i : i + len(sums)]
    sums.sort()
    return bool((sums[1:] == sums[:-1]).any())


def _right(codes: np.ndarray, at: int, lag: int) -> int:
    """First place from ``at`` on where words ``lag`` apart differ or end."""
    step, end = 64, len(codes) - lag
    while at < end:
        m = min(step, end - at)
        differ = codes[at : at + m] != codes[at + lag : at + lag + m]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + m, step * 2
    return at


def _left(codes: np.ndarray, at: int, lag: int) -> int:
    """First place of the stretch up to ``at`` in which words ``lag`` apart are equal."""
    step = 64
    while at:
        m = min(step, at)
        differ = codes[at - m : at] != codes[at - m + lag : at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = at - m, step * 2
    return at


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``codes`` (numbers of words), by start and period."""
    n, found = len(codes), []
    needed = lambda q: max(min_length, exponent * q)
    turn = min_length // exponent  # up to here the overlap shrinks with the lag, then it grows
    grams: dict[int, np.ndarray] = {}
    covered: dict[int, int] = {}
    for w in (1 << t for t in range(n.bit_length())):
        if needed(w) > n:
            break
        k = min(needed(q) - q for q in (w, max(w, turn), max(w, turn + 1)))  # least overlap of this level and those above
        if not grams:
            if not _repeats(codes, k):
                break
            grams[1] = codes
        wide = max(grams)
        while wide * 2 <= k:
            grams[wide * 2] = _named(grams[wide][:-wide], grams[wide][wide:])
            wide *= 2
        whole = grams[wide] if wide == k else _named(grams[wide][: n - k + 1], grams[wide][k - wide :][: n - k + 1])
        grams = {wide: grams[wide]}
        order = np.argsort(whole, kind="stable")
        same = whole[order[1:]] == whole[order[:-1]]
        if not same.any():
            break  # longer grams stand twice only where shorter ones do
        lags = order[1:] - order[:-1]
        seeds = np.flatnonzero(same & (lags >= w) & (lags < 2 * w))
        seeds = seeds[np.argsort(order[seeds], kind="stable")]
        for at, lag in zip(order[seeds].tolist(), lags[seeds].tolist()):
            if at < covered.get(lag, 0):
                continue
            low, high = _left(codes, at, lag), _right(codes, at + k, lag)
            covered[lag] = high
            if high - low + lag >= needed(lag):
                found.append((low, high - low + lag, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return edges.cumsum()[:n] > 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs, n_dropped, collapsed of every document; one row per input row.

    Words are what ASCII white space separates, numbered from 0. ``runs`` holds (start, length, period) of every run:
    consecutive words with smallest period q, at least ``max(min_length, exponent * q)`` of them, that no neighbouring word
    extends with that period, by start and period. ``collapsed`` is the text of the words that lie in no run after its
    first period, joined by one space; ``n_dropped`` counts the others.

    A null text counts as the empty one and has neither words nor runs. Runs may overlap; two never share start and
    period. Rows that repeat are looked at each for itself, doc_id may be null, an empty table gives an empty result, further
    columns are not read. A text is one row and is read whole: memory is some 100 bytes a word of the longest one,
    time n log^2 n for any text. ``exponent`` is 3 at least, as a seed must not be shorter than its lag.
    """
    if exponent < 3 or min_length < 2:
        raise ValueError("a run needs three periods and two words at least")

    def task(batches):
        for batch in slices(batches):
            ids, counts, runs, drops, texts = batch.column("doc_id"), [], [], [], []
            for text in batch.column("text").to_pylist():
                words = text.split()  # of bytes: at ASCII white space alone
                names: dict[bytes, int] = {}
                codes = np.fromiter((names.setdefault(x, len(names)) for x in words), np.int64, len(words))
                found = find_runs(codes, min_length, exponent)
                if found:
                    gone = _dropped(len(words), found)
                    drops.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    drops.append(0)
                counts.append(len(codes))
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                texts.append(b" ".join(words))
            arrays = [ids, pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(drops, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "n_dropped", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(task, f"doc_id long, n_words long, runs array<{RUN}>, n_dropped long, collapsed string")
