"""Repeated byte strings by depth-limited radix sorting of suffixes.

Two suffixes matter to each other only if they agree through the threshold. They are sorted by digits from the
most significant on, and a suffix that is alone in its group is dropped at once:

1. The first digit is chosen so that few suffixes carry it: of the grams inside a window of the threshold's
   length the one with the smallest hash, the window's anchor. Equal windows have equal anchors at equal
   places, and a run of neighbouring windows has one anchor, so a run is one row. Runs whose anchor gram
   stands once in the corpus are dropped by a filter of fixed size, before anything but a hash has moved.
2. The second digit is the whole stretch of the run. Runs with equal stretches are repeated as a whole.
3. Runs that share only the anchor are sorted window by window on 40-byte digits through the threshold. The
   groups of two and more that are left are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bit_filter, cut, in_filter, slices

DEPTH, GRAM, DIGIT = 200, 48, 40
WINDOW = DEPTH - GRAM + 1  # grams in a window
#: Bits of the filter of repeated anchors as a power of two (8 MB).
FILTER_BITS = 26
#: Bytes that are looked at together, and windows that are sorted together.
BLOCK_BYTES, SORT_WINDOWS = 4 << 20, 400_000
#: Anchors with more different stretches are resolved by counting windows instead of sorting them in one task.
GROUP_ROWS = 200_000

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


class Hashes:
    """Hashes of any stretch of a byte array from the sums of its prefixes."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(Hashes.up) <= len(data):
            Hashes.up = powers(BASE, len(data) + 1)
            Hashes.down = powers(pow(BASE, -1, 1 << 64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * Hashes.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Hashes.down[start])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * Hashes.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def runs(data: np.ndarray, bounds: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of every run of windows with one anchor; no window crosses ``bounds``."""
    n = len(data) - DEPTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = hashes.grams(GRAM)
    low = np.uint64(0xFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # of equal grams the leftmost
    width = 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: n], least[WINDOW - width :][:n])
    at = (least[:n] & low).astype(np.int64)
    step = np.zeros(n + 1, np.int32)
    firsts, lasts = bounds[:-1], bounds[1:] - DEPTH + 1
    some = lasts > firsts
    np.add.at(step, firsts[some], 1)
    np.add.at(step, np.minimum(lasts[some], n), -1)
    inside = np.cumsum(step[:n]) > 0
    begins = inside.copy()
    begins[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    begins[bounds[:-1][bounds[:-1] < n]] &= True
    ends = inside.copy()
    ends[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends), at[begins]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds of the pieces, row of each piece, place of each piece in its row's text).

    A text longer than a block is taken in pieces that overlap so that every window lies in exactly one.
    """
    for batch in slices(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        pieces = [(k, at, t[at : at + BLOCK_BYTES]) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - DEPTH + 1), BLOCK_BYTES - DEPTH + 1)]
        while pieces:
            size, take = 0, 0
            while take < len(pieces) and (not take or size + len(pieces[take][2]) <= BLOCK_BYTES):
                size += len(pieces[take][2])
                take += 1
            now, pieces = pieces[:take], pieces[take:]
            bounds = np.cumsum([0, *(len(p) for _, _, p in now)])
            yield batch, np.frombuffer(b"".join(p for _, _, p in now), np.uint8), bounds, np.array([k for k, _, _ in now]), np.array([at for _, at, _ in now])


def repeated_anchors(docs: DataFrame) -> np.ndarray:
    """Filter of the anchor grams that stand at more than one place."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds, _, _ in blocks(batches):
            hashes = Hashes(data)
            _, _, at = runs(data, bounds, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.of(at, at + GRAM).view(np.int64))], names=["key"])

    found = docs.select("text").mapInArrow(keys, "key long").groupBy("key").count()
    return bit_filter(found.where("count > 1").select("key"), FILTER_BITS)


RUN = "doc_id long, text_key long, start int, n int, place int, gram long, stretch long, bytes binary"


def shared_runs(docs: DataFrame) -> DataFrame:
    """Runs whose anchor gram may stand elsewhere too; the first of each stretch in a task has the bytes it stretches over."""
    may_repeat = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # stretches whose bytes this task has given already
        for batch, data, bounds, rows, offsets in blocks(batches):
            hashes = Hashes(data)
            first, last, at = runs(data, bounds, hashes)
            grams = hashes.of(at, at + GRAM)
            kept = in_filter(may_repeat.value, grams, FILTER_BITS)
            first, last, at, grams = first[kept], last[kept], at[kept], grams[kept]
            piece = np.searchsorted(bounds, first, side="right") - 1
            row = pa.array(rows[piece])
            stretch = mixed(hashes.of(first, last + DEPTH) + ((at - first) * 4096 + last - first).astype(np.uint64))
            raw = data.tobytes()
            new = [s not in sent and not sent.add(s) for s in stretch.tolist()]
            columns = [
                batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array((first - bounds[piece] + offsets[piece]).astype(np.int32)),
                pa.array((last - first + 1).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array(grams.view(np.int64)),
                pa.array(stretch.view(np.int64)), pa.array([raw[a:b] if n else None for a, b, n in zip(first.tolist(), (last + DEPTH).tolist(), new)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "n", "place", "gram", "stretch", "bytes"])

    return keyed(docs).mapInArrow(find, RUN)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def window_digits(stretches: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, digits) of every window of some stretches; digits has a row for each digit."""
    bounds = np.cumsum([0, *map(len, stretches)])
    hashes = Hashes(np.frombuffer(b"".join(stretches), np.uint8))
    row = np.repeat(np.arange(len(stretches)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[row] + offset
    return row, offset, np.stack([hashes.of(start + d, start + d + DIGIT) for d in range(0, DEPTH, DIGIT)])


def repeated_windows(gram: np.ndarray, place: np.ndarray, counts: np.ndarray, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the windows that stand in more than one row of the same gram, by radix passes."""
    row, offset, digits = window_digits(stretches, counts)
    group = mixed(gram.view(np.uint64)[row] + (place[row] - offset).astype(np.uint64))  # the place of the anchor in the window
    left = np.arange(len(row))
    for digit in digits:
        order = np.lexsort((digit[left], group))
        same = (group[order][1:] == group[order][:-1]) & (digit[left][order][1:] == digit[left][order][:-1])
        number = np.concatenate([[0], np.cumsum(~same)]).astype(np.uint64) if len(order) else group
        size = np.bincount(number.astype(np.int64)) if len(order) else number
        alone = size[number.astype(np.int64)] < 2 if len(order) else number.astype(bool)
        left, group = left[order][~alone], number[~alone]
    return row[left], offset[left]


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of the runs that occur once; the rows come sorted by gram."""
    names = ["doc_id", "text_key", "start", "n", "place", "gram", "times", "bytes"]
    held: list[tuple] = []

    def sort_out(rows: list[tuple]) -> pa.RecordBatch:
        _, _, start, n, place, gram, times, stretches = (list(c) for c in zip(*rows))
        counts, place, gram = np.array(n), np.array(place), np.array(gram, np.int64)
        found = []
        per_row = max(1, SORT_WINDOWS // len(rows))
        widest = int((place.max() - np.minimum(0, place - counts + 1).min()) + 1)
        for low in range(-widest, widest + 1, per_row) if per_row < widest else [None]:
            # windows are equal only if the anchor lies at the same place in them: one range of places at a time
            if low is None:
                found.append(np.stack(repeated_windows(gram, place, counts, stretches)))
            else:
                a = np.clip(place - (low + per_row - 1), 0, counts)
                b = np.clip(place - low + 1, 0, counts)
                some = np.flatnonzero(b > a)
                cut_out = [stretches[k][a[k] : b[k] + DEPTH - 1] for k in some]
                if len(some):
                    r, o = repeated_windows(gram[some], (place - a)[some], (b - a)[some], cut_out)
                    found.append(np.stack([some[r], o + a[some][r]]))
        row, offset = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        once = np.array(times)[row] == 1
        row, offset = row[once], offset[once]
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        begins = np.ones(len(row), bool)
        begins[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
        ends = np.ones(len(row), bool)
        ends[:-1] = begins[1:]
        at = np.array(start)[row]
        out = [[rows[k][0] for k in row[begins]], [rows[k][1] for k in row[begins]]]
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array((at + offset)[begins].astype(np.int32)), pa.array((at + offset)[ends].astype(np.int32) + DEPTH)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "end"])

    for batch in slices(batches, 2048):
        rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
        split = next((k for k in range(len(rows) - 1, -1, -1) if rows[k][5] != rows[-1][5]), -1) + 1
        if split or (held and rows and held[-1][5] != rows[0][5]):
            if held and held[-1][5] != rows[0][5] and split == 0:
                yield sort_out(held)
                held = rows
                continue
            yield sort_out(held + rows[:split])
            held = rows[split:]
        else:
            held += rows
    if held:
        yield sort_out(held)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end of stretches that are covered by repeated windows; they may overlap."""
    found = cut(shared_runs(docs))
    of = F.min(F.struct("doc_id", "text_key", "start")).alias("at")
    per = found.groupBy("gram", "stretch").agg(F.count("*").alias("times"), of, *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "place", "bytes")])
    per = cut(per)
    again = per.where("times > 1").select(F.col("gram").alias("g"), F.col("stretch").alias("s"))
    whole = found.drop("bytes").join(again, (F.col("gram") == F.col("g")) & (F.col("stretch") == F.col("s")), "left_semi")
    whole = whole.select("doc_id", "text_key", "start", (F.col("start") + F.col("n") - 1 + DEPTH).alias("end"))
    mixed_grams = per.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("kinds")).where("kinds > 1")
    differing = per.join(mixed_grams, F.col("gram") == F.col("g")).select("at.*", "n", "place", "gram", "times", "bytes", "kinds")
    sorted_rows = differing.where(F.col("kinds") <= GROUP_ROWS).drop("kinds").repartition("gram").sortWithinPartitions("gram")
    parts = sorted_rows.mapInArrow(resolve, "doc_id long, text_key long, start int, end int")
    counted = counted_windows(differing.where(F.col("kinds") > GROUP_ROWS))
    return whole.unionByName(parts).unionByName(counted)


def counted_windows(runs_of_large: DataFrame) -> DataFrame:
    """The same as :func:`resolve` for anchors with very many different stretches, by counting window digests."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, grams = batch.column("n").to_numpy(), batch.column("gram").to_numpy()
            row, offset, digits = window_digits(batch.column("bytes").to_pylist(), n)
            left, right = grams[row].view(np.uint64), np.zeros(len(row), np.uint64)
            for d in digits:
                left, right = mixed(left + d), mixed(right * np.uint64(31) + d)
            take = pa.array(row)
            columns = [
                batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array((batch.column("start").to_numpy()[row] + offset).astype(np.int32)),
                batch.column("times").take(take), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "times", "left", "right"])

    rows = runs_of_large.mapInArrow(digests, "doc_id long, text_key long, start int, times long, left long, right long")
    again = rows.groupBy("left", "right").agg(F.count("*").alias("seen")).where("seen > 1").select(F.col("left").alias("l"), F.col("right").alias("r"))
    hits = rows.join(again, (F.col("left") == F.col("l")) & (F.col("right") == F.col("r")), "left_semi").where("times = 1")
    return hits.select("doc_id", "text_key", "start", (F.col("start") + DEPTH).alias("end"))


def fewer_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same bytes in fewer spans: those of one batch that overlap or touch become one, as in a text that repeats itself throughout."""
    for batch in batches:
        doc_id, null = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        key, start, end = (batch.column(c).to_numpy() for c in ("text_key", "start", "end"))
        order = np.lexsort((start, key, doc_id, null))
        same = np.ones(len(order), bool)
        for column in (doc_id, null, key):
            same[1:] &= column[order][1:] == column[order][:-1]
        same[:1] = False
        # ends so far within a document: documents are set apart by an offset beyond any place
        place = (np.cumsum(~same) - 1) * (1 << 32)
        reach = np.maximum.accumulate(end[order] + place)
        begins = np.ones(len(order), bool)
        begins[1:] = (start[order] + place)[1:] > reach[:-1]
        last = np.flatnonzero(np.append(begins[1:], True)) if len(order) else order
        first = pa.array(order[begins])
        ends = pa.array((reach - place)[last].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(first), batch.column("text_key").take(first), batch.column("start").take(first), ends], names=["doc_id", "text_key", "start", "end"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans; one row per input row.

    A byte goes if a 200-byte string covers it that also starts anywhere else in the corpus, the same document
    included; overlaps count. Texts are UTF-8 bytes, null counts as empty, and no string crosses documents.
    ``spans`` are the maximal removed runs (start, end). A repeated row is a second place, so both lose what
    they share; an empty table gives an empty result; further columns are not read. A very long text is read in
    overlapping blocks of 4 MB. Strings are compared by 64-bit digests of 40 bytes each.
    """
    merged = repeated_spans(docs).mapInArrow(fewer_spans, "doc_id long, text_key long, start int, end int")
    spans = merged.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    spans = spans.agg(F.collect_list(F.struct("start", "end")).alias("found"))
    rows = keyed(docs)
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["text_key"] == spans["_key"]), "left").select("doc_id", "text", "found")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in found or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for span in merged for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(merged), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "spans": [{"start": a, "end": b} for a, b in merged]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start int, end int>>"
    return joined.mapInArrow(remove, ddl)
