"""How filters of a corpus interact: which of them remove what, in every order.

Four filters look at a text alone; the fifth at whether the same text stands under a smaller doc_id. Equal texts are found by
radix tries. Each task first puts the texts it reads into a compressed trie whose terminals hold the smallest and
largest doc_id, and hands on every text of the trie once, so that copies meet before anything is moved. The texts
are then range-partitioned by prefixes whose length adapts: where a prefix holds more than its share of the bytes, all
its texts are told apart by one eight times as long, until the share is met or the prefix is the whole text. A task
inserts the whole texts of one prefix after the other into a trie and traverses it for terminals under which two
doc_ids met; only digests of those texts and their smallest doc_id leave it. The filters a document fails make a mask;
masks are counted, and everything else, orders and Shapley values too, follows from at most 2^n counts a part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, slices, text_or_empty

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: Bytes of text that a task's trie holds before it is emptied.
HELD_BYTES = 16 << 20
#: Length in bytes of the first prefix and the factor from one to the next.
PREFIX_BYTES, PREFIX_STEP = 8, 8
#: A prefix may hold 1/8 of a partition's share of the bytes, within these bounds.
SHARES, LEAST_CLASS_BYTES, MOST_CLASS_BYTES = 8, 1 << 16, 32 << 20
#: Prefixes held by too many bytes are broadcast, 8 bytes each, up to so many; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


class Trie:
    """A compressed trie over byte strings: an edge holds all bytes up to the next fork, a terminal (low, high, key)."""

    __slots__ = ("root", "held")

    def __init__(self) -> None:
        self.root: list = [b"", None, None]  # label, children by first byte, terminal
        self.held = 0

    def insert(self, text: bytes, low: int, high: int, key=None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1] and node[1].get(text[at])
            if not child:
                self.held += len(text) - at
                node[1] = node[1] or {}
                node[1][text[at]] = node = [text[at:], None, None]
                break
            label = child[0]
            if not text.startswith(label, at):
                same = _common(label, text, at)
                fork = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
                node[1][text[at]] = child = fork
            node, at = child, at + len(child[0])
        old = node[2]
        node[2] = (low, high, key) if old is None else (min(low, old[0]), max(high, old[1]), key)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """Texts and terminals in byte order."""
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            if node[1]:
                todo += [(text, node[1][b]) for b in sorted(node[1], reverse=True)]

    def terminals(self) -> Iterator[tuple]:
        """Terminals alone: no text is put together."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[2] is not None:
                yield node[2]
            if node[1]:
                todo += node[1].values()


def _common(label: bytes, text: bytes, at: int) -> int:
    """How many first bytes of ``label`` stand in ``text`` at ``at``; fewer than all."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        half = (low + high + 1) // 2
        if label[low:half] == text[at + low : at + half]:
            low = half
        else:
            high = half - 1
    return low


def once_a_task(rows: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """text, low, high: every text of (doc_id, text) once for each trie that its copies fell in, with their least and largest doc_id."""

    def emptied(trie: Trie) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for text, (low, high, _) in trie.items():
            found.append((text, low, high))
            size += len(text)
            if size >= 1 << 20:
                yield batch_of(found)
                found, size = [], 0
        if found:
            yield batch_of(found)

    def batch_of(found: list) -> pa.RecordBatch:
        texts, lows, highs = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], ["text", "low", "high"])

    def task(batches):
        trie = Trie()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                trie.insert(text, doc_id, doc_id)
                if trie.held >= held_bytes:
                    yield from emptied(trie)
                    trie = Trie()
        yield from emptied(trie)

    return rows.mapInArrow(task, "text binary, low long, high long")


def by_prefix(texts: DataFrame, partitions: int, class_bytes: int | None = None) -> DataFrame:
    """``texts`` with ``prefix``: rows of one prefix hold few bytes, or one text; equal texts share their prefix.

    Prefixes of all lengths are counted at once, over all texts; a text takes the first of its prefixes whose texts hold at most
    ``class_bytes``. One that holds more has only shorter ones that do, too, so no count waits for another. Prefixes that hold more
    are known by a 64-bit hash; should two share one, a light prefix is made longer, which changes nothing.
    """
    total, longest = texts.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    if class_bytes is None:
        class_bytes = min(max((total or 0) // (SHARES * partitions), LEAST_CLASS_BYTES), MOST_CLASS_BYTES)
    depths = [PREFIX_BYTES]
    while depths[-1] * PREFIX_STEP < (longest or 0):
        depths.append(depths[-1] * PREFIX_STEP)
    # a text that ends by a prefix is told apart already
    own = lambda depth: F.when(F.length("text") > depth, F.xxhash64(F.substring("text", 1, depth)))
    prefixes = F.array_compact(F.array(*[F.when(F.length("text") > d, F.struct(F.lit(d).alias("at"), own(d).alias("heavy"))) for d in depths]))
    counted = texts.select(F.length("text").alias("bytes"), F.inline(prefixes)).groupBy("at", "heavy").agg(F.sum("bytes").alias("bytes"))
    heavy = Scratch(texts.sparkSession).keep(counted.where(F.col("bytes") > class_bytes).select("at", "heavy"))
    longer = texts.withColumn("depth", F.lit(PREFIX_BYTES).cast("long"))
    for depth, n in sorted(map(tuple, heavy.groupBy("at").count().collect())):  # a row a length
        side = heavy.where(F.col("at") == depth).select("heavy")
        side = F.broadcast(side) if n <= BROADCAST_ROWS else side
        longer = longer.withColumn("own", F.when(F.col("depth") == depth, own(depth))).join(side, F.col("own") == F.col("heavy"), "left")
        longer = longer.withColumn("depth", F.when(F.col("heavy").isNotNull(), F.lit(depth * PREFIX_STEP)).otherwise(F.col("depth"))).drop("own", "heavy")
    return longer.withColumn("prefix", F.expr("substring(text, 1, cast(depth as int))")).drop("depth")


def repeated_texts(docs: DataFrame, held_bytes: int = HELD_BYTES, class_bytes: int | None = None) -> DataFrame:
    """key (SHA-256), low of every text that stands under two doc_ids or more: its smallest doc_id."""
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    scratch = Scratch(spark)
    texts = scratch.keep(once_a_task(rows, held_bytes))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = by_prefix(texts, partitions, class_bytes).withColumn("key", F.sha2("text", 256))
    dealt = classes.repartitionByRange("prefix").sortWithinPartitions("prefix").select("prefix", "text", "low", "high", "key")

    def repeated(trie: Trie) -> list[tuple[str, int]]:
        return [(key, low) for low, high, key in trie.terminals() if low < high]

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["key", "low"])

    def task(batches):
        trie, of = Trie(), None
        for batch in slices(batches):
            found = []
            for prefix, text, low, high, key in zip(*(batch.column(c).to_pylist() for c in ("prefix", "text", "low", "high", "key"))):
                if prefix != of:
                    found += repeated(trie)
                    trie, of = Trie(), prefix
                trie.insert(text, low, high, key)
            yield batch_of(found)
        yield batch_of(repeated(trie))

    out = scratch.keep(dealt.mapInArrow(task, "key string, low long"))
    scratch.free(texts)
    return out


def text_failures() -> list[Column]:
    """Of columns text and words: too few words, too few different ones, too many capitals, odd symbols."""
    n = F.size("words")
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITALS_PERCENT * F.length("text"),
        F.col("text").rlike(SYMBOLS),
    ]


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row of ``docs``: bit i of the mask is set if it fails filter i of ``LETTERS``.

    A to D look at the text, E fails a row whose whole text also stands under a smaller doc_id. Null counts as the empty
    text; words are what ASCII white space separates. The part is lang, null the empty string. A null doc_id is
    neither smaller nor larger than any. Rows that repeat a doc_id do not fail E for each other. An empty table gives an empty
    result; further columns are not read; a text is read whole, however long, as one row.
    """
    repeated = repeated_texts(docs).select(F.col("key").alias("_key"), "low")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_or_empty().alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    mask = sum(F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures()))
    rows = rows.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("key"), mask.alias("mask"))
    # no row of a text that stands once meets the join's other side; a text that stands very often is one key, which Spark splits
    joined = rows.join(repeated, F.col("key") == F.col("_key"), "left")
    return joined.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("low"), 1 << 4).otherwise(0)).alias("mask"))


def interactions(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts of (part, mask, good, toxic) rows for every part, order of the filters and step.

    kept: rows after the step; removed: rows it removes, good_lost and toxic_lost those of a kind; redundant: rows that
    fail its filter and were removed earlier; unique_fails: rows that fail no other; shapley: rows its filter removes, over all orders.

    Rows are counted by mask first; a part then has at most 2^n counts, from which all its n! * n rows are derived
    (seven filters at most). An empty table gives an empty result.
    """
    if len(letters) > 7:
        raise ValueError("seven filters have 5040 orders; more are too many to list")
    flag = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), flag("good").alias("good"), flag("toxic").alias("toxic"))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(x)) for x in itertools.permutations(letters)])
    places = F.sequence(F.lit(1), F.lit(len(letters)))
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(places))

    def bit(place: Column) -> Column:
        """The mask of the filter at a place of the order."""
        letter = F.substr("filter_order", place, F.lit(1))
        return F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)]), letter)

    earlier = F.aggregate(F.filter(places, lambda i: i < F.col("step")), F.lit(0), lambda found, i: found.bitwiseOR(bit(i)))
    steps = steps.withColumn("own", bit(F.col("step"))).withColumn("earlier", earlier)

    def total(of: str, which, times=lambda mask: F.lit(1)) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(which(c["mask"]), c[of] * times(c["mask"])).otherwise(0))

    fails = lambda mask: mask.bitwiseAND(F.col("own")) != 0
    came = lambda mask: mask.bitwiseAND(F.col("earlier")) == 0
    # of the orders, a document's filters each remove it in an equal part
    part_of_orders = F.array(*[F.lit(math.factorial(len(letters)) // k) for k in range(1, len(letters) + 1)])
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: came(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: came(m) & fails(m)).alias("removed"),
        total("n", lambda m: fails(m) & ~came(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", lambda m: came(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: came(m) & fails(m)).alias("toxic_lost"),
        total("n", fails, lambda m: F.element_at(part_of_orders, F.bit_count(m))).alias("shapley"),
    )
