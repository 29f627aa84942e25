"""Near-duplicate documents: exact Jaccard self-join of word 5-gram sets by a grouped prefix join.

Grams are ordered globally, the frequent ones last, and a set's prefix is so long that two sets over the
threshold share a gram of both prefixes. Documents with identical prefixes and sizes make one group, and only
groups are listed under their grams. Groups are compared with hubs under the size and position filters, first
with one hub each, then with the others that lie in another component yet; the pairs that are left are
expanded to members and verified on the whole sets, after a test of parities that rules most unlike pairs out.
A list whose documents are one component by then needs no more pairs; in the others the documents outside the
list's largest component are compared with all that the filters leave, so no link between components is missed.
For these, lists that hold the same groups are one list, that of their first gram, where the position filter
leaves most; and a pair is passed over where the lists just before hold both, as it is told there.

Grams, groups and what lists hold go by 64-bit hashes, sets by 128 bits; clashes are not looked for. Which grams
count as frequent only decides the order, so any choice is right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import Scratch, bit_filter, cut, forget_shuffles, in_filter, once, slices, text_or_empty

GRAM_WORDS, PERCENT = 5, 75
#: At most so many frequent grams are broadcast (1 MB), those seen in at least so many documents.
FREQUENT_GRAMS, FREQUENT_FROM = 1 << 17, 16
#: Lists over which a frequent gram's groups are dealt.
SALTS = 64
#: Lists before it that a group's row of a list names.
LISTS_BEFORE = 8
#: Bits of the filter of sets whose texts are wanted, as a power of two (4 MB); a fuller filter only lets more texts move than needed.
FILTER_BITS = 25
BLOCK_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = np.random.default_rng(12).integers(1, 1 << 63, GRAM_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The set of every text as sorted hashes of its 5-word grams; words are lower-case A-Z, split at ASCII white space."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    space = SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    inside = ~space
    lengths = ends - starts
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    words = mixed(np.add.reduceat(TABLE[data[inside]] * power[place], np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    sums = np.zeros(max(0, len(words) - GRAM_WORDS + 1), np.uint64)
    for k, step in enumerate(STEPS):
        sums += words[k : k + len(sums)] * step
    grams = mixed(sums)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= GRAM_WORDS:
            out.append(np.unique(grams[a : b - GRAM_WORDS + 1]))
        else:  # fewer words: the whole sequence is the only gram
            out.append(mixed(np.array([(words[a:b] * STEPS[: b - a]).sum() + np.uint64(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[np.ndarray]]]:
    """(doc_ids, texts, sets) of some rows at a time."""
    for batch in slices(batches):
        ids = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= BLOCK_BYTES):
                size += len(texts[high])
                high += 1
            yield ids[low:high], texts[low:high], gram_sets(texts[low:high])
            low = high


def prefix_length(n: int) -> int:
    """Grams of a set of n of which one is shared with any set over the threshold."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def set_keys(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that stand for each set."""
    grams, bounds = np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)])
    sums = np.zeros((2, len(grams) + 1), np.uint64)
    np.cumsum(mixed(grams + np.uint64(1)), out=sums[0, 1:])
    np.cumsum(mixed(grams * np.uint64(BASE)), out=sums[1, 1:])
    keys = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).T
    keys[:, 1] += np.diff(bounds).astype(np.uint64)
    return [k.tobytes() for k in keys]


def ordered(grams: np.ndarray, frequent: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The first n grams of a set in the global order, by hash and frequent grams last; and how many of them are not frequent."""
    if not len(frequent):
        return grams[:n], n
    often = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
    rare = grams[~often]
    return np.concatenate([rare, grams[often]])[:n], min(n, len(rare))


#: Words of the parities of fixed size, over which pairs are tested inside the join.
PARITY_WORDS = 8


def parities(grams: np.ndarray, words: int | None = None) -> np.ndarray:
    """Parities of the grams in 64 slots a word: as many slots as the set has grams, up to a power of two, or of ``words`` words.

    Two sets differ in at least as many grams as their parities differ in slots.
    """
    slots = 64 * words if words else max(64 * PARITY_WORDS, 1 << int(len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def long_lists(rows: list[np.ndarray | None]) -> pa.Array:
    """An Arrow column of lists from arrays."""
    offsets = np.cumsum([0, *(0 if r is None else len(r) for r in rows)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([r is None for r in rows]))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent grams, a bounded number.

    A task reports the grams of prefixes by hash that it has seen in two of its documents at least.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys = [], set()
        for _, _, sets in blocks(batches):
            for grams, key in zip(sets, set_keys(sets)):
                if len(grams) and key not in keys:
                    keys.add(key)
                    held.append(grams[: 2 * prefix_length(len(grams))])
            if sum(map(len, held[-256:])) and len(held) >= 20_000:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([signed(grams[n > 1]), pa.array(n[n > 1])], names=["gram", "n"])

    counts = docs.select("text").mapInArrow(seen, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT_FROM).orderBy(F.col("n").desc(), "gram").limit(FREQUENT_GRAMS)
    return np.sort(top.select("gram").toArrow().column("gram").to_numpy().view(np.uint64))


DOCUMENT = "doc_id long, digest binary, n long, sid binary, gid long, packed binary, bits array<long>, words array<long>, prefix array<long>, rare int"


def described(docs: DataFrame, with_digest: bool) -> DataFrame:
    """Every document's set size and set id, and the text's digest if asked for; for the first of each set in a task its group, prefix and text.

    ``rare`` counts the grams of the prefix that are not frequent; the frequent ones follow them.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, packer = set(), zstandard.ZstdCompressor(3)
        for ids, texts, sets in blocks(batches):
            sids, gids, packed, rare, held = [], [], [], [], {"bits": [], "words": [], "prefix": []}
            for text, grams, key in zip(texts, sets, set_keys(sets)):
                sids.append(key if len(grams) else None)
                if not len(grams) or key in seen:
                    for column in (gids, packed, rare, *held.values()):
                        column.append(None)
                    continue
                seen.add(key)
                prefix, n_rare = ordered(grams, frequent.value, prefix_length(len(grams)))
                gids.append(int(mixed(mixed(prefix).sum(keepdims=True) + np.uint64(len(grams))).view(np.int64)[0]))
                packed.append(packer.compress(text))
                rare.append(n_rare)
                for name, values in (("bits", parities(grams)), ("words", parities(grams, PARITY_WORDS)), ("prefix", prefix.view(np.int64))):
                    held[name].append(values)
            digests = [hashlib.sha256(t).digest() if with_digest else None for t in texts]
            columns = [ids, digests, [*map(len, sets)], sids, gids, packed, held["bits"], held["words"], held["prefix"], rare]
            yield pa.RecordBatch.from_arrays([long_lists(c) if f.type == longs else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    longs = pa.list_(pa.int64())
    arrow = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sid", pa.binary()), ("gid", pa.int64()), ("packed", pa.binary()), ("bits", longs), ("words", longs), ("prefix", longs), ("rare", pa.int32())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, DOCUMENT)


def needed(n1: Column, n2: Column) -> Column:
    """Grams that two sets of these sizes share at least if they link."""
    return F.ceil(F.lit(PERCENT) * (n1 + n2) / F.lit(100 + PERCENT) - F.lit(1e-9))


def few_odd(words1: str, n1: Column, words2: str, n2: Column) -> Column:
    """Do the parities of fixed size leave it open that the sets link?"""
    apart = sum(F.bit_count(F.get(words1, F.lit(k)).bitwiseXOR(F.get(words2, F.lit(k)))) for k in range(PARITY_WORDS))
    return apart <= n1 + n2 - 2 * needed(n1, n2)


def few_odd_of_any(bits1: str, n1: Column, bits2: str, n2: Column) -> Column:
    """The same for parities by size, of sets whose sizes are near enough to link: the longer ones are folded once at most."""
    k = F.least(F.size(bits1), F.size(bits2))
    word = lambda bits, j: F.get(bits, j).bitwiseXOR(F.coalesce(F.when(F.size(bits) > k, F.get(bits, j + k)), F.lit(0).cast("long")))
    apart = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0), lambda total, j: total + F.bit_count(word(bits1, j).bitwiseXOR(word(bits2, j))))
    return apart <= n1 + n2 - 2 * needed(n1, n2)


def near_sizes(n1: Column, n2: Column) -> Column:
    return (100 * n1 >= PERCENT * n2) & (100 * n2 >= PERCENT * n1)


def may_link(n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
    """Size and position filters for two sets whose first common gram stands at these places of their orders."""
    return near_sizes(n1, n2) & (F.least(n1 - at1, n2 - at2) >= needed(n1, n2))


def listed(found: DataFrame) -> DataFrame:
    """gram, gid, n, at, rare, hub, held of the groups' prefixes, without the places whose gram no group of a near size shares.

    ``hub`` (at, n, gid) is the gram's purest group, the one with the fewest grams before it. The list of a
    frequent gram is dealt over ``SALTS`` lists, each with a hub of its own. ``held`` (64 bits) names the groups
    that a list holds; a frequent gram's list has a name of its own.
    """
    rows = found.where("prefix is not null").select("gid", "n", F.col("rare").alias("_rare"), F.posexplode("prefix").alias("at", "gram"))
    rows = rows.withColumn("rare", F.col("at") < F.col("_rare")).drop("_rare").withColumn("salt", F.when(F.col("rare"), 0).otherwise(F.pmod("gid", F.lit(SALTS))).cast("int"))
    by_size = Window.partitionBy("gram", "salt").orderBy("n")
    beside = F.coalesce(100 * F.col("n") >= PERCENT * F.lead("n").over(by_size), F.lit(False)) | F.coalesce(100 * F.lag("n").over(by_size) >= PERCENT * F.col("n"), F.lit(False))
    purest = Window.partitionBy("gram", "salt").orderBy("at", "n", "gid").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_beside", beside).where(F.col("_beside") | ~F.col("rare"))
    whole = purest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # sums of 32 bits a row: the order doesn't matter, and a repeated row does not cancel itself
    groups = [F.sum(F.shiftright(F.xxhash64("gid", F.lit(k)), 32)).over(whole) for k in range(2)]
    held = F.when(F.col("rare"), F.xxhash64(*groups)).otherwise(F.xxhash64("gram")).alias("held")
    return near.select("gram", "gid", "n", "at", "rare", F.first(F.struct("at", "n", "gid")).over(purest).alias("hub"), held)


def unlike_lists(lists: DataFrame) -> DataFrame:
    """gram, gid, at, before: of lists that hold the same groups only the one whose gram is first in the order.

    ``before`` names the last lists of the group, up to ``LISTS_BEFORE`` of them, whose grams come before.
    """
    first = lists.groupBy("gid", "held").agg(F.min(F.struct("at", "gram")).alias("first")).select("gid", "first.at", "first.gram")
    before = Window.partitionBy("gid").orderBy("at").rowsBetween(-LISTS_BEFORE, -1)
    return first.select("gram", "gid", "at", F.collect_list("gram").over(before).alias("before"))


def hub_pairs(lists: DataFrame) -> DataFrame:
    """gid, hub, times: groups with the hubs of their grams that size and position let them link with, and the hubs of dealt lists with each other's purest."""
    purest = Window.partitionBy("gram").orderBy("at", "n", "gid").rowsBetween(Window.unboundedPreceding, 0)
    hubs = lists.where("not rare and gid = hub.gid").select("gram", "gid", "n", "at").distinct()
    hubs = hubs.withColumn("hub", F.first(F.struct("at", "n", "gid")).over(purest))
    rows = lists.select("gid", "n", "at", "hub").unionByName(hubs.drop("gram")).where("gid <> hub.gid")
    rows = rows.where(may_link(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at")))
    return rows.groupBy("gid", F.col("hub.gid").alias("hub")).agg(F.count("*").alias("times"))


def texts_of(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """sid, packed of the sets ``wanted`` (sid), each once.

    Tasks pass a filter of the wanted sets before anything moves: the join after it would otherwise move every text
    as soon as the wanted ids are too many to be broadcast.
    """
    may = found.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("sid").alias("key")), FILTER_BITS))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            yield batch.select(["sid", "packed"]).filter(pa.array(in_filter(may.value, keys, FILTER_BITS)))

    given = found.where("packed is not null").select(F.xxhash64("sid").alias("key"), "sid", "packed")
    texts = given.mapInArrow(passed, "sid binary, packed binary")
    return texts.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("packed").alias("packed"))


def verified(pairs: DataFrame, members: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are over the threshold, as a table."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in slices(batches, 512):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            packed = dict(zip(a + b, batch.column("packed_a").to_pylist() + batch.column("packed_b").to_pylist()))
            raw = [unpacker.decompress(p) for p in packed.values()]
            sets, low = {}, 0
            names = list(packed)
            while low < len(raw):
                high, size = low, 0
                while high < len(raw) and (high == low or size + len(raw[high]) <= BLOCK_BYTES):
                    size += len(raw[high])
                    high += 1
                sets |= zip(names[low:high], gram_sets(raw[low:high]))
                low = high
            linked = []
            for x, y in zip(a, b):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                linked.append(100 * common >= PERCENT * (len(sets[x]) + len(sets[y]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    side = lambda k: members.select(F.col("sid").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}"))
    open_pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("b"), "b").join(side("a"), "a")
    left_open = near_sizes(F.col("n_a"), F.col("n_b")) & few_odd_of_any("bits_a", F.col("n_a"), "bits_b", F.col("n_b"))
    near = scratch.keep(open_pairs.where(left_open).select("a", "b"))
    # only the texts of sets in these pairs move
    texts = scratch.keep(texts_of(near.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), found))
    of = lambda k: texts.select(F.col("sid").alias(k), F.col("packed").alias(f"packed_{k}"))
    joined = near.join(of("b"), "b").join(of("a"), "a").select("a", "b", "packed_a", "packed_b")
    links = scratch.keep(joined.mapInArrow(check, "a binary, b binary"))
    scratch.free(near, texts)
    return links


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """sid and root (the smallest reachable) of every node of the links, as a table: label spreading with pointer jumping."""
    both = scratch.keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = scratch.keep(both.groupBy(F.col("u").alias("sid")).agg(F.min("v").alias("low")).select("sid", F.col("sid").alias("was"), F.least("sid", "low").alias("root")))
    while True:
        near = both.join(labels.select(F.col("sid").alias("v"), F.col("root").alias("other")), "v").groupBy(F.col("u").alias("sid")).agg(F.min("other").alias("other"))
        spread = labels.select("sid", "root").join(near, "sid").select("sid", F.col("root").alias("was"), F.least("root", "other").alias("root"))
        jumped = spread.join(labels.select(F.col("sid").alias("root"), F.col("root").alias("next")), "root")
        new = scratch.keep(jumped.select("sid", "was", F.least("root", "next").alias("root")))
        scratch.free(labels)
        labels = new
        if new.where("was <> root").isEmpty():
            scratch.free(both)
            return labels


def rooted(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (sid, root) after further links, which join the components that stand already."""
    of = lambda k: labels.select(F.col("sid").alias(k), F.col("root").alias(f"root_{k}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b")
    higher = components(between, scratch)
    out = scratch.keep(labels.join(higher.select(F.col("sid").alias("root"), F.col("root").alias("higher")), "root", "left").select("sid", F.coalesce("higher", "root").alias("root")))
    scratch.free(higher)
    return out


def unsettled(lists: DataFrame, members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets of one list that lie in different components and that the filters leave: one of them outside the list's largest component.

    A pair that shares several lists is told in the first, where the position filter leaves it if any does: it is passed over
    where both have a list in common among those named as before. The members of one group share all of their prefix: the group is a list of its own.
    """
    placed = scratch.keep(members.drop("bits").join(labels, "sid").withColumn("root", F.xxhash64("root")))
    ends = placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    own = ends.where("low <> high").select(F.xxhash64("gid").alias("gram"), "gid", F.lit(0).alias("at"), F.array().cast("array<long>").alias("before"), "low", "high")
    rows = lists.join(ends, "gid").select(*own.columns).union(own)
    rows = scratch.keep(rows)
    undecided = rows.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("gram")
    open_lists = scratch.keep(rows.drop("low", "high").join(undecided, "gram", "left_semi"))
    scratch.free(rows)
    roots = open_lists.join(placed.select("gid", "root").distinct(), "gid")
    sizes = roots.groupBy("gram", "root").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("gram").agg(F.max(F.struct("k", "root"))["root"].alias("most"))
    sets = scratch.keep(open_lists.join(placed, "gid").join(largest, "gram"))
    scratch.free(open_lists, placed)
    minor = sets.where("root <> most").select("gram", F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"), F.col("root").alias("root_x"), F.col("words").alias("words_x"), F.col("before").alias("before_x"))
    rest = sets.join(minor, "gram").where("root <> root_x").where((F.col("root") == F.col("most")) | (F.col("sid") < F.col("x")))
    rest = rest.where(may_link(F.col("n"), F.col("at"), F.col("n_x"), F.col("at_x")) & ~F.arrays_overlap("before", "before_x") & few_odd("words", F.col("n"), "words_x", F.col("n_x")))
    return rest.select(F.col("sid").alias("a"), F.col("x").alias("b"))


def classes(docs: DataFrame, with_digest: bool = False) -> DataFrame:
    """doc_id, digest, n, class of every document: ``class`` names its component and is null where the set is empty."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(described(docs, with_digest))
    given = found.where("packed is not null")
    members = scratch.keep(given.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("gid", "n", "bits", "words")]))
    every = scratch.keep(listed(found))
    pairs = scratch.keep(hub_pairs(every))
    forget_shuffles(docs.sparkSession)
    lists = scratch.keep(unlike_lists(every))
    scratch.free(every)
    forget_shuffles(docs.sparkSession)

    # one hub a group first, and the members of a group with the first of them
    first = members.groupBy("gid").agg(F.min("sid").alias("rep"))
    of = lambda pairs: pairs.join(first.select("gid", F.col("rep").alias("a")), "gid").join(first.select(F.col("gid").alias("hub"), F.col("rep").alias("b")), "hub").select("a", "b")
    within = members.join(first, "gid").where("sid <> rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
    best = pairs.groupBy("gid").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
    links = verified(of(best).union(within), members, found, scratch)
    labels = rooted(members.select("sid", F.col("sid").alias("root")), links, scratch)
    # then the other hubs, where they lie in another component
    label = lambda k: labels.select(F.col("sid").alias(k), F.col("root").alias(f"root_{k}"))
    others = of(pairs.join(best, ["gid", "hub"], "left_anti")).join(label("a"), "a").join(label("b"), "b").where("root_a <> root_b").select("a", "b")
    links = verified(others, members, found, scratch)
    labels = rooted(labels, links, scratch)
    forget_shuffles(docs.sparkSession)
    # last what the hubs have not settled
    links = verified(unsettled(lists, members, labels, scratch), members, found, scratch)
    labels = rooted(labels, links, scratch)
    out = scratch.keep(found.select("doc_id", "digest", "n", "sid").join(labels.withColumnRenamed("root", "class"), "sid", "left").drop("sid"))
    scratch.free(found, members, lists, pairs)
    return out


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; one row per input row.

    Two documents link when the Jaccard similarity of their sets of 5-word grams is 0.75 or more; the
    component is the smallest doc_id reachable by links, a null doc_id counting as the largest. With fewer
    than five words the whole sequence is the only gram; null, empty and white-space texts have none, link with
    nothing and are their own component. Repeated rows link with each other; an empty table gives an empty result.
    Texts are read whole: a very long one is one row, whose set of grams a task holds once. Further columns are not read.
    """
    with_root = classes(docs)
    smallest = with_root.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return with_root.join(smallest, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest doc_id (null last), then text digest.

    Documents go by doc_id and text, null counting as the empty text, so unlike texts under one doc_id or without
    one all stay; a repeated row stays once.
    """
    each = classes(docs, with_digest=True).groupBy("class", "doc_id", "digest").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "rows")).alias("first")
    linked = each.where("class is not null").groupBy("class").agg(first).select("first.doc_id", "first.digest", "first.rows")
    stay = linked.union(each.where("class is null").select("doc_id", "digest", "rows"))
    stay = cut(stay.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_sha"), F.col("rows").alias("_rows")))
    # the rows travel as one struct, so that no name of theirs meets one of ours
    marked = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("_key"), F.col("doc_id").alias("_doc"))
    on = marked["_doc"].eqNullSafe(stay["_id"]) & (marked["_key"] == stay["_sha"])
    repeated = not stay.where("_rows > 1").isEmpty()
    return once(marked.join(stay, on, "left_semi"), ["_doc", "_key"], repeated).select("row.*")
