"""Line dedup by winnowing over line hashes.

In every window of ``MIN_LINES`` lines, and in every shorter one of ``MIN_WORDS`` words, the line with the smallest
hash (the first, on ties) is selected, so two places that share a run of that size are sure to have selected the same
line of it: that line is their fingerprint. Only selected places are looked at further, and of these only those whose fingerprint
stands at two places. A place is matched with the first place that has the same fingerprint and the same lines to
its left and right, as far as a window reaches; every line of the window is compared, by 128 bits. Matches of neighbouring
fingerprints extend each other to the whole run. All but the first occurrence go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD_CLASS, text_or_empty

MIN_LINES, MIN_WORDS = 3, 50


def line_hashes(docs: DataFrame) -> DataFrame:
    lines = F.split(text_or_empty(), "\n")
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD_CLASS)))
    hashes, more = F.transform(lines, lambda x: F.xxhash64(x)), F.transform(lines, lambda x: F.xxhash64(x, F.lit(1)))
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), hashes.alias("hashes"), more.alias("more"), words.alias("words"))


def windows(min_lines: int, min_words: int | None) -> Column:
    """Windows (start, n) of ``min_lines`` lines, or of fewer with ``min_words`` words, as an array."""

    def of(n: int) -> Column:
        words = lambda i: sum(F.get("words", i + k) for k in range(n))
        starts = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: (i + n <= F.size("hashes")) & (F.lit(True) if n == min_lines else words(i) >= min_words))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n")))

    return F.flatten(F.array(*[of(n) for n in range(min_lines if min_words is None else 1, min_lines + 1)]))


def fingerprints(hashed: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """place, fingerprint, around of every selected line; ``around`` holds the windows that it was selected in.

    ``place`` orders lines over the corpus: by doc_id (null last), text, line.
    """
    least = lambda w: F.array_min(F.slice("hashes", w["start"] + 1, w["n"]))
    lines = lambda c, w: F.slice(c, w["start"] + 1, w["n"])
    chosen = F.transform("windows", lambda w: F.struct((w["start"] + F.array_position(lines("hashes", w), least(w)) - 1).cast("int").alias("at"), w["start"].alias("start"), w["n"].alias("n")))
    rows = hashed.withColumn("windows", windows(min_lines, min_words)).withColumn("chosen", chosen).withColumn("at", F.explode(F.array_distinct(F.transform("chosen", lambda w: w["at"]))))
    around = F.transform(F.filter("chosen", lambda w: w["at"] == F.col("at")), lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n"), F.xxhash64(lines("hashes", w)).alias("one"), F.xxhash64(lines("more", w)).alias("two")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "at")
    return rows.select(place.alias("place"), F.get("hashes", F.col("at")).alias("fingerprint"), around.alias("around"))


def later_windows(docs: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """doc_id, text_key, start, n of windows that stand at an earlier place too."""
    rows = fingerprints(line_hashes(docs), min_lines, min_words)
    shared = rows.groupBy("fingerprint").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low <> high").select(F.col("fingerprint").alias("f"))
    near = rows.join(shared, rows["fingerprint"] == shared["f"], "left_semi").select("place", F.inline("around"))
    # the selected line lies at the same place of equal windows, so the first place is that of the first window
    spot = F.struct("place.none", "place.doc_id", "place.text_key", "start")
    near = near.select(spot.alias("spot"), "n", "one", "two")
    first = near.groupBy("n", "one", "two").agg(F.min("spot").alias("first"), F.max("spot").alias("last")).where("first <> last")
    first = first.select(F.col("n").alias("m"), F.col("one").alias("a"), F.col("two").alias("b"), "first")
    joined = near.join(first, (near["one"] == first["a"]) & (near["two"] == first["b"]) & (near["n"] == first["m"]))
    return joined.where("spot > first").select("spot.doc_id", "spot.text_key", "spot.start", "n")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text of every document; one row per input row.

    Lines are what newlines separate. A line goes if it lies in a run of whole lines, ``min_lines`` at least
    or ``min_words`` words at least, that also stands earlier, in the same document or one with a smaller doc_id
    (null last); with ``min_words`` None only lines count. Words are what ASCII white space separates. Null counts as
    the empty text, which has one line. Rows that repeat a doc_id and its text are one document and do not
    count as earlier; an empty table gives an empty result; further columns are not read. A very long text is
    one row with an array over its lines.
    """
    gone = later_windows(docs, min_lines, min_words).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    gone = gone.agg(F.collect_set(F.struct("start", "n")).alias("found"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))
    on = rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["text_key"] == gone["_key"])
    joined = rows.join(gone, on, "left").withColumn("lines", F.split("text", "\n"))
    covered = F.flatten(F.transform(F.coalesce("found", F.array().cast("array<struct<start: int, n: int>>")), lambda w: F.sequence(w["start"], w["start"] + w["n"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    kept = F.transform(stay, lambda i: F.element_at("lines", i + 1))
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(stay)).cast("long").alias("n_removed"),
        F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
