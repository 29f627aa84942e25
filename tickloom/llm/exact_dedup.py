"""Exact duplicates by content-defined chunk recipes, in DataFrame expressions only.

The normalised text (ASCII white space deleted) is cut where its last three characters fall into given
classes, so equal passages are cut alike wherever they stand. Distinct chunks meet once, under a 64-bit
identifier, and every identifier is checked to stand for one chunk text; if two texts ever share one, all
chunks get identifiers from the next seed. Documents are then compared by their ordered identifier lists,
a few bytes a chunk: no document moves as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE_CLASS, cut, once, text_or_empty

#: Code points of a chunk; only a text with no place of the kinds below is cut at the greater length.
MIN_CHUNK, MAX_CHUNK = 512, 8192
#: Where a chunk may end: after characters of these classes. Latin letters first, then the same for Cyrillic
#: letters and digits, then frequent characters of other scripts before some others, and punctuation beyond ASCII;
#: each stands at one place in some tens to hundreds, so that chunks fall into step again after a change.
BOUNDARIES = (
    r"(?<=[b-dl-nr-tB-DL-NR-T.,;][aeiouAEIOU][^a-mA-M])",
    r"(?<=[аеоий][нтрсл][^а-м])",
    r"(?<=[0-4][13579][05])",
    r"(?<=[的了是不のに에는من\u0E32\u093E][一-个あ-お가-기ا-ت\u0E01-\u0E08\u0915-\u091A])",
    r"(?<=[\p{P}&&[^\x00-\x7F]][一-人あ-が가-나Α-οА-к])",
)
BOUNDARY = "|".join(BOUNDARIES)


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS, "")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a text, in order; together they are the text."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?(?:{BOUNDARY}|$)|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_id(chunk: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), chunk)


def verified(texts: DataFrame, identify: Callable[[Column, int], Column], seed: int) -> bool:
    """Does every identifier stand for one chunk text? ``texts`` has a column ``norm``."""
    pieces = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    clashes = (
        pieces.groupBy(identify(F.col("chunk"), seed).alias("id"))
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .where("low <> high")
    )
    return clashes.isEmpty()


def grouped(docs: DataFrame, identify: Callable[[Column, int], Column], seeds: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and ``whole``, a digest of the text as it is; see :func:`exact_dedup`."""
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("norm", normalised(F.col("text")))
    seed = next((s for s in range(seeds) if verified(texts, identify, s)), None)
    if seed is None:
        raise ValueError("no seed gives every chunk text an identifier of its own")
    recipes = cut(
        texts.select(
            "doc_id",
            F.char_length("text").alias("n_points"),
            F.transform(chunks(F.col("norm")), lambda c: identify(c, seed)).alias("recipe"),
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("whole"),
            F.monotonically_increasing_id().alias("row"),  # the checkpoint holds it fast
        )
    )
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "whole", "row")
    groups = cut(recipes.groupBy("recipe").agg(F.min(order).alias("first"), F.count("*").alias("group_size")))
    return recipes.join(groups, "recipe").select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "whole"
    )


def exact_dedup(docs: DataFrame, identify: Callable[[Column, int], Column] = chunk_id, seeds: int = 8) -> DataFrame:
    """Groups of equal documents: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Texts are equal when the same after deleting ASCII white space; null counts as empty. The row with the
    most code points in the original text, then the smallest doc_id (null last), then the smallest digest of the
    original text stays; of rows that repeat both, any one of them: every group keeps exactly one row. A very
    long text is many chunks and moves as none. An empty table gives an empty result; further columns of
    ``docs`` are not read.
    """
    return grouped(docs, identify, seeds).drop("whole")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with all their columns; a repeated row stays once."""
    stay = cut(grouped(docs, chunk_id, 8).where("kept").select(F.col("doc_id").alias("_id"), "whole"))
    # the rows travel as one struct, so that no name of theirs meets one of ours
    marked = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("_key"), F.col("doc_id").alias("_doc"))
    on = marked["_doc"].eqNullSafe(stay["_id"]) & (marked["_key"] == stay["whole"])
    kept = marked.join(stay, on, "left_semi")
    repeated = not marked.groupBy("_doc", "_key").count().where("count > 1").isEmpty()
    return once(kept, ["_doc", "_key"], repeated).select("row.*")
