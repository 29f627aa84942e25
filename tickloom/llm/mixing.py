"""Mixing sources to target weights by a time-varying curriculum, in DataFrame expressions only.

Targets: each source gets a share of the mix by weight, at most ``max_epochs`` times its size, and what is
above goes to the others (water filling, in closed form over the sources sorted by cap over weight).
Order: a source asks for words at a rate that changes linearly over the training, target * (1 + slope *
(2t - 1)). Its integral, the cumulative demand, is inverted at each document's cumulative word count, which
gives the document's position in [0, 1); the range sort by position is the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import WORD_CLASS, cut, once, text_or_empty

#: Weights of the sources by code point, repeating, and the change of their demand over the training.
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)
MIX_PER_MILLE, MAX_EPOCHS = 1500, 2
#: Documents that one window partition of a source should hold.
ROWS_PER_BUCKET = 256


def size_of() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD_CLASS)).cast("long")


def cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame) -> DataFrame:
    """source, n_rows, source_size, slope, target of every source of ``sized`` (source, size).

    The windows here run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    per = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    per = (
        per.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", cycle(WEIGHTS, F.col("rank")))
        .withColumn("slope", cycle(SLOPES, F.col("rank")))
        .withColumn("cap", F.col("source_size") * MAX_EPOCHS)
        .withColumn("budget", F.sum("source_size").over(whole) * MIX_PER_MILLE / 1000.0)
    )
    fullest = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("full", F.col("cap") * weights_left <= F.col("weight") * left)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest / rest_weight)
    return per.withColumn("target", target).select("source", "n_rows", "source_size", "slope", "target")


def words_before(sized: DataFrame) -> DataFrame:
    """Adds ``before``: words of the same source that come earlier in the source's order (by digest of doc_id).

    The running sum is split by leading digits of the digest, so that no task holds a whole source: sums of
    the buckets first, then the rows of each bucket.
    """
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n_rows") / ROWS_PER_BUCKET))).cast("int")
    keyed = sized.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("bucket", F.substr("digest", F.lit(1), digits))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = rows["source"].eqNullSafe(sums["_source"]) & (rows["bucket"] == sums["_bucket"])
    return rows.join(sums, on).withColumn("before", F.col("base") + F.col("inner")).drop("_source", "_bucket", "base", "inner", "bucket", "digest")


def position(words: Column) -> Column:
    """Training time in [0, 1] at which the source has asked for ``words``: the inverse of its cumulative demand."""
    done, slope = words / F.col("target"), F.col("slope")
    curve = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * done) - (1 - slope)) / (2 * slope)
    return F.round(F.when(slope == 0, done).otherwise(curve), 9) + F.lit(0.0)  # no negative zero


def mix(docs: DataFrame) -> DataFrame:
    """The mix in training order: doc_id, size, source_size, target, taken, first_position; one row per input row.

    Size is the number of words (null: 0). ``taken`` counts the words the mix takes of a document, repeats
    included: pass e over a source covers the words [e * source_size, (e + 1) * source_size) of its demand
    and the mix takes those below the target, so only the last document of a source can be taken in part.
    A document that isn't taken has a null ``first_position`` and sorts last. A null source is a source of its
    own, the last. Repeated rows count as often as they stand there; an empty table gives an empty result. A source without
    words has the target 0. Of a very long text only its count of words travels; further columns are not read.
    """
    sized = cut(docs.select("doc_id", "source", size_of().alias("size"), F.xxhash64("text").alias("text_key")))
    per = cut(source_targets(sized)).withColumnRenamed("source", "_source")
    rows = words_before(sized.join(per, sized["source"].eqNullSafe(per["_source"])).drop("_source"))
    limit = F.floor("target")
    taken = sum(
        F.greatest(F.lit(0), F.least(F.col("size"), limit - (F.col("source_size") * e + F.col("before")))) for e in range(MAX_EPOCHS)
    )
    rows = rows.withColumn("taken", taken.cast("long")).withColumn(
        "first_position", F.when(F.col("taken") > 0, position(F.col("before")))
    )
    order = F.coalesce(F.col("first_position"), 1 + F.col("before") / (F.col("source_size") + 1))
    return rows.orderBy(order, "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken", "first_position", "before", "slope", "text_key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, in training order: all columns of ``docs``, a row for each whole copy the mix takes.

    A copy of which the mix takes less than half is left out, any other stands whole.
    """
    plan = mix(docs)
    half = F.col("size") / 2
    passes = F.array_compact(
        F.array(*[
            F.when(
                (F.col("size") > 0) & (F.least(F.col("size"), F.floor("target") - (F.col("source_size") * e + F.col("before"))) >= half),
                position(F.col("source_size") * e + F.col("before")),
            )
            for e in range(MAX_EPOCHS)
        ])
    )
    key = ["doc_id", "source", "text_key"]
    plan = plan.withColumn("_passes", passes).where(F.size("_passes") > 0)
    plan = plan.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.flatten(F.collect_list("_passes")).alias("_passes"), F.count("*").alias("_rows"))
    plan = cut(plan)
    # the rows travel as one struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.col("source").alias("from"), F.xxhash64("text").alias("key"))
    rows = once(rows, ["doc", "from", "key"], not plan.where("_rows > 1").isEmpty())
    on = rows["doc"].eqNullSafe(plan["_doc_id"]) & rows["from"].eqNullSafe(plan["_source"]) & (rows["key"] == plan["_text_key"])
    copies = rows.join(plan, on).withColumn("at", F.explode("_passes"))
    return copies.orderBy("at", "doc").select("row.*")
