"""Joins of rows that have a place (a bar, a time) in a series, without pairing every row of a series with every other.

``as_of`` merges both sides in order of their places. ``within`` and ``near`` cut places into buckets and join on these, so that a
series is also dealt over many tasks; the exact test follows.

The planner takes spread rows for as few as they were before, and would send them all to the driver to broadcast them: what is
spread is joined as ``spread_out`` says, by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, value: Column, name: str, order: Column | None = None, forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with ``name``: ``value`` of the last row of ``right`` at or before its place, null if there is none.

    ``forward`` takes the first at or after it; ``strict`` leaves out rows at the same place. Of rows at one place the one with the
    largest ``order`` is last. Each row of ``left`` comes out once; a null place matches nothing and is matched by nothing.
    Both sides are sorted by place once: the work is that of their rows, not of their pairs.
    """
    order = F.lit(0) if order is None else order
    held = left.select(*keys, left_at.alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(0).alias("_order"), F.struct("*").alias("_row"))
    given = right.where(right_at.isNotNull()).select(*keys, right_at.alias("_at"), F.lit(1 if strict else 0).alias("_side"), order.alias("_order"), value.alias("_value"))
    every = held.unionByName(given, allowMissingColumns=True)
    way = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    # a null place sorts before all of the other side
    nulls = F.col("_at").isNotNull()
    so_far = Window.partitionBy(*keys).orderBy(nulls, way("_at"), F.col("_side"), way("_order")).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("_found", F.last("_value", ignorenulls=True).over(so_far)).where("_row is not null")
    return found.select("_row.*", F.col("_found").alias(name))


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows that stand for many more than the planner knows of, never to be broadcast: the next join sorts and merges both sides."""
    return rows.hint("merge")


def within(rows: DataFrame, spans: DataFrame, keys: list[str], at: Column, start: Column, end: Column, width: int) -> DataFrame:
    """Each row beside each span (both ends included) that its place ``at`` lies in: the columns of both, keys once.

    A span is spread over the buckets of ``width`` that it touches, so that should be some average length of spans. Spans with a null end
    or that end before they start hold nothing.
    """
    bucket = lambda c: F.floor(c / width)
    spread = spans.where(start <= end).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    spread = spread.withColumns({"_start": start, "_end": end})
    placed = rows.withColumn("_bucket", bucket(at)).withColumn("_at", at)
    return placed.join(spread_out(spread), [*keys, "_bucket"]).where("_at between _start and _end").drop("_bucket", "_at", "_start", "_end")


def near(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, reach: int) -> DataFrame:
    """Pairs of rows whose places are at most ``reach`` apart: the columns of both, keys once."""
    width = max(1, reach)
    bucket = lambda c: F.floor(c / width)
    spread = left.withColumn("_left", left_at).withColumn("_bucket", F.explode(F.sequence(bucket(left_at) - 1, bucket(left_at) + 1)))
    placed = right.withColumn("_right", right_at).withColumn("_bucket", bucket(right_at))
    return spread_out(spread).join(placed, [*keys, "_bucket"]).where(F.abs(F.col("_left") - F.col("_right")) <= reach).drop("_bucket", "_left", "_right")
