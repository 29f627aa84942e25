"""Quality rules whose cutoffs come with a guarantee, in DataFrame expressions only.

Fixed base rules go first. Above them stand rules of one measure each, whose cutoffs are chosen per stratum (lang) from labelled
documents. Half of the labelled texts, by digest, propose: for several tolerances, lax to strict, each rule takes the
cutoff of its grid that rejects the most bad texts while it rejects no more good ones than its part of the tolerance, of equal ones the laxest. The
other half, the holdout, disposes: a proposal is admitted if so few good holdouts are rejected by its rules together that, were
its true rate of false rejection above ``alpha``, this would happen with a chance of ``delta / strata`` at most, by
the exact binomial tail. Proposals of a stratum are tested from lax to strict up to the first that fails, which needs no
correction; the strata share ``delta`` (Bonferroni). So with a chance of 1 - delta no stratum loses more than ``alpha`` of its
good documents to the rules. A stratum with too few labels to prove that has no rules beyond the base.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import Scratch, text_or_empty

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, REPEAT_PERCENT, WINDOW, SYMBOLS = 50, 50, 3, "#*$%&|<>"
SPACES = "[\\x20\\x09-\\x0D]"
#: Share of good texts that a proposal's rules may reject together among the texts that propose, lax to strict.
TOLERANCES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04)
#: Cutoffs of each rule, lax to strict; a text fails a rule if its measure is above the cutoff.
GRIDS: dict[str, tuple[float, ...]] = {
    "short_words": (-1.5, -2.0, -2.5, -2.75, -3.0, -3.25, -3.5, -3.75, -4.0, -4.25, -4.5),
    "long_words": (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.0),
    "symbols": (4.0, 2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05),
    "repeated_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeated_words": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "capitals": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
}


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _standing_twice(keyed: Column) -> Column:
    """Of an array of (key, place): the places whose key stands twice or more."""

    def of(rows: Column) -> Column:
        at = lambda i: F.get(rows, i)["key"]
        twice = F.filter(rows, lambda x, i: F.coalesce(at(i - 1) == x["key"], F.lit(False)) | F.coalesce(at(i + 1) == x["key"], F.lit(False)))
        return F.transform(twice, lambda x: x["place"])

    return bound(F.sort_array(keyed), of)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many of ``words`` lie in a window of consecutive words that stands twice or more.

    Windows meet by hash first; only if two do, those that do are compared by their words.
    """
    inside = lambda w, i: [F.get(w, i + k) for k in range(window)]

    def covered(places: Column) -> Column:
        ahead = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(ahead, F.lit(0), lambda a, b: a + b)

    def among(w: Column, places: Column) -> Column:
        keyed = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *inside(w, i)).alias("key"), i.alias("place")))
        return bound(F.sort_array(_standing_twice(keyed)), covered)

    def hashed(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*inside(w, i)))

        def of(h: Column) -> Column:
            keyed = F.transform(h, lambda x, i: F.struct(x.alias("key"), i.alias("place")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound(_standing_twice(keyed), lambda places: among(w, places)))

        return bound(hashes, of)

    return F.when(F.size(words) < window + 1, 0).otherwise(bound(words, hashed))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, key and the counts the rules look at, one row per row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text_or_empty().alias("text"))
    words = F.array_remove(F.split("text", f"{SPACES}+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("words", words).withColumn("lines", lines)
    return rows.select(
        "doc_id", "stratum", F.md5(F.col("text").cast("binary")).alias("key"),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def values() -> list[Column]:
    """The measure of each rule of ``GRIDS``, in their order, of a document with words."""
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    a_word = per("word_chars", "n_words")
    return [-a_word, a_word, per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_capitals", "word_chars")]


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial X of ``n`` draws with chance ``p``; 1 from k = n p on, where no test is passed.

    Terms are added in logarithms, each from the one before, so that none underflows; at most n p of them.
    """
    import math

    odds, first = F.lit(math.log(p / (1 - p))), n * math.log1p(-p)

    def step(sums: Column, i: Column) -> Column:
        term = sums["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(term, sums["total"]) + F.log1p(F.exp(-F.abs(term - sums["total"])))).alias("total"))

    draws = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(draws, F.struct(first.alias("term"), first.alias("total")), step, lambda sums: F.exp(sums["total"]))
    return F.when(k >= n * p, 1.0).otherwise(total)


def proposals(rows: DataFrame, grids: dict[str, tuple[float, ...]], tolerances: tuple[float, ...]) -> DataFrame:
    """stratum, levels of the proposing texts ``rows`` (stratum, good, values): for each tolerance the cutoffs of all rules, null where a rule is off."""
    grid = F.element_at(F.array(*[F.array(*[F.lit(c) for c in g]) for g in grids.values()]), F.col("rule") + 1)
    one = rows.select("stratum", "good", F.posexplode("values").alias("rule", "value"))
    # a text fails the cutoffs of the grid from its place on
    placed = one.withColumn("place", F.size(F.filter(grid, lambda c: F.col("value") <= c)))
    counts = placed.groupBy("stratum", "rule", "place").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    held = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("place", "good", "bad")).alias("held"), F.sum("good").alias("n_good"))
    upto = lambda c, name: F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + F.when(x["place"] <= c, x[name]).otherwise(0))
    tried = F.transform(grid, lambda cutoff, c: F.struct(upto(c, "bad").alias("bad"), (-c).alias("laxest"), cutoff.alias("cutoff"), upto(c, "good").alias("good")))
    held = held.withColumn("tried", tried)

    def chosen(tolerance: float) -> Column:
        allowed = F.filter("tried", lambda x: (x["good"] <= F.col("n_good") * (tolerance / len(grids))) & (x["bad"] > 0))
        return F.array_max(allowed)["cutoff"]

    by_level = held.select("stratum", "rule", F.posexplode(F.array(*[chosen(t) for t in tolerances])).alias("level", "cutoff"))
    rules = F.transform(F.array_sort(F.collect_list(F.struct("rule", "cutoff"))), lambda x: x["cutoff"])
    return by_level.groupBy("stratum", "level").agg(rules.alias("cutoffs"))


def rejects(values: Column, cutoffs: Column, rules: int) -> list[Column]:
    return [F.coalesce(values[r] > cutoffs[r], F.lit(False)) for r in range(rules)]


def thresholds(
    measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grids: dict[str, tuple[float, ...]] = GRIDS, tolerances: tuple[float, ...] = TOLERANCES
) -> DataFrame:
    """stratum, level, cutoffs, n_holdouts, n_rejected, chance of every stratum with an admitted proposal: of these the one that
    rejects the most labelled bad texts, of equal ones the laxest.

    ``labels`` has doc_id and quality (1 good, 0 bad, else no label); of several labels of a doc_id the largest counts. Only
    texts that pass the base rules take part, and texts that are equal are one draw.
    """
    scratch = Scratch(measured.sparkSession)
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") == 1).alias("good"))
    rows = measured.where(~base_failed()).withColumn("values", F.array(*values()))
    rows = rows.join(marks, rows["doc_id"] == marks["_id"]).select("stratum", "key", "good", "values").dropDuplicates(["stratum", "key", "good"])
    # an even last digit of the text's digest: it proposes
    rows = scratch.keep(rows.withColumn("proposes", F.conv(F.substring("key", -1, 1), 16, 10).cast("int") % 2 == 0).drop("key"))
    levels = scratch.keep(proposals(rows.where("proposes"), grids, tolerances)).withColumnRenamed("stratum", "_stratum")
    tested = rows.join(levels, rows["stratum"] == levels["_stratum"]).withColumn("gone", reduce(Column.__or__, rejects(F.col("values"), F.col("cutoffs"), len(grids))))
    holdout = F.col("good") & ~F.col("proposes")
    tested = tested.groupBy("stratum", "level").agg(
        F.count_if(holdout).alias("n_holdouts"), F.count_if(holdout & F.col("gone")).alias("n_rejected"),
        F.count_if(~F.col("good") & F.col("gone")).alias("n_bad"), F.first("cutoffs").alias("cutoffs"),
    )
    tested = scratch.keep(tested.withColumn("chance", binomial_tail(F.col("n_holdouts"), F.col("n_rejected"), alpha)))
    strata = max(1, tested.select("stratum").distinct().count())
    so_far = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    admitted = tested.withColumn("worst", F.max("chance").over(so_far)).where(F.col("worst") <= delta / strata)
    best = admitted.groupBy("stratum").agg(F.max_by(F.struct("level", "cutoffs", "n_holdouts", "n_rejected", "chance"), F.struct("n_bad", -F.col("level"))).alias("best"))
    return best.select("stratum", "best.*")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept, failed_rules of every document; one row per input row.

    ``failed_rules`` names the rules above the base that a document fails in its stratum; it is kept if it passes the base
    and fails none of them. Null counts as the empty text, a null lang as the stratum of the empty string. Words are what
    ASCII white space separates; lines are what newlines separate, those without a word left out. Repeated rows share
    their fate; an empty table gives an empty result; without labels, or with too few of a stratum, only the base rules
    hold. Further columns are not read. A text is read whole as one row; its windows of words take memory in its proportion.
    """
    scratch = Scratch(docs.sparkSession)
    measured = scratch.keep(measures(docs))
    cutoffs = scratch.keep(thresholds(measured, labels, alpha, delta)).select(F.col("stratum").alias("_stratum"), "cutoffs")
    rows = measured.join(cutoffs, measured["stratum"] == cutoffs["_stratum"], "left").withColumn("base_failed", base_failed())
    failed = [F.when(fails, F.lit(name)) for name, fails in zip(GRIDS, rejects(F.array(*values()), F.col("cutoffs"), len(GRIDS)))]
    rows = rows.withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*failed))))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules", "n_lines", "n_capitals", "stratum",
    )
