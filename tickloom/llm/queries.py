"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, quality, topk, warc
from tickloom.llm.common import WORD_CLASS, cut, table, text_or_empty
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.filter_audit import interactions, masks
from tickloom.llm.line_dedup import line_dedup
from tickloom.llm.mixing import mix
from tickloom.llm.ngram_join import ngram_join
from tickloom.llm.periodic import periodic_runs
from tickloom.llm.quality_rules import quality_rules
from tickloom.llm.secrets import scan
from tickloom.llm.suffix_dedup import suffix_dedup


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op3_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(warc.write(table(spark, sf_dir, "pages")))
    return warc.read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def _kept_lines(rows: DataFrame) -> DataFrame:
    kept = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return rows.select("doc_id", "n_lines", "n_removed", kept)


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs by lines and by words: one or two long lines go too."""
    return _kept_lines(line_dedup(table(spark, sf_dir, "documents")))


def line_winnowing_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs by lines alone, however long these are."""
    return _kept_lines(line_dedup(table(spark, sf_dir, "documents"), min_words=None))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Texts of which about one in ten, by the check sum of doc_id, repeats its words from some place on."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(code / 10).cast("long")

    def rewritten(words):
        n = F.size(words)
        a = F.pmod(g, n.cast("long")).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # the words are bound once, as the only element of an array, and not cut anew for each place
    bound = F.array(F.regexp_extract_all(text_or_empty(), F.lit(f"({WORD_CLASS})")))
    changed = F.transform(bound, lambda words: F.when(F.size(words) > 0, rewritten(words)).otherwise(""))[0]
    return docs.select("doc_id", F.when(code % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_made_periodic(table(spark, sf_dir, "documents")))
    # the longest run, of equal ones the first, then the one with the smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.less")).alias("period"), F.floor(1000 * F.col("longest.length") / -F.col("longest.less")).cast("long").alias("exponent_milli"),
        digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words", "n_dropped",
    )


def op12_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("failed_rules", F.array_join("failed_rules", ",")).drop("stratum")


def op13_trie_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a label's doc_id have the label if any of them has."""
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
    labels = labels.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masks(table(spark, sf_dir, "documents"))
    return interactions(rows.join(labels, rows["doc_id"] == labels["_id"], "left"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_chunk_reuse": op1_bpe_chunk_reuse,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op3_suffix_radix": op3_suffix_radix,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc_zstd": op5_warc_zstd,
    "op6_ngram_group_join": op6_ngram_group_join,
    "op7_pu_quality": op7_pu_quality,
    "op8_ball_tree_topk": op8_ball_tree_topk,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_winnowing": op10_line_winnowing,
    "op11_periodic_diagonals": op11_periodic_diagonals,
    "op12_risk_controlled_rules": op12_risk_controlled_rules,
    "op13_trie_filter_audit": op13_trie_filter_audit,
    "line_winnowing_by_lines": line_winnowing_by_lines,
}

ORACLE: dict[str, str] = {
    "op2_curriculum_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][rk % 3 + 1] AS weight, [-0.5, 0.0, 0.5][rk % 3 + 1]::DOUBLE AS slope, 2 * source_size AS cap,
         sum(source_size) OVER () * 1500 / 1000.0::DOUBLE AS budget, sum([3, 1, 2][rk % 3 + 1]) OVER () AS weights FROM per
), filled AS (
  SELECT *, cap * (weights - coalesce(sum(weight) OVER w, 0)) <= weight * (budget - coalesce(sum(cap) OVER w, 0)) AS filled
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, slope, CASE WHEN filled THEN cap::DOUBLE ELSE
    weight * (budget - coalesce(sum(cap) FILTER (WHERE filled) OVER (), 0)) / sum(weight) FILTER (WHERE NOT filled) OVER () END AS target
  FROM filled
), ordered AS (
  SELECT doc_id, size, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY sized.source
    ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), counted AS (
  SELECT *, (greatest(0, least(size, floor(target)::BIGINT - before))
           + greatest(0, least(size, floor(target)::BIGINT - source_size - before)))::BIGINT AS taken FROM ordered
)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN before / target
  ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (before / target)) - (1 - slope)) / (2 * slope) END, 9) + 0.0 END AS first_position
FROM counted""",
    "op5_warc_zstd": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f""",
    "op8_ball_tree_topk": r"""
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.ints) = 0 THEN 0 ELSE list_inner_product(q.ints, c.ints) END::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.place <> c.place AND len(q.ints) = len(c.ints)
)
SELECT query_id, (row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op9_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS whole, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST, whole)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
    "line_winnowing_by_lines": r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, len(lines) - 2)) AS start, lines FROM d
), f AS (
  SELECT doc_id, start, min(row(doc_id, start)) OVER (PARTITION BY lines[start + 1 : start + 3]) AS first FROM w
), gone AS (
  SELECT doc_id, list_distinct(flatten(list([start, start + 1, start + 2]))) AS places FROM f WHERE row(doc_id, start) > first GROUP BY doc_id
), k AS (
  SELECT d.doc_id, lines, list_filter(range(0, len(lines)), lambda i: NOT list_contains(coalesce(places, []), i)) AS stay FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(stay, lambda i: lines[i + 1]), chr(10))) AS kept_sha256
FROM k""",
    "op10_line_winnowing": r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), p AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS start, lines FROM d
), w AS (
  SELECT doc_id, start, n, lines[start + 1 : start + n] AS run FROM p, (VALUES (1), (2), (3)) AS s(n) WHERE start + n <= len(lines)
), f AS (
  SELECT doc_id, start, n, min(row(doc_id, start)) OVER (PARTITION BY run) AS first FROM w
  WHERE n = 3 OR len(regexp_extract_all(array_to_string(run, ' '), '[^\x20\x09-\x0D]+')) >= 50
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(start, start + n)))) AS places FROM f WHERE row(doc_id, start) > first GROUP BY doc_id
), k AS (
  SELECT d.doc_id, lines, list_filter(range(0, len(lines)), lambda i: NOT list_contains(coalesce(places, []), i)) AS stay FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(stay, lambda i: lines[i + 1]), chr(10))) AS kept_sha256
FROM k""",
    "op13_trie_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails FROM m LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, n_fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, step, o[step] AS own, o[1 : step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
), j AS (
  SELECT part, o, step, n, n_fails, good, toxic, fails[own] AS failed, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone FROM c, steps
)
SELECT part, array_to_string(o, '') AS filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND failed), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND failed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (WHERE NOT gone AND failed AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND failed AND toxic), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(n_fails, 1)) FILTER (WHERE failed), 0)::BIGINT AS shapley
FROM j GROUP BY part, o, step""",
    "op12_risk_controlled_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS place FROM documents
), windows AS (
  SELECT place, i, count(*) OVER (PARTITION BY place, run) AS times FROM (
    SELECT place, i, words[i : i + 2] AS run FROM (SELECT place, words, unnest(range(1, len(words) - 1)) AS i FROM d))
), repeats AS (
  SELECT place, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS s(k) WHERE times > 1 GROUP BY place
), m AS (
  SELECT doc_id, stratum, md5(text) AS key, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals FROM d LEFT JOIN repeats USING (place)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words > 0 THEN [-(word_chars / n_words), word_chars / n_words,
         n_symbols / n_words, n_dup_lines / n_lines, n_repeat_words / n_words, n_capitals / word_chars] END AS vals FROM m
), marks AS (
  SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT DISTINCT stratum, key, good, vals, key[-1] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS proposes FROM v JOIN marks USING (doc_id) WHERE NOT base_failed
), grids AS (
  SELECT * FROM (VALUES
    (1, 'short_words', [-1.5, -2.0, -2.5, -2.75, -3.0, -3.25, -3.5, -3.75, -4.0, -4.25, -4.5]), (2, 'long_words', [20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.0]),
    (3, 'symbols', [4.0, 2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05]), (4, 'repeated_lines', [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    (5, 'repeated_words', [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]), (6, 'capitals', [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05])) AS g(rule, name, cuts)
), tried AS (
  SELECT stratum, rule, c, cuts[c]::DOUBLE AS cutoff, count(*) FILTER (WHERE good) AS n_good,
         count(*) FILTER (WHERE good AND vals[rule] > cuts[c]) AS good, count(*) FILTER (WHERE NOT good AND vals[rule] > cuts[c]) AS bad
  FROM texts, (SELECT rule, cuts, unnest(range(1, len(cuts) + 1)) AS c FROM grids) WHERE proposes GROUP BY stratum, rule, c, cuts
), levels AS (
  SELECT stratum, rule, level, arg_max(cutoff, row(bad, -c)) FILTER (WHERE bad > 0 AND good <= n_good * (t / 6)) AS cutoff
  FROM tried, (VALUES (0, 0.0::DOUBLE), (1, 0.002::DOUBLE), (2, 0.005::DOUBLE), (3, 0.01::DOUBLE), (4, 0.02::DOUBLE), (5, 0.04::DOUBLE)) AS tolerances(level, t) GROUP BY stratum, rule, level
), sets AS (
  SELECT stratum, level, list(cutoff ORDER BY rule) AS cutoffs FROM levels GROUP BY stratum, level
), gone AS (
  SELECT stratum, level, cutoffs, good, proposes, len(list_filter(range(1, 7), lambda r: coalesce(vals[r] > cutoffs[r], false))) > 0 AS gone FROM texts JOIN sets USING (stratum)
), tested AS (
  SELECT stratum, level, cutoffs, count(*) FILTER (WHERE good AND NOT proposes) AS n, count(*) FILTER (WHERE good AND NOT proposes AND gone) AS k,
         count(*) FILTER (WHERE NOT good AND gone) AS bad FROM gone GROUP BY stratum, level, cutoffs
), chances AS (
  SELECT *, CASE WHEN k >= n * 0.05 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) END AS chance FROM tested
), admitted AS (
  SELECT *, max(chance) OVER (PARTITION BY stratum ORDER BY level) <= 0.05 / (SELECT count(DISTINCT stratum) FROM chances) AS passed FROM chances
), best AS (
  SELECT stratum, arg_max(cutoffs, row(bad, -level)) AS cutoffs FROM admitted WHERE passed GROUP BY stratum
), judged AS (
  SELECT v.*, CASE WHEN base_failed THEN [] ELSE list_filter(range(1, 7), lambda r: coalesce(vals[r] > cutoffs[r], false)) END AS failed FROM v LEFT JOIN best USING (stratum)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept,
  array_to_string(list_transform(failed, lambda r: ['short_words', 'long_words', 'symbols', 'repeated_lines', 'repeated_words', 'capitals'][r]), ',') AS failed_rules, n_lines, n_capitals
FROM judged""",
    "op3_suffix_radix": r"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT place, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT place, h, unnest(range(0, n - 199)) AS i FROM d)
), twice AS (
  SELECT place, i FROM (SELECT place, i, count(*) OVER (PARTITION BY k) AS times FROM w) WHERE times > 1
), runs AS (
  SELECT place, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY place ORDER BY i) AS run FROM (SELECT *, (i - coalesce(lag(i) OVER (PARTITION BY place ORDER BY i), -1000) > 200)::INTEGER AS new FROM twice)) GROUP BY place, run
), kept AS (
  SELECT place, sum(b - a) AS removed, count(*) AS n_spans, list(row(a, b) ORDER BY a) AS spans FROM runs GROUP BY place
), parts AS (
  SELECT d.*, coalesce(removed, 0) AS removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN spans IS NULL THEN h ELSE
    array_to_string(list_transform(range(1, len(spans) + 2), lambda k: substr(h, 2 * (CASE WHEN k = 1 THEN 0 ELSE spans[k - 1][2] END) + 1, 2 * (CASE WHEN k > len(spans) THEN n ELSE spans[k][1] END - CASE WHEN k = 1 THEN 0 ELSE spans[k - 1][2] END))), '') END AS left_over
  FROM d LEFT JOIN kept USING (place)
)
SELECT doc_id, n::BIGINT AS n_bytes, removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM parts""",
    "op6_ngram_group_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT place, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS grams FROM d
), g AS (
  SELECT place, len(grams) AS n, unnest(grams) AS gram FROM s
), links AS MATERIALIZED (
  SELECT a.place AS a, b.place AS b FROM g a JOIN g b ON a.gram = b.gram AND a.place <> b.place GROUP BY a.place, b.place, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT place, place AS other FROM s UNION SELECT reach.place, links.b FROM reach JOIN links ON reach.other = links.a
), least AS (
  SELECT reach.place, min(s.doc_id) AS least FROM reach JOIN s ON s.place = reach.other GROUP BY reach.place
)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, least AS component_id FROM s JOIN least USING (place)""",
    "op11_periodic_diagonals": r"""
WITH h AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b:
      list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM documents
), g AS (
  SELECT *, len(w) AS n, h // 10 AS g FROM h
), p AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g
), d AS (
  SELECT place, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p
), x AS (
  SELECT place, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM d
), e AS (
  SELECT a.place, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.place = b.place AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), s AS (
  SELECT place, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY place, q ORDER BY i) AS island FROM e) GROUP BY place, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.place = s.place AND o.q < s.q AND o.s <= s.s AND o.s + o.m >= s.s + s.m)
), f AS (
  SELECT place, count(*) AS n_runs, arg_max(row(s, m, q), row(m, -s, -q)) AS best, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY place
), gone AS (
  SELECT DISTINCT place, unnest(range(s + q, s + m)) AS i FROM r
), k AS (
  SELECT place, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (place, i) GROUP BY place
), c AS (
  SELECT place, count(*) AS n_dropped FROM gone GROUP BY place
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN f USING (place) LEFT JOIN k USING (place) LEFT JOIN c USING (place)""",
}
