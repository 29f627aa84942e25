"""Periodic runs, risk-controlled rules and the filter audit against brute force, with nulls, ties, repeats and clashing columns."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import filter_audit, periodic, quality_rules
from tickloom.llm.queries import QUERIES, _made_periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, prefix string, key string, low long, mask int, stratum string"


def table(spark, rows):
    """Documents of (doc_id, text[, lang]) with further columns of names that the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, "p", "k", 7, 9, "x") for r in rows], SCHEMA)


def plain_runs(c, min_length=6, exponent=4):
    found = []
    for q in range(1, len(c) // exponent + 1):
        i = 0
        while i < len(c) - q:
            j = i
            while j < len(c) - q and c[j] == c[j + q]:
                j += 1
            m = j - i + q
            if j > i and m >= max(min_length, exponent * q) and not any(c[i : i + m - d] == c[i + d : i + m] for d in range(1, q)):
                found.append((i, m, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_all_lags():
    rnd, n = random.Random(1), 0
    for _ in range(1500):
        c = [rnd.randrange(rnd.choice([1, 2, 3, 8])) for _ in range(rnd.randrange(0, 80))]
        for _ in range(rnd.randrange(3)):
            block = [rnd.randrange(4) for _ in range(rnd.randrange(1, 12))]
            at = rnd.randrange(len(c) + 1)
            c[at:at] = (block * 7)[: rnd.randrange(7 * len(block))]
        least, exponent = rnd.choice([(6, 4), (6, 4), (2, 3), (20, 4), (30, 3), (7, 5)])
        want = plain_runs(c, least, exponent)
        assert periodic.find_runs(np.array(c, np.int64), least, exponent) == want
        n += len(want)
    assert n > 1000
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, exponent=2)


def test_runs_in_a_block_without_rare_grams():
    """Every short gram of the period stands in it twice, so that only long seeds show the period."""
    rnd = random.Random(3)
    for order in (5, 6, 8):
        cycle, seen = "0" * order, {"0" * order}  # greedy de Bruijn cycle
        while (turn := next((b for b in "10" if (cycle + b)[-order:] not in seen), None)) is not None:
            cycle += turn
            seen.add(cycle[-order:])
        block = [int(x) for x in cycle[: 2**order]]
        c = [rnd.randrange(2) for _ in range(50)] + block * 5 + [2]
        assert periodic.find_runs(np.array(c, np.int64)) == plain_runs(c)


def test_runs_of_long_texts_take_one_pass_a_level():
    n = 1_000_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n, dtype=np.int64) % 977) == [(0, n, 977)]
    assert periodic.find_runs(np.arange(n, dtype=np.int64)) == []


def test_periodic_table(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 5), (4, "a b " * 5), (None, "x y " * 6), (6, "A a " * 3), (7, "日 本\r\n" * 4 + "é"), (8, "w " * 300_000)]
    got = periodic.periodic_runs(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.n_dropped, r.collapsed))
    assert by[1] == by[2] == by[3] == [(0, [], 0, "")]
    assert by[4] == [(10, [(0, 10, 2)], 8, "a b")] * 2
    assert by[None] == [(6, [(0, 6, 1)], 5, "x y")]  # a no-break space is no white space
    assert by[6] == [(6, [], 0, "A a A a A a")]  # three periods are too few
    assert by[7] == [(9, [(0, 8, 2)], 6, "日 本 é")]
    assert by[8] == [(300_000, [(0, 300_000, 1)], 299_999, "w")]
    assert periodic.periodic_runs(table(spark, [])).count() == 0


def test_periodic_query_rewrites_one_text_in_ten(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    changed = {r.doc_id: r.text for r in _made_periodic(docs).collect()}
    found = {r.doc_id: r for r in QUERIES["op11_periodic_diagonals"](spark, sf).collect()}
    assert set(found) == set(texts)
    for d, text in texts.items():
        words, code = WORD.findall(text or ""), zlib.crc32(str(d).encode())
        n, g = len(words), code // 10
        if code % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert WORD.findall(changed[d] or "") == words
        if n < 1500:
            runs = plain_runs([words.index(w) for w in words])
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
            assert (found[d].n_runs, found[d].start, found[d].length, found[d].period) == (len(runs), *best)


def plain_repeat_words(words):
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_measures(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice("ab") if rnd.random() < 0.5 else f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(0, 40)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n \r"), (103, "# a\n\n# a\n \n# a\n# a"), (None, "a b c " * 30), (105, "日本 é|<>"), (105, "日本 é|<>"), (106, "ab\n" * 100_000)]
    got = defaultdict(list)
    for r in quality_rules.measures(table(spark, rows)).collect():
        got[r.doc_id].append(tuple(r)[3:])
    want = defaultdict(list)
    for d, text, *_ in rows:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        repeats = len(words) if d == 106 else plain_repeat_words(words)
        want[d].append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, len(lines), len(re.findall("[A-Z]", text))))
    assert got == want


def test_windows_whose_hashes_clash_are_compared_by_their_words(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "a", "b", "c"],)], "words array<string>")
    assert rows.select(quality_rules.repeat_words(F.col("words")).alias("n")).first().n == 6
    keyed = F.array(F.struct(F.lit(1).alias("key"), F.lit(0).alias("place")), F.struct(F.lit(2).alias("key"), F.lit(1).alias("place")), F.struct(F.lit(1).alias("key"), F.lit(5).alias("place")))
    assert rows.select(quality_rules._standing_twice(keyed).alias("p")).first().p == [0, 5]


def test_binomial_tail_is_exact(spark):
    cases = [(0, 0), (1, 0), (60, 0), (60, 2), (60, 3), (500, 10), (500, 24), (500, 25), (20_000, 900), (20_000, 999)]
    rows = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.05))
    for n, k, p in rows.collect():
        if k >= n * 0.05:
            assert p == 1
        else:
            chance = Fraction(1, 20)
            want = float(sum(math.comb(n, i) * chance**i * (1 - chance) ** (n - i) for i in range(k + 1))) if n < 1000 else None
            assert want is None or abs(p - want) <= 1e-9 * want
            assert 0 < p < 1


def labelled(spark, good, bad, lang="en"):
    """Texts of plain words, good ones; bad ones full of symbols."""
    rnd = random.Random(11)
    text = lambda mark: " ".join("".join(rnd.choice("aeioustrn") for _ in range(rnd.randrange(3, 8))) + mark for _ in range(60))
    rows = [(k, text("a"), lang) for k in range(good)] + [(10_000 + k, text("#"), lang) for k in range(bad)]
    return rows, [(d, int(d < 10_000), 0) for d, *_ in rows]


def rules_of(spark, rows, labels, **kw):
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return quality_rules.quality_rules(table(spark, rows), labels, **kw)


def test_rules_need_enough_holdouts(spark):
    """With 60 good holdouts 5 % can't be proven, with some 400 it can; a stratum without labels has the base rules alone."""
    few, few_labels = labelled(spark, 60, 20, "fr")
    many, many_labels = labelled(spark, 800, 40, "en")
    shift = lambda rows: [(r[0] + 50_000, *r[1:]) for r in rows]
    rows = many + shift(few) + [(90_000, many[-1][1], None), (90_001, None, "en"), (90_002, "", "en"), (90_003, many[-1][1], "en"), (90_003, many[-1][1], "en"), (None, many[0][1], "en")]
    got = {(r.doc_id, r.kept, r.base_failed, tuple(r.failed_rules)) for r in rules_of(spark, rows, many_labels + shift(few_labels) + [(None, 1, 0)]).collect()}
    for d, *_ in many:
        assert (d, d < 10_000, False, () if d < 10_000 else ("symbols",)) in got
    assert all((d, True, False, ()) in got for d, *_ in shift(few))
    assert {(90_000, True, False, ()), (90_001, False, True, ()), (90_002, False, True, ()), (90_003, False, False, ("symbols",)), (None, True, False, ())} <= got
    assert rules_of(spark, [], many_labels).count() == 0
    assert {r.kept for r in rules_of(spark, many, []).collect()} == {True}


def test_copies_are_one_draw(spark):
    """One good text two thousand times proves nothing."""
    rows, labels = labelled(spark, 1, 30)
    rows += [(20_000 + k, rows[0][1], "en") for k in range(2000)]
    labels += [(20_000 + k, 1, 0) for k in range(2000)]
    assert all(r.kept for r in rules_of(spark, rows, labels).collect())


def test_a_rule_that_would_reject_good_texts_is_not_admitted(spark):
    """Good texts with as many symbols as bad ones: no cutoff between them, so they stay."""
    rows, labels = labelled(spark, 600, 600)
    flip = {d: 1 if d >= 10_000 and d % 2 else q for d, q, _ in labels}
    got = rules_of(spark, rows, [(d, q, 0) for d, q in flip.items()]).collect()
    good = [r for r in got if flip[r.doc_id] == 1]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)


def test_the_guarantee_holds_over_many_draws(spark):
    """Strata drawn from one law, whose rule rejects a known share: those with a true share above alpha are hardly ever admitted."""
    rnd, alpha, delta = random.Random(2), 0.05, 0.05
    rows = []
    for s in range(200):
        share = 0.08 if s % 2 else 0.0
        for k in range(400):
            good = k < 300
            value = 1.0 if not good or rnd.random() < share else 0.0
            rows.append((f"{s:03}", good, [value], rnd.random() < 0.5, k))
    # thresholds() from measured texts: symbols per word are the value
    measured = spark.createDataFrame(
        [(k + 1000 * i, s, f"{i:06}" + ("0" if p else "1"), 100, 500, int(v[0] * 100), 0, 0, 10, 0, g) for i, (s, g, v, p, k) in enumerate(rows)],
        "doc_id long, stratum string, key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, good boolean",
    )
    labels = measured.select("doc_id", F.col("good").cast("int").alias("quality"))
    admitted = quality_rules.thresholds(measured.drop("good"), labels, alpha, delta * 200, tolerances=(0.9,)).collect()  # delta for each stratum
    wrong = sum(int(r.stratum) % 2 for r in admitted)
    assert len(admitted) - wrong == 100 and wrong <= 12


def plain_audit(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    marks = defaultdict(set)
    for d, q, x in labels:
        marks[d] |= ({"good"} if q == 1 else set()) | ({"toxic"} if x == 1 else set())
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {c for c, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > first[t])) if x}
        docs.append((lang or "", fails, marks.get(d, set()) if d is not None else set()))
    out = {}
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        removed_over = Counter()
        for order in itertools.permutations("ABCDE"):
            for _, fails, _ in mine:
                removed_over[next((c for c in order if c in fails), None)] += 1
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                own, earlier = order[step - 1], set(order[: step - 1])
                gone = [x for x in mine if own in x[1] and not x[1] & earlier]
                out[part, "".join(order), step] = (
                    sum(not x[1] & (earlier | {own}) for x in mine), len(gone), sum(own in x[1] and bool(x[1] & earlier) for x in mine), sum(x[1] == {own} for x in mine),
                    sum("good" in x[2] for x in gone), sum("toxic" in x[2] for x in gone), removed_over[own],
                )
    return out


@pytest.fixture(scope="module")
def audited():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["A#", "BB", "é"]
    base = [" ".join(rnd.choice(words[: rnd.choice([20, 303])]) for _ in range(rnd.choice([10, 210, 260]))) for _ in range(25)]
    shared = "the same long beginning " * 60
    base += [shared, shared + "x", shared + "y", shared[:-1], shared + "x" * 3000, shared + "x" * 3000 + "z", "", "日本語", "日本"]
    rows = [(rnd.randrange(400), rnd.choice(base), rnd.choice(["en", "de", None, ""])) for _ in range(300)]
    rows += [(k + 1000, base[0], "en") for k in range(150)] + rows[:5] + [(None, base[0], "en"), (None, "alone", "xx"), (5, None, "de")]
    labels = [(rnd.randrange(400), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    return rows, labels


def test_trie_holds_texts_and_least_ids():
    rnd = random.Random(7)
    for _ in range(200):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 9))).encode() for _ in range(rnd.randrange(0, 40))]
        trie, want = filter_audit.Trie(), {}
        for k, t in enumerate(texts):
            k = (k * 7) % 41
            trie.insert(t, k, k)
            low, high = want.get(t, (k, k))
            want[t] = (min(low, k), max(high, k))
        assert [(t, x[:2]) for t, x in trie.items()] == sorted(want.items())
        assert sorted(x[:2] for x in trie.terminals()) == sorted(want.values())
        labels, todo = [], [trie.root]
        while todo:  # compressed: but for the root, a node without a terminal forks
            node = todo.pop()
            labels.append(len(node[0]))
            assert node is trie.root or node[2] is not None or len(node[1]) > 1
            todo += (node[1] or {}).values()
        assert sum(labels) <= trie.held


def test_prefixes_of_all_lengths_are_counted_at_once(spark):
    """As many joins as lengths at which a prefix holds too much, none for the counts: passes over the texts don't add up."""
    rows = [(b"x" * 5000 + bytes([k]) * 9,) for k in range(40)] + [(b"x" * 70 + bytes([k]) * 9,) for k in range(40)]
    texts, made = spark.createDataFrame(rows, "text binary"), []
    kept = filter_audit.Scratch.keep
    try:
        filter_audit.Scratch.keep = lambda self, df: (made.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(self, df))[1]
        got = {(bytes(r.text), len(r.prefix)) for r in filter_audit.by_prefix(texts, 4, class_bytes=5000).collect()}
    finally:
        filter_audit.Scratch.keep = kept
    assert len(made) == 1 and "Join" not in made[0]
    assert got == {(t, len(t)) for (t,) in rows}  # up to 512 and 32,768 bytes, where they end


def test_prefixes_grow_where_texts_are_many(spark, audited):
    rows, _ = audited
    texts = table(spark, rows).select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).where("text IS NOT NULL")
    got = [(bytes(r.text), bytes(r.prefix)) for r in filter_audit.by_prefix(texts, 4, class_bytes=5000).collect()]
    assert len(got) == len(rows) and all(t.startswith(p) for t, p in got)
    held, of = Counter(), defaultdict(set)
    for t, p in got:
        of[t].add(p)
    for t in of:
        held[next(iter(of[t]))] += len(t) * sum(x[0] == t for x in got)
    assert all(len(x) == 1 for x in of.values())
    kinds = defaultdict(set)
    for t, p in got:
        kinds[p].add(t)
    assert all(n <= 5000 or len(kinds[p]) == 1 for p, n in held.items())
    assert any(len(p) > 1000 for _, p in got) and any(len(p) < len(t) for t, p in got)


@pytest.mark.parametrize("held, class_bytes", [(filter_audit.HELD_BYTES, None), (2000, 3000)])
def test_audit(spark, audited, held, class_bytes, monkeypatch):
    rows, labels = audited
    full = filter_audit.repeated_texts
    monkeypatch.setattr(filter_audit, "repeated_texts", lambda docs: full(docs, held, class_bytes))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    got = filter_audit.interactions(filter_audit.masks(table(spark, rows)).join(marks, "doc_id", "left")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(rows, labels) and len(got) == 600 * 4


def test_audit_of_an_empty_table(spark):
    rows = filter_audit.masks(table(spark, [])).withColumns({"good": F.lit(True), "toxic": F.lit(True)})
    assert filter_audit.interactions(rows).count() == 0
    with pytest.raises(ValueError):
        filter_audit.interactions(rows, "ABCDEFGH")


def test_audit_of_very_long_texts(spark):
    long = "many words of one text " * 200_000
    rows = [(k, long + "x" * (k % 2), "en") for k in range(6)]
    got = {(r.doc_id, r.mask) for r in filter_audit.masks(table(spark, rows)).collect()}
    assert got == {(k, 2 + 16 * (k > 1)) for k in range(6)}
