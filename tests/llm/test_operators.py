"""Corpus operators against brute force on small fixtures with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bpe, line_dedup, mixing, ngram_join, quality, secrets, suffix_dedup, topk, warc
from tickloom.llm.exact_dedup import chunk_id, chunks, exact_dedup, keep_first
from tickloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, id long"


def table(spark, rows):
    """Documents of (doc_id, text[, source]) with two columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "k", 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(200)] + ["é", "Été", "日本語"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 120))) for _ in range(8)]
    rows = []
    for k in range(120):
        t = rnd.choice(base).split(" ")
        for _ in range(rnd.randrange(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        t = (" " if k % 3 else "\n").join(t)
        rows.append((k, t if k % 17 else (None, "", "  \n\t")[k % 3], rnd.choice(["a", "b", "ä", None])))
    rows.append((200, " ".join(rnd.choice(words) for _ in range(30_000)), "a"))
    return rows + rows[:3] + [(None, base[0], "b")]


def test_empty_tables(spark):
    docs = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (exact_dedup(docs), keep_first(docs), mixing.mix(docs), mixing.mixed_documents(docs), secrets.scan(docs), suffix_dedup.suffix_dedup(docs), ngram_join.ngram_join(docs), line_dedup.line_dedup(docs), bpe.encode(docs, tokenizer_path()), quality.score(docs, labels)):
        assert df.count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_exact_dedup(spark, corpus):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = corpus + [(7001, "a b"), (7001, "ab"), (7001, "a\tb"), (7002, "ab"), (7002, "ab"), (7003, "漢字" * 9000), (7004, " " + "漢字" * 9000), (7005, "Привет, мир 12345 " * 3000)]
    groups = defaultdict(list)
    for k, (d, t, *_) in enumerate(rows):
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, hashlib.sha256((t or "").encode()).digest(), k))
    first = {n: min(g)[4] for n, g in groups.items()}
    want = sorted(((d, rows[first[norm(t)]][0], len(groups[norm(t)]), k == first[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for k, (d, t, *_) in enumerate(rows)), key=str)
    assert sorted(map(tuple, exact_dedup(table(spark, rows)).collect()), key=str) == want
    kept = keep_first(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([rows[k][:2] for k in first.values()], key=str)


def test_chunks_follow_the_content(spark):
    """An inserted character leaves most chunks of a long text as they are, whatever its script."""
    rnd = random.Random(9)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "0123456789", "的一是不了在人有我他这中大来上"]
    texts = ["".join(rnd.choice(s) for _ in range(60_000)) for s in scripts]
    rows = spark.createDataFrame([(k, t, t[:100] + "+" + t[100:]) for k, t in enumerate(texts)], "k int, a string, b string")
    for r in rows.select(chunks(F.col("a")).alias("a"), chunks(F.col("b")).alias("b")).collect():
        assert len(r.a) > 20 and len(set(r.a) & set(r.b)) > 0.8 * len(set(r.a))


def test_colliding_chunk_ids_take_the_next_seed(spark):
    weak = lambda c, seed: chunk_id(c, seed) if seed else F.length(c).cast("long")
    docs = table(spark, [(1, "abc"), (2, "abd"), (3, "a b c")])
    assert [(r.doc_id, r.group_size) for r in exact_dedup(docs, weak).orderBy("doc_id").collect()] == [(1, 2), (2, 1), (3, 2)]


def test_mix(spark, corpus):
    rows = mixing.mix(table(spark, corpus)).collect()
    size = Counter()
    for _, t, s in corpus:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, budget, full = {}, 1.5 * sum(size.values()), set()
    while True:  # hand out by weight, cap, hand out the excess again
        rest = budget - sum(2 * size[s] for s in full)
        share = {s: weight[s] * rest / sum(weight[x] for x in size if x not in full) for s in size if s not in full}
        over = {s for s in share if share[s] >= 2 * size[s]}
        target = {s: 2 * size[s] for s in full} | share
        if not over:
            break
        full |= over
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
    assert all(taken[s] == int(target[s]) for s in size)
    positions = [r.first_position for r in rows if r.taken]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(table(spark, corpus)).collect()))
    copies = Counter(r.doc_id for r in mixing.mixed_documents(table(spark, corpus)).collect())
    repeated = Counter(d for d, *_ in corpus)
    assert all(n <= 2 * repeated[d] for d, n in copies.items())


def test_secrets_base_is_that_of_plain_expressions():
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    rnd, found = random.Random(1), secrets.automaton()
    parts = ["password", "PassWd", "api_key", "token", '"', " ", ":", "=", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "ſ", "K", "\n", "abcdefgh1234"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30)))
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [s for s in secrets.find_spans(t, found) if s[1] < 3] == sorted(want)


def test_secrets_with_checksums(spark):
    body = "abcdefghijklmnopqrstuvwxyzABCD"
    good, bad = f"ghp_{body}{secrets.checksum62(body)}", f"ghp_{body}000000"
    rows = secrets.scan(table(spark, [(1, f"x {good}"), (2, f"x {bad}"), (3, None)])).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["github:2:42", "", ""]


def test_secrets_of_hostile_texts(spark):
    """Deep JSON, runs without an end and long texts beyond ASCII: whole results in linear time."""
    head = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    deep, fine = head(b"{\"a\":" + b"[" * 200_000), head(b'{"alg":"x"}')
    rows = [(1, f"{deep}.a.b {fine}.a.b"), (2, "eyJ" * 400_000), (3, ("é" + "0123456789abcdef" * 2 + " ") * 30_000), (4, "password=" + "x" * 1_000_000), (None, "Token: abcdefgh"), (5, None)]
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan(table(spark, rows + rows[4:5])).collect()}
    assert time.time() - began < 60
    start = len(deep) + 5
    assert got[1].spans == f"jwt:{start}:{start + len(fine) + 4}" and got[2].spans == "" and got[5].spans == ""
    assert (got[3].n_hex, got[3].n_assign) == (30_000, 0)
    assert got[3].base_sha256 == hashlib.sha256(",".join(f"hex:{34 * k + 1}:{34 * k + 33}" for k in range(30_000)).encode()).hexdigest()
    assert (got[4].n_assign, got[4].spans) == (1, "assign:0:1000009")
    assert (got[None].n_assign, got[None].base_sha256) == (1, hashlib.sha256(b"assign:0:15").hexdigest())


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://x/{k} \r\n", "<p>" + "long text " * 20 + str(k // 4)) for k in range(400)] + [(900, None, "short"), (901, "u", "short"), (902, "u", None), (None, "u", "y" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write(pages)
    warc.export(archives, str(tmp_path))
    for found in (warc.read(archives), warc.load(spark, str(tmp_path))):
        by_id = {r.page_id: r for r in found.collect()}
        assert len(by_id) == len(rows)
        for d, _, html in rows:
            raw, r = (html or "").encode(), by_id[d]
            first = d // 4 * 4 if d is not None and d < 400 else d
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            assert (r.record_type, r.refers_to) == (("response", None) if d == first else ("revisit", first))
            assert r.payload is None or bytes(r.payload) == raw


def test_warc_names_a_damaged_record():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parsed(raw)["payload"] == b"payload"
    for broken in (raw.replace(b"payload", b"Payload"), raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9")):
        with pytest.raises(ValueError):
            warc.parsed(broken)


def test_topk(spark):
    """Against all rows by brute force; rows that repeat, and rows under one vec_id with unlike vectors, count each."""
    rnd = np.random.default_rng(3)
    vectors = [(int(k), [float(x) for x in v]) for k, v in enumerate(rnd.normal(size=(700, 6)).round(1))]
    vectors += vectors[:2] + vectors[50:51] * 7 + [(100, vectors[300][1]), (100, vectors[7][1]), (3, [9.0] * 6), (3, [9.0] * 6)]
    odd = [(5000, None), (5050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5100, [float("nan")] * 6), (None, [0.0] * 6)]
    ints = np.floor(np.array([v for _, v in vectors]) * 256).astype(int)
    want = []
    for at, (q, _) in enumerate(vectors):
        if q % 50 == 0:
            best = sorted((-int(s), vectors[j][0]) for j, s in enumerate(ints @ ints[at]) if j != at)[:5]
            want += [(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)]
    rows = topk.search(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, rows)) == sorted(want)
    assert len(want) == 5 * (14 + 1 + 7 + 2)


def test_mix_of_sources_without_words(spark):
    rows = [(1, "a b c", "x"), (2, None, "y"), (3, " ", "y"), (4, "d " * 50_000, None), (5, "", "z")]
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(table(spark, rows)).collect()}
    assert got[2] == got[3] == got[5] == (0, 0, 0.0, 0) and got[1][:2] == (3, 3) and got[4][:2] == (50_000, 50_000) and got[1][3] == 6


def test_warc_of_long_payloads_and_further_columns(spark):
    pages = [(1, "http://a/", "x" * 3_000_000), (2, None, "x" * 3_000_000), (3, "http://b/", None), (None, "http://c/", "é" * 70), (4, "http://d/", "é" * 70), (5, "http://e/", "short"), (6, "http://f/", "short")]
    frame = spark.createDataFrame([(*p, "n", 7) for p in pages], "page_id long, url string, html string, payload string, n_records int")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(frame)).collect()}
    assert got == {1: (3_000_000, "response", None), 2: (3_000_000, "revisit", 1), 3: (0, "response", None), None: (140, "revisit", 4), 4: (140, "response", None), 5: (5, "response", None), 6: (5, "response", None)}


def test_rows_are_repeated_in_blocks(spark):
    rows = topk.repeated(spark.createDataFrame([(1, 3), (2, 1), (3, (1 << 16) + 1)], "k long, n long"), "n").groupBy("k").count().collect()
    assert sorted(map(tuple, rows)) == [(1, 3), (2, 1), (3, (1 << 16) + 1)]


def test_topk_of_large_numbers(spark):
    """Scores beyond what floats hold, and beyond a long."""
    vectors = [(0, [2.0**40, 2.0**40 + 5 / 256]), (1, [1.0 + 1 / 256, 3 / 256]), (2, [1.0, 3 / 256]), (3, [2.0**40, 1 / 256]), (4, [1e300, 0.0]), (5, [2.0**44, 1.0])]
    frame = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, score string")
    ints = {k: [max(-(2**62), min(2**62, int(x * 256) if abs(x) < 1e15 else 2**62)) for x in v] for k, v in vectors}
    want = sorted(((-min(sum(a * b for a, b in zip(ints[0], v)), 2**63 - 1), k) for k, v in ints.items() if k))
    got = [(r.vec_id, r.score) for r in topk.search(frame).orderBy("rank").collect()]
    assert got == [(k, -s) for s, k in want]


def test_bounds_hold_where_products_cancel():
    """Large components, queries nearly orthogonal to every row, tied rows: the tree's answers are those of whole numbers."""
    rnd = np.random.default_rng(6)
    for low, high in [(8, 12), (24, 28), (28, 30), (45, 50), (58, 61)] * 8:
        query = rnd.integers(2**low, 2**high, 8)
        rows = rnd.integers(2**low, 2**high, (300, 8)) * rnd.choice([-1, 1], (300, 8))
        rows[:, -1] = [-sum(int(a) * int(b) for a, b in zip(r[:-1], query[:-1])) // int(query[-1]) % 2**61 for r in rows]
        rows = np.concatenate([rows, rows[:100], rows[:100]])
        exact = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, query)))) for r in rows]
        tree = topk.BallTree(rows)
        found = tree.best(query, tree.upper_bounds(query[None].astype(float))[0], np.arange(len(rows)), np.ones(len(rows), int), -1, 5, -np.inf)
        assert sorted((-s, -i) for s, i in found) == sorted((-s, i) for i, s in enumerate(exact))[:5]


def test_topk_of_mixed_and_empty_vectors(spark):
    """Only vectors of the query's length are candidates; those without components score 0."""
    vectors = [(0, []), (50, []), (7, []), (100, [1.0]), (8, [-2.0]), (9, [0.5]), (150, [1.0, 1.0])]
    rows = topk.search(spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, rank int")).collect()
    want = [(0, 1, 7, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 7, 0), (100, 1, 9, 256 * 128), (100, 2, 8, -256 * 512)]
    assert sorted(map(tuple, rows)) == want


def test_suffix_dedup_of_a_periodic_text(spark):
    rows = [(1, "ab" * 1_000_000), (None, "x" * 500), (3, "y" * 199), (4, "z" * 200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect()}
    assert got == {1: (2_000_000, 2_000_000, 1), None: (500, 500, 1), 3: (199, 0, 0), 4: (200, 0, 0)}


def test_ngram_join(spark, corpus):
    sets = []
    for _, t, _ in corpus:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    roots = list(range(len(sets)))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                roots[root(i)] = root(j)
    low = {}
    for k, (d, *_) in enumerate(corpus):
        low[root(k)] = min(low.get(root(k), 1 << 60), 1 << 60 if d is None else d)
    want = sorted(((d, len(sets[k]), None if low[root(k)] == 1 << 60 else low[root(k)]) for k, (d, *_) in enumerate(corpus)), key=str)
    assert sorted(map(tuple, ngram_join.ngram_join(table(spark, corpus)).collect()), key=str) == want


def test_ngram_join_tells_a_pair_once(spark, monkeypatch):
    """Large unlike texts that share a passage: what the hubs leave open is told once a pair, not once a gram or list."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(300)]
    text = lambda k, n: " ".join([f"{k}x{rnd.randrange(10**6)}" for _ in range(n)] + passage)
    rows = [(k, text(k, 3_000 + 40 * k)) for k in range(9)]
    rows.append((9, rows[4][1] + " end"))
    told, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: (told.append([tuple(sorted(map(bytes, r))) for r in pairs.collect()]), verified(pairs, *rest))[1])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark, rows)).collect()}
    assert got == {k: 4 if k == 9 else k for k in range(10)}
    assert len(set(told[-1])) > 20
    assert len(told[-1]) == len(set(told[-1]))


def test_ngram_join_moves_only_texts_to_verify(spark, monkeypatch):
    """However many sets are to be verified, so that their ids can't be broadcast, other texts stay where they are."""
    rnd = random.Random(9)
    rows = [(k, " ".join(f"{rnd.randrange(10**9)}" for _ in range(2_000))) for k in range(60)]
    rows += [(60 + k, rows[k][1] + " end") for k in range(3)]
    moved, keep = [], ngram_join.Scratch.keep

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    def measured(scratch, df):
        before = shuffled() if df.columns == ["sid", "packed"] else None
        out = keep(scratch, df)
        if before is not None:
            moved.append((out.count(), shuffled() - before))
        return out

    monkeypatch.setattr(ngram_join.Scratch, "keep", measured)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {k: k % 60 for k in range(63)}
    assert sum(n for n, _ in moved) >= 6
    assert max(size for _, size in moved) < 10 * 2_000 * 10


def test_keep_one_goes_by_doc_id_and_text(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    near = lambda k: text(k) + " end"
    stay = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (5, text("e")), (6, text("f")), (None, ""), (8, None)]
    go = [(6, near("e")), (None, near("e")), (1, text("a")), (None, text("c")), (None, "")]
    either = [(None, text("g")), (None, near("g"))]
    docs = table(spark, stay + go + either)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    rest = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    assert [r for r in rest if r not in either] == sorted(stay, key=str)
    assert len(rest) == len(stay) + 1


def test_suffix_dedup(spark, monkeypatch):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(700)) for _ in range(4)]
    rows = []
    for k in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice("xyzé")
        t = "".join(t)[rnd.randrange(0, 300) :]
        rows.append((k, None if k % 23 == 0 else "a" * rnd.randrange(150, 900) if k % 17 == 0 else t + t if k % 10 == 0 else t))
    rows += rows[:3]
    seen = Counter(r[i : i + 200] for r in ((t or "").encode() for _, t in rows) for i in range(len(r) - 199))
    want = []
    for d, t in rows:
        r = (t or "").encode()
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(r, gone) if not g)
        want.append((d, len(r), len(r) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    for rows_per_group in (200_000, 3):
        monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", rows_per_group)
        assert sorted(map(tuple, suffix_dedup.suffix_dedup(table(spark, rows)).drop("kept", "spans").collect())) == sorted(want)


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = corpus + [(300, "Hello<|endoftext|> İstanbul's don't 12,5 \x0b\x1c x " * 40), (301, "x" * 20_000), (302, "漢字かな交じり文、" * 120_000), (303, "a1-" * 5000 + "\t" + "Y̊H̱ " * 400 + "T̈" * 900)]
    encoded = bpe.encode(table(spark, rows), tokenizer_path(), with_ids=True)
    got = {r.doc_id: r for r in encoded.collect()}
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, tokenizer_path()).collect()}
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[d].ids, "<u4").tolist() == ids and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert decoded[d] == library.decode(ids, skip_special_tokens=False)
        assert got[d].decoded_sha256 == hashlib.sha256(decoded[d].encode()).hexdigest()


def test_bpe_joins_cut_inside_words(monkeypatch):
    monkeypatch.setattr(bpe, "MIN_CHUNK", 3)
    monkeypatch.setattr(bpe, "MAX_CHUNK", 9)
    monkeypatch.setattr(bpe, "CUT_BITS", 2)
    encoder, rnd = bpe.Encoder(tokenizer_path()), random.Random(2)
    parts = ["Hello", "wörld", "é", " ", "\n", "\x1c", "'s", "<|endoftext|>", "12", "!!", "Σ", "İ", "日本語", "\U0001f600", "|>", "\t", *"HTJYW", *map(chr, range(0x300, 0x370, 5)), "H\u0331", "T\u0308", "J\u030c", "Y\u030a"]
    monkeypatch.setattr(bpe, "LONG_STRETCH", 25)
    for _ in range(2500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40)))
        ids = encoder.assemble(t.encode(), bpe.cuts(t.encode()), {})
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc"), (4, "q\nq\nq\nq"), (5, None), (None, "a\nb\nc"), (2, "x\na\nb\nc\ny")]
    got = sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in line_dedup.line_dedup(table(spark, rows)).collect())
    assert got == [("1", 0, "a\nb\nc\nd"), ("2", 3, "x\ny"), ("2", 3, "x\ny"), ("3", 0, "b\nc"), ("4", 3, "q"), ("5", 0, ""), ("None", 3, "")]


def test_line_dedup_is_that_of_all_windows(spark):
    rnd = random.Random(6)
    rows = [(k if k % 7 else None, "\n".join(rnd.choice("abcd") * rnd.choice([1, 1, 30]) for _ in range(rnd.randrange(1, 30)))) for k in range(60)]
    rows += [(100, "\n".join("xy"[k % 2] for k in range(5000))), (101, ""), (102, None)] + rows[:4]
    spark.sparkContext.setLogLevel("ERROR")
    for min_words in (None, 2):
        docs = table(spark, [(d, None if t is None else t.replace("a" * 30, "a b")) for d, t in rows])
        key = {t: r for t, r in docs.select("text", F.xxhash64("text")).collect()}
        each = sorted({(d is None, d or 0, key[t], t or "") for d, t, *_ in docs.collect()})
        first, gone = {}, {}
        for none, d, _, t in each:
            lines = t.split("\n")
            for n in (1, 2, 3):
                for k in range(len(lines) - n + 1):
                    run = tuple(lines[k : k + n])
                    if n == 3 or min_words and sum(len(x.split()) for x in run) >= min_words:
                        if first.setdefault(run, (none, d, t, k)) != (none, d, t, k):
                            gone.setdefault((none, d, t), set()).update(range(k, k + n))
        want = sorted((str(d), len((t or "").split("\n")), "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get((d is None, d or 0, t or ""), ()))) for d, t, *_ in docs.collect())
        assert sorted((str(r.doc_id), r.n_lines, r.kept_text) for r in line_dedup.line_dedup(docs, min_words=min_words).collect()) == want


def test_line_dedup_by_words(spark):
    line = lambda k, n: " ".join([k] * n)
    long, half, rest, short = line("l", 50), line("h", 30), line("r", 20), line("s", 49)
    rows = [(1, f"{long}\na\n{half}\n{rest}\nb\n{short}"), (2, long), (3, f"x\n{half}\n{rest}\ny"), (4, f"{half}\nz"), (5, short), (6, long), (7, f"{long}\na"), (None, f"{half}\n{rest}")]
    got = sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in line_dedup.line_dedup(table(spark, rows)).collect())
    assert got == [("1", 0, rows[0][1]), ("2", 1, ""), ("3", 2, "x\ny"), ("4", 0, f"{half}\nz"), ("5", 0, short), ("6", 1, ""), ("7", 2, ""), ("None", 2, "")]


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95
    assert (rows[rows["quality"] == 1]["predicted"] == 1).mean() > 0.98


def test_quality_of_odd_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score(table(spark, [(1, None), (None, "x"), (2, "")]), labels).collect()
    assert all(r.score == 0.5 and r.predicted == 1 for r in rows)


def test_quality_counts_all_documents(spark, monkeypatch):
    """Edges, mean slopes and the threshold are those of all documents however small the sample; a repeated doc_id is one row of it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 300)
    found = quality.described(docs.union(docs.where("doc_id % 5 = 1")))
    edges, weights = quality.train(found, labels)
    known = found.where("not held_out").select("row", "grams").toArrow().combine_chunks()
    rows = np.array(known.column("row").to_pylist())
    exact = np.quantile(rows, np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0, method="inverted_cdf").T
    assert (edges <= exact).all() and (edges >= exact * (1 - 1 / 1000)).all()
    every = quality.design(known.to_batches()[0], edges)
    mean, loss = quality.means_over(found.where("not held_out"), edges, weights)
    assert np.allclose(mean, every.T @ quality.sigmoid(every @ weights) / len(every)) and np.isclose(loss, np.logaddexp(0, every @ weights).mean())
    trusted = labels.where("quality = 1").count() / labels.count()
    assert abs((every @ weights >= np.log(quality.THRESHOLD / (1 - quality.THRESHOLD))).mean() - trusted) < 0.08
    assert quality.sampled(found, docs.where("doc_id < 50").select("doc_id")).num_rows == docs.where("doc_id < 50").count()


def test_quality_risk_and_slope_against_plain_loops():
    rnd = np.random.default_rng(5)
    positive, unlabelled, weights = rnd.normal(size=(40, 4)), rnd.normal(size=(70, 4)), rnd.normal(size=4)
    positive[:, -1] = unlabelled[:, -1] = 1
    loss = lambda z: np.log(1 + np.exp(-z))

    def plain(w, prior, part):
        as_positive = sum(loss(x @ w) for x in positive) / 40
        as_negative = sum(loss(-(x @ w)) for x in unlabelled) / 70 - prior * sum(loss(-(x @ w)) for x in positive) / 40
        return prior * as_positive + part * as_negative + quality.SHRINK / 2 * sum(w[:-1] ** 2)

    for prior, part in ((0.3, 1.0), (0.8, 0.4)):
        assert np.isclose(quality.risk(positive, unlabelled, weights, prior, part), plain(weights, prior, part))
        mean = unlabelled.T @ quality.sigmoid(unlabelled @ weights) / 70
        moved = [(plain(weights + 1e-6 * e, prior, part) - plain(weights - 1e-6 * e, prior, part)) / 2e-6 for e in np.eye(4)]
        assert np.allclose(quality.slope(positive, mean, weights, prior, part), moved, atol=1e-6)
        best = quality.fit(positive, unlabelled, prior, part)
        assert all(plain(best, prior, part) <= plain(best + d, prior, part) + 1e-9 for d in rnd.normal(size=(50, 4)) * 0.1)
    apart = positive + np.array([2.5, 0, 0, 0])
    large = np.concatenate([apart[::2] + 0.1, unlabelled[:8]])  # more alike than chance lets a sample be: the risk of negatives is clamped
    clamped, part = quality.fit_clamped(apart, large, 0.8)
    assert part < 1 and 0 <= quality.negative_risk(apart, large, clamped, 0.8) < 0.05


@pytest.mark.filterwarnings("ignore:the classifier's weights still moved")
def test_a_misleading_sample_changes_nothing():
    """Risk and part are those of all documents, whatever small or lopsided sample gives the first weights."""
    rnd = np.random.default_rng(9)
    one = lambda rows: np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
    positive = one(rnd.normal(1.5, 1, (300, 3)))
    for prior, shift in ((0.8, 0.3), (0.4, 0.0), (0.7, 0.6)):
        everyone = one(np.where(rnd.random((5000, 1)) < prior, rnd.normal(1.5 + shift, 1, (5000, 3)), rnd.normal(-1.5, 1, (5000, 3))))
        over = lambda w: (everyone.T @ quality.sigmoid(everyone @ w) / 5000, float(np.logaddexp(0, everyone @ w).mean()))
        want, part = quality.fit_clamped(positive, everyone, prior)
        for sample in (everyone[everyone[:, 0] < -1][:200], everyone[everyone[:, 0] > 2][:50], everyone[:40]):
            seen = quality.Everyone(positive, sample, prior, over)
            got, found = seen.clamped(*quality.fit_clamped(positive, sample, prior))
            cost = [quality.risk(positive, everyone, w, prior, 0.0) + max(0.0, quality.negative_risk(positive, everyone, w, prior)) for w in (got, want)]
            assert abs(found - part) < 0.05 and abs(cost[0] - cost[1]) < 0.005, (prior, part, found, cost)
            assert found == 1.0 or abs(seen.negative(got, over(got)[1])) <= quality.NEAR_ZERO


def test_quality_scores_odd_texts_by_a_model(spark):
    """Null and empty texts, a very long one and repeated rows, scored by a model that labels gave."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (None, "x"), (9004, "word " * 400_000), (9005, "a b"), (9005, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(r.doc_id, 1, 0) for r in docs.where("doc_id % 3 = 0").collect()] + [(9001, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs.select("doc_id", "text").union(odd), labels).collect()
    assert len(rows) == docs.count() + 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= quality.THRESHOLD) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[9001] == by[9002] and len(by[9005]) == 1 and len(set(map(tuple, by.values()))) > 10


def test_quality_prior_is_found():
    rnd = np.random.default_rng(6)
    for prior in (0.2, 0.5, 0.85):
        positive = rnd.normal(3, 1, 4000)
        mixed = np.sort(np.where(rnd.random(60_000) < prior, rnd.normal(3, 1, 60_000), rnd.normal(-1, 1, 60_000)))
        assert abs(quality.prior_of(positive, mixed, np.ones(len(mixed), int)) - prior) < 0.03
