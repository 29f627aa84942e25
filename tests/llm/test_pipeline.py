"""The pipeline's stages on a small fixture: each one's decisions against plain Python."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tickloom.llm import quality


def words(t):
    return (t or "").encode().lower().split()


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names, name
    before = spark.read.parquet(f"{sf}/documents.parquet")
    predicted = {r.doc_id: r.predicted for r in quality.score(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in kept[0]} == {d for d, p in predicted.items() if p}
    first = {}
    for r in kept[0]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        first[key] = min(first.get(key, (0, 1 << 60)), (-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in kept[1]} == {d for _, d in first.values()}
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := words(r.text)) >= 5 else {tuple(w)} if w else set() for r in kept[1]}
    ids = {r.doc_id for r in kept[2]}
    similar = lambda a, b: a and 100 * len(a & b) >= 75 * len(a | b)
    assert not any(similar(sets[a], sets[b]) for a in ids for b in ids if a < b)
    assert all(any(similar(sets[d], sets[x]) for x in sets if x < d) for d in set(sets) - ids)
    copies = Counter(r.doc_id for r in kept[3])
    assert set(copies) <= ids and max(copies.values()) <= 2
    total = sum(len(words(r.text)) for r in kept[2])
    assert abs(sum(len(words(r.text)) for r in kept[3]) - 1.5 * total) < 0.3 * total
    assert len(kept[4]) == len(kept[3])


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, _key string, class int, score double, at int, digest string, prefix int"


def odd_rows():
    base = [" ".join(f"w{(7 * k + j * j) % 97}" for j in range(40 + k)) for k in range(12)]
    rows = [(k, base[k % 12], "en", ("a", "b", None)[k % 3]) for k in range(24)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t", "en", "b"), (None, base[0], "en", "a"), (None, None, None, None), (103, base[1] + " tail", "en", "é")]
    rows += [rows[3]] * 3 + [(104, "word " * 30_000, "en", "a")]
    return [(d, t, lang, s, len(t or ""), 1, "k", 2, 0.5, 3, "d", 4) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables with labels; documents are given to the stages themselves."""
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(d, 1, 0) for d in range(0, 24, 2)] + [(1, None, None), (None, 1, 0), (4, 1, 1), (4, 1, 0), (100, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, folder, k):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as those inside."""
    name, stage = corpus_pipeline.STAGES[k]
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = stage(spark, docs, folder).collect()
    if k < 4:
        assert all(r.asDict().keys() == dict.fromkeys(docs.columns).keys() for r in got), name
        given = Counter(map(tuple, docs.collect()))
        kept = Counter(map(tuple, got))
        assert set(kept) <= set(given) and kept, name
    if k == 0:  # repeated rows share their fate
        assert all(kept[r] == given[r] for r in kept)
    if k == 1:
        norms = Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in got)
        assert set(norms) == {re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows} and max(norms.values()) == 1
    if k == 2:  # texts without words link with nothing; one of each other component stays
        assert {r.doc_id for r in got if not words(r.text)} == {100, 101, 102, None} and max(kept.values()) == 1
        assert {r.doc_id for r in got if words(r.text)} == {*range(12), 104}
    if k == 3:
        assert all(n <= 2 * given[r] for r, n in kept.items()) and not any(not words(r.text) for r in got)
    if k == 4:
        assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (100, 101)} == {0}


@pytest.mark.parametrize("k", range(5))
def test_stages_of_an_empty_table(spark, folder, k):
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_run_of_an_empty_table(spark, folder):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
