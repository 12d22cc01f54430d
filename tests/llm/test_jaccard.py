"""The join against brute force over all pairs, and its edge cases."""

import numpy as np
import pyarrow as pa
import pytest

from panelwise.llm import jaccard


def shingles(text):
    w = (text or "").lower().split(None)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """doc -> (class, links, copies, class size) of (doc_id, text) rows with distinct ids."""
    texts = {}
    for doc, text in rows:
        texts.setdefault(tuple((text or "").lower().split()), []).append(doc)
    keys = list(texts)
    sets = [shingles(" ".join(k)) for k in keys]
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    links = [set() for _ in keys]
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in index[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j != i and 9 * n >= 4 * (len(s) + len(sets[j])):
                links[i].add(j)
    comp = list(range(len(keys)))
    for i in range(len(keys)):
        todo = [i] if comp[i] == i else []
        while todo:
            x = todo.pop()
            comp[x] = i
            todo += [j for j in links[x] if comp[j] == j and j != i and j > i]
    out = {}
    for i, k in enumerate(keys):
        docs = [d for j, c in enumerate(comp) if c == comp[i] for d in texts[keys[j]]]
        for d in texts[k]:
            out[d] = (min(docs), len(links[i]), len(texts[k]), len(docs))
    return out


def result(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies, r.class_size) for r in jaccard.jaccard_join(df).collect()}


def near_copies(r, n, words=60, edits=4):
    base = [f"w{r.integers(1000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.integers(0, edits)):
            w[r.integers(words)] = f"e{r.integers(1000)}"
        out.append(" ".join(w))
    return out


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 8)
    r = np.random.default_rng(1)
    texts = near_copies(r, 60) + near_copies(r, 30, 25, 2) + near_copies(r, 30, 200, 12)
    half = " ".join(f"p{i}" for i in range(40))
    texts += [half + " " + " ".join(f"q{r.integers(10**6)}" for _ in range(30)) for _ in range(30)]
    texts += ["", None, " \n", "one", "one", "one two", "a b c d e", "a b c d f", "A  b\tc d e"]
    rows = list(enumerate(texts))
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == brute(rows)
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {c for c, *_ in brute(rows).values()}


def test_edges(spark):
    schema = "doc_id bigint, text string, key string, rid int, doc string"
    empty = spark.createDataFrame([], schema)
    assert jaccard.jaccard_join(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [(None, "a b c d e f", "k", 1, "-"), (None, "a b c d e f", "k", 1, "-"), (3, "a b c d e f", "z", 2, None), (4, long, None, None, None), (5, long + " y", "", 0, "")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, jaccard.jaccard_join(df).collect()), key=repr)
    assert got == sorted([(3, 3, 0, 3, 3), (4, 4, 1, 1, 2), (5, 4, 1, 1, 2), (None, 3, 0, 3, 3), (None, 3, 0, 3, 3)], key=repr)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
    nobody = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id bigint, text string")
    assert [r.class_id for r in jaccard.jaccard_join(nobody).collect()] == [None, None]
    assert jaccard.keep_one(nobody).count() == 1


def test_posterior_bound():
    steps = dict(jaccard.least_matches())
    assert steps[112] > 60 and all(0 <= m <= n for n, m in steps.items())


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(jaccard, "VOCABULARY", 7)
    r = np.random.default_rng(2)
    a, b = ([np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint64)) for _ in range(9)] for _ in range(2))
    assert (jaccard.shared_counts(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


@pytest.mark.parametrize("n", [1, 6])
def test_components(spark, n):
    chain = [(i, i + 1) for i in range(n * 7)] + [(100, 101)]
    got = {r.rid: r.comp for r in jaccard.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(n * 7 + 1), 0), 100: 100, 101: 100}


def test_words_match_plain_split():
    from panelwise.llm.words import shingle_set, word_hashes

    hashes, lengths, first = word_hashes(pa.array(["A  bé\tC", None, "", "x", "a bé c"]))
    assert np.diff(first).tolist() == [3, 0, 0, 1, 3] and (hashes[:3] == hashes[4:]).all() and lengths.tolist()[:3] == [1, 3, 1]
    assert len(shingle_set(hashes[:3])) == 1 and len(shingle_set(hashes[:0])) == 0
