import random

import brute
import numpy as np

import __spark_entry__ as E
from tallystack.llm import arrays, minhash

SF = "/root/testdata/sf0.01"


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute.components(docs, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in E.queries()["op3_minhash_near_dedup"](spark, SF).collect()}
    assert got == want
    assert any(i != c for i, (_n, c) in want.items())


def test_chains_hot_groups_and_odd_rows(spark):
    rnd = random.Random(5)
    rows, at = [], 0
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    for c in range(150):                       # a chain: each differs a little from the one before
        rows.append((at, " ".join(base)))
        at += 1
        base[rnd.randrange(120)] = f"x{c}"
    hot = [f"h{i}" for i in range(200)]
    for c in range(300):                       # a large group of near copies
        t = list(hot)
        t[rnd.randrange(200)] = f"y{c}"
        rows.append((at, " ".join(t)))
        at += 1
    rows += [(at + i, "same words in this short row") for i in range(40)]
    at += 40
    rows += [(at, None), (at + 1, ""), (at + 2, " \t\n"), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "two words")]
    rows.append(rows[0])                       # a repeated row
    df = spark.createDataFrame([(i, t, "clash", 1, None) for i, t in rows],
                               "doc_id long, text string, component_id string, kept int, rep string")
    got = minhash.near_duplicates(df, k=4).collect()
    want = brute.components(dict(rows), 4, 80)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (2**62 + 1, "other")], "doc_id long, text string"))
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} == {(None, 7, True), (7, 7, True), (2**62 + 1, 2**62 + 1, True)}


def test_sketch_estimates_similarity():
    """Every coordinate is filled, and the share of equal ones is close to the similarity."""
    rnd = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        common = rnd.integers(0, 2**63, n).astype(np.uint64)
        a = np.unique(np.concatenate([common, rnd.integers(0, 2**63, n // 4).astype(np.uint64)]))
        b = np.unique(np.concatenate([common, rnd.integers(0, 2**63, n // 4).astype(np.uint64)]))
        g, d = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        s = minhash.sketch(g, d, 2, 512)
        assert (s != np.iinfo(np.uint64).max).all()
        true = n / (len(a) + len(b) - n)
        assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_words_and_shingles_match_the_definition():
    texts = ["A b\x0bC d e", "", "ß É é Z", "x " * 40, "a\xa0b c"]
    raw = [t.encode() for t in texts]
    h, doc, _s, _e = arrays.words(raw)
    assert [int((doc == i).sum()) for i in range(len(texts))] == [len(brute.words(t)) for t in texts]
    g, d = arrays.shingles(h, doc, len(texts), 4)
    assert np.bincount(d, minlength=len(texts)).tolist() == [len(brute.shingles(t, 4)) for t in texts]


def test_sketch_fills_cells_without_sorting(monkeypatch):
    """Every coordinate is the least value that any round throws into it; no round sorts its throws."""
    t, rnd = 16, np.random.default_rng(4)
    sizes = [0, 1, 3, 40, 400]
    d = np.repeat(np.arange(len(sizes)), sizes)
    g = rnd.integers(0, 2**63, len(d)).astype(np.uint64)
    want = np.full((len(sizes), t), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            x = arrays.mix(g + np.uint64(i + 1) * minhash._STEP)
            low = (np.uint64(i) << np.uint64(48)) | (x >> np.uint64(16))
            at = (arrays.mix(x) % np.uint64(t)).astype(int) if i < t else np.full(len(g), i - t)
            for doc, cell, v in zip(d, at, low):
                want[doc, cell] = min(want[doc, cell], v)

    def never(*_a, **_k):
        raise AssertionError("sorted")
    monkeypatch.setattr(np, "lexsort", never)
    assert (minhash.sketch(g, d, len(sizes), t) == want).all()
