import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from brute import words
from tallystack.llm import runs

SF = "/root/testdata/sf0.001"


def brute_runs(w, least):
    """All runs by comparing words at every distance."""
    ids = np.array([hash(x) for x in w], np.int64)
    found = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], ids[q:] == ids[:-q], [0]]).astype(np.int8)
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            n = int(e - s) + q
            if n >= max(least, 2 * q) and not any(a <= s and s + n <= a + m and q % p == 0 for a, p, m in found.get(int(s), [])):
                found.setdefault(int(s), []).append((int(s), q, n))
    return sorted(x for v in found.values() for x in v)


def brute_row(doc_id, text, plant=True):
    w = words(text, lower=False)
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    r = brute_runs(w, 12)
    gone = {i for s, p, m in r for i in range(s + p, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    s = m = p = None
    if r:
        m, s, p = min((-m, s, p) for s, p, m in r)
        m = -m
    lines = "".join(f"{x},{z},{y}\n" for x, y, z in r)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(r), s, m, p, 1000 * m // p if r else None, sha(lines), sha(kept))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in E.queries()["op11_periodic_runs"](spark, SF).collect()]
    assert collections.Counter(got) == collections.Counter(brute_row(*r) for r in rows)
    assert any(r[1] for r in got)


def test_tree_answers_common_extensions():
    rnd = random.Random(5)
    for size, letters in ((1, 1), (2, 1), (30, 1), (200, 2), (300, 3), (500, 40)):
        s = [rnd.randint(1, letters) for _ in range(size)]
        t = runs.SuffixTree(s)
        rank = t.ranks()
        assert np.argsort(rank).tolist() == sorted(range(size + 1), key=lambda i: [*s, 0][i:])
        i, j = (np.array([rnd.randrange(size + 1) for _ in range(800)]) for _ in "ij")
        i, j = i[i != j], j[i != j]
        for a, b, c in zip(i, j, t.common(i, j)):
            x, y = s[a:], s[b:]
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert c == k


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_equal_all_distances(letters):
    rnd = random.Random(letters)
    for size in (1, 2, 3, 9, 40, 150, 400):
        s = [rnd.randint(1, letters) for _ in range(size)]
        for _ in range(3):                       # copies of stretches make longer periods
            a, b = sorted(rnd.randrange(size) for _ in "ab")
            s = (s[:b] + s[a:b] + s[b:])[:2 * size]
        for least in (2, 6):
            start, end, period = runs.runs_of(s, least)
            got = sorted((int(x), int(p), int(y - x)) for x, y, p in zip(start, end, period))
            assert got == brute_runs([str(x) for x in s], least)


def test_made_documents(spark, monkeypatch):
    rnd = random.Random(11)
    word = lambda: rnd.choice(["ab", "é", "\U0001f600", "x", " "])
    text = lambda n: "".join(word() + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(n))
    base = text(14)
    rows = [(i, text(rnd.randrange(30)) + base * rnd.randrange(4) + text(rnd.randrange(30))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, base * 3), (103, base * 3), (103, base * 3), (104, "one"), (105, "w " * 12),
             (106, "w " * 11), (107, "w " * 4000), (108, base * 200), (2**62 + 1, "a b " * 6 + "a"), (109, "y" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS start")
    got = {}
    for r in runs.periodic_runs(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [(x.start, x.period, x.length) for x in r.runs], r.collapsed))
    for d, t in rows:
        w = words(t, lower=False)
        want = brute_runs(w, 12)
        gone = {i for s, p, m in want for i in range(s + p, s + m)}
        assert (len(w), want, " ".join(x for i, x in enumerate(w) if i not in gone)) in got[d]
    assert sum(map(len, got.values())) == len(rows)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    # the planted texts of the query, short ones included
    short = [(i, t) for i, (_d, t) in enumerate(rows)] + [(None, "a b")]
    made = runs.planted(spark.createDataFrame(short, "doc_id long, text string")).collect()
    whole = {r.doc_id: words(r.text, lower=False) for r in made}
    for d, t in short:
        w, h = words(t, lower=False), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        assert whole[d] == w


def test_many_stretches_share_trees(monkeypatch):
    rnd = random.Random(3)
    raw = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(60))).encode() for _ in range(40)]
    whole = runs.find_runs(raw, 12)
    monkeypatch.setattr(runs, "BATCH", 1)
    assert runs.find_runs(raw, 12) == whole
    assert [x for x in whole[1]] == [brute_runs(x.decode().split(), 12) for x in raw]
