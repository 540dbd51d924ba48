import collections
import random
import re

import numpy as np
import pytest

import __spark_entry__ as E
from tallystack.llm import phrases

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, covered=100):
    """rows: (lang, text)"""
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f["und" if lang is None else lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, c in f.items():
        words = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        gone = {k[i:j] for k, v in cand.items() for i in range(len(k)) for j in range(i + 2, len(k) + 1)
                if j - i < len(k) and k[i:j] in cand and 100 * v >= covered * cand[k[i:j]]}
        found = []
        for k, a in cand.items():
            if k in gone:
                continue
            score, _i, l, r = min((1000 * a * words // (c[k[:i]] * c[k[i:]]), i, c[k[:i]], c[k[i:]]) for i in range(1, len(k)))
            found.append((-score, -a, " ".join(k).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words, -s))
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_query_against_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, E.queries()["op13_phrase_collocations"](spark, SF).collect()))
    assert got == brute(rows, 100, 2000) and got


def made(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["ab", "Cd", "é", "x-y", "\U0001f600", "Éa", " ", "gh"])
    gap = lambda: rnd.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "!?", "\r"])
    text = lambda n: "".join(word() + gap() for _ in range(n))
    passage = text(30)
    rows = [(rnd.choice(["en", "de", None, ""]), text(rnd.randrange(60)) + passage + text(rnd.randrange(20))) for _ in range(40)]
    return rows + [("en", None), ("en", ""), ("en", " . \n"), (None, "one"), ("en", passage), ("en", passage), ("und", passage),
                   ("xx", "ab " * 3000), ("en", "a" * 20000), ("en", text(5000))]


@pytest.mark.parametrize("spread", [1, 3, 64])
def test_made_cases(spark, spread):
    rows = made(spread)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS c", "3 AS last")
    assert found(df, least=3, top=50, spread=spread) == brute(rows, 3, 50)
    if spread == 3:
        assert found(df, least=5, top=10 ** 6, spread=spread, covered=90) == brute(rows, 5, 10 ** 6, 90)
        assert found(df.limit(0)) == []


def test_a_full_bit_table_costs_no_result(spark, monkeypatch):
    """All bits set: nothing is filtered early, the result stays."""
    rows = made(9)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "_bit_table", lambda frequent, bits: spark.sparkContext.broadcast(b"\xff" * (1 << 17)))
    assert found(df, least=4, top=100) == brute(rows, 4, 100)




def test_chunks_hold_every_phrase_start_once():
    rnd = random.Random(2)
    raw = [" ".join(rnd.choice("abc") for _ in range(n)).encode() for n in (0, 1, 3, 4, 5, 40, 400)]
    for spread in (1, 2, 7):
        buf, text, s, e, last = phrases.chunks(raw, spread)
        total = np.zeros(len(raw), int)
        for i, a, b, z in zip(text, s, e, last):
            n = len(bytes(buf[a:b]).split())
            total[i] += n if z else n - phrases.OVERLAP
        assert total.tolist() == [len(x.split()) for x in raw]


def test_products_beyond_64_bits(spark):
    rows = [(7 * 10 ** 15 + 1, 9 * 10 ** 16 + 7, 7 * 10 ** 15 + 3, 8 * 10 ** 15 + 9), (3, 10 ** 15 + 1, 7, 3), (100, 100, 100, 100)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a long, n long, l long, r long").selectExpr("i", phrases.SCORE + " AS s")
    assert [r.s for r in got.sort("i").collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]
