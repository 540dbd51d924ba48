import collections
import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as E
from tallystack.llm import arrays, suffixes
from tallystack.llm.common import bitmap, maybe

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for (d, _t), x in zip(rows, raw):
        cover = np.zeros(len(x) + 1, np.int8)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                cover[i:i + length] = 1
        kept = bytes(b for b, c in zip(x, cover) if not c)
        out.append((d, len(x), int(cover.sum()), int((np.diff(np.concatenate([[0], cover])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = E.queries()["op1_suffix_array_dedup"](spark, SF).collect()
    assert collections.Counter(map(tuple, got)) == brute(rows, 400)
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("max_group", [2000, 3])
def test_made_cases(spark, max_group):
    rnd = random.Random(max_group)
    word = lambda: rnd.choice(["ab", "cde", "é", "fghi", "x", "\U0001f600", "kl"]) + str(rnd.randrange(60))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(25), text(120)
    rows = [(i, text(rnd.randrange(40)) + passage + text(rnd.randrange(40))) for i in range(25)]
    for i in range(12):
        w = base.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, "a" * 300), (201, "ab" * 200), (202, "a" * 39), (203, None), (204, ""), (205, base), (205, base), (None, base),
             (206, passage * 3), (207, "a" * 40), (208, "z" * 41), (2**62 + 1, base + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rk", "2 AS spans", "3 AS anchor")
    got = suffixes.dedup(df, length=40, gram=20, max_group=max_group, batch_rows=64).collect()
    assert collections.Counter(map(tuple, got)) == brute(rows, 40)
    if max_group == 3:
        got = suffixes.dedup(df, length=40, gram=20, max_broadcast=0).collect()
        assert collections.Counter(map(tuple, got)) == brute(rows, 40)
        assert suffixes.dedup(df.limit(0)).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    rnd = random.Random(1)
    x = bytes(rnd.choice(b"abc") for _ in range(3000))
    whole = suffixes.segments_of([x], 50, 20)
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    parts = suffixes.segments_of([x], 50, 20)
    for s in (whole, parts):
        cover = np.zeros(3000, int)
        for start, n in zip(s[1], s[2]):
            cover[start:start + n] += 1
        assert (cover[:2951] == 1).all() and not cover[2951:].any()
    anchors = [{(int(a) + int(b), int(g)) for a, b, g in zip(s[1], s[3], s[4])} for s in (whole, parts)]
    assert anchors[0] == anchors[1]


def test_common_prefixes_equal_direct_comparison():
    rnd = random.Random(4)
    data, a, n, group = [], [], [], []
    for g in range(6):
        core = bytes(rnd.choice(b"ab") for _ in range(8))
        for _ in range(rnd.randint(1, 9)):
            left = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 4)))
            right = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(4, 8)))
            x = left + core + right
            data.append(x)
            a.append(len(left))
            n.append(len(x) - 12 + 1)
            group.append(g)
    hits = suffixes.column_wise(np.array(group), data, np.array(a), np.array(n), 12)
    for i, h in enumerate(hits):
        for s in range(n[i]):
            w, col = data[i][s:s + 12], s - a[i]
            other = any(group[k] == group[i] and k != i and 0 <= col + a[k] < n[k] and data[k][col + a[k]:col + a[k] + 12] == w
                        for k in range(len(data)))
            assert h[s] == other
    assert arrays.BLOCK


def test_lists_are_not_broadcast_to_documents(spark):
    """A list per document has no bound: the join shuffles, and only documents that may have one."""
    docs = spark.createDataFrame([(i, bytes([i]), f"text {i}") for i in range(40)], "doc_id long, rk binary, text string")
    lists = spark.createDataFrame([(bytes([i]), [i] * 500) for i in range(3)], "rk binary, spans array<long>")
    joined, held = suffixes._by_rk(docs, lists)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() < 10 and len(held.value)
    assert sorted(r.doc_id for r in joined.where("spans IS NOT NULL").collect()) == [0, 1, 2]


def test_bitmap_comes_in_packed_rows(spark):
    keys = spark.range(300_000).selectExpr("xxhash64(id) AS key")
    bits = bitmap(keys, 300_000)
    held = keys.toPandas()["key"].to_numpy().view(np.uint64)
    want = np.zeros(len(bits) * 64, bool)
    want[held & np.uint64(len(want) - 1)] = True
    assert (np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool) == want).all()
    assert maybe(bits, held).all() and not maybe(bits, ~held).all()
    one = bitmap(spark.createDataFrame([(7,)], "key long"), 1)
    assert maybe(one, np.array([7, 8], np.uint64)).tolist() == [True, False]
