import collections
import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__ as E
from brute import words
from tallystack.llm import arrays, simhash

SF = "/root/testdata/sf0.001"


def brute_bits(text):
    """The fingerprint from its definition, one term and bit at a time."""
    w = words(text)
    one = {x: arrays.words([x.encode()])[0] for x in set(w)}
    term = collections.Counter()
    for x in w:
        term[int(one[x][0])] += 1
    for x, y in zip(w, w[1:]):
        with np.errstate(over="ignore"):
            term[int(arrays.mix(one[x] * simhash._STEP + one[y])[0])] += 1
    votes = [0] * simhash.BITS
    for t, n in term.items():
        weight = round(64 * (1 + math.log2(n)))
        for k in range(simhash.LANES):
            lane = int(arrays.mix(np.array([(t + k * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            for b in range(64):
                votes[64 * k + b] += weight if lane >> b & 1 else -weight
    return "".join(f"{sum((votes[8 * i + b] > 0) << b for b in range(8)):02x}" for i in range(simhash.BITS // 8))


def far(x, y):
    return (int(x, 16) ^ int(y, 16)).bit_count()


def brute(rows, radius=simhash.RADIUS):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    prints, out = {}, []

    def bits(t):
        return prints.setdefault(t, brute_bits(t))
    kinds = collections.Counter(bits(t) for _, t in rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 2
        made = t[:len(t) - k] + after[:k]
        near = sum(n for y, n in kinds.items() if far(bits(t), y) <= radius) - 1 if d is not None and d % 20 == 0 else None
        out.append((d, len(t), hashlib.sha256(made.encode()).hexdigest(), bits(t), bits(made),
                    1 - far(bits(t), bits(made)) / simhash.BITS, 1 - far(bits(t), bits(after)) / simhash.BITS, near))
    return collections.Counter(out)


def test_query_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = E.queries()["op12_simhash_fingerprints"](spark, SF).collect()
    by = {r.doc_id: r for r in got}
    short = {d for d, t in rows if len(t or "") < 4000}
    assert len(got) == len(rows) == len(by)
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k, r = len(t) // 2, by[d]
        made = t[:len(t) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(made.encode()).hexdigest())
        if d in short:
            assert (r.fingerprint, r.edited_fingerprint) == (brute_bits(t), brute_bits(made))
        other = by[order[(i + 1) % len(order)][0]].fingerprint
        assert r.near_edited == 1 - far(r.fingerprint, r.edited_fingerprint) / 256 and r.near_next == 1 - far(r.fingerprint, other) / 256
        near = sum(far(r.fingerprint, x.fingerprint) <= simhash.RADIUS for x in got) - 1
        assert r.n_near == (near if d % 20 == 0 else None)
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.99 * len(long)


@pytest.mark.parametrize("parts", [1, 5])
def test_made_documents(spark, parts):
    rnd = random.Random(parts)
    text = lambda n: " ".join(rnd.choice(["Ab", "cd", "É", "\U0001f600", "x,"]) + str(rnd.randrange(9)) for _ in range(n))
    base = text(60)
    rows = [(i, text(rnd.randrange(40))) for i in range(30)] + [(20 * i, base + f" {i % 3}") for i in range(30, 45)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2020, "a"), (2020, "b"), (2020, "b"), (None, base), (None, None), (2**62, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS fp", "2 AS part", "3 AS n_chars")
    got = collections.Counter(map(tuple, simhash.document_fingerprints(df).collect()))
    assert got == brute(rows)
    if parts == 1:
        assert simhash.document_fingerprints(df.limit(0)).count() == 0
        only = [(5, "just one text")]
        assert collections.Counter(map(tuple, simhash.document_fingerprints(spark.createDataFrame(only, "doc_id long, text string")).collect())) == brute(only)


def test_tables_hold_every_pair_within_the_radius():
    rnd = random.Random(8)
    for bits, radius, blocks in ((256, 8, 13), (256, 3, 6), (64, 3, 6)):
        bounds, pairs = simhash.block_tables(bits, radius, blocks)
        assert bounds[0][0] == 0 and bounds[-1][1] == bits
        for _ in range(500):
            touched = {next(k for k, (a, b) in enumerate(bounds) if a <= x < b) for x in rnd.sample(range(bits), radius)}
            assert any(a not in touched and b not in touched for a, b in pairs)
        worst = list(range(blocks))
        for _ in range(500):
            bad = set(rnd.sample(worst, radius))
            assert any(a not in bad and b not in bad for a, b in pairs)


def test_search_in_blocks_counts_each_pair_once(spark, monkeypatch):
    rnd = random.Random(4)
    center = rnd.getrandbits(256)
    made = [center ^ sum(1 << b for b in rnd.sample(range(256), rnd.randrange(9))) for _ in range(300)] + [rnd.getrandbits(256) for _ in range(40)]
    rows = [(i, x.to_bytes(32, "little")) for i, x in enumerate(made + made[:20])]
    monkeypatch.setattr(simhash, "ROWS", 16)
    monkeypatch.setattr(simhash, "QUERIES", 4)
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, fp binary")
    from pyspark.sql import functions as F
    got = {bytes(r.fp): r.near for r in simhash.near_counts(df, F.col("doc_id") % 7 == 0).collect()}
    for i, b in rows:
        if i % 7 == 0:
            assert got[b] == sum((int.from_bytes(b, "little") ^ int.from_bytes(c, "little")).bit_count() <= 8 for _, c in rows)
    assert set(got) == {b for i, b in rows if i % 7 == 0}
