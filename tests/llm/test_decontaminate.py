import os
import random
import sys

import brute

import __spark_entry__ as E
from tallystack.llm.decontaminate import containment_search

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    name = "op10_benchmark_decontamination"
    ok, msg = compare(spark, duck(SF), name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, msg
    assert E.queries()[name](spark, SF).count() > 0


def test_partial_items_against_brute_force(spark):
    rnd = random.Random(11)
    items = {i: " ".join(f"v{rnd.randrange(3000)}" for _ in range(n)) for i, n in
             enumerate([1, 3, 4, 5, 6, 9, 20, 40, 41, 80, 300, 700])}
    items[20] = items[8]                       # the same item twice
    items[21], items[22] = None, "  "
    docs, at = {}, 0
    for i, t in items.items():
        w = (t or "x").split() or ["x"]
        for share in (1.0, 0.9, 0.84, 0.8, 0.75, 0.3):
            part = list(w[:max(1, int(len(w) * share))])
            if share == 0.9 and len(w) > 30:
                part[rnd.randrange(len(part))] = "changed"
            fill = [f"f{rnd.randrange(50)}" for _ in range(rnd.choice([0, 10, 3000]))]
            docs[at] = " ".join(fill + part + fill).upper()
            at += 1
    docs |= {at: None, at + 1: "", at + 2: "\n \t"}
    want = set()
    for d, t in docs.items():
        s = brute.shingles(t, 5)
        for i, q in items.items():
            g = brute.shingles(q, 5)
            if g and 100 * len(g & s) >= 80 * len(g):
                want.add((d, i, len(g), len(g & s)))
    rows = [*docs.items(), (0, docs[0]), (None, docs[0])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, class int, item_id int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(None, "a b c d e f", 1)],
                                  "item_id long, text string, doc_id int")
    got = containment_search(df, bench)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    shuffled = containment_search(df, bench, max_broadcast=0)     # beyond the size bound
    assert {tuple(r) for r in shuffled.collect()} == want
    assert containment_search(df.limit(0), bench).count() == 0
    assert containment_search(df, bench.limit(0)).count() == 0
