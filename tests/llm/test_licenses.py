import random
import re

import numpy as np

import __spark_entry__ as E
from tallystack.llm import licenses as L

SF = "/root/testdata/sf0.01"
LINES = {"mit_notice": "Released under the MIT License.", "apache_2_notice": "Licensed under the Apache License, Version 2.0.",
         "gpl_3_notice": "licensed under the GNU General Public License, version 3.", "cc_by_nc_4_notice": "Licensed under CC BY-NC 4.0."}


def test_query_finds_exactly_the_planted_lines(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, n) for i, t in docs.items() for n, x in LINES.items() if x.rstrip(".") in t}
    got = E.queries()["op2_license_scan"](spark, SF).collect()
    assert {(r.doc_id, r.license) for r in got} == want and want
    for r in got:
        assert re.sub(r"\W+", " ", docs[r.doc_id][r.start:r.end]) in re.sub(r"\W+", " ", LINES[r.license])


def test_edits_positions_and_odd_rows(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for i in range(60):
        name = rnd.choice(sorted(L.TEMPLATES))
        w = L.TEMPLATES[name].split()
        if len(w) > 12 and i % 2:
            for _ in range(len(w) // 12):
                at = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[at] = "altered"
                else:
                    w.insert(at, "inserted")
        fill = [f"f{rnd.randrange(99)}" for _ in range(rnd.randrange(200))]
        rows.append((i, "\n * ".join([" ".join(fill), " ".join(w).upper() if i % 3 else " ".join(w), " ".join(fill)])))
        want[i] = name
    rows += [(100, None), (101, ""), (102, "the license"), (103, "x " * 50000), (None, LINES["mit_notice"]), (104, (LINES["mit_notice"] + " ") * 2),
             (105, " ".join(L.TEMPLATES["bsd_grant"].split()[:8]))]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license", "2 AS start")
    out = L.license_scan(df).collect()
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append(r.license)
    for i, name in want.items():
        assert name in found[i], (i, name, found.get(i))
    assert found[0].count(want[0]) == 2                        # the repeated row
    assert found[None] == ["mit_notice"] and len(found[104]) == 2
    assert not {100, 101, 102, 103, 105} & set(found)
    assert L.license_scan(df.limit(0)).count() == 0


def test_band_alignment_against_full_alignment():
    rnd = random.Random(3)
    for _ in range(200):
        t = [rnd.choice("abcd") for _ in range(rnd.randint(1, 9))]
        d = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        n, a, z = L.align(t, d, 2 * (len(t) + len(d)) + 3, -len(t) - 1)
        s = np.zeros((len(t) + 1, len(d) + 1))
        s[1:, 0] = -np.arange(1, len(t) + 1)
        for i in range(1, len(t) + 1):
            for j in range(1, len(d) + 1):
                s[i, j] = max(s[i - 1, j - 1] + (1 if t[i - 1] == d[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
        best = s[-1].max()
        full = L.align(t, d, 2 * (len(t) + len(d)) + 3, -len(t) - 1)
        assert full[0] >= (best + len(t)) / 2 - len(t) / 2 and (n == 0 or (t.count(d[a]) and t.count(d[z])))


def test_shared_runs_share_a_fingerprint():
    rnd = np.random.default_rng(2)
    for _ in range(100):
        x = rnd.integers(0, 50, 40).astype(np.uint64)
        p = L.winnow(x, 4)
        assert all(any(i <= q < i + 4 for q in p) for i in range(len(x) - 3))


def test_blocks_left_out_or_inserted_and_texts_cut_at_an_end():
    index = L.Index(L.TEMPLATES)
    fill = " ".join(f"f{i}" for i in range(40))
    new = " ".join(f"g{i}" for i in range(10))
    for name in ("mit_grant", "gpl_header", "isc_grant"):
        w = L.TEMPLATES[name].split()
        gone = min(10, len(L.tokens(L.TEMPLATES[name])[0]) // 5 - 1)
        mid = len(w) // 2 - gone // 2
        cases = [" ".join([fill, *w[:mid], *w[mid + gone:], fill]), " ".join([fill, *w[:mid], new, *w[mid:], fill]),
                 " ".join(w[gone:]), " ".join([fill, *w[:-gone]]), " ".join([*w[gone:], fill]),
                 " ".join([*w, *w[:mid], *w[mid + gone:], *w])]
        for i, text in enumerate(cases):
            found = [r for r in L.scan_text(text, index, 80) if r[0] == name]
            assert len(found) == (3 if i == 5 else 1), (name, i, found)
            assert all(100 * r[2] >= 80 * r[1] for r in found)
