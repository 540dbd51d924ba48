import os
import random
import sys

import __spark_entry__ as E
from tallystack.llm import urls
from tallystack.llm.common import connected_components

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    ok, msg = compare(spark, duck(SF), "op5", E.queries()["op5_url_filters"], E.oracle_sql()["op5_url_filters"], SF)
    assert ok, msg


def canonical(u):
    return f'<html><LINK rel="canonical" href="{u}"></html>'


def test_aliases_rules_and_odd_rows(spark):
    rows = [
        (1, "http://a.info/1", canonical("https://b.info/2")), (2, "https://B.info/2#x", None),
        (3, "http://c.info/3", '<meta http-equiv="refresh" content="0; url=http://bad.net/x">'),   # alias of a blocked url
        (4, "http://b.info/9", canonical("//c.info/3")), (5, "http://d.info/5", canonical("http://x.net/5")),
        (6, "http://d.info/6", canonical("http://x.net/5")), (7, "http://x.net/5", canonical("http://www.example.net/en/q")),
        (8, "http://example.com/de/8", canonical("http://fine.info/")), (9, "http://fine.info", ""),
        (10, "http://www.example.com/dex", None), (11, "http://q.org/fr/", None), (12, None, canonical("http://bad.net/")),
        (13, "no scheme", canonical("/x")), (14, "http://NET/", None), (15, "http://planet/", None), (16, "http://net?x", None),
        (17, "http://r.info/a/b?c", '<link href="../z" rel=canonical>'), (18, "", None), (18, "", None), (None, "http://v.net/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS node", "3 AS a")
    got = {}
    out = urls.url_verdicts(df).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r.page_id] = (r.host, r.path, r.rule, r.verdict)
    assert got[1] == ("a.info", "/1", None, "allow") and got[2][3] == "allow"
    assert got[3][3] == "block" and got[4][3] == "block"          # spread along the chain
    assert got[5][3] == got[6][3] == "allow"                      # an alias is explicitly allowed
    assert got[7] == ("x.net", "/5", "net/", "block")             # its own rule stands
    assert got[8][2:] == ("example.com/de/", "block") and got[9][3] == "block"
    assert got[10][2:] == (None, "allow") and got[11][2:] == ("org/fr/", "allow")
    assert got[12] == ("", "", None, "allow") == got[13] == got[18]
    assert got[14] == ("net", "/", "net/", "block") and got[15][2] is None and got[16][2] is None
    assert got[None][3] == "block"
    assert urls.url_verdicts(df.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1400)]
    pairs += [(rnd.randrange(2000, 3000), rnd.randrange(2000, 3000)) for _ in range(600)] + [(5000, 5000), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
