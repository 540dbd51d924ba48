import hashlib
import re

import __spark_entry__ as E
from tallystack.llm import pii

SF = "/root/testdata/sf0.01"
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def base(text):
    out = []
    for kind, pat in KINDS.items():
        for m in re.finditer(pat, text or ""):
            d = re.sub("[^0-9]", "", m.group(0))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group(0).split(".")) if kind == "ip" else True,
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = [None, "", "a", "1.2.3.4.5.6.7.8 ", "256.1.1.1 1.1.1.1", "x@y.z_d@e.f q@a.b.c@d.e", "\U0001f600 a.b@c.de é1@2.3",
       "4111 1111 1111 1111", "41111111111111112 4111-1111-1111-1111 0", "+1 (202) 555-0188 9", "+1--- +49 30 901820",
       "007.01.2.3 0000000001.2.3.4 99999999999.1.1.1", "1 " * 20000, "9" * 50000, "a." * 30000 + "@b.c", "+1" + "-" * 20000,
       "a@" * 5000, "1.2." * 9000, "4" * 16 + " " + "0" * 16, "é" * 300 + "x@y.zz"]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = E.queries()["op9_pii_boosting"](spark, SF).collect()
    assert len(out) == len(docs)
    total = 0
    for r in out:
        want = base(docs[r.doc_id])
        total += len(want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        order = [(list(KINDS).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
    assert total > 10


def test_odd_texts_and_redaction(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, None), (None, "mail a@b.cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pii", "2 AS _t", "3 AS s", "4 AS kind")
    out = pii.personal_data(df, redact=True)
    assert out.columns == ["doc_id", "text", "_t", "s", "kind", "pii"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r.doc_id]
        assert [f"{x.kind}:{x.s}:{x.e}" for x in r.pii.base] == base(t)
        spans = sorted((x.s, x.e, x.kind) for x in r.pii.spans)
        want, at = "", 0
        for s, e, k in spans:
            if s >= at:
                want, at = want + t[at:s] + f"[{k.upper()}]", e
            at = max(at, e)
        assert r.text == (None if t is None else want + t[at:])
    assert pii.personal_data(df.limit(0)).count() == 0


def test_trees_learn_what_the_checks_leave_out(spark):
    """Card numbers with separators that the base expression does not take."""
    import random
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        d = [rnd.randrange(10) for _ in range(15)]
        d.append(next(c for c in range(10) if luhn("".join(map(str, [*d, c])))))
        s = "".join(map(str, d))
        if i % 3 == 0:
            rows.append(f"pay with card {s[:4]} {s[4:8]} {s[8:12]} {s[12:]} today")
        elif i % 3 == 1:
            rows.append("order number " + "".join(str(rnd.randrange(10)) for _ in range(14)) + " was sent")
        else:
            rows.append(f"pay with card {s[:4]}.{s[4:8]}.{s[8:12]}.{s[12:]} today")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    out = pii.personal_data(df).collect()
    added = [r for r in out if len(r.pii.spans) > len(r.pii.base)]
    assert sum(r.doc_id % 3 == 2 for r in added) > 150
    assert sum(r.doc_id % 3 == 1 for r in added) < 15


def test_thousands_of_matches_in_one_text(spark):
    """Positions and overlaps stay cheap: blocks of matches, not one growing array."""
    import time
    text = " ".join(f"x{i}@a{i % 7}.de 10.0.{i % 256}.{i % 99} +49 30 {100000 + i}" for i in range(4000))
    df = spark.createDataFrame([(1, text), (2, "a@b.cd " * 129), (3, "a@b.cd " * 128)], "doc_id long, text string")
    start = time.time()
    for r in pii.personal_data(df).collect():
        assert [f"{x.kind}:{x.s}:{x.e}" for x in r.pii.base] == base(r.text)
    assert time.time() - start < 120


def test_national_numbers_after_a_phone_word(spark):
    import random
    rnd = random.Random(6)
    rows = []
    for i in range(1200):
        a, b, c = rnd.randrange(200, 999), rnd.randrange(100, 999), rnd.randrange(1000, 9999)
        rows.append([f"some words {rnd.choice([f'+1 ({a}) {b}-{c}', f'+49 {a} {b} {c}', f'+44 {a}{b} {c}'])} and more", f"please call {a} {b} {c} today", f"the sizes {a} {b} {c} were kept",
                     f"call of 2024-{1 + i % 12:02}-{10 + i % 18} was short", f"please call {a} {b} now"][i % 5])
    out = pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    share = [sum(any(x.kind == "phone" for x in r.pii.spans) for r in out if r.doc_id % 5 == j) / 240 for j in range(5)]
    assert share[0] == 1 and share[1] > 0.9 and share[2:] == [0, 0, 0]


def test_trees_and_threshold_see_all_labelled_candidates(spark, monkeypatch):
    from pyspark.sql import functions as F
    x = {n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3)).cast("double") for i, n in enumerate(pii.FEATURES)}
    cand = spark.range(30_000).select(F.col("id").cast("string").alias("_key"), F.lit("card").alias("kind"), F.lit(0).alias("s"), F.lit(9).alias("e"),
                                      F.when(F.col("id") % 100 > 0, (F.col("id") % 2).cast("int")).alias("label"), F.lit(False).alias("over"),
                                      *[c.alias(n) for n, c in x.items()])
    seen = []

    class Spy(pii.GBTClassifier):
        def fit(self, df, *a):
            seen.append(df.agg(F.sum("_n")).first()[0] if "_n" in df.columns else df.count())
            return super().fit(df, *a)
    monkeypatch.setattr(pii, "GBTClassifier", Spy)
    pii.boosted_extra(cand, rounds=2).count()
    fold = F.pmod(F.xxhash64("_key", "kind", "s", F.lit(7)), F.lit(5))
    assert seen == [cand.where("label IS NOT NULL").where(fold > 0).count()]
