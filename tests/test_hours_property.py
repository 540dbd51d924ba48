"""Randomised check of the opening-hours expression against a pure-Python
statement of the rules (batched: one Spark job per generated list)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallystack.functions.text import open_hours


def expected(text):
    if text is None or "-" not in text:
        return None
    parts = text.split("-")
    mins = []
    for piece in parts[:2]:
        hm = piece.split(":")
        if len(hm) < 2:
            return None
        try:
            h, m = int(hm[0].strip()), int(hm[1].strip())
        except ValueError:
            return None
        if not ((0 <= h <= 23 and 0 <= m <= 59) or (h == 24 and m == 0)):
            return None
        mins.append(h * 60 + m)
    s, e = mins
    d = 1440 if s == e else (e + 1440 - s if e < s else e - s)
    return d / 60.0


clock = st.tuples(st.integers(0, 26), st.integers(0, 62), st.booleans()).map(
    lambda t: f"{t[0]:02d}:{t[1]}" if t[2] else f"{t[0]}:{t[1]:02d}")
text = st.one_of(st.tuples(clock, clock).map(lambda t: f"{t[0]}-{t[1]}"),
                 st.sampled_from(["none", "NULL", "", "9-10", "9:00-", "-9:00", "a:b-c:d"]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(text, min_size=50, max_size=200))
def test_open_hours_matches_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["h"] for r in df.select("i", open_hours("t").alias("h")).collect()}
    for i, t in enumerate(texts):
        e = expected(t)
        assert (got[i] is None and e is None) or abs(got[i] - e) < 1e-12, (t, got[i], e)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="u'ab\"$\\\\\n", max_size=12)), min_size=30, max_size=100))
def test_strip_first_matches_python(spark, texts):
    from tallystack.functions.text import strip_first_seq
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", strip_first_seq("t", ["u'", "'", "'"]).alias("s")).collect()}
    for i, t in enumerate(texts):
        e = None if t is None else t.replace("u'", "", 1).replace("'", "", 1).replace("'", "", 1)
        assert got[i] == e, (t, got[i], e)


def test_hash_uniform_matches_hashlib(spark):
    import hashlib
    from pyspark.sql import functions as F
    from tallystack.functions.hashing import hash_uniform
    df = spark.range(200).withColumn("u", hash_uniform(66, "id"))
    for r in df.collect():
        h = hashlib.md5(f"66:{r['id']}".encode()).hexdigest()[:8]
        assert r["u"] == int(h, 16) / 2 ** 32
