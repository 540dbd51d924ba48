"""Split, oversampling, scaling, imputation properties."""

from pyspark.sql import functions as F

from tallystack.operators import impute, prep


def test_split_75_25_disjoint(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    s = prep.shuffle_split(df, "k", 0.75, 66)
    tr = {r["k"] for r in s.filter("split = 'train'").collect()}
    ev = {r["k"] for r in s.filter("split = 'eval'").collect()}
    assert len(tr) == 75 and len(ev) == 25 and not (tr & ev) and len(tr | ev) == 100


def test_oversample_equalises_and_keeps_originals(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(100)], "k long, y int")
    o = prep.oversample(df, "y", "k", seed=3)
    counts = {r["y"]: r["count"] for r in o.groupBy("y").count().collect()}
    assert counts == {0: 90, 1: 90}
    assert o.filter("copy = 0").count() == 100
    assert {r["k"] for r in o.collect()} == set(range(100))


def test_minmax_within_unit_interval(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "a double, b double")
    tr, ev = prep.minmax(df, df, ["a", "b"])
    r = tr.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    assert tuple(r) == (0.0, 1.0, 0.0, 1.0)


def test_impute_marginal_changes_only_missing_cells(spark):
    rows = [(i, None if i % 4 == 0 else ("x" if i % 3 else "y")) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, c string")
    out = impute.impute_marginal(df, ["c"], "k", m=3, seed=500)
    assert out.count() == 600 and out.filter(F.col("c").isNull()).count() == 0
    orig = dict(rows)
    for r in out.collect():
        if orig[r["k"]] is not None:
            assert r["c"] == orig[r["k"]]
        else:
            assert r["c"] in ("x", "y")


def test_dummy_code_levels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, c string")
    out = prep.dummy_code(df, "c", ["a", "b"], drop_base=True).orderBy("k").collect()
    assert [r["c_b"] for r in out] == [0, 1, None] and "c_a" not in out[0].asDict()


def test_impute_marginal_single_level(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "k long, c string")
    out = impute.impute_marginal(df, ["c"], "k", m=2)
    assert {r["c"] for r in out.collect()} == {"a"} and out.count() == 6


def test_cut_split_takes_the_same_rows_without_ordering(spark, monkeypatch):
    ids = [(i, i % 7) for i in range(1000)] + [(i, 9) for i in range(0, 1000, 5)] + [(None, i) for i in range(40)]
    df = spark.createDataFrame(ids, "id long, v int")
    for frac in (0.0, 0.3, 0.75, 1.0):
        for buckets in (4, 1 << 16):
            want = prep.shuffle_split(df, "id", frac, 66).groupBy("id", "split").count()
            got = prep.cut_split(df, "id", frac, 66, buckets=buckets).groupBy("id", "split").count()
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(prep, "ordered_prefix", None)       # no row is ordered but those of one bucket
    one = prep.cut_split(df.where("v < 7 AND id IS NOT NULL"), "id", 0.75, 66)
    assert one.where("split = 'train'").count() == 750
