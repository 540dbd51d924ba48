"""Unit fixtures for column functions and row-level operators (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallystack.functions import calendar as C
from tallystack.functions import text as T
from tallystack.operators import clean, features


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")


def collect(df, col="r"):
    return [r[col] for r in df.orderBy("i").collect()]


def test_open_hours_reference_examples(spark):
    vals = ["09:30-12:15", "09:30-09:15", "09:30-09:30", "09:30-01:30", "11:0-2:0", "11:0-21:30", "none"]
    got = collect(one_col(spark, vals).select("i", T.open_hours("v").alias("r")))
    assert got == [2.75, 23.75, 24.0, 16.0, 15.0, 10.5, None]


def test_open_hours_own_cases(spark):
    vals = ["NULL", None, "9:0-24:00", "25:00-2:0", "9:0:30-10:0:30", "9-10"]
    got = collect(one_col(spark, vals).select("i", T.open_hours("v").alias("r")))
    assert got == [None, None, 15.0, None, 1.0, None]


def test_strip_first_only_first_occurrences(spark):
    vals = ["u'full_bar'", "'none'", "NULL", "a'b'c'd'", None]
    df = clean.strip_first(one_col(spark, vals), ["v"])
    assert collect(df, "v") == ["full_bar", "none", "NULL", "abc'd'", None]


def test_strip_all(spark):
    df = clean.strip_all(one_col(spark, ['"9:0-10:0"', 'a"b"']), ["v"])
    assert collect(df, "v") == ["9:0-10:0", "ab"]


def test_null_text_only_on_strings(spark):
    df = spark.createDataFrame([(1, "NULL", 2.0), (2, "x", None)], "i int, s string, d double")
    out = clean.null_text_to_null(df).orderBy("i").collect()
    assert out[0]["s"] is None and out[1]["s"] == "x" and out[0]["d"] == 2.0


def test_strict_rolling_window_frame_of_three(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, None, 3, 4, 5])], "k int, i int, v int")
    out = features.rolling_rows(df, "k", "i", "v", before=2, strict=True, name="r")
    assert collect(out) == [1, None, None, None, 12]


def test_rolling_by_days(spark):
    rows = [(1, 0, dt.date(2017, 1, 1), 1), (1, 1, dt.date(2017, 1, 10), 2), (1, 2, dt.date(2017, 1, 20), 4)]
    df = spark.createDataFrame(rows, "k int, i int, d date, v int")
    out = features.rolling_days(df, "k", "d", "v", days=14, name="r")
    assert collect(out) == [1, 3, 6]


def test_rolling_rejoin_counts_reference_rows(spark):
    d1, d2 = dt.date(2017, 1, 1), dt.date(2017, 1, 2)
    df = spark.createDataFrame([(1, 0, d1, 1), (1, 1, d1, 2), (1, 2, d2, 3)], "k int, i int, d date, v int")
    out = features.rolling_rejoin(df, "k", "d", ["d", "i"], "v", name="r")
    # the reference's rejoin repeats each row once per row of its day: 2*2 + 1 = 5
    assert out.agg(F.sum("rejoin_copies")).first()[0] == 5
    assert out.count() == 3


def test_rejoin_emits_every_pair_of_a_day(spark):
    d1, d2 = dt.date(2017, 1, 1), dt.date(2017, 1, 2)
    rows = [(1, 0, d1, 1), (1, 1, d1, 2), (1, 2, d2, 3), (1, 3, None, 4), (1, 4, None, 5), (None, 5, d1, 6), (None, 6, d1, 7)]
    df = spark.createDataFrame(rows, "k int, i int, d date, v int")
    # the fixture's two keys: 2*2 + 1 rows from 3, here with the pairs of a missing day and a missing key
    own = {0: 1, 1: 3, 2: 6, 3: 10, 4: 15, 5: 6, 6: 13}
    days = [(0, 1), (2,), (3, 4), (5, 6)]
    want = sorted((a, own[b], len(g), min(own[x] for x in g), max(own[x] for x in g)) for g in days for a in g for b in g)
    out = features.rolling_rejoin_rows(df, "k", "d", ["d", "i"], "v", name="r", segment_rows=20)
    assert len(want) == 13
    assert sorted(tuple(x) for x in out.select("i", "r", "rejoin_copies", "r_min", "r_max").collect()) == want


def test_tie_rounding_half_even(spark):
    df = clean.round_even(one_col(spark, [0.125, 0.375], "double"), ["v"], 2)
    assert collect(df, "v") == [0.12, 0.38]


def test_gate_by_flag(spark):
    df = spark.createDataFrame([(0, 0, 7.0), (1, 1, 7.0), (2, None, 7.0)], "i int, f int, x double")
    assert collect(clean.gate_by_flag(df, "f", ["x"]), "x") == [0.0, 7.0, None]


def test_to_date_and_weekend(spark):
    df = one_col(spark, ["2017/05/01", "2017-05-01", "bad"]).select("i", C.to_date_safe("v").alias("r"))
    assert collect(df) == [dt.date(2017, 5, 1), dt.date(2017, 5, 1), None]
    w = spark.createDataFrame([(0, dt.date(2017, 5, 6)), (1, dt.date(2017, 5, 8))], "i int, d date")
    assert collect(w.select("i", C.weekend_flag("d").alias("r"))) == [True, False]


def test_collapse_levels_first_match_wins(spark):
    df = one_col(spark, ["Fast Food Pizza", "Pizza", "Sushi", None])
    out = clean.collapse_levels(df, "v", ["Fast Food", "Pizza"], "Others")
    assert collect(out, "v") == ["Fast Food", "Pizza", "Others", None]


def test_label_text_and_num(spark):
    df = spark.createDataFrame([(0, 2), (1, 0), (2, None), (3, 1)], "i int, h int")
    assert collect(clean.label_text(df, "h", "r")) == ["ch_in", "Noch_in", None, "ch_in"]
    assert collect(clean.label_num(df, "h", "r")) == [0, 0, None, 1]


def test_bool_to_num(spark):
    df = clean.bool_to_num(one_col(spark, ["TRUE", "FALSE", None, "True"]), ["v"])
    assert collect(df, "v") == [1, 0, None, 0]


def test_segmented_rolling_equals_plain_window(spark):
    import random
    random.seed(9)
    rows = [(k, dt.date(2017, 1, 1) + dt.timedelta(days=random.randint(0, 30)), i,
             None if random.random() < 0.03 else float(random.randint(0, 9)))
            for i in range(3000) for k in [0 if i % 3 else random.randint(1, 5)]]   # key 0 is hot
    df = spark.createDataFrame(rows, "k long, d date, i long, v double")
    plain = features.rolling_rows(df, "k", ["d", "i"], "v", before=14, name="r")
    seg = features.rolling_rows_segmented(df, "k", "d", ["i"], "v", before=14, name="r", segment_rows=50)
    a = {r["i"]: r["r"] for r in plain.collect()}
    b = {r["i"]: r["r"] for r in seg.collect()}
    assert a == b and len(b) == 3000
