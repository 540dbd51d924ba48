"""The reference's steps on small frames shaped like its inputs."""

import datetime as dt

from tallystack.plans import checkin


def frames(spark):
    def df(name, rows):
        return spark.createDataFrame(rows, checkin.SCHEMAS[name])
    hours = ['"09:30-12:15"', '"none"', "NULL", '"11:0-2:0"', '"09:30-09:30"', '"11:0-21:30"', '"09:30-01:30"']
    bools = ["TRUE", "FALSE", "NULL", "TRUE", "x", "TRUE", None, "TRUE", "TRUE", "FALSE"]
    biz = df("business", [("b1", *hours, "u'full_bar'", "'quiet'", *bools, "2", "Latin American",
                           -80.8, 35.2, 4.0, 10),
                          ("b2", *hours, "NULL", "u'loud'", *bools, None, "Pizza", -80.9, 35.3, 3.5, 5)])
    d1, d2, d3 = dt.date(2017, 5, 5), dt.date(2017, 5, 6), dt.date(2017, 5, 7)
    inputs = {
        "daily_checkins": df("daily_checkins", [("b1", d1, 1, 1, "2", "NULL"), ("b1", d2, 0, 1, "NULL", "3"),
                                                 ("b2", d1, 1, 0, "1", "1"), ("b2", d3, 0, 0, "1", "1")]),
        "weather": df("weather", [("2017/05/05", 70.0, 0.1), ("2017-05-06", 60.0, 0.0), ("2017/05/07", 65.0, 0.2)]),
        "photos": df("photos", [("b1", 3)]),
        "review_stats": df("review_stats", [("b1", 4.2, 10, 1, 2, 3), ("b2", 3.0, 2, 0, 0, 0)]),
        "reached_fans": df("reached_fans", [("b1", d1, 5.0), ("b1", d1, 2.0)]),
        "reached_friends": df("reached_friends", [("b2", d1, 4.0)]),
        "review_sentiment": df("review_sentiment", [(0, "b1", d1, "good", "POSITIVE", 0.9),
                                                    (1, "b1", d2, "bad", "NEGATIVE", 0.8)]),
        "tip_sentiment": df("tip_sentiment", [(0, "b1", d1, "ok", "POSITIVE", 0.7)]),
        "audience_avg": df("audience_avg", [("b1", 10.0, 2.0)]),
    }
    return biz, inputs


def test_clean_business(spark):
    biz, _ = frames(spark)
    b = {r["business_id"]: r for r in checkin.clean_business(biz).collect()}
    r = b["b1"]
    assert (r["open_hours_mon"], r["open_hours_tue"], r["open_hours_wed"], r["open_hours_thu"]) == (2.75, 0.0, 0.0, 15.0)
    assert r["open_hours_week"] == 2.75 + 15.0 + 24.0 + 10.5 + 16.0
    assert r["alcohol"] == "full_bar" and r["noise_level"] == "quiet" and r["categories"] == "Latin_American"
    assert b["b2"]["alcohol"] is None and "mon_open_hours" not in r.asDict()


def test_assemble_default_and_parity(spark):
    biz, inputs = frames(spark)
    b = checkin.clean_business(biz)
    d = {(r["business_id"], str(r["date"])): r for r in checkin.assemble_facts(b, inputs).collect()}
    assert len(d) == 4
    r = d[("b1", "2017-05-05")]
    assert r["n_reached_fans"] == 7.0 and r["reach"] == 7.0 + 0.0 + 2.0 + 10.0
    assert d[("b1", "2017-05-06")]["avg_n_fans_bus"] == 0.0            # no check-in that day
    assert r["share_positive_feedback"] == 0.67 and r["WE"] is False   # 2 of 3 labels positive
    assert d[("b2", "2017-05-05")]["reach"] is None                    # check-in day, audience missing
    assert d[("b2", "2017-05-07")]["reach"] == 0.0                     # no check-in: audience gated to 0
    assert d[("b1", "2017-05-06")]["cum_max_u_elite"] == 0.0
    # the reference's way: two different fans rows on (b1, 2017-05-05) survive
    # the full-row de-duplication, so that day appears twice
    p = checkin.assemble_facts(b, inputs, parity=True)
    assert p.count() == 5
    assert p.filter("business_id = 'b1' AND date = DATE'2017-05-05'").count() == 2


def test_training_tables(spark):
    biz, inputs = frames(spark)
    facts = checkin.assemble_facts(checkin.clean_business(biz), inputs)
    tr, ev, spec, thr = checkin.training_tables(facts)
    assert tr.count() + ev.count() == 4 and tr.count() == 3
    assert spec.label == "ch_in" and spec.label_text == "ch_in_string"
    assert "WE" in spec.categorical and "rolling_reach_sum" in spec.numeric and "stars_review" not in spec.numeric
    assert 0.0 <= thr <= 1.0


def test_impute_business_fills_price_range_only_where_missing(spark):
    import random
    from pyspark.sql import functions as F
    biz, _ = frames(spark)
    b = checkin.clean_business(biz).filter("business_id = 'b1'")
    random.seed(2)
    rows = b.collect()[0].asDict()
    gen = []
    for i in range(80):
        r = dict(rows)
        r["business_id"] = f"b{i}"
        r["price_range"] = None if i % 7 == 0 else str(1 + i % 3)
        r["noise_level"] = random.choice(["quiet", "loud", None])
        r["stars"] = float(i % 5)
        gen.append(r)
    df = spark.createDataFrame(gen, b.schema)
    out = checkin.impute_business(df, m=2, max_iter=1, keep=2)
    got = {r["business_id"]: r for r in out.collect()}
    assert len(got) == 80
    for r in gen:
        g = got[r["business_id"]]
        assert g["price_range"] in ("1", "2", "3")
        if r["price_range"] is not None:
            assert g["price_range"] == r["price_range"]
