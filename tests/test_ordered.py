"""Order of any id type, ties that one score or one group shares."""

import random

import pytest
from pyspark.sql import functions as F

from tallystack.operators import evaluate
from tallystack.operators.ordered import grouped_prefix, ordered_prefix

IDS = {"text": lambda i: f"cust-{i:06d}", "long": lambda i: 2**60 + i, "int": lambda i: i}


@pytest.mark.parametrize("kind", sorted(IDS))
def test_ranks_are_exact_for_every_id_type(spark, kind):
    rnd = random.Random(kind)
    rows = [(IDS[kind](i), 0.5 if i % 3 == 0 else round(rnd.random(), 3), int(rnd.random() < 0.3)) for i in range(3000)]
    rnd.shuffle(rows)
    schema = f"id {'string' if kind == 'text' else 'long'}, s double, y int"
    df = spark.createDataFrame(rows, schema)
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    for parts in (1, 7):
        got = ordered_prefix(df.repartition(parts), "s", "id", sums={"c": F.col("y")}).collect()
        assert {r["id"]: r["rank"] for r in got} == want
        run = 0
        for r in sorted(got, key=lambda r: r["rank"]):
            run += r["y"]
            assert r["c"] == run
    m = evaluate.lift_metrics(df, "s", "y", "id").collect()
    assert m[0]["n"] == 3000


def test_a_shared_score_is_split_over_buckets(spark, tmp_path):
    n = 40_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("s"))
    b = (df.repartitionByRange(64, F.col("s").desc_nulls_last(), F.col("id").asc_nulls_last())
         .groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
    assert b < 4 * n / 64


def test_groups_with_one_value(spark):
    rows = [(g, 0.5 if g else i / 1000, i, i % 2) for g in range(3) for i in range(1000)]
    got = grouped_prefix(spark.createDataFrame(rows, "g int, v double, id long, y int"), "g", "v", ["id"], descending=True,
                         sums={"c": F.col("y")}).collect()
    for g in range(3):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 1001)) and mine[-1]["c"] == mine[-1]["c_total"] == 500
        assert [r["id"] for r in mine] == (list(range(1000)) if g else list(range(999, -1, -1)))
    empty = spark.createDataFrame([], "g int, v double, id long, y int")
    assert grouped_prefix(empty, "g", "v", ["id"], sums={"c": F.col("y")}).count() == 0


def test_tasks_of_the_segmented_sum_follow_the_rows(spark, monkeypatch):
    """Twenty times the rows, twenty times the tasks: none sorts more."""
    import datetime
    from tallystack.operators import features
    monkeypatch.setattr(features, "TASK_ROWS", 50)
    day = datetime.date(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(i % 7), i, float(i % 5)) for k in range(4) for i in range(1000 if k == 0 else 40)]
    df = spark.createDataFrame(rows, "k long, day date, i long, v double")
    whole = features.rolling_rejoin(df, "k", "day", ["day", "i"], "v", 3, True, "s", segment_rows=20)
    plain = features.rolling_rejoin(df, "k", "day", ["day", "i"], "v", 3, True, "s")
    cols = ["k", "day", "i", "v", "s", "rejoin_copies", "s_min", "s_max"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))
    assert features.tasks_for(df) == 23
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 23), REPARTITION_BY_NUM") >= 3
