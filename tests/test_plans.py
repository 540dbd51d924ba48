"""Physical-plan properties of the registered queries (scale discipline)."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

SQL_KEYS = sorted(E.oracle_sql())


def plan_text(df, mode=None):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode) if mode else df.explain()
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    qs = E.queries()
    return {n: plan_text(qs[n](spark, SF_SMALL)) for n in SQL_KEYS}


def test_no_cross_or_nested_loop_joins(plans):
    bad = [n for n, t in plans.items() if "CartesianProduct" in t or "BroadcastNestedLoopJoin" in t]
    assert not bad, bad


def test_filter_reaches_the_scan(spark):
    t = plan_text(E.queries()["filter_eq"](spark, SF_SMALL), "formatted")
    assert "EqualTo(l_suppkey,7)" in t


def test_flagship_scan_reads_only_used_columns(spark):
    t = plan_text(E.entry(spark), "formatted")
    li = [line for line in t.splitlines() if "ReadSchema" in line and "l_suppkey" in line]
    assert li and all(c not in li[0] for c in ("l_quantity", "l_tax", "l_partkey", "l_orderkey"))


def test_ordered_metrics_window_partitioned_by_bucket(plans):
    for n in ("lift_curve", "gini", "rank_by_score", "shuffle_split"):
        assert "hashpartitioning(_b" in plans[n], n


def test_sentiment_share_is_one_aggregation(plans):
    assert plans["sentiment_share"].count("Exchange hashpartitioning") == 1


def test_no_row_at_a_time_python(plans):
    """Python in a plan is only Arrow-batched (ArrowEvalPython, cogroups)."""
    bad = [n for n, t in plans.items() if "BatchEvalPython" in t]
    assert not bad, bad
    assert "ArrowEvalPython" in plans["model_knn"] or "FlatMapCoGroupsInPandas" in plans["model_knn"]
