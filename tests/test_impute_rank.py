"""Imputation by rank: draws, posterior parameters, cross products."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystack.operators import impute
from tallystack.operators.models.gram import gramian, posterior_draw


def uniform(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32


@pytest.mark.parametrize("limit", [256, 3])
def test_marginal_draws_equal_ranks(spark, monkeypatch, limit):
    monkeypatch.setattr(impute, "MAX_LEVELS", limit)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1.5, 2.0, -3.0, 7.0, float(rnd.randrange(40))]), rnd.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b string")
    got = {(r.imp, r.k): (r.a, r.b) for r in impute.impute_marginal(df, ["a", "b"], "k", m=3, seed=9).collect()}
    seen = [sorted(v for v in col if v is not None) for col in list(zip(*rows))[1:]]
    for k, a, b in rows:
        for imp in (1, 2, 3):
            want = [v if v is not None else s[math.floor(uniform(9, imp, c, k) * len(s))] for v, s, c in zip((a, b), seen, "ab")]
            assert got[imp, k] == tuple(want)
    assert len(got) == 900


def test_marginal_without_observed_values_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, a double")
    assert [r.a for r in impute.impute_marginal(df, ["a"], "k", m=1).collect()] == [None, None]
    assert impute.impute_marginal(df.limit(0), ["a"], "k", m=1).count() == 0


def test_rank_draws_are_linear_in_missing_cells(spark, monkeypatch):
    """Every missing cell meets one row: the join on the rank multiplies nothing."""
    monkeypatch.setattr(impute, "MAX_LEVELS", 0)
    for n in (500, 2000):
        df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.rand(1)).alias("a"))
        out = impute.impute_marginal(df, ["a"], "k", m=2)
        assert out.count() == 2 * n and out.where("a IS NULL").count() == 0
        ranks = impute.ranked_values(df, "a", ["k"])
        assert ranks.count() == ranks.select("rank").distinct().count() == n // 2


def test_gramian_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x, y, w, g = rng.normal(size=(400, 6)), rng.normal(size=400), rng.random(400), rng.integers(0, 3, 400)
    rows = [([float(v) for v in x[i]], float(y[i]), float(w[i]), int(g[i])) for i in range(400)] + [(None, 1.0, 1.0, 0), ([float("nan")] * 6, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "x array<double>, y double, w double, g int").repartition(5)
    got = gramian(df, "x", ["y"], "w", "g")
    z = np.column_stack([np.ones(400), x, y])
    for k in range(3):
        np.testing.assert_allclose(got[k], (z[g == k].T * w[g == k]) @ z[g == k], rtol=1e-9)
    np.testing.assert_allclose(gramian(df, "x")[None], z[:, :-1].T @ z[:, :-1], rtol=1e-9)
    assert gramian(df.limit(0), "x") == {}


def test_posterior_draws_follow_least_squares():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(500), rng.normal(size=(500, 2))])
    y = x @ [1.0, 2.0, -0.5] + rng.normal(scale=0.7, size=500)
    z = np.column_stack([x, y])
    draws = [posterior_draw(z.T @ z, np.random.default_rng(i), 0.0) for i in range(4000)]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = ((y - x @ beta) ** 2).sum()
    np.testing.assert_allclose(draws[0][0], beta, rtol=1e-8)
    b = np.array([d[1] for d in draws])
    np.testing.assert_allclose(b.mean(0), beta, atol=0.01)
    np.testing.assert_allclose(np.cov(b.T), np.linalg.inv(x.T @ x) * rss / 495, rtol=0.15, atol=2e-4)
    assert np.mean([d[2] ** 2 for d in draws]) == pytest.approx(rss / 495, rel=0.02)


@pytest.mark.parametrize("method", ["residual", "normal", "pmm"])
def test_chained_numbers_recover_the_relation(spark, method):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        x = rnd.uniform(-2, 2)
        rows.append((i, None if i % 4 == 0 else 3 * x + 1 + rnd.gauss(0, 0.2), x, rnd.choice("pq")))
    df = spark.createDataFrame(rows, "k long, a double, x double, c string")
    out = impute.impute_chained(df, {"a": ["x", "c"]}, "k", m=2, max_iter=1, seed=5, numeric_method=method).collect()
    assert len(out) == 1200
    by = {(r.imp, r.k): r.a for r in out}
    gap = [by[i, k] - (3 * x + 1) for i in (1, 2) for k, a, x, _c in rows if a is None]
    assert all(by[i, k] == a for i in (1, 2) for k, a, _x, _c in rows if a is not None)
    assert abs(np.mean(gap)) < 0.1 and 0.1 < np.std(gap) < 0.4
    assert any(by[1, k] != by[2, k] for k, a, *_ in rows if a is None)


@pytest.mark.parametrize("method", ["residual", "pmm"])
def test_chained_tasks_follow_the_rows(spark, monkeypatch, method):
    """Copies are made by as many tasks as their rows need, with the same
    result; matching stores the columns it needs; the last draw is not written."""
    import tallystack.session as session
    rnd = random.Random(8)
    rows = [(i, None if i % 7 == 0 else rnd.randrange(50), rnd.choice("xyz"), rnd.random(), "unused") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, a int, c string, x double, note string").coalesce(1)
    parts, columns = [], []
    cut, keep = session.checkpoint, session.stored
    monkeypatch.setattr(session, "checkpoint", lambda d: parts.append(d.rdd.getNumPartitions()) or cut(d))
    monkeypatch.setattr(session, "stored", lambda d, name: columns.append(d.columns) or keep(d, name))

    def run():
        return sorted(map(tuple, impute.impute_chained(df, {"a": ["x", "c"]}, "k", m=2, max_iter=3, seed=5, numeric_method=method).collect()))
    want = run()
    monkeypatch.setattr(impute, "TASK_ROWS", 200)
    parts.clear()
    assert run() == want
    assert parts == [6]                                       # 1200 completed rows; one lineage cut before the only sweep
    assert all(r[1] is not None for r in want) and len(want) == 1200
    assert all("note" not in c for c in columns) and bool(columns) == (method == "pmm")
