"""Wavelets, bootstrap intervals, rank correlation, orders and budgets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import bootstrap, knowledge, portfolio, stats, wavelets
from tapeworks.plans.series import Series


@pytest.mark.parametrize("limits", [{}, {"max_rows": 40, "block_rows": 30}])
def test_wavelet_levels_and_inverse(spark, limits):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=150), "b": np.cumsum(rng.normal(size=73)), "c": rng.normal(size=5)}
    rows = [(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)]
    s = Series.of(spark.createDataFrame(rows, "k string, t int, x double").repartition(3), ["k"], ["t"], **limits)
    tables = wavelets.transform(s, "x", 2)
    for k, x in data.items():
        cur = np.concatenate([x, np.zeros(-(-(len(x) + 8) // 4) * 4 - len(x))])
        for t in tables:
            got = t.where(F.col("k") == k).orderBy("i").collect()
            at = (2 * np.arange(len(cur) // 2)[:, None] + np.arange(8)) % len(cur)
            a, d = cur[at] @ np.array(wavelets.LOW), cur[at] @ np.array(wavelets.HIGH)
            assert np.allclose([r.approx for r in got], a) and np.allclose([r.detail for r in got], d)
            cur = a
    back = wavelets.denoised(s, "x", 2, 0.0).orderBy("k", "t").collect()
    assert np.allclose([r.denoised for r in back], np.concatenate(list(data.values())), atol=1e-9)
    if not limits:
        flat = wavelets.denoised(s, "x", 2, 1e9).where("k = 'b'").orderBy("t").collect()
        assert np.var(np.diff([r.denoised for r in flat])) < np.var(np.diff(data["b"]))


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.exponential(size=120), "b": rng.normal(1, 2, size=60), "s": np.arange(3.0)}
    rows = [(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    one = bootstrap.intervals(Series.of(df.repartition(4), ["k"], ["t"]), bootstrap.mean("x"), 400, block=8, seed="7").collect()
    two = bootstrap.intervals(Series.of(df, ["k"], ["t"], max_rows=30, block_rows=25), bootstrap.mean("x"), 400, block=8, seed="7").collect()
    got = {r.k: r for r in one}
    for r in two:                                     # neither partitions nor slices change a draw
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(r[1:], got[r.k][1:]) if isinstance(a, float))
    for k in "ab":
        x, r = data[k], got[k]
        assert abs(r.estimate - x.mean()) < 1e-12 and abs(r.std_error / (x.std() / math.sqrt(len(x))) - 1) < 0.15
        for lo, hi in ((r.lower, r.upper), (r.bca_lower, r.bca_upper), (r.block_lower, r.block_upper)):
            assert lo < r.estimate < hi and abs((hi - lo) / (2 * 1.96 * x.std() / math.sqrt(len(x))) - 1) < 0.5
        j = np.array([np.delete(x, i).mean() for i in range(len(x))])
        d = j.mean() - j
        assert abs(r.acceleration - (d**3).sum() / (6 * (d**2).sum() ** 1.5)) < 1e-9
    assert got["a"].bca_upper > got["a"].upper and got["s"].estimate is None


def test_bootstrap_draws():
    u = bootstrap.draws(np.array([5, 10**6]).repeat(500), np.tile(np.arange(500), 2), 40)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.15
    n = bootstrap.times(u, np.full(1000, 0.7))
    assert abs(n.mean() - 0.7) < 0.03 and abs(n.var() - 0.7) < 0.05


@pytest.mark.parametrize("limits", [{}, {"max_rows": 40, "block_rows": 30}])
def test_kendall(spark, limits):
    rng = np.random.default_rng(3)
    rows = [(k, t, float(rng.integers(0, 30)), float(rng.integers(0, 12))) for k in "ab" for t in range(90)] + [("c", t, 1.0, float(t)) for t in range(5)]
    s = Series.of(spark.createDataFrame(rows, "k string, t int, x double, y double"), ["k"], ["t"], **limits)
    got = {r.k: r.tau for r in stats.kendall(s, "x", "y").collect()}
    for k in "ab":
        x, y = (np.array([r[c] for r in rows if r[0] == k]) for c in (2, 3))
        a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        assert abs(got[k] - (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())) < 1e-12
    assert got["c"] is None


def test_kendall_sorts_each_row_once(spark, monkeypatch):
    """Whole series pass in one plan without copies of rows; batches cut series anywhere."""
    monkeypatch.setattr(stats, "TOGETHER", 50)
    rng = np.random.default_rng(9)
    rows = [(k, t, float(rng.integers(0, 9)), None if t % 13 == 5 else float(rng.integers(0, 40))) for k in range(30) for t in range(3 + 7 * k)] + [(None, 1, 1.0, 2.0), (None, 2, 2.0, 1.0)]
    s = Series.of(spark.createDataFrame(rows, "k int, t int, x double, y double").repartition(3), ["k"], ["t"])
    df = stats.kendall(s, "x", "y")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {r.k: (r.n, r.tau) for r in df.collect()}
    assert set(got) == set(range(30))
    for k, (n, tau) in got.items():
        x, y = (np.array([r[i] for r in rows if r[0] == k and r[3] is not None]) for i in (2, 3))
        a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        free = (a * a).sum() * (b * b).sum()
        assert n == len(x) and (tau is None if free == 0 else abs(tau - (a * b).sum() / math.sqrt(free)) < 1e-12)


def test_layers(spark):
    e = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("z", "a"), ("b", "a")]
    got = {r.node: r.layer for r in knowledge.dependency_layers(spark.createDataFrame(e, "child string, parent string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None}


def test_tail_budgets(spark):
    rng = np.random.default_rng(4)
    size = np.array([0.5, 1.0, 2.0, 4.0])
    ret = rng.normal(0, 1, (1500, 4)) * size
    rows = [(t, a, float(ret[t, a])) for t in range(1500) for a in range(4)]
    want = {0: 0.4, 1: 0.3, 2: 0.2, 3: 0.1}
    got = {r.asset: r for r in portfolio.risk_budget(spark.createDataFrame(rows, "t int, asset int, ret double"), want).collect()}
    assert abs(sum(r.weight for r in got.values()) - 1) < 1e-9 and all(r.residual <= 0.1 and abs(r.share / want[a] - 1) <= 0.1 for a, r in got.items())
    w = np.array([got[a].weight for a in range(4)])
    p = ret @ w
    tail = ret[p <= np.quantile(p, 0.05)]
    share = -w * tail.mean(axis=0) / -(tail @ w).mean()
    assert np.abs(share - np.array(list(want.values()))).max() < 0.1
