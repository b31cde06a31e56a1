"""Numbers without a SQL form: closed forms, invariants, independent loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.functions.draws import erf, md5_mod_100, uniform
from tapeworks.operators import drift, monitors, portfolio as P, stats, strategies as Y
from tapeworks.plans.fold import ordered_fold
from tapeworks.plans.series import Series
from tapeworks.sources import store


def test_erf_and_probit(spark):
    xs = [(-6.0,), (-3.2,), (-1.5,), (-0.1,), (0.0,), (0.5,), (2.9,), (3.0,), (4.5,)]
    for r in spark.createDataFrame(xs, "x double").select("x", erf(F.col("x")).alias("e")).collect():
        assert abs(r.e - math.erf(r.x)) < 1e-13
    ps = [(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999)]
    for r in spark.createDataFrame(ps, "p double").select("p", stats.probit(F.col("p")).alias("z")).collect():
        assert abs(0.5 * (1 + math.erf(r.z / math.sqrt(2))) - r.p) < 1e-8


def test_student_p(spark):
    # closed forms: 1 degree of freedom is Cauchy, 2 is t / sqrt(2 + t^2)
    rows = [(t, n) for t in (-3.0, 0.0, 0.4, 2.5, 12.0) for n in (1.0, 2.0)]
    for r in spark.createDataFrame(rows, "t double, n double").select("t", "n", drift.student_p(F.col("t"), F.col("n")).alias("p")).collect():
        want = 1 - 2 / math.pi * math.atan(abs(r.t)) if r.n == 1 else 1 - abs(r.t) / math.sqrt(2 + r.t**2)
        assert abs(r.p - want) < 1e-9


def test_md5_split(spark):
    import hashlib

    ids = [(str(i),) for i in range(200)]
    for r in spark.createDataFrame(ids, "k string").select("k", md5_mod_100(F.col("k")).alias("m")).collect():
        assert r.m == int(hashlib.md5(r.k.encode()).hexdigest(), 16) % 100


def test_uniform_draws(spark):
    a = spark.range(20000).repartition(7).select("id", uniform("id", seed="1").alias("u"))
    b = spark.range(20000).repartition(3).select("id", uniform("id", seed="1").alias("u"))
    assert a.exceptAll(b).count() == 0
    row = a.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(row[0] - 0.5) < 0.01 and 0 < row[1] and row[2] < 1


@pytest.fixture(scope="module")
def moments():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(6, 6))
    return rng.uniform(0.01, 0.1, 6), a @ a.T / 6 + np.eye(6) * 0.1


def test_solvers(moments):
    mu, cov = moments
    for name, solve in P.SOLVERS.items():
        w = solve(mu, cov)
        assert abs(w.sum() - 1) < 1e-6 and w.min() > -1e-9, name
    rc = P.risk_parity(mu, cov) * (cov @ P.risk_parity(mu, cov))
    assert np.ptp(rc / rc.sum()) < 1e-6
    w = P.max_diversification(mu, cov)
    ratio = lambda x: x @ np.sqrt(np.diag(cov)) / np.sqrt(x @ cov @ x)
    rng = np.random.default_rng(0)
    assert all(ratio(w) >= ratio(x) - 1e-4 for x in rng.dirichlet(np.ones(6), 2000))
    sh = lambda x: x @ mu / np.sqrt(x @ cov @ x)
    assert all(sh(P.max_sharpe(mu, cov)) >= sh(x) - 1e-4 for x in rng.dirichlet(np.ones(6), 2000))


def test_phillips_perron_and_unit_root(spark):
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=300)) + 50
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "k int, t bigint, y double")
    s = Series.of(df, ["k"], ["t"])
    got = stats.unit_root(s, "y").first()
    dy, x = np.diff(y)[1:], np.column_stack([np.ones(298), y[1:-1], np.diff(y)[:-1]])
    b, *_ = np.linalg.lstsq(x, dy, rcond=None)
    e = dy - x @ b
    se = np.sqrt(e @ e / (298 - 3) * np.linalg.inv(x.T @ x)[1, 1])
    assert abs(got.t_stat - b[1] / se) < 1e-6
    x = np.column_stack([np.ones(299), y[:-1]])
    b, *_ = np.linalg.lstsq(x, y[1:], rcond=None)
    e = y[1:] - x @ b
    g = [e[k:] @ e[: len(e) - k] / 299 for k in range(5)]
    lam = g[0] + 2 * sum((1 - k / 5) * g[k] for k in range(1, 5))
    s2 = e @ e / 297
    se = np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
    want = np.sqrt(g[0] / lam) * (b[1] - 1) / se - 0.5 * (lam - g[0]) / np.sqrt(lam) * 299 * se / np.sqrt(s2)
    assert abs(stats.phillips_perron(s, "y").first().z_t - want) < 1e-6


def test_haar_denoise_inverts(spark):
    df = spark.createDataFrame([(0, i, float(i * i % 17)) for i in range(21)], "k int, t bigint, y double")
    out = stats.haar_denoise(Series.of(df, ["k"], ["t"]), "y", 0.0).df.toPandas().sort_values("t")
    assert np.allclose(out["denoised"], out["y"])


def test_detectors_find_a_change(spark):
    rng = np.random.default_rng(1)
    err = np.concatenate([rng.random(500) < 0.1, rng.random(500) < 0.6]).astype(float)
    df = spark.createDataFrame([(0, i, float(e)) for i, e in enumerate(err)], "k int, i bigint, e double")
    got = monitors.detectors(df, ["k"], ["i"], "i", "e").where("event = 'drift'").toPandas()
    for name in ("ddm", "adwin"):
        at = got[got.detector == name]["i"]
        assert ((at >= 500) & (at < 650)).any(), name


def test_backtest_accounting(spark):
    rows = [(0, t, c, c + 1, c - 1, 1.0, s, x, False) for t, c, s, x in [(0, 100.0, 1, False), (1, 110.0, 0, False), (2, 120.0, 0, True)]]
    df = spark.createDataFrame([(a, b, c, d, e, f, g, h, i) for a, b, c, d, e, f, g, h, i in rows], "k int, t bigint, close double, high double, low double, atr double, signal int, exit_long boolean, exit_short boolean")
    tr = Y.backtest(df, ["k"], "t", 1000.0, 0.02, 0.0, 10.0).first()
    qty = 1000 * 0.02 / 2
    assert abs(tr.quantity - qty) < 1e-9 and abs(tr.pnl - ((120 - 100) * qty - (120 + 100) * qty * 0.001)) < 1e-9
    assert tr.holding_bars == 2 and abs(tr.mfe - 21 * qty) < 1e-9
    old = Y.backtest(df, ["k"], "t", 1000.0, 0.02, 5.0, 10.0, compat=True).first()
    new = Y.backtest(df, ["k"], "t", 1000.0, 0.02, 5.0, 10.0).first()
    assert old.exit_price == new.exit_price and old.pnl != new.pnl


def test_store_prunes(spark, tmp_path):
    st = store.CandleStore(spark, str(tmp_path / "c"))
    df = spark.range(100).selectExpr(
        "timestamp_ntz'2024-01-01' + make_interval(0,0,0,cast(id as int)) open_time", "id % 5 symbol", "'x' exchange", "if(id % 2 = 0, '1d', '1h') timeframe",
        *[f"1.0D {c}" for c in ("open", "high", "low", "close", "volume", "quote_volume")], "1L trades", "1.0D taker_buy_volume", "1.0D taker_buy_quote",
    )
    st.write(df)
    got = st.read("x", "1d", 2, ["open_time", "close"], start="2024-01-10", end="2024-03-01")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(exchange" in plan and "GreaterThanOrEqual(open_time" in plan and "high" not in plan
    assert got.count() == df.where("timeframe = '1d' and symbol = 2 and open_time between timestamp_ntz'2024-01-10' and timestamp_ntz'2024-03-01'").count()
    assert st.exists("x", "1d", 2) and not st.exists("x", "1d", 9) and st.symbols("x").count() == 5


def test_rank_tests_of_millions_of_rows(spark):
    n = 2_000_000        # n * n * (2 n + 1) is more than a bigint
    rows = spark.range(2 * n).select(F.lit("f").alias("feature"), F.when(F.col("id") < n, "reference").otherwise("current").alias("part"), (F.col("id") % 1000 * 1.0 + F.when(F.col("id") < n, 0.0).otherwise(100.0)).alias("value"))
    r = drift.rank_tests(rows).first()
    less = sum(max(0, v - 100) + 0.5 * (v >= 100) for v in range(1000)) * (n / 1000) ** 2      # reference above current, ties half
    z = (less - n * n / 2) / math.sqrt(n * n * (2 * n + 1) / 12)
    assert (r.m, r.n) == (n, n) and r.ks == pytest.approx(0.1) and r.u_statistic == pytest.approx(less, rel=1e-12) and r.rank_z == pytest.approx(z, rel=1e-9) and r.ks_p == 0


def test_parts_are_compared_without_moving_rows(spark):
    rows = spark.createDataFrame([("f", "reference" if i % 2 else "current", float(i)) for i in range(100)], "feature string, part string, value double").repartition(4)
    for x in (drift.psi(rows), drift.histogram(rows, 5)):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan


def test_quartile_counts_leave_rows_where_they_are(spark):
    from tapeworks.catalog.models import quartile_counts

    rows = spark.createDataFrame([("f", i % 2, float(i)) for i in range(9)], "feature string, label_class int, value double")
    x = quartile_counts(rows)
    assert "strategy=broadcast" in x._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.bin, r.y): r.n for r in x.collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1, (2, 0): 1, (2, 1): 1, (3, 0): 2, (3, 1): 1}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_streaks_across_tasks(spark, monkeypatch, parts):
    from itertools import groupby

    from tapeworks.operators import reports

    rng = np.random.default_rng(8)
    rows = []
    for k, n, p in (("a", 400, 0.5), ("b", 300, 0.97), ("c", 1, 0.0), ("d", 90, 0.02), ("e", 60, 1.0)):
        for t in range(n):
            pnl = None if k in "ab" and t % 41 == 0 else 1.0 if rng.random() < p else -1.0
            rows.append((k, t, 1.0, pnl))
    rows += [("f", t, 1.0, None) for t in range(3)] + [(None, 1, 1.0, 2.0)]

    def longest(k, sign):
        of = [None if r[3] is None else r[3] > 0 for r in rows if r[0] == k]
        return max((len(list(g)) for w, g in groupby(of) if w is sign), default=0)

    # the trades aren't dealt as a series, whose sliced form stores and joins whole rows
    monkeypatch.setattr(reports.Series, "of", None)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.createDataFrame(rows, "k string, t int, hours double, pnl double").repartition(5)
        got = {r.k: (r.consecutive_wins, r.consecutive_losses) for r in reports.trade_statistics(df, ["k"], ["t"]).collect()}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert got == {k: (longest(k, True), longest(k, False)) for k in "abcdef"}


def test_forest_makes_its_features_once(spark, monkeypatch):
    from tapeworks.catalog import models

    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    rng = np.random.default_rng(5)
    feats = rng.normal(0, 1, (300, len(models.MLC)))
    rows = [("a", t, *map(float, f), int(np.sign(round(f[0])))) for t, f in enumerate(feats)]
    cols = ", ".join(f"{n} double" for n in models.MLC)
    df = spark.createDataFrame(rows, f"symbol string, t bigint, {cols}, label_class int")
    df = df.withColumn("ret_1", F.udf(count, "double").asNondeterministic()("ret_1"))
    monkeypatch.setattr(models, "matrix", lambda *a: df)
    got = models.l01(spark, "").collect()
    assert len(got) == len(models.MLC) - 1 and abs(sum(r.importance for r in got) - 1) < 1e-4
    assert seen.value == 300
