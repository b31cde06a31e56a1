"""Described rules on hand-written rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import texts
from tapeworks.operators import candles, knowledge, portfolio, risk
from tapeworks.plans.pairs import cov, pair_sums


def one(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_text_marks(spark):
    rows = [("$BTC up, $BTCUSDT not", "[TICKER_BTC] up, $BTCUSDT not"), ("@müller_1 said #größe", "[MENTION] said größe"), ("see https://x.y/z?q=1 now \n ok", "see [URL] now ok"), ("$ETHé", "$ETHé")]
    got = one(spark, "t string", [(a,) for a, _ in rows]).select("t", texts.clean(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == dict(rows)
    spam = one(spark, "t string", [("ÄÖÜÄÖÜÄÖÜÄÖÜ a",), ("quiet words in a row",), ("short",), ("please click here for more",)])
    assert [r[0] for r in spam.select(texts.is_spam(F.col("t"))).collect()] == [True, False, True, True]


def test_best_path_counts_direct_edges(spark):
    direct = one(spark, "k string, o string, score double", [("r", "s1", 0.9), ("r", "s2", 0.1)])
    first = one(spark, "k string, m string, p1 double", [("r", "i", 0.5)])
    second = one(spark, "m string, o string, p2 double", [("i", "s1", 0.8), ("i", "s2", 0.8)])
    got = {r.o: r.score for r in knowledge.best_path(direct, first, second, "k", "m", "o").collect()}
    assert got == {"s1": 0.9, "s2": 0.4}


def test_removal_takes_edges_at_both_ends(spark):
    nodes = one(spark, "id string", [("a",), ("b",), ("c",)])
    edges = one(spark, "source string, target string", [("a", "b"), ("b", "c"), ("a", "c")])
    kept, left = knowledge.remove_nodes(nodes, edges, one(spark, "id string", [("b",)]))
    assert sorted(r.id for r in kept.collect()) == ["a", "c"] and [tuple(r) for r in left.select("source", "target").collect()] == [("a", "c")]


def test_closure_of_a_long_chain_and_a_cycle(spark):
    edges = one(spark, "child int, parent int", [(i, i - 1) for i in range(1, 40)] + [(100, 101), (101, 100)])
    got = knowledge.dependents(edges).collect()
    assert sum(r.child < 100 for r in got) == 39 * 40 // 2
    assert {(r.child, r.parent, r.cyclic) for r in got if r.child >= 100} == {(a, b, True) for a in (100, 101) for b in (100, 101)}


def test_triangles_once_with_hubs(spark):
    rng = np.random.default_rng(1)
    e = {(int(a), int(b)) for a, b in zip(rng.integers(0, 25, 260), rng.integers(0, 25, 260))} | {(0, k) for k in range(25)}
    want = {(a, b, c) for a in range(25) for b in range(25) for c in range(25) if len({a, b, c}) == 3 and a == min(a, b, c) and {(a, b), (b, c), (c, a)} <= e}
    got = [tuple(r) for r in knowledge.triangles(one(spark, "source int, target int", sorted(e))).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_triangles_in_cells_of_node_groups(spark):
    rng = np.random.default_rng(2)
    e = {(f"n{a}", f"n{b}") for a, b in zip(rng.integers(0, 30, 300), rng.integers(0, 30, 300))} | {("n0", f"n{k}") for k in range(30)}
    rows = one(spark, "source string, target string", sorted(e) + [(None, "n1"), ("n1", None)])
    ids = [f"n{k}" for k in range(30)]
    want = {(a, b, c) for a in ids for b in ids for c in ids if len({a, b, c}) == 3 and a == min(a, b, c) and {(a, b), (b, c), (c, a)} <= e}
    x = knowledge.triangles(rows, cell_edges=20, wedges=50)
    assert sorted(map(tuple, x.collect())) == sorted(want)
    assert "SortMergeJoin [b" not in x._jdf.queryExecution().executedPlan().toString()      # wedges stay in their cell
    assert knowledge.triangles(rows.where("source = 'n0'")).collect() == []


def test_stress_deepens_losses(spark):
    pos = one(spark, "leverage double, signed double", [(1.0, 100.0)])
    now = {r.scenario: r.total_pnl for r in risk.stress(pos).collect()}
    plain = {r.scenario: r.total_pnl for r in risk.stress(pos, penalty=False).collect()}
    old = {r.scenario: r.total_pnl for r in risk.stress(pos, compat=True).collect()}
    changed = [k for k in now if now[k] != plain[k]]
    assert changed and all(now[k] == pytest.approx(plain[k] - 0.2 * abs(plain[k])) and old[k] == pytest.approx(0.8 * plain[k]) for k in changed)


def test_pair_sums_of_many_assets_and_groups(spark):
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=(12, 600))
    df = one(spark, "g int, t int, a bigint, v double", [(t % 2, t, int(1000 * k + 7), float(x[t, k])) for t in range(12) for k in range(600)])
    got = pair_sums(df, ["t"], "a", "v", group="g").where("i % 50000 = 7 and j % 70000 = 7").select("g", "i", "j", cov().alias("c")).collect()
    assert len(got) > 100
    for r in got:
        rows = x[[t for t in range(12) if t % 2 == r.g]]
        assert r.c == pytest.approx(np.cov(rows[:, r.i // 1000], rows[:, r.j // 1000])[0, 1], abs=1e-8)


def test_few_rows_give_the_identity(spark):
    df = one(spark, "t int, asset bigint, ret double", [(t, a, float(t * a)) for t in range(9) for a in (1, 2)])
    assert {(r.i, r.j, r.cov, r.corr) for r in risk.covariances(df).collect()} == {(1, 1, 1.0, 1.0), (1, 2, 0.0, 0.0), (2, 2, 1.0, 1.0)}


def test_value_area_beyond_a_hundred_bins(spark):
    rows = [("x", b, 1.0) for b in range(300)] + [("x", 250, 0.0)]
    lv = one(spark, "symbol string, bin int, vol double", rows).groupBy("symbol", "bin").agg(F.sum("vol").alias("vol")).withColumn("vol", F.when(F.col("bin") == 250, 500.0).otherwise(F.col("vol")))
    r = candles.value_area(lv, ["symbol"]).first()
    assert (r.poc, r.area_lo <= 250 <= r.area_hi) == (250, True)


def test_bounded_weights_and_cvar(spark):
    w = portfolio.bounded_project(np.array([3.0, 1.0, -2.0, 0.1]), 0.05, 0.5)
    assert w.sum() == pytest.approx(1) and w.min() >= 0.05 - 1e-9 and w.max() <= 0.5 + 1e-9
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, [0.01, 0.03, 0.05], (200, 3))
    df = one(spark, "t int, asset int, ret double", [(t, a, float(x[t, a])) for t in range(200) for a in range(3)])
    assets, w, best, equal = portfolio.min_cvar(df, tolerance=1e-2)

    def cvar(v):
        p = np.sort(x @ v)
        return -p[p <= np.quantile(p, 0.05)].mean()

    assert assets == [0, 1, 2] and equal == pytest.approx(cvar(np.full(3, 1 / 3)), rel=1e-9) and best == pytest.approx(cvar(w), rel=1e-9)
    grid = min(cvar(np.array([a, b, 1 - a - b])) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41))
    assert best <= grid * 1.05


def test_exposures_of_a_flat_symbol(spark):
    rows = [("a", 1, 0.0, 0.0, 1.0), ("b", 1, 30.0, -30.0, 2.0), ("c", 2, None, None, 1.0)]
    got = {(r.nation, r.symbol): r for r in risk.exposure_sets(one(spark, "symbol string, nation int, notional double, signed double, leverage double", rows)).collect()}
    assert np.isnan(got[None, "a"].hhi) and got[None, "a"].gross_exposure == 0 and got[None, "b"].hhi == 1 and got[1, None].hhi == 1
    assert got[None, "c"].hhi is None and got[None, None].net_exposure == -30
