"""The blocked form of a series equals the plain form, however it is sliced."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.catalog.features import moments, regime_features
from tapeworks.functions import averages as A
from tapeworks.functions import bands, oscillators as O, structure as S
from tapeworks.operators import reports, stats
from tapeworks.plans import series
from tapeworks.plans.joins import asof
from tapeworks.plans.quantiles import exact_percentiles
from tapeworks.plans.series import Series
from tapeworks.session import counted_by

BARS = "open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    """One hot series with half of all rows, several short ones."""
    rng = np.random.default_rng(7)
    rows = []
    for sym, n in ((0, 400), (1, 130), (2, 90), (3, 60), (4, 3), (5, 1)):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        o = np.concatenate([[100.0], c[:-1]])
        for i in range(n):
            h, l = max(o[i], c[i]) * (1 + rng.random() * 0.02), min(o[i], c[i]) * (1 - rng.random() * 0.02)
            rows.append((sym, i, float(o[i]), float(h), float(l), float(c[i]), float(rng.integers(1, 1000))))
    rng.shuffle(rows)
    rows = [(int(a), int(b), *map(float, r)) for a, b, *r in rows]
    return spark.createDataFrame(rows, "symbol bigint, t bigint, " + BARS).cache()


def both(bars, slice_rows):
    plain = Series.of(bars, ["symbol"], ["t"])
    cut = Series.of(bars, ["symbol"], ["t"], max_rows=10, block_rows=slice_rows)
    assert cut.blocked and not plain.blocked
    return plain, cut


OPS = {
    "sma": lambda s: A.sma(s, "close", 20),
    "ema": lambda s: A.ema(s, "close", 10),
    "tema": lambda s: A.tema(s, "close", 5),
    "kama": lambda s: A.kama(s, "close"),
    "smooth": lambda s: A.super_smoother(s, "close"),
    "macd": O.macd,
    "adx": O.adx,
    "crsi": lambda s: O.connors_rsi(s, 3, 20),
    "supertrend": bands.supertrend,
    "obv": bands.obv,
    "nvi": lambda s: bands.volume_index(s, True, "nvi"),
    "cycle": lambda s: bands.dominant_cycle(s, 4, 12),
    "patterns": S.patterns,
    "drawdown": S.drawdown,
    "cusum": lambda s: S.cusum(s.bounded(1, {"r": lambda w: F.coalesce(F.col("close") / w.lag("close") - 1, F.lit(0.0))}), "r"),
    "regime": lambda s: S.rolling_vol_regime(s, 10, 30),
    "lead": lambda s: s.bounded(2, {"x": lambda w: w.lead("close", 3) - w.lag("close", 2)}, ahead=3),
    "next": lambda s: s.mutate(_n=F.when(F.col("t") % 5 == 0, F.col("close"))).next_value(nx="_n").running(pv=("last", "_n"), ct=("count", "_n")),
    "totals": lambda s: s.totals(m=F.avg("close")),
}


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("slice_rows", [60])
def test_blocked_equals_plain(bars, op, slice_rows):
    plain, cut = both(bars, slice_rows)
    a = OPS[op](plain).df.toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    b = OPS[op](cut).df.toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)[a.columns]
    assert len(a) == len(b) == bars.count()
    for c in a.columns:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        if x.dtype.kind in "fi":
            np.testing.assert_allclose(y.astype(float), x.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
        else:
            assert (a[c].isna() == b[c].isna()).all() and (a[c].dropna() == b[c].dropna()).all(), c


def test_ema_equals_loop(bars):
    got = A.ema(Series.of(bars, ["symbol"], ["t"]), "close", 20).df.toPandas().sort_values(["symbol", "t"])
    for _, g in got.groupby("symbol"):
        x, want, k = g["close"].to_numpy(), [], 2 / 21
        for i in range(len(x)):
            want.append(np.nan if i < 19 else (x[:20].mean() if i == 19 else k * x[i] + (1 - k) * want[-1]))
        np.testing.assert_allclose(g["ema"].to_numpy(), want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_does_not_matter(spark, bars, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = O.rsi_wilder(Series.of(bars.repartition(parts), ["symbol"], ["t"])).df.agg(F.sum("rsi_wilder")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = O.rsi_wilder(Series.of(bars, ["symbol"], ["t"])).df.agg(F.sum("rsi_wilder")).first()[0]
    assert abs(got - want) < 1e-6


def test_exact_percentiles_hot_group(bars):
    pdf = bars.toPandas()
    for args in ({}, {"max_rows": 10, "block_rows": 60}):
        got = exact_percentiles(bars, ["symbol"], "volume", {"p1": 0.01, "p50": 0.5, "p99": 0.99}, **args).toPandas().set_index("symbol")
        for sym, g in pdf.groupby("symbol"):
            for n, p in (("p1", 1), ("p50", 50), ("p99", 99)):
                assert abs(got.loc[sym, n] - np.percentile(g["volume"], p)) < 1e-9


def test_asof_hot_key(bars):
    left = bars.select("symbol", F.col("t").alias("at"), F.col("close").alias("px"))
    right = bars.where("t % 7 = 3").select("symbol", F.col("t").alias("qt"), F.col("close").alias("mid"))
    plain = asof(left, right, ["symbol"], "at", "qt", ["mid", "qt"]).toPandas()
    cut = asof(left, right, ["symbol"], "at", "qt", ["mid", "qt"], max_rows=10, block_rows=50).toPandas()
    for got in (plain, cut):
        assert len(got) == left.count()
        ok = got.dropna()
        assert (ok["qt"] <= ok["at"]).all() and (ok["at"] - ok["qt"] < 7).all()
    key = ["symbol", "at"]
    assert plain.sort_values(key).reset_index(drop=True).equals(cut.sort_values(key).reset_index(drop=True))


def test_level_clusters_equal_greedy_loop(bars):
    got = S.level_clusters(Series.of(bars, ["symbol"], ["t"]), 2, 2, 1.0).toPandas()
    pdf = bars.toPandas().sort_values(["symbol", "t"])
    want = []
    for sym, g in pdf.groupby("symbol"):
        px = g["close"].iloc[-1]
        for kind, col, sign in (("resistance", "high", 1), ("support", "low", -1)):
            x = g[col].to_numpy() * sign
            lv = sorted(sign * x[i] for i in range(2, len(x) - 2) if x[i] >= max(x[i - 2 : i + 3]))
            cur = []
            for v in lv + [None]:
                if cur and (v is None or v - np.mean(cur) > max(v, px) * 0.01):
                    if len(cur) >= 2:
                        want.append((sym, kind, round(float(np.mean(cur)), 6), len(cur)))
                    cur = []
                if v is not None:
                    cur.append(v)
    assert sorted((r.symbol, r.kind, round(r.level, 6), r.touches) for r in got.itertuples()) == sorted(want)


def test_plain_windows_share_one_exchange(bars):
    s = A.sma(bands.bollinger(O.rsi(Series.of(bars.repartition(4, "t"), ["symbol"], ["t"]))), "close", 50)
    plan = s.df._jdf.queryExecution().sparkPlan().toString() + s.df._jdf.queryExecution().executedPlan().toString()
    executed = s.df._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(symbol") == 1
    assert "CartesianProduct" not in plan


def test_cheaper_count_decides_the_form(spark, monkeypatch):
    """The rows themselves are not read when their source has few of each key."""
    monkeypatch.setattr(series, "SMALL_BYTES", 0)
    source = spark.range(20).select((F.col("id") % 3).alias("k"), "id")
    costly = source.select("k", "id", F.raise_error(F.lit("read")).cast("double").alias("x")).groupBy("k", "id").agg(F.max("x").alias("x"))
    costly = costly.where("x is null")          # a count must read x
    s = Series.of(counted_by(costly, source), ["k"], ["id"])
    assert not s.blocked
    few = counted_by(source.where("id < 12"), source)
    assert Series.of(few, ["k"], ["id"], max_rows=3, block_rows=5).blocked
    assert not Series.of(few, ["k"], ["id"], max_rows=4, block_rows=5).blocked
    left = Series.of(source, ["k"], ["id"]).kept("id > 4")
    assert sorted((r.k, r.id, r._i) for r in left.rows.collect()) == sorted((i % 3, i, sum(j % 3 == i % 3 for j in range(5, i + 1))) for i in range(5, 20))


def walk(n, seed):
    x = 100 + np.cumsum(np.random.default_rng(seed).normal(size=n))
    return [float(v) for v in x]


def ragged(spark):
    """A long series with a gap and a flat stretch, one that ends in its warm-up."""
    data = {1: walk(180, 1), 2: walk(40, 2), 3: [7.0] * 150}
    data[1][20] = None
    rows = [(k, i, v, None if (k, i) == (1, 30) else float(i % 7 + 1)) for k, x in data.items() for i, v in enumerate(x)]
    return data, spark.createDataFrame(rows, "symbol bigint, t bigint, close double, volume double").repartition(5).cache()


@pytest.mark.parametrize("limits", [{}, {"max_rows": 10, "block_rows": 60}])
def test_rolling_moments_and_regimes(spark, limits):
    data, df = ragged(spark)
    s = Series.of(df, ["symbol"], ["t"], **limits)
    got = moments(s)
    assert "skewness" not in got.df._jdf.queryExecution().executedPlan().toString()   # one pass, no frame of aggregates
    w = Series.of(df, ["symbol"], ["t"])
    w = w.bounded(1, {"_r": lambda f: F.log(F.col("close") / f.lag("close"))})
    w = w.bounded(60, {"ret_mean": lambda f: f.full(61, F.avg("_r").over(f(60))), "ret_std": lambda f: f.full(61, F.stddev_pop("_r").over(f(60))), "ret_skew": lambda f: f.full(61, F.skewness("_r").over(f(60))), "ret_kurt": lambda f: f.full(61, F.kurtosis("_r").over(f(60))), "volume_ratio": lambda f: f.full(61, F.col("volume") / F.avg("volume").over(f(60)))})
    same(got.df, w.df, ["ret_mean", "ret_std", "ret_skew", "ret_kurt", "volume_ratio"])
    got = regime_features(s)
    assert "stddev_pop" not in got.df._jdf.queryExecution().executedPlan().toString()
    w = Series.of(df, ["symbol"], ["t"])
    w = w.bounded(1, {"r": lambda f: F.col("close") / f.lag("close") - 1})
    k = F.col("_i").cast("double")
    w = w.bounded(99, {
        "realised": lambda f: f.full(101, F.stddev_pop("r").over(f(20)) * 252 ** 0.5), "_long": lambda f: f.full(101, F.stddev_pop("r").over(f(100)) * 252 ** 0.5),
        "trend": lambda f: f.full(101, F.regr_slope(F.col("close"), k).over(f(50)) / F.avg("close").over(f(50))),
        "ad_score": lambda f: f.full(101, F.sum(F.col("r") * F.col("volume")).over(f(20)) / F.sum("volume").over(f(20))),
        "volume_pct": lambda f: f.full(101, F.avg("volume").over(f(20)) / F.avg("volume").over(f(100))),
        **{f"_c{j}": (lambda f, j=j: F.stddev_pop("r").over(f.span(-20 * (j + 1) + 1, -20 * j))) for j in range(5)},
    })
    same(got.df, w.df, ["realised", "_long", "trend", "ad_score", "volume_pct", *[f"_c{j}" for j in range(5)]])


def same(a, b, cols):
    x, y = ([tuple(r) for r in d.select("symbol", "t", *cols).orderBy("symbol", "t").collect()] for d in (a, b))
    assert len(x) == len(y)
    for p, q in zip(x, y):
        assert p[:2] == q[:2]
        for name, u, v in zip(cols, p[2:], q[2:]):
            assert (u is None) == (v is None) and (u is None or abs(u - v) < 1e-9 * max(1, abs(v))), (p[:2], name, u, v)


@pytest.mark.parametrize("limits", [{}, {"max_rows": 10, "block_rows": 60}])
def test_haar_energy_in_one_pass(spark, limits):
    data, df = ragged(spark)
    e = stats.haar_energy(Series.of(df, ["symbol"], ["t"], **limits), "close", 3)
    if not limits:      # no aggregate for each pair of each level
        assert e._jdf.queryExecution().executedPlan().toString().count("Aggregate(") <= 2
    got = {(r.symbol, r.level): (r.n, r.energy) for r in e.collect()}
    want = {}
    for k, x in data.items():
        cur = x
        for level in (1, 2, 3):
            pairs = [(a, b) if a is not None and b is not None else None for a, b in zip(cur[::2], cur[1::2])]
            d = [(p[0] - p[1]) / 2 ** 0.5 for p in pairs if p]
            if d:
                want[k, level] = (len(d), sum(v * v for v in d))
            cur = [(p[0] + p[1]) / 2 ** 0.5 if p else None for p in pairs]
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and abs(got[k][1] - v) < 1e-9 * max(1, v)


def test_equity_sums_trades_once(spark, monkeypatch):
    """Readers of a large curve don't read the trades again."""
    monkeypatch.setattr(reports, "SMALL_BYTES", 0)
    trades = spark.range(40).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).alias("day"), F.col("id").cast("double").alias("pnl"))
    eq = reports.equity_curve(trades, ["k"], "day", 100.0)
    assert "Range" not in eq._jdf.queryExecution().executedPlan().toString()
    want = [(k, d, 100.0 + sum(i for i in range(40) if i % 2 == k and i % 7 <= d)) for k in (0, 1) for d in range(7)]
    assert sorted((r.k, r.day, r.equity) for r in eq.collect()) == want


def test_percentiles_of_all_rows_are_sliced(spark, monkeypatch):
    from tapeworks.plans import quantiles

    cut, sliced = Series._sliced, []
    monkeypatch.setattr(quantiles, "SMALL_BYTES", 0)
    monkeypatch.setattr(quantiles, "WHOLE_ROWS", 50)
    monkeypatch.setattr(Series, "_sliced", classmethod(lambda cls, *a: sliced.append(1) or cut(*a)))
    v = np.round(np.random.default_rng(4).normal(0, 9, 700), 1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3)
    got = exact_percentiles(df, [], "v", {"p": 0.37, "q": 0.95}).first()
    assert sliced and got.n == 700
    assert abs(got.p - np.quantile(v, 0.37)) < 1e-9 and abs(got.q - np.quantile(v, 0.95)) < 1e-9
