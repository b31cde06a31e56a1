"""Draws from hashes of stable keys."""

import math

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.bands import TR
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.oscillators import UD
from tapeworks.catalog.risk import panel
from tapeworks.catalog.signals import bt_sql
from tapeworks.catalog.sql import ASSET, BARS, R, SERIES
from tapeworks.functions import bands
from tapeworks.functions.draws import uniform
from tapeworks.operators import strategies as Y
from tapeworks.plans.quantiles import exact_percentiles
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

c = lambda n: F.col(n)
U = lambda seed, key: f"((('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
SIMS = 200


@query(
    "b14_monte_carlo",
    f"""WITH RECURSIVE {BARS}, {UD}, {TR}, {bt_sql(30, 70)}, mt AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY t) AS j, count(*) OVER (PARTITION BY symbol) AS n FROM k WHERE pnl IS NOT NULL),
dr AS (SELECT symbol, sim, j AS pos, CAST(floor({U('31', "symbol || ':' || sim || ':' || j")} * n) + 1 AS BIGINT) AS pick FROM mt, range(0, {SIMS}) AS r(sim)), pt AS (SELECT d.symbol, sim, sum(pnl) AS total FROM dr d JOIN mt ON mt.symbol = d.symbol AND mt.j = d.pick GROUP BY 1, 2)
SELECT symbol, {R('quantile_cont(total, 0.05)', 1)} AS p05, {R('quantile_cont(total, 0.5)', 1)} AS p50, {R('quantile_cont(total, 0.95)', 1)} AS p95, {R('avg(CASE WHEN total < 0 THEN 1.0 ELSE 0 END)', 6)} AS loss_share FROM pt GROUP BY 1""",
)
def b14(spark, sf):
    """Trades resampled with replacement: a drawn position joins the indexed
    trades of its symbol; paths are grouped sums."""
    s = bands.atr(Y.rsi_cross(bar_series(spark, sf)), 14, "atr")
    tr = Y.backtest(s.df, ["symbol"], "t")
    ix = Series.of(tr, ["symbol"], ["exit_t"]).totals(n=F.count(F.lit(1))).rows.select("symbol", c(IDX).alias("j"), "n", "pnl")
    dr = ix.select("symbol", "j", "n", F.explode(F.sequence(F.lit(0), F.lit(SIMS - 1))).alias("sim"))
    dr = dr.select("symbol", "sim", (F.floor(uniform("symbol", "sim", "j", seed="31") * c("n")) + 1).alias("j"))
    pt = dr.join(ix.select("symbol", "j", "pnl"), ["symbol", "j"]).groupBy("symbol", "sim").agg(F.sum("pnl").alias("total"))
    q = exact_percentiles(pt, ["symbol"], "total", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).drop("n")
    loss = pt.groupBy("symbol").agg(F.avg(F.when(c("total") < 0, 1.0).otherwise(0.0)).alias("loss"))
    return q.join(loss, "symbol").select("symbol", *[r(k, 1).alias(k) for k in ("p05", "p50", "p95")], r("loss", 6).alias("loss_share"))


BOOT = 100
# Poisson(1) weights by inverse distribution: cumulative probabilities 0..5
POI = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(6)]


@query(
    "m09_bootstrap",
    f"""WITH {ASSET}, w AS (SELECT asset, b, ret, {' + '.join(f"CASE WHEN {U('37', 'asset || chr(58) || t || chr(58) || b')} > {p!r} THEN 1 ELSE 0 END" for p in POI)} AS w FROM ret, range(0, {BOOT}) AS r(b)),
m AS (SELECT asset, b, sum(w * ret) / sum(w) AS m FROM w GROUP BY 1, 2) SELECT asset, {R('quantile_cont(m, 0.025)', 6)} AS lower, {R('quantile_cont(m, 0.975)', 6)} AS upper, {R('stddev_samp(m)', 6)} AS std_error FROM m GROUP BY 1""",
)
def m09(spark, sf):
    """Bootstrap of the mean with Poisson weights: rows are never regrouped,
    each replicate is a weighted sum with map-side combine."""
    x = panel(spark, sf).select("asset", "t", "ret", F.explode(F.sequence(F.lit(0), F.lit(BOOT - 1))).alias("b")).withColumn("u", uniform("asset", "t", "b", seed="37"))
    w = sum((F.when(c("u") > p, 1).otherwise(0) for p in POI), F.lit(0))
    m = x.withColumn("w", w).groupBy("asset", "b").agg((F.sum(c("w") * c("ret")) / F.sum("w")).alias("m"))
    q = exact_percentiles(m, ["asset"], "m", {"lower": 0.025, "upper": 0.975}).drop("n")
    se = m.groupBy("asset").agg(F.stddev_samp("m").alias("se"))
    return q.join(se, "asset").select("asset", r("lower", 6).alias("lower"), r("upper", 6).alias("upper"), r("se", 6).alias("std_error"))


GA = lambda seed, key: f"sqrt(-2 * ln({U(seed + 'a', key)})) * cos(2 * pi() * {U(seed + 'b', key)})"
KEYS = "kind || chr(58) || sev || chr(58) || asset"
STRESS = {
    "market_crash": f"m - 0.1 * sev + {GA('41', KEYS)} * 0.05 * sev", "liquidity_crisis": f"m * (1 - 0.3 * sev) + 0.15 * sev * {GA('41', KEYS)}",
    "correlation_breakdown": f"m * (1 - 0.5 * sev) - 0.05 * sev + 0.1 * sev * {GA('43', 'kind || chr(58) || sev')}", "volatility_spike": f"m + 0.3 * sev * {GA('41', KEYS)}",
    "flash_crash": f"m - 0.2 * sev - 0.05 * sev * ln({U('47', KEYS)})", "depeg_event": f"m + CASE WHEN {U('47', KEYS)} < 0.3 THEN -0.15 ELSE 0 END * sev", "regulatory_shock": f"m - CASE WHEN {U('47', KEYS)} < 0.333 THEN 0.15 ELSE 0 END * sev",
}


@query(
    "a60_random_stress",
    f"""WITH {ASSET}, m AS (SELECT asset, avg(ret) AS m FROM ret GROUP BY 1), kn(kind) AS (VALUES {', '.join(f"('{k}')" for k in STRESS)}), s AS (SELECT asset, m, kind, sev FROM m, kn, (VALUES (1), (2), (3)) AS v(sev)),
x AS (SELECT kind, sev, asset, CASE kind {' '.join(f"WHEN '{k}' THEN {e}" for k, e in STRESS.items())} END AS ret FROM s), n AS (SELECT *, ntile(3) OVER (PARTITION BY kind, sev ORDER BY ret, asset) AS q FROM x), g AS (SELECT kind, sev, -avg(ret) AS loss, CAST(sum(CASE WHEN q = 1 THEN asset ELSE 0 END) AS BIGINT) AS worst FROM n GROUP BY 1, 2)
SELECT kind, sev AS severity, {R('loss', 6)} AS loss, {R('greatest(0.001, least(0.5, 0.1 / (1 + loss)))', 6)} AS probability, {R('24 + loss * 100')} AS recovery_hours, worst AS worst_third FROM g""",
)
def a60(spark, sf):
    """Seven kinds x three severities on the assets' mean returns; draws are
    hashes of (kind, severity, asset)."""
    from pyspark.sql import Window

    m = panel(spark, sf).groupBy("asset").agg(F.avg("ret").alias("m"))
    kinds = F.array(*[F.lit(k) for k in STRESS])
    x = m.select("asset", "m", F.explode(kinds).alias("kind")).select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("sev"))
    g = lambda seed, *ks: F.sqrt(-2 * F.log(uniform(*ks, seed=seed + "a"))) * F.cos(2 * math.pi * uniform(*ks, seed=seed + "b"))
    ks = ("kind", "sev", "asset")
    z, zc, u, s, mm = g("41", *ks), g("43", "kind", "sev"), uniform(*ks, seed="47"), c("sev"), c("m")
    out = {
        "market_crash": mm - 0.1 * s + z * 0.05 * s, "liquidity_crisis": mm * (1 - 0.3 * s) + 0.15 * s * z, "correlation_breakdown": mm * (1 - 0.5 * s) - 0.05 * s + 0.1 * s * zc, "volatility_spike": mm + 0.3 * s * z,
        "flash_crash": mm - 0.2 * s - 0.05 * s * F.log(u), "depeg_event": mm + F.when(u < 0.3, -0.15).otherwise(0.0) * s, "regulatory_shock": mm - F.when(u < 0.333, 0.15).otherwise(0.0) * s,
    }
    ret = F.lit(None).cast("double")
    for k, e in out.items():
        ret = F.when(c("kind") == k, e).otherwise(ret)
    x = x.withColumn("ret", ret).withColumn("q", F.ntile(3).over(Window.partitionBy("kind", "sev").orderBy("ret", "asset")))
    g2 = x.groupBy("kind", "sev").agg((-F.avg("ret")).alias("loss"), F.sum(F.when(c("q") == 1, c("asset")).otherwise(0)).alias("worst"))
    return g2.select("kind", c("sev").alias("severity"), r("loss", 6).alias("loss"), r(F.greatest(F.lit(0.001), F.least(F.lit(0.5), 0.1 / (1 + c("loss")))), 6).alias("probability"), r(24 + c("loss") * 100).alias("recovery_hours"), c("worst").cast("bigint").alias("worst_third"))


@query(
    "x29_augmentation",
    f"WITH {BARS} SELECT symbol, t, {R('close * (1 + 0.01 * ' + GA('53', 'symbol || chr(58) || t') + ')')} AS jitter, {R('close * (0.9 + 0.2 * ' + U('59', 'symbol') + ')')} AS scaled, CASE WHEN {U('61', 'symbol || chr(58) || t')} < 0.1 THEN 0.0 ELSE close END AS masked, {R(f'(close + coalesce(lead(close) {SERIES}, close)) / 2')} AS warped FROM bar",
)
def x29(spark, sf):
    """Seeded jitter, scale, mask and half-step time warp per row."""
    s = bar_series(spark, sf).bounded(0, {"_n": lambda w: w.lead("close")}, ahead=1)
    z = F.sqrt(-2 * F.log(uniform("symbol", "t", seed="53a"))) * F.cos(2 * math.pi * uniform("symbol", "t", seed="53b"))
    return s.df.select(
        "symbol", "t", r(c("close") * (1 + 0.01 * z)).alias("jitter"), r(c("close") * (0.9 + 0.2 * uniform("symbol", seed="59"))).alias("scaled"),
        F.when(uniform("symbol", "t", seed="61") < 0.1, 0.0).otherwise(c("close")).alias("masked"), r((c("close") + F.coalesce(c("_n"), c("close"))) / 2).alias("warped"),
    )


@query("s15_sample_candles")
def s15(spark, sf):
    """Seeded random-walk candles, one instrument per supplier, started at its
    balance."""
    from tapeworks.sources.store import sample_candles

    sup = market.table(spark, sf, "supplier").select(c("s_suppkey").alias("symbol"), (1000 + F.abs("s_acctbal")).alias("start"))
    return sample_candles(sup, 100).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), r(F.avg("close"), 2).alias("avg_close"), F.bool_and(c("high") >= c("low")).alias("ordered"))
