"""Series statistics, volatility models, copulas, clusters."""

import math

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.joins import ALIGN, aligned
from tapeworks.catalog.risk import panel
from tapeworks.catalog.sql import ASSET, BARS, R, SERIES, full, over
from tapeworks.operators import bootstrap as B
from tapeworks.operators import regimes as H
from tapeworks.operators import stats as Z
from tapeworks.operators import wavelets as V
from tapeworks.plans.pairs import corr, pair_sums
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

c = lambda n: F.col(n)


def log_returns(spark, sf):
    s = bar_series(spark, sf).bounded(1, {"r": lambda w: F.log(c("close") / w.lag("close"))})
    return s.kept("r is not null", "r")


LR = "lr AS (SELECT symbol, t, i - 1 AS i, ln(close / pc) AS r FROM bar WHERE pc IS NOT NULL)"
ACF = f"{LR}, dm AS (SELECT *, r - avg(r) OVER (PARTITION BY symbol) AS d FROM lr), lg AS (SELECT symbol, d, " + ", ".join(f"lag(d, {k}) {SERIES} AS l{k}" for k in range(1, 4)) + " FROM dm), ac AS (SELECT symbol, " + ", ".join(f"sum(d * l{k}) / sum(d * d) AS a{k}" for k in range(1, 4)) + " FROM lg GROUP BY 1)"


@query("m01_acf", f"WITH {BARS}, {ACF} SELECT symbol, {R('a1', 6)} AS acf_1, {R('a2', 6)} AS acf_2, {R('a3', 6)} AS acf_3 FROM ac")
def m01(spark, sf):
    return Z.autocorrelation(log_returns(spark, sf), "r", 3).select("symbol", *[r(f"acf_{k}", 6).alias(f"acf_{k}") for k in (1, 2, 3)])


P3 = "(a3 - 2 * a1 * a2 + pow(a1, 3) - a1 * a1 * a3 + a1 * a2 * a2) / (1 - 2 * a1 * a1 + 2 * a1 * a1 * a2 - a2 * a2)"


@query("m01_pacf", f"WITH {BARS}, {ACF} SELECT symbol, {R('a1', 6)} AS pacf_1, {R('(a2 - a1 * a1) / (1 - a1 * a1)', 6)} AS pacf_2, {R(P3, 6)} AS pacf_3 FROM ac")
def m01p(spark, sf):
    x = Z.partial_autocorrelation(Z.autocorrelation(log_returns(spark, sf), "r", 3), ["symbol"], 3)
    return x.select("symbol", *[r(f"pacf_{k}", 6).alias(f"pacf_{k}") for k in (1, 2, 3)])


@query(
    "m02_jarque_bera",
    f"WITH {BARS}, {LR}, m AS (SELECT symbol, avg(r) AS m, stddev_pop(r) AS s FROM lr GROUP BY 1), g AS (SELECT symbol, count(*) AS n, avg(pow((r - m) / s, 3)) AS k3, avg(pow((r - m) / s, 4)) - 3 AS k4 FROM lr JOIN m USING (symbol) GROUP BY 1) SELECT symbol, {R('n / 6.0 * (k3 * k3 + k4 * k4 / 4)')} AS jb, {R('exp(-n / 12.0 * (k3 * k3 + k4 * k4 / 4))', 6)} AS p_value FROM g",
)
def m02(spark, sf):
    return Z.jarque_bera(log_returns(spark, sf).df, ["symbol"], "r").select("symbol", r("jb").alias("jb"), r("p_value", 6).alias("p_value"))


FWL = f"""d0 AS (SELECT symbol, close - pc AS dy, pc AS lv, pc - lag(pc) {SERIES} AS dl FROM bar), d1 AS (SELECT * FROM d0 WHERE dl IS NOT NULL AND dy IS NOT NULL),
b1 AS (SELECT symbol, regr_slope(dy, dl) AS s1, regr_intercept(dy, dl) AS c1, regr_slope(lv, dl) AS s2, regr_intercept(lv, dl) AS c2 FROM d1 GROUP BY 1), rs AS (SELECT symbol, dy - c1 - s1 * dl AS ey, lv - c2 - s2 * dl AS ex FROM d1 JOIN b1 USING (symbol)),
sl AS (SELECT symbol, count(*) AS n, sum(ex * ey) / sum(ex * ex) AS rho, sum(ex * ex) AS xx, sum(ey * ey) AS yy, sum(ex * ey) AS xy FROM rs GROUP BY 1)"""


@query("m03_unit_root", f"WITH {BARS}, {FWL} SELECT symbol, n, {R('rho', 6)} AS rho, {R('rho / sqrt((yy - xy * xy / xx) / (n - 3) / xx)')} AS t_stat FROM sl")
def m03(spark, sf):
    return Z.unit_root(bar_series(spark, sf), "close").select("symbol", "n", r("rho", 6).alias("rho"), r("t_stat").alias("t_stat"))


@query("m04_phillips_perron")
def m04(spark, sf):
    return Z.phillips_perron(bar_series(spark, sf).mutate(_x=c("close")), "close").select("symbol", r("z_t").alias("z_t"), r("rho", 6).alias("rho"))


@query("m05_variance_ratio", f"WITH {BARS}, l AS (SELECT symbol, t, ln(close) AS l FROM bar), d AS (SELECT symbol, " + ", ".join(f"l - lag(l, {q}) {SERIES} AS d{q}" for q in (1, 2, 4, 8)) + f" FROM l) SELECT symbol, " + ", ".join(f"{R(f'var_samp(d{q}) / ({q} * var_samp(d1))', 6)} AS vr_{q}" for q in (2, 4, 8)) + " FROM d GROUP BY 1")
def m05(spark, sf):
    return Z.variance_ratios(bar_series(spark, sf), "close").select("symbol", *[r(f"vr_{q}", 6).alias(f"vr_{q}") for q in (2, 4, 8)])


GRG = f"""{ALIGN}, g0 AS (SELECT a, b, ln(ca / lag(ca) OVER w) AS y, ln(cb / lag(cb) OVER w) AS x, t FROM al WINDOW w AS (PARTITION BY a, b ORDER BY t)), g1 AS (SELECT a, b, y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM g0 WHERE y IS NOT NULL WINDOW w AS (PARTITION BY a, b ORDER BY t)), g2 AS (SELECT * FROM g1 WHERE y1 IS NOT NULL),
h1 AS (SELECT a, b, regr_slope(y, y1) AS s1, regr_intercept(y, y1) AS c1, regr_slope(x1, y1) AS s2, regr_intercept(x1, y1) AS c2 FROM g2 GROUP BY 1, 2), h2 AS (SELECT a, b, y - c1 - s1 * y1 AS ey, x1 - c2 - s2 * y1 AS ex FROM g2 JOIN h1 USING (a, b)),
h3 AS (SELECT a, b, count(*) AS n, sum(ey * ey) AS r0, sum(ey * ey) - pow(sum(ex * ey), 2) / sum(ex * ex) AS r1 FROM h2 GROUP BY 1, 2)"""


def pair_returns(spark, sf):
    s = Series.of(aligned(spark, sf), ["a", "b"], ["t"]).bounded(1, {"y": lambda w: F.log(c("ca") / w.lag("ca")), "x": lambda w: F.log(c("cb") / w.lag("cb"))})
    return Series.of(s.df.where("y is not null"), ["a", "b"], ["t"])


@query("m06_granger", f"WITH {BARS}, {GRG} SELECT a, b, n, {R('(r0 - r1) / (r1 / (n - 3))')} AS f_stat FROM h3")
def m06(spark, sf):
    return Z.granger(pair_returns(spark, sf), "y", "x", 1).select("a", "b", "n", r("f_stat").alias("f_stat"))


@query("m07_cointegration", f"WITH {BARS}, {ALIGN}, h AS (SELECT a, b, regr_slope(ca, cb) AS hr, regr_intercept(ca, cb) AS ic FROM al GROUP BY 1, 2), bar2 AS (SELECT a || ':' || b AS symbol, al.a, al.b, t, ca - ic - hr * cb AS close, hr FROM al JOIN h USING (a, b)), bar3 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS pc FROM bar2), " + FWL.replace("FROM bar)", "FROM bar3)") + f", hh AS (SELECT DISTINCT symbol, a, b, hr FROM bar2) SELECT a, b, {R('hr', 6)} AS hedge_ratio, {R('rho / sqrt((yy - xy * xy / xx) / (n - 3) / xx)')} AS t_stat FROM sl JOIN hh USING (symbol)")
def m07(spark, sf):
    """Two-step test: hedge ratio by regression, unit root of the residual."""
    al = aligned(spark, sf)
    h = al.groupBy("a", "b").agg(F.regr_slope("ca", "cb").alias("hr"), F.regr_intercept("ca", "cb").alias("ic"))
    x = al.join(h, ["a", "b"]).withColumn("e", c("ca") - c("ic") - c("hr") * c("cb"))
    u = Z.unit_root(Series.of(x, ["a", "b"], ["t"]), "e")
    return u.join(h, ["a", "b"]).select("a", "b", r("hr", 6).alias("hedge_ratio"), r("t_stat").alias("t_stat"))


GRID = [(a, b) for a in (0.05, 0.1, 0.2) for b in (0.6, 0.7, 0.75)]


def gfit(spark, sf):
    return Z.garch_fit(log_returns(spark, sf), "r", GRID)


def _garch_sql() -> str:
    one = lambda a, b: f"sum(ln(h) + r * r / h) FILTER (a = {a} AND b = {b})"
    return f"""WITH RECURSIVE {BARS}, {LR}, gv AS (SELECT symbol, var_pop(r) AS v FROM lr GROUP BY 1), q AS MATERIALIZED (SELECT lr.symbol, i, r, v FROM lr JOIN gv USING (symbol)), g(a, b) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in GRID)}),
k AS (SELECT symbol, i, a, b, r, v, v AS h FROM q, g WHERE i = 1 UNION ALL SELECT q.symbol, q.i, a, b, q.r, q.v, q.v * (1 - a - b) + a * k.r * k.r + b * k.h FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1),
ll AS (SELECT symbol, a, b, sum(ln(h) + r * r / h) AS s, arg_max(h, i) AS h FROM k GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s, a, b) AS z FROM ll)
SELECT symbol, a AS alpha, b AS beta, {R('h', 6)} AS variance, {R('-0.5 * s', 4)} AS loglik FROM rk WHERE z = 1"""


@query("m10_garch_fit", _garch_sql())
def m10(spark, sf):
    return gfit(spark, sf).select("symbol", "alpha", "beta", r("variance", 6).alias("variance"), r("loglik").alias("loglik"))


@query("m17_garch_forecast")
def m17(spark, sf):
    return Z.garch_forecast(gfit(spark, sf), ["symbol"], 10).select("symbol", "step", r("variance", 6).alias("variance"))


# one iteration of a two-state model: forward and backward recursions, row by row
HMM = f"""{LR}, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r, t) - 1 AS j, count(*) OVER (PARTITION BY symbol) AS n FROM lr),
pt AS (SELECT symbol, CASE WHEN j < (n % 2) * (n // 2 + 1) THEN j // (n // 2 + 1) ELSE n % 2 + (j - (n % 2) * (n // 2 + 1)) // (n // 2) END AS part, avg(r) AS mu, stddev_pop(r) + 1e-8 AS sd FROM rk WHERE n >= 4 GROUP BY 1, 2),
pp AS (SELECT symbol, max(mu) FILTER (part = 0) AS u1, max(mu) FILTER (part = 1) AS u2, max(sd) FILTER (part = 0) AS s1, max(sd) FILTER (part = 1) AS s2 FROM pt GROUP BY 1),
em AS MATERIALIZED (SELECT symbol, i, r, u1, u2, exp(-0.5 * pow((r - u1) / s1, 2)) / (s1 * sqrt(2 * pi())) AS b1, exp(-0.5 * pow((r - u2) / s2, 2)) / (s2 * sqrt(2 * pi())) AS b2, max(i) OVER (PARTITION BY symbol) AS n FROM lr JOIN pp USING (symbol)),
fw AS (SELECT symbol, i, 0.5 * b1 / (0.5 * b1 + 0.5 * b2) AS a1, 0.5 * b2 / (0.5 * b1 + 0.5 * b2) AS a2, ln(0.5 * b1 + 0.5 * b2) AS l FROM em WHERE i = 1
  UNION ALL SELECT symbol, i, x1 / (x1 + x2), x2 / (x1 + x2), ln(x1 + x2) FROM (SELECT em.symbol, em.i, (0.8 * a1 + 0.2 * a2) * b1 AS x1, (0.2 * a1 + 0.8 * a2) * b2 AS x2 FROM fw JOIN em ON em.symbol = fw.symbol AND em.i = fw.i + 1)),
bw AS (SELECT symbol, i, 0.5::DOUBLE AS v1, 0.5::DOUBLE AS v2 FROM em WHERE i = n
  UNION ALL SELECT symbol, i, y1 / (y1 + y2), y2 / (y1 + y2) FROM (SELECT em.symbol, em.i - 1 AS i, 0.8 * b1 * v1 + 0.2 * b2 * v2 AS y1, 0.2 * b1 * v1 + 0.8 * b2 * v2 AS y2 FROM bw JOIN em ON em.symbol = bw.symbol AND em.i = bw.i WHERE em.i > 1)),
gm AS (SELECT em.*, l, a1 * v1 / (a1 * v1 + a2 * v2) AS g1, a2 * v2 / (a1 * v1 + a2 * v2) AS g2, v1, v2, lag(a1) OVER w AS p1, lag(a2) OVER w AS p2 FROM em JOIN fw USING (symbol, i) JOIN bw USING (symbol, i) WINDOW w AS (PARTITION BY symbol ORDER BY i)),
xi AS (SELECT symbol, sum(0.8 * p1 * b1 * v1 / z) AS x11, sum(0.2 * p1 * b2 * v2 / z) AS x12, sum(0.2 * p2 * b1 * v1 / z) AS x21, sum(0.8 * p2 * b2 * v2 / z) AS x22 FROM (SELECT *, 0.8 * p1 * b1 * v1 + 0.2 * p1 * b2 * v2 + 0.2 * p2 * b1 * v1 + 0.8 * p2 * b2 * v2 AS z FROM gm WHERE p1 IS NOT NULL) GROUP BY 1),
ms AS (SELECT symbol, count(*) AS n, sum(l) AS ll, sum(g1 * r) / sum(g1) AS m1, sum(g2 * r) / sum(g2) AS m2, sum(g1) AS c1, sum(g2) AS c2, max(g1) FILTER (i = 1) AS start_1 FROM gm GROUP BY 1),
vs AS (SELECT symbol, sqrt(sum(g1 * pow(r - m1, 2)) / max(c1)) + 1e-8 AS d1, sqrt(sum(g2 * pow(r - m2, 2)) / max(c2)) + 1e-8 AS d2 FROM gm JOIN ms USING (symbol) GROUP BY 1)"""


@query(
    "m11_hmm_step",
    f"WITH RECURSIVE {BARS}, {HMM} SELECT symbol, ms.n, {R('ll', 5)} AS log_likelihood, {R('start_1', 6)} AS start_1, {R('x11 / (x11 + x12)', 6)} AS stay_1, {R('x22 / (x21 + x22)', 6)} AS stay_2, {R('m1', 6)} AS mean_1, {R('m2', 6)} AS mean_2, {R('d1', 6)} AS sd_1, {R('d2', 6)} AS sd_2 FROM ms JOIN vs USING (symbol) JOIN xi USING (symbol)",
)
def m11s(spark, sf):
    """One iteration of a two-state model over chunks of 64 rows."""
    s = log_returns(spark, sf)
    size = s.rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    first = H.starts(s, "r", [2], stay=0.8).select("symbol", "states", "theta", F.lit(None).cast("double").alias("ll"), F.lit(0).alias("rounds"))
    x = H.step(H.chunked(s, "r", 64), first, ["symbol"]).join(size, "symbol")
    at = lambda k: r(F.get("theta", F.lit(k)), 6)
    return x.select("symbol", "n", r("ll", 5).alias("log_likelihood"), *[at(k).alias(n) for k, n in ((0, "start_1"), (2, "stay_1"), (5, "stay_2"), (6, "mean_1"), (7, "mean_2"), (8, "sd_1"), (9, "sd_2"))])


@query("m11_hmm_regimes")
def m11(spark, sf):
    """Fitted regimes: state count by BIC, and the share of rows in each state."""
    rows, models = H.regimes(log_returns(spark, sf), "r", max_states=4)
    share = rows.groupBy("symbol", "states", "state").agg(F.count(F.lit(1)).alias("rows"))
    x = share.join(models.select("symbol", "theta", "ll", "score"), "symbol", "left")
    mean, dev = (F.get("theta", (k + c("state")).cast("int")) for k in (c("states") + c("states") * c("states"), 2 * c("states") + c("states") * c("states")))
    return x.select("symbol", "states", "state", "rows", r(mean, 6).alias("mean"), r(dev, 6).alias("sd"), r("ll", 4).alias("log_likelihood"), r("score", 4).alias("bic"))


def _kalman_sql() -> str:
    return f"""WITH RECURSIVE {BARS}, gk AS (SELECT 1 AS n, CAST(1.01 / 2.01 AS DOUBLE) AS k, CAST((1 - 1.01 / 2.01) * 1.01 AS DOUBLE) AS p UNION ALL SELECT n + 1, (p + 0.01) / (p + 1.01), (1 - (p + 0.01) / (p + 1.01)) * (p + 0.01) FROM gk WHERE n < 500), q AS MATERIALIZED (SELECT symbol, t, i, close, k FROM bar LEFT JOIN gk ON n = i - 1),
f AS (SELECT symbol, t, i, close AS y FROM q WHERE i = 1 UNION ALL SELECT q.symbol, q.t, q.i, f.y + q.k * (q.close - f.y) FROM f JOIN q ON q.symbol = f.symbol AND q.i = f.i + 1) SELECT symbol, t, {R('y')} AS trend FROM f"""


@query("m12_kalman_trend", _kalman_sql())
def m12(spark, sf):
    return Z.local_level(bar_series(spark, sf), "close").df.select("symbol", "t", r("trend").alias("trend"))


def _hedge_sql() -> str:
    # a, b, d: covariance, e: its determinant (kept apart, so nothing cancels)
    pred = "a + 1e-5 AS a, b, d + 1e-5 AS d, e + 1e-5 * (a + d) + 1e-10 AS e"
    step = "SELECT p, q, t, i, y, x, m0, m1, a, b, d, e, a + 2 * x * b + x * x * d + 0.01 AS s"
    upd = "m0 + (a + x * b) / s * (y - m0 - m1 * x) AS m0, m1 + (b + x * d) / s * (y - m0 - m1 * x) AS m1, (x * x * e + 0.01 * a) / s AS a, (0.01 * b - x * e) / s AS b, (e + 0.01 * d) / s AS d, 0.01 * e / s AS e"
    return f"""WITH RECURSIVE {BARS}, {ALIGN}, q AS MATERIALIZED (SELECT a AS p, b AS q, t, ca AS y, cb AS x, row_number() OVER (PARTITION BY a, b ORDER BY t) AS i, count(*) OVER (PARTITION BY a, b) AS n FROM al),
f AS (SELECT p, q, t, i, {upd} FROM ({step} FROM (SELECT p, q, t, i, y, x, 0.0::DOUBLE AS m0, 1.0::DOUBLE AS m1, {pred} FROM (SELECT *, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d, 1.0::DOUBLE AS e FROM q WHERE i = 1)))
UNION ALL SELECT p, q, t, i, {upd} FROM ({step} FROM (SELECT q.p, q.q, q.t, q.i, q.y, q.x, m0, m1, {pred} FROM f JOIN q ON q.p = f.p AND q.q = f.q AND q.i = f.i + 1)))
SELECT f.p AS a, f.q AS b, f.t, {R('CASE WHEN n < 10 THEN 1 ELSE m1 END', 6)} AS hedge_ratio, {R('CASE WHEN n < 10 THEN 0 ELSE m0 END', 4)} AS intercept FROM f JOIN q ON q.p = f.p AND q.q = f.q AND q.i = f.i"""


@query("m12_hedge_ratio", _hedge_sql())
def m12h(spark, sf):
    """Slope and intercept at each bar of every instrument pair."""
    s = Z.hedge_ratio(Series.of(aligned(spark, sf), ["a", "b"], ["t"]), "ca", "cb")
    return s.df.select("a", "b", "t", r("hedge_ratio", 6).alias("hedge_ratio"), r("intercept").alias("intercept"))


@query(
    "m14_haar_energy",
    f"WITH {BARS}, l0 AS (SELECT symbol, i - 1 AS i, close AS v FROM bar), "
    + ", ".join(f"p{k} AS (SELECT symbol, i // 2 AS j, sum(v) FILTER (i % 2 = 0) AS a, sum(v) FILTER (i % 2 = 1) AS b FROM l{k - 1} GROUP BY 1, 2), l{k} AS (SELECT symbol, j AS i, (a + b) / sqrt(2) AS v, (a - b) / sqrt(2) AS d FROM p{k} WHERE a IS NOT NULL AND b IS NOT NULL)" for k in (1, 2, 3))
    + " " + " UNION ALL ".join(f"SELECT symbol, {k} AS level, count(*) AS n, {R('sum(d * d) / 1000000', 3)} AS energy_millions FROM l{k} GROUP BY 1" for k in (1, 2, 3)),
)
def m14(spark, sf):
    return Z.haar_energy(bar_series(spark, sf), "close", 3).select("symbol", "level", "n", r(c("energy") / 1e6, 3).alias("energy_millions"))


@query("m14_denoise")
def m14d(spark, sf):
    return Z.haar_denoise(bar_series(spark, sf), "close", 500.0).df.select("symbol", "t", r("denoised").alias("denoised"))


UR = f"{ASSET}, ur AS (SELECT asset, t, row_number() OVER (PARTITION BY asset ORDER BY ret, t) * 1.0 / (count(*) OVER (PARTITION BY asset) + 1) AS u FROM ret)"


@query("m15_tail_dependence", f"WITH {UR} SELECT a.asset AS i, b.asset AS j, {R('count(*) FILTER (a.u < 0.1 AND b.u < 0.1) / (count(*) * 0.1)', 6)} AS lower_tail, {R('count(*) FILTER (a.u > 0.9 AND b.u > 0.9) / (count(*) * 0.1)', 6)} AS upper_tail FROM ur a JOIN ur b ON a.t = b.t AND a.asset < b.asset GROUP BY 1, 2")
def m15(spark, sf):
    """Joint tail shares: pair sums of tail indicators (no rows per pair and t)."""
    u = Z.uniform_ranks(panel(spark, sf).select("asset", "t", "ret"), ["asset"], "ret", ["t"])
    one = lambda k: F.when(k, 1.0).otherwise(0.0)
    lo = pair_sums(u.withColumn("v", one(c("u") < 0.1)), ["t"], "asset", "v", centre=False).where("i < j").select("i", "j", "n", c("sxy").alias("lo"))
    hi = pair_sums(u.withColumn("v", one(c("u") > 0.9)), ["t"], "asset", "v", centre=False).where("i < j").select("i", "j", c("sxy").alias("hi"))
    return lo.join(hi, ["i", "j"]).select("i", "j", r(c("lo") / (c("n") * 0.1), 6).alias("lower_tail"), r(c("hi") / (c("n") * 0.1), 6).alias("upper_tail"))


@query("m15_gaussian_copula")
def m15g(spark, sf):
    """Correlation of the normal scores of ranks."""
    u = Z.uniform_ranks(panel(spark, sf).select("asset", "t", "ret"), ["asset"], "ret", ["t"]).withColumn("v", Z.probit(c("u")))
    return pair_sums(u, ["t"], "asset", "v").where("i < j").select("i", "j", r(corr(), 6).alias("rho"))


@query("m16_kmeans")
def m16(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = market.table(spark, sf, "embeddings").select("vec_id", array_to_vector(c("embedding").cast("array<double>")).alias("features"))
    m = KMeans(k=8, seed=42, maxIter=10).fit(v)
    return m.transform(v).groupBy(c("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("m16_pca")
def m16p(spark, sf):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = market.table(spark, sf, "embeddings").select("vec_id", array_to_vector(c("embedding").cast("array<double>")).alias("features"))
    m = PCA(k=3, inputCol="features", outputCol="pc").fit(v)
    x = m.transform(v).select("vec_id", vector_to_array("pc").alias("p"))
    return x.select("vec_id", *[r(F.abs(F.get("p", F.lit(k))), 6).alias(f"abs_pc{k + 1}") for k in range(3)])


# --- 8-tap wavelets -----------------------------------------------------------------------
DEEP = 3


def _wavelet_sql() -> str:
    taps = ", ".join(f"({k}, {h!r}::DOUBLE, {g!r}::DOUBLE)" for k, (h, g) in enumerate(zip(V.LOW, V.HIGH)))
    unit = 1 << DEEP
    levels = ", ".join(
        f"p{k} AS (SELECT symbol, j AS i, sum(h * v) AS v, sum(g * v) AS d, max(n) // 2 AS n FROM (SELECT o.symbol, o.i // 2 AS j, o.n, tp.h, tp.g, x.v FROM p{k - 1} o JOIN tp ON true JOIN p{k - 1} x ON x.symbol = o.symbol AND x.i = (o.i + tp.k) % o.n WHERE o.i % 2 = 0) GROUP BY 1, 2)"
        for k in range(1, DEEP + 1)
    )
    return f"""WITH {BARS}, tp(k, h, g) AS (VALUES {taps}), sz AS (SELECT symbol, count(*) AS m, CAST(ceil((count(*) + 8) / {unit}.0) * {unit} AS BIGINT) AS n FROM bar GROUP BY 1),
p0 AS (SELECT symbol, i, coalesce(close, 0) AS v, n FROM (SELECT symbol, n, unnest(range(n)) AS i FROM sz) LEFT JOIN (SELECT symbol, i - 1 AS i, close FROM bar) USING (symbol, i)), {levels}
""" + " UNION ALL ".join(f"SELECT symbol, {k} AS level, count(*) AS n, {R('sum(d * d) / 1000000', 3)} AS detail_millions, {R('sum(v * v) / 1000000', 3)} AS approx_millions FROM p{k} GROUP BY 1" for k in range(1, DEEP + 1))


@query("m14_wavelet_levels", _wavelet_sql())
def m14w(spark, sf):
    """Energy of approximation and detail of three levels of the 8-tap wavelet."""
    out = None
    for k, t in enumerate(V.transform(bar_series(spark, sf), "close", DEEP), 1):
        e = lambda n: r(F.sum(c(n) * c(n)) / 1e6, 3)
        x = t.groupBy("symbol").agg(F.lit(k).alias("level"), F.count(F.lit(1)).alias("n"), e("detail").alias("detail_millions"), e("approx").alias("approx_millions"))
        out = x if out is None else out.unionByName(x)
    return out


@query("m14_wavelet_inverse", f"WITH {BARS} SELECT symbol, t, {R('close', 2)} AS close FROM bar")
def m14i(spark, sf):
    """The series that the three levels rebuild."""
    return V.denoised(bar_series(spark, sf), "close", DEEP, 0.0).select("symbol", "t", r("denoised", 2).alias("close"))


# --- bootstrap intervals -------------------------------------------------------------------
REPS, BLK = 100, 10


def _probit_sql(p: str) -> str:
    """Text of :func:`Z.probit` (the same published coefficients, read from it)."""
    a, b, lo, hi = Z.PROBIT
    poly = lambda x, ks: "(" * (len(ks) - 1) + repr(ks[0]) + "".join(f" * {x} + {k!r})" for k in ks[1:])
    q, r2 = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    side = lambda x: f"({poly(x, lo)} / ({poly(x, hi)} * {x} + 1))"
    return f"CASE WHEN {p} < 0.02425 THEN {side(f'sqrt(-2 * ln({p}))')} WHEN {p} > 0.97575 THEN -{side(f'sqrt(-2 * ln(1 - {p}))')} ELSE {poly(r2, a)} * {q} / ({poly(r2, b)} * {r2} + 1) END"


def _cdf_sql(x: str) -> str:
    """Normal distribution of the column x, |x| < 4, by the series of erf."""
    z = f"({x} * {x} / 2)"
    acc = "1.0::DOUBLE"
    for n in range(40, 0, -1):
        acc = f"(1.0 + {acc} * (2.0 * {z} / {2 * n + 1}))"
    return f"(0.5 * (1 + sign({x}) * 2 / 1.7724538509055159 * abs({x}) / 1.4142135623730951 * exp(-{z}) * {acc}))"


def _bootstrap_sql() -> str:
    def weighted(name: str, src: str, seed: str, rate: str) -> str:
        x = f"SELECT asset, i, n, s, ss, nn, b, (('0x' || substr(md5('{seed}:' || asset), 1, 7))::BIGINT + i * 7919 + b * 104729) % {B.PRIME} AS x, CAST({rate} AS DOUBLE) AS l FROM {src}, range(0, {REPS}) AS r(b)"
        for k in B.STEPS:
            x = f"SELECT * REPLACE ((x * x + {k} * (x + b + 1)) % {B.PRIME} AS x) FROM ({x})"
        p, total, w = "exp(-l)", "exp(-l)", []
        for k in range(1, B.MOST + 1):
            w.append(f"CASE WHEN u > {total} THEN 1 ELSE 0 END")
            p = f"{p} * l / {k}"
            total = f"{total} + {p}"
        sums = f"SELECT asset, b, sum(w * nn) AS c, sum(w * s) AS x, sum(w * ss) AS xx FROM (SELECT *, {' + '.join(w)} AS w FROM (SELECT *, (x + 0.5::DOUBLE) / {B.PRIME} AS u FROM ({x}))) GROUP BY 1, 2"
        return f"{name} AS (SELECT asset, list(v ORDER BY v) AS v, stddev_pop(v) AS sd FROM (SELECT asset, x / c / sqrt(greatest(xx / c - pow(x / c, 2), 1e-300)) AS v FROM ({sums})) GROUP BY 1)"

    at = lambda v, p: f"(CASE WHEN floor({p} * (len({v}) - 1)) + 1 >= len({v}) THEN {v}[len({v})] ELSE {v}[CAST(floor({p} * (len({v}) - 1)) AS BIGINT) + 1] + ({p} * (len({v}) - 1) - floor({p} * (len({v}) - 1))) * ({v}[CAST(floor({p} * (len({v}) - 1)) AS BIGINT) + 2] - {v}[CAST(floor({p} * (len({v}) - 1)) AS BIGINT) + 1]) END)"
    sr = lambda c_, x, xx: f"({x} / {c_}) / sqrt(greatest({xx} / {c_} - ({x} / {c_}) * ({x} / {c_}), 1e-300))"
    return f"""WITH {ASSET}, rw AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY t) AS i, count(*) OVER (PARTITION BY asset) AS n FROM ret), pl AS (SELECT asset, i, n, ret AS s, ret * ret AS ss, 1.0::DOUBLE AS nn FROM rw),
bl AS (SELECT * FROM (SELECT asset, i, n, sum(ret) OVER w AS s, sum(ret * ret) OVER w AS ss, {BLK}.0::DOUBLE AS nn FROM rw WINDOW w AS (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND {BLK - 1} FOLLOWING)) WHERE i <= n - {BLK - 1} AND n >= {2 * BLK}),
{weighted('pv', 'pl', '83', '1')}, {weighted('bv', 'bl', '83b', f'floor(n / {BLK}) / (n - {BLK - 1})')},
tt AS (SELECT asset, count(*) AS c, sum(ret) AS x, sum(ret * ret) AS xx FROM rw GROUP BY 1), jk AS (SELECT asset, {sr('(c - 1)', '(x - ret)', '(xx - ret * ret)')} AS j FROM rw JOIN tt USING (asset)),
ac AS (SELECT asset, sum(pow(m - j, 3)) / (6 * pow(sum(pow(m - j, 2)), 1.5)) AS a FROM (SELECT *, avg(j) OVER (PARTITION BY asset) AS m FROM jk) GROUP BY 1),
e0 AS (SELECT asset, {sr('c', 'x', 'xx')} AS est, a, pv.v, pv.sd, bv.v AS w FROM tt JOIN ac USING (asset) JOIN pv USING (asset) LEFT JOIN bv USING (asset) WHERE c >= 5), e1 AS (SELECT *, len(list_filter(v, lambda y: y < est)) / CAST(len(v) AS DOUBLE) AS sh FROM e0),
e2 AS (SELECT *, CASE WHEN sh > 0 AND sh < 1 THEN {_probit_sql('sh')} ELSE 0 END AS z0, {_probit_sql('0.025::DOUBLE')} AS zl, {_probit_sql('0.975::DOUBLE')} AS zh FROM e1), e3 AS (SELECT *, z0 + (z0 + zl) / (1 - a * (z0 + zl)) AS ql, z0 + (z0 + zh) / (1 - a * (z0 + zh)) AS qh FROM e2), e4 AS (SELECT *, {_cdf_sql('ql')} AS sl, {_cdf_sql('qh')} AS sg FROM e3)
SELECT asset, {R('est', 6)} AS estimate, {R('sd', 6)} AS std_error, {R('z0', 6)} AS z0, {R('a', 6)} AS acceleration, {R(at('v', '0.025'), 6)} AS lower, {R(at('v', '0.975'), 6)} AS upper, {R(at('w', '0.025'), 6)} AS block_lower, {R(at('w', '0.975'), 6)} AS block_upper, {R(at('v', 'sl'), 6)} AS bca_lower, {R(at('v', 'sg'), 6)} AS bca_upper FROM e4"""


@query("m09_intervals", _bootstrap_sql())
def m09i(spark, sf):
    """Percentile, corrected and block intervals of mean over deviation."""
    x = B.intervals(Series.of(panel(spark, sf).select("asset", "t", "ret"), ["asset"], ["t"]), B.sharpe("ret"), REPS, 0.05, BLK, "83")
    return x.select("asset", *[r(n, 6).alias(n) for n in x.columns if n != "asset"])


# --- rank correlation and the t copula -----------------------------------------------------
@query(
    "m15_kendall",
    f"WITH {BARS}, {ALIGN}, g0 AS (SELECT a, b, round(ln(ca / lag(ca) OVER w), 2) AS y, round(ln(cb / lag(cb) OVER w), 2) AS x, t FROM al WINDOW w AS (PARTITION BY a, b ORDER BY t)), g1 AS (SELECT * FROM g0 WHERE y IS NOT NULL), pr AS (SELECT p.a, p.b, sign(p.x - q.x) AS sx, sign(p.y - q.y) AS sy FROM g1 p JOIN g1 q ON p.a = q.a AND p.b = q.b AND p.t < q.t), s AS (SELECT a, b, sum(sx * sy) AS s, sum(abs(sx)) AS nx, sum(abs(sy)) AS ny FROM pr GROUP BY 1, 2), n AS (SELECT a, b, count(*) AS n FROM g1 GROUP BY 1, 2) SELECT a, b, n, {R('s / sqrt(nx * ny)', 6)} AS tau FROM s JOIN n USING (a, b)",
)
def m15k(spark, sf):
    """Kendall's tau-b of the (rounded) returns of instrument pairs."""
    x = pair_returns(spark, sf).mutate(y=F.round("y", 2), x=F.round("x", 2))
    return Z.kendall(x, "x", "y").where("n > 1").select("a", "b", "n", r("tau", 6).alias("tau"))


@query("m15_t_copula", f"WITH {UR}, z AS (SELECT t, avg({_probit_sql('u')}) AS m FROM ur GROUP BY 1), k AS (SELECT count(*) AS n, kurtosis_pop(m) AS k FROM z) SELECT n, {R('k', 6)} AS kurtosis, {R('CASE WHEN k > 0 THEN greatest(2.5, 6 / k + 4) ELSE 10 END', 4)} AS df FROM k")
def m15t(spark, sf):
    """Degrees of freedom by the kurtosis of the mean normal score."""
    u = Z.uniform_ranks(panel(spark, sf).select("asset", "t", "ret"), ["asset"], "ret", ["t"]).withColumn("v", Z.probit(c("u")))
    return Z.t_copula_freedom(u, "t", "v").select("n", r("kurtosis", 6).alias("kurtosis"), r("df").alias("df"))
