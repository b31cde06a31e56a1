"""Portfolio construction."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import r
from tapeworks.catalog.risk import PAIRS, panel
from tapeworks.catalog.sql import ASSET, R, TRADE
from tapeworks.functions.draws import uniform
from tapeworks.operators import portfolio as O
from tapeworks.operators import risk as K
from tapeworks.sources import market

c = lambda n: F.col(n)


def moments(spark, sf):
    """Covariances and means of the assets of each regional portfolio."""
    p = panel(spark, sf)
    reg = market.table(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("i"), c("n_regionkey").cast("bigint").alias("portfolio"))
    cv = K.covariances(p, market.table(spark, sf, "nation").count()).select("i", "j", "cov").join(reg, "i").join(reg.select(c("i").alias("j"), c("portfolio").alias("_q")), "j").where(c("portfolio") == c("_q")).drop("_q")
    mu = p.groupBy(c("asset").cast("bigint").alias("i")).agg(F.avg("ret").alias("mu"))
    return cv.join(mu, "i")


def solved(name, methods):
    @query(name)
    def run(spark, sf):
        return O.solve_groups(moments(spark, sf), methods).select("portfolio", "method", "asset", r("weight", 6).alias("weight"))


solved("p01_mean_variance", ["mean_variance", "max_sharpe"])
solved("p02_shrunk_inverse", ["shrunk_inverse"])
solved("p03_p04_risk_parity_diversification", ["risk_parity", "max_diversification"])
solved("p06_p07_hierarchical_black_litterman", ["hierarchical", "black_litterman"])


@query("p01_efficient_frontier")
def p01f(spark, sf):
    x = O.frontier(moments(spark, sf), [0.5, 1, 2, 4, 8, 16, 32, 64])
    return x.select("portfolio", "aversion", r("ret", 6).alias("ret"), r("vol", 6).alias("vol"))


@query(
    "p05_min_correlation",
    f"WITH {ASSET}, {PAIRS}, s AS (SELECT i, corr FROM cv WHERE i < j UNION ALL SELECT j, corr FROM cv WHERE i < j), m AS (SELECT i AS asset, sum(abs(corr)) / (count(*) + 1) AS ac, count(*) + 1 AS n FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY round(ac, 12), asset) AS k FROM m) SELECT CAST(asset AS BIGINT) AS asset, {R('ac', 6)} AS avg_corr, round((n - k + 1) / (n * (n + 1) / 2.0), 8) AS weight FROM k",
)
def p05(spark, sf):
    return O.min_correlation(K.covariances(panel(spark, sf), market.table(spark, sf, "nation").count())).select("asset", r("avg_corr", 6).alias("avg_corr"), F.round("weight", 8).alias("weight"))


@query(
    "p08_min_cvar",
    f"""WITH {ASSET}, n AS (SELECT count(DISTINCT asset) AS n FROM ret), pr AS (SELECT t, sum(ret) / (SELECT n FROM n) AS p FROM ret GROUP BY 1), q AS (SELECT quantile_cont(p, 0.05) AS q FROM pr)
SELECT (SELECT n FROM n) AS assets, CAST(1 AS DOUBLE) AS weight_sum, {R('-avg(p)', 6)} AS equal_cvar, true AS within_bounds, true AS below_equal FROM pr, q WHERE p <= q""",
)
def p08(spark, sf):
    """Least CVaR with weights up to 0.2, checked by its objective."""
    assets, w, cvar, equal = O.min_cvar(panel(spark, sf), high=0.2)
    rows = spark.createDataFrame([(a, float(x)) for a, x in zip(assets, w)], "asset bigint, weight double")
    g = rows.agg(F.count(F.lit(1)).alias("assets"), F.round(F.sum("weight"), 6).alias("weight_sum"), (F.max("weight") <= 0.2 + 1e-9).alias("_hi"), (F.min("weight") >= -1e-9).alias("_lo"))
    return g.select("assets", "weight_sum", r(F.lit(equal), 6).alias("equal_cvar"), (c("_hi") & c("_lo")).alias("within_bounds"), (F.lit(cvar) <= F.lit(equal)).alias("below_equal"))


@query("p09_cvar_budget", f"WITH {ASSET}, n AS (SELECT asset, count(*) OVER () AS n FROM (SELECT DISTINCT asset FROM ret)) SELECT CAST(asset AS BIGINT) AS asset, {R('1.0 / n', 6)} AS budget, CAST(1 AS DOUBLE) AS share_sum, CAST(1 AS DOUBLE) AS weight_sum, true AS closer FROM n")
def p09(spark, sf):
    """Equal budgets of the tail loss: sums of shares and weights, and whether the
    shares are closer to the budgets than those of equal weights."""
    x = O.risk_budget(panel(spark, sf))
    t = x.agg(F.round(F.sum("share"), 6).alias("share_sum"), F.round(F.sum("weight"), 6).alias("weight_sum"))
    return x.join(F.broadcast(t), F.lit(True)).select("asset", r("budget", 6).alias("budget"), "share_sum", "weight_sum", (c("residual") < c("start")).alias("closer"))


@query("p09_budget_weights")
def p09w(spark, sf):
    x = O.risk_budget(panel(spark, sf))
    return x.select("asset", r("weight", 6).alias("weight"), r("share", 6).alias("share"), r("residual", 6).alias("residual"))


@query("p08_min_cvar_weights")
def p08w(spark, sf):
    """The weights of least CVaR themselves, with their CVaR and that of equal ones."""
    assets, w, cvar, equal = O.min_cvar(panel(spark, sf), high=0.2)
    rows = [(a, float(x), float(cvar), float(equal)) for a, x in zip(assets, w)]
    x = spark.createDataFrame(rows, "asset bigint, weight double, cvar double, equal double")
    return x.select("asset", r("weight", 4).alias("weight"), r("cvar").alias("cvar"), r("equal").alias("equal_cvar"))


N_C = 200
DIR = lambda k: f"-ln(((('0x' || substr(md5('23:' || {k}), 1, 8))::BIGINT + 0.5) / 4294967296.0))"


@query(
    "p10_p11_random_mix",
    f"""WITH {TRADE}, st AS (SELECT strategy_id, avg(pnl) AS m, stddev_pop(pnl) AS s FROM trade GROUP BY 1), cd AS (SELECT cand, strategy_id, m, s, {DIR("cand || ':' || strategy_id")} AS g FROM st, range(0, {N_C}) AS r(cand)),
w AS (SELECT cand, strategy_id, m, s, g / sum(g) OVER (PARTITION BY cand) AS w FROM cd), sc AS (SELECT cand, sum(w * m) / (sqrt(sum(w * w * s * s)) + 1e-8) - 0.1 * sum(w * ln(w + 1e-12)) - 0.05 * sum(abs(w - 0.2)) AS score FROM w GROUP BY 1), b AS (SELECT arg_max(cand, score) AS cand, max(score) AS score FROM sc)
SELECT strategy_id, {R('w', 6)} AS weight, {R('score', 6)} AS score FROM w JOIN b USING (cand)""",
)
def p11(spark, sf):
    """Dirichlet candidates as rows (hash draws), scored by grouped sums."""
    st = market.trades(spark, sf).groupBy("strategy_id").agg(F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s"))
    cd = st.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(N_C - 1)))).withColumn("g", -F.log(uniform("cand", "strategy_id", seed="23")))
    tot = cd.groupBy("cand").agg(F.sum("g").alias("tot"))
    w = cd.join(tot, "cand").withColumn("w", c("g") / c("tot"))
    ww, m, s = c("w"), c("m"), c("s")
    sc = w.groupBy("cand").agg((F.sum(ww * m) / (F.sqrt(F.sum(ww * ww * s * s)) + 1e-8) - 0.1 * F.sum(ww * F.log(ww + 1e-12)) - 0.05 * F.sum(F.abs(ww - 0.2))).alias("score"))
    best = sc.agg(F.max_by("cand", "score").alias("cand"), F.max("score").alias("score"))
    return w.join(F.broadcast(best), "cand").select("strategy_id", r("w", 6).alias("weight"), r("score", 6).alias("score"))
