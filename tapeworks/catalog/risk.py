"""Risk."""

import math

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import r
from tapeworks.catalog.sql import ASSET, POS, R, TICK
from tapeworks.operators import risk as K
from tapeworks.plans.series import Series
from tapeworks.sources import market


def panel(spark, sf):
    return market.nation_returns(spark, sf)


def weights(spark, sf):
    """Weights from the suppliers' balances per country (normalised)."""
    s = market.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("asset")).agg(F.sum(F.abs("s_acctbal")).alias("b"))
    tot = s.agg(F.sum("b").alias("t"))
    return s.join(F.broadcast(tot), F.lit(True)).select("asset", (F.col("b") / F.col("t")).alias("weight"))


WTS = "wt AS (SELECT s_nationkey AS asset, sum(abs(s_acctbal)) / (SELECT sum(abs(s_acctbal)) FROM supplier) AS weight FROM supplier GROUP BY 1)"
PORT = f"{ASSET}, {WTS}, pr AS (SELECT t, sum(ret * weight) AS ret FROM ret JOIN wt USING (asset) GROUP BY 1)"


@query(
    "a15_a16_tail_risk",
    f"""WITH {ASSET}, q AS (SELECT asset, quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.025) AS q2, count(*) AS n FROM ret GROUP BY 1)
SELECT asset, {R('CASE WHEN any_value(n) >= 100 THEN -any_value(q1) END', 6)} AS var_99, {R('-avg(ret) FILTER (ret <= q1)', 6)} AS cvar_99, {R('-avg(ret) FILTER (ret <= q2)', 6)} AS es_975 FROM ret JOIN q USING (asset) GROUP BY 1""",
)
def a15(spark, sf):
    x = K.tail_levels(panel(spark, sf), ["asset"], "ret", {"99": 0.99, "975": 0.975})
    ok = F.col("n") >= 100
    return x.select("asset", r(F.when(ok, F.col("var_99")), 6).alias("var_99"), r(F.when(ok, F.col("cvar_99")), 6).alias("cvar_99"), r("cvar_975", 6).alias("es_975"))


def _cf(c: float) -> str:
    z = K.Z[c]
    zc = f"({z!r} + {(z * z - 1) / 6!r} * k3 + {(z**3 - 3 * z) / 24!r} * k4 - {(2 * z**3 - 5 * z) / 36!r} * k3 * k3)"
    return f"""SELECT asset, {R(f'-(m - {z!r} * s)', 6)} AS var_normal, {R(f'-(m - s * {K.pdf(z) / (1 - c)!r})', 6)} AS es_normal,
 {R(f'-(m - s * exp(-{zc} * {zc} / 2) / {math.sqrt(2 * math.pi)!r} / {1 - c!r})', 6)} AS es_cornish_fisher FROM g WHERE n >= 30"""


# population moments by their definition
MOM = """mm AS (SELECT asset, avg(ret) AS m, stddev_samp(ret) AS s, stddev_pop(ret) AS sp, count(*) AS n FROM ret GROUP BY 1),
g AS (SELECT asset, m, s, n, avg(pow((ret - m) / sp, 3)) AS k3, avg(pow((ret - m) / sp, 4)) - 3 AS k4 FROM ret JOIN mm USING (asset) GROUP BY 1, 2, 3, 4)"""


@query("a16_parametric_es", f"WITH {ASSET}, {MOM} {_cf(0.975)}")
def a16(spark, sf):
    x = K.parametric(panel(spark, sf), ["asset"], "ret", 0.975)
    return x.select("asset", *[r(c, 6).alias(c) for c in ("var_normal", "es_normal", "es_cornish_fisher")])


@query(
    "a09_order_statistic_var",
    f"WITH {ASSET}, x AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ret, t) AS k, count(*) OVER (PARTITION BY asset) AS n FROM ret) SELECT asset, {R('max(ret)', 6)} AS var, {R('avg(ret)', 6)} AS cvar FROM x WHERE k <= floor(CAST(0.010000000000000009 AS DOUBLE) * n) + 1 GROUP BY 1",
)
def a09(spark, sf):
    return K.order_statistic_var(panel(spark, sf), ["asset"], "ret", ["t"]).select("asset", r("var", 6).alias("var"), r("cvar", 6).alias("cvar"))


@query("a17_portfolio_tail", f"WITH {PORT}, q AS (SELECT quantile_cont(ret, 0.025) AS q FROM pr) SELECT {R('-any_value(q)', 6)} AS var, {R('-avg(ret)', 6)} AS cvar FROM pr, q WHERE ret <= q")
def a17(spark, sf):
    pr = K.portfolio_returns(panel(spark, sf), weights(spark, sf))
    return K.tail_stats(pr, [], "ret", 0.975, 50).select(r("var", 6).alias("var"), r("cvar", 6).alias("cvar"))


@query(
    "a18_es_decomposition",
    f"""WITH {PORT}, q0 AS (SELECT quantile_cont(ret, 0.025) AS q FROM pr), es0 AS (SELECT -avg(ret) AS es FROM pr, q0 WHERE ret <= q),
u AS (SELECT r.asset, pr.ret + 0.0001 * r.ret AS u FROM ret r JOIN pr ON r.t = pr.t), qu AS (SELECT asset, quantile_cont(u, 0.025) AS q FROM u GROUP BY 1),
eu AS (SELECT asset, -avg(u) AS es FROM u JOIN qu USING (asset) WHERE u <= q GROUP BY 1),
m AS (SELECT asset, weight, (eu.es - es0.es) / 0.0001 AS me FROM eu JOIN wt USING (asset), es0)
SELECT asset, {R('me', 3)} AS marginal_es, {R('weight * me', 3)} AS contribution, {R('abs(weight * me) / (SELECT sum(abs(weight * me)) FROM m) * 100', 2)} AS pct FROM m""",
)
def a18(spark, sf):
    x = K.es_bumps(panel(spark, sf), weights(spark, sf))
    return x.select("asset", r("marginal_es", 3).alias("marginal_es"), r("contribution", 3).alias("contribution"), r("pct", 2).alias("pct"))


PAIRS = "cv AS (SELECT a.asset AS i, b.asset AS j, count(*) AS n, CASE WHEN count(*) < 10 THEN CAST(a.asset = b.asset AS INTEGER) ELSE covar_samp(a.ret, b.ret) END AS cov, CASE WHEN count(*) < 10 THEN CAST(a.asset = b.asset AS INTEGER) ELSE corr(a.ret, b.ret) END AS corr FROM ret a JOIN ret b ON a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2)"
FULLM = f"{PAIRS}, fm AS (SELECT i, j, cov FROM cv UNION ALL SELECT j, i, cov FROM cv WHERE i < j)"


@query("a20_covariance_pairs", f"WITH {ASSET}, {PAIRS} SELECT i, j, n, {R('cov', 6)} AS cov, {R('corr', 6)} AS corr FROM cv")
def a20(spark, sf):
    return K.covariances(panel(spark, sf), market.table(spark, sf, "nation").count()).select("i", "j", "n", r("cov", 6).alias("cov"), r("corr", 6).alias("corr"))


HEAT = f"""{ASSET}, {WTS}, {FULLM}, cw AS (SELECT i, sum(cov * weight) AS cw FROM fm JOIN wt ON j = asset GROUP BY 1), x AS (SELECT i, cw, weight FROM cw JOIN wt ON i = asset),
pv AS (SELECT sum(weight * cw) AS pv FROM x), y AS (SELECT i AS asset, weight, cw / sqrt(pv) * {K.Z[0.99]!r} AS mv FROM x, pv)"""


@query(
    "a19_risk_heat_map",
    f"WITH {HEAT}, z AS (SELECT *, weight * mv / (SELECT sum(weight * mv) FROM y) * 100 AS pct FROM y) SELECT asset, {R('mv', 6)} AS marginal_var, {R('weight * mv', 6)} AS component_var, {R('pct')} AS pct, CASE WHEN pct > 30 THEN 'high' WHEN pct > 15 THEN 'medium' ELSE 'low' END AS level FROM z",
)
def a19(spark, sf):
    x = K.risk_contributions(panel(spark, sf), weights(spark, sf))
    return x.select("asset", r("marginal_var", 6).alias("marginal_var"), r("component_var", 6).alias("component_var"), r("pct").alias("pct"), "level")


@query("a21_eigen_spectrum")
def a21(spark, sf):
    x = K.spectrum(K.covariances(panel(spark, sf), market.table(spark, sf, "nation").count()))
    return x.select("k", r("eigenvalue", 6).alias("eigenvalue"), r("share", 6).alias("share"), (F.col("eigenvalue") > 1).alias("significant"))


@query(
    "a22_correlation_breakdown",
    f"""WITH {ASSET}, c AS (SELECT t >= 1450 AS late, a.asset AS i, b.asset AS j, corr(a.ret, b.ret) AS c FROM ret a JOIN ret b USING (t) WHERE a.asset <= b.asset GROUP BY 1, 2, 3),
d AS (SELECT i, j, abs(x.c - y.c) AS d FROM (SELECT * FROM c WHERE NOT late) x JOIN (SELECT * FROM c WHERE late) y USING (i, j))
SELECT {R('max(d)', 6)} AS max_change, {R('(2 * sum(CASE WHEN i < j THEN d ELSE 0 END) + sum(CASE WHEN i = j THEN d ELSE 0 END)) / (2 * count(*) FILTER (i < j) + count(*) FILTER (i = j))', 6)} AS avg_change,
 CAST(2 * count(*) FILTER (d > 0.15) AS BIGINT) AS affected_pairs, max(d) > 0.3 AS breakdown FROM d""",
)
def a22(spark, sf):
    """Two periods side by side; change over the full matrix."""
    p = panel(spark, sf)
    n = market.table(spark, sf, "nation").count()
    a = K.covariances(p.where("t < 1450"), n).select("i", "j", F.col("corr").alias("c0"))
    b = K.covariances(p.where("t >= 1450"), n).select("i", "j", F.col("corr").alias("c1"))
    d = F.abs(F.col("c1") - F.col("c0"))
    mult = F.when(F.col("i") < F.col("j"), 2).otherwise(1)
    return a.join(b, ["i", "j"]).agg(
        r(F.max(d), 6).alias("max_change"), r(F.sum(d * mult) / F.sum(mult), 6).alias("avg_change"),
        (2 * F.count_if(d > 0.15)).cast("bigint").alias("affected_pairs"), (F.max(d) > 0.3).alias("breakdown"),
    )


@query(
    "a23_concentration",
    f"""WITH {ASSET}, {WTS}, {PAIRS}, f AS (SELECT i, j, corr FROM cv UNION ALL SELECT j, i, corr FROM cv WHERE i < j),
v AS (SELECT sum(a.weight * b.weight * corr) AS pv FROM f JOIN wt a ON a.asset = i JOIN wt b ON b.asset = j)
SELECT count(*) FILTER (i < j AND abs(corr) > 0.15) AS high_pairs, {R('max(abs(corr)) FILTER (i < j)', 6)} AS max_corr, {R('sqrt(1 / any_value(pv))', 6)} AS diversification,
 CASE WHEN count(*) FILTER (i < j AND abs(corr) > 0.15) > 25 THEN 'high' WHEN count(*) FILTER (i < j AND abs(corr) > 0.15) > 0 THEN 'moderate' ELSE 'low' END AS level FROM cv, v""",
)
def a23(spark, sf):
    c = K.covariances(panel(spark, sf), market.table(spark, sf, "nation").count()).select("i", "j", "corr")
    w = weights(spark, sf)
    a, b = w.select(F.col("asset").alias("i"), F.col("weight").alias("a")), w.select(F.col("asset").alias("j"), F.col("weight").alias("b"))
    x = c.join(a, "i").join(b, "j")
    off = F.col("i") < F.col("j")
    hit = F.count_if(off & (F.abs("corr") > 0.15))
    mult = F.when(off, 2).otherwise(1)
    return x.agg(
        hit.alias("high_pairs"), r(F.max(F.when(off, F.abs("corr"))), 6).alias("max_corr"),
        r(F.sqrt(1 / F.sum(F.col("a") * F.col("b") * F.col("corr") * mult)), 6).alias("diversification"),
        F.when(hit > 25, "high").when(hit > 0, "moderate").otherwise("low").alias("level"),
    )


EXPO = "sum(CASE WHEN signed > 0 THEN notional ELSE 0 END) AS le, sum(CASE WHEN signed > 0 THEN 0 ELSE notional END) AS se, sum(signed) AS ne, sum(signed * leverage) AS la, sum(notional * notional) / pow(sum(notional), 2) AS hhi"


@query(
    "a24_exposures",
    f"""WITH {POS}, g AS (SELECT nation, symbol, {EXPO} FROM pos GROUP BY GROUPING SETS ((), (nation), (symbol)))
SELECT coalesce(nation, -1) AS nation, coalesce(symbol, -1) AS symbol, {R('le', 2)} AS long_exposure, {R('se', 2)} AS short_exposure, {R('le + se', 2)} AS gross_exposure, {R('ne', 2)} AS net_exposure, {R('la', 2)} AS leverage_adjusted, {R('hhi', 6)} AS hhi FROM g""",
)
def a24(spark, sf):
    x = K.exposure_sets(market.positions(spark, sf))
    none = F.lit(-1)
    return x.select(
        F.coalesce("nation", none).alias("nation"), F.coalesce("symbol", none.cast("bigint")).alias("symbol"),
        *[r(c, 2).alias(c) for c in ("long_exposure", "short_exposure", "gross_exposure", "net_exposure", "leverage_adjusted")], r("hhi", 6).alias("hhi"),
    )


@query("j11_beta_exposure", f"WITH {POS} SELECT nation, {R('sum(signed * CASE WHEN s_acctbal > 0 THEN 1 + s_acctbal / 10000 ELSE 1 END)', 2)} AS beta_exposure FROM pos JOIN supplier ON symbol = s_suppkey GROUP BY 1")
def j11(spark, sf):
    betas = market.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"), (1 + F.col("s_acctbal") / 10000).alias("beta"))
    return K.beta_adjusted(market.positions(spark, sf), betas).groupBy("nation").agg(r(F.sum("beta_exposure"), 2).alias("beta_exposure"))


@query(
    "j12_correlation_adjusted",
    f"""WITH {ASSET}, {PAIRS}, net AS (SELECT symbol, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) * arg_max(price, (ts, o1, o2, o3, price)) AS signed FROM tick GROUP BY 1),
e AS (SELECT s_nationkey AS asset, sum(signed) AS s FROM net JOIN supplier ON symbol = s_suppkey GROUP BY 1)
SELECT {R('sqrt((SELECT sum(s * s) FROM e) + (SELECT sum(2 * a.s * b.s * corr) FROM cv JOIN e a ON a.asset = i JOIN e b ON b.asset = j WHERE i < j))', 2)} AS corr_adjusted""",
)
def j12(spark, sf):
    e = market.positions(spark, sf).groupBy(F.col("nation").alias("asset")).agg(F.sum("signed").alias("signed"))
    return K.correlation_adjusted(e, K.covariances(panel(spark, sf), market.table(spark, sf, "nation").count()).select("i", "j", "corr")).select(r("corr_adjusted", 2).alias("corr_adjusted"))


SC = ", ".join(f"('{k}', {s}, {str(t).lower()})" for k, (s, t) in K.SCENARIOS.items())
RP = ", ".join(f"('{k}', {a}, {b}, {d})" for k, (a, b, d) in K.REPLAYS.items())


@query(
    "a25_j13_stress",
    f"WITH {POS}, sc(scenario, shock, one) AS (VALUES {SC}), x AS (SELECT scenario, one, sum(signed * shock * CASE WHEN leverage > 1 THEN 1.5 ELSE 1 END) AS pnl FROM pos, sc GROUP BY 1, 2) SELECT scenario, {R('CASE WHEN one THEN pnl - 0.2 * abs(pnl) ELSE pnl END', 2)} AS total_pnl FROM x",
)
def a25(spark, sf):
    return K.stress(market.positions(spark, sf)).select("scenario", r("total_pnl", 2).alias("total_pnl"))


@query(
    "j13_replays",
    f"WITH {POS}, sc(scenario, big, alt, days) AS (VALUES {RP}) SELECT scenario, days AS recovery_days, {R('sum(signed * CASE WHEN nation < 5 THEN big ELSE alt END * CASE WHEN leverage > 1 THEN 1.5 ELSE 1 END)', 2)} AS total_pnl FROM pos, sc GROUP BY 1, 2",
)
def j13(spark, sf):
    return K.replay(market.positions(spark, sf), F.col("nation") < 5).select("scenario", "recovery_days", r("total_pnl", 2).alias("total_pnl"))


@query(
    "a57_tail_drivers",
    f"WITH {PORT}, q AS (SELECT quantile_cont(ret, 0.05) AS q FROM pr), tl AS (SELECT t FROM pr, q WHERE ret <= q) SELECT asset, {R('avg(ret * weight)', 6)} AS tail_contribution, count(*) AS n FROM ret JOIN tl USING (t) JOIN wt USING (asset) GROUP BY 1",
)
def a57(spark, sf):
    """Mean weighted return per asset over the portfolio's worst periods."""
    p, w = panel(spark, sf), weights(spark, sf)
    pr = K.portfolio_returns(p, w)
    from tapeworks.plans.quantiles import exact_percentiles

    q = exact_percentiles(pr, [], "ret", {"q": 0.05}).select("q")
    tail = pr.join(F.broadcast(q), F.lit(True)).where(F.col("ret") <= F.col("q")).select("t")
    return p.join(tail, "t", "left_semi").join(w, "asset").groupBy("asset").agg(r(F.avg(F.col("ret") * F.col("weight")), 6).alias("tail_contribution"), F.count(F.lit(1)).alias("n"))


LIMITS = {"symbol": 150_000.0, "order": 50_000.0, "drawdown": 0.2, "gross": 1_000_000.0, "concentration": 20.0, "margin_ratio": 0.1, "net": 600_000.0}
LINES = """ln AS (SELECT o_custkey AS account, l_suppkey AS symbol, l_extendedprice AS notional, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_shipdate < TIMESTAMP '1999-01-01' AS held
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "j18_pre_trade_checks",
    f"""WITH {LINES}, hd AS (SELECT account, symbol, sum(notional) AS n, sum(CASE WHEN side = 'buy' THEN notional ELSE -notional END) AS s FROM ln WHERE held GROUP BY 1, 2),
ac AS (SELECT account, sum(n) AS g, sum(s) AS s FROM hd GROUP BY 1),
x AS (SELECT ln.notional AS o, coalesce(hd.n, 0) + ln.notional AS nw, coalesce(ac.g, 0) AS g, coalesce(ac.s, 0) + CASE WHEN side = 'buy' THEN notional ELSE -notional END AS nt, c_acctbal AS tv FROM ln LEFT JOIN hd USING (account, symbol) LEFT JOIN ac USING (account) JOIN customer ON c_custkey = account WHERE NOT held),
c AS (SELECT 'position_limit_symbol' AS chk, nw <= 150000 AS ok FROM x UNION ALL SELECT 'order_notional', o <= 50000 FROM x UNION ALL SELECT 'max_drawdown', CASE WHEN tv > 0 THEN 0.1 * tv / tv ELSE 0 END <= 0.2 FROM x
 UNION ALL SELECT 'gross_exposure', g + o <= 1000000 FROM x UNION ALL SELECT 'concentration', nw / tv <= 20 FROM x WHERE tv > 0 UNION ALL SELECT 'margin', o * CAST(0.1 AS DOUBLE) <= tv - g * CAST(0.1 AS DOUBLE) FROM x UNION ALL SELECT 'net_exposure', abs(nt) <= 600000 FROM x)
SELECT chk AS "check", CASE WHEN ok THEN 'allow' ELSE 'reject' END AS decision, count(*) AS n FROM c GROUP BY 1, 2""",
)
def j18(spark, sf):
    """Order lines from 1999 on, checked against the positions held before."""
    li = market.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("symbol"), F.col("l_extendedprice").alias("notional"), "l_linestatus", "l_shipdate")
    o = market.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("account"))
    side = F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell")
    ln = li.join(o, li.l_orderkey == o.o_orderkey).select("account", "symbol", "notional", side.alias("side"), (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("held"))
    held = ln.where("held").withColumn("signed", F.when(F.col("side") == "buy", F.col("notional")).otherwise(-F.col("notional")))
    books = market.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("total_value"), (-0.1 * F.col("c_acctbal")).alias("unrealized"))
    return K.pre_trade_checks(ln.where("not held").drop("held"), held, books, LIMITS).groupBy("check", "decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j19_t08_order_rates",
    "WITH d AS (SELECT o_custkey AS account, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, count(*) AS n FROM orders GROUP BY 1, 2) "
    "SELECT account, day, CAST(sum(n) OVER (PARTITION BY account ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS rate, sum(n) OVER (PARTITION BY account ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) > 2 AS violation FROM d",
)
def j19(spark, sf):
    """Orders per account in the last 30 days; orders are first counted per
    (account, day), so a window holds at most one row per day."""
    from pyspark.sql import Window

    d = market.orders(spark, sf).groupBy("account", "day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("account").orderBy("day").rangeBetween(-29, 0)
    return d.select("account", "day", F.sum("n").over(w).alias("rate"), (F.sum("n").over(w) > 2).alias("violation"))
