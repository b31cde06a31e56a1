"""Reports over trades and equity."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import r
from tapeworks.catalog.sql import BARS, EQUITY, R, TICK, TRADE
from tapeworks.operators import reports as P
from tapeworks.plans.series import IDX, Series
from tapeworks.session import no_larger_than
from tapeworks.sources import market

ST = ["strategy_id"]


def equity(spark, sf):
    t = market.trades(spark, sf)
    return P.equity_curve(no_larger_than(t.withColumnRenamed("exit_day", "day"), t), ST, "day", 100_000.0)


STATS = f"""{TRADE}, ag AS (SELECT strategy_id, count(*) AS total_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gp, abs(sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END)) AS gl,
  max(pnl) AS best_trade, min(pnl) AS worst_trade, avg(pnl) FILTER (pnl > 0) AS aw, avg(pnl) FILTER (pnl <= 0) AS al, avg(hours) AS hrs, sum(pnl) AS total_pnl FROM trade GROUP BY 1),
rk AS (SELECT strategy_id, pnl > 0 AS w, row_number() OVER (PARTITION BY strategy_id ORDER BY exit_day, o1, o2, o3, pnl) - row_number() OVER (PARTITION BY strategy_id, pnl > 0 ORDER BY exit_day, o1, o2, o3, pnl) AS g FROM trade),
st AS (SELECT strategy_id, w, count(*) AS n FROM rk GROUP BY 1, 2, g), sm AS (SELECT strategy_id, max(n) FILTER (w) AS cw, max(n) FILTER (NOT w) AS cl FROM st GROUP BY 1)"""


@query(
    "a06_trade_statistics",
    f"WITH {STATS} SELECT strategy_id, total_trades, {R('win_rate', 6)} AS win_rate, {R('gp / gl')} AS profit_factor, best_trade, worst_trade, {R('aw')} AS avg_winning_trade, {R('al')} AS avg_losing_trade, {R('hrs')} AS avg_trade_duration_hours, {R('total_pnl', 2)} AS total_pnl, cw AS consecutive_wins, cl AS consecutive_losses FROM ag JOIN sm USING (strategy_id)",
)
def a06(spark, sf):
    x = P.trade_statistics(market.trades(spark, sf), ST, market.TRADE_ORDER)
    return x.select(
        "strategy_id", "total_trades", r("win_rate", 6).alias("win_rate"), r("profit_factor").alias("profit_factor"), "best_trade", "worst_trade",
        *[r(c).alias(c) for c in ("avg_winning_trade", "avg_losing_trade", "avg_trade_duration_hours")], r("total_pnl", 2).alias("total_pnl"), "consecutive_wins", "consecutive_losses",
    )


METR = f"""{EQUITY}, pk AS (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS pk FROM er), dd AS (SELECT *, (pk - equity) / pk AS dd FROM pk),
ln AS (SELECT *, CASE WHEN dd > 0 THEN i - coalesce(max(CASE WHEN dd = 0 THEN i END) OVER (PARTITION BY strategy_id ORDER BY day ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS len FROM dd),
m AS (SELECT strategy_id, arg_min(equity, day) AS e0, arg_max(equity, day) AS e1, count(*) AS bars, count(ret) AS n, avg(ret) AS mu, stddev_pop(ret) AS sd, stddev_pop(CASE WHEN ret < 0 THEN ret END) AS dsd, max(dd) AS mdd, max(len) AS mlen FROM ln GROUP BY 1),
z AS (SELECT *, e1 / e0 - 1 AS tr, pow(1 + greatest(least(e1 / e0 - 1, 100), -0.9999), 365.0 / bars) - 1 AS ar FROM m)"""


@query(
    "a07_backtest_metrics",
    f"""WITH {METR} SELECT strategy_id, {R('tr', 6)} AS total_return, {R('ar', 6)} AS annualised_return, {R('mu / sd * sqrt(365)')} AS sharpe, {R('mu / dsd * sqrt(365)')} AS sortino, {R('mdd', 6)} AS max_drawdown, mlen AS max_drawdown_bars,
 {R('ar / mdd')} AS calmar, {R('tr - 0.05', 6)} AS alpha, {R('(tr - 0.05) / n * 365 / (sd * sqrt(365))')} AS information_ratio FROM z""",
)
def a07(spark, sf):
    x = P.equity_metrics(equity(spark, sf), ST, "day", benchmark=F.lit(0.05))
    return x.select(
        "strategy_id", *[r(c, 6).alias(c) for c in ("total_return", "annualised_return", "max_drawdown", "alpha")], *[r(c).alias(c) for c in ("sharpe", "sortino", "calmar", "information_ratio")], "max_drawdown_bars"
    )


PERF = f"""{METR}, ag AS{STATS.split(', ag AS', 1)[1]},
od AS (SELECT strategy_id, ret, row_number() OVER (PARTITION BY strategy_id ORDER BY ret, day) AS k, count(*) OVER (PARTITION BY strategy_id) AS cnt FROM er WHERE ret IS NOT NULL),
vr AS (SELECT strategy_id, max(ret) AS var_99, avg(ret) AS cvar_99 FROM od WHERE k <= floor(CAST(0.010000000000000009 AS DOUBLE) * cnt) + 1 GROUP BY 1)"""


@query(
    "a08_a13_performance_report",
    f"WITH {PERF} SELECT z.strategy_id, {R('e0', 2)} AS starting, {R('e1', 2)} AS ending, {R('tr', 6)} AS total_return, {R('mu / sd * sqrt(365)')} AS sharpe, {R('mdd', 6)} AS max_drawdown, {R('win_rate', 6)} AS win_rate, {R('gp / gl')} AS profit_factor, {R('var_99', 6)} AS var_99, {R('cvar_99', 6)} AS cvar_99, cw AS consecutive_wins "
    "FROM z JOIN ag USING (strategy_id) JOIN sm USING (strategy_id) JOIN vr USING (strategy_id)",
)
def a08(spark, sf):
    """Per-strategy report: equity metrics, trade statistics, tail losses."""
    from tapeworks.operators.risk import order_statistic_var

    eq = equity(spark, sf)
    m = P.equity_metrics(eq, ST, "day")
    st = P.trade_statistics(market.trades(spark, sf), ST, market.TRADE_ORDER)
    v = order_statistic_var(P.returns(eq, ST, "day").df.where("ret is not null"), ST, "ret", ["day"])
    x = m.join(st, ST).join(v, ST)
    return x.select(
        "strategy_id", r("first", 2).alias("starting"), r("last", 2).alias("ending"), r("total_return", 6).alias("total_return"), r("sharpe").alias("sharpe"), r("max_drawdown", 6).alias("max_drawdown"),
        r("win_rate", 6).alias("win_rate"), r("profit_factor").alias("profit_factor"), r("var", 6).alias("var_99"), r("cvar", 6).alias("cvar_99"), "consecutive_wins",
    )


BEN = f"{EQUITY}, bm AS (SELECT day, avg(ret) AS b FROM er WHERE ret IS NOT NULL GROUP BY 1), jn AS (SELECT er.*, b FROM er JOIN bm USING (day) WHERE ret IS NOT NULL)"


@query(
    "a10_attribution",
    f"""WITH {BEN}, a AS (SELECT strategy_id, covar_samp(ret, b) / var_samp(b) AS beta, avg(ret) AS mr, avg(b) AS mb, stddev_pop(ret - b) AS sd, avg(ret - b) AS me FROM jn GROUP BY 1)
SELECT strategy_id, {R('beta', 6)} AS beta, {R('(mr - beta * mb) * 365', 6)} AS alpha, {R('sd * sqrt(365)', 6)} AS tracking_error, {R('me / sd * sqrt(365)')} AS information_ratio FROM a""",
)
def a10(spark, sf):
    ret = P.returns(equity(spark, sf), ST, "day").df.where("ret is not null")
    bench = ret.groupBy("day").agg(F.avg("ret").alias("b"))
    x = P.attribution(ret.join(bench, "day"), ST, "ret", "b")
    return x.select("strategy_id", *[r(c, 6).alias(c) for c in ("beta", "alpha", "tracking_error")], r("information_ratio").alias("information_ratio"))


@query("a11_period_returns", f"WITH {EQUITY} SELECT strategy_id, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m') AS period, {R('arg_max(equity, day) / arg_min(equity, day) - 1', 6)} AS ret FROM eq GROUP BY 1, 2")
def a11(spark, sf):
    month = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM")
    return P.period_returns(equity(spark, sf), ST, "day", month).select("strategy_id", "period", r("ret", 6).alias("ret"))


@query("a12_daily_returns", f"WITH {EQUITY} SELECT strategy_id, day, {R('ret', 6)} AS ret FROM er WHERE ret IS NOT NULL")
def a12(spark, sf):
    return P.returns(equity(spark, sf), ST, "day").df.where("ret is not null").select("strategy_id", "day", r("ret", 6).alias("ret"))


@query(
    "a14_best_by_metric",
    f"""WITH {PERF}, x AS (SELECT strategy_id, mu / sd * sqrt(365) AS sharpe, total_pnl, win_rate, -mdd AS dd, gp / gl AS pf FROM z JOIN ag USING (strategy_id)),
l AS (SELECT strategy_id, unnest(['sharpe', 'pnl', 'win_rate', 'max_drawdown', 'profit_factor']) AS metric, unnest([sharpe, total_pnl, win_rate, dd, pf]) AS v FROM x)
SELECT metric, arg_max(strategy_id, v) AS best, {R('max(v)')} AS value FROM l GROUP BY 1""",
)
def a14(spark, sf):
    x = P.equity_metrics(equity(spark, sf), ST, "day").join(P.trade_statistics(market.trades(spark, sf), ST, market.TRADE_ORDER), ST)
    c = F.col
    m = {"sharpe": c("sharpe"), "pnl": c("total_pnl"), "win_rate": c("win_rate"), "max_drawdown": -c("max_drawdown"), "profit_factor": c("profit_factor")}
    return P.best_by_metric(x, "strategy_id", m).select("metric", "best", r("value").alias("value"))


@query(
    "a48_fill_rollup",
    f"""SELECT o_orderkey AS order_id, {R('least(sum(l_quantity), 100)', 2)} AS filled, {R('sum(l_extendedprice) / sum(l_quantity)', 4)} AS avg_price, {R('sum(l_extendedprice * l_tax)', 2)} AS commission,
 CASE WHEN sum(l_quantity) >= 100 THEN 'filled' WHEN sum(l_quantity) > 0 THEN 'partial' ELSE 'open' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def a48(spark, sf):
    """Fills of each order: capped quantity (orders of 100 units), average
    price, commission, status."""
    li = market.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("n"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("f"))
    o = market.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"))
    q = F.col("q")
    return li.join(o, "order_id").select(
        "order_id", r(F.least(q, F.lit(100.0)), 2).alias("filled"), r(F.col("n") / q).alias("avg_price"), r("f", 2).alias("commission"),
        F.when(q >= 100, "filled").when(q > 0, "partial").otherwise("open").alias("status"),
    )


@query("a52_signal_counts", "SELECT user_id AS strategy_id, count(*) FILTER (event_type = 'purchase') AS long, count(*) FILTER (event_type = 'signup') AS short, count(*) FILTER (event_type NOT IN ('purchase', 'signup')) AS neutral FROM events GROUP BY 1")
def a52(spark, sf):
    e = F.col("event_type")
    return market.events(spark, sf).groupBy(F.col("user_id").alias("strategy_id")).agg(
        F.count_if(e == "purchase").alias("long"), F.count_if(e == "signup").alias("short"), F.count_if(~e.isin("purchase", "signup")).alias("neutral")
    )


@query(
    "a53_benchmarks",
    f"WITH {BARS}, h AS (SELECT symbol, arg_max(close, t) / arg_min(close, t) - 1 AS hold FROM bar GROUP BY 1) SELECT {R('avg(hold)')} AS equal_weight, {R('max(hold)')} AS best_asset_return, arg_max(symbol, hold) AS best_asset, count(*) AS assets FROM h",
)
def a53(spark, sf):
    return P.benchmarks(market.bars(spark, sf), "symbol", "t").select(r("equal_weight").alias("equal_weight"), r("best_asset_return").alias("best_asset_return"), "best_asset", "assets")


@query(
    "a55_walk_forward_rollup",
    f"""WITH {BARS}, f AS (SELECT symbol, CAST(floor((i - 1) / 52) AS BIGINT) AS fold, avg(abs(close - pc) / pc) AS loss FROM bar WHERE pc IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, lag(loss) OVER (PARTITION BY symbol ORDER BY fold) AS p FROM f),
c AS (SELECT a.symbol, avg(CASE WHEN b.loss > a.loss THEN 1.0 ELSE 0 END) AS c FROM f a JOIN f b ON a.symbol = b.symbol AND a.fold < b.fold GROUP BY 1)
SELECT symbol, count(*) AS folds, {R('avg(loss)')} AS oos_loss, {R('1 - stddev_pop(loss) / avg(loss)')} AS stability, {R('regr_slope(loss, fold)', 6)} AS trend, {R('corr(loss, p)', 6)} AS autocorrelation, {R('any_value(c)', 6)} AS concordance FROM l JOIN c USING (symbol) GROUP BY 1""",
)
def a55(spark, sf):
    s = Series.of(market.bars(spark, sf), ["symbol"], ["t"]).bounded(1, {"_p": lambda w: w.lag("close")})
    folds = s.rows.where("_p is not null").groupBy("symbol", F.floor((F.col(IDX) - 1) / 52).alias("fold")).agg(F.avg(F.abs(F.col("close") - F.col("_p")) / F.col("_p")).alias("loss"))
    x = P.walk_forward_rollup(folds, ["symbol"], "fold")
    return x.select("symbol", "folds", r("oos_loss").alias("oos_loss"), r("stability").alias("stability"), *[r(c, 6).alias(c) for c in ("trend", "autocorrelation", "concordance")])


@query(
    "a58_cube",
    f"WITH {TRADE} SELECT coalesce(venue, '*') AS venue, coalesce(strategy_id, '*') AS strategy_id, coalesce(side, '*') AS side, count(*) AS trades, {R('sum(pnl)', 2)} AS pnl, {R('sum(qty)', 2)} AS qty FROM trade GROUP BY CUBE (venue, strategy_id, side)",
)
def a58(spark, sf):
    x = market.trades(spark, sf).cube("venue", "strategy_id", "side").agg(F.count(F.lit(1)).alias("trades"), r(F.sum("pnl"), 2).alias("pnl"), r(F.sum("qty"), 2).alias("qty"))
    star = F.lit("*")
    return x.select(*[F.coalesce(c, star).alias(c) for c in ("venue", "strategy_id", "side")], "trades", "pnl", "qty")


@query(
    "a68_prediction_metrics",
    f"""WITH {BARS}, p AS (SELECT symbol, t, close AS y, avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM bar),
q AS (SELECT *, lag(y) OVER w AS ly, lag(p) OVER w AS lp FROM p WHERE p IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, {R('avg(pow(y - p, 2))', 2)} AS mse, {R('avg(abs(y - p))')} AS mae, {R('sqrt(avg(pow(y - p, 2)))')} AS rmse, {R('1 - avg(pow(y - p, 2)) / var_pop(y)')} AS r2, {R('avg(CASE WHEN sign(y - ly) = sign(p - lp) THEN 1.0 WHEN ly IS NOT NULL THEN 0 END)', 6)} AS direction_accuracy FROM q GROUP BY 1""",
)
def a68(spark, sf):
    s = Series.of(market.bars(spark, sf), ["symbol"], ["t"]).bounded(5, {"p": lambda w: F.avg("close").over(w.span(-5, -1))})
    x = P.prediction_metrics(s.df.where("p is not null"), ["symbol"], ["t"], "close", "p")
    return x.select("symbol", r("mse", 2).alias("mse"), *[r(c).alias(c) for c in ("mae", "rmse", "r2")], r("direction_accuracy", 6).alias("direction_accuracy"))
