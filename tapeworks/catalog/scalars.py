"""Scalar jobs."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.features import RT
from tapeworks.catalog.reports import STATS
from tapeworks.catalog.risk import WTS, panel, weights
from tapeworks.catalog.sql import ASSET, BARS, POS, R, TICK, TRADE, full, over
from tapeworks.functions import scalars as X
from tapeworks.functions import texts as T
from tapeworks.operators import reports as P
from tapeworks.plans.quantiles import exact_percentiles
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

c = lambda n: F.col(n)


def points(name, src, from_sql, keys, cols, raw=None, digits=4):
    """Row-wise query: ``cols`` maps output -> (column factory, SQL)."""
    raw = raw or {}
    sel = ", ".join(keys + [f"{R(s, digits)} AS {k}" for k, (_, s) in cols.items()] + [f"{s} AS {k}" for k, (_, s) in raw.items()])

    @query(name, f"{from_sql[0]} SELECT {sel} FROM {from_sql[1]}")
    def run(spark, sf):
        return src(spark, sf).select(*keys, *[r(f(), digits).alias(k) for k, (f, _) in cols.items()], *[f().alias(k) for k, (f, _) in raw.items()])


def erf_sql(x: str) -> str:
    return f"(exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 120), lambda n: pow({x}, 2 * n + 1) / gamma(n + 1.5))))"


def options(spark, sf):
    """Option rows from candles: spot = close, strike near it, a quarter to
    expiry, volatility from the bar's range."""
    b = market.bars(spark, sf)
    return b.select("symbol", "t", c("close").alias("s"), (F.floor(c("close") * (90 + 10 * (c("t") % 3))) / 100).alias("k"), F.lit(0.25).alias("tt"), (0.2 + F.least(F.lit(1.0), (c("high") - c("low")) / c("high"))).alias("v"))


OPT = "op AS (SELECT symbol, t, close AS s, floor(close * (90 + 10 * (t % 3))) / 100 AS k, CAST(0.25 AS DOUBLE) AS tt, CAST(0.2 AS DOUBLE) + least(1.0, (high - low) / high) AS v FROM bar)"
OPD = f"{OPT}, o1 AS (SELECT *, (ln(s / k) + (0.02 + v * v / 2) * tt) / (v * sqrt(tt)) AS d1 FROM op), o2 AS (SELECT *, d1 - v * sqrt(tt) AS d2, k * exp(-0.02 * tt) AS ds, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS ph FROM o1), o3 AS (SELECT *, 0.5 * (1 + {erf_sql('d1 / sqrt(2)')}) AS n1, 0.5 * (1 + {erf_sql('d2 / sqrt(2)')}) AS n2 FROM o2)"
BSQ = {"call": "s * n1 - ds * n2", "put": "ds * (1 - n2) - s * (1 - n1)", "delta": "n1", "gamma": "ph / (s * v * sqrt(tt))", "vega": "s * ph * sqrt(tt)", "theta": "-s * ph * v / (2 * sqrt(tt)) - 0.02 * ds * n2", "rho": "tt * ds * n2"}


@query("x01_black_scholes", f"WITH {BARS}, {OPD} SELECT symbol, t, " + ", ".join(f"{R(e, 8 if k == 'gamma' else 4)} AS {k}" for k, e in BSQ.items()) + " FROM o3")
def x01(spark, sf):
    g = X.black_scholes(options(spark, sf), "s", "k", "tt", 0.02, "v")
    return g.select("symbol", "t", *[r(k, 8 if k == "gamma" else 4).alias(k) for k in BSQ])


@query("x02_implied_vol", f"WITH {BARS}, {OPT} SELECT symbol, t, {R('v')} AS implied FROM op")
def x02(spark, sf):
    """The volatility recovered from its own price (round trip)."""
    o = X.black_scholes(options(spark, sf), "s", "k", "tt", 0.02, "v")
    return o.select("symbol", "t", r(X.implied_vol(c("call"), c("s"), c("k"), c("tt"), 0.02)).alias("implied"))


tick_src = lambda spark, sf: market.ticks(spark, sf)
SL = lambda e: f"price * CASE WHEN side = 'buy' THEN 1 + ({e}) / 10000 ELSE 1 - ({e}) / 10000 END"
sl = lambda: X.slippage_models(c("price"), c("qty"), F.lit(1000.0), F.lit(1500.0), F.lit(0.02), c("side") == "buy")
K4 = ["symbol", "o1", "o2", "o3", "qty"]
points(
    "x03_slippage", tick_src, (f"WITH {TICK}", "tick"), K4,
    {
        "percentage": (lambda: sl()["percentage"], SL("5.0")), "square_root": (lambda: sl()["square_root"], SL("5 * sqrt(qty / 1000)")),
        "impact": (lambda: sl()["impact"], SL("CAST(0.1 AS DOUBLE) * 0.02 * sqrt(qty / 1000) * 10000")), "thin_market": (lambda: sl()["thin_market"], SL("least(50.0, 5.0 * 1500 / 1000)")),
    },
)
fl = lambda: X.fills(c("qty"), F.lit(20.0))
points(
    "x04_fill_models", tick_src, (f"WITH {TICK}", "tick"), K4,
    {"immediate": (lambda: fl()["immediate"], "qty"), "partial": (lambda: fl()["partial"], "least(least(qty, 20), qty * 0.7)"), "partial_left": (lambda: fl()["partial_left"], "qty - least(least(qty, 20), qty * 0.7)"), "fill_or_kill": (lambda: fl()["fill_or_kill"], "CASE WHEN 20 >= qty * 0.95 THEN qty ELSE 0 END")},
)


def strategy_stats(spark, sf):
    t = market.trades(spark, sf)
    win = c("pnl") > 0
    return t.groupBy("strategy_id", "venue").agg(F.avg(F.when(win, 1.0).otherwise(0.0)).alias("w"), F.avg(F.when(win, c("pnl"))).alias("aw"), F.avg(F.when(~win, -c("pnl"))).alias("al"), F.avg("pnl").alias("m"), (F.stddev_pop("pnl") / 1000).alias("v"))


SS = f"{TRADE}, ss AS (SELECT strategy_id, venue, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS w, avg(pnl) FILTER (pnl > 0) AS aw, avg(-pnl) FILTER (pnl <= 0) AS al, avg(pnl) AS m, stddev_pop(pnl) / 1000 AS v FROM trade GROUP BY 1, 2)"
KF = "greatest(0, w - (1 - w) / (aw / al))"
KD = f"CASE WHEN f > 0 THEN CASE WHEN 1 - pow(1 - f, greatest(3, floor(ln(0.75) / ln(1 - f)))) > 0.25 THEN f * 0.25 / (1 - pow(1 - f, greatest(3, floor(ln(0.75) / ln(1 - f))))) ELSE f END ELSE 0 END"
VS = "100000 * 0.02 * greatest(0.25, least(3.0, 0.15 / v))"
points(
    "x05_position_sizing", strategy_stats, (f"WITH {SS}, kf AS (SELECT *, {KF} AS f FROM ss)", "kf"), ["strategy_id", "venue"],
    {
        "kelly": (lambda: X.kelly_size(c("w"), c("aw"), c("al"), 100_000.0), f"100000 * 0.5 * {KD}"), "volatility": (lambda: X.volatility_size(100_000.0, c("v")), VS),
        "dynamic": (lambda: F.least(X.kelly_size(c("w"), c("aw"), c("al"), 100_000.0), X.volatility_size(100_000.0, c("v"))), f"least(100000 * 0.5 * {KD}, {VS})"),
        "fixed_fractional": (lambda: 2000 / F.abs(c("aw") - c("al")), "2000 / abs(aw - al)"),
    },
)


@query("x06_kelly_allocation", f"WITH {SS}, k AS (SELECT strategy_id, venue, 0.5 * {KF} AS f FROM ss) SELECT strategy_id, venue, {R('CASE WHEN (SELECT sum(f) FROM k) > 1 THEN f / (SELECT sum(f) FROM k) ELSE f END', 6)} AS weight FROM k")
def x06(spark, sf):
    k = strategy_stats(spark, sf).select("strategy_id", "venue", (0.5 * F.greatest(F.lit(0.0), c("w") - (1 - c("w")) / (c("aw") / c("al")))).alias("f"))
    tot = k.agg(F.sum("f").alias("tot"))
    return k.join(F.broadcast(tot), F.lit(True)).select("strategy_id", "venue", r(F.when(c("tot") > 1, c("f") / c("tot")).otherwise(c("f")), 6).alias("weight"))


lv = lambda: X.leverage_targets(c("m") / 1000, c("v"))
points(
    "x07_leverage", strategy_stats, (f"WITH {SS}", "ss"), ["strategy_id", "venue"],
    {"kelly": (lambda: lv()["kelly"], "m / 1000 / (v * v)"), "by_volatility": (lambda: lv()["by_volatility"], "least(3.0, 0.15 / v)"), "by_drawdown": (lambda: lv()["by_drawdown"], "sqrt(0.4) / v"), "optimal": (lambda: lv()["optimal"], "greatest(0, least(m / 1000 / (v * v) * 0.5, least(3.0, 0.15 / v), sqrt(0.4) / v, 3.0))")},
)

TW = f"{ASSET}, {WTS}, vl AS (SELECT asset, stddev_pop(ret) AS v FROM ret GROUP BY 1), tw AS (SELECT asset, weight AS cur, (1 / v) / (SELECT sum(1 / v) FROM vl) AS tgt FROM vl JOIN wt USING (asset))"


def targets(spark, sf):
    """Current weights against inverse-volatility targets."""
    v = panel(spark, sf).groupBy("asset").agg((1 / F.stddev_pop("ret")).alias("iv"))
    tot = v.agg(F.sum("iv").alias("tot"))
    return v.join(F.broadcast(tot), F.lit(True)).join(weights(spark, sf), "asset").select("asset", c("weight").alias("cur"), (c("iv") / c("tot")).alias("tgt"))


COST = "5 * count(*) FILTER (abs(tgt - cur) > 0) + 1000000 * sum(abs(tgt - cur)) * 0.001 + 1000000 * sum(abs(tgt - cur)) * 0.1 * sqrt(sum(abs(tgt - cur)) * 0.1)"


@query("x08_transaction_cost", f"WITH {TW} SELECT {R('sum(abs(tgt - cur))', 6)} AS turnover, {R(COST, 2)} AS total_cost FROM tw")
def x08(spark, sf):
    """Fixed, proportional and square-root impact cost of a rebalance."""
    d = F.sum(F.abs(c("tgt") - c("cur")))
    n = F.count_if(F.abs(c("tgt") - c("cur")) > 0)
    return targets(spark, sf).agg(r(d, 6).alias("turnover"), r(5 * n + 1e6 * d * 0.001 + 1e6 * d * 0.1 * F.sqrt(d * 0.1), 2).alias("total_cost"))


points(
    "x09_rebalance_trades", lambda s, f: targets(s, f).where(F.abs(c("tgt") - c("cur")) > 0.005), (f"WITH {TW}", "tw WHERE abs(tgt - cur) > 0.005"), ["asset"],
    {"diff": (lambda: c("tgt") - c("cur"), "tgt - cur"), "notional": (lambda: (c("tgt") - c("cur")) * 1e6, "(tgt - cur) * 1000000")},
    raw={"action": (lambda: F.when(c("tgt") > c("cur"), "buy").otherwise("sell"), "CASE WHEN tgt > cur THEN 'buy' ELSE 'sell' END")},
)


@query(
    "x10_liquidity_risk",
    f"""WITH {BARS}, l AS (SELECT symbol, t, (high - low) / close * 10000 AS sp, quote_volume AS dp FROM bar), w AS (SELECT *, lag(sp, 4) OVER q AS s4, lag(dp, 4) OVER q AS d4, avg(dp) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS av FROM l WINDOW q AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, {R('sp', 2)} AS spread_bps, CASE WHEN sp > 5000 THEN 'critical' WHEN sp > 1000 THEN 'elevated' ELSE 'normal' END AS spread_level, coalesce(sp > 1.5 * s4, false) AS widening, coalesce(dp < 0.5 * d4, false) AS thinning, {R('0.5 * sqrt(10000 / av) * 10000', 2)} AS impact_bps FROM w""",
)
def x10(spark, sf):
    s = bar_series(spark, sf).mutate(sp=(c("high") - c("low")) / c("close") * 10000, dp=c("quote_volume"))
    s = s.bounded(4, {"s4": lambda w: w.lag("sp", 4), "d4": lambda w: w.lag("dp", 4), "av": lambda w: F.avg("dp").over(w(5))})
    no = F.lit(False)
    return s.df.select(
        "symbol", "t", r("sp", 2).alias("spread_bps"), F.when(c("sp") > 5000, "critical").when(c("sp") > 1000, "elevated").otherwise("normal").alias("spread_level"),
        F.coalesce(c("sp") > 1.5 * c("s4"), no).alias("widening"), F.coalesce(c("dp") < 0.5 * c("d4"), no).alias("thinning"), r(0.5 * F.sqrt(10000 / c("av")) * 10000, 2).alias("impact_bps"),
    )


OPS = "CASE WHEN dl < 2 THEN 95 WHEN dl < 12 THEN 70 WHEN dl < 48 THEN 50 ELSE 20 END"
RESV = "CASE WHEN bal > 5000 THEN 95 WHEN bal > 2000 THEN 80 WHEN bal > 0 THEN 50 ELSE 20 END"
SCORE = f"0.3 * 80 + 0.2 * 75 + 0.3 * {RESV} + 0.2 * {OPS}"


@query(
    "x11_counterparty_score",
    f"WITH v AS (SELECT s_suppkey AS venue, s_acctbal AS bal, s_suppkey % 60 AS dl FROM supplier), s AS (SELECT venue, {RESV} AS rs, {OPS} AS op, {SCORE} AS sc FROM v) SELECT venue, {R('sc', 2)} AS score, CASE WHEN sc >= 80 THEN 'low' WHEN sc >= 60 THEN 'medium' ELSE 'high' END AS risk, concat_ws(',', CASE WHEN rs < 60 THEN 'reserves' END, CASE WHEN op < 60 THEN 'withdrawals' END) AS warnings FROM s",
)
def x11(spark, sf):
    v = market.table(spark, sf, "supplier").select(c("s_suppkey").alias("venue"), c("s_acctbal").alias("bal"), (c("s_suppkey") % 60).alias("dl"))
    rs = F.when(c("bal") > 5000, 95).when(c("bal") > 2000, 80).when(c("bal") > 0, 50).otherwise(20)
    op = F.when(c("dl") < 2, 95).when(c("dl") < 12, 70).when(c("dl") < 48, 50).otherwise(20)
    x = v.withColumns({"rs": rs, "op": op}).withColumn("sc", 0.3 * 80 + 0.2 * 75 + 0.3 * c("rs") + 0.2 * c("op"))
    warn = F.array_join(F.array_compact(F.array(F.when(c("rs") < 60, F.lit("reserves")), F.when(c("op") < 60, F.lit("withdrawals")))), ",")
    return x.select("venue", r("sc", 2).alias("score"), F.when(c("sc") >= 80, "low").when(c("sc") >= 60, "medium").otherwise("high").alias("risk"), warn.alias("warnings"))


@query(
    "x12_risk_budgets",
    f"WITH {ASSET}, {WTS}, v AS (SELECT asset, stddev_pop(ret) AS v FROM ret GROUP BY 1), b AS (SELECT asset, weight, v, (1 / v) / sum(1 / v) OVER () AS tg, least(0.05, (1 / v) / sum(1 / v) OVER ()) AS cap, weight * v / sum(weight * v) OVER () AS us FROM v JOIN wt USING (asset)) SELECT asset, {R('tg', 6)} AS target, {R('cap', 6)} AS budget, {R('us / cap', 4)} AS utilisation, us > cap AS over_budget FROM b",
)
def x12(spark, sf):
    v = panel(spark, sf).groupBy("asset").agg(F.stddev_pop("ret").alias("v")).join(weights(spark, sf), "asset")
    tot = v.agg(F.sum(1 / c("v")).alias("ti"), F.sum(c("weight") * c("v")).alias("tu"))
    x = v.join(F.broadcast(tot), F.lit(True)).withColumns({"tg": 1 / c("v") / c("ti"), "us": c("weight") * c("v") / c("tu")}).withColumn("cap", F.least(F.lit(0.05), c("tg")))
    return x.select("asset", r("tg", 6).alias("target"), r("cap", 6).alias("budget"), r(c("us") / c("cap")).alias("utilisation"), (c("us") > c("cap")).alias("over_budget"))


MULT = "CASE regime WHEN 'crisis' THEN 0.5 WHEN 'ranging' THEN 0.8 ELSE 1.0 END * (1 - 0.5 * stress) * CASE WHEN sharpe < -0.5 THEN 0.6 WHEN sharpe < 0 THEN 0.8 ELSE 1.0 END"
ST = f"{TRADE}, st AS (SELECT strategy_id, venue, CASE venue WHEN 'A' THEN 'crisis' WHEN 'N' THEN 'ranging' ELSE 'trending_up' END AS regime, avg(pnl) / stddev_pop(pnl) AS sharpe, avg(CASE WHEN pnl < 0 THEN 1.0 ELSE 0 END) AS stress FROM trade GROUP BY 1, 2)"


def state(spark, sf):
    t = market.trades(spark, sf)
    return t.groupBy("strategy_id", "venue").agg((F.avg("pnl") / F.stddev_pop("pnl")).alias("sharpe"), F.avg(F.when(c("pnl") < 0, 1.0).otherwise(0.0)).alias("stress")).withColumn(
        "regime", F.when(c("venue") == "A", "crisis").when(c("venue") == "N", "ranging").otherwise("trending_up")
    )


def mult():
    return F.when(c("regime") == "crisis", 0.5).when(c("regime") == "ranging", 0.8).otherwise(1.0) * (1 - 0.5 * c("stress")) * F.when(c("sharpe") < -0.5, 0.6).when(c("sharpe") < 0, 0.8).otherwise(1.0)


points("x13_adaptive_limits", state, (f"WITH {ST}", "st"), ["strategy_id", "venue"], {"var_limit": (lambda: mult() * 0.05, f"({MULT}) * 0.05"), "leverage_limit": (lambda: mult() * 3, f"({MULT}) * 3"), "position_limit": (lambda: mult() * 0.1, f"({MULT}) * 0.1")}, digits=6)


def level():
    return F.when(c("stress") > 0.45, "high").when(c("stress") > 0.4, "medium").otherwise("low")


@query(
    "x14_x39_narratives",
    f"WITH {ST} SELECT strategy_id, venue, CASE WHEN stress > 0.45 THEN 'high' WHEN stress > 0.4 THEN 'medium' ELSE 'low' END AS level, concat_ws(' ', 'Strategy', strategy_id, 'on', venue, 'is at', CASE WHEN stress > 0.45 THEN 'high' WHEN stress > 0.4 THEN 'medium' ELSE 'low' END, 'risk with', CAST(CAST(round(stress * 1.000000001 * 100) AS BIGINT) AS VARCHAR) || '% losing trades in a', regime, 'market') AS narrative FROM st",
)
def x14(spark, sf):
    pct = F.concat(F.round(c("stress") * 1.000000001 * 100).cast("bigint").cast("string"), F.lit("% losing trades in a"))
    words = F.concat_ws(" ", F.lit("Strategy"), "strategy_id", F.lit("on"), "venue", F.lit("is at"), level(), F.lit("risk with"), pct, "regime", F.lit("market"))
    return state(spark, sf).select("strategy_id", "venue", level().alias("level"), words.alias("narrative"))


SMX = f"{ASSET}, sn AS (SELECT s_nationkey AS asset, n_regionkey AS class FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), sc AS (SELECT asset, class, avg(ret) / stddev_pop(ret) AS s FROM ret JOIN sn USING (asset) GROUP BY 1, 2), cl AS (SELECT class, exp(5 * avg(s)) AS e FROM sc GROUP BY 1), cw AS (SELECT class, e / sum(e) OVER () AS cw FROM cl), aw AS (SELECT asset, class, exp(5 * s) / sum(exp(5 * s)) OVER (PARTITION BY class) AS w FROM sc)"


def softmax_split(spark, sf):
    """Class weights by softmax of mean scores, asset weights inside a class
    (cap 0.08); both are sums of exponentials, no windows over assets."""
    cls = market.table(spark, sf, "nation").select(c("n_nationkey").alias("asset"), c("n_regionkey").alias("class"))
    s = panel(spark, sf).groupBy("asset").agg((F.avg("ret") / F.stddev_pop("ret")).alias("s")).join(cls, "asset")
    cl = s.groupBy("class").agg(F.exp(5 * F.avg("s")).alias("e"), F.sum(F.exp(5 * c("s"))).alias("z"))
    tot = cl.agg(F.sum("e").alias("tot"))
    x = s.join(cl, "class").join(F.broadcast(tot), F.lit(True))
    return x.select("asset", "class", (c("e") / c("tot")).alias("cw"), (F.exp(5 * c("s")) / c("z")).alias("w"))


@query("x15_softmax_allocation", f"WITH {SMX} SELECT asset, class, {R('cw', 6)} AS class_weight, {R('least(0.08, cw * w)', 6)} AS weight FROM aw JOIN cw USING (class)")
def x15(spark, sf):
    return softmax_split(spark, sf).select("asset", "class", r("cw", 6).alias("class_weight"), r(F.least(F.lit(0.08), c("cw") * c("w")), 6).alias("weight"))


@query("x38_capital_split", f"WITH {SMX} SELECT coalesce(class, -1) AS class, coalesce(asset, -1) AS asset, {R('sum(cw * w * 1000000)', 2)} AS capital FROM aw JOIN cw USING (class) GROUP BY ROLLUP (class, asset)")
def x38(spark, sf):
    x = softmax_split(spark, sf).rollup("class", "asset").agg(r(F.sum(c("cw") * c("w") * 1e6), 2).alias("capital"))
    return x.select(F.coalesce("class", F.lit(-1)).alias("class"), F.coalesce("asset", F.lit(-1)).alias("asset"), "capital")


EP = "ep AS (SELECT event_id, least(1.0, value / 100) AS st, (TIMESTAMP '2024-02-01' - ts) AS d, epoch(TIMESTAMP '2024-02-01') - epoch(ts) AS sec, user_id % 5 AS rh FROM events), eh AS (SELECT *, sec / 3600.0 AS h FROM ep), et AS (SELECT *, h / (1 + 0.2 * rh) AS tt FROM eh)"


def episodes(spark, sf):
    e = market.events(spark, sf)
    return e.select("event_id", F.least(F.lit(1.0), c("value") / 100).alias("st"), ((F.lit(1706745600000000) - c("us")) / 3.6e9).alias("h"), (c("user_id") % 5).alias("rh"))


points(
    "x17_forgetting_curve", episodes, (f"WITH {EP}", "et"), ["event_id"],
    {
        "exponential": (lambda: X.retention(c("st"), c("h"), c("rh"), "exponential"), "greatest(0, least(1, st * exp(-0.05 * tt)))"),
        "power": (lambda: X.retention(c("st"), c("h"), c("rh"), "power"), "greatest(0, least(1, st * pow(1 + 0.1 * tt, -0.8)))"),
        "logarithmic": (lambda: X.retention(c("st"), c("h"), c("rh"), "logarithmic"), "greatest(0, least(1, st * ln(2) / ln(1 + greatest(tt, 0.01))))"),
        "decayed_confidence": (lambda: c("st") * F.exp(-0.1 * c("h") / 24), "st * exp(-0.1 * h / 24)"),
    },
    digits=6,
)

doc_src = lambda spark, sf: market.table(spark, sf, "documents")
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '[URL]', 'g'), '\$([A-Z]{2,5})($|[^\p{L}\p{N}_])', '[TICKER_\1]\2', 'g'), '@[\p{L}\p{N}_]+', '[MENTION]', 'g'), '#([\p{L}\p{N}_]+)', '\1', 'g'), '\s+', ' ', 'g'), ' ')"


@query("x21_clean_text", f"SELECT doc_id, md5({CLEAN}) AS digest, length({CLEAN}) AS n FROM documents")
def x21(spark, sf):
    x = T.clean(c("text"))
    return doc_src(spark, sf).select("doc_id", F.md5(x).alias("digest"), F.length(x).cast("bigint").alias("n"))


@query("x22_spam", "SELECT conv_id, turn, regexp_matches(lower(text), '" + "|".join(T.BOT_PHRASES) + "') OR length(text) < 10 OR length(regexp_replace(text, '\\P{Lu}', '', 'g')) * 1.0 / greatest(length(text), 1) > 0.7 AS spam FROM conversations")
def x22(spark, sf):
    return market.table(spark, sf, "conversations").select("conv_id", "turn", T.is_spam(c("text")).alias("spam"))


ENG = "least(ln(1 + n_chars + 3 * (doc_id % 7) + 2 * (doc_id % 5)) / 10 * (0.5 + 0.5 * least(ln(1 + doc_id) / 10, 1)), 1)"
points(
    "x23_engagement", doc_src, ("", "documents"), ["doc_id"],
    {
        "post": (lambda: T.engagement(c("n_chars"), c("doc_id") % 7, c("doc_id") % 5, c("doc_id")), ENG), "thread": (lambda: T.thread_engagement(c("n_chars"), c("doc_id") % 9), "least(ln(1 + n_chars + 2 * (doc_id % 9)) / 10, 1)"),
        "credibility": (lambda: T.credibility(F.when(c("source") == "src1", "Reuters").otherwise(c("source"))), "CASE WHEN source = 'src1' THEN 0.95 ELSE 0.5 END"),
    },
    digits=6,
)
HIT = {k: " OR ".join(f"contains(lower(text), '{w}')" for w in ws) for k, ws in T.EVENTS.items()}


@query("x24_event_categories", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {h} THEN '{k}' END" for k, h in HIT.items()) + ") AS categories, CASE " + " ".join(f"WHEN {h} THEN '{k}'" for k, h in HIT.items()) + " END AS primary_category FROM documents WHERE " + " OR ".join(HIT.values()))
def x24(spark, sf):
    """Keyword events over whole texts; the first category is the primary one."""
    x = doc_src(spark, sf).select("doc_id", F.lower("text").alias("low")).withColumn("cats", T.event_categories(c("low"))).where(F.size("cats") > 0)
    return x.select("doc_id", F.array_join("cats", ",").alias("categories"), F.get("cats", F.lit(0)).alias("primary_category"))


@query(
    "x26_dialects",
    "WITH t AS (SELECT event_id, ['30s', '5m', '4h', '1d', '2w'][CAST(user_id % 5 + 1 AS INTEGER)] AS tf, ['A', 'N', 'R'][CAST(user_id % 3 + 1 AS INTEGER)] AS v, upper(event_type) AS b FROM events) "
    "SELECT event_id, round(CASE tf WHEN '30s' THEN 0.5 WHEN '5m' THEN 5 WHEN '4h' THEN 240 WHEN '1d' THEN 1440 ELSE 20160 END, 4)::DOUBLE AS minutes, CASE v WHEN 'A' THEN b || 'USDT' WHEN 'N' THEN b || '-USDT' ELSE b || '/USDT' END AS symbol FROM t",
)
def x26(spark, sf):
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (c("user_id") % k + 1).cast("int"))
    return market.events(spark, sf).select(
        "event_id", F.round(X.timeframe_minutes(pick(["30s", "5m", "4h", "1d", "2w"], 5)), 4).alias("minutes"), X.dialect_symbol(F.upper("event_type"), F.lit("USDT"), pick("ANR", 3)).alias("symbol")
    )


@query(
    "x27_scalers",
    f"WITH {BARS}, s AS (SELECT avg(volume) AS m, stddev_pop(volume) AS sd, min(volume) AS lo, max(volume) AS hi, quantile_cont(volume, 0.5) AS md, quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25) AS iqr FROM bar) SELECT symbol, t, {R('(volume - m) / sd', 6)} AS standard, {R('(volume - lo) / (hi - lo)', 6)} AS minmax, {R('(volume - md) / iqr', 6)} AS robust, {R('(volume - m) / sd * sd + m', 4)} AS inverse FROM bar, s",
)
def x27(spark, sf):
    b = market.bars(spark, sf).select("symbol", "t", "volume")
    st = b.agg(F.avg("volume").alias("m"), F.stddev_pop("volume").alias("sd"), F.min("volume").alias("lo"), F.max("volume").alias("hi"))
    q = exact_percentiles(b, [], "volume", {"q1": 0.25, "md": 0.5, "q3": 0.75})
    x = b.join(F.broadcast(st), F.lit(True)).join(F.broadcast(q), F.lit(True))
    z = (c("volume") - c("m")) / c("sd")
    return x.select("symbol", "t", r(z, 6).alias("standard"), r((c("volume") - c("lo")) / (c("hi") - c("lo")), 6).alias("minmax"), r((c("volume") - c("md")) / (c("q3") - c("q1")), 6).alias("robust"), r(z * c("sd") + c("m")).alias("inverse"))


@query("x28_pad_sequences", "WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_concat(w[1:32], list_transform(range(0, 32 - len(w[1:32])), lambda x: '<pad>')), ' ') AS padded, least(32, len(w)) AS mask_sum FROM s")
def x28(spark, sf):
    w = F.slice(F.split("text", " "), 1, 32)
    n = F.size(w)
    pad = F.concat(w, F.array_repeat(F.lit("<pad>"), 32 - n))
    return market.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(pad, " ").alias("padded"), n.cast("bigint").alias("mask_sum"))


@query(
    "x32_execution_schedules",
    f"""WITH o AS (SELECT o_orderkey AS order_id, o_totalprice AS q, unnest(range(0, 8)) AS k FROM orders), n AS (SELECT *, sqrt(0.1 * 0.0004 / 0.1) AS kp FROM o), x AS (SELECT *, q * sinh(kp * (8 - k)) / sinh(kp * 8) AS h0, q * sinh(kp * (7 - k)) / sinh(kp * 8) AS h1, [0.2, 0.15, 0.1, 0.05, 0.05, 0.1, 0.15, 0.2][CAST(k + 1 AS INTEGER)] AS p FROM n)
SELECT order_id, CAST(k AS INTEGER) AS slice, {R('q / 8', 2)} AS twap, {R('q * p', 2)} AS vwap, {R('h0 - h1', 2)} AS optimal FROM x""",
)
def x32(spark, sf):
    """Slices of every order: equal, by volume profile, impact-optimal."""
    prof = [0.2, 0.15, 0.1, 0.05, 0.05, 0.1, 0.15, 0.2]
    kp = math.sqrt(0.1 * 0.0004 / 0.1)
    o = market.orders(spark, sf).select("order_id", c("notional").alias("q"), F.posexplode(F.array(*[F.lit(p) for p in prof])).alias("slice", "p"))
    hold = lambda k: c("q") * F.sinh(kp * (8 - k)) / math.sinh(kp * 8)
    return o.select("order_id", "slice", r(c("q") / 8, 2).alias("twap"), r(c("q") * c("p"), 2).alias("vwap"), r(hold(c("slice")) - hold(c("slice") + 1), 2).alias("optimal"))


RTE = "rt AS (SELECT s_suppkey AS venue, s_nationkey AS market, 1 / (1 + (s_suppkey % 17) / 10.0) * 0.4 + 1 / (1 + (s_suppkey % 5)) * 0.3 + least(1, greatest(s_acctbal, 0) / 10000) * 0.3 AS sc FROM supplier), rk AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY sc DESC, venue) AS k, sum(sc) OVER (PARTITION BY market) AS tot, count(*) OVER (PARTITION BY market) AS n FROM rt), al AS (SELECT *, floor(1000 * sc / tot) AS q FROM rk)"


@query("x33_venue_routing", f"WITH {RTE} SELECT market, venue, k, {R('sc', 6)} AS score, CASE WHEN k = n THEN 1000 - sum(CASE WHEN k < n THEN q ELSE 0 END) OVER (PARTITION BY market) ELSE q END AS quantity FROM al")
def x33(spark, sf):
    """Score venues by latency, fee and liquidity; split an order in proportion,
    the last venue takes the rounding rest."""
    s = market.table(spark, sf, "supplier")
    k = c("s_suppkey")
    sc = 1 / (1 + (k % 17) / 10.0) * 0.4 + 1 / (1 + (k % 5)) * 0.3 + F.least(F.lit(1.0), F.greatest(c("s_acctbal"), F.lit(0.0)) / 10000) * 0.3
    x = s.select(k.alias("venue"), c("s_nationkey").alias("market"), sc.alias("sc"))
    w, p = Window.partitionBy("market").orderBy(F.desc("sc"), "venue"), Window.partitionBy("market")
    x = x.select("*", F.row_number().over(w).alias("k"), F.sum("sc").over(p).alias("tot"), F.count(F.lit(1)).over(p).alias("n")).withColumn("q", F.floor(1000 * c("sc") / c("tot")).cast("double"))
    rest = 1000 - F.sum(F.when(c("k") < c("n"), c("q")).otherwise(0.0)).over(p)
    return x.select("market", "venue", "k", r("sc", 6).alias("score"), F.when(c("k") == c("n"), rest).otherwise(c("q")).alias("quantity"))


@query(
    "x36_feature_versions",
    "WITH d AS (SELECT p_brand AS feature, p_partkey AS id, p_type || ':' || p_size AS def FROM part), v AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY id) AS version FROM d) SELECT feature, CAST(version AS INTEGER) AS version, id, sha256(feature || '|' || def) AS fingerprint FROM v",
)
def x36(spark, sf):
    """Definition versions per feature with a fingerprint."""
    p = market.table(spark, sf, "part").select(c("p_brand").alias("feature"), c("p_partkey").alias("id"), F.concat_ws(":", "p_type", c("p_size").cast("string")).alias("def"))
    s = Series.of(p, ["feature"], ["id"])
    return s.rows.select("feature", c(IDX).cast("int").alias("version"), "id", F.sha2(F.concat_ws("|", "feature", "def"), 256).alias("fingerprint"))
