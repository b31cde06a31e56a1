"""Batch twins of the streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.features import PRED, predictions
from tapeworks.catalog.reports import equity
from tapeworks.catalog.sql import BARS, EQUITY, R, SERIES, TICK, TRADE, full, over
from tapeworks.operators import monitors as M
from tapeworks.operators import reports as P
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

c = lambda n: F.col(n)


@query(
    "t02_sliding_vwap",
    f"WITH {TICK}, d AS (SELECT symbol, day, sum(price * qty) AS n, sum(qty) AS q FROM tick GROUP BY 1, 2) SELECT symbol, day, {R('sum(n) OVER w / sum(q) OVER w')} AS vwap FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)",
)
def t02(spark, sf):
    """30-day VWAP; ticks are reduced per day first (one row per day in a window)."""
    d = market.ticks(spark, sf).groupBy("symbol", "day").agg(F.sum(c("price") * c("qty")).alias("n"), F.sum("qty").alias("q"))
    w = Window.partitionBy("symbol").orderBy("day").rangeBetween(-29, 0)
    return d.select("symbol", "day", r(F.sum("n").over(w) / F.sum("q").over(w)).alias("vwap"))


@query(
    "t03_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS ticks FROM s GROUP BY user_id, sid""",
)
def t03(spark, sf):
    """Activity sessions with a 6-hour gap."""
    e = market.events(spark, sf).withColumn("ts", c("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("ticks"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "ticks")


@query(
    "t04_tick_quality",
    f"""WITH {TICK}, x AS (SELECT symbol, day - lag(day) OVER w > 5 AS gap, abs(price / lag(price) OVER w - 1) > 0.1 AS mv FROM tick WINDOW w AS (PARTITION BY symbol ORDER BY ts, o1, o2, o3, price, qty))
SELECT symbol, count(*) AS ticks, count(*) FILTER (gap) AS gaps, count(*) FILTER (mv) AS moves, {R('count(*) FILTER (gap) * 1.0 / count(*)', 6)} AS gap_rate FROM x GROUP BY 1""",
)
def t04(spark, sf):
    s = Series.of(market.ticks(spark, sf), ["symbol"], ["ts", "o1", "o2", "o3", "price", "qty"])
    s = s.bounded(1, {"gap": lambda w: c("day") - w.lag("day") > 5, "mv": lambda w: F.abs(c("price") / w.lag("price") - 1) > 0.1})
    return s.df.groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.count_if("gap").alias("gaps"), F.count_if("mv").alias("moves"), r(F.count_if("gap") / F.count(F.lit(1)), 6).alias("gap_rate"))


TRIP = f"tp AS (SELECT symbol, t, i, coalesce(abs(close / pc - 1) > 0.9 OR volume > 5 * avg(volume) {over(20)}, false) AS trip FROM bar)"


@query(
    "t07_circuit_breaker",
    f"""WITH RECURSIVE {BARS}, {TRIP}, q AS MATERIALIZED (SELECT * FROM tp),
k AS (SELECT symbol, i, t, CASE WHEN trip THEN 'open' ELSE 'closed' END AS st, CASE WHEN trip THEN t END AS since, trip AS emit FROM q WHERE i = 1
 UNION ALL SELECT symbol, i, t, CASE WHEN trip AND st2 <> 'open' THEN 'open' WHEN st2 = 'half' THEN 'closed' ELSE st2 END, CASE WHEN trip AND st2 <> 'open' THEN t ELSE since END, (trip AND st2 <> 'open') OR st2 = 'half' FROM (
  SELECT q.symbol, q.i, q.t, q.trip, k.since, CASE WHEN k.st = 'open' AND q.t - k.since >= 3 THEN 'half' ELSE k.st END AS st2 FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1))
SELECT symbol, t, st AS state FROM k WHERE emit""",
)
def t07(spark, sf):
    """Price-move or volume trips, three bars of cooldown, half-open probe."""
    s = bar_series(spark, sf).bounded(19, {"trip": lambda w: F.coalesce((F.abs(c("close") / w.lag("close") - 1) > 0.9) | (c("volume") > 5 * F.avg("volume").over(w(20))), F.lit(False))})
    return M.circuit_breaker(s.df, ["symbol"], "t", "trip", 3)


# exponential averages of squared log returns, started with the first one
EMAS = """lr AS (SELECT symbol, t, i, close, volume, low, high, pc, ln(close / pc) AS r FROM bar),
em AS (SELECT symbol, i, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS s FROM lr WHERE i = 1 UNION ALL SELECT lr.symbol, lr.i, CASE WHEN em.f IS NULL THEN r * r ELSE 0.1 * r * r + 0.9 * f END, CASE WHEN em.s IS NULL THEN r * r ELSE 0.02 * r * r + 0.98 * s END FROM em JOIN lr ON lr.symbol = em.symbol AND lr.i = em.i + 1)"""
REASON = f"""{EMAS}, rs AS (SELECT symbol, t, i, CASE WHEN abs(close / pc - 1) > 0.9 THEN 'price' WHEN volume > 4 * avg(volume) {over(20)} THEN 'volume' WHEN (high - low) / ((high + low) / 2) * 100 > 120 THEN 'spread' WHEN i >= 10 AND s > 0 AND f / s > 1.5 THEN 'volatility' END AS reason FROM lr JOIN em USING (symbol, i))"""


def opened(cte: str, key: str, i: str, t: str, trip: str, cooldown: int) -> str:
    """Closed, open and half-open states of a breaker, row by row."""
    return f"""k AS (SELECT {key}, {i}, {t}, CASE WHEN {trip} THEN 'open' ELSE 'closed' END AS st, CASE WHEN {trip} THEN {t} END AS since, {trip} AS emit FROM {cte} WHERE {i} = 1
 UNION ALL SELECT {key}, {i}, {t}, CASE WHEN tr AND st2 <> 'open' THEN 'open' WHEN st2 = 'half' THEN 'closed' ELSE st2 END, CASE WHEN tr AND st2 <> 'open' THEN {t} ELSE since END, (tr AND st2 <> 'open') OR st2 = 'half' FROM (
  SELECT q.{key}, q.{i}, q.{t}, {trip.replace('reason', 'q.reason')} AS tr, k.since, CASE WHEN k.st = 'open' AND q.{t} - k.since >= {cooldown} THEN 'half' ELSE k.st END AS st2 FROM k JOIN {cte} q ON q.{key} = k.{key} AND q.{i} = k.{i} + 1))"""


@query("t07_breaker_reasons", f"WITH RECURSIVE {BARS}, {REASON}, {opened('rs', 'symbol', 'i', 't', '(reason IS NOT NULL)', 3)} SELECT k.symbol, k.t, k.st AS state, CASE WHEN k.st = 'open' THEN rs.reason END AS reason FROM k JOIN rs USING (symbol, i) WHERE emit")
def t07r(spark, sf):
    """Four rules, first reason wins; three bars of cooldown, half-open probe."""
    s = M.trip_reasons(bar_series(spark, sf).mutate(bid=c("low"), ask=c("high")), 0.9, 4.0, 120.0, 1.5)
    x = s.df.select("symbol", "t", "reason", c("reason").isNotNull().alias("trip"))
    got = M.circuit_breaker(x, ["symbol"], "t", "trip", 3)
    return got.join(x.select("symbol", "t", "reason"), ["symbol", "t"]).select("symbol", "t", "state", F.when(c("state") == "open", c("reason")).alias("reason"))


@query("t09_breaker_cooldown", f"WITH RECURSIVE {EQUITY}, b AS (SELECT strategy_id, day, row_number() OVER (PARTITION BY strategy_id ORDER BY day) AS j, CASE WHEN sum(pnl) OVER (PARTITION BY strategy_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) < -10000 THEN 'loss' WHEN stddev_samp(ret) OVER (PARTITION BY strategy_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0.05 THEN 'volatility' END AS reason FROM er), {opened('b', 'strategy_id', 'j', 'day', '(reason IS NOT NULL)', 10)} SELECT strategy_id, k.day, k.st AS state FROM k WHERE emit")
def t09c(spark, sf):
    """The loss and volatility breaker holds for ten days before a probe."""
    s = Series.of(equity(spark, sf), ["strategy_id"], ["day"]).bounded(
        20, {"ret": lambda w: c("equity") / w.lag("equity") - 1}, {"loss": lambda w: F.sum("pnl").over(w(5)), "vol": lambda w: F.stddev_samp("ret").over(w(20))}
    )
    trip = F.coalesce((c("loss") < -10000) | (c("vol") > 0.05), F.lit(False))
    x = s.df.select("strategy_id", "day", trip.alias("trip"))
    return M.circuit_breaker(x, ["strategy_id"], "day", "trip", 10).withColumnRenamed("t", "day")


@query(
    "t09_loss_breaker",
    f"""WITH {EQUITY}, b AS (SELECT strategy_id, day, pnl, sum(pnl) OVER (PARTITION BY strategy_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS loss, stddev_samp(ret) OVER (PARTITION BY strategy_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM er)
SELECT strategy_id, day, {R('loss', 2)} AS loss_5d, CASE WHEN loss < -10000 THEN 'loss' ELSE 'volatility' END AS reason FROM b WHERE loss < -10000 OR vol > 0.05""",
)
def t09(spark, sf):
    s = Series.of(equity(spark, sf), ["strategy_id"], ["day"]).bounded(
        20, {"ret": lambda w: c("equity") / w.lag("equity") - 1}, {"loss": lambda w: F.sum("pnl").over(w(5)), "vol": lambda w: F.stddev_samp("ret").over(w(20))}
    )
    x = s.df.where((c("loss") < -10000) | (c("vol") > 0.05))
    return x.select("strategy_id", "day", r("loss", 2).alias("loss_5d"), F.when(c("loss") < -10000, "loss").otherwise("volatility").alias("reason"))


@query(
    "t10_ewma_var",
    f"""WITH {EQUITY}, x AS (SELECT strategy_id, day, ret, row_number() OVER (PARTITION BY strategy_id ORDER BY day) AS j FROM er WHERE ret IS NOT NULL), tl AS (SELECT *, max(j) OVER (PARTITION BY strategy_id) AS n FROM x),
v AS (SELECT strategy_id, sqrt(sum(CASE WHEN j = 1 THEN ret * ret * pow(0.94, n - 1) ELSE 0.06 * ret * ret * pow(0.94, n - j) END)) AS vol, quantile_cont(ret, 0.05) AS q FROM tl GROUP BY 1)
SELECT strategy_id, {R('vol', 6)} AS ewma_vol, {R('-q', 6)} AS var_95, vol > 0.01 AS alert FROM v""",
)
def t10(spark, sf):
    from tapeworks.plans.quantiles import exact_percentiles

    ret = P.returns(equity(spark, sf), ["strategy_id"], "day").df.where("ret is not null")
    s = M.ewma_volatility(Series.of(ret, ["strategy_id"], ["day"]), "ret")
    g = s.df.groupBy("strategy_id").agg(F.max_by("ewma_vol", "day").alias("v"))
    q = exact_percentiles(ret, ["strategy_id"], "ret", {"q": 0.05})
    return g.join(q, "strategy_id").select("strategy_id", r("v", 6).alias("ewma_vol"), r(-c("q"), 6).alias("var_95"), (c("v") > 0.01).alias("alert"))


@query("t11_drift_detectors")
def t11(spark, sf):
    """Three detectors per model over its error stream."""
    p = predictions(spark, sf)
    s = Series.of(p, ["model", "regime"], ["ts", "o1", "o2", "o3", "o4"])
    err = F.when(c("correct") == (c("prob") > 0.5), 0.0).otherwise(1.0)
    x = s.rows.select("model", "regime", c(IDX).alias("k"), err.alias("err"))
    d = M.detectors(x, ["model", "regime"], ["k"], "k", "err")
    return d.groupBy("detector", "model", "regime", "event").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k"))


@query("t13_latest_price_ttl", f"WITH {TICK}, m AS (SELECT max(day) AS now FROM tick), l AS (SELECT symbol, venue, arg_max(price, (ts, o1, o2, o3, price)) AS price, max(day) AS day FROM tick GROUP BY 1, 2) SELECT symbol, venue, price FROM l, m WHERE now - day <= 30")
def t13(spark, sf):
    tk = market.ticks(spark, sf)
    now = tk.agg(F.max("day").alias("now"))
    l = tk.groupBy("symbol", "venue").agg(F.max_by("price", F.struct(*market.TICK_ORDER)).alias("price"), F.max("day").alias("day"))
    return l.join(F.broadcast(now), F.lit(True)).where(c("now") - c("day") <= 30).select("symbol", "venue", "price")


@query("t14_dedupe", "SELECT l_returnflag AS venue, l_suppkey AS symbol, l_orderkey AS trade_id FROM lineitem GROUP BY 1, 2, 3")
def t14(spark, sf):
    li = market.table(spark, sf, "lineitem").select(c("l_returnflag").alias("venue"), c("l_suppkey").alias("symbol"), c("l_orderkey").alias("trade_id"))
    return li.dropDuplicates(["venue", "symbol", "trade_id"])


@query("t15_freshness", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, CAST(floor((1706745600000000 - epoch_us(last)) / 3600000000.0) AS BIGINT) AS age_hours, (1706745600000000 - epoch_us(last)) > 48 * 3600000000 AS stale FROM l")
def t15(spark, sf):
    g = market.events(spark, sf).groupBy("user_id").agg(F.max("us").alias("last"))
    age = F.lit(1706745600000000) - c("last")
    return g.select("user_id", F.floor(age / 3600000000.0).alias("age_hours"), (age > 48 * 3600000000).alias("stale"))


@query("t15_newly_stale", "WITH g AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) SELECT user_id, us + 172800000000 AS stale_us, nx AS fresh_us FROM g WHERE coalesce(nx, 1706745600000000) - us > 172800000000")
def t15n(spark, sf):
    """When a user's feature became stale (48 hours without an event), and the
    event that made it fresh again."""
    s = Series.of(market.events(spark, sf).select("user_id", "us", "event_id"), ["user_id"], ["us", "event_id"]).bounded(0, {"nx": lambda w: w.lead("us")}, ahead=1)
    limit = 48 * 3600000000
    return s.df.where(F.coalesce("nx", F.lit(1706745600000000)) - c("us") > limit).select("user_id", (c("us") + limit).alias("stale_us"), c("nx").alias("fresh_us"))


@query(
    "t12_alert_gate",
    """WITH RECURSIVE h AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value > 60),
g AS (SELECT user_id, us, i, us AS at_us, 1 AS n, true AS emit FROM h WHERE i = 1 UNION ALL SELECT h.user_id, h.us, h.i, CASE WHEN h.us - g.at_us >= 86400000000 THEN h.us ELSE g.at_us END, CASE WHEN h.us - g.at_us >= 86400000000 THEN g.n + 1 ELSE g.n END, h.us - g.at_us >= 86400000000 FROM g JOIN h ON h.user_id = g.user_id AND h.i = g.i + 1)
SELECT user_id, us, CASE WHEN n > 3 THEN 'escalated' ELSE 'sent' END AS state FROM g WHERE emit""",
)
def t12g(spark, sf):
    """Alerts on large values: one a day at most, escalated after three."""
    from tapeworks.plans.fold import ordered_fold
    from tapeworks.streaming.jobs import AlertGate

    e = market.events(spark, sf).where("value > 60")
    return ordered_fold(e, ["user_id"], ["us", "event_id"], ["us"], lambda: AlertGate(86400000000, 3), "us bigint, state string")


@query(
    "t18_auto_disable",
    f"WITH {EQUITY}, s AS (SELECT strategy_id, day, i, avg(pnl) OVER w / stddev_pop(pnl) OVER w * sqrt(252) AS sh FROM eq WINDOW w AS (PARTITION BY strategy_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT strategy_id, day, {R('CASE WHEN i >= 20 THEN sh END')} AS sharpe, coalesce(i >= 20 AND sh < 0, false) AS disabled FROM s",
)
def t18(spark, sf):
    s = M.auto_disable(Series.of(equity(spark, sf), ["strategy_id"], ["day"]), "pnl")
    return s.df.select("strategy_id", "day", r("sharpe_n").alias("sharpe"), "disabled")


@query(
    "t19_platform_gauges",
    f"WITH o AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, count(*) AS orders, sum(o_totalprice) AS v FROM orders GROUP BY 1), x AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, count(*) AS trades FROM lineitem GROUP BY 1) "
    f"SELECT day, coalesce(orders, 0) AS orders, coalesce(trades, 0) AS trades, {R('coalesce(v, 0)', 2)} AS value FROM o FULL JOIN x USING (day)",
)
def t19(spark, sf):
    o = market.orders(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("orders"), F.sum("notional").alias("v"))
    t = market.ticks(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("trades"))
    z = F.lit(0)
    return o.join(t, "day", "full").select("day", F.coalesce("orders", z).alias("orders"), F.coalesce("trades", z).alias("trades"), r(F.coalesce("v", F.lit(0.0)), 2).alias("value"))


@query(
    "t16_order_fill_join",
    "SELECT o_orderpriority AS priority, count(*) AS fills, CAST(sum(date_diff('day', o_orderdate, l_shipdate)) AS BIGINT) AS delay FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY 1",
)
def t16(spark, sf):
    """Orders with their fills inside a time bound (equi-key plus bound)."""
    o = market.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    li = market.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    x = o.join(li, (c("o_orderkey") == c("l_orderkey")) & (c("l_shipdate") >= c("o_orderdate")) & (c("l_shipdate") <= c("o_orderdate") + F.expr("INTERVAL 60 DAYS")))
    return x.groupBy(c("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("fills"), F.sum(F.date_diff("l_shipdate", "o_orderdate")).alias("delay"))
