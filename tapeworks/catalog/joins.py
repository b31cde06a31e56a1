"""Joins across venues, instruments and time."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.sql import ASSET, BARS, R, SERIES, TICK, TRADE
from tapeworks.operators import candles as C
from tapeworks.plans import joins as J
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

LATEST = f"{TICK}, lp AS (SELECT symbol, venue, arg_max(price, (ts, o1, o2, o3, price)) AS price FROM tick GROUP BY 1, 2)"


def latest(spark, sf):
    """Latest price per (symbol, venue): the arbitrage joins start from this
    reduced table, a few rows per symbol."""
    return market.ticks(spark, sf).groupBy("symbol", "venue").agg(F.max_by("price", F.struct(*market.TICK_ORDER)).alias("price"))


def venue_pairs(px, fee_bps, ordered=True):
    a = px.select("symbol", F.col("venue").alias("buy_venue"), F.col("price").alias("buy_price"))
    b = px.select("symbol", F.col("venue").alias("sell_venue"), F.col("price").alias("sell_price"))
    cond = F.col("buy_venue") != F.col("sell_venue") if ordered else F.col("buy_venue") < F.col("sell_venue")
    return a.join(b, "symbol").where(cond & (F.col("buy_price") > 0) & (F.col("sell_price") > 0))


@query(
    "j02_venue_arbitrage",
    f"WITH {LATEST} SELECT a.symbol, a.venue AS buy_venue, b.venue AS sell_venue, {R('(b.price - a.price) / a.price * 100')} AS spread_pct, {R('b.price - a.price - (a.price + b.price) * 0.001')} AS profit FROM lp a JOIN lp b ON a.symbol = b.symbol AND a.venue <> b.venue WHERE b.price - a.price - (a.price + b.price) * 0.001 > 0",
)
def j02(spark, sf):
    x = venue_pairs(latest(spark, sf), 10)
    profit = F.col("sell_price") - F.col("buy_price") - (F.col("buy_price") + F.col("sell_price")) * 0.001
    return x.where(profit > 0).select("symbol", "buy_venue", "sell_venue", r((F.col("sell_price") - F.col("buy_price")) / F.col("buy_price") * 100).alias("spread_pct"), r(profit).alias("profit"))


SP = "abs(a.price - b.price) / least(a.price, b.price) * 10000"


@query(
    "j03_b18_best_venue_pair",
    f"""WITH {LATEST}, p AS (SELECT a.symbol, CASE WHEN a.price < b.price THEN a.venue ELSE b.venue END AS buy, CASE WHEN a.price < b.price THEN b.venue ELSE a.venue END AS sell, {SP} AS sp FROM lp a JOIN lp b ON a.symbol = b.symbol AND a.venue < b.venue)
SELECT symbol, arg_max(buy, sp) AS buy_venue, arg_max(sell, sp) AS sell_venue, {R('max(sp) - 15', 2)} AS net_profit_bps, CASE WHEN max(sp) < 5000 THEN 'exit' ELSE 'hold' END AS state FROM p WHERE sp > 20 GROUP BY 1""",
)
def j03(spark, sf):
    """Best pair above fee + latency + profit (10 + 5 + 5 bps); a pair closes
    when its spread falls below the exit level."""
    x = venue_pairs(latest(spark, sf), 10, ordered=False)
    sp = F.abs(F.col("buy_price") - F.col("sell_price")) / F.least("buy_price", "sell_price") * 10000
    low = F.col("buy_price") < F.col("sell_price")
    row = F.struct(sp.alias("sp"), F.when(low, F.col("buy_venue")).otherwise(F.col("sell_venue")).alias("buy"), F.when(low, F.col("sell_venue")).otherwise(F.col("buy_venue")).alias("sell"))
    g = x.where(sp > 20).groupBy("symbol").agg(F.max(row).alias("m"))
    return g.select("symbol", F.col("m.buy").alias("buy_venue"), F.col("m.sell").alias("sell_venue"), r(F.col("m.sp") - 15, 2).alias("net_profit_bps"), F.when(F.col("m.sp") < 5000, "exit").otherwise("hold").alias("state"))


FUND = f"{TICK}, fr AS (SELECT symbol, venue, avg(CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END) * 0.01 AS rate FROM tick GROUP BY 1, 2)"


def funding(spark, sf):
    """Funding rate stand-in per (symbol, venue): order-flow balance / 100."""
    return market.ticks(spark, sf).groupBy("symbol", "venue").agg((F.avg(F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)) * 0.01).alias("rate"))


@query(
    "j04_funding_arbitrage",
    f"WITH {FUND} SELECT a.symbol, CASE WHEN a.rate > b.rate THEN a.venue ELSE b.venue END AS short_venue, CASE WHEN a.rate > b.rate THEN b.venue ELSE a.venue END AS long_venue, {R('abs(a.rate - b.rate)', 6)} AS funding_spread, {R('abs(a.rate - b.rate) - 0.0002', 6)} AS net_profit FROM fr a JOIN fr b ON a.symbol = b.symbol AND a.venue < b.venue WHERE abs(a.rate - b.rate) > 0.0005",
)
def j04(spark, sf):
    f = funding(spark, sf)
    a, b = f.select("symbol", F.col("venue").alias("va"), F.col("rate").alias("ra")), f.select("symbol", F.col("venue").alias("vb"), F.col("rate").alias("rb"))
    sp = F.abs(F.col("ra") - F.col("rb"))
    up = F.col("ra") > F.col("rb")
    x = a.join(b, "symbol").where((F.col("va") < F.col("vb")) & (sp > 0.0005) & (sp - 0.0002 > 0))
    return x.select("symbol", F.when(up, F.col("va")).otherwise(F.col("vb")).alias("short_venue"), F.when(up, F.col("vb")).otherwise(F.col("va")).alias("long_venue"), r(sp, 6).alias("funding_spread"), r(sp - 0.0002, 6).alias("net_profit"))


EXP = f"{TICK}, ex AS (SELECT symbol, venue, sum(qty) AS q FROM tick GROUP BY 1, 2), ac AS (SELECT symbol, venue, sum(qty) AS q FROM tick WHERE price > 400 AND (venue <> 'A' OR symbol > 2) GROUP BY 1, 2)"


@query(
    "j05_reconciliation",
    f"""WITH {EXP} SELECT 'missing_position' AS field, ex.symbol, ex.venue, ex.q AS expected, CAST(NULL AS DOUBLE) AS actual FROM ex LEFT JOIN ac USING (symbol, venue) WHERE ac.q IS NULL
UNION ALL SELECT 'quantity', ex.symbol, ex.venue, ex.q, ac.q FROM ex JOIN ac USING (symbol, venue) WHERE abs(ex.q - ac.q) > 1e-8
UNION ALL SELECT 'total_value', -1, '*', (SELECT sum(q) FROM ex), (SELECT sum(q) FROM ac) WHERE abs((SELECT sum(q) FROM ex) - (SELECT sum(q) FROM ac)) > 1""",
)
def j05(spark, sf):
    """Two position tables: missing rows, quantity differences, total value."""
    tk = market.ticks(spark, sf)
    ex = tk.groupBy("symbol", "venue").agg(F.sum("qty").alias("expected"))
    ac = tk.where((F.col("price") > 400) & ((F.col("venue") != "A") | (F.col("symbol") > 2))).groupBy("symbol", "venue").agg(F.sum("qty").alias("actual"))
    x = ex.join(ac, ["symbol", "venue"], "left")
    rows = x.where(F.col("actual").isNull() | (F.abs(F.col("expected") - F.col("actual")) > 1e-8)).select(
        F.when(F.col("actual").isNull(), "missing_position").otherwise("quantity").alias("field"), "symbol", "venue", "expected", "actual"
    )
    tot = ex.agg(F.sum("expected").alias("expected")).join(F.broadcast(ac.agg(F.sum("actual").alias("actual"))), F.lit(True))
    total = tot.where(F.abs(F.col("expected") - F.col("actual")) > 1).select(F.lit("total_value").alias("field"), F.lit(-1).cast("bigint").alias("symbol"), F.lit("*").alias("venue"), "expected", "actual")
    return rows.unionByName(total)


@query(
    "j06_trade_vs_mid",
    f"""WITH {TICK}, qt AS (SELECT symbol, day, (max(price) + min(price)) / 2 AS mid FROM tick WHERE venue = 'A' GROUP BY 1, 2), tr AS (SELECT symbol, day, price FROM tick WHERE venue <> 'A'),
x AS (SELECT tr.symbol, tr.price, qt.mid FROM tr ASOF LEFT JOIN qt ON tr.symbol = qt.symbol AND tr.day >= qt.day)
SELECT symbol, count(*) AS trades, count(mid) AS quoted, {R('avg(2 * (price - mid) / mid)')} AS realised_spread, {R('avg(2 * abs(price - mid) / mid)')} AS effective_spread FROM x GROUP BY 1""",
)
def j06(spark, sf):
    """As-of join of trades to the latest mid (the quote of the same day counts)."""
    tk = market.ticks(spark, sf)
    qt = tk.where("venue = 'A'").groupBy("symbol", "day").agg(((F.max("price") + F.min("price")) / 2).alias("mid"))
    tr = tk.where("venue <> 'A'").select("symbol", "day", "price")
    x = J.asof(tr, qt, ["symbol"], "day", "day", ["mid"])
    d = 2 * (F.col("price") - F.col("mid")) / F.col("mid")
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.count("mid").alias("quoted"), r(F.avg(d)).alias("realised_spread"), r(F.avg(F.abs(d))).alias("effective_spread"))


@query(
    "j07_trade_excursions",
    f"""WITH {BARS}, {TRADE}, x AS (SELECT tr.strategy_id, tr.side, tr.price, tr.qty, max(b.high) AS hi, min(b.low) AS lo, arg_max(b.close, b.t) AS ex FROM (SELECT *, row_number() OVER () AS id FROM trade) tr
  JOIN bar b ON b.symbol = tr.symbol AND b.t BETWEEN CAST(floor(entry_day / 7.0) AS BIGINT) AND CAST(floor(exit_day / 7.0) AS BIGINT) GROUP BY id, 1, 2, 3, 4)
SELECT strategy_id, side, count(*) AS trades, {R("sum(CASE WHEN side = 'buy' THEN price - lo ELSE hi - price END * qty)", 1)} AS mae, {R("sum(CASE WHEN side = 'buy' THEN hi - price ELSE price - lo END * qty)", 1)} AS mfe,
 {R("sum((CASE WHEN side = 'buy' THEN hi - price ELSE price - lo END - CASE WHEN side = 'buy' THEN ex - price ELSE price - ex END) * qty)", 1)} AS etd FROM x GROUP BY 1, 2""",
)
def j07(spark, sf):
    """Best and worst price over each holding period (interval join)."""
    b = market.bars(spark, sf).select("symbol", "t", "high", "low", "close")
    tr = market.trades(spark, sf).withColumns({"lo_t": F.floor(F.col("entry_day") / 7), "hi_t": F.floor(F.col("exit_day") / 7)})
    x = J.interval_extremes(tr, b, ["symbol"], "lo_t", "hi_t", "t", {"hi": ("max", "high"), "lo": ("min", "low"), "ex": ("last", "close")}).where("hi is not null")
    c = F.col
    buy = c("side") == "buy"
    mae = F.when(buy, c("price") - c("lo")).otherwise(c("hi") - c("price")) * c("qty")
    mfe = F.when(buy, c("hi") - c("price")).otherwise(c("price") - c("lo")) * c("qty")
    pnl = F.when(buy, c("ex") - c("price")).otherwise(c("price") - c("ex")) * c("qty")
    return x.groupBy("strategy_id", "side").agg(F.count(F.lit(1)).alias("trades"), r(F.sum(mae), 1).alias("mae"), r(F.sum(mfe), 1).alias("mfe"), r(F.sum(mfe - pnl), 1).alias("etd"))


def _tf(ratio: int) -> str:
    return f"""c{ratio} AS (SELECT symbol, CAST(floor(t / {ratio}.0) AS BIGINT) AS c, last(close ORDER BY t) AS cl FROM bar GROUP BY 1, 2),
s{ratio} AS (SELECT symbol, (c + 1) * {ratio} AS at, sign(cl - lag(cl) OVER (PARTITION BY symbol ORDER BY c)) AS v{ratio} FROM c{ratio})"""


@query(
    "j08_b17_multi_timeframe_vote",
    f"""WITH {BARS}, {_tf(4)}, {_tf(13)}, b1 AS (SELECT symbol, t, sign(close - pc) AS v1 FROM bar),
x AS (SELECT b1.symbol, b1.t, v1, v4 FROM b1 ASOF LEFT JOIN s4 ON b1.symbol = s4.symbol AND b1.t >= s4.at), y AS (SELECT x.symbol, x.t, v1, v4, v13 FROM x ASOF LEFT JOIN s13 ON x.symbol = s13.symbol AND x.t >= s13.at),
z AS (SELECT symbol, t, (coalesce(v1, 0) * 1.0 + coalesce(v4, 0) * 2.0 + coalesce(v13, 0) * 3.0) / 6.0 AS score FROM y),
th AS (SELECT *, quantile_cont(abs(score), 0.75) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS th FROM z)
SELECT symbol, t, {R('score', 6)} AS score, {R('th', 6)} AS threshold, CASE WHEN score > th THEN 'long' WHEN score < -th THEN 'short' ELSE 'neutral' END AS direction FROM th""",
)
def j08(spark, sf):
    """Slower bars count only once closed; threshold = 75th percentile of the
    last 100 absolute scores."""
    import numpy as np

    s = bar_series(spark, sf).bounded(1, {"v1": lambda w: F.signum(F.col("close") - w.lag("close"))})
    base = s.df.select("symbol", "t", "close", "v1")
    x = base
    for ratio in (4, 13):
        slow = base.groupBy("symbol", F.floor(F.col("t") / ratio).alias("c")).agg(F.max_by("close", "t").alias("cl"))
        sig = Series.of(slow, ["symbol"], ["c"]).bounded(1, {f"v{ratio}": lambda w: F.signum(F.col("cl") - w.lag("cl"))}).df
        x = J.asof(x, sig.withColumn("at", (F.col("c") + 1) * ratio), ["symbol"], "t", "at", [f"v{ratio}"])
    z = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    score = (z("v1") * 1.0 + z("v4") * 2.0 + z("v13") * 3.0) / 6.0
    s = Series.of(x.select("symbol", "t", score.alias("score")), ["symbol"], ["t"]).mutate(_a=F.abs("score"))

    def pct(v):
        n = v["_a"].shape[1]
        own = v[IDX] + np.arange(n - 1, -1, -1) == v[IDX][:, -1:]
        y = np.sort(np.where(own, v["_a"], np.nan), axis=1)
        cnt = own.sum(axis=1)
        at = (cnt - 1) * 0.75
        a, b, k = np.floor(at).astype(int), np.ceil(at).astype(int), np.arange(len(y))
        return (y[k, a] + (y[k, b] - y[k, a]) * (at - a),)

    s = s.rolling(100, ["_a", IDX], ["threshold"], pct, short_ok=True)
    d = F.when(F.col("score") > F.col("threshold"), "long").when(F.col("score") < -F.col("threshold"), "short").otherwise("neutral")
    return s.df.select("symbol", "t", r("score", 6).alias("score"), r("threshold", 6).alias("threshold"), d.alias("direction"))


PAIR = "sp AS (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier)"


def instrument_pairs(spark, sf):
    """Neighbouring suppliers of one country form a pair."""
    from pyspark.sql import Window

    s = market.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("b"))
    return s.where("b is not null")


def aligned(spark, sf):
    bars = market.bars(spark, sf).select("symbol", "t", "close")
    p = instrument_pairs(spark, sf)
    x = bars.select(F.col("symbol").alias("a"), "t", F.col("close").alias("ca"))
    y = bars.select(F.col("symbol").alias("b"), "t", F.col("close").alias("cb"))
    return p.join(x, "a").join(y, ["b", "t"]).select("a", "b", "t", "ca", "cb")


ALIGN = f"{PAIR}, al AS (SELECT sp.a, sp.b, x.t, x.close AS ca, y.close AS cb FROM sp JOIN bar x ON x.symbol = a JOIN bar y ON y.symbol = b AND y.t = x.t WHERE sp.b IS NOT NULL)"


@query("j09_pair_alignment", f"WITH {BARS}, {ALIGN} SELECT a, b, count(*) AS n, {R('corr(ca, cb)', 6)} AS corr, {R('avg(ca - cb)')} AS mean_spread FROM al GROUP BY 1, 2")
def j09(spark, sf):
    return aligned(spark, sf).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r(F.corr("ca", "cb"), 6).alias("corr"), r(F.avg(F.col("ca") - F.col("cb"))).alias("mean_spread"))


@query(
    "j10_cross_asset",
    f"""WITH {ASSET}, rf AS (SELECT t, asset AS ref, ret AS rr, lag(ret) OVER w AS rp FROM ret WHERE asset IN (0, 1, 2) WINDOW w AS (PARTITION BY asset ORDER BY t)), tg AS (SELECT t, asset, ret AS tr, lag(ret) OVER w AS tp, row_number() OVER (PARTITION BY asset ORDER BY t DESC) AS back FROM ret WINDOW w AS (PARTITION BY asset ORDER BY t)),
j AS (SELECT tg.*, rf.ref, rr, rp FROM tg JOIN rf USING (t) WHERE asset <> ref)
SELECT asset, ref, {R('corr(tr, rr)', 6)} AS corr, {R('covar_samp(tr, rr) / var_pop(rr)', 6)} AS beta, {R('corr(tr, rp) - corr(tp, rr)', 6)} AS lead_lag, {R('exp(sum(ln(1 + tr)) FILTER (back <= 20)) / exp(sum(ln(1 + rr)) FILTER (back <= 20)) - 1', 6)} AS relative_strength FROM j GROUP BY 1, 2""",
)
def j10(spark, sf):
    """Every asset against three reference assets, joined on t."""
    p = market.nation_returns(spark, sf).select("asset", "t", "ret")
    s = Series.of(p, ["asset"], ["t"]).totals(_n=F.count(F.lit(1))).bounded(1, {"_prev": lambda w: w.lag("ret")})
    rows = s.rows.withColumn("back", F.col("_n") - F.col(IDX) + 1)
    tg = rows.select("asset", "t", F.col("ret").alias("tr"), F.col("_prev").alias("tp"), "back")
    rf = rows.where(F.col("asset").isin(0, 1, 2)).select(F.col("asset").alias("ref"), "t", F.col("ret").alias("rr"), F.col("_prev").alias("rp"))
    j = tg.join(rf, "t").where(F.col("asset") != F.col("ref"))
    near = F.col("back") <= 20
    growth = lambda c: F.exp(F.sum(F.when(near, F.log1p(c))))
    return j.groupBy("asset", "ref").agg(
        r(F.corr("tr", "rr"), 6).alias("corr"), r(F.covar_samp("tr", "rr") / F.var_pop("rr"), 6).alias("beta"),
        r(F.corr("tr", "rp") - F.corr("tp", "rr"), 6).alias("lead_lag"), r(growth("tr") / growth("rr") - 1, 6).alias("relative_strength"),
    )


@query(
    "j20_semi_anti",
    "SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')) AS parts_not_returned, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS urgent_customers, "
    "(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orders_without_lines",
)
def j20(spark, sf):
    t = lambda n: market.table(spark, sf, n)
    li, o = t("lineitem"), t("orders")
    a = t("part").join(li.where("l_returnflag = 'A'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").agg(F.count(F.lit(1)).alias("parts_not_returned"))
    b = t("customer").join(o.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("urgent_customers"))
    c = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("orders_without_lines"))
    return a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(c), F.lit(True))


@query(
    "j21_b16_walk_forward_windows",
    f"""WITH {BARS}, n AS (SELECT symbol, max(i) AS n FROM bar GROUP BY 1), w AS (SELECT symbol, k, k * 26 AS lo, k * 26 + 104 AS cut, k * 26 + 130 AS hi FROM n, range(0, 100) AS r(k) WHERE k * 26 + 130 <= n)
SELECT w.symbol, k AS win, count(*) FILTER (i <= cut) AS train_rows, count(*) FILTER (i > cut) AS test_rows, {R('avg(close) FILTER (i <= cut)')} AS train_mean, {R('avg(close) FILTER (i > cut)')} AS test_mean FROM w JOIN bar ON bar.symbol = w.symbol AND i > lo AND i <= hi GROUP BY 1, 2""",
)
def j21(spark, sf):
    """Each bar is exploded to the few windows that hold it (train 104, test 26,
    step 26 bars), so there is no range join."""
    return walk_windows(bar_series(spark, sf), 104, 26, 26).groupBy("symbol", "win").agg(
        F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"),
        r(F.avg(F.when(F.col("part") == "train", F.col("close")))).alias("train_mean"), r(F.avg(F.when(F.col("part") == "test", F.col("close")))).alias("test_mean"),
    )


@query(
    "b16_anchored_windows",
    f"""WITH {BARS}, n AS (SELECT symbol, max(i) AS n FROM bar GROUP BY 1), w AS (SELECT symbol, k, k * 52 + 104 AS cut, k * 52 + 110 AS lo, k * 52 + 136 AS hi FROM n, range(0, 100) AS r(k) WHERE k * 52 + 136 <= n)
SELECT w.symbol, k AS win, count(*) FILTER (i <= cut) AS train_rows, count(*) FILTER (i > lo) AS test_rows, {R('avg(close) FILTER (i <= cut)')} AS train_mean, {R('avg(close) FILTER (i > lo)')} AS test_mean FROM w JOIN bar ON bar.symbol = w.symbol AND i <= hi GROUP BY 1, 2""",
)
def b16a(spark, sf):
    """Expanding windows: trained from the first bar, six bars left out before
    the test of 26, 52 bars on each time."""
    return walk_windows(bar_series(spark, sf), 104, 26, 52, gap=6, anchored=True).groupBy("symbol", "win").agg(
        F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"),
        r(F.avg(F.when(F.col("part") == "train", F.col("close")))).alias("train_mean"), r(F.avg(F.when(F.col("part") == "test", F.col("close")))).alias("test_mean"),
    )


def walk_windows(s, train: int, test: int, step: int, gap: int = 0, anchored: bool = False):
    """Bars with the number of each window that holds them and the part they
    play; sliding by default, ``anchored`` trains from the first bar."""
    s = s.totals(_n=F.max(IDX))
    size = train + gap + test
    i = F.col(IDX)
    last = F.floor((F.col("_n") - size) / step)
    first = F.when(i > size, F.ceil((i - size) / step)).otherwise(0)
    upto = last if anchored else F.least(last, F.floor((i - 1) / step))
    x = s.rows.where(first <= upto).withColumn("win", F.explode(F.sequence(first, upto)))
    off = i - F.col("win") * step
    part = F.when(off <= train, "train").when((off > train + gap) & (off <= size), "test")
    return x.withColumn("part", part).where("part is not null").drop("_n", IDX)
