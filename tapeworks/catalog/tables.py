"""S, F, K and U rows: sources and sinks, filters, sort / top-k, set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.sql import BARS, R, TICK, bars_cte
from tapeworks.functions import messages, quality as Q
from tapeworks.functions.draws import uniform
from tapeworks.operators import books as B
from tapeworks.operators.candles import candle_shape
from tapeworks.plans.series import IDX, Series
from tapeworks.session import checkpointed, shared_folder
from tapeworks.sources import market, store

ORD = "ord AS (SELECT o_orderkey AS order_id, o_custkey AS account, o_orderstatus AS status, o_totalprice AS notional, o_orderdate AS ts, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, o_orderpriority AS priority FROM orders)"


def _candles(spark, sf):
    b = market.bars(spark, sf)
    return b.select(
        F.timestamp_add("DAY", (F.col("t") * 7).cast("int"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("open_time"),
        "symbol", F.lit("main").alias("exchange"), F.lit("1w").alias("timeframe"),
        "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote",
    )


@query(
    "s01_s03_candle_store",
    f"WITH {BARS} SELECT symbol, count(*) AS n, {R('sum(close)', 2)} AS total FROM bar WHERE t * 7 BETWEEN 10000 AND 10500 GROUP BY 1",
)
def s01(spark, sf):
    """Write the store, read columns of a time range back (pruned, pushed down)."""
    st = store.CandleStore(spark, shared_folder(spark, "candles"))
    st.write(_candles(spark, sf))
    got = st.read("main", "1w", columns=["symbol", "open_time", "close"], start="1997-05-19", end="1998-10-01")
    return got.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.sum("close"), 2).alias("total"))


@query("s03_list_symbols", f"WITH {BARS} SELECT DISTINCT symbol FROM bar")
def s03(spark, sf):
    st = store.CandleStore(spark, shared_folder(spark, "candles"))
    st.write(_candles(spark, sf))
    return st.symbols("main")


@query("s04_csv_round_trip", f"WITH {BARS} SELECT symbol, t, close, trades FROM bar")
def s04(spark, sf):
    path = shared_folder(spark, "csv")
    store.write_csv(market.bars(spark, sf).select("symbol", "t", "close", "trades"), path)
    return store.read_csv(spark, path, "symbol bigint, t bigint, close double, trades bigint")


@query("s05_s06_fixed_tick_parquet", f"WITH {TICK} SELECT venue AS exchange, side, count(*) AS n, {R('sum(qty)', 2)} AS qty FROM tick GROUP BY 1, 2")
def s05(spark, sf):
    path = shared_folder(spark, "ticks")
    tk = market.ticks(spark, sf).select("ts", "symbol", F.col("venue").alias("exchange"), "price", F.col("qty").alias("quantity"), "side", F.concat_ws("-", "o1", "o2", "o3").alias("trade_id"))
    store.write_fixed(tk, store.TICK, path, "zstd", max_rows=50_000)
    back = spark.read.schema(store.TICK).parquet(path)
    return back.groupBy("exchange", "side").agg(F.count(F.lit(1)).alias("n"), r(F.sum("quantity"), 2).alias("qty"))


def _signal_messages(spark, sf):
    """Signal messages as JSON text: strength is out of range for large values,
    and 'error' events carry an unknown direction."""
    e = market.events(spark, sf)
    direction = F.when(F.col("event_type") == "purchase", "long").when(F.col("event_type") == "signup", "short").when(F.col("event_type") == "error", "sideways").otherwise("neutral")
    msg = F.struct(
        F.concat(F.lit("s"), F.col("event_id")).alias("signal_id"), F.col("user_id").cast("string").alias("symbol"), direction.alias("direction"),
        (F.col("value") / 100).alias("strength"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("strategy_id"), F.col("ts").cast("string").alias("timestamp"),
    )
    return e.select("event_id", F.to_json(msg).alias("value"))


@query(
    "s07_parse_topic",
    "SELECT 's' || event_id AS signal_id, CAST(user_id AS VARCHAR) AS symbol, value / 100 AS strength, CASE WHEN event_type <> 'view' THEN event_type END AS strategy_id FROM events",
)
def s07(spark, sf):
    return messages.parse("signals", _signal_messages(spark, sf)).select("signal_id", "symbol", "strength", "strategy_id")


@query("s08_keyed_publish", f"WITH {TICK} SELECT venue || ':' || symbol AS key, count(*) AS n, {R('sum(price)', 2)} AS total FROM tick GROUP BY 1")
def s08(spark, sf):
    tk = market.ticks(spark, sf).select("symbol", F.col("venue").alias("exchange"), "price", F.col("qty").alias("quantity"))
    kv = store.keyed_json(tk, "market-data")
    return kv.groupBy("key").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.get_json_object("value", "$.price").cast("double")), 2).alias("total"))


REASON = "CASE WHEN event_type = 'view' THEN 'missing strategy_id' WHEN event_type = 'error' THEN 'value of direction' WHEN value / 100 > 1 OR value < 0 THEN 'range of strength' END"


@query("f05_s09_dead_letters", f"SELECT 'signals' AS original_topic, {REASON} AS reason, count(*) AS n FROM events WHERE {REASON} IS NOT NULL GROUP BY 1, 2")
def s09(spark, sf):
    _, dead = store.split_valid(_signal_messages(spark, sf), "signals")
    return dead.groupBy("original_topic", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("f05_valid_messages", f"SELECT event_id FROM events WHERE {REASON} IS NULL")
def f05(spark, sf):
    good, _ = store.split_valid(_signal_messages(spark, sf), "signals")
    return good.select("event_id")


@query("s10_insert_defaults", f"WITH {ORD} SELECT order_id, coalesce(CASE WHEN status <> 'P' THEN status END, 'new') AS status, 0.0::DOUBLE AS commission, 'limit' AS order_type FROM ord")
def s10(spark, sf):
    o = market.orders(spark, sf).select("order_id", F.when(F.col("status") != "P", F.col("status")).alias("status"))
    return store.with_defaults(o, {"status": "new", "commission": 0.0, "order_type": "limit"})


@query(
    "s11_venue_dialects",
    f"WITH {TICK} SELECT venue, symbol, side, count(*) AS n, {R('sum(price)', 2)} AS px, {R('sum(qty)', 2)} AS qty, max(day) * 86400000 AS last_ms FROM tick GROUP BY 1, 2, 3",
)
def s11(spark, sf):
    """Ticks rendered in three venue dialects, read back as one tick table."""
    tk = market.ticks(spark, sf)
    ms, sym, tid = (F.col("day") * 86400000), F.col("symbol").cast("string"), F.concat_ws("-", "o1", "o2", "o3")
    px, q = F.col("price").cast("string"), F.col("qty").cast("string")
    a = F.to_json(F.struct(F.lit("trade").alias("e"), sym.alias("s"), px.alias("p"), q.alias("q"), ms.alias("T"), (F.col("side") == "sell").alias("m"), F.col("o1").alias("t")))
    b = F.to_json(F.struct(F.lit("publicTrade").alias("topic"), F.array(F.struct(ms.alias("T"), sym.alias("s"), F.initcap("side").alias("S"), q.alias("v"), px.alias("p"), tid.alias("i"))).alias("data")))
    c = F.to_json(F.struct(F.struct(F.lit("trades").alias("channel"), sym.alias("instId")).alias("arg"), F.array(F.struct(sym.alias("instId"), tid.alias("tradeId"), px.alias("px"), q.alias("sz"), F.col("side"), ms.cast("string").alias("ts"))).alias("data")))
    raw = tk.select("venue", F.when(F.col("venue") == "A", a).when(F.col("venue") == "N", b).otherwise(c).alias("body"))
    t = messages.ticks_from_raw(raw, ("A", "N", "R"))
    return t.groupBy("venue", F.col("symbol").cast("bigint").alias("symbol"), "side").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("price"), 2).alias("px"), r(F.sum("qty"), 2).alias("qty"), F.max("ts_ms").alias("last_ms")
    )


# one depth message a symbol and day: some ids are old, some start the count anew
MSG = f"""{TICK}, msg AS (SELECT symbol, day, CASE WHEN (day + symbol) % 97 = 0 THEN 0 WHEN (day * 7 + symbol) % 11 = 0 THEN day - 40 ELSE day END AS u FROM tick GROUP BY 1, 2),
lv AS (SELECT symbol, day, side, floor(price / 50) * 50 AS price, CASE WHEN CAST(sum(qty) AS BIGINT) % 5 = 0 THEN 0 ELSE sum(qty) END AS qty FROM tick GROUP BY 1, 2, 3, 4)"""


def depth_messages(spark, sf):
    """Raw (day, body) rows, one message a symbol and day."""
    tk = market.ticks(spark, sf)
    lv = tk.groupBy("symbol", "day", "side", (F.floor(F.col("price") / 50) * 50).alias("price")).agg(F.sum("qty").alias("qty"))
    qty = F.when(F.col("qty").cast("bigint") % 5 == 0, F.lit("0")).otherwise(F.col("qty").cast("string"))
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.array(F.col("price").cast("string"), qty))))
    day, sym = F.col("day"), F.col("symbol")
    u = F.when((day + sym) % 97 == 0, 0).when((day * 7 + sym) % 11 == 0, day - 40).otherwise(day)
    m = lv.groupBy("symbol", "day").agg(side("buy").alias("b"), side("sell").alias("a"))
    return m.select("day", F.to_json(F.struct(F.lit("depthUpdate").alias("e"), sym.cast("string").alias("s"), u.alias("u"), "b", "a")).alias("body"))


@query("s11_book_deltas", f"WITH {MSG} SELECT symbol, side, count(*) AS n, count(*) FILTER (qty = 0) AS deletes, {R('sum(price * qty)', 2)} AS notional, CAST(sum(u) AS BIGINT) AS id_sum FROM lv JOIN msg USING (symbol, day) GROUP BY 1, 2")
def s11d(spark, sf):
    """Depth updates rendered as messages and read back, one row a level."""
    d = messages.deltas_from_raw(depth_messages(spark, sf))
    return d.groupBy(F.col("symbol").cast("bigint").alias("symbol"), "side").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("qty") == 0).alias("deletes"), r(F.sum(F.col("price") * F.col("qty")), 2).alias("notional"), F.sum("update_id").alias("id_sum")
    )


@query(
    "t06_local_book",
    f"""WITH {MSG}, sg AS (SELECT *, sum(CASE WHEN u = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day) AS seg FROM msg), ac AS (SELECT * FROM (SELECT *, max(u) OVER (PARTITION BY symbol, seg ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sg) WHERE u = 0 OR u > coalesce(b, 0)),
lf AS (SELECT lv.*, lead(lv.day) OVER (PARTITION BY lv.symbol, side, price ORDER BY lv.day) AS until FROM lv JOIN ac USING (symbol, day)), mo AS (SELECT DISTINCT symbol, day // 60 * 60 + 59 AS at_day FROM tick),
bk AS (SELECT mo.symbol, at_day, side, price, qty, row_number() OVER (PARTITION BY mo.symbol, at_day, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END) AS k FROM lf JOIN mo ON mo.symbol = lf.symbol AND day <= at_day AND (until IS NULL OR until > at_day) WHERE qty > 0)
SELECT symbol, CAST(at_day AS BIGINT) AS at_day, side, k, price, {R('qty', 2)} AS qty FROM bk WHERE k <= 3""",
)
def t06(spark, sf):
    """Best three levels of each side at the end of every 60 days, from the lives
    of levels; old updates are dropped, a quantity of 0 ends a level."""
    # stored: each series counts its rows first, messages are read once
    d = checkpointed(messages.deltas_from_raw(depth_messages(spark, sf)).withColumn("symbol", F.col("symbol").cast("bigint")))
    ids = B.accepted(d.select("symbol", "day", "update_id").distinct(), ["symbol"], "day", "update_id").drop("update_id")
    lives = B.level_lives(d.join(ids, ["symbol", "day"]), ["symbol"], "day", "place")
    moments = market.ticks(spark, sf).select("symbol", (F.floor(F.col("day") / 60) * 60 + 59).alias("at_day")).distinct()
    return B.book_at(lives, moments, ["symbol"], "at_day", 3).select("symbol", "at_day", "side", "k", "price", r("qty", 2).alias("qty"))


@query("s12_feature_target_pairs", f"WITH {TICK}, x AS (SELECT symbol, count(*) AS n, avg(price) AS f FROM tick GROUP BY 1) SELECT symbol, {R('f')} AS feature, {R('s_acctbal')} AS target FROM x JOIN supplier ON symbol = s_suppkey")
def s12(spark, sf):
    """Feature and target tables paired on the row key (not by position)."""
    f = market.ticks(spark, sf).groupBy("symbol").agg(F.avg("price").alias("f"))
    t = market.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("y"))
    return f.join(t, "symbol").select("symbol", r("f").alias("feature"), r("y").alias("target"))


@query("s13_report_json", f"WITH {ORD} SELECT priority, count(*) AS n, {R('sum(notional)', 2)} AS total FROM ord GROUP BY 1")
def s13(spark, sf):
    path = shared_folder(spark, "report")
    rep = market.orders(spark, sf).groupBy("priority").agg(F.struct(F.count(F.lit(1)).alias("n"), r(F.sum("notional"), 2).alias("total")).alias("stats"))
    store.write_report(rep, path)
    return spark.read.schema("priority string, stats struct<n: bigint, total: double>").json(path).select("priority", "stats.*")


@query(
    "s14_upsert",
    f"WITH {ORD}, u AS (SELECT order_id, day AS version, status FROM ord UNION ALL SELECT order_id, day + 1, 'amended' FROM ord WHERE priority = '1-URGENT') SELECT order_id, max(version) AS version, arg_max(status, version) AS status FROM u GROUP BY 1",
)
def s14(spark, sf):
    o = market.orders(spark, sf)
    cur = o.select("order_id", F.col("day").alias("version"), "status")
    chg = o.where(F.col("priority") == "1-URGENT").select("order_id", (F.col("day") + 1).alias("version"), F.lit("amended").alias("status"))
    return store.upsert(cur, chg, ["order_id"], "version")


# --- filters ---------------------------------------------------------------------------
@query("f01_k01_order_listing", f"WITH {ORD} SELECT order_id, account, notional FROM ord WHERE status = 'O' AND priority = '2-HIGH' ORDER BY notional DESC, order_id LIMIT 50 OFFSET 100")
def f01(spark, sf):
    return Q.listing(market.orders(spark, sf), {"status": "O", "priority": "2-HIGH", "account": None}, "notional", True, 100, 50, ["order_id"]).select("order_id", "account", "notional")


@query("f02_trade_listing", f"WITH {TICK} SELECT symbol, day, o1, o2, o3, price FROM tick WHERE side = 'buy' AND venue = 'R' ORDER BY price DESC, o1, o2, o3 LIMIT 100")
def f02(spark, sf):
    return Q.listing(market.ticks(spark, sf), {"side": "buy", "venue": "R"}, "price", True, 0, 100, ["o1", "o2", "o3"]).select("symbol", "day", "o1", "o2", "o3", "price")


@query("f03_active_orders", f"WITH {ORD} SELECT account, count(*) AS active FROM ord WHERE status IN ('O', 'P') GROUP BY 1")
def f03(spark, sf):
    return market.orders(spark, sf).where(F.col("status").isin("O", "P")).groupBy("account").agg(F.count(F.lit(1)).alias("active"))


@query("f04_pnl_history", f"WITH {ORD} SELECT day, {R('sum(notional)', 2)} AS pnl FROM ord WHERE ts >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY GROUP BY 1")
def f04(spark, sf):
    as_of = F.lit("2001-08-01").cast("timestamp_ntz")
    return market.orders(spark, sf).where(F.col("ts") >= as_of - F.expr("INTERVAL 90 DAYS")).groupBy("day").agg(r(F.sum("notional"), 2).alias("pnl"))


@query(
    "f06_j01_normalise",
    "SELECT n_name AS symbol, l_returnflag AS venue, count(*) AS n, round(sum(CASE l_returnflag WHEN 'A' THEN floor(l_extendedprice) WHEN 'N' THEN floor(l_extendedprice * 10) / 10 ELSE l_extendedprice END), 1) AS px, "
    "CAST(max(epoch_ms(l_shipdate)) AS BIGINT) AS last_ms FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
)
def f06(spark, sf):
    """Symbol map by dimension join, price cut to the venue's precision, epoch ms."""
    li = market.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    sup = market.table(spark, sf, "supplier").join(market.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("symbol"))
    digits = F.create_map(F.lit("A"), F.lit(1.0), F.lit("N"), F.lit(10.0))
    k = F.coalesce(digits[F.col("l_returnflag")], F.lit(None).cast("double"))
    px = F.when(k.isNull(), F.col("l_extendedprice")).otherwise(F.floor(F.col("l_extendedprice") * k) / k)
    x = li.join(sup, li.l_suppkey == sup.s_suppkey)
    return x.groupBy("symbol", F.col("l_returnflag").alias("venue")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(px), 1).alias("px"), F.max(F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("last_ms")
    )


@query(
    "f07_tick_issues",
    f"""WITH {TICK}, x AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts, o1, o2, o3, price, qty) AS pp, max(ts) OVER (PARTITION BY symbol) AS now FROM tick),
y AS (SELECT symbol, price <= 0 AS a, qty <= 0 AS b, date_diff('day', ts, now) > 30 AS c, coalesce(pp > 0 AND abs(price - pp) / pp > 0.1, false) AS d FROM x)
SELECT symbol, concat_ws(',', CASE WHEN a THEN 'price' END, CASE WHEN b THEN 'quantity' END, CASE WHEN c THEN 'stale' END, CASE WHEN d THEN 'jump' END) AS issues, count(*) AS n FROM y GROUP BY 1, 2""",
)
def f07(spark, sf):
    s = Series.of(market.ticks(spark, sf).select("symbol", "ts", "o1", "o2", "o3", "price", "qty"), ["symbol"], ["ts", "o1", "o2", "o3", "price", "qty"])
    return Q.tick_issues(s).df.groupBy("symbol", F.array_join("issues", ",").alias("issues")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f08_clock_offset",
    "SELECT l_returnflag AS venue, CAST(arg_max(date_diff('day', o_orderdate, l_shipdate), (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS BIGINT) AS offset_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def f08(spark, sf):
    """Latest local-minus-venue clock offset per venue."""
    li = market.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
    o = market.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    off = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("bigint")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("l_returnflag").alias("venue")).agg(F.max_by(off, F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("offset_days"))


@query(
    "f09_market_quality",
    f"""WITH RECURSIVE {TICK}, q AS MATERIALIZED (SELECT symbol, price, qty, row_number() OVER (PARTITION BY symbol ORDER BY ts, o1, o2, o3, price, qty) AS i FROM tick),
k AS (SELECT symbol, i, price AS ref, CASE WHEN qty > 45 THEN 'suspicious' ELSE 'valid' END AS quality FROM q WHERE i = 1
 UNION ALL SELECT q.symbol, q.i, CASE WHEN abs(q.price - k.ref) / k.ref * 100 > 50 THEN k.ref ELSE q.price END,
   CASE WHEN abs(q.price - k.ref) / k.ref * 100 > 50 OR q.qty > 45 THEN 'suspicious' ELSE 'valid' END FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1)
SELECT symbol, quality, count(*) AS n FROM k GROUP BY 1, 2""",
)
def f09(spark, sf):
    tk = market.ticks(spark, sf)
    return Q.quality_class(tk, ["symbol"], ["ts", "o1", "o2", "o3", "price", "qty"], 50.0, 0.0, 45.0).groupBy("symbol", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("f10_signal_quality", "SELECT CASE WHEN event_type = 'error' THEN 'invalid' WHEN value / 100 < 0 OR value / 100 > 1 THEN 'invalid' ELSE 'valid' END AS quality, count(*) AS n FROM events GROUP BY 1")
def f10(spark, sf):
    e = market.events(spark, sf)
    strength, direction = F.col("value") / 100, F.when(F.col("event_type") != "error", F.col("event_type"))
    q = F.when(direction.isNull() | strength.isNull(), "invalid").when((strength < 0) | (strength > 1), "invalid").otherwise("valid")
    return e.groupBy(q.alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_sample_filter",
    f"""WITH v AS (SELECT label, vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS m FROM embeddings),
x AS (SELECT *, row_number() OVER w AS i, avg(m) OVER p AS mu, stddev_samp(m) OVER p AS sd FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id), p AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT label, vec_id, {R('CASE WHEN i > 30 THEN (m - mu) / greatest(sd, 1e-8) END')} AS z, coalesce(i > 30 AND abs((m - mu) / greatest(sd, 1e-8)) > 2, false) AS outlier FROM x""",
)
def f11(spark, sf):
    emb = market.table(spark, sf, "embeddings").where(Q.array_range_ok(F.col("embedding")))
    m = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding")
    s = Series.of(emb.select("label", "vec_id", m.alias("m")), ["label"], ["vec_id"])
    return Q.running_outliers(s, "m", 30, 2.0).df.select("label", "vec_id", r("z").alias("z"), "outlier")


@query(
    "f12_candle_columns",
    f"WITH {BARS} SELECT symbol, t, {R('(high + low + close) / 3')} AS typical, {R('high - low')} AS range, {R('abs(close - open)')} AS body, {R('high - greatest(open, close)')} AS upper_wick, {R('least(open, close) - low')} AS lower_wick, close > open AS bullish FROM bar",
)
def f12(spark, sf):
    sh = candle_shape()
    return market.bars(spark, sf).select("symbol", "t", *[(c if k == "bullish" else r(c)).alias(k) for k, c in sh.items()])


@query(
    "f13_order_derived",
    f"SELECT o_orderkey AS order_id, {R('o_totalprice * (1 - f.share)')} AS remaining, o_orderstatus IN ('O', 'P') AS active, {R('o_totalprice / 5')} AS margin FROM orders JOIN (VALUES ('F', 1.0), ('O', 0.0), ('P', 0.5)) AS f(s, share) ON o_orderstatus = f.s",
)
def f13(spark, sf):
    share = F.when(F.col("status") == "F", 1.0).when(F.col("status") == "P", 0.5).otherwise(0.0)
    return market.orders(spark, sf).select("order_id", r(F.col("notional") * (1 - share)).alias("remaining"), F.col("status").isin("O", "P").alias("active"), r(F.col("notional") / 5.0).alias("margin"))


def zs(c: str) -> str:
    return R(f"greatest(-2, least(2, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()))")


@query("f14_standardise", f"WITH {BARS} SELECT symbol, t, {zs('close')} AS close, {zs('volume')} AS volume FROM bar")
def f14(spark, sf):
    x = Q.standardise(market.bars(spark, sf).select("symbol", "t", "close", "volume"), ["close", "volume"], 2.0)
    return x.select("symbol", "t", r("close").alias("close"), r("volume").alias("volume"))


@query(
    "f15_confidence",
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings),
m AS (SELECT *, list_max(p) AS mx, list_avg(list_transform(p, lambda x: abs(x))) AS ma, list_stddev_pop(list_transform(p, lambda x: abs(x))) AS sa FROM e)
SELECT vec_id, {R('1 / (list_sum(list_transform(p, lambda x: exp(x - mx))) + 1e-8)', 6)} AS softmax, {R('1 / (1 + exp(-mx))', 6)} AS sigmoid, {R('(ma + 1e-8) / (ma + 1e-8 + sa + 1e-8)', 6)} AS magnitude FROM m""",
)
def f15(spark, sf):
    e = market.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    return e.select("vec_id", *[r(Q.confidence(F.col("p"), h), 6).alias(h) for h in ("softmax", "sigmoid", "magnitude")])


@query(
    "f16_curriculum_subset",
    f"""WITH {BARS}, v AS (SELECT symbol, t, i, count(*) OVER (PARTITION BY symbol) AS n, (high - low) / close AS vol FROM bar), k AS (SELECT * FROM v WHERE vol <= 0.5),
f AS (SELECT * FROM v WHERE (vol <= 0.5) OR (SELECT count(*) FROM k) = 0) SELECT symbol, count(*) AS n, min(t) AS first_t FROM f WHERE i > n - greatest(100, floor(n * 0.4)) GROUP BY 1""",
)
def f16(spark, sf):
    """Volatility cap (all rows when nothing passes), most recent share."""
    s = bar_series(spark, sf).totals(_n=F.count(F.lit(1)))
    rows = s.rows.withColumn("vol", (F.col("high") - F.col("low")) / F.col("close"))
    kept = Q.with_fallback(rows, F.col("vol") <= 0.5)
    recent = kept.where(F.col(IDX) > F.col("_n") - F.greatest(F.lit(100), F.floor(F.col("_n") * 0.4)))
    return recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"))


@query(
    "f17_distance_anomalies",
    f"""WITH {BARS}, m AS (SELECT avg(close) AS m1, stddev_pop(close) AS s1, avg(volume) AS m2, stddev_pop(volume) AS s2 FROM bar),
d AS (SELECT symbol, t, sqrt(pow((close - m1) / (s1 + 1e-10), 2) + pow((volume - m2) / (s2 + 1e-10), 2)) AS d FROM bar, m),
q AS (SELECT quantile_cont(d, 0.95) AS th FROM d) SELECT symbol, t, {R('d')} AS distance, {R('th')} AS threshold FROM d, q WHERE d > th""",
)
def f17(spark, sf):
    x = Q.distance_anomalies(market.bars(spark, sf).select("symbol", "t", "close", "volume"), ["close", "volume"])
    return x.where("anomaly").select("symbol", "t", r("distance").alias("distance"), r("threshold").alias("threshold"))


# --- sort and top-k ----------------------------------------------------------------------
@query("k02_last_n_candles", f"WITH {BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM bar) SELECT symbol, t, close FROM x WHERE k <= 20")
def k02(spark, sf):
    """row_number <= n is cut inside each task before the shuffle."""
    w = Window.partitionBy("symbol").orderBy(F.desc("t"))
    return market.bars(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 20").select("symbol", "t", "close")


@query("k03_latest_price", f"WITH {TICK} SELECT symbol, venue, arg_max(price, (ts, o1, o2, o3, price)) AS price, max(day) AS day FROM tick GROUP BY 1, 2")
def k03(spark, sf):
    return market.ticks(spark, sf).groupBy("symbol", "venue").agg(F.max_by("price", F.struct(*market.TICK_ORDER)).alias("price"), F.max("day").alias("day"))


BOOK = f"{TICK}, lv AS (SELECT symbol, side, floor(price / 500) * 500 AS price, arg_max(qty, (ts, o1, o2, o3, price, qty)) AS qty FROM tick GROUP BY 1, 2, 3)"


def book_levels(spark, sf):
    """Latest quantity per (symbol, side, price level): ticks as level updates."""
    tk = market.ticks(spark, sf).withColumn("level", F.floor(F.col("price") / 500) * 500.0)
    at = F.struct("ts", "o1", "o2", "o3", "price", "qty")
    return tk.groupBy("symbol", "side", F.col("level").alias("price")).agg(F.max_by("qty", at).alias("qty"))


@query(
    "k04_depth_levels",
    f"WITH {BOOK}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END) AS k FROM lv) SELECT symbol, side, k, price, qty FROM x WHERE k <= 10",
)
def k04(spark, sf):
    w = Window.partitionBy("symbol", "side").orderBy(F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price")))
    return book_levels(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 10").select("symbol", "side", "k", "price", "qty")


@query(
    "k05_depth_walk",
    f"""WITH {BOOK}, x AS (SELECT *, sum(qty) OVER (PARTITION BY symbol ORDER BY price ROWS UNBOUNDED PRECEDING) - qty AS before, min(price) OVER (PARTITION BY symbol) AS best FROM lv WHERE side = 'sell'),
f AS (SELECT symbol, best, price, greatest(0, least(qty, 100 - before)) AS take FROM x)
SELECT symbol, {R('sum(take)')} AS filled, {R('sum(take * price) / sum(take)')} AS vwap, {R('(sum(take * price) / sum(take) - any_value(best)) / nullif(any_value(best), 0)')} AS slippage FROM f WHERE take > 0 GROUP BY symbol""",
)
def k05(spark, sf):
    """Walk the ask side until 100 units are filled."""
    from tapeworks.operators.books import depth_walk

    return depth_walk(book_levels(spark, sf).where(F.col("side") == "sell"), ["symbol"], "price", 100.0).select("symbol", *[r(c).alias(c) for c in ("filled", "vwap", "slippage")])


@query("k06_top_k", f"WITH {BARS}, x AS (SELECT symbol, t, close / pc - 1 AS r FROM bar WHERE pc IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(r) DESC, t) AS k FROM x) SELECT symbol, k, t, {R('r')} AS ret FROM y WHERE k <= 5")
def k06(spark, sf):
    s = bar_series(spark, sf).bounded(1, {"r": lambda w: F.col("close") / w.lag("close") - 1})
    w = Window.partitionBy("symbol").orderBy(F.desc(F.abs("r")), "t")
    return s.df.where("r is not null").withColumn("k", F.row_number().over(w)).where("k <= 5").select("symbol", "k", "t", r("r").alias("ret"))


UNI = lambda key, seed: f"((('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("k09_priority_sample", f"WITH {ORD}, x AS (SELECT order_id, -ln({UNI('order_id', '7')}) / pow(abs(notional) + 0.0001, 0.6) AS k FROM ord) SELECT order_id, round(k, 12) AS key FROM x ORDER BY k, order_id LIMIT 64")
def k09(spark, sf):
    """Weighted sample without replacement: smallest exponential keys win."""
    key = -F.log(uniform("order_id", seed="7")) / F.pow(F.abs("notional") + 0.0001, 0.6)
    return market.orders(spark, sf).select("order_id", key.alias("key")).orderBy("key", "order_id").limit(64).select("order_id", F.round("key", 12).alias("key"))


@query(
    "k10_support_query_split",
    f"WITH {ORD}, x AS (SELECT order_id, priority, row_number() OVER (PARTITION BY priority ORDER BY {UNI('order_id', '11')}, order_id) AS k FROM ord) SELECT order_id, priority, CASE WHEN k <= 16 THEN 'support' ELSE 'query' END AS part FROM x WHERE k <= 48",
)
def k10(spark, sf):
    w = Window.partitionBy("priority").orderBy(uniform("order_id", seed="11"), "order_id")
    return market.orders(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 48").select("order_id", "priority", F.when(F.col("k") <= 16, "support").otherwise("query").alias("part"))


@query(
    "k11_reservoir",
    f"""WITH {ORD}, rs AS (SELECT order_id, row_number() OVER (ORDER BY day DESC, order_id DESC) AS a FROM (SELECT * FROM ord ORDER BY {UNI('order_id', '13')}, order_id LIMIT 1000))
SELECT order_id, a AS age FROM rs ORDER BY -ln({UNI('order_id', '17')}) * a, order_id LIMIT 32""",
)
def k11(spark, sf):
    """Uniform reservoir of 1000 rows, then a draw weighted by recency."""
    keep = market.orders(spark, sf).orderBy(uniform("order_id", seed="13"), "order_id").limit(1000)
    aged = keep.withColumn("age", F.row_number().over(Window.orderBy(F.desc("day"), F.desc("order_id"))))   # at most 1000 rows
    return aged.orderBy(-F.log(uniform("order_id", seed="17")) * F.col("age"), "order_id").limit(32).select("order_id", "age")


# --- set operations --------------------------------------------------------------------------
@query(
    "u01_archive_split",
    f"WITH {TICK} SELECT CASE WHEN day < 9500 THEN 'archive' ELSE 'live' END AS part, count(*) AS n, {R('sum(price)', 2)} AS px FROM tick GROUP BY 1",
)
def u01(spark, sf):
    """Old trades move to the archive; history is the union of both."""
    tk = market.ticks(spark, sf)
    old, live = tk.where("day < 9500").withColumn("part", F.lit("archive")), tk.where("day >= 9500").withColumn("part", F.lit("live"))
    return old.unionByName(live).groupBy("part").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 2).alias("px"))


@query("u02_retention", f"WITH {BARS}, c AS (SELECT symbol, max(t) - 104 AS cut FROM bar GROUP BY 1) SELECT symbol, t, close FROM bar JOIN c USING (symbol) WHERE t >= cut")
def u02(spark, sf):
    s = bar_series(spark, sf).totals(_last=F.max("t"))
    return s.df.where(F.col("t") >= F.col("_last") - 104).select("symbol", "t", "close")


@query(
    "u03_union_feature_modules",
    "SELECT event_type AS entity, CAST(count(*) AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS total FROM events GROUP BY 1 UNION ALL SELECT o_orderpriority, NULL, round(sum(o_totalprice), 2) FROM orders GROUP BY 1",
)
def u03(spark, sf):
    a = market.events(spark, sf).groupBy(F.col("event_type").alias("entity")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    b = market.orders(spark, sf).groupBy(F.col("priority").alias("entity")).agg(F.round(F.sum("notional"), 2).alias("total"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "u07_position_difference",
    f"WITH {TICK}, a AS (SELECT symbol, sum(qty) AS q FROM tick WHERE day < 9500 GROUP BY 1), b AS (SELECT symbol, sum(qty) AS q FROM tick WHERE venue <> 'A' AND day < 9500 GROUP BY 1) SELECT symbol, q FROM a EXCEPT ALL SELECT symbol, q FROM b",
)
def u07(spark, sf):
    old = market.ticks(spark, sf).where("day < 9500")
    a = old.groupBy("symbol").agg(F.sum("qty").alias("q"))
    b = old.where("venue <> 'A'").groupBy("symbol").agg(F.sum("qty").alias("q"))
    return a.exceptAll(b)
