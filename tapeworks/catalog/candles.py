"""Flagship, A01-A05, A49-A51: candles, profiles, books."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.sql import BARS, R, SERIES, TICK, bars_cte, full, over
from tapeworks.catalog.tables import BOOK, book_levels
from tapeworks.functions import bands, oscillators as O
from tapeworks.operators import candles as C
from tapeworks.operators import books
from tapeworks.plans.series import Series
from tapeworks.sources import market

RS = """ud AS (SELECT *, CASE WHEN close > pc THEN close - pc ELSE 0 END AS up, CASE WHEN close < pc THEN pc - close ELSE 0 END AS dn FROM bar)"""


@query(
    "flagship_mean_reversion",
    f"""WITH {BARS}, {RS}, x AS (SELECT symbol, t, close,
  {full(20, f'avg(close) {over(20)}')} AS m, {full(20, f'stddev_pop(close) {over(20)}')} AS sd,
  {full(15, f'CASE WHEN avg(dn) {over(14)} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + avg(up) {over(14)} / avg(dn) {over(14)}) END')} AS rsi,
  lead(close) {SERIES} / close - 1 AS fwd FROM ud),
e AS (SELECT * FROM x WHERE sd > 0 AND (close - m + 2 * sd) / (4 * sd) < 0.2 AND rsi < 40)
SELECT symbol, count(*) AS signals, {R('avg(fwd)')} AS avg_next_return, {R('avg(rsi)')} AS avg_rsi FROM e GROUP BY 1""",
)
def flagship(spark, sf):
    """Ticks -> valid ticks -> weekly candles -> Bollinger %B and RSI -> entries
    -> signals and mean next-bar return per symbol.  All built-ins; one shuffle
    builds the candles and one orders the series."""
    s = O.rsi(bands.bollinger(bar_series(spark, sf)), 14)
    s = s.bounded(0, {"fwd": lambda w: w.lead("close") / F.col("close") - 1}, ahead=1)
    hit = s.df.where((F.col("bb_width") > 0) & (F.col("bb_pct") < 0.2) & (F.col("rsi") < 40))
    return hit.groupBy("symbol").agg(F.count(F.lit(1)).alias("signals"), r(F.avg("fwd")).alias("avg_next_return"), r(F.avg("rsi")).alias("avg_rsi"))


CANDLE_COLS = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote"]


@query("a01_ohlcv", f"WITH {bars_cte(30)} SELECT symbol, t, trades, " + ", ".join(f"{R(c, 2)} AS {c}" for c in CANDLE_COLS) + " FROM bar0")
def a01(spark, sf):
    return market.bars(spark, sf, 30).select("symbol", "t", "trades", *[r(c, 2).alias(c) for c in CANDLE_COLS])


MERGE = "first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume, count(*) AS bars"


@query("a02_resample_count", f"WITH {BARS}, c AS (SELECT *, CAST(floor((i - 1) / 4) AS BIGINT) AS chunk FROM bar) SELECT symbol, chunk, {MERGE} FROM c GROUP BY 1, 2")
def a02(spark, sf):
    return C.resample_by_count(market.bars(spark, sf), ["symbol"], "t", 4)


@query("a02_resample_clock", f"WITH {BARS}, c AS (SELECT *, CAST(floor(t / 4) AS BIGINT) AS chunk FROM bar) SELECT symbol, chunk, {MERGE} FROM c GROUP BY 1, 2")
def a02c(spark, sf):
    return C.resample_by_clock(market.bars(spark, sf), ["symbol"], "t", 4)


def volume_bins(bars, keys, bins=50):
    """Typical-price volume in ``bins`` equal bins between the lowest low and
    the highest high of each group."""
    span = bars.groupBy(*keys).agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((tp - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))))
    return bars.join(span, keys).groupBy(*keys, "lo", "hi", at.cast("int").alias("bin")).agg(F.sum("volume").alias("vol"))


def area_sql(extra: str, bins_cte: str, bins: int | None, count_poc: bool) -> str:
    """Step-by-step growth of the area as a recursive table."""
    return f"""{bins_cte},
tot AS (SELECT symbol, sum(vol) AS total, max(vol) AS mx, {'max(bin)' if bins is None else bins - 1} AS top FROM bins GROUP BY 1),
pc0 AS (SELECT b.symbol, min(b.bin) AS poc FROM bins b JOIN tot USING (symbol) WHERE b.vol = mx GROUP BY 1),
k AS (SELECT p.symbol, 0 AS step, poc, poc AS lo, poc AS hi, {'mx' if count_poc else 'CAST(0 AS DOUBLE)'} AS acc, total, top FROM pc0 p JOIN tot USING (symbol)
 UNION ALL SELECT symbol, step + 1, poc, CASE WHEN dn THEN lo - 1 ELSE lo END, CASE WHEN dn THEN hi ELSE hi + 1 END, acc + CASE WHEN dn THEN a ELSE b END, total, top FROM (
  SELECT k.*, coalesce(x.vol, 0) AS a, coalesce(y.vol, 0) AS b, k.lo > 0 AND (coalesce(x.vol, 0) >= coalesce(y.vol, 0) OR k.hi >= k.top) AS dn
  FROM k LEFT JOIN bins x ON x.symbol = k.symbol AND x.bin = k.lo - 1 LEFT JOIN bins y ON y.symbol = k.symbol AND y.bin = k.hi + 1
  WHERE k.acc < 0.7 * k.total AND (k.lo > 0 OR k.hi < k.top))),
fin AS (SELECT symbol, max(step) AS step FROM k GROUP BY 1)
SELECT k.symbol, CAST(poc AS INTEGER) AS poc, CAST(lo AS INTEGER) AS area_lo, CAST(hi AS INTEGER) AS area_hi, total FROM k JOIN fin USING (symbol, step)"""


BINS = """sp AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bar GROUP BY 1),
bins AS (SELECT symbol, CASE WHEN hi = lo THEN 0 ELSE least(49, greatest(0, floor(((high + low + close) / 3 - lo) / (hi - lo) * 50))) END AS bin, sum(volume) AS vol FROM bar JOIN sp USING (symbol) GROUP BY 1, 2)"""


@query("a03_volume_profile", f"WITH RECURSIVE {BARS}, {area_sql('', BINS, 50, True)}")
def a03(spark, sf):
    return C.value_area(volume_bins(market.bars(spark, sf), ["symbol"]), ["symbol"], 50)


@query(
    "a04_trade_profile",
    f"WITH {TICK} SELECT symbol, floor(price / 500) * 500 AS bin_price, sum(qty) AS volume, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS sell_volume, count(*) AS trades FROM tick GROUP BY 1, 2",
)
def a04(spark, sf):
    tk = market.ticks(spark, sf)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0.0))
    return tk.groupBy("symbol", (F.floor(F.col("price") / 500) * 500.0).alias("bin_price")).agg(
        F.sum("qty").alias("volume"), side("buy").alias("buy_volume"), side("sell").alias("sell_volume"), F.count(F.lit(1)).alias("trades")
    )


TBINS = "bins AS (SELECT symbol, floor(price / 1000) AS bin, sum(qty) AS vol FROM tick GROUP BY 1, 2)"


@query("a04_trade_value_area", f"WITH RECURSIVE {TICK}, {area_sql('', TBINS, None, False)}")
def a04v(spark, sf):
    """Fixed bin size; the busiest bin's own volume does not count."""
    lv = market.ticks(spark, sf).groupBy("symbol", F.floor(F.col("price") / 1000).cast("int").alias("bin")).agg(F.sum("qty").alias("vol"))
    return C.value_area(lv, ["symbol"], count_poc=False)


@query(
    "a05_missing_report",
    f"""WITH {BARS}, sp AS (SELECT symbol, min(t) AS a, max(t) AS b FROM bar GROUP BY 1), g AS (SELECT symbol, unnest(range(a, b + 1)) AS t FROM sp),
x AS (SELECT g.symbol, g.t, close, volume, CASE WHEN taker_buy_volume = 0 THEN NULL ELSE taker_buy_volume END AS taker FROM g LEFT JOIN bar USING (symbol, t)),
l AS (SELECT 'close' AS col, close AS v FROM x UNION ALL SELECT 'volume', volume FROM x UNION ALL SELECT 'taker_buy_volume', taker FROM x)
SELECT col AS column_name, count(*) AS total_count, count(*) - count(v) AS missing_count, {R('(count(*) - count(v)) * 100.0 / count(*)')} AS missing_pct FROM l GROUP BY 1""",
)
def a05(spark, sf):
    """Missing values per column in one aggregate; a zero taker volume counts
    as missing (integer-column rule)."""
    from tapeworks.functions.structure import on_full_grid

    x = on_full_grid(market.bars(spark, sf).select("symbol", "t", "close", "volume", "taker_buy_volume"), ["symbol"], "t")
    gone = {"close": F.col("close").isNull(), "volume": F.col("volume").isNull(), "taker_buy_volume": F.coalesce(F.col("taker_buy_volume"), F.lit(0.0)) == 0}
    one = x.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in gone.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("column_name"), F.col(k).alias("missing_count")) for k in gone])
    return one.select(F.inline(rows), F.col("n").alias("total_count")).withColumn("missing_pct", r(F.col("missing_count") * 100.0 / F.col("total_count")))


@query(
    "a49_book_metrics",
    f"""WITH {BOOK}, tp AS (SELECT symbol, max(CASE WHEN side = 'buy' THEN price END) AS bid, min(CASE WHEN side = 'sell' THEN price END) AS ask, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS bv, sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS av,
 arg_max(CASE WHEN side = 'buy' THEN qty END, CASE WHEN side = 'buy' THEN price END) AS bq, arg_min(CASE WHEN side = 'sell' THEN qty END, CASE WHEN side = 'sell' THEN price END) AS aq FROM lv GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END) AS k FROM lv),
im AS (SELECT symbol, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) / sum(qty) AS imb FROM rk WHERE k <= 5 GROUP BY 1)
SELECT symbol, bid, ask, {R('(bid + ask) / 2')} AS mid, {R('(bid * aq + ask * bq) / (aq + bq)')} AS weighted_mid, {R('ask - bid')} AS spread, {R('(ask - bid) / ((bid + ask) / 2) * 100')} AS spread_pct, {R('imb')} AS imbalance, bv AS bid_volume, av AS ask_volume FROM tp JOIN im USING (symbol)""",
)
def a49(spark, sf):
    m = books.metrics(book_levels(spark, sf), ["symbol"], 5)
    return m.select("symbol", "bid", "ask", *[r(c).alias(c) for c in ("mid", "weighted_mid", "spread", "spread_pct", "imbalance")], "bid_volume", "ask_volume")


MICRO = """f AS (SELECT symbol, CAST(floor(day / 7.0) AS BIGINT) AS t, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS flow, sum(qty) AS vol, count(*) AS n, sum(price * qty) / sum(qty) AS vwap,
  first(price ORDER BY day, o1, o2, o3, price) AS op, last(price ORDER BY day, o1, o2, o3, price) AS lp, avg(qty) AS aq FROM tick GROUP BY 1, 2)"""


@query(
    "a50_microstructure",
    f"""WITH {TICK}, {MICRO} SELECT symbol, t, {R('flow / vol')} AS flow_imbalance, {R('vol / n')} AS flow_velocity, {R('(lp - vwap) / vwap')} AS vwap_deviation, {R('lp / vwap')} AS vwap_ratio,
 {R('CASE WHEN n > 5 THEN abs(lp - op) / (abs(flow) + 1e-8) ELSE 0 END', 2)} AS impact_slope, {R('abs(lp - op) / (vol * lp + 1e-12)', 6)} AS illiquidity FROM f""",
)
def a50(spark, sf):
    m = books.trade_flow(market.ticks(spark, sf).withColumn("t", F.floor(F.col("day") / 7)), ["symbol", "t"], ["day", "o1", "o2", "o3", "price"])
    return m.select("symbol", "t", *[r(c).alias(c) for c in ("flow_imbalance", "flow_velocity", "vwap_deviation", "vwap_ratio")], r("impact_slope", 2).alias("impact_slope"), r("illiquidity", 6).alias("illiquidity"))


@query(
    "a51_whale_share",
    f"WITH {TICK}, n AS (SELECT symbol, price * qty AS v FROM tick), a AS (SELECT symbol, avg(v) AS a FROM n GROUP BY 1) SELECT symbol, {R('least(1.0, sum(CASE WHEN v > 3 * a THEN v ELSE 0 END) / sum(v) * 5)')} AS whale_score FROM n JOIN a USING (symbol) GROUP BY 1",
)
def a51(spark, sf):
    """Share of notional in trades above 3x the symbol's average (10x by default)."""
    return books.whale_share(market.ticks(spark, sf).withColumn("v", F.col("price") * F.col("qty")), ["symbol"], "v", 3.0).select("symbol", r("whale_score").alias("whale_score"))
