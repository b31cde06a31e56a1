"""X16, X30, T12, T17 batch forms, B01-B13, B15, B19, B20."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.averages import ema_sql
from tapeworks.catalog.bands import BB, KC, TR
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.joins import ALIGN, FUND, aligned, funding, walk_windows
from tapeworks.catalog.oscillators import ADX, HL, KK, MACD, STREAK, UD, rsi_sql
from tapeworks.catalog.sql import BARS, R, SERIES, TICK, full, over, span
from tapeworks.functions import bands, oscillators as O, structure as S
from tapeworks.operators import signals as G
from tapeworks.operators import strategies as Y
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

NAMES = ["rsi", "macd", "bb", "atr", "adx", "stoch", "ichimoku", "volume", "zscore", "connors_rsi", "ttm_squeeze"]


def _scores_sql() -> str:
    clip = lambda e: f"greatest(-1, least(1, {e}))"
    mid = lambda n: f"(max(high) {over(n)} + min(low) {over(n)}) / 2"
    mfm = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END"
    crsi = full(101, "(r3 + len(list_filter(ls, lambda x: x <= st)) + len(list_filter(lc, lambda x: x <= chp))) / 3")
    ctes = f"""{STREAK}, cr AS (SELECT symbol, t, {crsi} AS crsi FROM l),
{MACD.replace('f AS (', 'mf AS (').replace('s AS (', 'ms AS (').replace('m AS (', 'mm AS (').replace('g AS (', 'mg AS (').replace('f.y', 'mf.y').replace('s.y', 'ms.y').replace('s.i', 'ms.i').replace('FROM s JOIN f', 'FROM ms JOIN mf').replace('FROM m a JOIN m x', 'FROM mm a JOIN mm x')},
{ADX}, {BB}, {KC.split(', art AS', 1)[0]}, art AS{KC.split(', art AS', 1)[1]},
{HL(14)}, kk AS (SELECT symbol, t, i, {KK} AS k FROM hl), kd AS (SELECT symbol, t, k, {full(16, f'avg(k) {over(3)}')} AS d FROM kk),
w AS (SELECT symbol, t, i, close, {full(52, mid(9))} AS tk, {full(52, mid(26))} AS kj, {full(52, mid(52))} AS sb, {full(20, f'sum({mfm} * volume) {over(20)} / sum(volume) {over(20)}')} AS cmf,
  {full(30, f'(close - avg(close) {over(30)}) / nullif(stddev_samp(close) {over(30)}, 0)')} AS z, avg(close) {over(14)} AS p14 FROM bar),
tra AS (SELECT symbol, t, {full(15, f'avg(tr) {over(14)}')} AS atr FROM tr), rsx AS (SELECT symbol, t, {rsi_sql(14)} AS rsi FROM ud),
al AS (SELECT w.symbol, w.t, w.i, w.close AS close, rsi, mm.m - mg.y AS mh, bb.m AS bm, bb.sd, x.y AS adx, k, d, greatest((tk + kj) / 2, sb) AS top, least((tk + kj) / 2, sb) AS bot, cmf, z, crsi, atr, p14,
   art.a AS ka, e.y AS km, CASE WHEN art.i > 20 THEN w.close - bb.m END AS mom FROM w JOIN rsx USING (symbol, t) JOIN tra USING (symbol, t) JOIN cr USING (symbol, t) JOIN kd USING (symbol, t) JOIN bb USING (symbol, t) JOIN art USING (symbol, t)
   LEFT JOIN mm USING (symbol, t) LEFT JOIN mg USING (symbol, t) LEFT JOIN x USING (symbol, t) LEFT JOIN e USING (symbol, t))"""
    sc = {
        "rsi": "CASE WHEN rsi > 70 THEN -(rsi - 70) / 30 WHEN rsi < 30 THEN (30 - rsi) / 30 ELSE (50 - rsi) / 50 * 0.3 END",
        "macd": f"CASE WHEN abs(mh) < 1e-10 THEN 0 ELSE {clip('mh / close * 1000')} END",
        "bb": "CASE WHEN sd = 0 THEN 0 WHEN (close - bm + 2 * sd) / (4 * sd) > 0.95 THEN -0.8 WHEN (close - bm + 2 * sd) / (4 * sd) < 0.05 THEN 0.8 ELSE (0.5 - (close - bm + 2 * sd) / (4 * sd)) * 1.6 END",
        "atr": "1 / (1 + exp(10 * (atr / p14 - 0.02)))",
        "adx": "CASE WHEN adx < 25 THEN 0 ELSE least(adx / 100, 1) END",
        "stoch": "CASE WHEN d IS NULL THEN 0 WHEN k > 80 THEN -(k - 80) / 20 WHEN k < 20 THEN (20 - k) / 20 ELSE (50 - k) / 50 * 0.3 END",
        "ichimoku": "CASE WHEN close > top THEN least((close - top) / ((top + bot) / 2), 1) WHEN close < bot THEN greatest((close - bot) / ((top + bot) / 2), -1) ELSE 0 END",
        "volume": clip("cmf * 5"),
        "zscore": "CASE WHEN abs(z) > 2.5 THEN -sign(z) * 0.8 WHEN abs(z) > 2 THEN -sign(z) * 0.5 ELSE 0 END",
        "connors_rsi": "CASE WHEN crsi > 80 THEN -0.6 WHEN crsi < 20 THEN 0.6 ELSE (50 - crsi) / 50 * 0.3 END",
        "ttm_squeeze": f"CASE WHEN bm - 2 * sd >= km - 1.5 * ka AND bm + 2 * sd <= km + 1.5 * ka THEN 0 ELSE {clip('mom / (atr + 1e-10)')} END",
    }
    w = G.WEIGHTS
    num = " + ".join(f"{n} * {w[n]}" for n in NAMES)
    tot = sum(w[n] for n in NAMES)
    return f"""WITH {BARS}, {ctes}, sc AS (SELECT symbol, t, i, {', '.join(f'CAST(coalesce({e}, 0) AS DOUBLE) AS {n}' for n, e in sc.items())} FROM al),
v AS (SELECT *, ({num}) / {tot!r} AS vote, list_avg([{', '.join(NAMES)}]) AS mu, list_stddev_pop([{', '.join(NAMES)}]) AS sd FROM sc),
g AS (SELECT *, ({' + '.join(f'CASE WHEN {n} * vote > 0 THEN 1 ELSE 0 END' for n in NAMES)}) / {len(NAMES)}.0 AS agr FROM v)
SELECT symbol, t, {', '.join(f'{R(n)} AS s_{n}' for n in NAMES)}, {R('vote')} AS vote, {R('CASE WHEN sd > 0 THEN abs(mu) / sd ELSE 0 END')} AS snr, {R('agr')} AS agreement,
 CASE WHEN i >= 50 AND vote > 0.3 THEN 'long' WHEN i >= 50 AND vote < -0.3 THEN 'short' ELSE 'neutral' END AS direction FROM g"""


@query("x16_signal_scores", _scores_sql())
def x16(spark, sf):
    s = G.vote(G.scores(bar_series(spark, sf)), NAMES)
    return s.df.select("symbol", "t", *[r(f"s_{n}").alias(f"s_{n}") for n in NAMES], r("vote").alias("vote"), r("snr").alias("snr"), r("agreement").alias("agreement"), "direction")


DIRS = "dr AS (SELECT symbol, t, i, CASE WHEN close > pc * 1.1 THEN 'long' WHEN close < pc * 0.9 THEN 'short' ELSE 'neutral' END AS d FROM bar)"


@query(
    "t12_signal_persistence",
    f"""WITH {BARS}, {DIRS}, g AS (SELECT *, i - row_number() OVER (PARTITION BY symbol, d ORDER BY t) AS g FROM dr), rn AS (SELECT *, row_number() OVER (PARTITION BY symbol, d, g ORDER BY t) AS run FROM g)
SELECT symbol, t, d AS direction, run, {R('CASE WHEN run >= 3 THEN 1.0 WHEN run = 1 THEN 0.3 ELSE run / 3.0 END')} AS persistence FROM rn""",
)
def t12(spark, sf):
    s = bar_series(spark, sf).bounded(1, {"direction": lambda w: F.when(F.col("close") > w.lag("close") * 1.1, "long").when(F.col("close") < w.lag("close") * 0.9, "short").otherwise("neutral")})
    return G.persistence(s, "direction", 3).df.select("symbol", "t", "direction", "run", r("persistence").alias("persistence"))


@query(
    "x30_bayesian_confidence",
    f"""WITH {BARS}, h AS (SELECT symbol, t, i, CASE WHEN close > pc THEN 1.0 ELSE 0 END AS h FROM bar),
ab AS (SELECT a.symbol, a.t, 11 * pow(0.95, a.i) + sum(x.h * pow(0.95, a.i - x.i)) AS al, 11 * pow(0.95, a.i) + sum((1 - x.h) * pow(0.95, a.i - x.i)) AS be FROM h a JOIN h x ON a.symbol = x.symbol AND x.i <= a.i GROUP BY a.symbol, a.t, a.i)
SELECT symbol, t, {R('al / (al + be)', 6)} AS confidence FROM ab""",
)
def x30(spark, sf):
    s = bar_series(spark, sf).bounded(1, {"hit": lambda w: F.when(F.col("close") > w.lag("close"), 1.0).otherwise(0.0)})
    return G.bayesian_confidence(s, "hit").df.select("symbol", "t", r("confidence", 6).alias("confidence"))


def rule(name, fn, ctes, long, short, strength, src, where=""):
    sql = f"""WITH {ctes} , z AS (SELECT * FROM {src})
SELECT symbol, t, CASE WHEN {long} THEN 1 ELSE -1 END AS signal, {R(strength)} AS strength FROM z WHERE ({long}) OR ({short})"""

    @query(name, sql)
    def run(spark, sf):
        return fn(bar_series(spark, sf)).df.where("signal <> 0").select("symbol", "t", "signal", r("strength").alias("strength"))


B01 = f"{BARS}, {ADX}, {ema_sql('bar', 'close', 20, name='ef')}, {ema_sql('bar', 'close', 50, name='es')}, c AS (SELECT es.symbol, es.t, es.i, ef.y > es.y AS ab FROM es JOIN ef USING (symbol, t)), d AS (SELECT *, lag(ab) {SERIES} AS was FROM c)"
rule("b01_ema_cross", Y.ema_cross, B01, "ab AND NOT was", "NOT ab AND was", "least(adx / 50, 1)", "(SELECT d.*, x.y AS adx FROM d JOIN x USING (symbol, t) WHERE x.y >= 25 AND d.i >= 60)")
P20 = span(-20, -1)
rule(
    "b02_breakout", Y.breakout, f"{BARS}, c AS (SELECT symbol, t, i, close, volume, max(high) {P20} AS hi, min(low) {P20} AS lo, avg(volume) {span(-19, -1)} AS av FROM bar)",
    "close > hi", "close < lo", "0.7", "(SELECT * FROM c WHERE i >= 21 AND volume > 1.5 * av)",
)
rule(
    "b03_rsi_cross", Y.rsi_cross, f"{BARS}, {UD}, c AS (SELECT symbol, t, {rsi_sql(14)} AS rsi FROM ud), d AS (SELECT *, lag(rsi) {SERIES} AS p FROM c)",
    "p < 30 AND rsi >= 30", "p > 70 AND rsi <= 70", "CASE WHEN p < 30 THEN (30 - p) / 30 ELSE (p - 70) / 30 END", "d",
)
rule(
    "b04_macd_flip", Y.macd_flip, f"{BARS}, {MACD}, hh AS (SELECT g.symbol, g.t, g.i, bar.close, m.m - g.y AS h FROM g JOIN m USING (symbol, t) JOIN bar USING (symbol, t)), d AS (SELECT *, lag(h) {SERIES} AS p FROM hh)",
    "p < 0 AND h > 0", "p > 0 AND h < 0", "least(abs(h) / close * 1000, 1)", "(SELECT * FROM d WHERE i > 35)",
)
rule(
    "b06_mean_reversion", Y.mean_reversion,
    f"{BARS}, {UD}, c AS (SELECT symbol, t, i, close, {rsi_sql(14)} AS rsi, avg(close) {over(20)} AS m, stddev_pop(close) {over(20)} AS sd, (close - avg(close) {over(30)}) / nullif(stddev_samp(close) {over(30)}, 0) AS z FROM ud), d AS (SELECT *, (close - m + 2 * sd) / nullif(4 * sd, 0) AS pb FROM c)",
    "pb < 0.05 AND rsi < 35 AND z < -2", "pb > 0.95 AND rsi > 65 AND z > 2", "0.8", "(SELECT * FROM d WHERE i >= 50)",
)
rule(
    "b07_volatility_expansion", Y.volatility_expansion, f"{BARS}, {TR}, c AS (SELECT symbol, t, i, close, pc, {full(15, f'avg(tr) {over(14)} / close * 100')} AS ap FROM tr), d AS (SELECT *, {full(34, f'avg(ap) {over(20)}')} AS av FROM c)",
    "close > pc", "close <= pc", "least(ap / av / 3, 1)", "(SELECT * FROM d WHERE ap > av * 1.5)",
)


@query("b05_supertrend_flip")
def b05(spark, sf):
    return Y.supertrend_flip(bar_series(spark, sf)).df.where("signal <> 0").select("symbol", "t", "signal", r("strength").alias("strength"), r("supertrend").alias("level"))


H1 = span(-99, -50)


@query(
    "b09_volume_spread",
    f"""WITH {BARS}, w AS (SELECT *, avg(volume) {over(100)} AS av, avg(high - low) {over(100)} AS ar, min(low) {H1} AS sup, max(high) {H1} AS res, lag(close, 4) {SERIES} AS c5, avg(volume) {over(5)} AS v5 FROM bar),
f AS (SELECT symbol, t, volume > 2 * av AND high - low > 1.5 * ar AND close > pc AS bc, volume > 2 * av AND high - low > 1.5 * ar AND close < pc AS sc, volume < 0.5 * av AND close < pc AS nd, volume < 0.5 * av AND close >= pc AS ns,
 low < sup * 0.98 AND close > sup AS sg, close > c5 AND v5 > 1.5 * av AS so, high > res * 1.02 AND close < res AS ut FROM w WHERE i >= 100)
SELECT symbol, t, bc AS buying_climax, sc AS selling_climax, nd AS no_demand, ns AS no_supply, sg AS spring, so AS sign_of_strength, ut AS upthrust, CASE WHEN sg OR so OR ns THEN 1 WHEN ut THEN -1 ELSE 0 END AS signal FROM f""",
)
def b09(spark, sf):
    s = Y.volume_spread(bar_series(spark, sf))
    return s.rows.where(F.col(IDX) >= 100).select("symbol", "t", "buying_climax", "selling_climax", "no_demand", "no_supply", "spring", "sign_of_strength", "upthrust", "signal")


@query(
    "b10_stat_arbitrage",
    f"""WITH {BARS}, {ALIGN}, h AS (SELECT a, b, regr_slope(ca, cb) AS hr, count(*) AS n FROM al GROUP BY 1, 2), s AS (SELECT al.a, al.b, t, hr, n, ca - hr * cb AS sp FROM al JOIN h USING (a, b)),
z AS (SELECT a, b, t, hr, n, sp, (sp - avg(sp) OVER p) / stddev_pop(sp) OVER p AS z, lag(sp) OVER (PARTITION BY a, b ORDER BY t) AS ls FROM s WINDOW p AS (PARTITION BY a, b)),
g AS (SELECT a, b, any_value(hr) AS hr, sum((sp - ls) * ls) / sum(ls * ls) FILTER (ls IS NOT NULL) AS be, arg_max(z, t) AS z FROM z WHERE n >= 30 GROUP BY 1, 2)
SELECT a, b, {R('hr', 6)} AS hedge_ratio, {R('z', 6)} AS z, {R('CASE WHEN be < 0 THEN -ln(2) / be END', 4)} AS half_life, CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 ELSE 0 END AS signal FROM g""",
)
def b10(spark, sf):
    """Static hedge ratio by regression, spread z-score at the last bar,
    half-life from the lag regression."""
    al = aligned(spark, sf)
    h = al.groupBy("a", "b").agg(F.regr_slope("ca", "cb").alias("hr"), F.count(F.lit(1)).alias("n"))
    x = al.join(h.where("n >= 30"), ["a", "b"]).withColumn("sp", F.col("ca") - F.col("hr") * F.col("cb"))
    s = Series.of(x, ["a", "b"], ["t"]).totals(_m=F.avg("sp"), _s=F.stddev_pop("sp")).bounded(1, {"ls": lambda w: w.lag("sp")})
    beta = F.sum((F.col("sp") - F.col("ls")) * F.col("ls")) / F.sum(F.col("ls") * F.col("ls"))
    g = s.df.groupBy("a", "b").agg(F.first("hr").alias("hr"), beta.alias("be"), F.max_by((F.col("sp") - F.col("_m")) / F.col("_s"), "t").alias("z"))
    return g.select("a", "b", r("hr", 6).alias("hedge_ratio"), r("z", 6).alias("z"), r(F.when(F.col("be") < 0, -0.6931471805599453 / F.col("be"))).alias("half_life"), F.when(F.col("z") > 2, -1).when(F.col("z") < -2, 1).otherwise(0).alias("signal"))


@query("b11_carry", f"WITH {FUND} SELECT symbol, venue, CASE WHEN rate < -0.001 THEN 1 WHEN rate > 0.001 THEN -1 ELSE 0 END AS signal, {R('least(abs(rate) / 0.1, 1)', 6)} AS strength FROM fr")
def b11(spark, sf):
    return Y.carry(funding(spark, sf), "rate", 0.001).select("symbol", "venue", "signal", r("strength", 6).alias("strength"))


@query("b08_turtle")
def b08(spark, sf):
    return Y.turtle(bar_series(spark, sf))


@query(
    "b19_x34_grid",
    f"""WITH {BARS}, {TR}, a AS (SELECT symbol, t, close, {full(15, f'avg(tr) {over(14)}')} AS atr FROM tr), k(k) AS (VALUES (-5), (-4), (-3), (-2), (-1), (1), (2), (3), (4), (5)),
m AS (SELECT symbol, t, i, avg(close) {over(10)} AS ref FROM bar), g AS (SELECT a.symbol, a.t, close, atr, ref + k * 0.5 * atr AS lv FROM a JOIN m USING (symbol, t), k WHERE atr IS NOT NULL),
n AS (SELECT symbol, t, close, any_value(atr) AS atr, max(lv) FILTER (lv < close) AS below, min(lv) FILTER (lv > close) AS above FROM g GROUP BY 1, 2, 3)
SELECT symbol, t, {R('below')} AS below, {R('above')} AS above, CASE WHEN close - below < 0.1 * atr THEN 1 WHEN above - close < 0.1 * atr THEN -1 ELSE 0 END AS signal FROM n""",
)
def b19(spark, sf):
    """Levels around the 10-bar mean; a signal when the close nears one."""
    s = bands.atr(bar_series(spark, sf), 14, "atr").bounded(9, {"ref": lambda w: F.avg("close").over(w(10))})
    x = s.df.where("atr is not null").withColumn("g", Y.grid_levels(F.col("ref"), F.col("atr")))
    below, above = F.array_max(F.filter("g", lambda v: v < F.col("close"))), F.array_min(F.filter("g", lambda v: v > F.col("close")))
    sig = F.when(F.col("close") - below < 0.1 * F.col("atr"), 1).when(above - F.col("close") < 0.1 * F.col("atr"), -1).otherwise(0)
    return x.select("symbol", "t", r(below).alias("below"), r(above).alias("above"), sig.alias("signal"))


@query(
    "b20_market_making",
    f"""WITH {BARS}, {TR}, a AS (SELECT symbol, t, i, close, volume, taker_buy_volume, {full(15, f'avg(tr) {over(14)} / close * 100')} AS ap, avg(volume) {over(20)} AS av, sum(2 * taker_buy_volume - volume) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS inv FROM tr),
x AS (SELECT *, least(volume / greatest(av, 1e-10), 5) / 5 / 2 AS x FROM a), tx AS (SELECT p.symbol, p.t, sum(q.x * 0.3 * pow(0.7, p.i - q.i)) AS toxic FROM x p JOIN x q ON p.symbol = q.symbol AND q.i <= p.i GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN ap > 5 THEN 2 WHEN ap > 3 THEN 1 + (ap - 3) / 2 ELSE 1 END AS vm FROM x WHERE ap IS NOT NULL), qt AS (SELECT *, close * 10 / 10000 * vm AS sp, inv / 1000 * 0.5 * close * 10 / 10000 * vm AS sh FROM m)
SELECT symbol, t, {R('close - greatest(sp / 2, close * 2 / 20000) - sh')} AS bid, {R('close + greatest(sp / 2, close * 2 / 20000) - sh')} AS ask, {R('toxic')} AS toxic, CASE WHEN inv > 800 THEN -1 WHEN inv < -800 THEN 1 ELSE 0 END AS signal FROM qt JOIN tx USING (symbol, t)""",
)
def b20(spark, sf):
    s = bands.atr_percent(bar_series(spark, sf), 14).bounded(19, {"_av": lambda w: F.avg("volume").over(w(20))})
    s = s.running(inv=("sum", 2 * F.col("taker_buy_volume") - F.col("volume")))
    s = Y.toxic_flow(s, "volume", F.col("_av"), F.lit(0.0))
    x = s.df.where("atrp is not null").withColumn("q", Y.quotes(F.col("close"), F.col("atrp"), F.col("inv"), 1000.0))
    return x.select("symbol", "t", r("q.bid").alias("bid"), r("q.ask").alias("ask"), r("toxic").alias("toxic"), F.when(F.col("inv") > 800, -1).when(F.col("inv") < -800, 1).otherwise(0).alias("signal"))


# --- backtests ------------------------------------------------------------------------------
def bt_sql(low: float, high: float, name: str = "k", size: float = 0.02) -> str:
    """The position fold as a step-by-step table over the bar number."""
    return f"""ri AS (SELECT symbol, t, i, close, {rsi_sql(14)} AS rsi FROM ud), atx AS (SELECT symbol, t, {full(15, f'avg(tr) {over(14)}')} AS atr FROM tr),
rq AS MATERIALIZED (SELECT ri.*, atr, lag(rsi) {SERIES} AS p FROM ri JOIN atx USING (symbol, t)),
sg AS MATERIALIZED (SELECT *, CASE WHEN p < {low} AND rsi >= {low} THEN 1 WHEN p > {high} AND rsi <= {high} THEN -1 ELSE 0 END AS sig FROM rq),
{name} AS (SELECT symbol, i, t, CAST(100000 AS DOUBLE) AS cap, 0 AS side, CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS ep, CAST(NULL AS DOUBLE) AS pnl, CAST(0 AS BIGINT) AS et, CAST(NULL AS BIGINT) AS xt FROM sg WHERE i = 1
 UNION ALL SELECT symbol, i, t, cap2, CASE WHEN open2 THEN sig ELSE side2 END, CASE WHEN open2 THEN cap2 * {size} / (2 * atr) ELSE qty END, CASE WHEN open2 THEN close * (1 + sig * 0.0005) ELSE ep END, pnl, CASE WHEN open2 THEN t ELSE et END, CASE WHEN pnl IS NOT NULL THEN et END FROM (
  SELECT *, side2 = 0 AND sig <> 0 AND atr > 0 AND cap2 > 0 AS open2 FROM (
   SELECT *, CASE WHEN ex THEN 0 ELSE side END AS side2, cap + coalesce(pnl, 0) AS cap2 FROM (
    SELECT *, CASE WHEN ex THEN (px - ep) * side * qty - px * qty * 0.001 - ep * qty * 0.001 END AS pnl FROM (
     SELECT sg.symbol, sg.i, sg.t, sg.close, sg.sig, sg.atr, k.cap, k.side, k.qty, k.ep, k.et, sg.close * (1 - k.side * 0.0005) AS px,
       coalesce((k.side = 1 AND sg.rsi > {high}) OR (k.side = -1 AND sg.rsi < {low}), false) AS ex
     FROM {name} k JOIN sg ON sg.symbol = k.symbol AND sg.i = k.i + 1)))))"""


@query(
    "b12_backtest",
    f"WITH RECURSIVE {BARS}, {UD}, {TR}, {bt_sql(30, 70)} SELECT symbol, xt AS entry_t, t AS exit_t, {R('pnl', 2)} AS pnl FROM k WHERE pnl IS NOT NULL",
)
def b12(spark, sf):
    """RSI-cross rule through the position fold, one trade per row."""
    s = bands.atr(Y.rsi_cross(bar_series(spark, sf)), 14, "atr")
    return Y.backtest(s.df, ["symbol"], "t").select("symbol", "entry_t", "exit_t", r("pnl", 2).alias("pnl"))


@query("b13_walk_forward_backtest")
def b13(spark, sf):
    """Signals once over the whole series; one fold per (symbol, test window)."""
    s = bands.atr(Y.rsi_cross(bar_series(spark, sf)), 14, "atr")
    test = walk_windows(Series.of(s.df, ["symbol"], ["t"]), 104, 52, 52).where("part = 'test'")
    tr = Y.backtest(test, ["symbol", "win"], "t")
    return tr.groupBy("win").agg(F.count(F.lit(1)).alias("trades"), r(F.sum("pnl"), 2).alias("pnl"), r(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0))).alias("win_rate"))


GRID = [(25.0, 75.0), (30.0, 70.0), (35.0, 65.0)]


@query("b15_parameter_sweep")
def b15(spark, sf):
    """Every parameter set is an extra fold key; indicators are computed once."""
    s = bands.atr(O.rsi(bar_series(spark, sf), 14), 14, "atr").bounded(1, {"_p": lambda w: w.lag("rsi")})
    par = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in GRID])
    x = s.df.select("symbol", "t", "close", "high", "low", "atr", "rsi", "_p", F.explode(par).alias("par"))
    lo, hi = F.col("par.low"), F.col("par.high")
    no = F.lit(False)
    x = x.withColumns(
        {
            "signal": F.when((F.col("_p") < lo) & (F.col("rsi") >= lo), 1).when((F.col("_p") > hi) & (F.col("rsi") <= hi), -1).otherwise(0),
            "exit_long": F.coalesce(F.col("rsi") > hi, no), "exit_short": F.coalesce(F.col("rsi") < lo, no), "oversold": lo,
        }
    )
    tr = Y.backtest(x, ["symbol", "oversold"], "t")
    return tr.groupBy("oversold").agg(F.count(F.lit(1)).alias("trades"), r(F.sum("pnl"), 2).alias("pnl"), r(F.avg("pnl"), 2).alias("avg_pnl"))


@query(
    "t17_position_ledger",
    f"""WITH RECURSIVE {TICK}, q AS MATERIALIZED (SELECT symbol, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS d, qty, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, o1, o2, o3, price, qty, side) AS i FROM tick),
k AS (SELECT symbol, i, d AS pos, price AS av, CAST(0 AS DOUBLE) AS rl FROM q WHERE i = 1
 UNION ALL SELECT q.symbol, q.i, k.pos + q.d, CASE WHEN k.pos = 0 OR k.pos * q.d > 0 THEN (k.av * abs(k.pos) + q.price * q.qty) / (abs(k.pos) + q.qty) WHEN k.pos * (k.pos + q.d) < 0 THEN q.price WHEN k.pos + q.d = 0 THEN 0 ELSE k.av END,
  CASE WHEN k.pos = 0 OR k.pos * q.d > 0 THEN k.rl ELSE k.rl + (q.price - k.av) * least(q.qty, abs(k.pos)) * sign(k.pos) END FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1)
SELECT symbol, arg_max(pos, i) AS quantity, {R('arg_max(av, i)')} AS avg_price, {R('arg_max(rl, i)', 2)} AS realised, CAST(max(i) AS INTEGER) AS fills FROM k GROUP BY 1""",
)
def t17(spark, sf):
    x = Y.ledger(market.ticks(spark, sf), ["symbol"], ["ts", "o1", "o2", "o3", "price", "qty", "side"])
    return x.select("symbol", "quantity", r("avg_price").alias("avg_price"), r("realised", 2).alias("realised"), "fills")
