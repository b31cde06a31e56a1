"""Levels, patterns, drawdowns, quality, statistics."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.averages import ema_sql
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.oscillators import ADX, MACD, UD, rsi_sql
from tapeworks.catalog.sql import BARS, R, SERIES, WALL, full, over, span
from tapeworks.catalog.windowed import windowed
from tapeworks.functions import oscillators as O
from tapeworks.functions import structure as S
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

LEVELS = ["pivot", "s1", "s2", "s3", "s4", "r1", "r2", "r3", "r4"]


def _pivot_sql() -> str:
    p, d, w = "(ph + pl + pc) / 3", "(ph - pl)", "(ph + pl + 2 * pc) / 4"
    fam = {
        "traditional": [p, f"2 * {p} - ph", f"{p} - {d}", f"pl - 2 * (ph - {p})", f"pl - 2 * (ph - {p}) - {d}", f"2 * {p} - pl", f"{p} + {d}", f"ph + 2 * ({p} - pl)", f"ph + 2 * ({p} - pl) + {d}"],
        "fibonacci": [p] + [f"{p} - {f} * {d}" for f in (0.382, 0.618, 1, 1.382)] + [f"{p} + {f} * {d}" for f in (0.382, 0.618, 1, 1.382)],
        "camarilla": [p] + [f"pc - 1.1 / {k}.0 * {d}" for k in (12, 6, 4, 2)] + [f"pc + 1.1 / {k}.0 * {d}" for k in (12, 6, 4, 2)],
        "woodie": [w, f"2 * {w} - ph", f"{w} - {d}", f"2 * {w} - ph - {d}", f"{w} - 2 * {d}", f"2 * {w} - pl", f"{w} + {d}", f"2 * {w} - pl + {d}", f"{w} + 2 * {d}"],
    }
    return f"WITH {BARS} " + " UNION ALL ".join(
        f"SELECT symbol, t, '{m}' AS method, " + ", ".join(f"{R(e)} AS {n}" for n, e in zip(LEVELS, ex)) + " FROM bar WHERE pc IS NOT NULL" for m, ex in fam.items()
    )


@query("w56_pivot_points", _pivot_sql())
def w56(spark, sf):
    return S.pivot_points(bar_series(spark, sf)).select("symbol", "t", "method", *[r(c).alias(c) for c in LEVELS])


FIBC = {f"back_{int(f * 1000)}": f"hi - {f} * (hi - lo)" for f in S.FIB_BACK} | {
    f"beyond_{int(f * 1000)}": f"CASE WHEN up THEN lo - {f} * (hi - lo) ELSE hi + {f} * (hi - lo) END" for f in S.FIB_BEYOND
}
windowed(
    "w57_fibonacci", S.fibonacci, {"swing_high": "hi", "swing_low": "lo", **FIBC},
    ctes=f"""l AS (SELECT *, list(high) {over(100)} AS lh, list(low) {over(100)} AS ll FROM bar),
f AS (SELECT symbol, t, CASE WHEN ok THEN hi END AS hi, CASE WHEN ok THEN lo END AS lo, up FROM (
  SELECT symbol, t, list_max(lh) AS hi, list_min(ll) AS lo, list_position(lh, list_max(lh)) > list_position(ll, list_min(ll)) AS up, i >= 10 AND list_max(lh) > list_min(ll) AS ok FROM l))""",
    src="f",
)


@query("w58_level_clusters")
def w58(spark, sf):
    return S.level_clusters(bar_series(spark, sf)).select("symbol", "kind", r("level").alias("level"), "touches")


W5 = span(-5, 5)


@query(
    "w58_fractals",
    f"WITH {BARS}, f AS (SELECT symbol, t, high, low, count(*) {W5} AS n, max(high) {W5} AS mh, min(low) {W5} AS ml FROM bar) "
    f"SELECT symbol, t, 'resistance' AS kind, high AS level FROM f WHERE n = 11 AND high >= mh UNION ALL SELECT symbol, t, 'support', low FROM f WHERE n = 11 AND low <= ml",
)
def w58f(spark, sf):
    return S.fractals(bar_series(spark, sf))


LAGS = ", ".join(f"lag({c}, {j}) {SERIES} AS {a}{j}" for a, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")) for j in range(5))
windowed(
    "w59_patterns", S.patterns, raw={k: f"i >= 5 AND coalesce({v}, false)" for k, v in S.pattern_sql().items()},
    ctes=f"p AS (SELECT symbol, t, i, {LAGS} FROM bar)", src="p",
)
DD = f"dd AS (SELECT *, max(close) {WALL} AS pk, (max(close) {WALL} - close) / max(close) {WALL} AS dd FROM bar)"
windowed("w60_drawdown", S.drawdown, {"drawdown_peak": "pk", "drawdown": "dd"}, ctes=DD, src="dd")


@query(
    "w60_drawdown_episodes",
    f"WITH {BARS}, {DD}, e AS (SELECT *, lead(t) {SERIES} AS nx, sum(CASE WHEN dd = 0 THEN 1 ELSE 0 END) {WALL} AS ep FROM dd) "
    f"SELECT symbol, min(t) AS start, arg_min(t, close) AS trough, CAST(last(nx ORDER BY t) AS DOUBLE) AS recovery, {R('max(pk)', 6)} AS peak_equity, {R('min(close)', 6)} AS trough_equity, "
    f"{R('max(dd)', 6)} AS depth, count(*) AS length FROM e WHERE dd > 0 GROUP BY symbol, ep",
)
def w60e(spark, sf):
    d = S.drawdown_episodes(bar_series(spark, sf))
    return d.select("symbol", "start", "trough", F.col("recovery").cast("double").alias("recovery"), "length", *[r(c, 6).alias(c) for c in ("peak_equity", "trough_equity", "depth")])


RET = "rt AS (SELECT *, close / pc - 1 AS r FROM bar)"
SQ52 = "sqrt(52)"
windowed(
    "w61_rolling_sharpe", S.rolling_sharpe,
    {
        "rolling_sharpe": full(61, f"avg(r) {over(60)} / stddev_samp(r) {over(60)} * {SQ52}"),
        "rolling_sortino": full(61, f"avg(r) {over(60)} / nullif(stddev_samp(CASE WHEN r < 0 THEN r END) {over(60)}, 0) * {SQ52}"),
    },
    ctes=RET, src="rt",
)
windowed(
    "w61_rolling_max_drawdown", lambda s: S.rolling_max_drawdown(s, 60),
    {"rolling_max_dd": full(60, "list_max(list_transform(range(1, 61), lambda k: 1 - l[k] / list_max(l[1:k])))")},
    ctes=f"l AS (SELECT symbol, t, i, list(close) {over(60)} AS l FROM bar)", src="l",
)
P52 = span(-52, -1)
NEG = "CASE WHEN r < 0 THEN r END"
windowed(
    "w62_trailing_metrics", S.trailing_metrics,
    {
        "trail_sharpe": full(54, f"avg(r) {P52} / stddev_pop(r) {P52} * {SQ52}"),
        "trail_sortino": full(54, f"CASE WHEN count({NEG}) {P52} >= 2 THEN avg(r) {P52} / stddev_pop({NEG}) {P52} * {SQ52} ELSE 0 END"),
        "trail_win_rate": full(54, f"avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) {P52}"),
    },
    ctes=RET, src="rt",
)


@query(
    "w63_streak_maxima",
    f"WITH {BARS}, x AS (SELECT symbol, i, close > pc AS w FROM bar WHERE pc IS NOT NULL), g AS (SELECT *, i - row_number() OVER (PARTITION BY symbol, w ORDER BY i) AS g FROM x), "
    "n AS (SELECT symbol, w, count(*) AS n FROM g GROUP BY symbol, w, g) "
    "SELECT symbol, coalesce(max(n) FILTER (w), 0) AS consecutive_wins, coalesce(max(n) FILTER (NOT w), 0) AS consecutive_losses FROM n GROUP BY 1",
)
def w63(spark, sf):
    s = bar_series(spark, sf).bounded(1, {"_p": lambda w: w.lag("close")})
    s = Series.of(s.df.where("_p is not null"), ["symbol"], ["t"])
    return S.streak_maxima(s, F.col("close") > F.col("_p"))


def rolling_stats(s):
    n = 20
    return s.bounded(n - 1, {k: (lambda w, f=f: w.full(n, f("close").over(w(n)))) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))})


windowed("w64_rolling_stats", rolling_stats, {k: full(20, f"{f}(close) {over(20)}") for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))})


@query(
    "w64_sliding_windows",
    f"WITH {BARS}, l AS (SELECT symbol, i, list(close) {over(10)} AS l FROM bar) SELECT symbol, CAST((i - 10) / 5 AS BIGINT) AS win, len(l) AS size, l[1] AS first, l[10] AS last, "
    f"{R('list_sum(list_transform(l, lambda x, k: x * k))')} AS weighted FROM l WHERE i >= 10 AND (i - 10) % 5 = 0",
)
def w64s(spark, sf):
    """Windows of 10 rows every 5 rows, one array per window."""
    s = bar_series(spark, sf).bounded(9, {"l": lambda w: F.collect_list("close").over(w(10))})
    rows = s.rows.where((F.col(IDX) >= 10) & ((F.col(IDX) - 10) % 5 == 0))
    dot = F.aggregate(F.zip_with("l", F.sequence(F.lit(1), F.lit(10)), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    return rows.select("symbol", ((F.col(IDX) - 10) / 5).cast("bigint").alias("win"), F.size("l").alias("size"), F.get("l", F.lit(0)).alias("first"), F.get("l", F.lit(9)).alias("last"), r(dot).alias("weighted"))


windowed(
    "w64_expanding", lambda s: s.running(_s=("sum", "close"), lo=("min", "close"), hi=("max", "close")).mutate(mean=F.when(F.col(IDX) >= 5, F.col("_s") / F.col(IDX))),
    {"mean": full(5, f"avg(close) {WALL}"), "lo": f"min(close) {WALL}", "hi": f"max(close) {WALL}"},
)


@query(
    "w65_supervised_windows",
    f"WITH {BARS}, l AS (SELECT symbol, t, i, list(close) {over(20)} AS l, lead(close, 5) {SERIES} AS y FROM bar) "
    f"SELECT symbol, t, len(l) AS size, {R('list_sum(list_transform(l, lambda x, k: x * k))')} AS weighted, {R('y')} AS target FROM l WHERE i >= 20 AND y IS NOT NULL AND (i - 20) % 2 = 0",
)
def w65(spark, sf):
    """Input windows of 20 rows with the value 5 rows ahead, stride 2."""
    s = bar_series(spark, sf).bounded(19, {"l": lambda w: F.collect_list("close").over(w(20)), "y": lambda w: w.lead("close", 5)}, ahead=5)
    rows = s.rows.where((F.col(IDX) >= 20) & F.col("y").isNotNull() & ((F.col(IDX) - 20) % 2 == 0))
    dot = F.aggregate(F.zip_with("l", F.sequence(F.lit(1), F.lit(20)), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    return rows.select("symbol", "t", F.size("l").alias("size"), r(dot).alias("weighted"), r("y").alias("target"))


@query(
    "w66_gaps",
    f"WITH {BARS}, g AS (SELECT symbol, lag(t) {SERIES} AS p, t FROM bar) SELECT symbol, p AS gap_start, t AS gap_end, t - p AS gap, t - p - 1 AS missing_bars FROM g WHERE t - p > 2",
)
def w66(spark, sf):
    return S.gaps(bar_series(spark, sf), "t")


@query(
    "w67_fill_gaps",
    f"""WITH {BARS}, sp AS (SELECT symbol, min(t) AS a, max(t) AS b FROM bar GROUP BY 1), g AS (SELECT symbol, unnest(range(a, b + 1)) AS t FROM sp),
x AS (SELECT g.symbol, g.t, bar.close FROM g LEFT JOIN bar USING (symbol, t)),
y AS (SELECT *, last_value(close IGNORE NULLS) {WALL} AS ff, last_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) {WALL} AS ta,
  first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf,
  first_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM x)
SELECT symbol, t, {R('ff')} AS ffill, {R('bf')} AS bfill, {R('coalesce(close, 0)')} AS zero, {R('CASE WHEN close IS NOT NULL THEN close ELSE ff + (bf - ff) * (t - ta) / (tb - ta) END')} AS linear FROM y""",
)
def w67(spark, sf):
    grid = S.on_full_grid(market.bars(spark, sf).select("symbol", "t", "close"), ["symbol"], "t")
    s = S.fill_gaps(Series.of(grid, ["symbol"], ["t"]), "close", "t")
    return s.df.select("symbol", "t", *[r(c).alias(c) for c in ("ffill", "bfill", "zero", "linear")])


@query(
    "w68_outliers",
    f"""WITH {BARS}, q AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS sd, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3, count(*) AS n FROM bar GROUP BY 1)
SELECT symbol, t, n >= 10 AND abs(close - m) > 3 * sd AS z_outlier, n >= 10 AND (close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1)) AS iqr_outlier,
  CASE WHEN NOT (n >= 10 AND abs(close - m) > 3 * sd) THEN close END AS cleaned FROM bar JOIN q USING (symbol)""",
)
def w68(spark, sf):
    return S.outliers(market.bars(spark, sf), ["symbol"], "close", z=3.0).select("symbol", "t", "z_outlier", "iqr_outlier", "cleaned")


windowed("w69_zscore", S.zscore, {"zscore": full(20, f"CASE WHEN stddev_samp(close) {over(20)} = 0 THEN 0 ELSE (close - avg(close) {over(20)}) / stddev_samp(close) {over(20)} END")})
A25, B25 = span(-49, -25), span(-24, 0)
DIV = f"""{UD}, rs AS (SELECT *, {rsi_sql(14)} AS rsi FROM ud),
ls AS (SELECT *, list(close) {over(50)} AS lc, list(rsi) {over(50)} AS lr FROM rs),
hv AS (SELECT symbol, t, i, list_min(lc[1:25]) AS l1, list_min(lc[26:50]) AS l2, list_max(lc[1:25]) AS h1, list_max(lc[26:50]) AS h2, lc, lr FROM ls),
dv AS (SELECT *, lr[list_position(lc[1:25], l1)] AS v1, lr[25 + list_position(lc[26:50], l2)] AS v2, lr[list_position(lc[1:25], h1)] AS w1, lr[25 + list_position(lc[26:50], h2)] AS w2 FROM hv)"""
windowed(
    "w70_w71_rsi_divergence", lambda s: S.divergences(O.rsi(s, 14, "rsi"), "rsi", 50, first_valid=15),
    raw={
        "bullish_regular": "coalesce(i >= 64 AND l2 < l1 AND v2 > v1, false)", "bearish_regular": "coalesce(i >= 64 AND h2 > h1 AND w2 < w1, false)",
        "bullish_hidden": "coalesce(i >= 64 AND l2 > l1 AND v2 < v1, false)", "bearish_hidden": "coalesce(i >= 64 AND h2 < h1 AND w2 > w1, false)",
    },
    ctes=DIV, src="dv",
)
MV = f"""{MACD}, mh AS (SELECT bar.*, m.m - g.y AS h FROM bar LEFT JOIN m USING (symbol, t) LEFT JOIN g USING (symbol, t)),
mv AS (SELECT *, min(close) {A25} AS l1, min(close) {B25} AS l2, max(close) {A25} AS h1, max(close) {B25} AS h2, avg(volume) {A25} AS v1, avg(volume) {B25} AS v2,
  coalesce(min(h) {A25}, 0) AS m1, coalesce(min(h) {B25}, 0) AS m2, coalesce(max(h) {A25}, 0) AS x1, coalesce(max(h) {B25}, 0) AS x2 FROM mh)"""
windowed(
    "w71_macd_volume_divergence", lambda s: S.macd_volume_divergence(O.macd(s)),
    raw={
        "macd_bullish": "coalesce(i >= 53 AND l2 < l1 AND m2 > m1, false)", "macd_bearish": "coalesce(i >= 53 AND h2 > h1 AND x2 < x1, false)",
        "volume_bullish": "coalesce(i >= 50 AND l2 < l1 AND v2 < 0.8 * v1, false)", "volume_bearish": "coalesce(i >= 50 AND h2 > h1 AND v2 < 0.8 * v1, false)",
    },
    ctes=MV, src="mv",
)


def hurst_ctes(src: str, min_n: int = 99) -> str:
    return f"""r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY t) AS j, ln(close / pc) AS r FROM {src} WHERE pc IS NOT NULL),
nn AS (SELECT symbol, count(*) AS n FROM r GROUP BY 1),
sg AS (SELECT r.symbol, k, CAST(floor((j - 1) / k) AS BIGINT) AS g, j, r, n FROM r JOIN nn USING (symbol), range(10, 50) AS ks(k) WHERE n >= {min_n} AND k < least(50, floor(n / 2))),
mn AS (SELECT *, avg(r) OVER (PARTITION BY symbol, k, g) AS m, count(*) OVER (PARTITION BY symbol, k, g) AS c FROM sg),
cd AS (SELECT *, sum(r - m) OVER (PARTITION BY symbol, k, g ORDER BY j ROWS UNBOUNDED PRECEDING) AS d FROM mn WHERE c = k),
rr AS (SELECT symbol, k, g, (max(d) - min(d)) / nullif(stddev_samp(r), 0) AS rs FROM cd GROUP BY 1, 2, 3),
av AS (SELECT symbol, k, avg(rs) AS rs FROM rr GROUP BY 1, 2),
hu AS (SELECT symbol, regr_slope(ln(rs), ln(k)) AS hurst FROM av WHERE rs > 0 GROUP BY 1)"""


@query("w72_hurst", f"WITH {BARS}, {hurst_ctes('bar')} SELECT symbol, {R('hurst')} AS hurst FROM hu")
def w72(spark, sf):
    return S.hurst(bar_series(spark, sf)).select("symbol", r("hurst").alias("hurst"))


@query(
    "w73_market_regime",
    f"""WITH {BARS}, {ADX}, lastbar AS (SELECT symbol, max(t) AS t, max(i) AS n FROM bar GROUP BY 1),
tail AS (SELECT bar.symbol, bar.t, bar.close, CASE WHEN bar.i > n - 99 THEN bar.pc END AS pc, n FROM bar JOIN lastbar l ON bar.symbol = l.symbol WHERE bar.i > n - 100),
vol AS (SELECT symbol, stddev_pop(ln(close / pc)) AS vol, max(n) AS n FROM tail GROUP BY 1), {hurst_ctes('tail')}
SELECT vol.symbol, {R('vol')} AS vol, {R('x.y')} AS adx, {R('hurst')} AS hurst,
  CASE WHEN vol.n < 50 THEN 'unknown' WHEN vol > 0.9 THEN 'volatile' WHEN vol < 0.01 THEN 'quiet' WHEN x.y > 25 THEN 'trending' WHEN hurst < 0.45 THEN 'mean_reverting' WHEN x.y > 20 THEN 'trending' ELSE 'quiet' END AS regime
FROM vol JOIN lastbar USING (symbol) LEFT JOIN x ON x.symbol = vol.symbol AND x.t = lastbar.t LEFT JOIN hu ON hu.symbol = vol.symbol""",
)
def w73(spark, sf):
    """Regime at the latest bar; the volatility limit fits weekly bars."""
    return market_regime(bar_series(spark, sf), vol_high=0.9).select("symbol", r("vol").alias("vol"), r("adx").alias("adx"), r("hurst").alias("hurst"), "regime")


def market_regime(s: Series, back: int = 100, vol_high: float = 0.05, vol_low: float = 0.01):
    s = O.adx(s).totals(_n=F.max(IDX))
    tail = s.rows.where(F.col(IDX) > F.col("_n") - back).select("symbol", "t", "close", "adx", "_n")
    ts = Series.of(tail, ["symbol"], ["t"])
    hu = S.hurst(ts)
    vol = ts.bounded(1, {"_r": lambda w: F.log(F.col("close") / w.lag("close"))}).df.groupBy("symbol").agg(
        F.stddev_pop("_r").alias("vol"), F.max_by("adx", "t").alias("adx"), F.max("_n").alias("n")
    )
    x = vol.join(hu, "symbol", "left")
    c = F.col
    return x.withColumn(
        "regime",
        F.when(c("n") < 50, "unknown").when(c("vol") > vol_high, "volatile").when(c("vol") < vol_low, "quiet").when(c("adx") > 25, "trending")
        .when(c("hurst") < 0.45, "mean_reverting").when(c("adx") > 20, "trending").otherwise("quiet"),
    )


windowed(
    "w74_vol_regime", S.rolling_vol_regime, {"vol_low": "lo", "vol_high": "hi"},
    raw={"regime": "CASE WHEN v IS NULL THEN 0 WHEN v > hi OR m < -3 * v THEN 2 WHEN v > lo THEN 1 ELSE 0 END"},
    ctes=f"""{RET}, v AS (SELECT symbol, t, i, {full(51, f'stddev_pop(r) {over(50)}')} AS v, {full(51, f'avg(r) {over(50)}')} AS m FROM rt),
q AS (SELECT *, quantile_cont(v, 0.33) {over(200)} AS lo, quantile_cont(v, 0.67) {over(200)} AS hi FROM v)""",
    src="q",
)
CU = f"""{RET}, b0 AS (SELECT symbol, t, i - 1 AS i, r FROM rt WHERE r IS NOT NULL),
bl AS (SELECT a.symbol, a.t, a.i, a.r, coalesce(sum(CASE WHEN x.i = 1 THEN x.r * pow(0.9, a.i - 2) ELSE 0.1 * pow(0.9, a.i - 1 - x.i) * x.r END), 0) AS b
  FROM b0 a LEFT JOIN b0 x ON a.symbol = x.symbol AND x.i < a.i GROUP BY 1, 2, 3, 4),
cs AS MATERIALIZED (SELECT symbol, t, i, b, r - b - 0.1 AS u, b - r - 0.1 AS d FROM bl),
k AS (SELECT symbol, t, i, b, greatest(0, u) AS up, greatest(0, d) AS dn FROM cs WHERE i = 1
  UNION ALL SELECT cs.symbol, cs.t, cs.i, cs.b, greatest(0, k.up + cs.u), greatest(0, k.dn + cs.d) FROM k JOIN cs ON cs.symbol = k.symbol AND cs.i = k.i + 1)"""


@query("w80_cusum", f"WITH RECURSIVE {BARS}, {CU} SELECT symbol, t, {R('b')} AS baseline, {R('up')} AS cusum_pos, {R('dn')} AS cusum_neg FROM k")
def w80(spark, sf):
    s = bar_series(spark, sf).bounded(1, {"r": lambda w: F.col("close") / w.lag("close") - 1})
    s = S.cusum(Series.of(s.df.where("r is not null"), ["symbol"], ["t"]), "r")
    return s.df.select("symbol", "t", *[r(c).alias(c) for c in ("baseline", "cusum_pos", "cusum_neg")])


@query(
    "w79_cross_section_ranks",
    f"""WITH {BARS}, x AS (SELECT symbol, t, close / pc - 1 AS r FROM bar WHERE pc IS NOT NULL)
SELECT symbol, t, rank() OVER w AS rk, dense_rank() OVER w AS dense_rk, ntile(4) OVER (PARTITION BY t ORDER BY r DESC, symbol) AS quartile, round(percent_rank() OVER w, 6) AS pct FROM x WINDOW w AS (PARTITION BY t ORDER BY r DESC)""",
)
def w79(spark, sf):
    """Symbols ranked by return within each bar (a bar holds each symbol once)."""
    from pyspark.sql import Window

    s = bar_series(spark, sf).bounded(1, {"r": lambda w: F.col("close") / w.lag("close") - 1})
    w = Window.partitionBy("t").orderBy(F.desc("r"))
    tie = Window.partitionBy("t").orderBy(F.desc("r"), "symbol")
    return s.df.where("r is not null").select("symbol", "t", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dense_rk"), F.ntile(4).over(tie).alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pct"))


@query(
    "w81_equity_tracker",
    f"""WITH {BARS}, e AS (SELECT symbol, t, i, close, CAST(floor(t / 4.0) AS BIGINT) AS period, first_value(close) {SERIES} AS base, max(close) {WALL} AS pk FROM bar)
SELECT symbol, t, {R('close - base')} AS pnl, {R('(close - base) / base')} AS pnl_pct, {R('(pk - close) / pk')} AS drawdown,
 {R('greatest(0, 1 - close / first_value(close) OVER (PARTITION BY symbol, period ORDER BY t))')} AS period_drawdown FROM e""",
)
def w81(spark, sf):
    """PnL from the first value, drawdown from the peak, loss since period start."""
    s = bar_series(spark, sf).mutate(period=F.floor(F.col("t") / 4))
    s = s.bounded(1, {"_new": lambda w: F.when(~F.col("period").eqNullSafe(w.lag("period")), F.col("close"))})
    s = S.drawdown(s.running(_open=("last", "_new"), _base=("last", F.when(F.col(IDX) == 1, F.col("close")))))
    c = F.col
    return s.df.select(
        "symbol", "t", r(c("close") - c("_base")).alias("pnl"), r((c("close") - c("_base")) / c("_base")).alias("pnl_pct"), r("drawdown").alias("drawdown"),
        r(F.greatest(F.lit(0.0), 1 - c("close") / c("_open"))).alias("period_drawdown"),
    )
