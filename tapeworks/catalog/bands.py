"""Volatility, channels, volume."""

import math

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.averages import ema_sql
from tapeworks.catalog.base import r
from tapeworks.catalog.sql import BARS, R, SERIES, WALL, bars_cte, full, over
from tapeworks.catalog.windowed import windowed
from tapeworks.functions import bands as X
from tapeworks.sources import market

TR = "tr AS (SELECT *, CASE WHEN i > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM bar)"
YR = math.sqrt(365) * 100

windowed("w30_true_range", X.true_range, {"tr": "tr"}, ctes=TR, src="tr")
windowed("w31_atr", X.atr, {"atr": full(15, f"avg(tr) {over(14)}")}, ctes=TR, src="tr")
windowed("w31_atr_wilder", X.atr_wilder, {"atr_wilder": "e.y"}, ctes=f"{TR}, {ema_sql('tr', 'tr', 14, 1, 1 / 14)}", src="bar LEFT JOIN e USING (symbol, t)")
windowed("w32_atr_percent", X.atr_percent, {"atrp": full(15, f"avg(tr) {over(14)} / close * 100")}, ctes=TR, src="tr")
BB = f"bb AS (SELECT *, {full(20, f'avg(close) {over(20)}')} AS m, {full(20, f'stddev_pop(close) {over(20)}')} AS sd FROM bar)"
windowed(
    "w33_bollinger", X.bollinger,
    {"bb_mid": "m", "bb_upper": "m + 2 * sd", "bb_lower": "m - 2 * sd", "bb_width": "4 * sd / m", "bb_pct": "CASE WHEN sd > 0 THEN (close - m + 2 * sd) / (4 * sd) WHEN m IS NOT NULL THEN 0.5 END"},
    ctes=BB, src="bb",
)
KC = f"{TR}, art AS (SELECT symbol, t, i, {full(21, f'avg(tr) {over(10)}')} AS a FROM tr), {ema_sql('bar', 'close', 20)}"
windowed(
    "w34_keltner", X.keltner, {"kc_mid": "CASE WHEN art.i > 20 THEN e.y END", "kc_upper": "e.y + 1.5 * a", "kc_lower": "e.y - 1.5 * a"},
    ctes=KC, src="art LEFT JOIN e USING (symbol, t)",
)
MX, MN = full(20, f"max(high) {over(20)}"), full(20, f"min(low) {over(20)}")
windowed("w35_donchian", X.donchian, {"dc_upper": MX, "dc_lower": MN, "dc_mid": f"({MX} + {MN}) / 2"})
windowed("w36_rolling_std", X.rolling_std, {"std": full(20, f"stddev_pop(close) {over(20)}")})
windowed("w37_hist_vol", X.hist_vol, {"hist_vol": full(21, f"stddev_samp(lr) {over(20)} * {YR!r}")}, ctes="lr AS (SELECT *, ln(close / pc) AS lr FROM bar)", src="lr")
windowed("w38_parkinson", X.parkinson, {"parkinson": full(20, f"sqrt(sum(pow(ln(high / low), 2)) {over(20)} / (80 * ln(2))) * {YR!r}")})
windowed(
    "w39_garman_klass", X.garman_klass,
    {"garman_klass": full(20, f"sqrt(greatest(sum(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)) {over(20)} / 20, 0)) * {YR!r}")},
)


def _dot(ws):
    n = len(ws)
    return " + ".join(f"lag(high - low, {n - 1 - j}) {SERIES} * {w!r}" for j, w in enumerate(ws))


CL, CB = X.chaikin_weights(10, 10)
windowed("w40_chaikin_vol", X.chaikin_vol, {"chaikin_vol": "CASE WHEN b = 0 THEN 0 ELSE (a - b) / b * 100 END"}, ctes=f"c AS (SELECT symbol, t, {_dot(CL)} AS a, {_dot(CB)} AS b FROM bar)", src="c")
windowed("w41_obv", X.obv, {"obv": f"sum(coalesce(sign(close - pc) * volume, 0)) {WALL}"})
MFM = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END"
windowed("w42_ad_line", X.ad_line, {"ad_line": f"sum({MFM} * volume) {WALL}"})
windowed("w43_cmf", X.cmf, {"cmf": full(20, f"sum({MFM} * volume) {over(20)} / sum(volume) {over(20)}")})
windowed("w44_force_index", X.force_index, {"force_index": "e.y"}, ctes=f"f AS (SELECT symbol, t, i, coalesce((close - pc) * volume, 0) AS f FROM bar), {ema_sql('f', 'f', 13)}", src="bar LEFT JOIN e USING (symbol, t)")
windowed(
    "w45_ease_of_movement", lambda s: X.ease_of_movement(s).mutate(emv_millions=F.col("emv") / 1e6), {"emv_millions": full(15, f"avg(e) {over(14)} / 1000000")},
    ctes="e AS (SELECT *, ((high + low) / 2 - (ph + pl) / 2) / ((volume / CAST(1e6 AS DOUBLE)) / (high - low + CAST(1e-10 AS DOUBLE)) + CAST(1e-10 AS DOUBLE)) AS e FROM bar)", src="e",
)
windowed("w46_volume_osc", X.volume_oscillator, {"volume_osc": full(20, f"(avg(volume) {over(5)} / avg(volume) {over(20)} - 1) * 100")})
# the index compounds over the whole series, so it is reported as a logarithm
IDXSQL = lambda op: f"ln(1000) + sum(CASE WHEN volume {op} pv THEN ln(close / pc) ELSE 0 END) {WALL}"
windowed("w47_nvi", lambda s: X.volume_index(s, True, "nvi").mutate(log_nvi=F.log("nvi")), {"log_nvi": IDXSQL("<")})
windowed("w48_pvi", lambda s: X.volume_index(s, False, "pvi").mutate(log_pvi=F.log("pvi")), {"log_pvi": IDXSQL(">")})
MID = lambda n: f"(max(high) {over(n)} + min(low) {over(n)}) / 2"
windowed(
    "w49_ichimoku", X.ichimoku,
    {"tenkan": full(52, MID(9)), "kijun": full(52, MID(26)), "senkou_a": full(52, f"({MID(9)} + {MID(26)}) / 2"), "senkou_b": full(52, MID(52)), "chikou": full(52, "close")},
)
windowed(
    "w50_squeeze", X.squeeze, {"squeeze_momentum": "CASE WHEN bb.i > 20 THEN close - m END"}, raw={"squeeze": "coalesce((m - 2 * sd >= e.y - 1.5 * a) AND (m + 2 * sd <= e.y + 1.5 * a), false)"},
    ctes=f"{BB}, {KC}", src="bb LEFT JOIN art USING (symbol, t) LEFT JOIN e USING (symbol, t)",
)
windowed("w51_vwap", X.vwap, {"vwap": f"sum((high + low + close) / 3 * volume) {WALL} / sum(volume) {WALL}"})


@query(
    "w52_vwap_bands",
    f"WITH {BARS}, m AS (SELECT symbol, sum((high + low + close) / 3 * volume) / sum(volume) AS vw FROM bar GROUP BY 1), "
    "v AS (SELECT symbol, vw, sqrt(sum(volume * pow((high + low + close) / 3 - vw, 2)) / sum(volume)) AS sd FROM bar JOIN m USING (symbol) GROUP BY 1, 2) "
    f"SELECT symbol, {R('vw')} AS vwap, {R('sd')} AS std_dev, {R('vw + 2 * sd')} AS upper, {R('vw - 2 * sd')} AS lower FROM v",
)
def w52(spark, sf):
    return X.vwap_bands(market.bars(spark, sf), ["symbol"]).select("symbol", *[r(c).alias(c) for c in ("vwap", "std_dev", "upper", "lower")])


LG = range(8, 49)
windowed(
    "w53_dominant_cycle", X.dominant_cycle,
    raw={"dominant_cycle": "CASE WHEN i >= 96 THEN CAST(7 + list_position(cs, list_max(cs)) AS DOUBLE) END"},
    ctes="lg AS (SELECT symbol, t, i, close, " + ", ".join(f"lag(close, {p}) {SERIES} AS l{p}" for p in LG) + " FROM bar), "
    + "cs AS (SELECT symbol, t, i, [" + ", ".join(f"corr(close, l{p}) {over(96 - p)}" for p in LG) + "] AS cs FROM lg)",
    src="cs",
)
windowed(
    "w54_fractal_dimension", X.fractal_dimension,
    {"fractal_dim": full(21, f"CASE WHEN rg = 0 OR pa = 0 THEN 1.5 ELSE greatest(1.0, least(2.0, 1 + ln(pa / rg) / ln(20))) END")},
    ctes=f"d AS (SELECT *, sum(abs(close - pc)) {over(19)} AS pa, max(close) {over(20)} - min(close) {over(20)} AS rg FROM bar)", src="d",
)
windowed(
    "w55_supertrend", X.supertrend, {"supertrend": "st"}, raw={"st_dir": "coalesce(d, 1.0)"}, recursive=True,
    ctes=f"""{TR}, {ema_sql('tr', 'tr', 10, 1, 1 / 10)},
b AS (SELECT bar.symbol, bar.t, bar.i, close, (high + low) / 2 + 3 * y AS ub, (high + low) / 2 - 3 * y AS lb FROM bar LEFT JOIN e USING (symbol, t)),
q AS MATERIALIZED (SELECT *, lag(ub) {SERIES} AS pub, lag(lb) {SERIES} AS plb FROM b),
k AS (SELECT symbol, t, i, CAST(1.0 AS DOUBLE) AS d, lb AS st FROM q WHERE i = 11
  UNION ALL SELECT symbol, t, i, d, CASE WHEN d = 1 THEN greatest(lb, pst) ELSE least(ub, pst) END FROM (
    SELECT q.symbol, q.t, q.i, q.lb, q.ub, k.st AS pst, CAST(CASE WHEN q.close > q.pub THEN 1 WHEN q.close < q.plb THEN -1 ELSE k.d END AS DOUBLE) AS d
    FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1))""",
    src="bar LEFT JOIN k USING (symbol, t)",
)
