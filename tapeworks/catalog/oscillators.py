"""Oscillators."""

from tapeworks.catalog.averages import ema_sql
from tapeworks.catalog.sql import SERIES, full, over, span
from tapeworks.catalog.windowed import windowed
from tapeworks.functions import oscillators as O

UD = "ud AS (SELECT *, close - pc AS ch, CASE WHEN close > pc THEN close - pc ELSE 0 END AS up, CASE WHEN close < pc THEN pc - close ELSE 0 END AS dn FROM bar)"


def strength(g: str, l: str) -> str:
    return f"CASE WHEN {l} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {g} / {l}) END"


def rsi_sql(n: int) -> str:
    return full(n + 1, strength(f"avg(up) {over(n)}", f"avg(dn) {over(n)}"))


windowed("w14_rsi", O.rsi, {"rsi": rsi_sql(14)}, ctes=UD, src="ud")
windowed(
    "w14_rsi_wilder", O.rsi_wilder, {"rsi_wilder": strength("g.y", "l.y")},
    ctes=f"{UD}, {ema_sql('ud', 'up', 14, 1, 1 / 14, 'g')}, {ema_sql('ud', 'dn', 14, 1, 1 / 14, 'l')}",
    src="bar LEFT JOIN g USING (symbol, t) LEFT JOIN l USING (symbol, t)",
)

STREAK = UD + f""", sg AS (SELECT *, sign(ch) AS sg FROM ud),
tn AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) {SERIES} THEN i END AS tn FROM sg),
st AS (SELECT *, abs(sg * (i - max(tn) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) + 1)) AS st, (close / pc - 1) * 100 AS chp FROM tn),
l AS (SELECT *, {rsi_sql(3)} AS r3, list(st) {over(100)} AS ls, list(chp) {over(100)} AS lc FROM st)"""
windowed(
    "w15_connors_rsi", O.connors_rsi,
    {"crsi": full(101, "(r3 + len(list_filter(ls, lambda x: x <= st)) / 100.0 * 100 + len(list_filter(lc, lambda x: x <= chp)) / 100.0 * 100) / 3")},
    ctes=STREAK, src="l",
)
windowed(
    "w15_streak", O.streak, raw={"streak": "CAST(sg * (i - max(tn) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) + 1) AS DOUBLE)"},
    ctes=STREAK, src="tn",
)

MACD = f"{ema_sql('bar', 'close', 12, name='f')}, {ema_sql('bar', 'close', 26, name='s')}, m AS (SELECT symbol, t, s.i, f.y - s.y AS m FROM s JOIN f USING (symbol, t)), {ema_sql('m', 'm', 9, 25, name='g')}"
windowed(
    "w16_macd", O.macd, {"macd": "m.m", "macd_signal": "g.y", "macd_hist": "m.m - g.y"}, ctes=MACD,
    src="bar LEFT JOIN m USING (symbol, t) LEFT JOIN g USING (symbol, t)",
)


def vwma(n: int) -> str:
    return full(n, f"CASE WHEN sum(volume) {over(n)} > 0 THEN sum(close * volume) {over(n)} / sum(volume) {over(n)} END")


windowed(
    "w17_vw_macd", O.vw_macd, {"vw_macd": "m", "vw_signal": full(34, f"avg(m) {over(9)}"), "vw_hist": f"m - {full(34, f'avg(m) {over(9)}')}"},
    ctes=f"m AS (SELECT *, {vwma(12)} - {vwma(26)} AS m FROM bar)", src="m",
)
HL = lambda n: f"hl AS (SELECT *, max(high) {over(n)} AS hh, min(low) {over(n)} AS ll FROM bar)"
KK = full(14, "CASE WHEN hh = ll THEN 50.0 ELSE (close - ll) / (hh - ll) * 100 END")
windowed("w18_stochastic", O.stochastic, {"stoch_k": "k", "stoch_d": full(16, f"avg(k) {over(3)}")}, ctes=f"{HL(14)}, k AS (SELECT *, {KK} AS k FROM hl)", src="k")
windowed(
    "w19_cci", O.cci, {"cci": full(20, "CASE WHEN mad = 0 THEN 0 ELSE (tp - m) / (0.015 * mad) END")},
    ctes=f"tp AS (SELECT *, (high + low + close) / 3 AS tp FROM bar), m AS (SELECT *, avg(tp) {over(20)} AS m, list(tp) {over(20)} AS l FROM tp), "
    "d AS (SELECT *, list_sum(list_transform(l, lambda x: abs(x - m))) / 20 AS mad FROM m)", src="d",
)
windowed("w20_williams_r", O.williams_r, {"williams_r": full(14, "CASE WHEN hh = ll THEN -50.0 ELSE (hh - close) / (hh - ll) * -100 END")}, ctes=HL(14), src="hl")
windowed("w21_roc", O.roc, {"roc": f"(close - lag(close, 12) {SERIES}) / lag(close, 12) {SERIES} * 100"})
windowed("w22_momentum", O.momentum, {"momentum": f"close - lag(close, 10) {SERIES}"})
windowed(
    "w23_trix", O.trix, {"trix": f"(e3.y / lag(e3.y) OVER (PARTITION BY bar.symbol ORDER BY bar.t) - 1) * 10000"},
    ctes=f"{ema_sql('bar', 'close', 15, name='e1')}, {ema_sql('e1', 'y', 15, 14, name='e2')}, {ema_sql('e2', 'y', 15, 28, name='e3')}",
    src="bar LEFT JOIN e3 USING (symbol, t)",
)
BP = """bp AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE close - least(low, pc) END AS bp,
  CASE WHEN i = 1 THEN 0 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM bar)"""
pt = lambda n: f"sum(bp) {over(n)} / sum(tr) {over(n)}"
windowed(
    "w24_ultimate", O.ultimate,
    {"ultimate": full(29, f"CASE WHEN sum(tr) {over(7)} = 0 OR sum(tr) {over(14)} = 0 OR sum(tr) {over(28)} = 0 THEN 50.0 ELSE (4 * {pt(7)} + 2 * {pt(14)} + {pt(28)}) / 7 * 100 END")},
    ctes=BP, src="bp",
)
windowed(
    "w25_mfi", O.mfi, {"mfi": full(15, strength(f"sum(pf) {over(14)}", f"sum(nf) {over(14)}"))},
    ctes=f"tp AS (SELECT *, (high + low + close) / 3 AS tp FROM bar), lg AS (SELECT *, lag(tp) {SERIES} AS ltp FROM tp), "
    "f AS (SELECT *, CASE WHEN tp > ltp THEN tp * volume ELSE 0 END AS pf, CASE WHEN tp < ltp THEN tp * volume ELSE 0 END AS nf FROM lg)", src="f",
)
DM = """dm AS (SELECT *, CASE WHEN i > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pd,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS md FROM bar)"""
ADX = f"""{DM}, {ema_sql('dm', 'tr', 14, 1, 1 / 14, 'a')}, {ema_sql('dm', 'pd', 14, 1, 1 / 14, 'p')}, {ema_sql('dm', 'md', 14, 1, 1 / 14, 'm')},
di AS (SELECT symbol, t, a.i, CASE WHEN a.y > 0 THEN p.y / a.y * 100 ELSE 0 END AS pdi, CASE WHEN a.y > 0 THEN m.y / a.y * 100 ELSE 0 END AS mdi
  FROM a JOIN p USING (symbol, t) JOIN m USING (symbol, t)),
dx AS (SELECT *, CASE WHEN pdi + mdi > 0 THEN abs(pdi - mdi) / (pdi + mdi) * 100 ELSE 0 END AS dx FROM di), {ema_sql('dx', 'dx', 14, 14, 1 / 14, 'x')}"""
windowed("w26_adx", O.adx, {"plus_di": "pdi", "minus_di": "mdi", "adx": "x.y"}, ctes=ADX, src="bar LEFT JOIN di USING (symbol, t) LEFT JOIN x USING (symbol, t)")
UP, DOWN = "(list_position(lh, list_max(lh)) - 1) / 25.0 * 100", "(list_position(ll, list_min(ll)) - 1) / 25.0 * 100"
windowed(
    "w27_aroon", O.aroon, {"aroon_up": full(26, UP), "aroon_down": full(26, DOWN), "aroon_osc": full(26, f"{UP} - {DOWN}")},
    ctes=f"l AS (SELECT *, list(high) {over(26)} AS lh, list(low) {over(26)} AS ll FROM bar)", src="l",
)
windowed(
    "w28_chande", O.chande,
    {"chande": full(15, f"CASE WHEN sum(up) {over(14)} + sum(dn) {over(14)} = 0 THEN 0 ELSE (sum(up) {over(14)} - sum(dn) {over(14)}) / (sum(up) {over(14)} + sum(dn) {over(14)}) * 100 END")},
    ctes=UD, src="ud",
)
FV = "greatest(-0.999, least(0.999, 2 * ((close - ll) / (hh - ll) - 0.5)))"
windowed(
    "w29_fisher", O.fisher, {"fisher": full(10, f"CASE WHEN hh = ll THEN 0 ELSE 0.5 * ln((1 + {FV}) / (1 - {FV})) END")},
    ctes=f"f AS (SELECT *, max((high + low) / 2) {over(10)} AS hh, min((high + low) / 2) {over(10)} AS ll FROM bar)", src="f",
)
