"""Moving averages over weekly candles of every symbol."""

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, out
from tapeworks.catalog.sql import BARS, R, full, over
from tapeworks.functions import averages as A

K = ["symbol", "t"]


def ema_sql(src: str, col: str, n: int, skip: int = 0, k: float | None = None, name: str = "e") -> str:
    """Closed form of the seeded exponential average as a weighted self-join:
    seed * (1-k)^(j-n) + sum k (1-k)^(j-m) x_m, j counted after ``skip`` rows."""
    k = 2.0 / (n + 1) if k is None else k
    j, m = f"(a.i - {skip})", f"(x.i - {skip})"
    return f"""{name} AS (
  SELECT a.symbol, a.t, a.i,
    sum(CASE WHEN {m} <= {n} THEN x.{col} / {n} * pow({1 - k!r}, {j} - {n}) ELSE {k!r} * pow({1 - k!r}, {j} - {m}) * x.{col} END) AS y
  FROM {src} a JOIN {src} x ON a.symbol = x.symbol AND x.i <= a.i AND x.i > {skip}
  WHERE {j} >= {n} GROUP BY 1, 2, 3)"""


def lefted(cte: str, cols: str) -> str:
    return f"SELECT bar.symbol, bar.t, {cols} FROM bar LEFT JOIN {cte} USING (symbol, t)"


@query("w01_sma", f"WITH {BARS} SELECT symbol, t, {R(full(20, 'avg(close) ' + over(20)))} AS sma FROM bar")
def w01(spark, sf):
    return out(A.sma(bar_series(spark, sf), "close", 20).df, K, sma="sma")


@query("w02_ema", f"WITH {BARS}, {ema_sql('bar', 'close', 20)} {lefted('e', R('y') + ' AS ema')}")
def w02(spark, sf):
    return out(A.ema(bar_series(spark, sf), "close", 20).df, K, ema="ema")


def wma_sql(col: str, n: int) -> str:
    parts = " + ".join(f"lag({col}, {n - j}) OVER (PARTITION BY symbol ORDER BY t) * {j}.0" if j < n else f"{col} * {n}.0" for j in range(1, n + 1))
    return f"({parts}) / {n * (n + 1) / 2}"


@query("w03_wma", f"WITH {BARS} SELECT symbol, t, {R(wma_sql('close', 10))} AS wma FROM bar")
def w03(spark, sf):
    return out(A.wma(bar_series(spark, sf), "close", 10).df, K, wma="wma")


@query(
    "w04_hma",
    f"WITH {BARS}, d AS (SELECT symbol, t, 2 * {wma_sql('close', 8)} - {wma_sql('close', 16)} AS d FROM bar) "
    f"SELECT symbol, t, {R(wma_sql('d', 4))} AS hma FROM d",
)
def w04(spark, sf):
    return out(A.hma(bar_series(spark, sf), "close", 16).df, K, hma="hma")


E2 = f"{ema_sql('bar', 'close', 12, name='e1')}, {ema_sql('e1', 'y', 12, 11, name='e2')}"


@query("w05_dema", f"WITH {BARS}, {E2} SELECT bar.symbol, bar.t, {R('2 * e1.y - e2.y')} AS dema FROM bar LEFT JOIN e1 USING (symbol, t) LEFT JOIN e2 USING (symbol, t)")
def w05(spark, sf):
    return out(A.dema(bar_series(spark, sf), "close", 12).df, K, dema="dema")


@query(
    "w06_tema",
    f"WITH {BARS}, {E2}, {ema_sql('e2', 'y', 12, 22, name='e3')} SELECT bar.symbol, bar.t, {R('3 * e1.y - 3 * e2.y + e3.y')} AS tema "
    "FROM bar LEFT JOIN e1 USING (symbol, t) LEFT JOIN e2 USING (symbol, t) LEFT JOIN e3 USING (symbol, t)",
)
def w06(spark, sf):
    return out(A.tema(bar_series(spark, sf), "close", 12).df, K, tema="tema")


@query(
    "w07_vwma",
    f"WITH {BARS} SELECT symbol, t, {R(full(20, f'CASE WHEN sum(volume) {over(20)} > 0 THEN sum(close * volume) {over(20)} / sum(volume) {over(20)} END'))} AS vwma FROM bar",
)
def w07(spark, sf):
    return out(A.vwma(bar_series(spark, sf), "close", "volume", 20).df, K, vwma="vwma")


# step by step over the bar number, all symbols at once
KAMA = f"""WITH RECURSIVE {BARS}, s AS (
  SELECT *, abs(close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY t)) AS far, abs(close - pc) AS step FROM bar),
p AS (SELECT *, sum(step) {over(10)} AS path FROM s),
q AS MATERIALIZED (SELECT symbol, t, i, close, pow(CASE WHEN path > 0 THEN far / path ELSE 0 END * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2) AS sc FROM p),
k AS (SELECT symbol, t, i, close AS y FROM q WHERE i = 11
  UNION ALL SELECT q.symbol, q.t, q.i, k.y + q.sc * (q.close - k.y) FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1)
{lefted('k', R('y') + ' AS kama')}"""


@query("w08_kama", KAMA)
def w08(spark, sf):
    return out(A.kama(bar_series(spark, sf), "close").df, K, kama="kama")


def _alma_sql() -> str:
    import math

    n, m, sd = 9, 0.85 * 8, 9 / 6.0
    ws = [math.exp(-((j - m) ** 2) / (2 * sd * sd)) for j in range(n)]
    tot = sum(ws)
    parts = " + ".join(f"lag(close, {n - 1 - j}) OVER (PARTITION BY symbol ORDER BY t) * {w / tot!r}" for j, w in enumerate(ws))
    return f"WITH {BARS} SELECT symbol, t, {R(parts)} AS alma FROM bar"


@query("w09_alma", _alma_sql())
def w09(spark, sf):
    return out(A.alma(bar_series(spark, sf), "close").df, K, alma="alma")


def _rng(a: int, b: int) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"
    return f"max(close) {f} - min(close) {f}"


FRAMA = f"""WITH RECURSIVE {BARS}, s AS (
  SELECT symbol, t, i, close, {_rng(20, 11)} AS r1, {_rng(10, 1)} AS r2, {_rng(20, 1)} AS r3,
         avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS seed FROM bar),
d AS (SELECT *, (ln(CASE WHEN r1 > 0 THEN 10.0 / r1 ELSE 1e10 END + CASE WHEN r2 > 0 THEN 10.0 / r2 ELSE 1e10 END)
         - ln(CASE WHEN r3 > 0 THEN 20.0 / r3 ELSE 1e10 END)) / ln(2) AS dim FROM s WHERE i > 20),
q AS MATERIALIZED (SELECT *, greatest(least(exp(-4.6 * (dim - 1)), 1.0), 0.01) AS al FROM d),
k AS (SELECT symbol, t, i, seed AS y FROM q WHERE i = 21
  UNION ALL SELECT q.symbol, q.t, q.i, q.al * q.close + (1 - q.al) * k.y FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1)
{lefted('k', R('y') + ' AS frama')}"""


@query("w10_frama", FRAMA)
def w10(spark, sf):
    return out(A.frama(bar_series(spark, sf), "close").df, K, frama="frama")


@query(
    "w11_zlema",
    f"WITH {BARS}, z AS (SELECT symbol, t, i, coalesce(2 * close - lag(close, 9) OVER (PARTITION BY symbol ORDER BY t), close) AS z FROM bar), "
    f"{ema_sql('z', 'z', 20)} {lefted('e', R('y') + ' AS zlema')}",
)
def w11(spark, sf):
    return out(A.zlema(bar_series(spark, sf), "close", 20).df, K, zlema="zlema")


def _smooth_sql() -> str:
    import math

    a = math.exp(-1.414 * math.pi / 10)
    c2, c3 = 2 * a * math.cos(1.414 * math.pi / 10), -a * a
    c1 = 1 - c2 - c3
    return f"""WITH RECURSIVE {BARS}, q AS MATERIALIZED (SELECT symbol, t, i, close, pc FROM bar),
k AS (SELECT symbol, t, i, close AS y, CAST(NULL AS DOUBLE) AS yp FROM q WHERE i = 1
  UNION ALL SELECT q.symbol, q.t, q.i, CASE WHEN q.i = 2 THEN q.close ELSE {c1!r} * (q.close + q.pc) / 2 + {c2!r} * k.y + {c3!r} * k.yp END, k.y
  FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1)
SELECT symbol, t, {R('y')} AS smooth FROM k"""


@query("w12_super_smoother", _smooth_sql())
def w12(spark, sf):
    return out(A.super_smoother(bar_series(spark, sf), "close").df, K, smooth="smooth")


RIB = [10 + 5 * j for j in range(8)]


@query(
    "w13_ribbon",
    f"WITH {BARS}, " + ", ".join(ema_sql("bar", "close", n, name=f"r{n}") for n in RIB)
    + " SELECT bar.symbol, bar.t, " + ", ".join(f"{R(f'r{n}.y')} AS ema_{n}" for n in RIB)
    + " FROM bar " + " ".join(f"LEFT JOIN r{n} USING (symbol, t)" for n in RIB),
)
def w13(spark, sf):
    return out(A.ribbon(bar_series(spark, sf), "close").df, K, **{f"ema_{n}": f"ema_{n}" for n in RIB})
