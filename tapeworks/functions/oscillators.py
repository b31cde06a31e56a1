"""Momentum oscillators over a candle series (open, high, low, close, volume)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.functions import averages as A
from tapeworks.functions.bar import B
from tapeworks.plans.recur import Calc, ema, wilder
from tapeworks.plans.series import IDX, Series


def _drop(s: Series, *cols: str) -> Series:
    return s._with(s.rows.drop(*cols))


def up_down(s: Series) -> Series:
    """``_up`` / ``_dn``: positive and negative part of the close change."""
    s = s.bounded(1, {"_ch": lambda w: B.c - w.lag("close")})
    return s.mutate(_up=F.when(F.col("_ch") > 0, F.col("_ch")).otherwise(0.0), _dn=F.when(F.col("_ch") < 0, -F.col("_ch")).otherwise(0.0))


def _strength(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss))


def rsi(s: Series, n: int = 14, out: str = "rsi") -> Series:
    """Plain-mean form."""
    s = up_down(s).bounded(n - 1, {out: lambda w: w.full(n + 1, _strength(F.avg("_up").over(w(n)), F.avg("_dn").over(w(n))))})
    return _drop(s, "_ch", "_up", "_dn")


def rsi_wilder(s: Series, n: int = 14, out: str = "rsi_wilder") -> Series:
    s = up_down(s).scan(wilder("_g", "_up", n, 1), wilder("_l", "_dn", n, 1))
    return _drop(s.mutate(**{out: F.when(F.col(IDX) > n, _strength(F.col("_g"), F.col("_l")))}), "_ch", "_up", "_dn", "_g", "_l")


def streak(s: Series, out: str = "streak") -> Series:
    """Signed run length of rising / falling closes (0 on no change)."""
    s = s.bounded(1, {"_sg": lambda w: F.signum(B.c - w.lag("close"))})
    s = s.bounded(1, {"_turn": lambda w: F.when(~F.col("_sg").eqNullSafe(w.lag("_sg")), F.col(IDX))})
    s = s.running(_from=("last", "_turn"))
    return _drop(s.mutate(**{out: F.col("_sg") * (F.col(IDX) - F.col("_from") + 1)}), "_sg", "_turn", "_from")


def connors_rsi(s: Series, rsi_n: int = 3, rank_n: int = 100, out: str = "crsi") -> Series:
    s = streak(rsi(s, rsi_n, "_r3"), "_st")
    s = s.bounded(1, {"_pc": lambda w: (B.c / w.lag("close") - 1) * 100})
    s = s.mutate(_st=F.abs("_st"))

    def ranks(v):
        st, pc = v["_st"], v["_pc"]
        return ((st <= st[:, -1:]).sum(axis=1) / rank_n * 100.0, (pc <= pc[:, -1:]).sum(axis=1) / rank_n * 100.0)

    s = s.rolling(rank_n, ["_st", "_pc"], ["_ks", "_kp"], ranks)
    s = s.mutate(**{out: F.when(F.col(IDX) > rank_n, (F.col("_r3") + F.col("_ks") + F.col("_kp")) / 3)})
    return _drop(s, "_r3", "_st", "_pc", "_ks", "_kp")


def macd_steps(fast: int = 12, slow: int = 26, signal: int = 9) -> list:
    return [
        ema("_f", "close", fast), ema("_s", "close", slow), Calc("macd", lambda c: c["_f"] - c["_s"]),
        ema("macd_signal", "macd", signal, skip=slow - 1),
    ]


def macd(s: Series, fast: int = 12, slow: int = 26, signal: int = 9) -> Series:
    s = s.scan(*macd_steps(fast, slow, signal))
    return _drop(s.mutate(macd_hist=F.col("macd") - F.col("macd_signal")), "_f", "_s")


def vw_macd(s: Series, fast: int = 12, slow: int = 26, signal: int = 9) -> Series:
    s = A.vwma(A.vwma(s, "close", "volume", fast, "_f"), "close", "volume", slow, "_s")
    s = s.mutate(vw_macd=F.col("_f") - F.col("_s"))
    s = s.bounded(signal - 1, {"vw_signal": lambda w: w.full(slow + signal - 1, F.avg("vw_macd").over(w(signal)))})
    return _drop(s.mutate(vw_hist=F.col("vw_macd") - F.col("vw_signal")), "_f", "_s")


def _place(w, n: int, x: Column | None = None, hi: str = "high", lo: str = "low"):
    """Position of x in the n-row range, and whether the range is empty."""
    hh, ll = F.max(hi).over(w(n)), F.min(lo).over(w(n))
    return hh, ll, ((B.c if x is None else x) - ll) / (hh - ll)


def stochastic(s: Series, k: int = 14, d: int = 3) -> Series:
    def kk(w):
        hh, ll, p = _place(w, k)
        return w.full(k, F.when(hh == ll, 50.0).otherwise(p * 100))

    return s.bounded(k + d - 2, {"stoch_k": kk}, {"stoch_d": lambda w: w.full(k + d - 1, F.avg("stoch_k").over(w(d)))})


def cci(s: Series, n: int = 20) -> Series:
    s = s.mutate(_tp=B.typical)
    s = s.bounded(n - 1, {"_m": lambda w: F.avg("_tp").over(w(n)), "_all": lambda w: F.collect_list("_tp").over(w(n))})
    mad = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
    s = s.mutate(_mad=mad)
    val = F.when(F.col("_mad") == 0, 0.0).otherwise((F.col("_tp") - F.col("_m")) / (0.015 * F.col("_mad")))
    return _drop(s.mutate(cci=F.when(F.col(IDX) >= n, val)), "_tp", "_m", "_all", "_mad")


def williams_r(s: Series, n: int = 14) -> Series:
    def f(w):
        hh, ll, _ = _place(w, n)
        return w.full(n, F.when(hh == ll, -50.0).otherwise((hh - B.c) / (hh - ll) * -100.0))

    return s.bounded(n - 1, {"williams_r": f})


def roc(s: Series, n: int = 12) -> Series:
    return s.bounded(n, {"roc": lambda w: F.when(w.lag("close", n) == 0, 0.0).otherwise((B.c - w.lag("close", n)) / w.lag("close", n) * 100)})


def momentum(s: Series, n: int = 10) -> Series:
    return s.bounded(n, {"momentum": lambda w: B.c - w.lag("close", n)})


def trix(s: Series, n: int = 15) -> Series:
    s = s.scan(ema("_e1", "close", n), ema("_e2", "_e1", n, n - 1), ema("_e3", "_e2", n, 2 * (n - 1)))
    s = s.bounded(1, {"trix": lambda w: F.when(w.lag("_e3") != 0, (F.col("_e3") / w.lag("_e3") - 1) * 10000)})
    return _drop(s, "_e1", "_e2", "_e3")


def ultimate(s: Series, a: int = 7, b: int = 14, c: int = 28) -> Series:
    pc = lambda w: w.lag("close")
    s = s.bounded(
        1,
        {
            "_bp": lambda w: F.coalesce(B.c - F.least(B.l, pc(w)), F.lit(0.0)) * F.when(F.col(IDX) == 1, 0.0).otherwise(1.0),
            "_tr": lambda w: F.when(F.col(IDX) == 1, 0.0).otherwise(F.greatest(B.h - B.l, F.abs(B.h - pc(w)), F.abs(B.l - pc(w)))),
        },
    )

    def f(w):
        part = lambda n: w.total("_bp", n) / w.total("_tr", n)
        empty = (w.total("_tr", a) == 0) | (w.total("_tr", b) == 0) | (w.total("_tr", c) == 0)
        return w.full(c + 1, F.when(empty, 50.0).otherwise((4 * part(a) + 2 * part(b) + part(c)) / 7 * 100))

    return _drop(s.bounded(c - 1, {"ultimate": f}), "_bp", "_tr")


def mfi(s: Series, n: int = 14) -> Series:
    s = s.mutate(_tp=B.typical)
    flow = lambda up: (lambda w: F.when((F.col("_tp") > w.lag("_tp")) if up else (F.col("_tp") < w.lag("_tp")), F.col("_tp") * B.v).otherwise(0.0))
    s = s.bounded(1, {"_pf": flow(True), "_nf": flow(False)})
    s = s.bounded(n - 1, {"mfi": lambda w: w.full(n + 1, _strength(w.total("_pf", n), w.total("_nf", n)))})
    return _drop(s, "_tp", "_pf", "_nf")


def directional(s: Series) -> Series:
    """True range and directional movement columns ``_tr``, ``_pd``, ``_md``."""
    up = lambda w: B.h - w.lag("high")
    dn = lambda w: w.lag("low") - B.l
    return s.bounded(
        1,
        {
            "_tr": lambda w: F.when(F.col(IDX) > 1, F.greatest(B.h - B.l, F.abs(B.h - w.lag("close")), F.abs(B.l - w.lag("close")))),
            "_pd": lambda w: F.when((up(w) > dn(w)) & (up(w) > 0), up(w)).otherwise(0.0),
            "_md": lambda w: F.when((dn(w) > up(w)) & (dn(w) > 0), dn(w)).otherwise(0.0),
        },
    )


def adx_steps(n: int = 14) -> list:
    def share(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return lambda c: np.where(c["_a"] > 0, c[x] / np.where(c["_a"] > 0, c["_a"], 1) * 100, 0.0)

    def dx(c):
        tot = c["plus_di"] + c["minus_di"]
        return np.where(tot > 0, np.abs(c["plus_di"] - c["minus_di"]) / np.where(tot > 0, tot, 1) * 100, 0.0)

    return [
        wilder("_a", "_tr", n, 1), wilder("_p", "_pd", n, 1), wilder("_m", "_md", n, 1),
        Calc("plus_di", share("_p")), Calc("minus_di", share("_m")), Calc("_dx", dx), wilder("adx", "_dx", n, n),
    ]


def adx(s: Series, n: int = 14) -> Series:
    s = directional(s).scan(*adx_steps(n))
    ok = F.col(IDX) > n
    s = s.mutate(plus_di=F.when(ok, F.col("plus_di")), minus_di=F.when(ok, F.col("minus_di")))
    return _drop(s, "_tr", "_pd", "_md", "_a", "_p", "_m", "_dx")


def aroon(s: Series, n: int = 25) -> Series:
    i = F.col(IDX)
    top = lambda w: F.max(F.struct(B.h, -i)).over(w(n + 1)).getField("col2")
    bot = lambda w: F.min(F.struct(B.l, i)).over(w(n + 1)).getField(IDX)
    s = s.bounded(
        n,
        {
            "aroon_up": lambda w: w.full(n + 1, (n - (i + top(w))) / n * 100),
            "aroon_down": lambda w: w.full(n + 1, (n - (i - bot(w))) / n * 100),
        },
    )
    return s.mutate(aroon_osc=F.col("aroon_up") - F.col("aroon_down"))


def chande(s: Series, n: int = 14) -> Series:
    def f(w):
        u, d = w.total("_up", n), w.total("_dn", n)
        return w.full(n + 1, F.when(u + d == 0, 0.0).otherwise((u - d) / (u + d) * 100))

    return _drop(up_down(s).bounded(n - 1, {"chande": f}), "_ch", "_up", "_dn")


def fisher(s: Series, n: int = 10) -> Series:
    s = s.mutate(_m=(B.h + B.l) / 2)

    def f(w):
        hh, ll = F.max("_m").over(w(n)), F.min("_m").over(w(n))
        v = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), 2 * ((B.c - ll) / (hh - ll) - 0.5)))
        return w.full(n, F.when(hh == ll, 0.0).otherwise(0.5 * F.log((1 + v) / (1 - v))))

    return _drop(s.bounded(n - 1, {"fisher": f}), "_m")
