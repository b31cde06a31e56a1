"""Volatility, channels and volume indicators over a candle series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tapeworks.functions import averages as A
from tapeworks.functions.bar import B
from tapeworks.functions.oscillators import _drop, directional
from tapeworks.plans.recur import Affine, Clamp, ema, wilder
from tapeworks.plans.series import IDX, Series

YEAR = 365.0


def true_range(s: Series, out: str = "tr") -> Series:
    return s.bounded(1, {out: lambda w: F.when(F.col(IDX) > 1, F.greatest(B.h - B.l, F.abs(B.h - w.lag("close")), F.abs(B.l - w.lag("close"))))})


def atr(s: Series, n: int = 14, out: str = "atr") -> Series:
    return _drop(true_range(s, "_tr").bounded(n - 1, {out: lambda w: w.full(n + 1, F.avg("_tr").over(w(n)))}), "_tr")


def atr_wilder(s: Series, n: int = 14, out: str = "atr_wilder") -> Series:
    return _drop(true_range(s, "_tr").scan(wilder(out, "_tr", n, 1)), "_tr")


def atr_percent(s: Series, n: int = 14) -> Series:
    return _drop(atr(s, n, "_a").mutate(atrp=F.when(B.c != 0, F.col("_a") / B.c * 100)), "_a")


def bollinger(s: Series, n: int = 20, k: float = 2.0, col: str = "close") -> Series:
    x = F.col(col)
    s = s.bounded(n - 1, {"bb_mid": lambda w: w.mean(col, n), "_sd": lambda w: w.full(n, F.stddev_pop(col).over(w(n)))})
    m, sd = F.col("bb_mid"), F.col("_sd")
    s = s.mutate(
        bb_upper=m + k * sd, bb_lower=m - k * sd,
        bb_width=F.when(m.isNotNull(), F.when(m > 0, 2 * k * sd / m).otherwise(0.0)),
        bb_pct=F.when(m.isNotNull(), F.when(sd > 0, (x - m + k * sd) / (2 * k * sd)).otherwise(0.5)),
    )
    return _drop(s, "_sd")


def keltner(s: Series, n: int = 20, atr_n: int = 10, k: float = 1.5) -> Series:
    """Uses ``kc_mid`` as the EMA when a caller already scanned it."""
    s = s if "kc_mid" in s.rows.columns else s.scan(ema("kc_mid", "close", n))
    s = atr(s, atr_n, "_a")
    ok = F.col(IDX) >= max(n, atr_n) + 1
    mid = F.when(ok, F.col("kc_mid"))
    return _drop(s.mutate(kc_mid=mid, kc_upper=mid + k * F.col("_a"), kc_lower=mid - k * F.col("_a")), "_a")


def donchian(s: Series, n: int = 20) -> Series:
    s = s.bounded(n - 1, {"dc_upper": lambda w: w.full(n, F.max("high").over(w(n))), "dc_lower": lambda w: w.full(n, F.min("low").over(w(n)))})
    return s.mutate(dc_mid=(F.col("dc_upper") + F.col("dc_lower")) / 2)


def rolling_std(s: Series, n: int = 20) -> Series:
    return s.bounded(n - 1, {"std": lambda w: w.full(n, F.stddev_pop("close").over(w(n)))})


def hist_vol(s: Series, n: int = 20) -> Series:
    s = s.bounded(n, {"_lr": lambda w: F.log(B.c / w.lag("close"))}, {"hist_vol": lambda w: w.full(n + 1, F.stddev_samp("_lr").over(w(n)) * math.sqrt(YEAR) * 100)})
    return _drop(s, "_lr")


def parkinson(s: Series, n: int = 20) -> Series:
    ok = (B.l > 0) & (B.h > 0)
    s = s.mutate(_x=F.when(ok, F.pow(F.log(B.h / B.l), 2)))

    def f(w):
        cnt = F.count("_x").over(w(n))
        return w.full(n, F.when(cnt >= n // 2, F.sqrt(w.total("_x", n) / (4 * cnt * math.log(2))) * math.sqrt(YEAR) * 100))

    return _drop(s.bounded(n - 1, {"parkinson": f}), "_x")


def garman_klass(s: Series, n: int = 20) -> Series:
    ok = (B.l > 0) & (B.h > 0) & (B.o > 0) & (B.c > 0)
    s = s.mutate(_x=F.when(ok, 0.5 * F.pow(F.log(B.h / B.l), 2) - (2 * math.log(2) - 1) * F.pow(F.log(B.c / B.o), 2)))

    def f(w):
        cnt = F.count("_x").over(w(n))
        return w.full(n, F.when(cnt >= n // 2, F.sqrt(F.greatest(w.total("_x", n) / cnt, F.lit(0.0))) * math.sqrt(YEAR) * 100))

    return _drop(s.bounded(n - 1, {"garman_klass": f}), "_x")


def chaikin_weights(n: int, m: int) -> tuple[list[float], list[float]]:
    """Fixed weights (oldest first) of the last and of the m-th last value of an
    EMA that restarts inside every window of n + m rows."""
    k, size = 2 / (n + 1), n + m

    def at(step: int) -> list[float]:          # EMA value after ``step`` rows beyond the seed
        w = [(1 - k) ** step / n] * n + [k * (1 - k) ** (step - j) for j in range(1, step + 1)]
        return w + [0.0] * (size - len(w))

    return at(m), at(m - (m - 1))


def chaikin_vol(s: Series, n: int = 10, m: int = 10) -> Series:
    s = s.mutate(_hl=B.h - B.l)
    last, base = chaikin_weights(n, m)
    dot = lambda w, ws: sum(((F.col("_hl") if j == 0 else w.lag("_hl", j)) * ws[-1 - j] for j in range(1, n + m)), F.col("_hl") * ws[-1])
    s = s.bounded(n + m - 1, {"_a": lambda w: dot(w, last), "_b": lambda w: dot(w, base)})
    val = F.when(F.col("_b") == 0, 0.0).otherwise((F.col("_a") - F.col("_b")) / F.col("_b") * 100)
    return _drop(s.mutate(chaikin_vol=F.when(F.col(IDX) >= n + m, val)), "_hl", "_a", "_b")


# --- volume -----------------------------------------------------------------------
def _close_location():
    return F.when(B.h - B.l > 0, ((B.c - B.l) - (B.h - B.c)) / (B.h - B.l)).otherwise(0.0)


def obv(s: Series) -> Series:
    s = s.bounded(1, {"_s": lambda w: F.coalesce(F.signum(B.c - w.lag("close")) * B.v, F.lit(0.0))})
    return _drop(s.running(obv=("sum", "_s")), "_s")


def ad_line(s: Series) -> Series:
    return s.running(ad_line=("sum", _close_location() * B.v))


def cmf(s: Series, n: int = 20) -> Series:
    s = s.mutate(_m=_close_location() * B.v)
    return _drop(s.bounded(n - 1, {"cmf": lambda w: w.full(n, F.when(w.total("volume", n) == 0, 0.0).otherwise(w.total("_m", n) / w.total("volume", n)))}), "_m")


def force_index(s: Series, n: int = 13) -> Series:
    s = s.bounded(1, {"_f": lambda w: F.coalesce((B.c - w.lag("close")) * B.v, F.lit(0.0))})
    return _drop(s.scan(ema("force_index", "_f", n)), "_f")


def ease_of_movement(s: Series, n: int = 14) -> Series:
    mid = (B.h + B.l) / 2
    ratio = (B.v / 1e6) / (B.h - B.l + 1e-10) + 1e-10
    s = s.mutate(_mid=mid).bounded(n, {"_e": lambda w: (F.col("_mid") - w.lag("_mid")) / ratio}, {"emv": lambda w: w.full(n + 1, F.avg("_e").over(w(n)))})
    return _drop(s, "_mid", "_e")


def volume_oscillator(s: Series, fast: int = 5, slow: int = 20) -> Series:
    def f(w):
        a, b = F.avg("volume").over(w(fast)), F.avg("volume").over(w(slow))
        return w.full(slow, F.when(b == 0, 0.0).otherwise((a - b) / b * 100))

    return s.bounded(slow - 1, {"volume_osc": f})


def volume_index(s: Series, falling: bool, out: str) -> Series:
    """Negative (``falling``) or positive volume index from 1000."""
    hit = lambda w: (B.v < w.lag("volume")) if falling else (B.v > w.lag("volume"))
    s = s.bounded(1, {"_g": lambda w: F.when(hit(w) & (w.lag("close") != 0), B.c / w.lag("close")).otherwise(1.0)})
    return _drop(s.scan(Affine(out, lambda c, i: (np.where(i == 1, 0.0, c["_g"]), np.where(i == 1, 1000.0, 0.0)))), "_g")


def ichimoku(s: Series, a: int = 9, b: int = 26, c: int = 52) -> Series:
    mid = lambda n: (lambda w: w.full(c, (F.max("high").over(w(n)) + F.min("low").over(w(n))) / 2))
    s = s.bounded(c - 1, {"tenkan": mid(a), "kijun": mid(b), "senkou_b": mid(c)})
    return s.mutate(senkou_a=(F.col("tenkan") + F.col("kijun")) / 2, chikou=F.when(F.col(IDX) >= c, B.c))


def squeeze(s: Series, n: int = 20, atr_n: int = 10) -> Series:
    s = keltner(bollinger(s, n), n, atr_n)
    active = F.coalesce((F.col("bb_lower") >= F.col("kc_lower")) & (F.col("bb_upper") <= F.col("kc_upper")), F.lit(False))
    return s.mutate(squeeze=active, squeeze_momentum=F.when(F.col("kc_mid").isNotNull(), B.c - F.col("bb_mid")))


def vwap(s: Series) -> Series:
    s = s.running(_pv=("sum", B.typical * B.v), _v=("sum", "volume"))
    return _drop(s.mutate(vwap=F.when(F.col("_v") > 0, F.col("_pv") / F.col("_v"))), "_pv", "_v")


def vwap_bands(bars, keys: list[str], k: float = 2.0):
    """One row per series: variance around the final VWAP from plain sums,
    centred on a first-pass mean so large prices do not cancel."""
    tp = B.typical
    mean = bars.groupBy(*keys).agg((F.sum(tp * B.v) / F.sum("volume")).alias("vwap"), F.count(F.lit(1)).alias("_n"))
    dev = F.pow(tp - F.col("vwap"), 2) * B.v
    got = (
        bars.join(mean, keys).groupBy(*keys)
        .agg(F.first("vwap").alias("vwap"), F.sqrt(F.sum(dev) / F.sum("volume")).alias("std_dev"), F.first("_n").alias("_n"))
        .where("_n >= 2").drop("_n")
    )
    return got.withColumns({"upper": F.col("vwap") + k * F.col("std_dev"), "lower": F.col("vwap") - k * F.col("std_dev")})


def dominant_cycle(s: Series, lo: int = 8, hi: int = 48) -> Series:
    """Lag of the best self-correlation inside the last ``2*hi`` closes (first
    best wins): one dot product per lag over window views."""
    n = 2 * hi

    def best(views):
        x = views["close"] - views["close"].mean(axis=1, keepdims=True)
        zero = np.zeros((len(x), 1))
        s1, s2 = np.hstack([zero, np.cumsum(x, axis=1)]), np.hstack([zero, np.cumsum(x * x, axis=1)])
        top, arg = np.full(len(x), -2.0), np.full(len(x), float(lo))
        for p in range(lo, hi + 1):
            m = n - p
            sa, sb = s1[:, m], s1[:, n] - s1[:, p]
            va, vb = s2[:, m] - sa * sa / m, s2[:, n] - s2[:, p] - sb * sb / m
            c = (np.einsum("ij,ij->i", x[:, :m], x[:, p:]) - sa * sb / m) / np.sqrt(va * vb)
            better = (va > 0) & (vb > 0) & (c > top)
            top, arg = np.where(better, c, top), np.where(better, float(p), arg)
        return (arg,)

    return s.rolling(n, ["close"], ["dominant_cycle"], best)


def fractal_dimension(s: Series, n: int = 20) -> Series:
    s = s.bounded(1, {"_d": lambda w: F.abs(B.c - w.lag("close"))})

    def f(w):
        path, rng = w.total("_d", n - 1), F.max("close").over(w(n)) - F.min("close").over(w(n))
        fd = 1 + F.log(path / rng) / math.log(n)
        return w.full(n + 1, F.when((rng == 0) | (path == 0), 1.5).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(2.0), fd))))

    return _drop(s.bounded(n - 1, {"fractal_dim": f}), "_d")


def supertrend(s: Series, n: int = 10, k: float = 3.0) -> Series:
    s = atr_wilder(s, n, "_a").mutate(_ub=(B.h + B.l) / 2 + k * F.col("_a"), _lb=(B.h + B.l) / 2 - k * F.col("_a"))
    event = lambda w: F.when(B.c > w.lag("_ub"), 1.0).when(B.c < w.lag("_lb"), -1.0)
    s = s.bounded(1, {"_ev": event}).running(_dir=("last", "_ev"))
    s = s.mutate(st_dir=F.coalesce(F.col("_dir"), F.lit(1.0)))

    def coef(c, i):
        up = c["st_dir"] > 0
        lo, hi = np.where(up, c["_lb"], -np.inf), np.where(up, np.inf, c["_ub"])
        seed = np.where(up, c["_lb"], c["_ub"])
        head, early = i == n + 1, i <= n
        return np.where(early, 0.0, np.where(head, seed, lo)), np.where(early, 0.0, np.where(head, seed, hi))

    return _drop(s.scan(Clamp("supertrend", coef, warm=n)), "_a", "_ub", "_lb", "_ev", "_dir")
