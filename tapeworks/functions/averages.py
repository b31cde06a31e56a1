"""Moving averages.  Each adds columns to a series; warm-up rows are null."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tapeworks.plans.recur import Affine, AffinePair, ema as ema_step
from tapeworks.plans.series import IDX, Series


def sma(s: Series, col: str, n: int, out: str = "sma") -> Series:
    return s.bounded(n - 1, {out: lambda w: w.mean(col, n)})


def ema(s: Series, col: str, n: int, out: str = "ema") -> Series:
    return s.scan(ema_step(out, col, n))


def weighted(s: Series, col: str, weights: list[float], out: str, valid_from: int | None = None) -> Series:
    """Fixed-weight average of the last ``len(weights)`` rows, oldest first."""
    n, total = len(weights), sum(weights)
    first = valid_from or n

    def make(w):
        # lags of one window spec: a flat sum stays in generated code, no arrays are built
        terms = [F.col(col) if j == n - 1 else w.lag(col, n - 1 - j) for j in range(n)]
        acc = terms[0] * (weights[0] / total)
        for x, k in zip(terms[1:], weights[1:]):
            acc = acc + x * (k / total)
        return F.when(F.col(IDX) >= first, acc)

    return s.bounded(n - 1, {out: make})


def wma(s: Series, col: str, n: int, out: str = "wma", valid_from: int | None = None) -> Series:
    """Linear weights 1..n."""
    return weighted(s, col, [float(j) for j in range(1, n + 1)], out, valid_from)


def hma(s: Series, col: str, n: int, out: str = "hma") -> Series:
    half, root = n // 2, int(math.sqrt(n))
    s = wma(wma(s, col, half, "_h"), col, n, "_f")
    s = s.mutate(_d=2 * F.col("_h") - F.col("_f"))
    s = wma(s, "_d", root, out, valid_from=n + root - 1)
    return s._with(s.rows.drop("_h", "_f", "_d"))


def _emas(col: str, n: int, depth: int):
    steps = [ema_step("_e1", col, n)]
    for d in range(2, depth + 1):
        steps.append(ema_step(f"_e{d}", f"_e{d - 1}", n, skip=(d - 1) * (n - 1)))
    return steps


def _drop(s: Series, *cols: str) -> Series:
    return s._with(s.rows.drop(*cols))


def dema(s: Series, col: str, n: int, out: str = "dema") -> Series:
    s = s.scan(*_emas(col, n, 2)).mutate(**{out: 2 * F.col("_e1") - F.col("_e2")})
    return _drop(s, "_e1", "_e2")


def tema(s: Series, col: str, n: int, out: str = "tema") -> Series:
    s = s.scan(*_emas(col, n, 3)).mutate(**{out: 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")})
    return _drop(s, "_e1", "_e2", "_e3")


def vwma(s: Series, col: str, vol: str, n: int, out: str = "vwma") -> Series:
    pv = F.col(col) * F.col(vol)
    return s.bounded(n - 1, {out: lambda w: w.full(n, F.when(w.total(vol, n) > 0, w.total(pv, n) / w.total(vol, n)))})


def kama(s: Series, col: str, n: int = 10, fast: float = 2 / 3, slow: float = 2 / 31, out: str = "kama") -> Series:
    s = s.bounded(
        n + 1,
        {"_step": lambda w: F.abs(F.col(col) - w.lag(col)), "_far": lambda w: F.abs(F.col(col) - w.lag(col, n))},
        {"_path": lambda w: w.total("_step", n)},
    )
    er = F.when(F.col("_path") > 0, F.col("_far") / F.col("_path")).otherwise(0.0)
    s = s.mutate(_sc=F.pow(er * (fast - slow) + slow, 2))

    def coef(c, i):
        # row n+1 starts the average at its own price, later rows move towards the price
        sc = c["_sc"]
        seed = i <= n + 1
        return np.where(seed, 0.0, 1.0 - sc), np.where(seed, c[col], sc * c[col])

    return _drop(s.scan(Affine(out, coef, warm=n)), "_step", "_far", "_path", "_sc")


def alma(s: Series, col: str, n: int = 9, offset: float = 0.85, sigma: float = 6.0, out: str = "alma") -> Series:
    m, sd = offset * (n - 1), n / sigma
    return weighted(s, col, [math.exp(-((j - m) ** 2) / (2 * sd * sd)) for j in range(n)], out)


def frama(s: Series, col: str, n: int = 20, out: str = "frama") -> Series:
    half = n // 2
    rng = lambda w, a, b: F.max(col).over(w.span(a, b)) - F.min(col).over(w.span(a, b))
    s = s.bounded(
        n,
        {
            "_r1": lambda w: rng(w, -n, -half - 1),
            "_r2": lambda w: rng(w, -half, -1),
            "_r": lambda w: rng(w, -n, -1),
            "_seed": lambda w: F.avg(col).over(w.span(-n, -1)),
        },
    )
    slope = lambda r, width: F.when(F.col(r) > 0, F.lit(width) / F.col(r)).otherwise(1e10)
    dim = (F.log(slope("_r1", n / 2) + slope("_r2", n / 2)) - F.log(slope("_r", float(n)))) / math.log(2)
    s = s.mutate(_al=F.greatest(F.least(F.exp(-4.6 * (dim - 1)), F.lit(1.0)), F.lit(0.01)))

    def coef(c, i):
        al = c["_al"]
        return np.where(i <= n + 1, 0.0, 1 - al), np.where(i <= n, 0.0, np.where(i == n + 1, c["_seed"], al * c[col]))

    return _drop(s.scan(Affine(out, coef, warm=n)), "_r1", "_r2", "_r", "_seed", "_al")


def zlema(s: Series, col: str, n: int, out: str = "zlema") -> Series:
    back = (n - 1) // 2
    s = s.bounded(back, {"_z": lambda w: F.coalesce(2 * F.col(col) - w.lag(col, back), F.col(col))})
    return _drop(s.scan(ema_step(out, "_z", n)), "_z")


def super_smoother(s: Series, col: str, n: int = 10, out: str = "smooth") -> Series:
    """Two-pole low-pass filter; the first two values are the inputs."""
    a = math.exp(-1.414 * math.pi / n)
    c2, c3 = 2 * a * math.cos(1.414 * math.pi / n), -a * a
    c1 = 1 - c2 - c3
    s = s.bounded(1, {"_p": lambda w: w.lag(col)})

    def coef(c, i):
        seed = i <= 2
        x = c[col]
        u = np.where(seed, x, c1 * (x + c["_p"]) / 2)
        zero = np.zeros(len(i))
        # (y, y_prev) -> (c2*y + c3*y_prev + u, y)
        return (np.where(seed, 0.0, c2), np.where(seed, 0.0, c3), np.where(i == 1, 0.0, 1.0), zero, u, zero)

    return _drop(s.scan(AffinePair(out, coef)), "_p")


def ribbon(s: Series, col: str, base: int = 10, count: int = 8, step: int = 5) -> Series:
    return s.scan(*[ema_step(f"ema_{base + j * step}", col, base + j * step) for j in range(count)])
