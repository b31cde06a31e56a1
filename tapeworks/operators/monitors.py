"""Breakers, detectors and gauges: batch forms of the keyed streaming state."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.fold import Machine, ordered_fold
from tapeworks.plans.recur import Affine
from tapeworks.plans.series import IDX, Series


class Breaker(Machine):
    """Closed -> open on a trip -> half-open after the cooldown -> closed when
    the next observation is calm, open again when it is not."""

    FIELDS = "state string, since bigint"

    def __init__(self, cooldown: int):
        self.cooldown, self.state, self.since = cooldown, "closed", None

    def row(self, t, trip):
        if self.state == "open" and t - self.since >= self.cooldown:
            self.state = "half_open"
        if trip and self.state != "open":
            self.state, self.since = "open", t
            yield t, "open"
        elif self.state == "half_open":
            self.state = "closed"
            yield t, "closed"


def circuit_breaker(df: DataFrame, keys: list[str], t: str, trip: str, cooldown: int) -> DataFrame:
    return ordered_fold(df, keys, [t], [t, trip], lambda: Breaker(cooldown), "t bigint, state string")


class DriftDetector(Machine):
    """Error-rate drift: warning / drift when rate + deviation exceeds its
    minimum by 2 / 3 deviations; drift resets the statistics."""

    def __init__(self, warm: int):
        self.warm = warm
        self._reset()

    def _reset(self):
        self.n, self.p, self.pmin, self.smin = 0, 0.0, math.inf, math.inf

    def row(self, k, err):
        self.n += 1
        self.p += (err - self.p) / self.n
        s = math.sqrt(self.p * (1 - self.p) / self.n)
        if self.n < self.warm:
            return
        if self.p + s <= self.pmin + self.smin:
            self.pmin, self.smin = self.p, s
        if self.p + s > self.pmin + 3 * self.smin:
            yield k, "drift"
            self._reset()
        elif self.p + s > self.pmin + 2 * self.smin:
            yield k, "warning"


class EarlyDetector(Machine):
    """Distance between errors: drift when mean + 2 deviations of the distance
    falls below 0.9 of its maximum (warning below 0.95)."""

    def __init__(self, errors: int):
        self.need = errors
        self._reset()

    def _reset(self):
        self.k, self.last, self.n, self.m, self.v, self.top = 0, None, 0, 0.0, 0.0, 0.0

    def row(self, k, err):
        self.k += 1
        if not err:
            return
        if self.last is not None:
            d = self.k - self.last
            self.n += 1
            old = self.m
            self.m += (d - self.m) / self.n
            self.v += (d - old) * (d - self.m)
            x = self.m + 2 * math.sqrt(self.v / self.n)
            self.top = max(self.top, x)
            if self.n >= self.need and self.top > 0:
                r = x / self.top
                if r < 0.9:
                    yield k, "drift"
                    self._reset()
                    return
                if r < 0.95:
                    yield k, "warning"
        self.last = self.k


class AdaptiveWindow(Machine):
    """Window over exponential buckets; it is cut where two halves differ by
    more than the Hoeffding bound."""

    def __init__(self, delta: float, every: int):
        self.delta, self.every, self.i, self.b = delta, every, 0, []

    def row(self, k, x):
        self.i += 1
        self.b.append((1, float(x)))
        size = 1
        while True:                                     # merge: at most 5 buckets per size
            at = [j for j, (n, _) in enumerate(self.b) if n == size]
            if len(at) <= 5:
                break
            a, c = at[0], at[1]
            self.b[a] = (2 * size, self.b[a][1] + self.b[c][1])
            del self.b[c]
            size *= 2
        if self.i % self.every:
            return
        cut = True
        while cut and len(self.b) > 1:
            cut, n0, s0 = False, 0, 0.0
            n, s = sum(q for q, _ in self.b), sum(v for _, v in self.b)
            for q, v in self.b[:-1]:
                n0, s0 = n0 + q, s0 + v
                n1, s1 = n - n0, s - s0
                m = 1 / (1 / n0 + 1 / n1)
                if abs(s0 / n0 - s1 / n1) > math.sqrt(math.log(4 * n / self.delta) / (2 * m)):
                    yield k, "drift"
                    self.b, cut = self.b[1:], True
                    break


def detectors(df: DataFrame, keys: list[str], order: list[str], idx: str, err: str, warm: int = 30) -> DataFrame:
    """All three detectors over an error stream, one row per event."""
    out = f"{idx} bigint, event string"
    run = lambda name, make: ordered_fold(df, keys, order, [idx, err], make, out).withColumn("detector", F.lit(name))
    return run("ddm", lambda: DriftDetector(warm)).unionByName(run("eddm", lambda: EarlyDetector(warm))).unionByName(run("adwin", lambda: AdaptiveWindow(0.002, 32)))


def trip_reasons(s: Series, move: float = 0.05, volume: float = 5.0, spread_pct: float = 2.0, ratio: float = 2.0, short: float = 0.1, long: float = 0.02, least: int = 10, window: int = 20) -> Series:
    """Adds ``reason``, the first rule a row breaks, else null: price (change of
    more than ``move``), volume (over ``volume`` times its mean of ``window``
    rows), spread (``ask`` - ``bid`` over ``spread_pct`` percent of the mid),
    volatility (fast over slow average of squared log returns beyond ``ratio``,
    once ``least`` prices are seen).  Both averages start with the first return.
    """
    c = F.col
    s = s.bounded(window - 1, {"_r": lambda w: F.log(c("close") / w.lag("close")), "_m": lambda w: F.abs(c("close") / w.lag("close") - 1), "_v": lambda w: F.avg("volume").over(w(window))})

    def average(a):
        return lambda v, i: (np.where(i <= 2, 0.0, 1 - a), np.where(i == 1, 0.0, np.where(i == 2, 1.0, a) * np.nan_to_num(v["_r"]) ** 2))

    s = s.scan(Affine("_fast", average(short)), Affine("_slow", average(long)))
    mid = (c("bid") + c("ask")) / 2
    reason = (
        F.when(c("_m") > move, "price").when(c("volume") > volume * c("_v"), "volume").when((mid > 0) & ((c("ask") - c("bid")) / mid * 100 > spread_pct), "spread")
        .when((c(IDX) >= least) & (c("_slow") > 0) & (c("_fast") / c("_slow") > ratio), "volatility")
    )
    return s._with(s.mutate(reason=reason).rows.drop("_r", "_m", "_v", "_fast", "_slow"))


def ewma_volatility(s: Series, ret: str, decay: float = 0.94) -> Series:
    """Exponential variance seeded with the first squared return."""
    s = s.scan(Affine("_v", lambda c, i: (np.where(i == 1, 0.0, decay), np.where(i == 1, c[ret] ** 2, (1 - decay) * c[ret] ** 2))))
    return s._with(s.mutate(ewma_vol=F.sqrt("_v")).rows.drop("_v"))


def auto_disable(s: Series, pnl: str, n: int = 20, limit: float = 0.0) -> Series:
    def sharpe(w):
        sd = F.stddev_pop(pnl).over(w(n))
        return w.full(n, F.when(sd > 0, F.avg(pnl).over(w(n)) / sd * math.sqrt(252)).otherwise(0.0))

    s = s.bounded(n - 1, {"sharpe_n": sharpe})
    return s.mutate(disabled=F.coalesce(F.col("sharpe_n") < limit, F.lit(False)))
