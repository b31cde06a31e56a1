"""Entry and exit rules as columns over indicator series, and the position fold.

A rule adds ``signal`` (+1 long, -1 short, 0 none), ``strength``, ``exit_long``
and ``exit_short``; the fold turns those columns into trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions import averages as A
from tapeworks.functions import bands, oscillators as O, structure as S
from tapeworks.functions.bar import B
from tapeworks.plans.fold import Machine, ordered_fold
from tapeworks.plans.recur import Affine, ema as ema_step
from tapeworks.plans.series import IDX, Series

import numpy as np

c = lambda name: F.col(name)


def _rule(s: Series, long: Column, short: Column, strength: Column | float, exit_long: Column, exit_short: Column) -> Series:
    no = F.lit(False)
    x = strength if isinstance(strength, Column) else F.lit(strength)
    sig = F.when(F.coalesce(long, no), 1).when(F.coalesce(short, no), -1).otherwise(0)
    s = s.mutate(signal=sig)
    return s.mutate(strength=F.when(c("signal") != 0, x).otherwise(0.0), exit_long=F.coalesce(exit_long, no), exit_short=F.coalesce(exit_short, no))


def ema_cross(s: Series, fast: int = 20, slow: int = 50, adx_min: Column | float = 25.0) -> Series:
    """Fast EMA crosses slow EMA while the trend is strong enough."""
    s = O.adx(s).scan(ema_step("fast", "close", fast), ema_step("slow", "close", slow))
    s = s.mutate(_above=c("fast") > c("slow")).bounded(1, {"_was": lambda w: w.lag("_above")})
    ok = (c(IDX) >= 60) & (c("adx") >= adx_min)
    return _rule(s, ok & c("_above") & ~c("_was"), ok & ~c("_above") & c("_was"), F.least(c("adx") / 50, F.lit(1.0)), c("fast") < c("slow"), c("fast") > c("slow"))


def breakout(s: Series, n: int = 20, volume_mult: float = 1.5, stop: float = 2.0) -> Series:
    """Close beyond the previous n-bar channel on high volume."""
    s = bands.atr(s, 14, "atr").bounded(
        n, {"_hi": lambda w: F.max("high").over(w.span(-n, -1)), "_lo": lambda w: F.min("low").over(w.span(-n, -1)), "_av": lambda w: F.avg("volume").over(w.span(-n + 1, -1))}
    )
    busy = (c(IDX) >= n + 1) & (c("_av") > 0) & (c("volume") > c("_av") * volume_mult)
    far = stop * c("atr")
    s = _rule(s, busy & (B.c > c("_hi")), busy & (B.c < c("_lo")), 0.7, F.lit(False), F.lit(False))
    return s.mutate(stop_distance=far)


def rsi_cross(s: Series, n: int = 14, low: float = 30.0, high: float = 70.0) -> Series:
    s = O.rsi(s, n).bounded(1, {"_p": lambda w: w.lag("rsi")})
    up, dn = (c("_p") < low) & (c("rsi") >= low), (c("_p") > high) & (c("rsi") <= high)
    x = F.when(c("signal") > 0, (low - c("_p")) / low).otherwise((c("_p") - high) / (100 - high))
    return _rule(s, up, dn, x, c("rsi") > high, c("rsi") < low)


def macd_flip(s: Series) -> Series:
    s = O.macd(s).bounded(1, {"_p": lambda w: F.when(c(IDX) > 35, w.lag("macd_hist"))})
    h = c("macd_hist")
    return _rule(s, (c("_p") < 0) & (h > 0), (c("_p") > 0) & (h < 0), F.least(F.abs(h) / B.c * 1000, F.lit(1.0)), h < 0, h > 0)


def supertrend_flip(s: Series, n: int = 10, k: float = 3.0) -> Series:
    s = bands.supertrend(s, n, k).bounded(1, {"_p": lambda w: F.when(c(IDX) > 20, w.lag("st_dir"))})
    d = c("st_dir")
    return _rule(s, (d == 1) & (c("_p") == -1), (d == -1) & (c("_p") == 1), 0.6, d == -1, d == 1)


def mean_reversion(s: Series, z_min: float = 2.0) -> Series:
    s = S.zscore(O.rsi(bands.bollinger(s), 14), 30)
    ok = c(IDX) >= 50
    lo = ok & (c("bb_pct") < 0.05) & (c("rsi") < 35) & (c("zscore") < -z_min)
    hi = ok & (c("bb_pct") > 0.95) & (c("rsi") > 65) & (c("zscore") > z_min)
    return _rule(s, lo, hi, 0.8, B.c >= c("bb_mid"), B.c <= c("bb_mid"))


def volatility_expansion(s: Series, back: int = 20, mult: float = 1.5) -> Series:
    s = bands.atr_percent(s, 14).bounded(back, {"_avg": lambda w: w.full(back + 14, F.avg("atrp").over(w(back))), "_pc": lambda w: w.lag("close")})
    hit = c("atrp") > c("_avg") * mult
    return _rule(s, hit & (B.c > c("_pc")), hit & (B.c <= c("_pc")), F.least(c("atrp") / c("_avg") / 3, F.lit(1.0)), F.lit(False), F.lit(False))


def volume_spread(s: Series, n: int = 100, volume_mult: float = 2.0, spring: float = 0.02) -> Series:
    """Volume-spread flags and accumulation phases over the last n bars."""
    half = n // 2
    s = s.bounded(
        n - 1,
        {
            "_av": lambda w: F.avg("volume").over(w(n)), "_ar": lambda w: F.avg(B.h - B.l).over(w(n)), "_pc": lambda w: w.lag("close"),
            "_sup": lambda w: F.min("low").over(w.span(-(n - 1), -(n - half))), "_res": lambda w: F.max("high").over(w.span(-(n - 1), -(n - half))),
            "_c5": lambda w: w.lag("close", 4), "_v5": lambda w: F.avg("volume").over(w(5)),
        },
    )
    rng, vol = B.h - B.l, c("volume")
    ok = c(IDX) >= n
    big, wide, thin = vol > volume_mult * c("_av"), rng > 1.5 * c("_ar"), vol < 0.5 * c("_av")
    s = s.mutate(
        buying_climax=ok & big & wide & (B.c > c("_pc")), selling_climax=ok & big & wide & (B.c < c("_pc")),
        no_demand=ok & ~big & thin & (B.c < c("_pc")), no_supply=ok & ~big & thin & (B.c >= c("_pc")),
        spring=ok & (B.l < c("_sup") * (1 - spring)) & (B.c > c("_sup")),
        sign_of_strength=ok & (B.c > c("_c5")) & (c("_v5") > 1.5 * c("_av")),
        upthrust=ok & (B.h > c("_res") * (1 + spring)) & (B.c < c("_res")),
    )
    long = c("spring") | c("sign_of_strength") | c("no_supply")
    x = F.when(c("signal") < 0, 0.6).otherwise(F.greatest(F.when(c("spring"), 0.7).otherwise(0.5), F.when(c("no_supply"), 0.6).otherwise(0.0)))
    return _rule(s, long, ~long & c("upthrust"), x, F.lit(False), F.lit(False))


def carry(df: DataFrame, rate: str, threshold: float) -> DataFrame:
    """Collect funding: long where shorts pay, short where longs pay."""
    r = F.col(rate)
    return df.withColumn("signal", F.when(r < -threshold, 1).when(r > threshold, -1).otherwise(0)).withColumn("strength", F.least(F.abs(r) / 0.1, F.lit(1.0)))


def grid_levels(price: Column, atr: Column, levels: int = 5, spacing: float = 0.5) -> Column:
    """Levels around the price, ``spacing`` ATRs apart."""
    steps = F.array(*[F.lit(float(k)) for k in range(-levels, levels + 1) if k])
    return F.transform(steps, lambda k: price + k * spacing * atr)


def quotes(mid: Column, atr_pct: Column, inventory: Column, limit: float, base_bps: float = 10.0, skew: float = 0.5, vol_mult: float = 2.0, min_bps: float = 2.0) -> Column:
    """Bid and ask with a volatility-wide spread and an inventory skew."""
    m = F.when(atr_pct > 5, vol_mult).when(atr_pct > 3, 1 + (atr_pct - 3) / 2 * (vol_mult - 1)).otherwise(1.0)
    spread = mid * base_bps / 10000 * m
    shift = inventory / limit * skew * spread
    half = F.greatest(spread / 2, mid * min_bps / 20000)
    return F.struct((mid - half - shift).alias("bid"), (mid + half - shift).alias("ask"), (shift / mid * 10000).alias("skew_bps"), m.alias("vol_mult"))


def toxic_flow(s: Series, size: str, avg_size: Column, impact: Column, limit: float = 0.7) -> Series:
    """Smoothed score of large, price-moving trades (0.7 old, 0.3 new)."""
    x = (F.least(c(size) / F.greatest(avg_size, F.lit(1e-10)), F.lit(5.0)) / 5 + F.least(F.abs(impact) / 0.01, F.lit(1.0))) / 2
    s = s.mutate(_x=x).scan(Affine("toxic", lambda v, i: (np.where(i == 1, 0.0, 0.7), 0.3 * v["_x"])))
    act = F.when(c("toxic") > limit, "cancel").when(c("toxic") > 0.5, "widen").otherwise("normal")
    return s._with(s.mutate(action=act).rows.drop("_x"))


# --- position folds -----------------------------------------------------------------------
class _Backtest(Machine):
    """One instrument: exit first, then entry when flat."""

    def __init__(self, capital, size, slip, fee, twice):
        self.cap, self.size, self.slip, self.fee, self.twice = capital, size, slip, fee, twice
        self.side, self.qty, self.entry, self.at, self.n = 0, 0.0, 0.0, None, 0
        self.hi = self.lo = 0.0

    def row(self, t, close, high, low, atr, signal, exit_long, exit_short):
        self.n += 1
        if self.side:
            self.hi, self.lo = max(self.hi, high), min(self.lo, low)
            if exit_long if self.side > 0 else exit_short:
                px = close * (1 - self.side * self.slip)
                cost = px * self.qty * self.fee + (abs(px - close) * self.qty if self.twice else self.entry * self.qty * self.fee)
                pnl = (px - self.entry) * self.side * self.qty - cost
                best, worst = (self.hi, self.lo) if self.side > 0 else (self.lo, self.hi)
                self.cap += pnl
                yield (self.at[0], t, self.side, self.entry, px, self.qty, pnl, self.n - self.at[1], (self.entry - worst) * self.side * self.qty, (best - self.entry) * self.side * self.qty, self.cap)
                self.side = 0
        if not self.side and signal:
            stop = 2 * atr if atr is not None else 0.02 * close
            qty = self.cap * self.size / stop if stop > 0 else 0.0
            if qty > 0 and self.cap > 0:
                self.side, self.qty, self.entry, self.at = signal, qty, close * (1 + signal * self.slip), (t, self.n)
                self.hi, self.lo = high, low


TRADE_DDL = "entry_t bigint, exit_t bigint, side int, entry_price double, exit_price double, quantity double, pnl double, holding_bars int, mae double, mfe double, capital double"


def backtest(signals: DataFrame, keys: list[str], t: str, capital: float = 100_000.0, size: float = 0.02, slip_bps: float = 5.0, fee_bps: float = 10.0, compat: bool = False) -> DataFrame:
    """Trades of every (instrument, parameter set, window) in ``keys``.

    ``compat`` charges slippage a second time as a cost and no entry fee (the
    older accounting); by default each side pays its fee once.
    """
    cols = [t, "close", "high", "low", "atr", "signal", "exit_long", "exit_short"]
    return ordered_fold(signals, keys, [t], cols, lambda: _Backtest(capital, size, slip_bps / 1e4, fee_bps / 1e4, compat), TRADE_DDL)


class _Turtle(Machine):
    """Channel breakout with pyramiding and a trailing stop."""

    def __init__(self, units, spacing):
        self.max, self.spacing = units, spacing
        self.units, self.side, self.last, self.stop = 0, 0, None, None

    def row(self, t, close, atr, hi, lo, xlo, xhi):
        if atr is None or hi is None:
            return
        if self.side:
            stopped = close < self.stop if self.side > 0 else close > self.stop
            counter = xlo is not None and (close < xlo if self.side > 0 else close > xhi)
            if stopped or counter:
                yield t, "exit", self.side, self.units
                self.units, self.side = 0, 0
        if self.side > 0 and close >= self.last + self.spacing * atr and self.units < self.max:
            kind = "pyramid"
        elif close > hi and self.units < self.max:
            kind, self.side = "breakout", 1
        elif close < lo and self.units < self.max:
            kind, self.side = "breakout", -1
        else:
            return
        self.units += 1
        self.last, self.stop = close, close - self.side * 2 * atr
        yield t, kind, self.side, self.units


def turtle(s: Series, entry: int = 20, leave: int = 10, atr_n: int = 20, units: int = 4, spacing: float = 0.5) -> DataFrame:
    s = bands.atr(s, atr_n, "atr").bounded(
        entry,
        {
            "_hi": lambda w: w.full(entry + 1, F.max("high").over(w.span(-entry, -1))), "_lo": lambda w: w.full(entry + 1, F.min("low").over(w.span(-entry, -1))),
            "_xl": lambda w: F.min("low").over(w.span(-leave, -1)), "_xh": lambda w: F.max("high").over(w.span(-leave, -1)),
        },
    )
    t = s.order[0]
    return ordered_fold(s.df, s.keys, s.order, [t, "close", "atr", "_hi", "_lo", "_xl", "_xh"], lambda: _Turtle(units, spacing), "t bigint, event string, side int, units int")


class _Ledger(Machine):
    """Average-cost position: open, add, reduce, close, flip."""

    FIELDS = "qty double, avg double, realised double, n int"

    def __init__(self):
        self.qty, self.avg, self.realised, self.n = 0.0, 0.0, 0.0, 0

    def row(self, side, qty, price):
        d = qty if side == "buy" else -qty
        self.n += 1
        if self.qty == 0 or self.qty * d > 0:
            self.avg = (self.avg * abs(self.qty) + price * qty) / (abs(self.qty) + qty)
            self.qty += d
            return ()
        closed = min(qty, abs(self.qty))
        self.realised += (price - self.avg) * closed * (1 if self.qty > 0 else -1)
        rest = self.qty + d
        if self.qty * rest < 0:
            self.avg = price
        elif rest == 0:
            self.avg = 0.0
        self.qty = rest
        return ()

    def end(self):
        yield self.qty, self.avg, self.realised, self.n


def ledger(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Final position, average entry and realised PnL per key."""
    return ordered_fold(fills, keys, order, ["side", "qty", "price"], _Ledger, "quantity double, avg_price double, realised double, fills int")
