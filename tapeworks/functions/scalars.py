"""Row-wise finance functions as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.draws import erf

one, zero = (lambda: F.lit(1.0)), (lambda: F.lit(0.0))


def cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def black_scholes(df: DataFrame, s: str, k: str, t: str, rate: float, vol: str) -> DataFrame:
    """Adds call, put and the five sensitivities (theta per year).  Built in
    stages so that each normal probability is evaluated once."""
    S, K, T, V = F.col(s), F.col(k), F.col(t), F.col(vol)
    root = V * F.sqrt(T)
    x = df.withColumn("_d1", (F.log(S / K) + (rate + V * V / 2) * T) / root)
    x = x.withColumns({"_n1": cdf(F.col("_d1")), "_n2": cdf(F.col("_d1") - root), "_ph": pdf(F.col("_d1")), "_df": K * F.exp(-rate * T)})
    n1, n2, ph, d = (F.col(c) for c in ("_n1", "_n2", "_ph", "_df"))
    return x.withColumns(
        {
            "call": S * n1 - d * n2, "put": d * (1 - n2) - S * (1 - n1), "delta": n1, "gamma": ph / (S * root), "vega": S * ph * F.sqrt(T),
            "theta": -S * ph * V / (2 * F.sqrt(T)) - rate * d * n2, "rho": T * d * n2,
        }
    ).drop("_d1", "_n1", "_n2", "_ph", "_df")


def implied_vol(price: Column, s: Column, k: Column, t: Column, rate: float) -> Column:
    """Newton iteration from 0.3, clamped to [0.001, 5], vectorised per Arrow batch."""
    @F.pandas_udf("double")
    def solve(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
        err = np.vectorize(math.erf, otypes=[float])
        n = lambda x: 0.5 * (1 + err(x / math.sqrt(2)))
        p, s_, k_, t_ = (v.to_numpy(float) for v in (price, s, k, t))
        vol, live = np.full(len(p), 0.3), np.ones(len(p), bool)
        for _ in range(100):
            d1 = (np.log(s_ / k_) + (rate + vol * vol / 2) * t_) / (vol * np.sqrt(t_))
            diff = s_ * n(d1) - k_ * np.exp(-rate * t_) * n(d1 - vol * np.sqrt(t_)) - p
            vega = s_ * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * np.sqrt(t_)
            live &= (np.abs(diff) >= 1e-6) & (vega >= 1e-10)
            if not live.any():
                break
            step = np.where(live, diff / np.where(vega < 1e-10, 1, vega), 0.0)
            vol = np.where(live, np.clip(vol - step, 0.001, 5.0), vol)
        return pd.Series(vol)

    return solve(price, s, k, t)


def slip(price: Column, bps: Column | float, buy: Column) -> Column:
    x = F.lit(bps) if isinstance(bps, (int, float)) else bps
    return price * F.when(buy, 1 + x / 10000).otherwise(1 - x / 10000)


def slippage_models(price: Column, qty: Column, volume: Column, normal: Column, sigma: Column, buy: Column, bps: float = 5.0, eta: float = 0.1) -> dict[str, Column]:
    """Percentage, square root of participation, impact, and thin-market (10x cap)."""
    part = F.when(volume > 0, qty / volume).otherwise(0.0)
    thin = F.least(F.lit(bps * 10), bps * normal / F.greatest(volume, F.lit(1e-10)))
    impact = eta * sigma * F.sqrt(part) * 10000
    return {"percentage": slip(price, bps, buy), "square_root": slip(price, bps * F.sqrt(part), buy), "impact": slip(price, impact, buy), "thin_market": slip(price, thin, buy)}


def fills(qty: Column, depth: Column, share: float = 0.7, kill_share: float = 0.95) -> dict[str, Column]:
    part = F.least(F.least(qty, depth), qty * share)
    fok = F.when(depth >= qty * kill_share, qty).otherwise(0.0)
    return {"immediate": qty, "partial": part, "partial_left": qty - part, "fill_or_kill": fok}


def kelly_size(win: Column, avg_win: Column, avg_loss: Column, capital: float, fraction: float = 0.5, max_dd: float = 0.25) -> Column:
    f = F.greatest(zero(), win - (1 - win) / (avg_win / avg_loss))
    runs = F.when(f < 1, F.floor(math.log(1 - max_dd) / F.log(1 - f))).otherwise(1)
    dd = 1 - F.pow(1 - f, F.greatest(F.lit(3), runs))
    capped = F.when(f > 0, F.when(dd > max_dd, f * max_dd / dd).otherwise(f)).otherwise(0.0)
    return F.when((avg_loss == 0) | (win == 0), 0.0).otherwise(capital * capped * fraction)


def volatility_size(capital: float, vol: Column, target: float = 0.15, risk: float = 0.02) -> Column:
    return F.when(vol > 0, capital * risk * F.greatest(F.lit(0.25), F.least(F.lit(3.0), target / vol))).otherwise(capital * risk)


def leverage_targets(mean: Column, vol: Column, target: float = 0.15, cap: float = 3.0, max_dd: float = 0.2) -> dict[str, Column]:
    kelly = F.when(vol > 0, mean / (vol * vol)).otherwise(0.0)
    by_vol = F.when(vol > 0, F.least(F.lit(cap), target / vol)).otherwise(F.lit(cap))
    by_dd = F.when(vol > 0, F.sqrt(F.lit(2 * max_dd)) / vol).otherwise(F.lit(cap))
    return {"kelly": kelly, "by_volatility": by_vol, "by_drawdown": by_dd, "optimal": F.greatest(zero(), F.least(kelly * 0.5, by_vol, by_dd, F.lit(cap)))}


def retention(strength: Column, hours: Column, rehearsals: Column, model: str) -> Column:
    """Forgetting curve: exponential, power or logarithmic."""
    t = hours / (1 + 0.2 * rehearsals)
    if model == "exponential":
        x = strength * F.exp(-0.05 * t)
    elif model == "power":
        x = strength * F.pow(1 + 0.1 * t, F.lit(-0.8))
    else:
        x = strength * math.log(2.0) / F.log1p(F.greatest(t, F.lit(0.01)))
    return F.when(hours <= 0, strength).otherwise(F.greatest(zero(), F.least(one(), x)))


def timeframe_minutes(text: Column) -> Column:
    """'15m', '4h', '1d', '1w', '30s' to minutes."""
    n, u = F.regexp_extract(text, r"^(\d+)", 1).cast("double"), F.regexp_extract(text, r"([a-zA-Z]+)$", 1)
    return n * F.when(u == "s", 1 / 60).when(u == "m", 1.0).when(u == "h", 60.0).when(u == "d", 1440.0).when(u == "w", 10080.0)


def dialect_symbol(base: Column, quote: Column, venue: Column) -> Column:
    """BTCUSDT, BTC-USDT or BTC/USDT by venue."""
    return F.when(venue == "A", F.concat(base, quote)).when(venue == "N", F.concat_ws("-", base, quote)).otherwise(F.concat_ws("/", base, quote))
