"""Composite signal: indicator scores in [-1, 1], weighted vote, noise ratio."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.functions import bands, oscillators as O, structure as S
from tapeworks.functions.bar import B
from tapeworks.plans.recur import Affine, ema as ema_step
from tapeworks.plans.series import IDX, Series

# Weights of the indicator scores.
WEIGHTS = {
    "rsi": 0.12, "macd": 0.12, "bb": 0.08, "atr": 0.05, "adx": 0.08, "stoch": 0.08, "ichimoku": 0.08,
    "volume": 0.08, "divergence": 0.12, "hurst": 0.04, "zscore": 0.05, "connors_rsi": 0.05, "ttm_squeeze": 0.05,
}
TREND = ("macd", "adx", "ichimoku")
REVERT = ("rsi", "bb", "zscore", "connors_rsi")


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _bands(x: Column, lo: float, hi: float) -> Column:
    mid = (lo + hi) / 2
    return F.when(x > hi, -(x - hi) / (100 - hi)).when(x < lo, (lo - x) / lo).otherwise((mid - x) / mid * 0.3)


def indicators(s: Series) -> Series:
    """All indicator columns the scores need.  Everything that runs in Arrow
    batches comes first, while rows are narrow (all recurrences share one
    pass); the bounded windows follow on one exchange."""
    s = O.directional(O.connors_rsi(s))
    s = s.scan(*O.macd_steps(), ema_step("kc_mid", "close", 20), *O.adx_steps())
    s = s._with(s.mutate(macd_hist=F.col("macd") - F.col("macd_signal")).rows.drop("_f", "_s", "_tr", "_pd", "_md", "_a", "_p", "_m", "_dx", "plus_di", "minus_di"))
    s = O.stochastic(bands.cmf(bands.ichimoku(O.rsi(s, 14))))
    s = bands.atr(s, 14, "atr").bounded(13, {"_p14": lambda w: F.avg("close").over(w(14))})
    return bands.squeeze(S.zscore(s, 30))


def scores(s: Series) -> Series:
    c = F.col
    s = indicators(s)
    top, bot = F.greatest("senkou_a", "senkou_b"), F.least("senkou_a", "senkou_b")
    mid = (top + bot) / 2
    z = c("zscore")
    out = {
        "rsi": _bands(c("rsi"), 30.0, 70.0),
        "macd": F.when(F.abs("macd_hist") < 1e-10, 0.0).otherwise(_clip(c("macd_hist") / B.c * 1000)),
        "bb": F.when(c("bb_upper") == c("bb_lower"), 0.0).when(c("bb_pct") > 0.95, -0.8).when(c("bb_pct") < 0.05, 0.8).otherwise((0.5 - c("bb_pct")) * 1.6),
        "atr": 1 / (1 + F.exp(10 * (c("atr") / c("_p14") - 0.02))),
        "adx": F.when(c("adx") < 25, 0.0).otherwise(F.least(c("adx") / 100, F.lit(1.0))),
        "stoch": F.when(c("stoch_d").isNull(), 0.0).otherwise(F.when(c("stoch_k") > 80, -(c("stoch_k") - 80) / 20).when(c("stoch_k") < 20, (20 - c("stoch_k")) / 20).otherwise((50 - c("stoch_k")) / 50 * 0.3)),
        "ichimoku": F.when(B.c > top, F.least((B.c - top) / mid, F.lit(1.0))).when(B.c < bot, F.greatest((B.c - bot) / mid, F.lit(-1.0))).otherwise(0.0),
        "volume": _clip(c("cmf") * 5),
        "zscore": F.when(F.abs(z) > 2.5, -F.signum(z) * 0.8).when(F.abs(z) > 2.0, -F.signum(z) * 0.5).otherwise(0.0),
        "connors_rsi": F.when(c("crsi") > 80, -0.6).when(c("crsi") < 20, 0.6).otherwise((50 - c("crsi")) / 50 * 0.3),
        "ttm_squeeze": F.when(c("squeeze"), 0.0).otherwise(_clip(c("squeeze_momentum") / (c("atr") + 1e-10))),
    }
    return s.mutate(**{f"s_{k}": F.coalesce(v, F.lit(0.0)) for k, v in out.items()})


def regime_weight(name: str, regime: Column) -> Column:
    """Weight factor of a score in a market regime."""
    fast, slow = (name in TREND), (name in REVERT)
    return (
        F.when(regime == "trending", 1.5 if fast else 0.5 if slow else 1.0)
        .when(regime == "mean_reverting", 1.5 if slow else 0.5 if fast else 1.0)
        .when(regime == "volatile", 1.5 if name == "atr" else 0.5)
        .when(regime == "quiet", 0.7).otherwise(1.0)
    )


def vote(s: Series, names: list[str], threshold: float = 0.3, confirm: float = 0.6, regime: Column | None = None) -> Series:
    """Weighted mean of the scores, signal-to-noise, share of agreeing scores,
    direction and strength (halved without confirmation)."""
    w = {n: F.lit(WEIGHTS[n]) * (regime_weight(n, regime) if regime is not None else F.lit(1.0)) for n in names}
    col = lambda n: F.col(f"s_{n}")
    total = sum((w[n] for n in names), F.lit(0.0))
    s = s.mutate(vote=sum((col(n) * w[n] for n in names), F.lit(0.0)) / total)
    k = len(names)
    mean = sum((col(n) for n in names), F.lit(0.0)) / k
    var = sum((F.pow(col(n) - mean, 2) for n in names), F.lit(0.0)) / k
    agree = sum((F.when(col(n) * F.col("vote") > 0, 1).otherwise(0) for n in names), F.lit(0)) / k
    ok = F.col(IDX) >= 50
    s = s.mutate(
        snr=F.when(var > 0, F.abs(mean) / F.sqrt(var)).otherwise(0.0), agreement=agree,
        direction=F.when(ok & (F.col("vote") > threshold), "long").when(ok & (F.col("vote") < -threshold), "short").otherwise("neutral"),
    )
    strength = F.least(F.abs("vote"), F.lit(1.0))
    return s.mutate(strength=F.when(F.col("agreement") < confirm, strength * 0.5).otherwise(strength))


def persistence(s: Series, direction: str, bars: int = 2) -> Series:
    """Run length of the direction; a fresh direction counts 0.3."""
    s = s.bounded(1, {"_turn": lambda w: F.when(~F.col(direction).eqNullSafe(w.lag(direction)), F.col(IDX))}).running(_from=("last", "_turn"))
    run = F.col(IDX) - F.col("_from") + 1
    s = s.mutate(run=run)
    f = F.when(F.col("run") >= bars, 1.0).when(F.col("run") == 1, 0.3).otherwise(F.col("run") / bars)
    return s._with(s.mutate(persistence=f).rows.drop("_turn", "_from"))


def bayesian_confidence(s: Series, correct: str, prior: float = 0.5, decay: float = 0.95) -> Series:
    """Beta counts with decay: two affine recurrences."""
    a0 = prior * 20 + 1
    b0 = (1 - prior) * 20 + 1
    hit = lambda v: np.nan_to_num(v[correct])

    def beta(start, gain):
        def coef(v, i):
            g = gain(v)
            return np.where(i == 1, 0.0, decay), np.where(i == 1, decay * start + g, g)
        return coef

    s = s.scan(Affine("_a", beta(a0, hit)), Affine("_b", beta(b0, lambda v: 1 - hit(v))))
    return s._with(s.mutate(confidence=F.col("_a") / (F.col("_a") + F.col("_b"))).rows.drop("_a", "_b"))
