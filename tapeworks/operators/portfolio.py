"""Portfolio construction.

Moments are Spark aggregates (pair sums of the return panel); a solve needs
one N x N matrix per portfolio, N being the few assets of a portfolio, so it
runs as a grouped Arrow function: many portfolios and dates spread out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.session import checkpointed

Solver = Callable[[np.ndarray, np.ndarray], np.ndarray]      # (mean, cov) -> weights


def project(w: np.ndarray) -> np.ndarray:
    """Nearest point of the simplex (long only, fully invested)."""
    u = np.sort(w)[::-1]
    css = np.cumsum(u) - 1
    k = np.nonzero(u - css / np.arange(1, len(w) + 1) > 0)[0][-1]
    return np.maximum(w - css[k] / (k + 1), 0)


def ascend(grad, n: int, step: float, rounds: int = 2000) -> np.ndarray:
    w = np.full(n, 1 / n)
    for _ in range(rounds):
        w = project(w + step * grad(w))
    return w


def min_variance_for(target: float | None = None, aversion: float = 4.0) -> Solver:
    def solve(mu, cov):
        step = 1 / (2 * aversion * np.linalg.eigvalsh(cov)[-1])
        return ascend(lambda w: mu - aversion * cov @ w, len(mu), step)

    return solve


def climb(value, grad, n: int, rounds: int = 3000) -> np.ndarray:
    """Projected gradient with a step that grows on success and halves on failure."""
    w, step = np.full(n, 1 / n), 1.0
    best = value(w)
    for _ in range(rounds):
        x = project(w + step * grad(w))
        v = value(x)
        if v > best:
            w, best, step = x, v, step * 1.5
        else:
            step /= 2
            if step < 1e-14:
                break
    return w


def _ratio(top: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Long-only maximiser of (w @ top) / sqrt(w' cov w)."""
    def value(w):
        return (w @ top) / np.sqrt(w @ cov @ w)

    def grad(w):
        v = np.sqrt(w @ cov @ w)
        return top / v - (w @ top) * (cov @ w) / v**3

    return climb(value, grad, len(top))


def max_sharpe(mu, cov):
    return _ratio(mu, cov)


def risk_parity(mu, cov):
    """Equal risk contributions by cyclical coordinate updates."""
    n = len(mu)
    x = np.full(n, 1 / np.sqrt(np.trace(cov)))
    for _ in range(500):
        for i in range(n):
            b = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
    return x / x.sum()


def max_diversification(mu, cov):
    return _ratio(np.sqrt(np.diag(cov)), cov)


def shrunk_inverse(mu, cov, share: float = 0.2):
    n = len(mu)
    s = share * np.eye(n) * np.mean(np.diag(cov)) + (1 - share) * cov + 1e-6 * np.eye(n)
    raw = np.linalg.solve(s, mu)
    w = np.clip(raw / (raw.sum() + 1e-12), 0, 1)
    return w / (w.sum() + 1e-12)


def black_litterman(mu, cov, tau: float = 0.05, aversion: float = 2.5):
    """Equilibrium from equal weights; one view per asset: its own mean."""
    n = len(mu)
    pi = aversion * cov @ np.full(n, 1 / n)
    a, o = np.linalg.inv(tau * cov), np.diag(1 / (0.5 * np.diag(cov)))
    m = np.linalg.inv(a + o)
    post = m @ (a @ pi + o @ mu)
    w = np.maximum(np.linalg.solve(aversion * (cov + m), post), 0)
    return w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)


def hierarchical(mu, cov):
    """Leaf order by nearest-cluster merging, then inverse-variance bisection."""
    sd = np.sqrt(np.diag(cov))
    dist = 1 - np.abs(cov / np.outer(sd, sd))
    groups = [[i] for i in range(len(mu))]
    while len(groups) > 1:
        pairs = [(np.mean(dist[np.ix_(a, b)]) * len(a) * len(b) / (len(a) + len(b)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        merged = groups[i] + groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]
    w = np.ones(len(mu))

    def var(ix):
        iv = 1 / (np.diag(cov)[ix] + 1e-10)
        p = iv / iv.sum()
        return p @ cov[np.ix_(ix, ix)] @ p

    todo = [groups[0]]
    while todo:
        g = todo.pop()
        if len(g) < 2:
            continue
        left, right = g[: len(g) // 2], g[len(g) // 2:]
        vl, vr = var(left), var(right)
        w[left] *= vr / (vl + vr)
        w[right] *= vl / (vl + vr)
        todo += [left, right]
    return w


SOLVERS: dict[str, Solver] = {
    "mean_variance": min_variance_for(), "max_sharpe": max_sharpe, "risk_parity": risk_parity, "max_diversification": max_diversification,
    "shrunk_inverse": shrunk_inverse, "black_litterman": black_litterman, "hierarchical": hierarchical,
}


def solve_groups(moments: DataFrame, methods: list[str]) -> DataFrame:
    """``moments``: (portfolio, i, j, cov, mu) with i <= j and mu on i = j rows.
    Returns (portfolio, method, asset, weight)."""

    def run(table):
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        ids, pos = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = pos[: len(i)], pos[len(i):]
        cov, mu = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        cov[a, b] = cov[b, a] = table["cov"].to_numpy()
        diag = a == b
        mu[a[diag]] = table["mu"].to_numpy(zero_copy_only=False)[diag]
        rows = [(m, w) for m in methods for w in [SOLVERS[m](mu, cov)]]
        n = len(ids)
        p = table["portfolio"][0].as_py()
        return pa.table(
            {
                "portfolio": pa.array([p] * n * len(rows), pa.int64()), "method": [m for m, _ in rows for _ in range(n)],
                "asset": pa.array(np.tile(ids, len(rows)), pa.int64()), "weight": np.concatenate([w for _, w in rows]),
            }
        )

    return moments.groupBy("portfolio").applyInArrow(run, "portfolio bigint, method string, asset bigint, weight double")


def frontier(moments: DataFrame, aversions: list[float]) -> DataFrame:
    """Efficient frontier: one solve per (portfolio, risk aversion)."""

    def run(table):
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        ids, pos = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = pos[: len(i)], pos[len(i):]
        cov, mu = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        cov[a, b] = cov[b, a] = table["cov"].to_numpy()
        mu[a[a == b]] = table["mu"].to_numpy(zero_copy_only=False)[a == b]
        lam = table["aversion"][0].as_py()
        w = min_variance_for(aversion=lam)(mu, cov)
        return pa.table({"portfolio": pa.array([table["portfolio"][0].as_py()], pa.int64()), "aversion": [lam], "ret": [float(w @ mu)], "vol": [float(np.sqrt(w @ cov @ w))]})

    x = moments.withColumn("aversion", F.explode(F.array(*[F.lit(float(a)) for a in aversions])))
    return x.groupBy("portfolio", "aversion").applyInArrow(run, "portfolio bigint, aversion double, ret double, vol double")


def min_correlation(pairs: DataFrame) -> DataFrame:
    """Rank assets by mean absolute correlation; the calmest gets the largest
    of the weights n..1 over their sum."""
    from pyspark.sql import Window

    sides = pairs.where("i < j").select("i", "corr").unionByName(pairs.where("i < j").select(F.col("j").alias("i"), "corr"))
    m = sides.groupBy(F.col("i").alias("asset")).agg(F.sum(F.abs("corr")).alias("_s"), (F.count(F.lit(1)) + 1).alias("n"))
    m = m.withColumn("avg_corr", F.col("_s") / F.col("n"))
    rk = F.row_number().over(Window.orderBy(F.round("avg_corr", 12), "asset"))          # one row per asset
    return m.withColumn("k", rk).select("asset", "avg_corr", ((F.col("n") - F.col("k") + 1) / (F.col("n") * (F.col("n") + 1) / 2)).alias("weight"))


def bounded_project(w: np.ndarray, low: float, high: float) -> np.ndarray:
    """Nearest fully invested point with weights in [low, high]."""
    lo, hi = (w - high).min(), (w - low).max()
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.clip(w - mid, low, high).sum() > 1:
            lo = mid
        else:
            hi = mid
    return np.clip(w - hi, low, high)


def tail_of(scenarios: DataFrame, weights: DataFrame, confidence: float) -> DataFrame:
    """CVaR of every candidate (cand, asset, weight) and its slope by asset: the
    mean return of the asset in the candidate's tail.  Scenarios are long rows
    (t, asset, ret); an asset without a row at t returned nothing."""
    from tapeworks.plans.quantiles import exact_percentiles

    p = scenarios.join(weights, "asset").groupBy("cand", "t").agg(F.sum(F.col("ret") * F.col("weight")).alias("p"))
    q = exact_percentiles(p, ["cand"], "p", {"q": 1 - confidence}).select("cand", "q")
    tail = p.join(q, "cand").where("p <= q").select("cand", "t", "p")
    level = tail.groupBy("cand").agg((-F.avg("p")).alias("cvar"), F.count(F.lit(1)).alias("n"))
    slope = scenarios.join(tail.select("cand", "t"), "t").groupBy("cand", "asset").agg(F.sum("ret").alias("s"))
    return level.join(slope, "cand").select("cand", "cvar", "asset", (F.col("s") / F.col("n")).alias("slope"))


def min_cvar(panel: DataFrame, confidence: float = 0.95, low: float = 0.0, high: float = 1.0, tolerance: float = 1e-3, rounds: int = 60, fan: int = 8) -> tuple[list, np.ndarray, float, float]:
    """Weights of least CVaR over a distributed scenario table: assets, weights,
    their CVaR and that of equal weights.

    Each round tries a fan of step lengths along the slope at the best weights
    in one job.  Steps shrink when none helps; the search ends when the last
    rounds gained less than ``tolerance`` and the shortest step is below it, and
    raises when that doesn't come.  One number per asset and step reaches the
    driver, no scenario does.
    """
    spark = panel.sparkSession
    scenarios = checkpointed(panel.select("t", F.col("asset").cast("bigint").alias("asset"), F.col("ret").cast("double").alias("ret")).where("ret is not null"))
    assets = sorted(r[0] for r in scenarios.select("asset").distinct().collect())
    n = len(assets)
    if n * high < 1 or n * low > 1:
        raise ValueError("no weights meet the bounds")

    def tried(ws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = [(k, a, float(x)) for k, w in enumerate(ws) for a, x in zip(assets, w)]
        cvar, slope = np.full(len(ws), np.inf), np.zeros((len(ws), n))
        at = {a: i for i, a in enumerate(assets)}
        for r in tail_of(scenarios, spark.createDataFrame(rows, "cand int, asset bigint, weight double"), confidence).collect():
            cvar[r.cand] = r.cvar
            slope[r.cand, at[r.asset]] = r.slope
        return cvar, slope

    w = np.full(n, 1 / n)
    cvar, slope = tried([w])
    best, equal, g = cvar[0], cvar[0], slope[0]
    step, idle = 1.0, 0
    for _ in range(rounds):
        d = g - g.mean()
        size = np.abs(d).max() or 1.0
        ws = [bounded_project(w + step * 0.5**k * d / size, low, high) for k in range(fan)]
        cvar, slope = tried(ws)
        k = int(cvar.argmin())
        gain = best - cvar[k]
        if gain > 0:
            # the slope of the old and the new tail together crosses a kink
            w, best, g, step = ws[k], cvar[k], 0.5 * g + 0.5 * slope[k], step * 0.5 ** max(0, k - 1)
        else:
            g, step = 0.5 * g + 0.5 * slope[-1], step * 0.5 ** (fan // 2)
        idle = idle + 1 if gain <= tolerance * abs(best) else 0
        if idle >= 2 and step <= tolerance:
            return assets, w, float(best), float(equal)
        if idle >= 2:
            step *= 0.5 ** (fan // 2)
    raise RuntimeError(f"CVaR did not settle to {tolerance} in {rounds} rounds")


def soft_tail(scenarios: DataFrame, weights: DataFrame, confidence: float, width: float = 0.9) -> DataFrame:
    """cand, asset, slope: the asset's mean return in each candidate's tail.  A
    scenario counts fully below the percentile at (1 - ``width``) of the tail's
    share, not at all above (1 + ``width``), and linearly between, so slopes move
    smoothly with the weights."""
    from tapeworks.plans.quantiles import exact_percentiles

    p = scenarios.join(weights, "asset").groupBy("cand", "t").agg(F.sum(F.col("ret") * F.col("weight")).alias("p"))
    cut = {"_lo": (1 - confidence) * (1 - width), "_hi": (1 - confidence) * (1 + width)}
    q = exact_percentiles(p, ["cand"], "p", cut).select("cand", *cut)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_hi") - F.col("p")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))))
    tail = p.join(q, "cand").where("p < _hi").select("cand", "t", share.alias("_w"))
    total = tail.groupBy("cand").agg(F.sum("_w").alias("_n"))
    slope = scenarios.join(tail, "t").groupBy("cand", "asset").agg(F.sum(F.col("ret") * F.col("_w")).alias("_s"))
    return slope.join(total, "cand").select("cand", "asset", (F.col("_s") / F.col("_n")).alias("slope"))


def risk_budget(panel: DataFrame, budget: dict | None = None, confidence: float = 0.95, low: float = 0.01, high: float = 0.99, tolerance: float = 0.1, rounds: int = 60, fan: int = 8, patience: int = 5) -> DataFrame:
    """asset, budget, weight, share, residual, start: weights whose shares of the
    tail loss meet their budgets (equal ones unless given).

    A share is the asset's weight times its mean loss in the (soft) tail of the
    whole.  Each round moves every weight by a power of budget over share, tries a
    fan of powers in one job and goes on from the best.  The search ends when
    every share is within ``tolerance`` times its budget, or when ``patience``
    rounds found no better weights: few scenarios make the tail jump, and shares
    in between don't exist then.  ``residual`` is the largest miss, as a part of
    the budget, ``start`` that of equal weights; raises when weights still get
    better after ``rounds``.
    """
    spark = panel.sparkSession
    scenarios = checkpointed(panel.select("t", F.col("asset").cast("bigint").alias("asset"), F.col("ret").cast("double").alias("ret")).where("ret is not null"))
    assets = sorted(r[0] for r in scenarios.select("asset").distinct().collect())
    n = len(assets)
    want = np.array([budget[a] for a in assets]) if budget else np.full(n, 1 / n)
    want = want / want.sum()
    at = {a: i for i, a in enumerate(assets)}

    def shares(ws: list[np.ndarray]) -> np.ndarray:
        rows = [(k, a, float(x)) for k, w in enumerate(ws) for a, x in zip(assets, w)]
        loss = np.zeros((len(ws), n))
        for r in soft_tail(scenarios, spark.createDataFrame(rows, "cand int, asset bigint, weight double"), confidence).collect():
            loss[r.cand, at[r.asset]] = abs(ws[r.cand][at[r.asset]] * r.slope)
        return loss / loss.sum(axis=1, keepdims=True)

    miss = lambda s: np.abs(s / want - 1).max() + ((s / want - 1) ** 2).mean()
    w = bounded_project(np.full(n, 1 / n), low, high)
    share, power, idle = shares([w])[0], 0.5, 0
    best = (miss(share), w, share)
    start = float(np.abs(share / want - 1).max())
    for _ in range(rounds):
        if idle >= patience or (np.abs(best[2] / want - 1) <= tolerance).all():
            out = [(a, float(b), float(x), float(s), float(np.abs(best[2] / want - 1).max()), start) for a, b, x, s in zip(assets, want, best[1], best[2])]
            return spark.createDataFrame(out, "asset bigint, budget double, weight double, share double, residual double, start double")
        ratio = np.clip(want / np.maximum(share, 1e-9), 0.2, 5.0)
        ws = [bounded_project((y := w * ratio ** (power * 0.6**k)) / y.sum(), low, high) for k in range(fan)]
        got = shares(ws)
        k = int(np.argmin([miss(s) for s in got]))
        better = miss(got[k]) < miss(share)
        w, share = ws[k], got[k]
        power = min(0.9, power * (1.5 if k == 0 else 0.6 ** max(0, k - 1))) if better else max(0.05, power * 0.5)
        idle = 0 if miss(share) < 0.98 * best[0] else idle + 1
        if miss(share) < best[0]:
            best = (miss(share), w, share)
    raise RuntimeError(f"weights did not settle in {rounds} rounds")
