"""Risk numbers: VaR and shortfall, exposures, stress, pre-trade checks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.pairs import corr, cov, pair_sums
from tapeworks.plans.quantiles import exact_percentiles
from tapeworks.plans.series import IDX, Series

# Standard normal quantiles and densities.
Z = {0.95: 1.6448536269514722, 0.975: 1.959963984540054, 0.99: 2.3263478740408408}


def pdf(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


# Parametric stress scenarios (shock, correlation goes to one).
SCENARIOS = {
    "flash_crash": (-0.20, True),
    "slow_bleed": (-0.10, False),
    "vol_spike": (-0.05, False),
    "liquidity_crisis": (-0.15, True),
    "correlation_breakdown": (-0.08, True),
    "black_swan": (-0.40, True),
    "covid_crash_march2020": (-0.35, True),
    "ftx_collapse_nov2022": (-0.25, True),
    "luna_crash_may2022": (-0.60, True),
}

# Historical replays (major-coin shock, other-coin shock, recovery days).
REPLAYS = {
    "covid_crash_feb_mar_2020": (-0.50, -0.65, 150),
    "ftx_collapse_nov_2022": (-0.25, -0.50, 60),
    "luna_crash_may_2022": (-0.30, -0.70, 90),
    "china_ban_may_2021": (-0.35, -0.55, 45),
}


def tail_levels(df: DataFrame, keys: list[str], ret: str, levels: dict[str, float]) -> DataFrame:
    """``var_<name>`` (interpolated percentile) and ``cvar_<name>`` (mean loss at
    or beyond it) for several confidence levels, with the row count ``n``."""
    q = exact_percentiles(df, keys, ret, {f"_q_{k}": 1 - c for k, c in levels.items()})
    x = df.join(q, keys) if keys else df.join(F.broadcast(q), F.lit(True))
    tail = [F.avg(F.when(F.col(ret) <= F.col(f"_q_{k}"), F.col(ret))) for k in levels]
    got = x.groupBy(*keys).agg(F.first("n").alias("n"), *[F.first(f"_q_{k}").alias(f"_q_{k}") for k in levels], *[t.alias(f"_t_{k}") for k, t in zip(levels, tail)])
    return got.select(*keys, "n", *[(-F.col(f"_q_{k}")).alias(f"var_{k}") for k in levels], *[(-F.col(f"_t_{k}")).alias(f"cvar_{k}") for k in levels])


def tail_stats(df: DataFrame, keys: list[str], ret: str, confidence: float, min_rows: int) -> DataFrame:
    """Historical VaR and CVaR; null for groups with fewer rows than ``min_rows``."""
    got = tail_levels(df, keys, ret, {"x": confidence})
    ok = F.col("n") >= min_rows
    return got.select(*keys, "n", F.when(ok, F.col("var_x")).alias("var"), F.when(ok, F.col("cvar_x")).alias("cvar"))


def parametric(df: DataFrame, keys: list[str], ret: str, confidence: float) -> DataFrame:
    """Normal VaR, normal ES and the Cornish-Fisher ES (30 rows at least)."""
    z = Z[confidence]
    g = df.groupBy(*keys).agg(
        F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"), F.skewness(ret).alias("_k3"), F.kurtosis(ret).alias("_k4"), F.count(ret).alias("n")
    )
    m, s, k3, k4 = (F.col(c) for c in ("_m", "_s", "_k3", "_k4"))
    zc = z + (z * z - 1) * k3 / 6 + (z**3 - 3 * z) * k4 / 24 - (2 * z**3 - 5 * z) * k3 * k3 / 36
    phi = F.exp(-zc * zc / 2) / math.sqrt(2 * math.pi)
    ok = F.col("n") >= 30
    return g.select(
        *keys,
        F.when(ok, -(m - z * s)).alias("var_normal"),
        F.when(ok, -(m - s * pdf(z) / (1 - confidence))).alias("es_normal"),
        F.when(ok, -(m - s * phi / (1 - confidence))).alias("es_cornish_fisher"),
    )


def order_statistic_var(df: DataFrame, keys: list[str], ret: str, order: list[str], confidence: float = 0.99) -> DataFrame:
    """VaR as the sorted return at index int((1-c)*n), CVaR as the mean up to it."""
    s = Series.of(df, keys, [ret, *order]).totals(_n=F.count(F.lit(1)))
    at = F.floor((1 - confidence) * F.col("_n")) + 1
    return s.rows.where((F.col("_n") >= 10) & (F.col(IDX) <= at)).groupBy(*keys).agg(F.max(ret).alias("var"), F.avg(ret).alias("cvar"))


def portfolio_returns(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """sum(weight * return) per t; weights are one row per asset."""
    return panel.join(weights, "asset").groupBy("t").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def es_bumps(panel: DataFrame, weights: DataFrame, confidence: float = 0.975, delta: float = 1e-4) -> DataFrame:
    """Marginal ES per asset by a bump of its weight: the bumped portfolio
    returns of all assets come from one pass (base + delta * own return)."""
    base = portfolio_returns(panel, weights)
    total = tail_stats(base, [], "ret", confidence, 50).select(F.col("cvar").alias("total_es"))
    up = panel.join(base.withColumnRenamed("ret", "_p"), "t").withColumn("_u", F.col("_p") + delta * F.col("ret"))
    got = tail_stats(up, ["asset"], "_u", confidence, 50).select("asset", F.col("cvar").alias("_up"))
    x = got.join(F.broadcast(total), F.lit(True)).join(weights, "asset")
    x = x.withColumn("marginal_es", (F.col("_up") - F.col("total_es")) / delta).withColumn("contribution", F.col("weight") * F.col("marginal_es"))
    tot = x.agg(F.sum(F.abs("contribution")).alias("_tot"))
    return x.join(F.broadcast(tot), F.lit(True)).withColumn("pct", F.abs("contribution") / F.col("_tot") * 100).drop("_up", "_tot")


MIN_ROWS = 10


def covariances(panel: DataFrame, n_assets: int | None = None) -> DataFrame:
    """asset pairs i <= j with n, covariance and correlation; pairs with fewer
    than ``MIN_ROWS`` common rows get the identity matrix's values."""
    s = pair_sums(panel, ["t"], "asset", "ret", n_assets)
    few, unit = F.col("n") < MIN_ROWS, F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return s.select("i", "j", F.col("n").cast("bigint").alias("n"), F.when(few, unit).otherwise(cov()).alias("cov"), F.when(few, unit).otherwise(corr()).alias("corr"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """i <= j rows to a full matrix in row form."""
    return pairs.unionByName(pairs.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in pairs.columns if c not in ("i", "j")]))


def risk_contributions(panel: DataFrame, weights: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Marginal and component VaR per asset with a level."""
    full = both_ways(covariances(panel).select("i", "j", "cov"))
    wi = weights.select(F.col("asset").alias("i"), F.col("weight").alias("wi"))
    wj = weights.select(F.col("asset").alias("j"), F.col("weight").alias("wj"))
    m = full.join(wj, "j").groupBy("i").agg(F.sum(F.col("cov") * F.col("wj")).alias("_cw")).join(wi, "i")
    pv = m.agg(F.sum(F.col("wi") * F.col("_cw")).alias("_pv"))
    x = m.join(F.broadcast(pv), F.lit(True))
    vol = F.when(F.col("_pv") > 0, F.sqrt("_pv")).otherwise(1e-10)
    x = x.withColumn("marginal_var", F.col("_cw") / vol * Z[confidence]).withColumn("component_var", F.col("wi") * F.col("marginal_var"))
    tot = x.agg(F.sum("component_var").alias("_t"))
    pct = F.col("component_var") / F.col("_t") * 100
    return x.join(F.broadcast(tot), F.lit(True)).select(
        F.col("i").alias("asset"), F.col("wi").alias("weight"), "marginal_var", "component_var", pct.alias("pct"),
        F.when(pct > 30, "high").when(pct > 15, "medium").otherwise("low").alias("level"),
    )


def spectrum(pairs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Eigenvalues of the correlation matrix.  The matrix has one row per asset
    (a dimension); its N x N solve runs in a grouped Arrow function."""
    import pyarrow as pa

    def solve(table):
        i, j, c = (table[x].to_numpy() for x in ("i", "j", "corr"))
        ids, pos = np.unique(np.concatenate([i, j]), return_inverse=True)
        m = np.eye(len(ids))
        a, b = pos[: len(i)], pos[len(i):]
        m[a, b] = m[b, a] = np.nan_to_num(c)
        np.fill_diagonal(m, 1.0)
        ev = np.sort(np.linalg.eigvalsh(m))[::-1]
        return pa.table({"k": np.arange(1, len(ev) + 1, dtype="int64"), "eigenvalue": ev, "share": ev / ev.sum()})

    return pairs.select("i", "j", "corr").groupBy(F.lit(1).alias("_one")).applyInArrow(lambda t: solve(t), "k bigint, eigenvalue double, share double")


def exposure_sets(pos: DataFrame) -> DataFrame:
    """Long, short, gross, net, leverage-adjusted exposure and HHI for the total,
    each currency group and each symbol (grouping sets in one pass).  A group
    whose net positions are all zero has no concentration: its HHI is NaN."""
    c = F.col
    total = F.sum("notional")
    g = pos.groupingSets([[], ["nation"], ["symbol"]], "nation", "symbol").agg(
        F.grouping_id().alias("gid"),
        F.sum(F.when(c("signed") > 0, c("notional")).otherwise(0.0)).alias("long_exposure"),
        F.sum(F.when(c("signed") > 0, 0.0).otherwise(c("notional"))).alias("short_exposure"),
        F.sum("signed").alias("net_exposure"),
        F.sum(c("signed") * c("leverage")).alias("leverage_adjusted"),
        F.when(total == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(c("notional") * c("notional")), total * total)).alias("hhi"),
    )
    return g.withColumn("gross_exposure", c("long_exposure") + c("short_exposure"))


def beta_adjusted(pos: DataFrame, betas: DataFrame) -> DataFrame:
    """Signed exposure times beta (missing beta = 1)."""
    return pos.join(betas, "symbol", "left").withColumn("beta_exposure", F.col("signed") * F.coalesce(F.col("beta"), F.lit(1.0)))


def correlation_adjusted(exposure: DataFrame, pairs: DataFrame) -> DataFrame:
    """sqrt(sum s_i^2 + 2 sum s_i s_j corr_ij): driven by the given correlation
    pairs, so missing pairs (0) are never generated."""
    own = exposure.agg(F.sum(F.col("signed") * F.col("signed")).alias("own"))
    a = exposure.select(F.col("asset").alias("i"), F.col("signed").alias("_a"))
    b = exposure.select(F.col("asset").alias("j"), F.col("signed").alias("_b"))
    cross = pairs.where("i < j").join(a, "i").join(b, "j").agg(F.coalesce(F.sum(2 * F.col("_a") * F.col("_b") * F.col("corr")), F.lit(0.0)).alias("cross"))
    total = F.col("own") + F.col("cross")
    return own.join(F.broadcast(cross), F.lit(True)).select(F.when(total > 0, F.sqrt(total)).otherwise(0.0).alias("corr_adjusted"))


def stress(pos: DataFrame, penalty: bool = True, compat: bool = False) -> DataFrame:
    """PnL of every scenario: the scenarios are a literal array exploded per
    position after positions were reduced to (leveraged?, side) sums.  Where
    correlations go to one, a fifth of the result's size is taken off;
    ``compat`` moves the result towards zero instead, gain or loss."""
    c = F.col
    base = pos.groupBy((c("leverage") > 1).alias("lev")).agg(F.sum("signed").alias("signed"))
    rows = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(s).alias("shock"), F.lit(t).alias("to_one")) for k, (s, t) in SCENARIOS.items()])
    g = base.select("lev", "signed", F.inline(rows)).groupBy("scenario", "to_one").agg(F.sum(c("signed") * c("shock") * F.when(c("lev"), 1.5).otherwise(1.0)).alias("pnl"))
    pen = F.when(c("to_one") & F.lit(penalty), 0.2 * (c("pnl") if compat else F.abs("pnl"))).otherwise(0.0)
    return g.select("scenario", (c("pnl") - pen).alias("total_pnl"))


def replay(pos: DataFrame, is_major: Column) -> DataFrame:
    """Historical replays with separate shocks for majors and the rest."""
    c = F.col
    base = pos.groupBy((c("leverage") > 1).alias("lev"), is_major.alias("major")).agg(F.sum("signed").alias("signed"))
    rows = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(a).alias("big"), F.lit(b).alias("alt"), F.lit(d).alias("recovery_days")) for k, (a, b, d) in REPLAYS.items()])
    shock = F.when(c("major"), c("big")).otherwise(c("alt")) * F.when(c("lev"), 1.5).otherwise(1.0)
    return base.select("lev", "major", "signed", F.inline(rows)).groupBy("scenario", "recovery_days").agg(F.sum(c("signed") * shock).alias("total_pnl"))


def pre_trade_checks(orders: DataFrame, held: DataFrame, books: DataFrame, limits: dict[str, float], halted: bool = False) -> DataFrame:
    """One row per (order, check).

    ``orders``: account, symbol, notional, side and an id; ``held``: (account,
    symbol, notional, signed) positions; ``books``: (account, total_value,
    unrealized).  Position sums are aggregated before the joins.  A kill switch
    short-circuits to a single rejection.
    """
    c = F.col
    if halted:
        return orders.select("*", F.lit("kill_switch").alias("check"), F.lit("reject").alias("decision"), F.lit(1.0).alias("value"), F.lit(0.0).alias("limit"))
    sym = held.groupBy("account", "symbol").agg(F.sum("notional").alias("_sym"))
    acc = held.groupBy("account").agg(F.sum("notional").alias("_gross"), F.sum("signed").alias("_net"))
    x = orders.join(sym, ["account", "symbol"], "left").join(acc, "account", "left").join(books, "account", "left")
    zero = lambda k: F.coalesce(c(k), F.lit(0.0))
    new = zero("_sym") + c("notional")
    net = zero("_net") + F.when(c("side") == "buy", c("notional")).otherwise(-c("notional"))
    total = c("total_value")

    def check(name, value, limit, when=F.lit(True)):
        lim = F.lit(limit) if not isinstance(limit, Column) else limit
        return F.when(when, F.struct(F.lit(name).alias("check"), value.alias("value"), lim.alias("limit"), F.when(value <= lim, "allow").otherwise("reject").alias("decision")))

    checks = F.array_compact(
        F.array(
            check("position_limit_symbol", new, limits["symbol"]),
            check("order_notional", c("notional"), limits["order"]),
            check("max_drawdown", F.when(total > 0, -c("unrealized") / total).otherwise(0.0), limits["drawdown"]),
            check("gross_exposure", zero("_gross") + c("notional"), limits["gross"]),
            check("concentration", new / total, limits["concentration"], total > 0),
            check("margin", c("notional") * limits["margin_ratio"], total - zero("_gross") * limits["margin_ratio"]),
            check("net_exposure", F.abs(net), limits["net"]),
        )
    )
    return x.select(*orders.columns, F.inline(checks))
