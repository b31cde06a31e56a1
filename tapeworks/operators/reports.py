"""Trade statistics, equity metrics, attribution, period returns, benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.structure import longest_streaks
from tapeworks.plans.series import IDX, SMALL_BYTES, Series
from tapeworks.session import checkpointed, no_larger_than, size_estimate


def trade_statistics(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Counts, win rate, profit factor (no losses -> 9999), best / worst,
    averages and duration in one grouped aggregate; streaks from one ordered pass."""
    p = F.col("pnl")
    win = p > 0
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.avg(F.when(win, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum(F.when(win, p).otherwise(0.0)).alias("_gp"), F.abs(F.sum(F.when(~win, p).otherwise(0.0))).alias("_gl"),
        F.max("pnl").alias("best_trade"), F.min("pnl").alias("worst_trade"),
        F.coalesce(F.avg(F.when(win, p)), F.lit(0.0)).alias("avg_winning_trade"), F.coalesce(F.avg(F.when(~win, p)), F.lit(0.0)).alias("avg_losing_trade"),
        F.avg("hours").alias("avg_trade_duration_hours"), F.sum("pnl").alias("total_pnl"),
    )
    pf = F.when(F.col("_gl") > 0, F.col("_gp") / F.col("_gl")).when(F.col("_gp") > 0, 9999.0).otherwise(0.0)
    streaks = longest_streaks(trades, keys, order, win)
    return g.withColumn("profit_factor", pf).drop("_gp", "_gl").join(streaks, keys)


def equity_curve(trades: DataFrame, keys: list[str], t: str, capital: float) -> DataFrame:
    """Capital plus cumulative PnL in cents; trades are summed per (key, t) first.
    Rounding keeps a day without PnL at a return of exactly zero."""
    daily = trades.groupBy(*keys, t).agg(F.sum("pnl").alias("pnl"))
    if hasattr(trades, "_size_bound"):
        daily = no_larger_than(daily, trades)
    if size_estimate(daily) >= SMALL_BYTES:      # readers of the curve don't sum the trades again
        daily = no_larger_than(checkpointed(daily), daily)
    eq = Series.of(daily, keys, [t]).running(_c=("sum", "pnl")).mutate(equity=F.round(capital + F.col("_c"), 2)).df.drop("_c")
    return no_larger_than(eq, daily)


def returns(eq: DataFrame, keys: list[str], t: str) -> Series:
    return Series.of(eq, keys, [t]).bounded(1, {"ret": lambda w: F.col("equity") / w.lag("equity") - 1})


def equity_metrics(eq: DataFrame, keys: list[str], t: str, year: float = 365.0, benchmark: Column | None = None) -> DataFrame:
    """Total and annualised return, Sharpe, Sortino, drawdown depth and length,
    Calmar, alpha and information ratio of an equity curve."""
    s = returns(eq, keys, t).running(_pk=("max", "equity"))
    s = s.mutate(_dd=(F.col("_pk") - F.col("equity")) / F.col("_pk"))
    s = s.running(_z=("max", F.when(F.col("_dd") == 0, F.col(IDX))))
    s = s.mutate(_len=F.when(F.col("_dd") > 0, F.col(IDX) - F.coalesce(F.col("_z"), F.lit(0))).otherwise(0))
    neg = F.when(F.col("ret") < 0, F.col("ret"))
    c = F.col
    g = s.rows.groupBy(*keys).agg(
        F.min_by("equity", t).alias("first"), F.max_by("equity", t).alias("last"), F.count(F.lit(1)).alias("bars"), F.count("ret").alias("_n"),
        F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_sd"), F.stddev_pop(neg).alias("_dsd"), F.max("_dd").alias("max_drawdown"), F.max("_len").alias("max_drawdown_bars"),
    )
    total = c("last") / c("first") - 1
    expo = F.lit(year) / c("bars")
    clamped = F.greatest(F.least(total, F.lit(100.0)), F.lit(-0.9999))
    annual = F.when((F.abs(total) > 100) | (expo > 5000), F.when(total > 0, 1000.0).otherwise(-0.99)).otherwise(F.pow(1 + clamped, expo) - 1)
    root = math.sqrt(year)
    g = g.withColumns(
        {
            "total_return": total, "annualised_return": annual,
            "sharpe": F.when(c("_sd") > 0, c("_m") / c("_sd") * root).otherwise(0.0),
            "sortino": F.when(c("_dsd") > 0, c("_m") / c("_dsd") * root).otherwise(0.0),
            "calmar": F.when(c("max_drawdown") > 0, annual / c("max_drawdown")).otherwise(0.0),
        }
    )
    b = F.lit(0.0) if benchmark is None else benchmark
    alpha = total - b
    # the benchmark is a constant per bar, so the active deviation is the return deviation
    te = F.when(c("_sd") > 0, c("_sd") * root).otherwise(1e-10)
    info = F.when(b != 0, alpha / c("_n") * year / te).otherwise(0.0)
    return g.withColumns({"alpha": alpha, "information_ratio": info}).drop("_m", "_sd", "_dsd", "_n")


def attribution(df: DataFrame, keys: list[str], ret: str, bench: str, year: float = 365.0) -> DataFrame:
    x = F.col(ret) - F.col(bench)
    root = math.sqrt(year)
    beta = F.when(F.var_samp(bench) > 0, F.covar_samp(ret, bench) / F.var_samp(bench)).otherwise(0.0)
    sd = F.stddev_pop(x)
    return df.groupBy(*keys).agg(
        beta.alias("beta"), ((F.avg(ret) - beta * F.avg(bench)) * year).alias("alpha"),
        F.when(sd > 0, sd * root).otherwise(0.0).alias("tracking_error"), F.when(sd > 0, F.avg(x) / sd * root).otherwise(0.0).alias("information_ratio"),
    )


def period_returns(eq: DataFrame, keys: list[str], t: str, period: Column) -> DataFrame:
    """Last over first equity of each period minus one."""
    return eq.groupBy(*keys, period.alias("period")).agg(
        F.when(F.min_by("equity", t) > 0, F.max_by("equity", t) / F.min_by("equity", t) - 1).alias("ret")
    )


def best_by_metric(report: DataFrame, id_col: str, metrics: dict[str, Column]) -> DataFrame:
    """Best id per metric: unpivot by literal array, then max_by."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
    return report.select(id_col, F.inline(rows)).groupBy("metric").agg(F.max(F.struct("value", id_col)).alias("_b")).select("metric", F.col(f"_b.{id_col}").alias("best"), F.col("_b.value").alias("value"))


def benchmarks(bars: DataFrame, key: str, t: str) -> DataFrame:
    """Buy-and-hold per symbol, then equal weight and best asset."""
    per = bars.groupBy(key).agg((F.max_by("close", t) / F.min_by("close", t) - 1).alias("hold"))
    return per.agg(F.avg("hold").alias("equal_weight"), F.max("hold").alias("best_asset_return"), F.max_by(key, "hold").alias("best_asset"), F.count(F.lit(1)).alias("assets"))


def prediction_metrics(df: DataFrame, keys: list[str], order: list[str], y: str, p: str) -> DataFrame:
    """mse, mae, rmse, r2 and the share of equal signs of change."""
    s = Series.of(df, keys, order).bounded(1, {"_dy": lambda w: F.signum(F.col(y) - w.lag(y)), "_dp": lambda w: F.signum(F.col(p) - w.lag(p))})
    e = F.col(y) - F.col(p)
    g = s.rows.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(y)).alias("_v"), F.avg(F.when(F.col("_dy") == F.col("_dp"), 1.0).when(F.col("_dy").isNotNull(), 0.0)).alias("direction_accuracy")
    )
    return g.withColumns({"rmse": F.sqrt("mse"), "r2": F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v"))}).drop("_v")


def walk_forward_rollup(folds: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """Out-of-sample loss, stability, trend, lag-1 autocorrelation and
    concordance (share of rising pairs) over folds.  Folds of one key are few;
    pairs come from an ordered array of them."""
    s = Series.of(folds, keys, [fold]).bounded(1, {"_p": lambda w: w.lag("loss")})
    g = s.df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("loss").alias("oos_loss"), F.stddev_pop("loss").alias("_sd"), F.regr_slope("loss", fold).alias("trend"), F.corr("loss", "_p").alias("autocorrelation"),
        F.transform(F.array_sort(F.collect_list(F.struct(fold, "loss"))), lambda x: x["loss"]).alias("_l"),
    )
    n = F.size("_l")
    ups = F.aggregate(
        F.sequence(F.lit(0), n - 2), F.lit(0.0),
        lambda a, i: a + F.size(F.filter(F.slice("_l", (i + 2).cast("int"), n), lambda v: v > F.get("_l", i.cast("int")))),
    )
    return g.select(*keys, "folds", "oos_loss", F.when(F.col("oos_loss") != 0, 1 - F.col("_sd") / F.abs("oos_loss")).alias("stability"), "trend", "autocorrelation", (ups / (n * (n - 1) / 2)).alias("concordance"))
