"""Feature statistics, drift tests and model monitoring over long-form tables
(feature, part, value) with part = reference / current."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.draws import erf
from tapeworks.plans.quantiles import exact_percentiles
from tapeworks.plans.series import IDX, Series


def long_form(df: DataFrame, keep: list, features: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in features.items()])
    return df.select(*keep, F.inline(rows))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def feature_stats(df: DataFrame) -> DataFrame:
    g = df.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("nan_count"), F.count_if(F.col("value") == 0).alias("zero_count"),
    )
    return g.join(exact_percentiles(df, ["feature"], "value", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}).drop("n"), "feature")


def quality_scores(df: DataFrame, batch: str, target: str) -> DataFrame:
    """Completeness, uniqueness, stability over batches, predictiveness."""
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v)
    cells = df.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))      # distinct values with counts: no per-group set
    uniq = cells.groupBy("feature").agg((F.count("value") / F.sum("_n")).alias("uniqueness"))
    comp = df.groupBy("feature").agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("completeness"), F.corr(v, F.col(target)).alias("_c"))
    per = df.groupBy("feature", batch).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    stab = per.groupBy("feature").agg((F.stddev_pop("_m") / (F.avg("_m") + 1e-8)).alias("_a"), (F.stddev_pop("_s") / (F.avg("_s") + 1e-8)).alias("_b"))
    x = comp.join(uniq, "feature").join(stab, "feature")
    stability = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), (F.col("_a") + F.col("_b")) / 2))
    x = x.withColumns({"stability": stability, "predictiveness": F.least(F.lit(1.0), 2 * F.abs("_c"))})
    return x.withColumn("overall", 0.3 * F.col("completeness") + 0.2 * F.col("uniqueness") + 0.3 * F.col("stability") + 0.2 * F.col("predictiveness")).drop("_a", "_b", "_c")


def psi(df: DataFrame, bins: int = 10) -> DataFrame:
    """Stability index against reference quantile bins: ``psi`` skips empty
    bins, ``psi_clipped`` floors shares at 1e-6."""
    ref = F.col("part") == "reference"
    cuts = [f"_q{k}" for k in range(1, bins)]
    edges = exact_percentiles(df.where(ref), ["feature"], "value", {c: k / bins for k, c in enumerate(cuts, 1)}).drop("n")
    x = df.join(F.broadcast(edges), "feature")      # one row per feature: the rows stay where they are
    at = sum((F.when(F.col("value") >= F.col(c), 1).otherwise(0) for c in cuts), F.lit(0))
    cell = x.groupBy("feature", at.alias("bin")).agg(F.count_if(ref).alias("_r"), F.count_if(~ref).alias("_c"))
    tot = cell.groupBy("feature").agg(F.sum("_r").alias("_nr"), F.sum("_c").alias("_nc"), F.count(F.lit(1)).alias("_k"))
    y = cell.join(tot, "feature")
    p, q = F.col("_r") / F.col("_nr"), F.col("_c") / F.col("_nc")
    pc, qc = F.greatest(p, F.lit(1e-6)), F.greatest(q, F.lit(1e-6))
    return y.groupBy("feature").agg(
        F.sum(F.when((p > 0) & (q > 0), (p - q) * F.log(p / q)).otherwise(0.0)).alias("psi"), F.sum((qc - pc) * F.log(qc / pc)).alias("psi_clipped")
    )


def rank_tests(df: DataFrame, **series_args) -> DataFrame:
    """Two-sample KS (exact statistic, asymptotic p) and rank-sum (average
    ranks for ties) per feature from one value-ordered pass over value counts.
    Products of counts are doubles: m * n * (m + n) passes a bigint from a few
    million rows a part."""
    ref = F.col("part") == "reference"
    cell = df.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count_if(ref).alias("_r"), F.count_if(~ref).alias("_c"))
    s = Series.of(cell, ["feature"], ["value"], **series_args).totals(m=F.sum("_r"), n=F.sum("_c")).running(_cr=("sum", "_r"), _cc=("sum", "_c"))
    x = s.df
    c = F.col
    here = c("_r") + c("_c")
    rank = c("_cr") + c("_cc") - here + (here + 1) / 2
    g = x.groupBy("feature", "m", "n").agg(F.max(F.abs(c("_cr") / c("m") - c("_cc") / c("n"))).alias("ks"), F.sum(c("_r") * rank).alias("rank_sum"))
    m, n = c("m").cast("double"), c("n").cast("double")
    ne = m * n / (m + n)
    lam = (F.sqrt(ne) + 0.12 + 0.11 / F.sqrt(ne)) * c("ks")
    series = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * F.col("_lam") * F.col("_lam")) for k in range(1, 101)), F.lit(0.0))
    z = (c("rank_sum") - m * (m + n + 1) / 2) / F.sqrt(m * n * (m + n + 1) / 12)
    g = g.withColumn("_lam", lam).withColumn("ks_p", F.when(c("_lam") < 0.01, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))).withColumn("rank_z", z)
    p = normal_cdf(c("rank_z"))
    return g.withColumn("rank_p", 2 * F.least(p, 1 - p)).withColumn("u_statistic", c("rank_sum") - m * (m + 1) / 2).drop("_lam")


def two_sample(df: DataFrame, keys: list[str], part: str, a: str, b: str, value: str) -> DataFrame:
    """Welch t with its degrees of freedom, Cohen's d and an effect label."""
    is_a, is_b = F.col(part) == a, F.col(part) == b
    v = F.col(value)
    g = df.groupBy(*keys).agg(
        F.count_if(is_a).alias("n1"), F.count_if(is_b).alias("n2"), F.avg(F.when(is_a, v)).alias("m1"), F.avg(F.when(is_b, v)).alias("m2"),
        F.var_samp(F.when(is_a, v)).alias("v1"), F.var_samp(F.when(is_b, v)).alias("v2"),
    )
    c = F.col
    s1, s2 = c("v1") / c("n1"), c("v2") / c("n2")
    pooled = F.sqrt(((c("n1") - 1) * c("v1") + (c("n2") - 1) * c("v2")) / (c("n1") + c("n2") - 2))
    d = F.when(pooled < 1e-10, 0.0).otherwise((c("m2") - c("m1")) / pooled)
    g = g.withColumns({"t": (c("m2") - c("m1")) / F.sqrt(s1 + s2), "dof": F.pow(s1 + s2, 2) / (s1 * s1 / (c("n1") - 1) + s2 * s2 / (c("n2") - 1)), "d": d})
    return g.withColumn("effect", F.when(F.abs("d") < 0.2, "negligible").when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large"))


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p of a t statistic (vectorised Arrow function: regularised
    incomplete beta by its continued fraction)."""
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        x = (n / (n + t * t)).to_numpy(float)
        a, b = n.to_numpy(float) / 2, np.full(len(n), 0.5)
        lg = np.vectorize(math.lgamma)
        swap = x > (a + 1) / (a + b + 2)
        xx, aa, bb = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
        d = 1 - (aa + bb) * xx / (aa + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c, h = np.ones_like(d), d.copy()
        for m in range(1, 300):
            for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
                d = 1 / (1 + num * d)
                c = 1 + num / c
                h *= d * c
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(aa * np.log(xx) + bb * np.log1p(-xx) - (lg(aa) + lg(bb) - lg(aa + bb))) / aa
        out = np.where(xx <= 0, 0.0, front * h)
        return pd.Series(np.where(swap, 1 - out, out))

    return p(t, dof)


def drift_verdict(ranks: DataFrame, psis: DataFrame, effect: DataFrame, alpha: float = 0.05, psi_limit: float = 0.2) -> DataFrame:
    """Any significant test is drift; severity by the smallest p and the PSI
    (medium reachable: p < 0.01 without a large PSI)."""
    c = F.col
    x = ranks.join(psis, "feature").join(effect, "feature")
    p = F.least("ks_p", "rank_p")
    drift = (c("ks_p") < alpha) | (c("rank_p") < alpha) | (c("psi") > psi_limit)
    sev = F.when(~drift, "none").when((p < 0.001) | (c("psi") > 0.3), "critical").when(c("psi") > 0.2, "high").when(p < 0.01, "medium").otherwise("low")
    return x.withColumns({"p_value": p, "is_drift": drift, "severity": sev})


def histogram(df: DataFrame, bins: int) -> DataFrame:
    """Shared-bin counts and densities of both parts."""
    span = df.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    x = df.join(F.broadcast(span), "feature")       # one row per feature: the rows stay where they are
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("_lo")) / width))).otherwise(0)
    cell = x.groupBy("feature", at.cast("int").alias("bin")).agg(F.count_if(F.col("part") == "reference").alias("ref_count"), F.count_if(F.col("part") != "reference").alias("cur_count"))
    tot = cell.groupBy("feature").agg(F.sum("ref_count").alias("_a"), F.sum("cur_count").alias("_b"))
    return cell.join(tot, "feature").select("feature", "bin", "ref_count", "cur_count", (F.col("ref_count") / F.col("_a")).alias("ref_share"), (F.col("cur_count") / F.col("_b")).alias("cur_share"))


def retrain_trigger(alerts: DataFrame, t: str, need: int, cooldown: int) -> DataFrame:
    """Times with enough drifting features, kept when the last kept one is at
    least ``cooldown`` away (an ordered pass over the few trigger times)."""
    from tapeworks.plans.fold import Machine, ordered_fold

    class Gap(Machine):
        last = None

        def row(self, at, n):
            if self.last is None or at - self.last >= cooldown:
                self.last = at
                yield at, n

    hits = alerts.groupBy("model", t).agg(F.count_distinct("feature").alias("n")).where(F.col("n") >= need)
    return ordered_fold(hits, ["model"], [t], [t, "n"], Gap, f"{t} bigint, features bigint")


def rolling_accuracy(preds: DataFrame, keys: list[str], order: list[str], last: int = 1000) -> DataFrame:
    """Accuracy of the latest ``last`` predictions and of the earlier ones, the
    relative drop and the two-proportion z."""
    s = Series.of(preds, keys, order).totals(_n=F.max(IDX))
    recent = F.col(IDX) > F.col("_n") - last
    hit = F.when(F.col("correct"), 1.0).otherwise(0.0)
    g = s.rows.groupBy(*keys).agg(F.avg(F.when(recent, hit)).alias("accuracy"), F.avg(F.when(~recent, hit)).alias("baseline"), F.count_if(recent).alias("samples"))
    p = (F.col("baseline") + F.col("accuracy")) / 2
    se = F.sqrt(p * (1 - p) * 2 / F.col("samples"))
    return g.withColumns({"drop": (F.col("baseline") - F.col("accuracy")) / F.col("baseline"), "z": F.when(se > 0, (F.col("baseline") - F.col("accuracy")) / se).otherwise(0.0)})


def reliability(preds: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Reliability bins (the last one closed) and their calibration gap."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("prob") * bins)).cast("int")
    return preds.groupBy(*keys, at.alias("bin")).agg(F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"), F.avg("prob").alias("confidence"), F.count(F.lit(1)).alias("n"))


def expected_calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))
