"""Series statistics.  Sums over rows are Spark aggregates; what is left per
series is a handful of numbers solved in NumPy per row of that aggregate."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.plans.recur import Affine, Filter
from tapeworks.plans.series import IDX, Series

c = lambda n: F.col(n)


def autocorrelation(s: Series, col: str, lags: int) -> DataFrame:
    """acf_1..acf_n per series: lagged products around the series mean."""
    s = s.totals(_m=F.avg(col)).mutate(_d=F.col(col) - c("_m"))
    s = s.bounded(lags, {f"_l{k}": (lambda w, k=k: w.lag("_d", k)) for k in range(1, lags + 1)})
    den = F.sum(c("_d") * c("_d"))
    return s.rows.groupBy(*s.keys).agg(*[(F.sum(c("_d") * c(f"_l{k}")) / den).alias(f"acf_{k}") for k in range(1, lags + 1)])


def partial_autocorrelation(acf: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """Levinson-Durbin on the acf columns, all series of a batch at once."""
    outs = [f"pacf_{k}" for k in range(1, lags + 1)]

    def solve(batches):
        for b in batches:
            r = np.column_stack([np.ones(b.num_rows)] + [b.column(f"acf_{k}").to_numpy(zero_copy_only=False) for k in range(1, lags + 1)])
            phi, out = np.zeros((b.num_rows, lags + 1)), []
            v = np.ones(b.num_rows)
            for k in range(1, lags + 1):
                a = (r[:, k] - (phi[:, 1:k] * r[:, k - 1:0:-1]).sum(axis=1)) / v
                phi[:, 1:k] = phi[:, 1:k] - a[:, None] * phi[:, k - 1:0:-1]
                phi[:, k] = a
                v = v * (1 - a * a)
                out.append(a)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(x) for x in out], names=[*keys, *outs])

    ddl = ", ".join([f"{k} {acf.schema[k].dataType.simpleString()}" for k in keys] + [f"{o} double" for o in outs])
    return acf.mapInArrow(solve, ddl)


def jarque_bera(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    n, k3, k4 = F.count(col), F.skewness(col), F.kurtosis(col)
    g = df.groupBy(*keys).agg((n / 6 * (k3 * k3 + k4 * k4 / 4)).alias("jb"))
    return g.withColumn("p_value", F.exp(-c("jb") / 2))          # chi-square, 2 degrees of freedom


def least_squares(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """OLS per group from one pass of Gram sums: coefficients, standard errors,
    residual sum of squares and row count."""
    names = [*xs, y]
    ok = F.lit(True)
    for v in names:
        ok = ok & c(v).isNotNull()
    aggs = [F.sum(c(a) * c(b)).alias(f"_g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    g = df.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    p = len(xs)
    outs = [f"b_{x}" for x in xs] + [f"se_{x}" for x in xs] + ["rss"]

    def solve(batches):
        for b in batches:
            m = np.zeros((b.num_rows, p + 1, p + 1))
            for i in range(p + 1):
                for j in range(i, p + 1):
                    m[:, i, j] = m[:, j, i] = b.column(f"_g{i}_{j}").to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy(zero_copy_only=False).astype(float)
            # scale the columns so that prices and constants are comparable
            d = np.sqrt(np.maximum(np.einsum("nii->ni", m[:, :p, :p]), 1e-300))
            inv = np.linalg.pinv(m[:, :p, :p] / d[:, :, None] / d[:, None, :]) / d[:, :, None] / d[:, None, :]
            beta = np.einsum("nij,nj->ni", inv, m[:, :p, p])
            rss = np.maximum(m[:, p, p] - np.einsum("ni,ni->n", beta, m[:, :p, p]), 0)
            se = np.sqrt(np.einsum("nii->ni", inv) * (rss / np.maximum(n - p, 1))[:, None])
            arr = [b.column(k) for k in keys] + [b.column("n")] + [pa.array(x) for x in [*beta.T, *se.T, rss]]
            yield pa.RecordBatch.from_arrays(arr, names=[*keys, "n", *outs])

    ddl = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["n bigint"] + [f"{o} double" for o in outs])
    return g.mapInArrow(solve, ddl)


def unit_root(s: Series, col: str) -> DataFrame:
    """Augmented unit-root regression with one lagged difference; the level is
    centred on the series mean first (the constant absorbs it)."""
    s = s.totals(_m=F.avg(col)).mutate(_y=F.col(col) - c("_m"), one=F.lit(1.0))
    s = s.bounded(2, {"level": lambda w: w.lag("_y"), "dy": lambda w: c("_y") - w.lag("_y"), "dlag": lambda w: w.lag("_y") - w.lag("_y", 2)})
    g = least_squares(s.rows, s.keys, "dy", ["one", "level", "dlag"])
    return g.select(*s.keys, "n", c("b_level").alias("rho"), (c("b_level") / c("se_level")).alias("t_stat"))


def phillips_perron(s: Series, col: str, bandwidth: int = 4) -> DataFrame:
    """Regression on the lag with a Bartlett-weighted correction."""
    s = s.totals(_m=F.avg(col)).mutate(_y=F.col(col) - c("_m"), one=F.lit(1.0)).bounded(1, {"_p": lambda w: w.lag("_y")})
    g = least_squares(s.rows, s.keys, "_y", ["one", "_p"])
    x = s.rows.join(g, s.keys).withColumn("_e", c("_y") - c("b_one") - c("b__p") * c("_p")).drop(IDX).where("_p is not null")
    e = Series.of(x, s.keys, s.order).bounded(bandwidth, {f"_e{k}": (lambda w, k=k: w.lag("_e", k)) for k in range(1, bandwidth + 1)})
    a = e.rows.groupBy(*s.keys, "n", "b__p", "se__p", "rss").agg((F.sum(c("_e") * c("_e")) / c("n")).alias("g0"), *[(F.sum(c("_e") * c(f"_e{k}")) / c("n")).alias(f"g{k}") for k in range(1, bandwidth + 1)])
    lam = c("g0") + sum((2 * (1 - k / (bandwidth + 1)) * c(f"g{k}") for k in range(1, bandwidth + 1)), F.lit(0.0))
    s2 = c("rss") / (c("n") - 2)
    t = (c("b__p") - 1) / c("se__p")
    z = F.sqrt(c("g0") / lam) * t - 0.5 * (lam - c("g0")) / F.sqrt(lam) * c("n") * c("se__p") / F.sqrt(s2)
    return a.select(*s.keys, z.alias("z_t"), c("b__p").alias("rho"))


def variance_ratios(s: Series, col: str, horizons: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    s = s.mutate(_l=F.log(F.col(col)))
    s = s.bounded(max(horizons), {f"_d{q}": (lambda w, q=q: c("_l") - w.lag("_l", q)) for q in (1, *horizons)})
    return s.rows.groupBy(*s.keys).agg(*[(F.var_samp(f"_d{q}") / (q * F.var_samp("_d1"))).alias(f"vr_{q}") for q in horizons])


def granger(s: Series, y: str, x: str, lags: int) -> DataFrame:
    """F statistic of x's lags in a regression of y on its own lags."""
    cols = {f"y{k}": (lambda w, k=k: w.lag(y, k)) for k in range(1, lags + 1)} | {f"x{k}": (lambda w, k=k: w.lag(x, k)) for k in range(1, lags + 1)}
    s = s.mutate(one=F.lit(1.0)).bounded(lags, cols)
    own, both = ["one"] + [f"y{k}" for k in range(1, lags + 1)], ["one"] + list(cols)
    a = least_squares(s.rows, s.keys, y, own).select(*s.keys, c("rss").alias("rss0"))
    b = least_squares(s.rows, s.keys, y, both).select(*s.keys, "n", c("rss").alias("rss1"))
    dof = c("n") - 2 * lags - 1
    return a.join(b, s.keys).select(*s.keys, "n", ((c("rss0") - c("rss1")) / lags / (c("rss1") / dof)).alias("f_stat"))


def garch_fit(s: Series, ret: str, grid: list[tuple[float, float]]) -> DataFrame:
    """GARCH(1,1) with targeted long-run variance: every (alpha, beta) of the
    grid is one affine recurrence of the same pass; the best likelihood wins."""
    s = s.totals(_v=F.var_pop(ret)).bounded(1, {"_p": lambda w: w.lag(ret)})

    def path(a: float, b: float):
        def coef(v, i):
            w = v["_v"] * (1 - a - b)
            p = np.nan_to_num(v["_p"])
            return np.where(i == 1, 0.0, b), np.where(i == 1, v["_v"], w + a * p * p)
        return coef

    s = s.scan(*[Affine(f"_h{j}", path(a, b)) for j, (a, b) in enumerate(grid)])
    ll = [F.sum(F.log(c(f"_h{j}")) + c(ret) * c(ret) / c(f"_h{j}")).alias(f"_s{j}") for j in range(len(grid))]
    last = [F.max_by(f"_h{j}", F.struct(*s.order)).alias(f"_e{j}") for j in range(len(grid))]
    g = s.rows.groupBy(*s.keys).agg(F.first("_v").alias("long_run"), F.max_by(ret, F.struct(*s.order)).alias("last_ret"), *ll, *last)
    pick = F.array_min(F.array(*[F.struct(c(f"_s{j}").alias("s"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), c(f"_e{j}").alias("h")) for j, (a, b) in enumerate(grid)]))
    return g.withColumn("_b", pick).select(*s.keys, "long_run", "last_ret", c("_b.alpha").alias("alpha"), c("_b.beta").alias("beta"), c("_b.h").alias("variance"), (-0.5 * c("_b.s")).alias("loglik"))


def garch_forecast(fit: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Closed-form multi-step variance, one row per step."""
    p = c("alpha") + c("beta")
    first = c("long_run") * (1 - p) + c("alpha") * c("last_ret") * c("last_ret") + c("beta") * c("variance")
    x = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return x.select(*keys, "step", (c("long_run") + F.pow(p, c("step") - 1) * (first - c("long_run"))).alias("variance"))


def local_level(s: Series, col: str, q: float = 1e-2, r_: float = 1.0) -> Series:
    """Kalman trend: the gain path does not depend on the data, so the filter
    is an affine recurrence with a gain table that settles quickly."""
    gains, p = [], 1.0
    for _ in range(500):
        p = p + q
        k = p / (p + r_)
        gains.append(k)
        p = (1 - k) * p
    table = np.array(gains)

    def coef(v, i):
        k = table[np.minimum(i.astype(int) - 2, len(table) - 1).clip(0)]
        return np.where(i == 1, 0.0, 1 - k), np.where(i == 1, v[col], k * v[col])

    return s.scan(Affine("trend", coef))


def hedge_ratio(s: Series, y: str, x: str, q: float = 1e-5, r_: float = 1e-2, least: int = 10) -> Series:
    """Intercept and slope of y on x as two random walks (variance ``q`` a step,
    ``r_`` of an observation), filtered row by row from intercept 0, slope 1 and
    unit covariance.  The covariance depends on x, so there is no gain table:
    each row is a map of (mean, covariance), and maps compose (recur.Filter).
    Series of fewer than ``least`` rows keep slope 1 and intercept 0.
    """
    def coef(v, i):
        a, b = v[y], v[x]
        first = i == 1
        p = np.where(first, 1 + q, q)             # predicted variance of what is new
        d = p * (1 + b * b) + r_
        z = np.zeros(len(i))
        later = lambda value: np.where(first, 0.0, value)
        k0, k1, gap = p / d, p * b / d, np.where(first, a - b, a)
        # differences such as 1 - p / d are written as sums of positive terms
        keep0, keep1, cross = (p * b * b + r_) / d, (p + r_) / d, -p * b / d
        return (
            later(keep0), later(cross), later(cross), later(keep1), k0 * gap, np.where(first, 1.0, 0.0) + k1 * gap,
            p * keep0, p * cross, p * keep1, later(a / d), later(a * b / d), later(1 / d) + z, later(b / d), later(b * b / d),
        )

    s = s.totals(_n=F.count(F.lit(1))).scan(Filter("_icpt", coef, ("_slope",)))
    enough = c("_n") >= least
    s = s.mutate(hedge_ratio=F.when(enough, c("_slope")).otherwise(1.0), intercept=F.when(enough, c("_icpt")).otherwise(0.0))
    return s._with(s.rows.drop("_n", "_icpt", "_slope"))


def haar_energy(s: Series, col: str, levels: int) -> DataFrame:
    """Energy of the Haar details per level: each level pairs neighbours by
    index.  A level's pairs lie 2**(level - 1) rows apart, so all levels are
    bounded looks ahead in one ordered pass; a pair that is not whole is null."""
    looks = []
    for lv in range(1, levels + 1):
        v, step = (F.col(col) if lv == 1 else c(f"_a{lv - 1}")), 1 << (lv - 1)
        other = lambda w, v=v, step=step: w.lead(v, step)
        looks.append({f"_d{lv}": (lambda w, v=v, other=other: (v - other(w)) / math.sqrt(2)), f"_a{lv}": (lambda w, v=v, other=other: (v + other(w)) / math.sqrt(2))})
    rows = s.bounded(0, *looks, ahead=(1 << levels) - 1).rows
    own = lambda lv: F.when((c(IDX) - 1) % (1 << lv) == 0, c(f"_d{lv}"))
    g = rows.groupBy(*s.keys).agg(*[x for lv in range(1, levels + 1) for x in (F.sum(F.pow(own(lv), 2)).alias(f"_e{lv}"), F.count(own(lv)).alias(f"_n{lv}"))])
    each = F.array(*[F.struct(c(f"_e{lv}").alias("energy"), c(f"_n{lv}").alias("n"), F.lit(lv).alias("level")) for lv in range(1, levels + 1)])
    return g.select(*s.keys, F.inline(each)).where("n > 0")


def haar_denoise(s: Series, col: str, limit: float) -> Series:
    """One-level soft threshold of details, then the true inverse."""
    s = s.bounded(1, {"_nx": lambda w: w.lead(col), "_pv": lambda w: w.lag(col)}, ahead=1)
    odd = c(IDX) % 2 == 1
    a, b = F.when(odd, F.col(col)).otherwise(c("_pv")), F.when(odd, c("_nx")).otherwise(F.col(col))
    ap, d = (a + b) / math.sqrt(2), (a - b) / math.sqrt(2)
    soft = F.signum(d) * F.greatest(F.abs(d) - limit, F.lit(0.0))
    y = F.when(b.isNull(), F.col(col)).when(odd, (ap + soft) / math.sqrt(2)).otherwise((ap - soft) / math.sqrt(2))
    return s._with(s.mutate(denoised=y).rows.drop("_nx", "_pv"))


# The published coefficients of the normal quantile's rational
# approximation (middle: over and under the line, then the same for the sides).
PROBIT = (
    [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239],
    [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572],
    [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783],
    [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416],
)


def probit(p: Column) -> Column:
    """Normal quantile by rational approximation (relative error 1e-9)."""
    a, b, cc, d = PROBIT

    def poly(x, ks, tail=None):
        out = F.lit(ks[0])
        for k in ks[1:]:
            out = out * x + k
        return out

    q = p - 0.5
    r2 = q * q
    mid = poly(r2, a) * q / (poly(r2, b) * r2 + 1)
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    side = lambda x: poly(x, cc) / (poly(x, d) * x + 1)
    return F.when(p < 0.02425, side(low)).when(p > 1 - 0.02425, -side(high)).otherwise(mid)


def uniform_ranks(df: DataFrame, keys: list[str], col: str, ties: list[str]) -> DataFrame:
    s = Series.of(df, keys, [col, *ties]).totals(_n=F.count(F.lit(1)))
    return s.rows.withColumn("u", c(IDX) / (c("_n") + 1)).drop(IDX, "_n")


TOGETHER = 1 << 16          # rows of whole series that are taken together


def _swaps(n_keys: int, batches):
    """n, discordant pairs and pairs tied in x, y and both of each series; rows come
    sorted by keys, rank of x and rank of y."""
    def done(t: pa.Table, new: np.ndarray):
        k, u, v = np.cumsum(new) - 1, t.column("_u").to_numpy(), t.column("_v").to_numpy()
        n = np.bincount(k)
        swapped = np.zeros(len(n))
        for b in range(int(v.max()).bit_length()):
            at = np.lexsort((v >> (b + 1), k))
            one, of, above = (v[at] >> b) & 1, k[at], v[at] >> (b + 1)
            start = np.concatenate(([True], (of[1:] != of[:-1]) | (above[1:] != above[:-1])))
            ones = np.cumsum(one)
            before = ones - np.repeat((ones - one)[start], np.diff(np.append(np.flatnonzero(start), len(at))))
            swapped += np.bincount(of, np.where(one == 0, before, 0), len(n))

        def tied(*by):
            at = np.lexsort((*by, k))
            cut = np.concatenate(([True], np.any([x[at][1:] != x[at][:-1] for x in (k, *by)], axis=0)))
            first = np.flatnonzero(cut)
            size = np.diff(np.append(first, len(at))).astype(float)
            return pa.array(np.bincount(k[at][first], size * (size - 1) / 2, len(n)))

        keys = t.select(range(n_keys)).take(pa.array(np.flatnonzero(new))).combine_chunks()
        cols = [pa.array(n), pa.array(swapped), tied(u), tied(v), tied(u, v)]
        return pa.table([*keys.columns, *cols], names=[*keys.column_names, "n", "_d", "_n1", "_n2", "_n3"]).to_batches()

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for i in range(n_keys):
            d = t.column(i).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= d[1:] != d[:-1]
        return new

    held, size, want = [], 0, TOGETHER
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < want:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = starts(t)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield from done(t.slice(0, last), new[:last])
        held = t.slice(last).to_batches()
        size = t.num_rows - last
        want = max(TOGETHER, 2 * size)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from done(t, starts(t))


def kendall(s: Series, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns in each series: keys, n, tau.

    Discordant pairs are the inversions of y's ranks in the order of x.  They are
    counted bit by bit: of rows that agree above a bit, each row without the bit
    is inverted with the rows before it that have it, so no pair is formed.  Series
    that fit a task pass one sort, whole ones at a time; in long ones, sliced as any
    other, every bit is a running count.
    """
    rows = s.df.where(c(x).isNotNull() & c(y).isNotNull()).select(*s.keys, c(x).alias("_x"), c(y).alias("_y"), *s.order)
    if not s.blocked:
        y = Window.partitionBy(*s.keys).orderBy("_y")
        ranks = rows.withColumn("_v", F.dense_rank().over(y).cast("bigint")).withColumn("_u", F.dense_rank().over(Window.partitionBy(*s.keys).orderBy("_x")).cast("bigint"))
        keyed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*s.keys).schema.fields)
        # the windows have put each series into one task
        g = ranks.sortWithinPartitions(*s.keys, "_u", "_v").select(*s.keys, "_u", "_v").mapInArrow(partial(_swaps, len(s.keys)), f"{keyed}, n bigint, _d double, _n1 double, _n2 double, _n3 double")
        for k in s.keys:
            g = g.where(c(k).isNotNull())
        return _tau(g, s.keys)
    ties = lambda *by: rows.groupBy(*s.keys, *by).agg(F.count(F.lit(1)).alias("_k")).groupBy(*s.keys).agg(F.sum(c("_k") * (c("_k") - 1) / 2).alias("_t"))
    ranked = Series.of(rows, s.keys, ["_y", *s.order]).bounded(1, {"_new": lambda w: F.when(w.lag("_y") == c("_y"), 0).otherwise(1)}).running(_v=("sum", "_new"))
    n = rows.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n")).first()[0] or 1
    bits = F.sequence(F.lit(0), F.lit(max(1, int(top).bit_length())))
    at = ranked.df.withColumn("_b", F.explode(bits)).withColumn("_g", F.expr("shiftright(_v, _b + 1)")).withColumn("_one", F.expr("shiftright(_v, _b) % 2"))
    run = Series.of(at, [*s.keys, "_b", "_g"], ["_x", "_y", *s.order]).running(_ones=("sum", "_one"))
    swapped = run.df.groupBy(*s.keys).agg(F.sum(F.when(c("_one") == 0, c("_ones")).otherwise(0)).alias("_d"))
    g = n.join(swapped, s.keys)
    for name, by in (("_n1", ["_x"]), ("_n2", ["_y"]), ("_n3", ["_x", "_y"])):
        g = g.join(ties(*by).withColumnRenamed("_t", name), s.keys)
    return _tau(g, s.keys)


def _tau(g: DataFrame, keys: list[str]) -> DataFrame:
    all_ = c("n") * (c("n") - 1) / 2
    agree = all_ - c("_n1") - c("_n2") + c("_n3") - c("_d")
    free = (all_ - c("_n1")) * (all_ - c("_n2"))
    return g.select(*keys, "n", F.when(free > 0, (agree - c("_d")) / F.sqrt(free)).alias("tau"))


def t_copula_freedom(scores: DataFrame, at: str, score: str) -> DataFrame:
    """n, kurtosis, df: degrees of freedom from the excess kurtosis of the mean
    normal score at each ``at``."""
    m = scores.groupBy(at).agg(F.avg(score).alias("_m"))
    g = m.agg(F.count(F.lit(1)).alias("n"), F.kurtosis("_m").alias("kurtosis"))
    return g.withColumn("df", F.when(c("kurtosis") > 0, F.greatest(F.lit(2.5), 6 / c("kurtosis") + 4)).otherwise(10.0))
