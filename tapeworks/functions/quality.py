"""Row filters and quality classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.fold import Machine, ordered_fold
from tapeworks.plans.quantiles import exact_percentiles
from tapeworks.plans.series import IDX, Series


def listing(df: DataFrame, equals: dict[str, object] | None = None, sort: str | None = None, descending: bool = True, offset: int = 0, limit: int | None = None, ties: list[str] = ()) -> DataFrame:
    """Optional equality filters, sort by a named column, paging (top-k plan)."""
    for k, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(k) == v)
    if sort:
        df = df.orderBy(F.desc(sort) if descending else F.asc(sort), *ties)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def tick_issues(s: Series, ts: str = "ts", stale_days: int = 30, jump: float = 0.10) -> Series:
    """List of issues per tick: bad price, bad quantity, stale, jump.

    Staleness is measured to the newest tick of the table's series."""
    s = s.totals(_now=F.max(ts)).bounded(1, {"_prev": lambda w: w.lag("price")})
    issue = lambda cond, text: F.when(cond, F.lit(text))
    prev = F.col("_prev")
    found = F.array_compact(
        F.array(
            issue(F.col("price") <= 0, "price"), issue(F.col("qty") <= 0, "quantity"),
            issue(F.date_diff(F.col("_now"), F.col(ts)) > stale_days, "stale"),
            issue((prev > 0) & (F.abs(F.col("price") - prev) / prev > jump), "jump"),
        )
    )
    s = s.mutate(issues=found)
    return s._with(s.rows.drop("_now", "_prev"))


class _Reference(Machine):
    """Keeps the last price that was accepted; a suspicious price does not move it."""

    def __init__(self, limit: float):
        self.ref, self.limit = None, limit

    def row(self, price, qty, lo, hi):
        if price is None or price <= 0:
            yield ("invalid",)
        elif self.ref is not None and abs(price - self.ref) / self.ref * 100 > self.limit:
            yield ("suspicious",)
        else:
            self.ref = price
            yield ("suspicious" if qty < lo or qty > hi else "valid",)


def quality_class(ticks: DataFrame, keys: list[str], order: list[str], deviation_pct: float = 50.0, min_qty: float = 0.0, max_qty: float = 1e12) -> DataFrame:
    df = ticks.withColumns({"_lo": F.lit(min_qty), "_hi": F.lit(max_qty)})
    return ordered_fold(df, keys, order, ["price", "qty", "_lo", "_hi"], lambda: _Reference(deviation_pct), "quality string")


def running_outliers(s: Series, value: str, warm: int = 30, limit: float = 5.0) -> Series:
    """Samples far from the mean of the earlier ones, after ``warm`` samples."""
    s = s.running(_s=("sum", value), _q=("sum", F.col(value) * F.col(value)))
    n = F.col(IDX) - 1
    m = (F.col("_s") - F.col(value)) / n
    var = F.greatest((F.col("_q") - F.col(value) * F.col(value)) / n - m * m, F.lit(0.0)) * n / (n - 1)
    z = (F.col(value) - m) / F.greatest(F.sqrt(var), F.lit(1e-8))
    s = s.mutate(z=F.when(n >= warm, z))
    s = s.mutate(outlier=F.coalesce(F.abs(F.col("z")) > limit, F.lit(False)))
    return s._with(s.rows.drop("_s", "_q"))


def array_range_ok(features: Column, nan_share: float = 0.1, bound: float = 1e6) -> Column:
    bad = F.size(F.filter(features, lambda x: x.isNull() | F.isnan(x)))
    inside = F.forall(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) <= bound))
    return (bad <= nan_share * F.size(features)) & inside


def standardise(df: DataFrame, cols: list[str], clip: float = 5.0) -> DataFrame:
    """NaN fill with 0, z-score with the table's own moments (std < 1e-8 -> 1),
    clip.  The moments are one row, attached by a one-row broadcast."""
    st = df.agg(*[x for c in cols for x in (F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(f"_m_{c}"), F.stddev_pop(F.nanvl(c, F.lit(None).cast("double"))).alias(f"_s_{c}"))])
    x = df.join(F.broadcast(st), F.lit(True))
    for c in cols:
        sd = F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}"))
        v = F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))
        x = x.withColumn(c, F.greatest(F.lit(-clip), F.least(F.lit(clip), (v - F.col(f"_m_{c}")) / sd)))
    return x.select(*df.columns)


def confidence(pred: Column, how: str) -> Column:
    """Confidence of a prediction array: softmax, sigmoid or magnitude."""
    if how == "softmax":
        top = F.array_max(pred)
        e = F.aggregate(pred, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return 1.0 / (e + 1e-8)
    if how == "sigmoid":
        return 1.0 / (1.0 + F.exp(-F.array_max(pred)))
    n = F.size(pred)
    mean = F.aggregate(pred, F.lit(0.0), lambda a, x: a + F.abs(x)) / n
    var = F.aggregate(pred, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) - mean, 2)) / n
    m, sd = mean + 1e-8, F.sqrt(var) + 1e-8
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), m / (m + sd)))


def distance_anomalies(df: DataFrame, cols: list[str], pct: float = 0.95) -> DataFrame:
    """Standardised distance to the mean; flag above the exact percentile."""
    st = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    x = df.join(F.broadcast(st), F.lit(True))
    dist = F.sqrt(sum((F.pow((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-10), 2) for c in cols), F.lit(0.0)))
    x = x.withColumn("distance", dist).select(*df.columns, "distance")
    cut = exact_percentiles(x, [], "distance", {"threshold": pct}).select("threshold")
    return x.join(F.broadcast(cut), F.lit(True)).withColumn("anomaly", F.col("distance") > F.col("threshold"))


def with_fallback(df: DataFrame, keep: Column) -> DataFrame:
    """Rows that satisfy ``keep``; all rows when none does (one-row flag)."""
    some = df.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("_some"))
    return df.join(F.broadcast(some), F.lit(True)).where(keep | ~F.col("_some")).drop("_some")
