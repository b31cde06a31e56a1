"""Wavelet transforms with an 8-tap filter pair, level by level, and their inverse.

A level halves a series: output j is the filter over rows 2j .. 2j + 7, the series
taken as a circle.  The few rows that cross its end are copied there, the rest is
a bounded look ahead, so long series are sliced as any other.  Series are padded
with zeros by a filter length, and on to a multiple of 2**levels, so that every
level has an even length and the inverse is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.series import IDX, Series
from tapeworks.session import checkpointed

c = lambda n: F.col(n)

# The low-pass filter with four vanishing moments.
LOW = (0.2303778133088964, 0.7148465705529154, 0.6308807679398587, -0.0279837694168599, -0.1870348117190931, 0.0308413818355607, 0.0328830116668852, -0.0105974017850690)
TAPS = len(LOW)
#: The high-pass filter is the low-pass one reversed with alternating signs.
HIGH = tuple((-1) ** k * LOW[TAPS - 1 - k] for k in range(TAPS))


def _weighted(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def padded(s: Series, col: str, levels: int) -> DataFrame:
    """keys, i (from 0), v, n (padded length), rows (own length)."""
    x = s.totals(rows=F.count(F.lit(1))).rows.select(*s.keys, (c(IDX) - 1).alias("i"), F.col(col).cast("double").alias("v"), "rows")
    unit = 1 << levels
    size = (F.ceil((c("rows") + TAPS) / unit) * unit).cast("bigint")
    x = x.withColumn("n", size)
    tail = x.where(c("i") == c("rows") - 1).withColumn("i", F.explode(F.sequence(c("rows"), c("n") - 1))).withColumn("v", F.lit(0.0))
    return x.unionByName(tail)


def split(x: DataFrame, keys: list[str]) -> DataFrame:
    """One level: keys, i, approx, detail, n, rows; n is halved."""
    over = x.where(c("i") < TAPS - 2).withColumn("i", c("i") + c("n"))
    s = Series.of(x.unionByName(over), keys, ["i"]).bounded(0, {f"_x{k}": (lambda w, k=k: w.lead("v", k)) for k in range(1, TAPS)}, ahead=TAPS - 1)
    at = [c("v"), *[c(f"_x{k}") for k in range(1, TAPS)]]
    even = s.df.where((c("i") % 2 == 0) & (c("i") < c("n")))
    return even.select(*keys, F.expr("i div 2").alias("i"), _weighted([h * a for h, a in zip(LOW, at)]).alias("approx"), _weighted([g * a for g, a in zip(HIGH, at)]).alias("detail"), F.expr("n div 2").alias("n"), "rows")


def joined(x: DataFrame, keys: list[str]) -> DataFrame:
    """The level above a level (keys, i, approx, detail, n, rows): keys, i, v, n, rows."""
    half = TAPS // 2
    over = x.where(c("i") >= c("n") - (half - 1)).withColumn("i", c("i") - c("n"))
    back = {f"_{n}{k}": (lambda w, n=n, k=k: w.lag(n, k)) for n in ("approx", "detail") for k in range(1, half)}
    s = Series.of(x.unionByName(over), keys, ["i"]).bounded(half - 1, back)
    a, d = (["approx", *[f"_approx{k}" for k in range(1, half)]], ["detail", *[f"_detail{k}" for k in range(1, half)]])
    value = lambda odd: _weighted([LOW[2 * k + odd] * c(a[k]) + HIGH[2 * k + odd] * c(d[k]) for k in range(half)])
    rows = F.array(*[F.struct((2 * c("i") + odd).alias("i"), value(odd).alias("v")) for odd in (0, 1)])
    return s.df.where("i >= 0").select(*keys, F.inline(rows), (2 * c("n")).alias("n"), "rows")


def transform(s: Series, col: str, levels: int) -> list[DataFrame]:
    """One table a level, from the finest; see :func:`split`.  A level is stored,
    as the next one and the way back read it again."""
    out, cur = [], padded(s, col, levels)
    for _ in range(levels):
        out.append(checkpointed(split(cur, s.keys)))
        cur = out[-1].withColumnRenamed("approx", "v").drop("detail")
    return out


def restored(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys, i, v of the series behind the tables of :func:`transform`."""
    cur = None
    for t in reversed(tables):
        if cur is not None:
            t = t.drop("approx").join(cur.select(*keys, "i", c("v").alias("approx")), [*keys, "i"])
        cur = checkpointed(joined(t.select(*keys, "i", "approx", "detail", "n", "rows"), keys))
    return cur.where(c("i") < c("rows")).select(*keys, "i", "v")


def denoised(s: Series, col: str, levels: int, limit: float) -> DataFrame:
    """keys, order columns and the series without details up to ``limit`` (soft)."""
    soft = F.signum("detail") * F.greatest(F.abs("detail") - limit, F.lit(0.0))
    back = restored([t.withColumn("detail", soft) for t in transform(s, col, levels)], s.keys)
    return s.rows.select(*s.keys, *s.order, (c(IDX) - 1).alias("i")).join(back, [*s.keys, "i"]).drop("i").withColumnRenamed("v", "denoised")
