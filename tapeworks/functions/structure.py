"""Levels, candlestick patterns, drawdowns, quality checks, statistics."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.bar import B
from tapeworks.functions.oscillators import _drop
from tapeworks.plans.fold import Machine, ordered_fold
from tapeworks.plans.quantiles import exact_percentiles
from tapeworks.plans.recur import Affine
from tapeworks.plans.series import IDX, Series


# --- pivots and retracements -----------------------------------------------------------
def pivot_points(s: Series) -> DataFrame:
    """Four pivot families from the previous bar, one row per (bar, method)."""
    s = s.bounded(1, {"_h": lambda w: w.lag("high"), "_l": lambda w: w.lag("low"), "_c": lambda w: w.lag("close")})
    h, l, c = F.col("_h"), F.col("_l"), F.col("_c")
    p, d = (h + l + c) / 3, h - l
    pw = (h + l + 2 * c) / 4

    def row(method, pivot, downs, ups):
        fields = [F.lit(method).alias("method"), pivot.alias("pivot")]
        fields += [x.alias(f"s{j}") for j, x in enumerate(downs, 1)] + [x.alias(f"r{j}") for j, x in enumerate(ups, 1)]
        return F.struct(*fields)

    fib = [0.382, 0.618, 1.0, 1.382]
    cam = [1.1 / 12, 1.1 / 6, 1.1 / 4, 1.1 / 2]
    s1, r1 = 2 * pw - h, 2 * pw - l
    rows = F.array(
        row("traditional", p, [2 * p - h, p - d, l - 2 * (h - p), l - 2 * (h - p) - d], [2 * p - l, p + d, h + 2 * (p - l), h + 2 * (p - l) + d]),
        row("fibonacci", p, [p - f * d for f in fib], [p + f * d for f in fib]),
        row("camarilla", p, [c - f * d for f in cam], [c + f * d for f in cam]),
        row("woodie", pw, [s1, pw - d, s1 - d, pw - 2 * d], [r1, pw + d, r1 + d, pw + 2 * d]),
    )
    return s.df.where("_c is not null").select(*s.keys, *s.order, F.inline(rows))


FIB_BACK = (0.236, 0.382, 0.5, 0.618, 0.786)
FIB_BEYOND = (0.272, 0.618, 1.0, 1.618)


def fibonacci(s: Series, n: int = 100) -> Series:
    i = F.col(IDX)
    top = lambda w: F.max(F.struct(B.h.alias("p"), (-i).alias("j"))).over(w(n))
    bot = lambda w: F.min(F.struct(B.l.alias("p"), i.alias("j"))).over(w(n))
    s = s.bounded(n - 1, {"_t": top, "_b": bot})
    hi, lo = F.col("_t.p"), F.col("_b.p")
    ok = (i >= 10) & (hi > lo)
    up = -F.col("_t.j") > F.col("_b.j")
    d = hi - lo
    cols = {"fib_up": F.when(ok, up), "swing_high": F.when(ok, hi), "swing_low": F.when(ok, lo)}
    cols |= {f"back_{int(f * 1000)}": F.when(ok, hi - f * d) for f in FIB_BACK}
    cols |= {f"beyond_{int(f * 1000)}": F.when(ok, F.when(up, lo - f * d).otherwise(hi + f * d)) for f in FIB_BEYOND}
    return _drop(s.mutate(**cols), "_t", "_b")


def fractals(s: Series, n: int = 5) -> DataFrame:
    """Bars whose high (low) is not exceeded by ``n`` bars on each side."""
    full = lambda w: F.count(F.lit(1)).over(w.span(-n, n)) == 2 * n + 1
    s = s.bounded(
        n,
        {
            "_hi": lambda w: F.when(full(w) & (B.h >= F.max("high").over(w.span(-n, n))), B.h),
            "_lo": lambda w: F.when(full(w) & (B.l <= F.min("low").over(w.span(-n, n))), B.l),
        },
        ahead=n,
    )
    sides = F.array(F.struct(F.lit("resistance").alias("kind"), F.col("_hi").alias("level")), F.struct(F.lit("support").alias("kind"), F.col("_lo").alias("level")))
    return s.df.select(*s.keys, *s.order, F.inline(sides)).where("level is not null")


def level_clusters(s: Series, n: int = 5, touches: int = 2, tolerance_pct: float = 0.5) -> DataFrame:
    """Support / resistance: fractal levels in price order join a cluster while
    they stay within tolerance of its running mean.

    A step larger than the tolerance from the level just below is a sure break
    (the mean is never above it), so levels are first cut into islands; only
    inside an island the greedy rule runs, as an ordered pass.
    """
    keys = s.keys
    last = s.df.groupBy(*keys).agg(F.max_by("close", F.struct(*s.order)).alias("_px"))
    lv = fractals(s, n).join(last, keys)
    tol = F.greatest(F.col("level"), F.col("_px")) * (tolerance_pct / 100)
    ls = Series.of(lv.withColumn("_tol", tol), [*keys, "kind"], ["level", *s.order])
    ls = ls.bounded(1, {"_cut": lambda w: F.when(w.lag("level").isNull() | (F.col("level") - w.lag("level") > F.col("_tol")), 1).otherwise(0)})
    ls = ls.running(_isle=("sum", "_cut"))
    return ordered_fold(ls.df, [*keys, "kind", "_isle"], ["level", *s.order], ["level", "_tol"], _Cluster, "level double, touches bigint").where(
        F.col("touches") >= touches
    ).drop("_isle")


class _Cluster(Machine):
    def __init__(self):
        self.total, self.n = 0.0, 0

    def row(self, level, tol):
        if self.n and level - self.total / self.n > tol:
            yield self.total / self.n, self.n
            self.total, self.n = 0.0, 0
        self.total += level
        self.n += 1

    def end(self):
        yield self.total / self.n, self.n


# --- candlestick patterns -------------------------------------------------------------------
# Predicates over bars 0 (current) .. 4 (four bars back); names fixed by the
# pattern catalogue, ratios are its fixed thresholds.
def _shape(j: int) -> dict[str, str]:
    return {f"rg{j}": f"(h{j} - l{j})", f"bd{j}": f"abs(c{j} - o{j})", f"bull{j}": f"(c{j} > o{j})", f"bear{j}": f"(c{j} < o{j})"}


PATTERNS = {
    "doji": "{rg0} > 0 AND {bd0} <= 0.05 * {rg0}",
    "dragonfly_doji": "{rg0} > 0 AND {bd0} <= 0.05 * {rg0} AND {us} <= 0.05 * {rg0} AND {ls} >= 0.6 * {rg0}",
    "gravestone_doji": "{rg0} > 0 AND {bd0} <= 0.05 * {rg0} AND {ls} <= 0.05 * {rg0} AND {us} >= 0.6 * {rg0}",
    "long_legged_doji": "{rg0} > 0 AND {bd0} <= 0.05 * {rg0} AND {us} >= 0.3 * {rg0} AND {ls} >= 0.3 * {rg0}",
    "hammer": "{rg0} > 0 AND {bd0} <= 0.33 * {rg0} AND {ls} >= 0.6 * {rg0} AND {us} <= 0.1 * {rg0} AND {bull0}",
    "inverted_hammer": "{rg0} > 0 AND {bd0} <= 0.33 * {rg0} AND {us} >= 0.6 * {rg0} AND {ls} <= 0.1 * {rg0}",
    "hanging_man": "{rg0} > 0 AND {bd0} <= 0.33 * {rg0} AND {ls} >= 0.6 * {rg0} AND {us} <= 0.1 * {rg0} AND {bear0}",
    "shooting_star": "{rg0} > 0 AND {bd0} <= 0.33 * {rg0} AND {us} >= 0.6 * {rg0} AND {ls} <= 0.1 * {rg0} AND {bear0}",
    "bullish_marubozu": "{rg0} > 0 AND {bull0} AND {us} <= 0.05 * {rg0} AND {ls} <= 0.05 * {rg0}",
    "bearish_marubozu": "{rg0} > 0 AND {bear0} AND {us} <= 0.05 * {rg0} AND {ls} <= 0.05 * {rg0}",
    "spinning_top": "{rg0} > 0 AND {bd0} <= 0.25 * {rg0} AND {us} >= 0.25 * {rg0} AND {ls} >= 0.25 * {rg0}",
    "bullish_engulfing": "{bear1} AND {bull0} AND c0 >= o1 AND o0 <= c1",
    "bearish_engulfing": "{bull1} AND {bear0} AND o0 >= c1 AND c0 <= o1",
    "tweezer_top": "{bull1} AND {bear0} AND abs(h0 - h1) < 0.001 * greatest(h0, h1)",
    "tweezer_bottom": "{bear1} AND {bull0} AND abs(l0 - l1) < 0.001 * greatest(l0, l1)",
    "piercing_line": "{bear1} AND {bull0} AND o0 < l1 AND c0 > (o1 + c1) / 2 AND c0 < o1",
    "dark_cloud_cover": "{bull1} AND {bear0} AND o0 > h1 AND c0 < (o1 + c1) / 2 AND c0 > o1",
    "bullish_harami": "{bear1} AND {bull0} AND o0 > c1 AND c0 < o1",
    "bearish_harami": "{bull1} AND {bear0} AND c0 > o1 AND o0 < c1",
    "morning_star": "{bear2} AND {rg1} > 0 AND {bd1} <= 0.33 * {rg1} AND {bull0} AND c0 > (o2 + c2) / 2",
    "evening_star": "{bull2} AND {rg1} > 0 AND {bd1} <= 0.33 * {rg1} AND {bear0} AND c0 < (o2 + c2) / 2",
    "three_white_soldiers": "{bull2} AND {bull1} AND {bull0} AND c0 > c1 AND c1 > c2 AND o1 > o2 AND o1 < c2 AND o0 > o1 AND o0 < c1",
    "three_black_crows": "{bear2} AND {bear1} AND {bear0} AND c0 < c1 AND c1 < c2 AND o1 < o2 AND o1 > c2 AND o0 < o1 AND o0 > c1",
    "three_inside_up": "{bear2} AND {bull1} AND o1 > c2 AND c1 < o2 AND {bull0} AND c0 > c1",
    "three_inside_down": "{bull2} AND {bear1} AND c1 > o2 AND o1 < c2 AND {bear0} AND c0 < c1",
    "three_outside_up": "{bear2} AND {bull1} AND c1 >= o2 AND o1 <= c2 AND {bull0} AND c0 > c1",
    "three_outside_down": "{bull2} AND {bear1} AND o1 >= c2 AND c1 <= o2 AND {bear0} AND c0 < c1",
    # standard gap rule (the middle bar lies wholly outside both neighbours)
    "bullish_abandoned_baby": "{bear2} AND {rg1} > 0 AND {bd1} <= 0.05 * {rg1} AND {bull0} AND h1 < l2 AND l0 > h1",
    "bearish_abandoned_baby": "{bull2} AND {rg1} > 0 AND {bd1} <= 0.05 * {rg1} AND {bear0} AND l1 > h2 AND h0 < l1",
    "rising_three_methods": "{bull4} AND {bd4} > 0.6 * {rg4} AND {bear3} AND {bear2} AND {bear1} AND least(l3, l2, l1) > l4 AND greatest(h3, h2, h1) < h4 AND {bull0} AND c0 > c4",
    "falling_three_methods": "{bear4} AND {bd4} > 0.6 * {rg4} AND {bull3} AND {bull2} AND {bull1} AND least(l3, l2, l1) > l4 AND greatest(h3, h2, h1) < h4 AND {bear0} AND c0 < c4",
    "bullish_belt_hold": "{rg0} > 0 AND {bull0} AND o0 - l0 < 0.01 * {rg0} AND {bd0} > 0.5 * {rg0}",
    "bearish_belt_hold": "{rg0} > 0 AND {bear0} AND h0 - o0 < 0.01 * {rg0} AND {bd0} > 0.5 * {rg0}",
    "bullish_counterattack": "{bear1} AND {bull0} AND abs(c0 - c1) < 0.01 * greatest(abs(c0), abs(c1))",
    "bearish_counterattack": "{bull1} AND {bear0} AND abs(c0 - c1) < 0.01 * greatest(abs(c0), abs(c1))",
    "bullish_breakaway": "{bear4} AND {bd4} > 0.5 * {rg4} AND c3 < c4 AND c2 < c3 AND {bull1} AND {bull0} AND c0 > (o4 + c4) / 2",
    "bearish_breakaway": "{bull4} AND {bd4} > 0.5 * {rg4} AND c3 > c4 AND c2 > c3 AND {bear1} AND {bear0} AND c0 < (o4 + c4) / 2",
}


def pattern_sql() -> dict[str, str]:
    names = {"us": "(h0 - greatest(o0, c0))", "ls": "(least(o0, c0) - l0)"}
    for j in range(5):
        names |= _shape(j)
    return {k: v.format(**names) for k, v in PATTERNS.items()}


def patterns(s: Series) -> Series:
    src = {"o": "open", "h": "high", "l": "low", "c": "close"}
    s = s.bounded(4, {f"{a}{j}": (lambda w, c=c, j=j: F.col(c) if j == 0 else w.lag(c, j)) for a, c in src.items() for j in range(5)})
    flags = {k: (F.col(IDX) >= 5) & F.coalesce(F.expr(v), F.lit(False)) for k, v in pattern_sql().items()}
    return _drop(s.mutate(**flags), *[f"{a}{j}" for a in src for j in range(5)])


# --- drawdowns and streaks --------------------------------------------------------------------
def drawdown(s: Series, col: str = "close", out: str = "drawdown") -> Series:
    s = s.running(**{f"{out}_peak": ("max", col)})
    return s.mutate(**{out: (F.col(f"{out}_peak") - F.col(col)) / F.col(f"{out}_peak")})


def drawdown_episodes(s: Series, col: str = "close") -> DataFrame:
    t = s.order[0]
    s = drawdown(s, col, "_dd").bounded(0, {"_next": lambda w: w.lead(t)}, ahead=1)
    s = s.running(_ep=("sum", F.when(F.col("_dd") == 0, 1).otherwise(0)))
    rows = s.rows.where("_dd > 0")
    return rows.groupBy(*s.keys, "_ep").agg(
        F.min(t).alias("start"),
        F.min(F.struct(F.col(col), F.col(t).alias("at"))).getField("at").alias("trough"),
        F.max_by("_next", F.struct(*s.order)).alias("recovery"),
        F.max("_dd_peak").alias("peak_equity"),
        F.min(col).alias("trough_equity"),
        F.max("_dd").alias("depth"),
        F.count(F.lit(1)).alias("length"),
    ).drop("_ep")


def streak_maxima(s: Series, win: Column) -> DataFrame:
    """Longest runs of winning and losing rows per series."""
    s = s.mutate(_win=win).bounded(1, {"_turn": lambda w: F.when(~F.col("_win").eqNullSafe(w.lag("_win")), F.col(IDX))}).running(_from=("last", "_turn"))
    run = F.col(IDX) - F.col("_from") + 1
    return s.rows.groupBy(*s.keys).agg(
        F.max(F.when(F.col("_win"), run).otherwise(0)).alias("consecutive_wins"),
        F.max(F.when(~F.col("_win"), run).otherwise(0)).alias("consecutive_losses"),
    )


def _joined(a: tuple, b: tuple) -> tuple:
    """Streaks of two stretches of rows, one after the other: (first kind, its
    length, last kind, its length, rows, longest wins, longest losses)."""
    first, head, last, tail, n, wins, losses = a
    met = last == b[0]
    run = tail + b[1] if met else 0
    wins, losses = max(wins, b[5], run if last == 1 else 0), max(losses, b[6], run if last == 0 else 0)
    return first, run if met and head == n else head, b[2], run if met and b[3] == b[4] else b[3], n + b[4], wins, losses


def _stretch(kind: np.ndarray) -> tuple:
    at = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    size, of = np.diff(np.append(at, len(kind))), kind[at]
    best = lambda k: int(size[of == k].max(initial=0))
    return int(of[0]), int(size[0]), int(of[-1]), int(size[-1]), len(kind), best(1), best(0)


def _stretches(n_keys: int, batches):
    """One row for each key of a sorted task: its streaks there."""
    key, held, block, names = None, None, 0, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, block, *held), types)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        names = [*b.schema.names[: n_keys + 1], "first", "head", "last", "tail", "n", "wins", "losses"]
        types = [*b.schema.types[: n_keys + 1], *[pa.int64()] * 7]
        kind = b.column(n_keys + 1).to_numpy()
        new = np.zeros(b.num_rows, bool)
        for i in range(n_keys):
            k = b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= k[1:] != k[:-1]
        edge = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(edge[:-1], edge[1:]):
            now, part = tuple(b.column(i)[lo].as_py() for i in range(n_keys)), _stretch(kind[lo:hi])
            if held is not None and now != key:
                yield row()
                held = None
            key, block = now, b.column(n_keys)[lo].as_py()
            held = part if held is None else _joined(held, part)
    if held is not None:
        yield row()


class _Streaks(Machine):
    def __init__(self):
        self.held = None

    def row(self, *part):
        self.held = part if self.held is None else _joined(self.held, part)
        return ()

    def end(self):
        yield self.held[5:]


def longest_streaks(df: DataFrame, keys: list[str], order: list[str], win: Column) -> DataFrame:
    """``streak_maxima`` of rows that aren't a series yet.  Rows are dealt to tasks
    by range with what orders them and the outcome only; a task passes on one row
    for each of its keys, and these are joined in the order of the tasks."""
    cols = list(dict.fromkeys([*keys, *order]))
    x = df.select(*cols, F.when(win, 1).when(~win, 0).otherwise(-1).alias("_win"))
    x = x.repartitionByRange(*[*keys, *order]).sortWithinPartitions(*keys, *order).select(*keys, F.spark_partition_id().alias("_task"), "_win")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    parts = ["first", "head", "last", "tail", "n", "wins", "losses"]
    got = x.mapInArrow(partial(_stretches, len(keys)), ddl + ", " + ", ".join(f"{p} bigint" for p in parts))
    return ordered_fold(got, keys, ["_task"], parts, _Streaks, "consecutive_wins bigint, consecutive_losses bigint")


def rolling_max_drawdown(s: Series, n: int, col: str = "close", out: str = "rolling_max_dd") -> Series:
    def f(v):
        x = v[col]
        peak = np.maximum.accumulate(x, axis=1)
        return (np.max((peak - x) / peak, axis=1),)

    return s.rolling(n, [col], [out], f)


def rolling_sharpe(s: Series, n: int = 60, year: float = 52.0) -> Series:
    """Sharpe and Sortino of the last ``n`` returns (sample deviation)."""
    s = s.bounded(1, {"_r": lambda w: B.c / w.lag("close") - 1})
    neg = F.when(F.col("_r") < 0, F.col("_r"))
    ratio = lambda sd: F.when(sd > 0, 1 / sd)
    s = s.bounded(
        n - 1,
        {
            "rolling_sharpe": lambda w: w.full(n + 1, F.avg("_r").over(w(n)) * ratio(F.stddev_samp("_r").over(w(n))) * math.sqrt(year)),
            "rolling_sortino": lambda w: w.full(n + 1, F.avg("_r").over(w(n)) * ratio(F.stddev_samp(neg).over(w(n))) * math.sqrt(year)),
        },
    )
    return _drop(s, "_r")


def trailing_metrics(s: Series, n: int = 52, year: float = 52.0) -> Series:
    """Report form: the window ends before the current row, population deviation."""
    s = s.bounded(1, {"_r": lambda w: B.c / w.lag("close") - 1})
    neg = F.when(F.col("_r") < 0, F.col("_r"))

    def ratio(x, at_least):
        def f(w):
            o = w.span(-n, -1)
            sd = F.stddev_pop(x).over(o)
            ok = (F.count(x).over(o) >= at_least) & (sd > 0)
            return w.full(n + 2, F.when(ok, F.avg("_r").over(o) / sd * math.sqrt(year)).otherwise(0.0))
        return f

    s = s.bounded(
        n,
        {
            "trail_sharpe": ratio(F.col("_r"), 2), "trail_sortino": ratio(neg, 2),
            "trail_win_rate": lambda w: w.full(n + 2, F.avg(F.when(F.col("_r") > 0, 1.0).otherwise(0.0)).over(w.span(-n, -1))),
        },
    )
    return _drop(s, "_r")


# --- data quality ---------------------------------------------------------------------------------
def gaps(s: Series, t: str, expected: int = 1) -> DataFrame:
    s = s.bounded(1, {"_p": lambda w: w.lag(t)})
    step = F.col(t) - F.col("_p")
    return s.df.where(step > 2 * expected).select(*s.keys, F.col("_p").alias("gap_start"), F.col(t).alias("gap_end"), step.alias("gap"), (F.floor(step / expected) - 1).alias("missing_bars"))


def on_full_grid(bars: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Add the missing buckets of every series as rows with null prices."""
    span = bars.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(t))
    return grid.join(bars, [*keys, t], "left")


def fill_gaps(s: Series, col: str, t: str) -> Series:
    """ffill, bfill, zero and linear interpolation of the nulls in ``col``."""
    pos = F.when(F.col(col).isNotNull(), F.col(t))
    s = s.running(ffill=("last", col), _ta=("last", pos)).next_value(bfill=F.col(col), _tb=pos)
    frac = (F.col(t) - F.col("_ta")) / (F.col("_tb") - F.col("_ta"))
    lin = F.when(F.col(col).isNotNull(), F.col(col)).otherwise(F.col("ffill") + (F.col("bfill") - F.col("ffill")) * frac)
    return _drop(s.mutate(zero=F.coalesce(F.col(col), F.lit(0.0)), linear=lin), "_ta", "_tb")


def outliers(df: DataFrame, keys: list[str], col: str, z: float = 5.0) -> DataFrame:
    """Outlier flags by z-score and by quartile fences (groups of at least 10
    values); ``cleaned`` is null where the z-score rule fires."""
    st = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_sd"))
    q = exact_percentiles(df, keys, col, {"_q1": 0.25, "_q3": 0.75})
    x = df.join(st, keys).join(q, keys)
    enough = F.col("n") >= 10
    iqr = F.col("_q3") - F.col("_q1")
    v = F.col(col)
    zflag = enough & (F.col("_sd") > 0) & (F.abs(v - F.col("_m")) / F.col("_sd") > z)
    qflag = enough & (iqr > 0) & ((v < F.col("_q1") - 1.5 * iqr) | (v > F.col("_q3") + 1.5 * iqr))
    return x.withColumns({"z_outlier": F.coalesce(zflag, F.lit(False)), "iqr_outlier": F.coalesce(qflag, F.lit(False))}).withColumn(
        "cleaned", F.when(~F.col("z_outlier"), v)
    ).drop("_m", "_sd", "_q1", "_q3", "n")


# --- statistics -------------------------------------------------------------------------------------
def zscore(s: Series, n: int = 20, col: str = "close") -> Series:
    def f(w):
        sd = F.stddev_samp(col).over(w(n))
        return w.full(n, F.when(sd == 0, 0.0).otherwise((F.col(col) - F.avg(col).over(w(n))) / sd))

    return s.bounded(n - 1, {"zscore": f})


def divergences(s: Series, ind: str, n: int = 50, first_valid: int = 1) -> Series:
    """Second-half price extreme against first-half extreme; the indicator is
    read at those bars.  Adds regular and hidden, bullish and bearish flags."""
    half = n // 2
    i = F.col(IDX)
    lo = F.struct(B.c.alias("p"), i.alias("j"), F.col(ind).alias("v"))
    hi = F.struct(B.c.alias("p"), (-i).alias("j"), F.col(ind).alias("v"))
    a = lambda w: w.span(-(n - 1), -(n - half))
    b = lambda w: w.span(-(half - 1), 0)
    s = s.bounded(
        n - 1,
        {"_l1": lambda w: F.min(lo).over(a(w)), "_l2": lambda w: F.min(lo).over(b(w)), "_h1": lambda w: F.max(hi).over(a(w)), "_h2": lambda w: F.max(hi).over(b(w))},
    )
    p = lambda x: F.col(f"{x}.p")
    v = lambda x: F.col(f"{x}.v")
    ok = i >= first_valid + n - 1
    flag = lambda c: F.coalesce(ok & c, F.lit(False))
    s = s.mutate(
        bullish_regular=flag((p("_l2") < p("_l1")) & (v("_l2") > v("_l1"))),
        bearish_regular=flag((p("_h2") > p("_h1")) & (v("_h2") < v("_h1"))),
        bullish_hidden=flag((p("_l2") > p("_l1")) & (v("_l2") < v("_l1"))),
        bearish_hidden=flag((p("_h2") < p("_h1")) & (v("_h2") > v("_h1"))),
    )
    return _drop(s, "_l1", "_l2", "_h1", "_h2")


def macd_volume_divergence(s: Series, hist: str = "macd_hist", n: int = 50, hist_from: int = 34) -> Series:
    half = n // 2
    a = lambda w: w.span(-(n - 1), -(n - half))
    b = lambda w: w.span(-(half - 1), 0)
    pick = lambda f, c, z=False: (lambda w: (F.coalesce(f(c).over(a(w)), F.lit(0.0)) if z else f(c).over(a(w))))
    late = lambda f, c, z=False: (lambda w: (F.coalesce(f(c).over(b(w)), F.lit(0.0)) if z else f(c).over(b(w))))
    s = s.bounded(
        n - 1,
        {
            "_l1": pick(F.min, "close"), "_l2": late(F.min, "close"), "_h1": pick(F.max, "close"), "_h2": late(F.max, "close"),
            "_m1": pick(F.min, hist, True), "_m2": late(F.min, hist, True), "_x1": pick(F.max, hist, True), "_x2": late(F.max, hist, True),
            "_v1": pick(F.avg, "volume"), "_v2": late(F.avg, "volume"),
        },
    )
    c, i = F.col, F.col(IDX)
    lower, higher = c("_l2") < c("_l1"), c("_h2") > c("_h1")
    enough = i >= max(n, hist_from + 19)
    thin = c("_v2") < 0.8 * c("_v1")
    f = lambda x: F.coalesce(x, F.lit(False))
    s = s.mutate(
        macd_bullish=f(enough & lower & (c("_m2") > c("_m1"))), macd_bearish=f(enough & higher & (c("_x2") < c("_x1"))),
        volume_bullish=f((i >= n) & lower & thin), volume_bearish=f((i >= n) & higher & thin),
    )
    return _drop(s, *[f"_{k}{j}" for k in "lhmxv" for j in (1, 2)])


def hurst(s: Series, lo: int = 10, hi: int = 50) -> DataFrame:
    """Rescaled-range exponent per series: every segment length is evaluated in
    one ordered pass, only its mean per length is shuffled."""
    lags = list(range(lo, hi))
    s = s.bounded(1, {"_r": lambda w: F.log(B.c / w.lag("close"))})

    def f(v):
        x, i = v["_r"], v[IDX][:, -1] - 1          # number of returns so far
        outs = []
        for k in lags:
            seg = x[:, -k:]
            dev = np.cumsum(seg - seg.mean(axis=1, keepdims=True), axis=1)
            sd = seg.std(axis=1, ddof=1)
            rs = np.where(sd > 0, (dev.max(axis=1) - dev.min(axis=1)) / np.where(sd > 0, sd, 1), np.nan)
            outs.append(np.where((i > 0) & (i % k == 0), rs, np.nan))
        return tuple(outs)

    names = [f"_rs{k}" for k in lags]
    rows = s.rolling(hi, ["_r", IDX], names, f, short_ok=True).rows
    means = rows.groupBy(*s.keys).agg((F.count("_r")).alias("_n"), *[F.avg(n).alias(n) for n in names])
    used = lambda k: F.when((F.col("_n") >= 99) & (F.lit(k) < F.least(F.lit(hi), F.floor(F.col("_n") / 2))) & (F.col(f"_rs{k}") > 0), F.struct(F.lit(math.log(k)).alias("x"), F.log(f"_rs{k}").alias("y")))
    pts = means.withColumn("_p", F.array_compact(F.array(*[used(k) for k in lags]))).where(F.size("_p") >= 3)
    return pts.select(*s.keys, F.explode("_p").alias("_q")).groupBy(*s.keys).agg(F.regr_slope(F.col("_q.y"), F.col("_q.x")).alias("hurst"))


def rolling_vol_regime(s: Series, n: int = 50, back: int = 200) -> Series:
    """0 low, 1 normal, 2 crisis: rolling deviation against the 33rd / 67th
    percentile of its own trailing values; a mean return below -3 deviations
    is a crisis too."""
    s = s.bounded(1, {"_r": lambda w: B.c / w.lag("close") - 1})
    s = s.bounded(n - 1, {"_v": lambda w: w.full(n + 1, F.stddev_pop("_r").over(w(n))), "_m": lambda w: w.full(n + 1, F.avg("_r").over(w(n)))})

    def f(v):
        own = v[IDX] + np.arange(back - 1, -1, -1) == v[IDX][:, -1:]     # rows of the same series
        x = np.sort(np.where(own, v["_v"], np.nan), axis=1)              # NaN sorts last
        cnt = (~np.isnan(x)).sum(axis=1)
        outs = []
        for p in (0.33, 0.67):
            at = np.maximum(cnt - 1, 0) * p
            a, b = np.floor(at).astype(int), np.ceil(at).astype(int)
            r = np.arange(len(x))
            outs.append(x[r, a] + (x[r, b] - x[r, a]) * (at - a))
        return tuple(outs)

    s = s.rolling(back, ["_v", IDX], ["vol_low", "vol_high"], f, short_ok=True)
    reg = F.when((F.col("_v") > F.col("vol_high")) | (F.col("_m") < -3 * F.col("_v")), 2).when(F.col("_v") > F.col("vol_low"), 1).otherwise(0)
    return _drop(s.mutate(regime=F.when(F.col("_v").isNotNull(), reg).otherwise(0)), "_r", "_v", "_m")


def cusum(s: Series, col: str, drift: float = 0.1, alpha: float = 0.1) -> Series:
    """Two-sided CUSUM against a moving baseline (exponential, updated after
    the comparison)."""
    s = s.scan(Affine("_b", lambda c, i: (np.where(i == 1, 0.0, 1 - alpha), np.where(i == 1, c[col], alpha * c[col]))))
    before = F.when(F.col(IDX) == 1, 0.0).otherwise((F.col("_b") - alpha * F.col(col)) / (1 - alpha))
    dev = F.col(col) - before
    s = s.mutate(baseline=before, _u=dev - drift, _d=-dev - drift)
    s = s.running(_tu=("sum", "_u"), _td=("sum", "_d")).running(_mu=("min", "_tu"), _md=("min", "_td"))
    zero = F.lit(0.0)
    s = s.mutate(cusum_pos=F.col("_tu") - F.least(zero, F.col("_mu")), cusum_neg=F.col("_td") - F.least(zero, F.col("_md")))
    return _drop(s, "_b", "_u", "_d", "_tu", "_td", "_mu", "_md")
