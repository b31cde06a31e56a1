"""Ordered recurrences as prefix scans over an associative composition.

``y[t] = f_t(y[t-1])`` is not a window frame, but the maps ``f_t`` compose:

* affine        ``y -> a*y + b``            (averages, filters, decays)
* affine pair   ``(y, z) -> M (y, z) + v``  (second-order filters)
* clamp         ``y -> min(hi, max(lo, y))``  (trailing bands)
* filter        ``(m, P) -> (A (I + P J)^-1 (m + P e) + b, A (I + P J)^-1 P A' + C)``
                (mean and covariance of a two-state linear filter, whose Riccati
                step is linear-fractional; this form composes without growing)

so a task computes the composition of its own rows, a slice of a series is
summarised by one small tuple, and summaries are carried forward between
slices.  Inside a task NumPy does the scan by doubling over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Cols = dict[str, np.ndarray]


@dataclass(frozen=True)
class Calc:
    """A row-wise column ``fn(cols)`` computed between recurrences."""

    out: str
    fn: Callable[[Cols], np.ndarray]


@dataclass(frozen=True)
class Affine:
    """``y = a*y_prev + b``; ``a`` must be 0 on the first row of a series.

    ``coef(cols, i)`` returns the arrays ``(a, b)``; ``warm`` rows are null.
    """

    out: str
    coef: Callable[[Cols, np.ndarray], tuple[np.ndarray, np.ndarray]]
    warm: int = 0


@dataclass(frozen=True)
class AffinePair:
    """State ``(y, y_prev)`` under a 2x2 matrix; ``coef`` returns m00, m01, m10, m11, v0, v1."""

    out: str
    coef: Callable[[Cols, np.ndarray], tuple[np.ndarray, ...]]
    warm: int = 0


@dataclass(frozen=True)
class Clamp:
    """``y = min(hi, max(lo, y_prev))``; ``coef`` returns ``(lo, hi)``."""

    out: str
    coef: Callable[[Cols, np.ndarray], tuple[np.ndarray, np.ndarray]]
    warm: int = 0


@dataclass(frozen=True)
class Filter:
    """Mean and covariance of two hidden states after each observation.

    ``coef`` returns A00, A01, A10, A11, b0, b1, C00, C01, C11, e0, e1, J00, J01,
    J11; the first row of a series has A, e and J 0.  ``out`` is the first mean,
    ``more`` names the second and then P00, P01, P11, as far as it goes.
    """

    out: str
    coef: Callable[[Cols, np.ndarray], tuple[np.ndarray, ...]]
    more: tuple[str, ...] = ()
    warm: int = 0


Step = Calc | Affine | AffinePair | Clamp | Filter


def _outs(s: Step) -> list[str]:
    return [s.out, *getattr(s, "more", ())]


def ema(out: str, src: str | Callable[[Cols], np.ndarray], n: int, skip: int = 0, k: float | None = None) -> Affine:
    """Exponential average seeded with the mean of its first ``n`` inputs.

    ``skip`` rows at the start of the series carry no input (warm-up of the
    source).  ``k`` is the weight of the newest value: ``2/(n+1)`` unless set
    (``1/n`` gives Wilder smoothing).
    """
    weight = 2.0 / (n + 1) if k is None else k

    def coef(c: Cols, i: np.ndarray):
        x = c[src] if isinstance(src, str) else src(c)
        j = i - skip                       # 1-based index among valid inputs
        a = np.where(j <= 1, 0.0, np.where(j < n, 1.0, np.where(j == n, 1.0 / n, 1.0 - weight)))
        b = np.where(j < 1, 0.0, np.where(j < n, x, np.where(j == n, x / n, weight * x)))
        return a, b

    return Affine(out, coef, skip + n - 1)


def wilder(out: str, src, n: int, skip: int = 0) -> Affine:
    return ema(out, src, n, skip, 1.0 / n)


# --- composition rules -----------------------------------------------------------
def _affine(p, q):
    return q[0] * p[0], q[0] * p[1] + q[1]


def _pair(p, q):
    return (
        q[0] * p[0] + q[1] * p[2], q[0] * p[1] + q[1] * p[3],
        q[2] * p[0] + q[3] * p[2], q[2] * p[1] + q[3] * p[3],
        q[0] * p[4] + q[1] * p[5] + q[4], q[2] * p[4] + q[3] * p[5] + q[5],
    )


def _clamp(p, q):
    lo, hi = q
    return np.minimum(hi, np.maximum(lo, p[0])), np.minimum(hi, np.maximum(lo, p[1]))


def _bend(c00, c01, c11, j00, j01, j11):
    """(I + C J)^-1 for symmetric 2 x 2 matrices."""
    d00, d01 = 1 + c00 * j00 + c01 * j01, c00 * j01 + c01 * j11
    d10, d11 = c01 * j00 + c11 * j01, 1 + c01 * j01 + c11 * j11
    det = d00 * d11 - d01 * d10
    return d11 / det, -d01 / det, -d10 / det, d00 / det


def _mul(p, q):
    return p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]


def _moved(a, b, c, inv, m0, m1, p00, p01, p11, e0, e1):
    """Mean and covariance (m, P) after a map with A, b, C, e."""
    g = _mul(a, inv)
    n0, n1 = m0 + p00 * e0 + p01 * e1, m1 + p01 * e0 + p11 * e1
    k = _mul(g, (p00, p01, p01, p11))
    return (
        g[0] * n0 + g[1] * n1 + b[0], g[2] * n0 + g[3] * n1 + b[1],
        k[0] * a[0] + k[1] * a[1] + c[0], k[0] * a[2] + k[1] * a[3] + c[1], k[2] * a[2] + k[3] * a[3] + c[2],
    )


def _filter(p, q):
    a, b, (c00, c01, c11), (e0, e1), (j00, j01, j11) = p[:4], p[4:6], p[6:9], p[9:11], p[11:]
    f0, f1, (k00, k01, k11) = q[9], q[10], q[11:]
    inv = _bend(c00, c01, c11, k00, k01, k11)
    w = _mul(inv, a)
    u0, u1 = f0 - k00 * b[0] - k01 * b[1], f1 - k01 * b[0] - k11 * b[1]
    ja = _mul((k00, k01, k01, k11), a)
    return (
        *_mul(_mul(q[:4], inv), a), *_moved(q[:4], q[4:6], q[6:9], inv, b[0], b[1], c00, c01, c11, f0, f1),
        w[0] * u0 + w[2] * u1 + e0, w[1] * u0 + w[3] * u1 + e1,
        w[0] * ja[0] + w[2] * ja[2] + j00, w[0] * ja[1] + w[2] * ja[3] + j01, w[1] * ja[1] + w[3] * ja[3] + j11,
    )


_RULES = {
    Affine: (_affine, (1.0, 0.0)),
    AffinePair: (_pair, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)),
    Clamp: (_clamp, (-np.inf, np.inf)),
    Filter: (_filter, (1.0, 0.0, 0.0, 1.0, *(0.0,) * 10)),
}


def _prefix(maps: tuple[np.ndarray, ...], start: np.ndarray, rule) -> tuple[np.ndarray, ...]:
    """Segmented inclusive scan by doubling; ``start`` marks segment heads."""
    maps = tuple(np.array(m, dtype=float) for m in maps)
    closed = start.copy()
    if len(closed):
        closed[0] = True
    d, n = 1, len(closed)
    while d < n and not closed[d:].all():
        at = np.flatnonzero(~closed[d:]) + d
        got = rule(tuple(m[at - d] for m in maps), tuple(m[at] for m in maps))
        nxt = closed.copy()
        nxt[d:] |= closed[:-d]
        for m, g in zip(maps, got):
            m[at] = g
        closed = nxt
        d *= 2
    return maps


def _value(kind, maps, carry):
    """Apply composed maps to the carried state; returns the state arrays."""
    if kind is Affine:
        return (maps[0] * carry[0] + maps[1],)
    if kind is AffinePair:
        return (maps[0] * carry[0] + maps[1] * carry[1] + maps[4], maps[2] * carry[0] + maps[3] * carry[1] + maps[5])
    if kind is Filter:
        inv = _bend(*carry[2:], *maps[11:])
        return _moved(maps[:4], maps[4:6], maps[6:9], inv, *carry, maps[9], maps[10])
    return (np.minimum(maps[1], np.maximum(maps[0], carry[0])),)


_NSTATE = {Affine: 1, AffinePair: 2, Clamp: 1, Filter: 5}


class _Lazy(dict):
    """Columns of a batch as float arrays, converted when first asked for: a
    recurrence needs one or two of a wide row."""

    def __init__(self, batch: pa.RecordBatch):
        super().__init__()
        self.batch = batch

    def __missing__(self, name: str) -> np.ndarray:
        col = self.batch.column(name)
        if pa.types.is_boolean(col.type):
            col = col.cast(pa.int8())
        self[name] = x = col.to_numpy(zero_copy_only=False).astype(float)
        return x


def _columns(batch: pa.RecordBatch) -> Cols:
    return _Lazy(batch)


def _null_nan(x: np.ndarray, extra: np.ndarray | None = None) -> pa.Array:
    mask = np.isnan(x)
    if extra is not None:
        mask |= extra
    return pa.array(x, pa.float64(), mask=mask)


def _schema(df: DataFrame, outs: list[str]) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(o, T.DoubleType()) for o in outs])


def run_plain(df: DataFrame, idx: str, steps) -> DataFrame:
    """Whole series lie in one partition, in order (row number ``idx``): one
    streaming pass over Arrow batches keeps one small state per step."""
    steps = list(steps)
    outs = [o for s in steps for o in _outs(s)]

    def go(batches):
        last_i = None
        carry = {s.out: tuple([0.0] * _NSTATE[type(s)]) for s in steps if not isinstance(s, Calc)}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = _columns(batch)
            i = cols[idx]
            start = i == 1
            steady = np.ones(len(i), bool)
            steady[1:] = start[1:] | (i[1:] == i[:-1] + 1)
            if last_i is not None:
                steady[0] = start[0] or i[0] == last_i + 1
            if not steady.all():
                raise RuntimeError("series rows reached a recurrence out of order")
            last_i = i[-1]
            arrays = list(batch.columns)
            for s in steps:
                if isinstance(s, Calc):
                    y = np.asarray(s.fn(cols), dtype=float)
                    arrays.append(_null_nan(y))
                    cols[s.out] = y
                    continue
                kind = type(s)
                rule, _ = _RULES[kind]
                maps = _prefix(s.coef(cols, i), start, rule)
                first = np.flatnonzero(start)
                head = first[0] if len(first) else len(i)   # rows that continue the carried series
                state = tuple(np.zeros(len(i)) for _ in range(_NSTATE[kind]))
                for lo, hi, c in ((0, head, carry[s.out]), (head, len(i), (0.0,) * _NSTATE[kind])):
                    if hi > lo:
                        got = _value(kind, tuple(m[lo:hi] for m in maps), c)
                        for st, g in zip(state, got):
                            st[lo:hi] = g
                carry[s.out] = tuple(st[-1] for st in state)
                warm = i <= s.warm
                for o, st in zip(_outs(s), state):
                    cols[o] = np.where(warm, np.nan, st)
                    arrays.append(_null_nan(st, warm))
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names + outs)

    return df.mapInArrow(go, _schema(df, outs))


def run_windows(df: DataFrame, idx: str, n: int, cols: list[str], outs: list[str], fn, short_ok: bool = False) -> DataFrame:
    """Window views over ordered batches; the last ``n - 1`` rows are carried
    from batch to batch.  Rows with fewer than ``n`` rows behind them are null."""

    def go(batches):
        tail = {c: np.full(n - 1, np.nan) for c in cols}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            got = _columns(batch)
            full = {c: np.concatenate([tail[c], got[c]]) for c in cols}
            tail = {c: x[-(n - 1):] if n > 1 else x[:0] for c, x in full.items()}
            short = None if short_ok else got[idx] < n
            views = {c: np.lib.stride_tricks.sliding_window_view(x, n) for c, x in full.items()}
            with np.errstate(all="ignore"):
                ys = fn(views)
            arrays = [*batch.columns, *[_null_nan(np.asarray(y, dtype=float), short) for y in ys]]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names + outs)

    return df.mapInArrow(go, _schema(df, outs))


def run_blocked(df: DataFrame, keys, block, order, idx, steps) -> DataFrame:
    """A series spans slices: one pass gives every row the composition of its
    slice so far, slice ends (one row each) are composed in order, and a join
    on (series, slice) brings the carried state back."""
    from tapeworks.session import checkpointed

    for s in steps:
        df = _one_blocked(df, keys, block, order, idx, s, checkpointed)
    return df


def _one_blocked(df, keys, block, order, idx, s, cut):
    if isinstance(s, Calc):
        def calc(batches):
            for b in batches:
                y = np.asarray(s.fn(_columns(b)), dtype=float)
                yield pa.RecordBatch.from_arrays([*b.columns, _null_nan(y)], names=b.schema.names + [s.out])
        return df.mapInArrow(calc, _schema(df, [s.out]))

    kind = type(s)
    rule, unit = _RULES[kind]
    names = [f"_m{j}" for j in range(len(unit))]

    def compose(batches):
        last_i, tail = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = _columns(b)
            i = cols[idx]
            start = np.ones(len(i), bool)
            start[1:] = (i[1:] != i[:-1] + 1) | (cols[block][1:] != cols[block][:-1])
            maps = _prefix(s.coef(cols, i), start, rule)
            key = cols[block][0]
            if last_i is not None and i[0] == last_i[0] + 1 and key == last_i[1]:
                stop = np.flatnonzero(start[1:])
                stop = stop[0] + 1 if len(stop) else len(i)
                joined = rule(tuple(np.full(stop, t) for t in tail), tuple(m[:stop] for m in maps))
                for m, g in zip(maps, joined):
                    m[:stop] = g
            last_i = (i[-1], cols[block][-1])
            tail = tuple(m[-1] for m in maps)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(m, pa.float64()) for m in maps]], names=b.schema.names + names)

    laid = df.repartition(*keys, block).sortWithinPartitions(*keys, block, *order)
    rows = cut(laid.mapInArrow(compose, _schema(df, names)))
    ends = rows.groupBy(*keys, block).agg(F.max_by(F.struct(*names), idx).alias("_end")).select(*keys, block, "_end.*")

    nstate = _NSTATE[kind]
    carried = [f"_s{j}" for j in range(nstate)]

    def carry(key, table):
        table = table.sort_by(block)
        maps = tuple(table[n].to_numpy() for n in names)
        start = np.zeros(table.num_rows, bool)
        full = _prefix(maps, start, rule)
        state = _value(kind, full, (0.0,) * nstate)
        out = {n: table[n] for n in [*keys, block]}
        for c, st in zip(carried, state):
            out[c] = pa.array(np.concatenate([[0.0], st[:-1]]))
        return pa.table(out)

    fields = [f for f in df.schema.fields if f.name in [*keys, block]]
    schema = T.StructType([next(f for f in fields if f.name == n) for n in [*keys, block]]
                          + [T.StructField(c, T.DoubleType()) for c in carried])
    before = ends.groupBy(*keys).applyInArrow(carry, schema)
    got = rows.join(before, [*keys, block])
    c = F.col
    if kind is Filter:
        ys = _value(kind, tuple(c(n) for n in names), tuple(c(n) for n in carried))
        return got.withColumns({o: F.when(c(idx) > s.warm, y) for o, y in zip(_outs(s), ys)}).drop(*names, *carried)
    if kind is Affine:
        y = c("_m0") * c("_s0") + c("_m1")
    elif kind is AffinePair:
        y = c("_m0") * c("_s0") + c("_m1") * c("_s1") + c("_m4")
    else:
        y = F.least(c("_m1"), F.greatest(c("_m0"), c("_s0")))
    return got.withColumn(s.out, F.when(c(idx) > s.warm, y)).drop(*names, *carried)
