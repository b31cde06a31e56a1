"""Ordered series: windows, running values and recurrences at any length.

A *series* is the set of rows that share ``keys``, in the order of ``order``
(which must be total within a key).  Two physical forms give the same rows:

plain
    One hash exchange on the keys and one sort; every window shares them.
    Used while no series is longer than ``max_rows``.

blocked
    A hot key cannot be one task.  Rows are range-partitioned and sorted on
    (keys, order), so every task holds an equal slice and a long series spans
    many tasks, and the slice number is stored with the rows by a reliable
    checkpoint.  Bounded frames copy the few rows a slice needs from its
    neighbours (halo); running values and recurrences carry one small summary
    per slice forward.

Which form applies is decided from Catalyst's size estimate, and only when
that is large from a count per key (first of the source that ``counted_by``
names, when there is one).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.plans import recur
from tapeworks.session import checkpointed, size_estimate

IDX = "_i"          # 1-based row number within the series
BLOCK = "_block"    # slice number (blocked form only)

MAX_ROWS = 4_000_000
BLOCK_ROWS = 1_000_000
SMALL_BYTES = 24 << 20


class Frames:
    """Makes window specs for one physical form; handed to column builders."""

    def __init__(self, part: list[str], order: list[Column]):
        self._base = Window.partitionBy(*part).orderBy(*order)

    def __call__(self, n: int):
        """The last ``n`` rows including this one."""
        return self._base.rowsBetween(-(n - 1), 0)

    def span(self, lo: int, hi: int):
        return self._base.rowsBetween(lo, hi)

    def lag(self, col: str | Column, n: int = 1) -> Column:
        return F.lag(col, n).over(self._base)

    def lead(self, col: str | Column, n: int = 1) -> Column:
        return F.lead(col, n).over(self._base)

    def full(self, n: int, value: Column) -> Column:
        """``value`` once ``n`` rows exist, null in the warm-up before."""
        return F.when(F.col(IDX) >= n, value)

    def mean(self, col: str | Column, n: int) -> Column:
        return self.full(n, F.avg(col).over(self(n)))

    def total(self, col: str | Column, n: int) -> Column:
        return F.sum(col).over(self(n))


Level = dict[str, Callable[[Frames], Column]]


@dataclass
class Series:
    rows: DataFrame
    keys: list[str]
    order: list[str]
    blocked: bool = False
    pieces: DataFrame | None = field(default=None, repr=False)

    # -- construction -----------------------------------------------------
    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: Iterable[str],
        order: Iterable[str],
        max_rows: int = MAX_ROWS,
        block_rows: int = BLOCK_ROWS,
    ) -> "Series":
        keys, order = list(keys), list(order)
        if max_rows >= MAX_ROWS and size_estimate(df) < SMALL_BYTES:
            return cls._plain(df, keys, order)
        bound = getattr(df, "_row_bound", None)
        if bound is not None and set(keys) <= set(bound.columns):
            if (bound.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= max_rows:
                return cls._plain(df, keys, order)
        per_key = df.groupBy(*keys).count().agg(F.max("count").alias("longest"), F.sum("count").alias("total"))
        row = per_key.first()
        if (row["longest"] or 0) <= max_rows:
            return cls._plain(df, keys, order)
        return cls._sliced(df, keys, order, max(2, math.ceil(row["total"] / block_rows)))

    @classmethod
    def _plain(cls, df, keys, order) -> "Series":
        w = Window.partitionBy(*keys).orderBy(*order)
        return cls(df.withColumn(IDX, F.row_number().over(w).cast("bigint")), keys, order)

    @classmethod
    def _sliced(cls, df, keys, order, slices) -> "Series":
        cols = [F.col(c) for c in keys + order]
        cut = checkpointed(
            df.repartitionByRange(slices, *cols)
            .sortWithinPartitions(*cols)
            .withColumn(BLOCK, F.spark_partition_id())
        )
        # one row per (series, slice): at most (number of series + slices) rows
        ahead = Window.partitionBy(*keys).orderBy(BLOCK)
        pieces = checkpointed(
            cut.groupBy(*keys, BLOCK)
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_start", F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        )
        own = Window.partitionBy(*keys, BLOCK).orderBy(*order)
        rows = (
            cut.join(pieces.drop("_n"), [*keys, BLOCK])
            .withColumn(IDX, F.row_number().over(own) + F.col("_start"))
            .drop("_start")
        )
        return cls(rows, keys, order, True, pieces)

    # -- internals ----------------------------------------------------------
    @property
    def part(self) -> list[str]:
        return [*self.keys, BLOCK] if self.blocked else list(self.keys)

    def frames(self) -> Frames:
        return Frames(self.part, [F.col(c) for c in self.order])

    def _with(self, rows: DataFrame) -> "Series":
        return replace(self, rows=rows)

    @property
    def df(self) -> DataFrame:
        """The rows without the helper columns."""
        return self.rows.drop(IDX, BLOCK)

    def kept(self, cond: Column | str, *cols: str) -> "Series":
        """The series of the rows that satisfy ``cond``, numbered anew.  None
        grows, so the plain form stays and nothing is counted."""
        df = self.df.where(cond).select(*self.keys, *self.order, *cols)
        return Series.of(df, self.keys, self.order) if self.blocked else self._plain(df, self.keys, self.order)

    def only(self, *cols: str) -> "Series":
        """The same rows with these columns only: what passes through Arrow is
        not pruned by itself."""
        return self._with(self.rows.select(*dict.fromkeys([*self.part, *self.order, IDX, *cols])))

    # -- row-wise -------------------------------------------------------------
    def mutate(self, **cols: Column) -> "Series":
        return self._with(self.rows.withColumns(cols))

    # -- bounded frames ---------------------------------------------------------
    def bounded(self, back: int, *levels: Level, ahead: int = 0) -> "Series":
        """Add window columns that look at most ``back`` rows back and
        ``ahead`` rows forward (summed over all levels)."""
        rows = self._halo(back, ahead) if self.blocked else self.rows
        w = self.frames()
        for level in levels:
            rows = rows.withColumns({name: make(w) for name, make in level.items()})
        if self.blocked:
            rows = rows.where(~F.col("_guest")).drop("_guest")
        return self._with(rows)

    def _halo(self, back: int, ahead: int) -> DataFrame:
        own = self.rows.withColumn("_guest", F.lit(False))
        spans = self.pieces.groupBy(*self.keys).agg(
            F.sort_array(F.collect_list(F.struct("_start", "_n", BLOCK))).alias("_spans")
        ).where(F.size("_spans") > 1)
        ends = self.pieces.select(*self.keys, BLOCK, F.col("_start").alias("_lo"), (F.col("_start") + F.col("_n")).alias("_hi"))
        edge = (
            self.rows.join(ends, [*self.keys, BLOCK])
            .where((F.col(IDX) > F.col("_hi") - back) | (F.col(IDX) <= F.col("_lo") + ahead))
            .join(spans, self.keys)
        )
        i = F.col(IDX)

        def wanted(s):
            later = (s["_start"] >= i) & (i > s["_start"] - back)
            earlier = (s["_start"] + s["_n"] < i) & (i <= s["_start"] + s["_n"] + ahead)
            return later | earlier

        guests = (
            edge.withColumn("_to", F.explode(F.filter("_spans", wanted)))
            .withColumn(BLOCK, F.col(f"_to.{BLOCK}"))
            .drop("_to", "_spans", "_lo", "_hi")
            .withColumn("_guest", F.lit(True))
        )
        return own.unionByName(guests)

    def rolling(self, n: int, cols: list[str], outs: list[str], fn, short_ok: bool = False) -> "Series":
        """Columns from the last ``n`` rows that no built-in frame expresses.

        ``fn(windows)`` gets ``{col: array (rows, n)}`` of NumPy window views
        over the ordered Arrow batches and returns one array per output.
        With ``short_ok`` rows with fewer rows behind them are kept: ``fn`` asks
        for ``_i`` and masks positions that lie before its series.
        """
        if not self.blocked:
            return self._with(recur.run_windows(self.rows, IDX, n, cols, outs, fn, short_ok))
        rows = self._halo(n - 1, 0).repartition(*self.part).sortWithinPartitions(*self.part, *self.order)
        got = recur.run_windows(rows, IDX, n, cols, outs, fn, short_ok)
        return self._with(got.where(~F.col("_guest")).drop("_guest"))

    # -- running values from the start of the series -------------------------------
    def running(self, **specs: tuple[str, Column | str]) -> "Series":
        """``name=(kind, column)`` with kind sum / max / min / count / last.

        ``last`` is the latest non-null value at or before the row.
        """
        agg = {
            "sum": F.sum,
            "max": F.max,
            "min": F.min,
            "count": F.count,
            "last": lambda c: F.last(c, ignorenulls=True),
        }
        w = Window.partitionBy(*self.part).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        if not self.blocked:
            return self._with(self.rows.withColumns({n: agg[k](c).over(w) for n, (k, c) in specs.items()}))
        rows = self.rows.withColumns({n: agg[k](c).over(w) for n, (k, c) in specs.items()})
        ends = rows.groupBy(*self.keys, BLOCK).agg(*[F.max_by(n, IDX).alias(n) for n in specs])
        before = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        fold = {**agg, "count": F.sum}
        carry = ends.select(*self.keys, BLOCK, *[fold[k](n).over(before).alias(f"_c_{n}") for n, (k, _) in specs.items()])
        rows = rows.join(carry, [*self.keys, BLOCK], "left")
        for n, (kind, _) in specs.items():
            c, v = F.col(f"_c_{n}"), F.col(n)
            if kind in ("sum", "count"):
                merged = F.when(v.isNull() & c.isNull(), None).otherwise(F.coalesce(v, F.lit(0)) + F.coalesce(c, F.lit(0)))
            elif kind == "max":
                merged = F.greatest(c, v)
            elif kind == "min":
                merged = F.least(c, v)
            else:
                merged = F.coalesce(v, c)
            rows = rows.withColumn(n, merged).drop(f"_c_{n}")
        return self._with(rows)

    def next_value(self, **specs: Column | str) -> "Series":
        """The nearest non-null value at or after the row (needs the reverse order)."""
        w = Window.partitionBy(*self.part).orderBy(*self.order).rowsBetween(0, Window.unboundedFollowing)
        rows = self.rows.withColumns({n: F.first(c, ignorenulls=True).over(w) for n, c in specs.items()})
        if self.blocked:
            heads = rows.groupBy(*self.keys, BLOCK).agg(*[F.min_by(n, IDX).alias(n) for n in specs])
            after = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
            carry = heads.select(*self.keys, BLOCK, *[F.first(n, ignorenulls=True).over(after).alias(f"_c_{n}") for n in specs])
            rows = rows.join(carry, [*self.keys, BLOCK], "left")
            for n in specs:
                rows = rows.withColumn(n, F.coalesce(n, f"_c_{n}")).drop(f"_c_{n}")
        return self._with(rows)

    # -- whole-series values on every row ---------------------------------------------
    def totals(self, **aggs: Column) -> "Series":
        if self.blocked:
            whole = self.rows.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])
            return self._with(self.rows.join(whole, self.keys))
        w = Window.partitionBy(*self.keys)
        return self._with(self.rows.withColumns({n: c.over(w) for n, c in aggs.items()}))

    # -- recurrences --------------------------------------------------------------------
    def scan(self, *steps: recur.Step) -> "Series":
        """Run recurrences (see :mod:`tapeworks.plans.recur`)."""
        if not self.blocked:
            return self._with(recur.run_plain(self.rows, IDX, steps))
        return self._with(recur.run_blocked(self.rows, self.keys, BLOCK, self.order, IDX, steps))
