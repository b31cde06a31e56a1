"""One-line registration of per-bar operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.sql import BARS, R
from tapeworks.plans.series import Series


def windowed(
    name: str,
    fn: Callable[[Series], Series],
    cols: dict[str, str] | None = None,
    raw: dict[str, str] | None = None,
    ctes: str = "",
    src: str = "bar",
    recursive: bool = False,
    spark_cols: list[str] | None = None,
) -> None:
    """``cols``: rounded output -> SQL expression; ``raw``: exact output -> SQL."""
    cols, raw = cols or {}, raw or {}
    sel = ", ".join([f"{R(e)} AS {c}" for c, e in cols.items()] + [f"{e} AS {c}" for c, e in raw.items()])
    sql = f"WITH {'RECURSIVE ' if recursive else ''}{BARS}{', ' + ctes if ctes else ''} SELECT symbol, t, {sel} FROM {src}"

    @query(name, sql if (cols or raw) and src else None)
    def run(spark, sf):
        df = fn(bar_series(spark, sf)).df
        return df.select("symbol", "t", *[r(c).alias(c) for c in (cols or {})], *[F.col(c) for c in raw])
