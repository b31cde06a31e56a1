"""Exact percentiles per group without holding a group in one task.

Values are first counted per (group, value) with a map-side combine, the
counts are cumulated in value order (a running sum that slices hot groups),
and only the rows that carry a wanted rank survive.  Without keys all values are
one group, so they are sliced far earlier than a series that shares a stage with
others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.series import SMALL_BYTES, Series
from tapeworks.session import checkpointed, no_larger_than, size_estimate

WHOLE_ROWS = 250_000    # distinct values of all rows that one task sorts


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], **series_args) -> DataFrame:
    """One row per group: linear-interpolation percentile per name in ``probs``
    and the group's row count ``n``.  Null values are ignored."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    flat = keys or ["_all"]
    if not keys:
        cells = cells.withColumn("_all", F.lit(0))
    if hasattr(df, "_size_bound"):
        cells = no_larger_than(cells, df)
    if not keys and not series_args and size_estimate(cells) >= SMALL_BYTES:
        # stored: the count, the cut into slices and the sums read them
        cells, series_args = checkpointed(cells), {"max_rows": WHOLE_ROWS, "block_rows": WHOLE_ROWS}
    ranked = Series.of(cells, flat, [value], **series_args).totals(n=F.sum("_c")).running(_cum=("sum", "_c")).df
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1     # 0-based ranks this value covers
    aggs = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((first <= lo) & (lo <= last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi <= last), F.col(value))).alias(f"_hi_{name}"),
        ]
    got = ranked.groupBy(*flat).agg(F.max("n").alias("n"), *aggs)
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        got = got.withColumn(name, lo + (hi - lo) * (at - F.floor(at)))
    return got.select(*keys, "n", *probs)
