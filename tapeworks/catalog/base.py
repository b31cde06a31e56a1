"""Small helpers for query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.plans.series import Series
from tapeworks.sources import market


# Reported numbers are rounded; exact halves (prices have two decimals) would
# round by the last bit of a sum, so a relative guard lifts them off the edge.
GUARD = 1.000000001


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * GUARD, digits)


def bar_series(spark: SparkSession, sf: str, days: int = 7) -> Series:
    return Series.of(market.bars(spark, sf, days), ["symbol"], ["t"])


def out(df: DataFrame, keys: list[str], digits: int = 4, **cols: Column | str) -> DataFrame:
    return df.select(*keys, *[r(c, digits).alias(n) for n, c in cols.items()])
