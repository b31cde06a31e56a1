"""Column shorthands of a candle row (columns exist only once Spark runs)."""

from pyspark.sql import functions as F


class _Bar:
    o = property(lambda self: F.col("open"))
    h = property(lambda self: F.col("high"))
    l = property(lambda self: F.col("low"))
    c = property(lambda self: F.col("close"))
    v = property(lambda self: F.col("volume"))
    typical = property(lambda self: (self.h + self.l + self.c) / 3)


B = _Bar()
