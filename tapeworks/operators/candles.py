"""Ticks to candles, candle resampling, volume profiles, candle columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.series import IDX, Series


def ohlcv(ticks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One grouped aggregate (partial on the map side): first / last by order."""
    at = F.struct(*order)
    return ticks.groupBy(*by).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum(F.col("price") * F.col("qty")).alias("quote_volume"),
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(F.col("side") == "buy", F.col("qty")).otherwise(0.0)).alias("taker_buy_volume"),
        F.sum(F.when(F.col("side") == "buy", F.col("price") * F.col("qty")).otherwise(0.0)).alias("taker_buy_quote"),
    )


def merge_bars(bars: DataFrame, by: list[str], order: str) -> DataFrame:
    return bars.groupBy(*by).agg(
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bars"),
    )


def resample_by_count(bars: DataFrame, keys: list[str], order: str, ratio: int) -> DataFrame:
    """Chunks of ``ratio`` consecutive bars; the last chunk may be short."""
    rows = Series.of(bars, keys, [order]).rows.withColumn("chunk", F.floor((F.col(IDX) - 1) / ratio))
    return merge_bars(rows, [*keys, "chunk"], order)


def resample_by_clock(bars: DataFrame, keys: list[str], order: str, ratio: int) -> DataFrame:
    """Chunks aligned to the bucket number (the default form)."""
    return merge_bars(bars.withColumn("chunk", F.floor(F.col(order) / ratio)), [*keys, "chunk"], order)


def candle_shape() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "typical": (h + l + c) / 3,
        "range": h - l,
        "body": F.abs(c - o),
        "upper_wick": h - F.greatest(o, c),
        "lower_wick": F.least(o, c) - l,
        "bullish": c > o,
    }


def value_area(levels: DataFrame, keys: list[str], bins: int | None = None, share: float = 0.70, count_poc: bool = True) -> DataFrame:
    """Point of control and value area of binned volume.

    ``levels`` holds (keys, bin, vol), already summed per bin: bin in 0..bins-1,
    or, without ``bins``, from 0 to each group's own largest.  The area grows from the
    busiest bin towards the larger neighbour (ties go down) until ``share`` of
    the volume is inside; ``count_poc`` says whether the busiest bin's own
    volume counts towards the target.
    """
    filled = levels.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "vol"))).alias("_m"), F.sum("vol").alias("total"), (F.max("bin") if bins is None else F.lit(bins - 1)).cast("int").alias("_top")
    )
    at = lambda arr, i: F.coalesce(F.get(arr, i), F.lit(0.0))
    filled = filled.withColumn("_v", F.transform(F.sequence(F.lit(0), F.col("_top")), lambda i: F.coalesce(F.element_at("_m", i.cast("int")), F.lit(0.0))))
    filled = filled.withColumn("poc", (F.array_position("_v", F.array_max("_v")) - 1).cast("int"))
    v = F.col("_v")
    begin = F.struct(
        F.col("poc").alias("lo"), F.col("poc").alias("hi"),
        (at(v, F.col("poc")) if count_poc else F.lit(0.0)).alias("acc"),
    )
    top = F.col("_top")

    def grow(s, _):
        low_room, high_room = s["lo"] > 0, s["hi"] < top
        down = F.when(low_room, at(v, s["lo"] - 1)).otherwise(0.0)
        up = F.when(high_room, at(v, s["hi"] + 1)).otherwise(0.0)
        go_down = low_room & ((down >= up) | ~high_room)
        done = (s["acc"] >= F.col("total") * share) | (~low_room & ~high_room)
        return F.when(done, s).otherwise(
            F.struct(
                F.when(go_down, s["lo"] - 1).otherwise(s["lo"]).alias("lo"),
                F.when(go_down, s["hi"]).otherwise(s["hi"] + 1).alias("hi"),
                (s["acc"] + F.when(go_down, down).otherwise(up)).alias("acc"),
            )
        )

    area = F.aggregate(F.sequence(F.lit(0), F.col("_top")), begin, grow)
    return filled.withColumn("_a", area).select(*keys, "poc", F.col("_a.lo").alias("area_lo"), F.col("_a.hi").alias("area_hi"), "total")
