"""Structured Streaming forms.  Every function takes and returns a DataFrame,
so the caller picks source, sink and trigger.  Late rows beyond the watermark
are dropped by the engine; inside it they update their window."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, _parse_datatype_string

from tapeworks.plans.fold import Machine

c = lambda n: F.col(n)


def candles(ticks: DataFrame, keys: list[str], ts: str, size: str, late: str, tie: list[str] = ()) -> DataFrame:
    """Tumbling candles, emitted once the watermark passes the window."""
    at = F.struct(ts, *tie)
    return (
        ticks.withWatermark(ts, late).groupBy(*keys, F.window(ts, size).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("trades"),
        )
        .select(*keys, c("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "trades")
    )


def sliding_vwap(ticks: DataFrame, keys: list[str], ts: str, size: str, slide: str, late: str) -> DataFrame:
    return (
        ticks.withWatermark(ts, late).groupBy(*keys, F.window(ts, size, slide).alias("w"))
        .agg((F.sum(c("price") * c("qty")) / F.sum("qty")).alias("vwap"))
        .select(*keys, c("w.end").alias("until"), "vwap")
    )


def sessions(ticks: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    return (
        ticks.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("ticks")).select(*keys, c("w.start").alias("start"), c("w.end").alias("end"), "ticks")
    )


def dedupe(ticks: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    return ticks.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def bounded_join(orders: DataFrame, fills: DataFrame, key: str, order_ts: str, fill_ts: str, within: str, late: str) -> DataFrame:
    """Fills within a time bound after their order; both sides are watermarked,
    so old state is dropped."""
    o = orders.withWatermark(order_ts, late).withColumnRenamed(key, "_ok")
    f = fills.withWatermark(fill_ts, late)
    on = (c("_ok") == c(key)) & (c(fill_ts) >= c(order_ts)) & (c(fill_ts) <= c(order_ts) + F.expr(f"INTERVAL {within}"))
    return o.join(f, on).drop("_ok")


def keyed_machine(df: DataFrame, keys: list[str], order: list[str], cols: list[str], make: Callable[[], Machine], out: str, ttl_ms: int | None = None) -> DataFrame:
    """Run the same :class:`Machine` the batch fold uses, one per key, with its
    state kept between micro-batches.

    Covers breakers, rate limits, detectors, alert gaps and the position
    ledger.  Rows are applied in ``order`` inside a micro-batch; ``ttl_ms``
    drops the state of a key that stays silent.
    """
    fields = [df.schema[k] for k in keys] + list(_parse_datatype_string(out).fields)
    schema = StructType(fields)
    names = [f.name for f in fields]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        m = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        got = [key + tuple(o) for row in rows[cols].itertuples(index=False, name=None) for o in m.row(*row)]
        state.update((cloudpickle.dumps(m),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        if got:
            yield pd.DataFrame(got, columns=names)

    return df.groupBy(*keys).applyInPandasWithState(step, schema, "m binary", "append", timeout)


class TickQuality(Machine):
    """Gap and move counters of one symbol with running rates."""

    FIELDS = "last bigint, price double, n int, gaps int, moves int"

    def __init__(self, gap: float, move: float):
        self.gap, self.move = gap, move
        self.last, self.price, self.n, self.gaps, self.moves = None, None, 0, 0, 0

    def row(self, t, price):
        self.n += 1
        if self.last is not None:
            self.gaps += t - self.last > self.gap
            self.moves += abs(price / self.price - 1) > self.move
        self.last, self.price = t, price
        yield t, self.n, int(self.gaps), int(self.moves)


class BookLevel(Machine):
    """One price level: older updates are dropped, zero quantity deletes."""

    FIELDS = "seen bigint"

    def __init__(self):
        self.seen = None

    def row(self, update_id, qty):
        if self.seen is None or update_id > self.seen:
            self.seen = update_id
            yield update_id, float(qty), qty == 0


class TokenBucket(Machine):
    """Violations of a rate limit with refill per unit of time."""

    FIELDS = "tokens double, at bigint"

    def __init__(self, size: float, refill: float):
        self.size, self.refill, self.tokens, self.at = size, refill, size, None

    def row(self, t):
        if self.at is not None:
            self.tokens = min(self.size, self.tokens + (t - self.at) * self.refill)
        self.at = t
        if self.tokens >= 1:
            self.tokens -= 1
        else:
            yield t, self.tokens


class AlertGate(Machine):
    """An alert repeats only after a gap; after ``limit`` repeats it escalates."""

    FIELDS = "at bigint, n int"

    def __init__(self, gap: float, limit: int):
        self.gap, self.limit, self.at, self.n = gap, limit, None, 0

    def row(self, t):
        if self.at is None or t - self.at >= self.gap:
            self.at = t
            self.n += 1
            yield t, "escalated" if self.n > self.limit else "sent"
