"""Keyed state in event-time order.

Rows wait in a map state until the watermark has passed them, then they are
applied in the order of (event time, tie), so neither the cut into micro-batches
nor shuffled or late input (within the watermark's delay) changes the result.
Rows behind the watermark are dropped by the engine; a row that comes twice with
the same (event time, tie) counts once.  State is typed columns, so it can be
read with the state reader and evolve; nothing is pickled.  One event-time timer
a key wakes it at its earliest waiting row.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType, _parse_datatype_string

from tapeworks.plans.fold import Machine

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(v):
    """A Python value of what pandas hands over (missing is None)."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return v.item() if hasattr(v, "item") else v


class _Waiting(StatefulProcessor):
    """Holds rows back until the watermark is past them."""

    def __init__(self, cols: list[str], kinds: str, names: list[str]):
        self.cols, self.kinds, self.names = cols, kinds, names

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "us bigint, tie bigint", self.kinds)
        self.wake = handle.getValueState("wake", "ms bigint")

    def _set(self, ms: int | None) -> None:
        old = self.wake.get()[0] if self.wake.exists() else None
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.wake.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = self.wake.get()[0] if self.wake.exists() else None
        for part in rows:
            for us, tie, *values in part[["event_us", "event_tie", *self.cols]].itertuples(index=False, name=None):
                self.rows.updateValue((int(us), int(tie)), tuple(map(plain, values)))
                first = int(us) // 1000 if first is None else min(first, int(us) // 1000)
        self._set(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        self.wake.clear()                      # its timer is the one that fired
        due, rest = [], None
        for at, value in self.rows.iterator():
            if at[0] // 1000 <= until:
                due.append(((at[0], at[1]), tuple(value)))
            else:
                rest = at[0] // 1000 if rest is None else min(rest, at[0] // 1000)
        due.sort(key=lambda x: x[0])
        for at, _ in due:
            self.rows.removeKey(at)
        self._set(rest)
        got = [tuple(key) + tuple(o) for o in self.apply(due)]
        if got:
            yield pd.DataFrame(got, columns=self.names)

    def apply(self, due: list[tuple]) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Machines(_Waiting):
    """Runs a :class:`Machine` whose attributes are its class's ``FIELDS``."""

    def __init__(self, make: Callable[[], Machine], *args):
        super().__init__(*args)
        self.make = make

    def init(self, handle) -> None:
        super().init(handle)
        fields = type(self.make()).FIELDS
        self.attrs = [f.strip().split(" ")[0] for f in fields.split(",")]
        self.state = handle.getValueState("machine", fields)

    def apply(self, due):
        m = self.make()
        if self.state.exists():
            for name, v in zip(self.attrs, self.state.get()):
                setattr(m, name, v)
        out = [o for _, values in due for o in m.row(*values)]
        self.state.update(tuple(plain(getattr(m, a)) for a in self.attrs))
        return out


class _Book(_Waiting):
    """One symbol's book: an id not above the last one is stale (0 starts anew),
    a quantity of 0 ends a level, levels beyond ``depth`` are let go."""

    def __init__(self, depth: int, *args):
        super().__init__(*args)
        self.depth = depth

    def init(self, handle) -> None:
        super().init(handle)
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")
        self.last = handle.getValueState("last", "id bigint")

    def apply(self, due):
        last = self.last.get()[0] if self.last.exists() else 0
        book = {(k[0], k[1]): v[0] for k, v in self.levels.iterator()}
        held = dict(book)
        out = []
        for (us, tie), (body,) in due:
            m = json.loads(body)
            u = int(m.get("u") or 0)
            if u <= last and u != 0:
                continue
            last = u
            for side, entries in (("buy", m.get("b")), ("sell", m.get("a"))):
                for e in entries or ():
                    price, qty = float(e[0]), float(e[1])
                    if qty <= 0:
                        book.pop((side, price), None)
                    else:
                        book[side, price] = qty
            bids = sorted((p for s, p in book if s == "buy"), reverse=True)
            asks = sorted(p for s, p in book if s == "sell")
            for side, prices in (("buy", bids), ("sell", asks)):
                for p in prices[self.depth:]:
                    del book[side, p]
            out.append((tie, u, bids[0] if bids else None, asks[0] if asks else None, min(len(bids), self.depth), min(len(asks), self.depth)))
        for k in held.keys() - book.keys():
            self.levels.removeKey(k)
        for k, q in book.items():
            if held.get(k) != q:
                self.levels.updateValue(k, (q,))
        self.last.update((last,))
        return out


def _run(df: DataFrame, keys: list[str], ts: str, tie: str, late: str, cols: list[str], out: str, make: Callable) -> DataFrame:
    src = df.withColumns({"event_us": F.unix_micros(ts), "event_tie": F.col(tie).cast("bigint")}).withWatermark(ts, late).select(*keys, ts, "event_us", "event_tie", *[c for c in cols if c not in keys and c != ts])
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)
    fields = [df.schema[k] for k in keys] + list(_parse_datatype_string(out).fields)
    work = make(cols, kinds, [f.name for f in fields])
    return src.groupBy(*keys).transformWithStateInPandas(work, StructType(fields), "append", "eventTime")


def ordered_machine(df: DataFrame, keys: list[str], ts: str, tie: str, late: str, cols: list[str], make: Callable[[], Machine], out: str) -> DataFrame:
    """The machine of the batch fold, one a key, over rows in event-time order.
    ``cols`` are its arguments (not keys, nor ``ts``), ``out`` the DDL of what it
    yields."""
    return _run(df, keys, ts, tie, late, cols, out, lambda *a: _Machines(make, *a))


def local_book(messages: DataFrame, keys: list[str], ts: str, seq: str, late: str, body: str = "body", depth: int = 50) -> DataFrame:
    """Best prices and level counts after each depth message that counts
    (``{"u": id, "b": [[price, qty], ...], "a": ...}``)."""
    return _run(messages, keys, ts, seq, late, [body], "seq bigint, update_id bigint, bid double, ask double, bids int, asks int", lambda *a: _Book(depth, *a))
