"""Topic messages: fixed schemas, parsing, validation with a reason, venue
dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required fields and property rules of the five topics.
TOPICS: dict[str, dict] = {
    "market-data": {
        "required": ["symbol", "exchange", "price", "timestamp", "data_type"],
        "types": {"symbol": "string", "exchange": "string", "price": "number", "quantity": "number", "timestamp": "string", "data_type": "string", "metadata": "object"},
        "enum": {"data_type": ["tick", "candle", "orderbook"]},
    },
    "signals": {
        "required": ["signal_id", "symbol", "direction", "strength", "strategy_id", "timestamp"],
        "types": {"signal_id": "string", "symbol": "string", "direction": "string", "strength": "number", "strategy_id": "string", "indicators": "object", "timestamp": "string"},
        "enum": {"direction": ["long", "short", "neutral"]},
        "range": {"strength": (0, 1)},
    },
    "orders": {
        "required": ["order_id", "symbol", "side", "order_type", "quantity", "action", "timestamp"],
        "types": {"order_id": "string", "symbol": "string", "side": "string", "order_type": "string", "quantity": "number", "price": "number", "action": "string", "strategy_id": "string", "timestamp": "string"},
        "enum": {"side": ["buy", "sell"], "action": ["submit", "cancel", "update"]},
    },
    "risk-events": {
        "required": ["event_type", "severity", "timestamp"],
        "types": {"event_type": "string", "severity": "string", "details": "object", "timestamp": "string"},
        "enum": {"severity": ["info", "warning", "critical"]},
    },
    "trades": {
        "required": ["trade_id", "order_id", "symbol", "side", "quantity", "price", "timestamp"],
        "types": {"trade_id": "string", "order_id": "string", "symbol": "string", "side": "string", "quantity": "number", "price": "number", "commission": "number", "exchange": "string", "timestamp": "string"},
        "enum": {"side": ["buy", "sell"]},
    },
}

# DDL used to read each topic with from_json
DDL = {
    topic: ", ".join(f"`{k}` {dict(string='string', number='double', object='map<string,string>')[v]}" for k, v in spec["types"].items())
    for topic, spec in TOPICS.items()
}


def invalid_reason(topic: str, json: Column) -> Column:
    """First broken rule of a JSON message, null when it is valid.  Topics
    without rules pass."""
    spec = TOPICS.get(topic)
    if spec is None:
        return F.lit(None).cast("string")
    doc = F.try_parse_json(json)
    field = lambda k: F.try_variant_get(doc, f"$.{k}", "variant")
    kind = lambda k: F.schema_of_variant(field(k))
    present = lambda k: field(k).isNotNull()
    reason = F.when(doc.isNull(), "not json")
    for k in spec["required"]:
        reason = reason.when(~present(k), f"missing {k}")
    for k, t in spec["types"].items():
        ok = {"string": kind(k) == "STRING", "number": kind(k).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "object": kind(k).startswith("OBJECT")}[t]
        reason = reason.when(present(k) & ~ok, f"type of {k}")
    for k, allowed in spec.get("enum", {}).items():
        reason = reason.when(~F.try_variant_get(doc, f"$.{k}", "string").isin(allowed), f"value of {k}")
    for k, (lo, hi) in spec.get("range", {}).items():
        x = F.try_variant_get(doc, f"$.{k}", "double")
        reason = reason.when((x < lo) | (x > hi), f"range of {k}")
    return reason


def parse(topic: str, df: DataFrame, json: str = "value") -> DataFrame:
    return df.withColumn("_m", F.from_json(F.col(json).cast("string"), DDL[topic])).select(*[c for c in df.columns if c != json], "_m.*")


# --- venue dialects --------------------------------------------------------------------
# Public trade messages; venues use field names that differ only in case, so
# they are read as maps.
ONE_TRADE = "map<string,string>"
TRADE_LIST = "data array<map<string,string>>"


def ticks_from_raw(raw: DataFrame, venues: tuple[str, str, str]) -> DataFrame:
    """Raw ``(venue, body)`` rows of three dialects to one tick shape.

    The dialect is chosen per row by venue, so one scan serves all venues and
    nested batches are exploded.
    """
    a, b, c = venues
    tick = lambda sym, px, q, side, ms, tid: F.struct(
        sym.alias("symbol"), px.cast("double").alias("price"), q.cast("double").alias("qty"), side.alias("side"), ms.cast("bigint").alias("ts_ms"), tid.cast("string").alias("trade_id")
    )
    body = F.col("body")
    m = F.from_json(body, ONE_TRADE)
    data = F.from_json(body, TRADE_LIST)["data"]
    one = F.array(tick(m["s"], m["p"], m["q"], F.when(m["m"] == "true", "sell").otherwise("buy"), m["T"], m["t"]))
    many_b = F.transform(data, lambda x: tick(x["s"], x["p"], x["v"], F.lower(x["S"]), x["T"], x["i"]))
    many_c = F.transform(data, lambda x: tick(F.replace(x["instId"], F.lit("-"), F.lit("")), x["px"], x["sz"], x["side"], x["ts"], x["tradeId"]))
    rows = F.when(F.col("venue") == a, one).when(F.col("venue") == b, many_b).when(F.col("venue") == c, many_c)
    return raw.select("venue", F.explode(rows).alias("k")).select("venue", "k.*")


def deltas_from_raw(raw: DataFrame) -> DataFrame:
    """Depth updates ``{"s": symbol, "u": id, "b": [[price, qty], ...], "a": ...}``
    to one row a level: raw columns but ``body``, symbol, update_id, side, price,
    qty, place.  Entries shorter than a pair are left out; a message with a
    price or quantity that is no number gives no rows."""
    body = F.from_json(F.col("body"), "s string, u bigint, b array<array<string>>, a array<array<string>>")

    def entries(col: Column, side: str) -> Column:
        pairs = F.filter(F.coalesce(col, F.array().cast("array<array<string>>")), lambda e: F.size(e) >= 2)
        return F.transform(pairs, lambda e: F.struct(F.lit(side).alias("side"), e[0].try_cast("double").alias("price"), e[1].try_cast("double").alias("qty")))

    keep = [c for c in raw.columns if c != "body"]
    m = raw.withColumn("_m", body).where(F.col("_m.s").isNotNull()).withColumn("_l", F.concat(entries(F.col("_m.b"), "buy"), entries(F.col("_m.a"), "sell")))
    whole = m.where(~F.exists("_l", lambda e: e["price"].isNull() | e["qty"].isNull()))
    return whole.select(*keep, F.col("_m.s").alias("symbol"), F.coalesce("_m.u", F.lit(0)).cast("bigint").alias("update_id"), F.posexplode("_l").alias("place", "_e")).select(*keep, "symbol", "update_id", "place", "_e.side", "_e.price", "_e.qty")
