"""The given tables in their market-data roles.

lineitem -> trade ticks (symbol = supplier, venue = return flag), orders ->
order stream, supplier / nation -> instrument and venue dimensions, events ->
stream ticks and service metrics.  Only the needed columns are selected, so
scans stay pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import counted_by, no_larger_than

TICK_ORDER = ["ts", "o1", "o2", "o3", "price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(ts) -> "F.Column":
    """Days since 1970-01-01 of a timestamp column."""
    return F.unix_date(F.to_date(ts)).cast("bigint")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        day_number("l_shipdate").alias("day"),
        F.col("l_orderkey").alias("o1"),
        F.col("l_linenumber").alias("o2"),
        F.col("l_partkey").alias("o3"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"),   # tick size 0.01
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        F.col("l_returnflag").alias("venue"),
    )


def bars(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """Epoch-floored candles per symbol; ``t`` is the bucket number."""
    from tapeworks.operators.candles import ohlcv

    tk = ticks(spark, sf_dir).withColumn("t", F.floor(F.col("day") / days))
    return counted_by(ohlcv(tk, ["symbol", "t"], ["day", "o1", "o2", "o3", "price"]), tk)


def nation_returns(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """Weekly returns of 25 country baskets: the asset panel for risk jobs.

    Asset value per week is the volume-weighted price of all ticks of the
    country's suppliers; the return is its relative change.
    """
    from tapeworks.plans.series import Series

    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("asset"))
    tk = ticks(spark, sf_dir).withColumn("t", F.floor(F.col("day") / days))
    # pre-aggregate per symbol before the dimension join: far fewer rows are joined
    per_symbol = tk.groupBy("symbol", "t").agg(F.sum(F.col("price") * F.col("qty")).alias("notional"), F.sum("qty").alias("qty"))
    px = (
        per_symbol.join(sup, per_symbol.symbol == sup.s_suppkey)
        .groupBy("asset", "t")
        .agg((F.sum("notional") / F.sum("qty")).alias("px"))
    )
    s = Series.of(no_larger_than(px, tk), ["asset"], ["t"]).bounded(1, {"ret": lambda w: F.col("px") / w.lag("px") - 1})
    return no_larger_than(s.df.where("ret is not null").select("asset", "t", "ret", "px"), tk)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("notional"),
        F.col("o_orderdate").alias("ts"),
        day_number("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("priority"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id"), "event_type", "value", "props",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )


def positions(spark: SparkSession, sf_dir: str, before_day: int | None = None) -> DataFrame:
    """Net position per symbol from all ticks: side from the net quantity,
    entry = average price, mark = latest price, leverage 2 for suppliers with a
    balance above 5000, venue group = nation."""
    tk = ticks(spark, sf_dir)
    if before_day is not None:
        tk = tk.where(F.col("day") < before_day)
    net = tk.groupBy("symbol").agg(
        F.sum(F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))).alias("net"),
        (F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("entry_price"),
        F.max_by("price", F.struct(*TICK_ORDER)).alias("mark_price"),
    )
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    q = F.abs(F.col("net"))
    return net.join(sup, "symbol").select(
        "symbol", "nation", F.when(F.col("net") >= 0, "buy").otherwise("sell").alias("side"), q.alias("quantity"), "entry_price", "mark_price",
        F.when(F.col("s_acctbal") > 5000, 2.0).otherwise(1.0).alias("leverage"), (q * F.col("mark_price")).alias("notional"),
        (F.signum("net") * q * F.col("mark_price")).alias("signed"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: an order line is entered on the order date and left on the
    ship date; strategy = order priority; pnl = price * (discount - tax)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_shipdate", "l_linestatus", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = F.col
    x = li.join(o, c("l_orderkey") == c("o_orderkey")).select(
        c("o_orderpriority").alias("strategy_id"), c("l_suppkey").alias("symbol"), c("o_custkey").alias("account"), c("l_returnflag").alias("venue"),
        day_number("o_orderdate").alias("entry_day"), day_number("l_shipdate").alias("exit_day"),
        c("l_orderkey").alias("o1"), c("l_linenumber").alias("o2"), c("l_partkey").alias("o3"),
        (F.round(c("l_extendedprice") * (c("l_discount") - c("l_tax")) * 1.000000001, 2)).alias("pnl"),
        c("l_quantity").alias("qty"), (F.floor(c("l_extendedprice") / c("l_quantity") * 100) / 100).alias("price"),
        F.when(c("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        ((day_number("l_shipdate") - day_number("o_orderdate")) * 24.0).alias("hours"),
    )
    return no_larger_than(x, li)      # order keys are unique


TRADE_ORDER = ["exit_day", "o1", "o2", "o3", "pnl"]
