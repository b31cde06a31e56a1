"""Shared pieces of the SQL forms."""

TICK = """tick AS (
  SELECT l_suppkey AS symbol, l_shipdate AS ts,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day,
         l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3,
         floor(l_extendedprice / l_quantity * 100) / 100 AS price, l_quantity AS qty,
         CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_returnflag AS venue
  FROM lineitem)"""


def bars_cte(days: int = 7, name: str = "bar0") -> str:
    return f"""{TICK}, {name} AS (
  SELECT symbol, CAST(floor(day / {days}.0) AS BIGINT) AS t,
         first(price ORDER BY day, o1, o2, o3, price) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY day, o1, o2, o3, price) AS close, sum(qty) AS volume,
         sum(price * qty) AS quote_volume, count(*) AS trades,
         sum(CASE WHEN side = 'buy' THEN qty ELSE 0.0 END) AS taker_buy_volume,
         sum(CASE WHEN side = 'buy' THEN price * qty ELSE 0.0 END) AS taker_buy_quote
  FROM tick GROUP BY 1, 2)"""


BARS = bars_cte() + """, bar AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i,
         lag(close) OVER (PARTITION BY symbol ORDER BY t) AS pc,
         lag(high) OVER (PARTITION BY symbol ORDER BY t) AS ph,
         lag(low) OVER (PARTITION BY symbol ORDER BY t) AS pl,
         lag(volume) OVER (PARTITION BY symbol ORDER BY t) AS pv
  FROM bar0)"""

ASSET = TICK + """, px AS (
  SELECT s_nationkey AS asset, CAST(floor(day / 7.0) AS BIGINT) AS t, sum(price * qty) / sum(qty) AS px
  FROM tick JOIN supplier ON symbol = s_suppkey GROUP BY 1, 2),
ret AS (SELECT * FROM (
  SELECT asset, t, px, px / lag(px) OVER (PARTITION BY asset ORDER BY t) - 1 AS ret FROM px) WHERE ret IS NOT NULL)"""


def R(expr: str, digits: int = 4) -> str:
    """Reported rounding, the same guard as the Spark side."""
    return f"round(({expr}) * CAST(1.000000001 AS DOUBLE), {digits})"


def over(n: int, part: str = "symbol", order: str = "t") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def span(lo: int, hi: int, part: str = "symbol", order: str = "t") -> str:
    a = f"{-lo} PRECEDING" if lo < 0 else ("CURRENT ROW" if lo == 0 else f"{lo} FOLLOWING")
    b = f"{-hi} PRECEDING" if hi < 0 else ("CURRENT ROW" if hi == 0 else f"{hi} FOLLOWING")
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {a} AND {b})"


def full(n: int, expr: str) -> str:
    return f"CASE WHEN i >= {n} THEN {expr} END"


WALL = "OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
SERIES = "OVER (PARTITION BY symbol ORDER BY t)"

POS = TICK + """, net AS (
  SELECT symbol, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS net, sum(price * qty) / sum(qty) AS entry_price, arg_max(price, (ts, o1, o2, o3, price)) AS mark_price FROM tick GROUP BY 1),
pos AS (SELECT symbol, s_nationkey AS nation, CASE WHEN net >= 0 THEN 'buy' ELSE 'sell' END AS side, abs(net) AS quantity, entry_price, mark_price,
  CASE WHEN s_acctbal > 5000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS leverage, abs(net) * mark_price AS notional, net * mark_price AS signed FROM net JOIN supplier ON symbol = s_suppkey)"""

TRADE = """trade AS (
  SELECT o_orderpriority AS strategy_id, l_suppkey AS symbol, o_custkey AS account, l_returnflag AS venue,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS entry_day, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS exit_day,
    l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, round(l_extendedprice * (l_discount - l_tax) * CAST(1.000000001 AS DOUBLE), 2) AS pnl, l_quantity AS qty,
    floor(l_extendedprice / l_quantity * 100) / 100 AS price, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
    date_diff('day', o_orderdate, l_shipdate) * 24.0 AS hours
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# equity per strategy and day: 100000 plus the running sum of daily PnL
EQUITY = TRADE + """, dl AS (SELECT strategy_id, exit_day AS day, sum(pnl) AS pnl FROM trade GROUP BY 1, 2),
eq AS (SELECT *, round(100000 + sum(pnl) OVER (PARTITION BY strategy_id ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS equity, row_number() OVER (PARTITION BY strategy_id ORDER BY day) AS i FROM dl),
er AS (SELECT *, equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY day) - 1 AS ret FROM eq)"""
