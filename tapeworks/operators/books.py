"""Order books held as level tables (symbol, side, price, qty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.series import IDX, Series
from tapeworks.session import checkpointed


def depth_walk(levels: DataFrame, keys: list[str], price: str, qty: float) -> DataFrame:
    """Average price of filling ``qty`` from the best level on, and slippage
    against the best price."""
    s = Series.of(levels, keys, [price]).running(_cum=("sum", "qty"))
    take = F.greatest(F.lit(0.0), F.least(F.col("qty"), qty - (F.col("_cum") - F.col("qty"))))
    x = s.df.withColumn("_take", take)
    filled, cost, best = F.sum("_take"), F.sum(F.col("_take") * F.col(price)), F.min(price)
    got = x.groupBy(*keys).agg(filled.alias("filled"), cost.alias("_cost"), best.alias("_best"))
    vwap = F.col("_cost") / F.col("filled")
    return got.select(*keys, "filled", vwap.alias("vwap"), F.when(F.col("_best") != 0, (vwap - F.col("_best")) / F.col("_best")).alias("slippage"))


def metrics(levels: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Best levels, mid, weighted mid, spread, imbalance of the top levels and
    side volumes; best levels come from one grouped aggregate."""
    from pyspark.sql import Window

    bid, ask = F.col("side") == "buy", F.col("side") == "sell"
    w = Window.partitionBy(*keys, "side").orderBy(F.when(bid, -F.col("price")).otherwise(F.col("price")))
    top = levels.withColumn("k", F.row_number().over(w)).where(F.col("k") <= depth)
    imb = top.groupBy(*keys).agg((F.sum(F.when(bid, F.col("qty")).otherwise(-F.col("qty"))) / F.sum("qty")).alias("imbalance"))
    best = levels.groupBy(*keys).agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"), F.min(F.when(ask, F.col("price"))).alias("ask"),
        F.max_by("qty", F.when(bid, F.col("price"))).alias("_bq"), F.min_by("qty", F.when(ask, F.col("price"))).alias("_aq"),
        F.sum(F.when(bid, F.col("qty")).otherwise(0.0)).alias("bid_volume"), F.sum(F.when(ask, F.col("qty")).otherwise(0.0)).alias("ask_volume"),
    )
    b, a = F.col("bid"), F.col("ask")
    mid = (b + a) / 2
    return best.join(imb, keys).withColumns(
        {
            "mid": mid, "weighted_mid": (b * F.col("_aq") + a * F.col("_bq")) / (F.col("_aq") + F.col("_bq")),
            "spread": a - b, "spread_pct": (a - b) / mid * 100,
        }
    ).drop("_aq", "_bq")


def trade_flow(ticks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Order-flow features of a bar from its trades."""
    at = F.struct(*order)
    g = ticks.groupBy(*by).agg(
        F.sum(F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))).alias("flow"), F.sum("qty").alias("vol"), F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("vwap"), F.min_by("price", at).alias("op"), F.max_by("price", at).alias("lp"),
    )
    c = F.col
    move = F.abs(c("lp") - c("op"))
    return g.withColumns(
        {
            "flow_imbalance": c("flow") / c("vol"), "flow_velocity": c("vol") / c("n"), "vwap_deviation": (c("lp") - c("vwap")) / c("vwap"), "vwap_ratio": c("lp") / c("vwap"),
            "impact_slope": F.when(c("n") > 5, move / (F.abs("flow") + 1e-8)).otherwise(0.0), "illiquidity": move / (c("vol") * c("lp") + 1e-12),
        }
    )


def whale_share(trades: DataFrame, keys: list[str], size: str, factor: float = 10.0) -> DataFrame:
    avg = trades.groupBy(*keys).agg(F.avg(size).alias("_a"))
    big = F.sum(F.when(F.col(size) > factor * F.col("_a"), F.col(size)).otherwise(0.0))
    return trades.join(avg, keys).groupBy(*keys).agg(F.least(F.lit(1.0), big / F.sum(size) * 5).alias("whale_score"))


# --- local books from depth updates -----------------------------------------------------
def accepted(messages: DataFrame, keys: list[str], seq: str, update_id: str) -> DataFrame:
    """Messages that a local book applies, in order of arrival (``seq``): an id
    above all applied before it.  An id of 0 is always applied and starts the
    count anew."""
    c = F.col
    s = Series.of(messages, keys, [seq]).running(_seg=("sum", F.when(c(update_id) == 0, 1).otherwise(0)))
    t = Series.of(s.df, [*keys, "_seg"], [seq]).running(_top=("max", update_id)).bounded(1, {"_before": lambda w: w.lag("_top")})
    ok = (c(update_id) == 0) | (c(update_id) > F.coalesce("_before", F.lit(0)))
    return t.df.where(ok).drop("_seg", "_top", "_before")


def level_lives(updates: DataFrame, keys: list[str], seq: str, place: str) -> DataFrame:
    """keys, side, price, qty, since, until: how long each quantity of a level
    stood (``until`` is null while it stands).  Of one message the last entry of
    a price counts; a quantity of 0 or less ends the level."""
    c = F.col
    last = updates.groupBy(*keys, "side", "price", seq).agg(F.max_by("qty", place).alias("qty"))
    s = Series.of(last, [*keys, "side", "price"], [seq]).bounded(0, {"until": lambda w: w.lead(seq)}, ahead=1)
    return s.df.where(c("qty") > 0).select(*keys, "side", "price", "qty", c(seq).alias("since"), "until")


def book_at(lives: DataFrame, moments: DataFrame, keys: list[str], at: str, depth: int) -> DataFrame:
    """The best ``depth`` levels of each side at each moment (keys, ``at``, an
    integer of the same kind as ``since``); k is 1 for the best.

    No book is replayed.  Time is counted in the moments of a key that have
    passed, so a life that no moment sees is gone.  A life is cut into dyadic
    blocks, at most two of each length, a moment lies in one block of each
    length, and both meet on (keys, length, block).  What is cut to a block stands
    all through it, so only the block's best ``depth`` levels go on: a moment
    meets a few of each length, however deep the book is.
    """
    from pyspark.sql import Window

    c = F.col
    lives = checkpointed(lives)
    m = checkpointed(moments.where(c(at).isNotNull()).select(*keys, at).distinct())

    def passed(rows: DataFrame, t: Column, name: str) -> DataFrame:
        """Adds the number of the key's moments before ``t``."""
        both = rows.withColumns({"_t": t, "_o": F.lit(0)}).unionByName(m.select(*keys, c(at).alias("_t"), F.lit(1).alias("_o")), allowMissingColumns=True)
        return Series.of(both, keys, ["_t", "_o"]).running(**{name: ("sum", "_o")}).df.where("_o = 0").drop("_t", "_o")

    spans = passed(passed(lives, c("since"), "_a"), F.coalesce("until", F.lit(2**63 - 1)), "_b").where("_a < _b")
    size = m.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    levels = F.sequence(F.lit(0), F.lit(int(size).bit_length()))
    two = lambda l: F.pow(F.lit(2.0), l).cast("bigint")
    low = lambda l: F.floor((c("_a") + two(l) - 1) / two(l))
    high = lambda l: F.floor(c("_b") / two(l))

    def blocks(l):
        a, b = low(l), high(l)
        one = lambda v: F.struct(l.alias("lv"), v.cast("bigint").alias("id"))
        return F.array(F.when((a < b) & (a % 2 == 1), one(a)), F.when((a < b) & (b % 2 == 1), one(b - 1)))

    cut = spans.select(*lives.columns, F.explode(F.array_compact(F.flatten(F.transform(levels, blocks)))).alias("_x")).select(*lives.columns, "_x.lv", "_x.id")
    better = F.when(c("side") == "buy", -c("price")).otherwise(c("price"))
    best = Window.partitionBy(*keys, "lv", "id", "side").orderBy(better)
    cut = cut.withColumn("_r", F.row_number().over(best)).where(c("_r") <= depth).drop("_r")
    m = Series.of(m, keys, [at]).rows.withColumn("lv", F.explode(levels))
    m = m.select(*keys, at, "lv", F.floor((c(IDX) - 1) / F.pow(F.lit(2.0), c("lv")).cast("bigint")).cast("bigint").alias("id"))
    met = m.join(cut, [*keys, "lv", "id"])
    w = Window.partitionBy(*keys, at, "side").orderBy(better)
    return met.withColumn("k", F.row_number().over(w)).where(c("k") <= depth).select(*keys, at, "side", "k", "price", "qty")
