"""Features, drift, monitoring."""

import math

import numpy as np
from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.reports import equity
from tapeworks.catalog.risk import panel
from tapeworks.catalog.sql import ASSET, BARS, EQUITY, R, SERIES, TICK, TRADE, full, over, span
from tapeworks.catalog.structure import CU
from tapeworks.catalog.windowed import windowed
from tapeworks.functions import structure as S
from tapeworks.functions.draws import md5_mod_100
from tapeworks.operators import drift as D
from tapeworks.operators import reports as P
from tapeworks.operators.risk import both_ways
from tapeworks.plans.pairs import corr, pair_sums
from tapeworks.plans.recur import Affine
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

CUT = 9800


def long_ticks(spark, sf):
    """Three tick features in long form, split into two periods."""
    tk = market.ticks(spark, sf)
    part = F.when(F.col("day") < CUT, "reference").otherwise("current").alias("part")
    c = F.col
    return D.long_form(tk, [part, "day", (c("o2") * 1.0).alias("target")], {"price": c("price"), "qty": c("qty"), "notional": F.round(c("price") * c("qty"), 2)})


LONG = f"""{TICK}, lf AS (SELECT CASE WHEN day < {CUT} THEN 'reference' ELSE 'current' END AS part, day, o2 * 1.0 AS target, unnest(['price', 'qty', 'notional']) AS feature, unnest([price, qty, round(price * qty, 2)]) AS value FROM tick)"""


@query(
    "a26_feature_stats",
    f"WITH {LONG} SELECT feature, count(*) AS count, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, min(value) AS min, max(value) AS max, count(*) FILTER (isnan(value)) AS nan_count, count(*) FILTER (value = 0) AS zero_count, "
    + ", ".join(f"{R(f'quantile_cont(value, {p})')} AS {n}" for n, p in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))) + " FROM lf GROUP BY 1",
)
def a26(spark, sf):
    x = D.feature_stats(long_ticks(spark, sf))
    return x.select("feature", "count", r("mean").alias("mean"), r("std").alias("std"), "min", "max", "nan_count", "zero_count", *[r(p).alias(p) for p in ("p05", "p25", "p50", "p75", "p95")])


@query(
    "a27_feature_quality",
    f"""WITH {LONG}, b AS (SELECT feature, CAST(floor(day / 30) AS BIGINT) AS mon, avg(value) AS m, stddev_pop(value) AS s FROM lf GROUP BY 1, 2), st AS (SELECT feature, greatest(0, 1 - least(1, (stddev_pop(m) / (avg(m) + 1e-8) + stddev_pop(s) / (avg(s) + 1e-8)) / 2)) AS st FROM b GROUP BY 1),
g AS (SELECT feature, count(value) * 1.0 / count(*) AS co, count(DISTINCT value) * 1.0 / count(*) AS un, least(1, 2 * abs(corr(value, target))) AS pr FROM lf GROUP BY 1)
SELECT feature, {R('co', 6)} AS completeness, {R('un', 6)} AS uniqueness, {R('st', 6)} AS stability, {R('pr', 6)} AS predictiveness, {R('0.3 * co + 0.2 * un + 0.3 * st + 0.2 * pr', 6)} AS overall FROM g JOIN st USING (feature)""",
)
def a27(spark, sf):
    x = D.quality_scores(long_ticks(spark, sf).withColumn("mon", F.floor(F.col("day") / 30)), "mon", "target")
    return x.select("feature", *[r(k, 6).alias(k) for k in ("completeness", "uniqueness", "stability", "predictiveness", "overall")])


FCOLS = ["open", "high", "low", "volume", "trades"]


@query(
    "a28_feature_interactions",
    f"WITH {BARS}, y AS (SELECT *, lead(close) {SERIES} / close - 1 AS y FROM bar), p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS c, corr({a} * {b}, y) AS e FROM y WHERE y IS NOT NULL" for i, a in enumerate(FCOLS) for b in FCOLS[i + 1:])
    + f") SELECT f1, f2, {R('c', 6)} AS corr, {R('e', 6)} AS effect FROM p WHERE abs(c) >= 0.3",
)
def a28(spark, sf):
    """All pair correlations of a fixed feature list in one aggregate pass."""
    s = bar_series(spark, sf).bounded(0, {"y": lambda w: w.lead("close") / F.col("close") - 1}, ahead=1)
    pairs = [(a, b) for i, a in enumerate(FCOLS) for b in FCOLS[i + 1:]]
    one = s.df.where("y is not null").agg(*[x for a, b in pairs for x in (F.corr(a, b).alias(f"c_{a}_{b}"), F.corr(F.col(a) * F.col(b), F.col("y")).alias(f"e_{a}_{b}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), r(f"c_{a}_{b}", 6).alias("corr"), r(f"e_{a}_{b}", 6).alias("effect")) for a, b in pairs])
    return one.select(F.inline(rows)).where(F.abs("corr") >= 0.3)


PSI = f"""{LONG}, ed AS (SELECT feature, """ + ", ".join(f"quantile_cont(value, {k / 10}) AS q{k}" for k in range(1, 10)) + """ FROM lf WHERE part = 'reference' GROUP BY 1),
bn AS (SELECT feature, part, """ + " + ".join(f"CASE WHEN value >= q{k} THEN 1 ELSE 0 END" for k in range(1, 10)) + """ AS bin FROM lf JOIN ed USING (feature)),
ct AS (SELECT feature, bin, count(*) FILTER (part = 'reference') * 1.0 / any_value(nr) AS p, count(*) FILTER (part = 'current') * 1.0 / any_value(nc) AS q FROM bn JOIN (SELECT feature, count(*) FILTER (part = 'reference') AS nr, count(*) FILTER (part = 'current') AS nc FROM lf GROUP BY 1) USING (feature) GROUP BY 1, 2),
ps AS (SELECT feature, sum(CASE WHEN p > 0 AND q > 0 THEN (p - q) * ln(p / q) ELSE 0 END) AS psi, sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))) AS psc FROM ct GROUP BY 1)"""


@query("a29_psi", f"WITH {PSI} SELECT feature, {R('psi', 6)} AS psi, {R('psc', 6)} AS psi_clipped FROM ps")
def a29(spark, sf):
    return D.psi(long_ticks(spark, sf)).select("feature", r("psi", 6).alias("psi"), r("psi_clipped", 6).alias("psi_clipped"))


RANK = f"""{LONG}, nn AS (SELECT feature, count(*) FILTER (part = 'reference') AS m, count(*) FILTER (part = 'current') AS n FROM lf GROUP BY 1),
vc AS (SELECT feature, value, count(*) FILTER (part = 'reference') AS a, count(*) FILTER (part = 'current') AS b FROM lf GROUP BY 1, 2), cu AS (SELECT feature, value, a, b, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value)),
rk AS (SELECT feature, part, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM lf), rs AS (SELECT feature, sum(rk) FILTER (part = 'reference') AS rs FROM rk GROUP BY 1),
ks AS (SELECT feature, m, n, max(abs(ca / m - cb / n)) AS ks FROM cu JOIN nn USING (feature) GROUP BY 1, 2, 3)"""


@query(
    "a31_a32_rank_tests",
    f"WITH {RANK} SELECT feature, m, n, {R('ks', 6)} AS ks, {R('(rs - m * (m + n + 1) / 2.0) / sqrt(m * n * (m + n + 1.0) / 12)')} AS rank_z, {R('rs - m * (m + 1) / 2.0', 1)} AS u_statistic FROM ks JOIN rs USING (feature)",
)
def a31(spark, sf):
    return D.rank_tests(long_ticks(spark, sf)).select("feature", "m", "n", r("ks", 6).alias("ks"), r("rank_z").alias("rank_z"), r("u_statistic", 1).alias("u_statistic"))


WELCH = f"""{TRADE}, vt AS (SELECT CASE WHEN venue = 'A' THEN 'A' ELSE 'B' END AS variant, strategy_id, pnl FROM trade),
w AS (SELECT strategy_id, count(*) FILTER (variant = 'A') AS n1, count(*) FILTER (variant = 'B') AS n2, avg(pnl) FILTER (variant = 'A') AS m1, avg(pnl) FILTER (variant = 'B') AS m2, var_samp(pnl) FILTER (variant = 'A') AS v1, var_samp(pnl) FILTER (variant = 'B') AS v2 FROM vt GROUP BY 1),
d AS (SELECT *, (m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM w)"""


@query(
    "a33_welch_effect",
    f"WITH {WELCH} SELECT strategy_id, n1, n2, {R('(m2 - m1) / sqrt(v1 / n1 + v2 / n2)')} AS t, {R('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))', 2)} AS dof, {R('d', 6)} AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d",
)
def a33(spark, sf):
    t = market.trades(spark, sf).withColumn("variant", F.when(F.col("venue") == "A", "A").otherwise("B"))
    x = D.two_sample(t, ["strategy_id"], "variant", "A", "B", "pnl")
    return x.select("strategy_id", "n1", "n2", r("t").alias("t"), r("dof", 2).alias("dof"), r("d", 6).alias("d"), "effect")


MOD = lambda k: f"(('0x' || substr(md5({k}), 1, 16))::UBIGINT % 100 * 16 + ('0x' || substr(md5({k}), 17, 16))::UBIGINT % 100) % 100"


@query("x25_a65_variant_split", f"WITH v AS (SELECT user_id, CAST({MOD(chr(39) + 'salt:' + chr(39) + ' || event_id')} AS BIGINT) AS slot FROM events) SELECT CASE WHEN slot < 50 THEN 'A' ELSE 'B' END AS variant, count(*) AS n, CAST(sum(slot) AS BIGINT) AS checksum FROM v GROUP BY 1")
def x25(spark, sf):
    e = market.events(spark, sf).select(md5_mod_100(F.concat(F.lit("salt:"), F.col("event_id").cast("string"))).alias("slot"))
    return e.groupBy(F.when(F.col("slot") < 50, "A").otherwise("B").alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.sum("slot").alias("checksum"))


AB = f"""{TRADE}, v AS (SELECT CASE WHEN venue = 'A' THEN 'A' ELSE 'B' END AS variant, pnl, hours, exit_day FROM trade), dl AS (SELECT variant, exit_day, sum(pnl) AS p FROM v GROUP BY 1, 2),
cu AS (SELECT variant, exit_day, sum(p) OVER (PARTITION BY variant ORDER BY exit_day) AS c FROM dl), pk AS (SELECT variant, max(c) OVER (PARTITION BY variant ORDER BY exit_day) - c AS dd FROM cu), dd AS (SELECT variant, max(dd) AS dd FROM pk GROUP BY 1),
g AS (SELECT variant, count(*) AS n, avg(pnl) AS m, stddev_pop(pnl) AS s, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS w, sum(pnl) AS t, avg(hours) AS lat FROM v GROUP BY 1)"""


@query(
    "a34_ab_comparison",
    f"WITH {AB} SELECT variant, n AS sample_count, {R('m')} AS mean_return, {R('m / s', 6)} AS sharpe_ratio, {R('w', 6)} AS win_rate, {R('t', 2)} AS total_pnl, {R('lat')} AS avg_latency, {R('dd', 2)} AS max_drawdown, (SELECT arg_max(variant, m / s) FROM g) AS winner FROM g JOIN dd USING (variant)",
)
def a34(spark, sf):
    t = market.trades(spark, sf).withColumn("variant", F.when(F.col("venue") == "A", "A").otherwise("B"))
    g = t.groupBy("variant").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("pnl").alias("m"), (F.avg("pnl") / F.stddev_pop("pnl")).alias("sr"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("w"),
        F.sum("pnl").alias("t"), F.avg("hours").alias("lat"),
    )
    daily = t.groupBy("variant", "exit_day").agg(F.sum("pnl").alias("p"))
    s = Series.of(daily, ["variant"], ["exit_day"]).running(c=("sum", "p")).running(pk=("max", "c"))
    dd = s.df.groupBy("variant").agg(F.max(F.col("pk") - F.col("c")).alias("dd"))
    best = g.agg(F.max_by("variant", "sr").alias("winner"))
    return g.join(dd, "variant").join(F.broadcast(best), F.lit(True)).select(
        "variant", "sample_count", r("m").alias("mean_return"), r("sr", 6).alias("sharpe_ratio"), r("w", 6).alias("win_rate"), r("t", 2).alias("total_pnl"), r("lat").alias("avg_latency"), r("dd", 2).alias("max_drawdown"), "winner"
    )


@query("a35_drift_verdict")
def a35(spark, sf):
    lf = long_ticks(spark, sf)
    eff = D.two_sample(lf, ["feature"], "part", "reference", "current", "value").select("feature", F.col("d").alias("effect_size"))
    x = D.drift_verdict(D.rank_tests(lf), D.psi(lf), eff)
    return x.select("feature", r("ks", 6).alias("ks"), r("ks_p", 6).alias("ks_p"), r("rank_p", 6).alias("rank_p"), r("psi", 6).alias("psi"), r("effect_size", 6).alias("effect_size"), "is_drift", "severity")


@query(
    "a36_concept_drift",
    f"""WITH {LONG}, c AS (SELECT part, feature, abs(corr(value, target)) AS c FROM lf GROUP BY 1, 2), a AS (SELECT avg(c) FILTER (part = 'reference') AS r, avg(c) FILTER (part = 'current') AS u FROM c)
SELECT {R('r', 6)} AS reference_corr, {R('u', 6)} AS current_corr, {R('abs(u - r)', 6)} AS shift, abs(u - r) > 0.1 AS is_drift FROM a""",
)
def a36(spark, sf):
    c = long_ticks(spark, sf).groupBy("part", "feature").agg(F.abs(F.corr("value", "target")).alias("c"))
    a = c.agg(F.avg(F.when(F.col("part") == "reference", F.col("c"))).alias("r"), F.avg(F.when(F.col("part") == "current", F.col("c"))).alias("u"))
    shift = F.abs(F.col("u") - F.col("r"))
    return a.select(r("r", 6).alias("reference_corr"), r("u", 6).alias("current_corr"), r(shift, 6).alias("shift"), (shift > 0.1).alias("is_drift"))


@query(
    "a37_distribution_comparison",
    f"""WITH {LONG}, sp AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lf GROUP BY 1), b AS (SELECT feature, part, CAST(least(19, floor((value - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin FROM lf JOIN sp USING (feature)),
g AS (SELECT feature, bin, count(*) FILTER (part = 'reference') AS ref_count, count(*) FILTER (part = 'current') AS cur_count FROM b GROUP BY 1, 2)
SELECT feature, bin, ref_count, cur_count, {R('ref_count / sum(ref_count) OVER (PARTITION BY feature)', 6)} AS ref_share, {R('cur_count / sum(cur_count) OVER (PARTITION BY feature)', 6)} AS cur_share FROM g""",
)
def a37(spark, sf):
    x = D.histogram(long_ticks(spark, sf), 20)
    return x.select("feature", "bin", "ref_count", "cur_count", r("ref_share", 6).alias("ref_share"), r("cur_share", 6).alias("cur_share"))


@query(
    "a38_retrain_trigger",
    """WITH RECURSIVE d AS (SELECT 'm' || (user_id % 5) AS model, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, count(DISTINCT event_type) AS n FROM events WHERE value > 100 GROUP BY 1, 2), h AS (SELECT * FROM d WHERE n >= 3),
k AS (SELECT model, min(t) AS t FROM h GROUP BY 1 UNION ALL SELECT model, nt FROM (SELECT k.model, min(h.t) AS nt FROM k JOIN h ON h.model = k.model AND h.t >= k.t + 3 GROUP BY k.model, k.t))
SELECT model, t, n AS features FROM k JOIN h USING (model, t)""",
)
def a38(spark, sf):
    """Days with at least 3 alerting features per model, 3 days apart."""
    e = market.events(spark, sf).where("value > 100")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    a = e.select(F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), day.alias("t"), F.col("event_type").alias("feature"))
    return D.retrain_trigger(a, "t", 3, 3)


def predictions(spark, sf):
    """Predictions stand-in: probability from the price's lower digits, correct
    when the line is open; model = venue, regime = quantity class."""
    li = market.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("model"), F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("regime"), F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"), F.col("l_partkey").alias("o3"), F.col("l_extendedprice").alias("o4"), ((F.col("l_extendedprice") % 1000) / 1000).alias("prob"), (F.col("l_linestatus") == "O").alias("correct"),
    )


PRED = "pd AS (SELECT l_returnflag AS model, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS regime, l_shipdate AS ts, l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_extendedprice AS o4, (l_extendedprice % 1000) / 1000 AS prob, l_linestatus = 'O' AS correct FROM lineitem)"
ACC = f"""{PRED}, rn AS (SELECT *, row_number() OVER (PARTITION BY model, regime ORDER BY ts DESC, o1 DESC, o2 DESC, o3 DESC, o4 DESC) AS k FROM pd),
ac AS (SELECT model, regime, avg(correct::INT) FILTER (k <= 1000) AS a, avg(correct::INT) FILTER (k > 1000) AS b, count(*) FILTER (k <= 1000) AS n FROM rn GROUP BY 1, 2)"""
PO = ["ts", "o1", "o2", "o3", "o4"]


@query("a39_model_accuracy", f"WITH {ACC} SELECT model, regime, n AS samples, {R('a', 6)} AS accuracy, {R('b', 6)} AS baseline, {R('(b - a) / b', 6)} AS drop, {R('(b - a) / sqrt((a + b) / 2 * (1 - (a + b) / 2) * 2 / n)')} AS z FROM ac")
def a39(spark, sf):
    x = D.rolling_accuracy(predictions(spark, sf), ["model", "regime"], PO)
    return x.select("model", "regime", "samples", *[r(k, 6).alias(k) for k in ("accuracy", "baseline", "drop")], r("z").alias("z"))


BIN = f"{PRED}, rb AS (SELECT model, CAST(least(9, floor(prob * 10)) AS INTEGER) AS bin, avg(correct::INT) AS a, avg(prob) AS c, count(*) AS n FROM pd GROUP BY 1, 2)"


@query("a40_reliability_bins", f"WITH {BIN} SELECT model, bin, n, {R('a', 6)} AS accuracy, {R('c', 6)} AS confidence FROM rb")
def a40(spark, sf):
    return D.reliability(predictions(spark, sf), ["model"]).select("model", "bin", "n", r("accuracy", 6).alias("accuracy"), r("confidence", 6).alias("confidence"))


@query("a40_calibration_error", f"WITH {BIN} SELECT model, {R('sum(n * abs(a - c)) / sum(n)', 6)} AS ece FROM rb GROUP BY 1")
def a40e(spark, sf):
    return D.expected_calibration_error(D.reliability(predictions(spark, sf), ["model"]), ["model"]).select("model", r("ece", 6).alias("ece"))


@query(
    "a67_model_comparison",
    f"WITH {ACC}, rb AS (SELECT model, least(9, floor(prob * 10)) AS bin, avg(correct::INT) AS a, avg(prob) AS c, count(*) AS n FROM pd GROUP BY 1, 2), e AS (SELECT model, sum(n * abs(a - c)) / sum(n) AS ece FROM rb GROUP BY 1), al AS (SELECT model, count(*) FILTER (b - a > 0.01) AS alerts, avg(a) AS acc FROM ac GROUP BY 1) "
    f"SELECT model, {R('acc', 6)} AS accuracy, {R('ece', 6)} AS ece, alerts, CASE WHEN alerts > 1 THEN 'degraded' WHEN alerts = 1 THEN 'warning' ELSE 'healthy' END AS status FROM al JOIN e USING (model)",
)
def a67(spark, sf):
    p = predictions(spark, sf)
    acc = D.rolling_accuracy(p, ["model", "regime"], PO)
    al = acc.groupBy("model").agg(F.avg("accuracy").alias("acc"), F.count_if(F.col("baseline") - F.col("accuracy") > 0.01).alias("alerts"))
    e = D.expected_calibration_error(D.reliability(p, ["model"]), ["model"])
    n = F.col("alerts")
    return al.join(e, "model").select("model", r("acc", 6).alias("accuracy"), r("ece", 6).alias("ece"), "alerts", F.when(n > 1, "degraded").when(n == 1, "warning").otherwise("healthy").alias("status")).orderBy(F.desc_nulls_last("accuracy"))


@query(
    "a41_service_metrics",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.5)')} AS p50, {R('quantile_cont(value, 0.95)')} AS p95, {R('quantile_cont(value, 0.99)')} AS p99,
 {R("avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END)", 6)} AS error_rate, {R("avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END)", 6)} AS hit_rate, {R('count(*) / 86400.0', 6)} AS throughput FROM events GROUP BY 1""",
)
def a41(spark, sf):
    from tapeworks.plans.quantiles import exact_percentiles

    e = market.events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    share = lambda k: F.avg(F.when(F.col("event_type") == k, 1.0).otherwise(0.0))
    g = e.groupBy("day").agg(F.count(F.lit(1)).alias("requests"), F.avg("value").alias("mean"), share("error").alias("error_rate"), share("view").alias("hit_rate"))
    q = exact_percentiles(e, ["day"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    return g.join(q, "day").select("day", "requests", *[r(k).alias(k) for k in ("mean", "p50", "p95", "p99")], *[r(k, 6).alias(k) for k in ("error_rate", "hit_rate")], r(F.col("requests") / 86400.0, 6).alias("throughput"))


@query(
    "a42_strategy_regime_summary",
    f"""WITH {TRADE}, g AS (SELECT strategy_id, CASE WHEN price > 2000 THEN 'high' ELSE 'low' END AS regime, pnl FROM trade)
SELECT coalesce(strategy_id, '*') AS strategy_id, coalesce(regime, '*') AS regime, count(*) AS trades, {R('avg(pnl)')} AS avg_pnl, {R('sum(pnl)', 2)} AS pnl FROM g GROUP BY ROLLUP (strategy_id, regime)""",
)
def a42(spark, sf):
    t = market.trades(spark, sf).withColumn("regime", F.when(F.col("price") > 2000, "high").otherwise("low"))
    x = t.rollup("strategy_id", "regime").agg(F.count(F.lit(1)).alias("trades"), r(F.avg("pnl")).alias("avg_pnl"), r(F.sum("pnl"), 2).alias("pnl"))
    return x.select(F.coalesce("strategy_id", F.lit("*")).alias("strategy_id"), F.coalesce("regime", F.lit("*")).alias("regime"), "trades", "avg_pnl", "pnl")


@query(
    "a61_degradation_trigger",
    f"""WITH RECURSIVE {BARS}, {CU}, rc AS (SELECT symbol, t, i, avg(r) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rec FROM b0), j AS (SELECT k.symbol, k.t, k.i, b, rec, up, dn FROM k JOIN rc ON rc.symbol = k.symbol AND rc.t = k.t),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS z FROM j)
SELECT symbol, {R('b')} AS baseline, {R('rec')} AS recent, {R('up')} AS cusum_pos, {R('dn')} AS cusum_neg, i >= 50 AND (b - rec > 0.3 OR up > 5 OR dn > 5) AS degraded FROM l WHERE z = 1""",
)
def a61(spark, sf):
    """Latest state per series: baseline against the mean of the last 50, CUSUM."""
    s = bar_series(spark, sf).bounded(1, {"r": lambda w: F.col("close") / w.lag("close") - 1})
    s = Series.of(s.df.where("r is not null").select("symbol", "t", "r"), ["symbol"], ["t"]).bounded(49, {"rec": lambda w: F.avg("r").over(w(50))})
    s = S.cusum(s, "r")
    g = s.rows.groupBy("symbol").agg(F.max_by(F.struct("baseline", "rec", "cusum_pos", "cusum_neg", IDX), "t").alias("x")).select("symbol", "x.*")
    c = F.col
    bad = (c(IDX) >= 50) & ((c("baseline") - c("rec") > 0.3) | (c("cusum_pos") > 5) | (c("cusum_neg") > 5))
    return g.select("symbol", r("baseline").alias("baseline"), r("rec").alias("recent"), r("cusum_pos").alias("cusum_pos"), r("cusum_neg").alias("cusum_neg"), bad.alias("degraded"))


@query("a69_class_weights", "WITH c AS (SELECT event_type AS regime, count(*) AS n FROM events GROUP BY 1) SELECT regime, n, round((SELECT sum(n) FROM c) * 1.0 / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def a69(spark, sf):
    c = market.events(spark, sf).groupBy(F.col("event_type").alias("regime")).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("tot"), F.count(F.lit(1)).alias("k"))
    return c.join(F.broadcast(t), F.lit(True)).select("regime", "n", F.round(F.col("tot") / (F.col("k") * F.col("n")), 6).alias("weight"))


# --- feature tables -----------------------------------------------------------------------------
RT = "rt AS (SELECT *, close / pc - 1 AS r FROM bar)"
SQ = "sqrt(252)"


def deviations(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``x`` (NaN is no value): count, mean, differences to the
    mean; those of equal values are exactly zero."""
    ok = ~np.isnan(x)
    n = ok.sum(axis=-1)
    mean = np.where(ok, x, 0.0).sum(axis=-1) / n
    flat = np.where(ok, x, np.inf).min(axis=-1) == np.where(ok, x, -np.inf).max(axis=-1)
    return n, mean, np.where(ok & ~flat[..., None], x - mean[..., None], 0.0)


def spread(x: np.ndarray) -> np.ndarray:
    n, _, d = deviations(x)
    return np.sqrt((d * d).sum(axis=-1) / n)


def some(x: np.ndarray) -> np.ndarray:
    """Sums of the values; NaN where there is none."""
    ok = ~np.isnan(x)
    return np.where(ok.any(axis=-1), np.where(ok, x, 0.0).sum(axis=-1), np.nan)


def _regimes(v: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    i = v[IDX][:, -1]
    own = np.arange(100) >= 100 - i[:, None]      # the rest lies before the series
    ret, close, volume = (np.where(own, v[k], np.nan) for k in ("r", "close", "volume"))
    chunks = [spread(ret[:, 80 - 20 * j : 100 - 20 * j]) for j in range(5)]
    y = close[:, 50:]
    k = np.where(np.isnan(y), np.nan, np.arange(50.0))
    _, level, dy = deviations(y)
    _, _, dk = deviations(k)
    slope = (dy * dk).sum(axis=1) / (dk * dk).sum(axis=1)
    n = lambda x: (~np.isnan(x)).sum(axis=1)
    volume_20, volume_100 = some(volume[:, 80:]), some(volume)
    return chunks[0], spread(ret), slope / level, some((ret * volume)[:, 80:]) / volume_20, (volume_20 / n(volume[:, 80:])) / (volume_100 / n(volume)), *chunks


def regime_features(s: Series) -> Series:
    s = s.bounded(1, {"r": lambda w: F.col("close") / w.lag("close") - 1})
    full = ["realised", "_long", "trend", "ad_score", "volume_pct"]
    s = s.rolling(100, ["r", "close", "volume", IDX], [*full, *[f"_c{j}" for j in range(5)]], _regimes, short_ok=True)
    root = {"realised": math.sqrt(252), "_long": math.sqrt(252)}
    s = s.mutate(**{k: F.when(F.col(IDX) >= 101, F.col(k) * F.lit(root.get(k, 1.0))) for k in full})
    cs = [F.col(f"_c{j}") for j in range(5)]
    mean = sum(cs, F.lit(0.0)) / 5
    sd = F.sqrt(sum((F.pow(x - mean, 2) for x in cs), F.lit(0.0)) / 5)
    s = s.mutate(vol_pct=F.col("realised") / (F.col("_long") + 1e-8))
    s = s.mutate(
        vol_regime=F.when(F.col("vol_pct") < 0.5, 0).when(F.col("vol_pct") > 1.5, 2).otherwise(1), trend_regime=F.when(F.abs("trend") < 1e-5, 0).when(F.col("trend") > 0, 1).otherwise(-1),
        liquidity_regime=F.when(F.col("volume_pct") < 0.5, 0).when(F.col("volume_pct") > 1.5, 2).otherwise(1), stability=F.greatest(F.lit(0.0), 1 - sd / (mean + 1e-8)),
    )
    return s


@query(
    "w75_regime_features",
    f"""WITH {BARS}, {RT}, c AS (SELECT symbol, t, i, stddev_pop(r) {over(20)} * {SQ} AS rv, stddev_pop(r) {over(100)} * {SQ} AS lg, regr_slope(close, i) {over(50)} / avg(close) {over(50)} AS tr, sum(r * volume) {over(20)} / sum(volume) {over(20)} AS ad, avg(volume) {over(20)} / avg(volume) {over(100)} AS vp,
 [""" + ", ".join(f"stddev_pop(r) {span(-20 * (j + 1) + 1, -20 * j)}" for j in range(5)) + f"""] AS cs FROM rt)
SELECT symbol, t, {R('rv')} AS realised, {R('rv / (lg + 1e-8)')} AS vol_pct, {R('tr', 6)} AS trend, {R('ad', 6)} AS ad_score, {R('vp')} AS volume_pct, {R('greatest(0, 1 - list_stddev_pop(cs) / (list_avg(cs) + 1e-8))')} AS stability,
 CASE WHEN rv / (lg + 1e-8) < 0.5 THEN 0 WHEN rv / (lg + 1e-8) > 1.5 THEN 2 ELSE 1 END AS vol_regime, CASE WHEN abs(tr) < 1e-5 THEN 0 WHEN tr > 0 THEN 1 ELSE -1 END AS trend_regime, CASE WHEN vp < 0.5 THEN 0 WHEN vp > 1.5 THEN 2 ELSE 1 END AS liquidity_regime FROM c WHERE i >= 101""",
)
def w75(spark, sf):
    s = regime_features(bar_series(spark, sf).only("close", "volume"))
    return s.rows.where(F.col(IDX) >= 101).select(
        "symbol", "t", r("realised").alias("realised"), r("vol_pct").alias("vol_pct"), r("trend", 6).alias("trend"), r("ad_score", 6).alias("ad_score"), r("volume_pct").alias("volume_pct"), r("stability").alias("stability"),
        "vol_regime", "trend_regime", "liquidity_regime",
    )


def _return_moments(v: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    n, mean, d = deviations(v["_r"])
    m2, m3, m4 = ((d ** k).sum(axis=1) / n for k in (2, 3, 4))
    return mean, np.sqrt(m2), m3 / m2 ** 1.5, m4 / (m2 * m2) - 3, some(v["volume"]) / (~np.isnan(v["volume"])).sum(axis=1)


def moments(s: Series, n: int = 60) -> Series:
    s = s.bounded(19, {"_r": lambda w: F.log(F.col("close") / w.lag("close")), "momentum_5": lambda w: w.full(n + 1, F.col("close") / w.lag("close", 4) - 1), "momentum_20": lambda w: w.full(n + 1, F.col("close") / w.lag("close", 19) - 1)})
    outs = ["ret_mean", "ret_std", "ret_skew", "ret_kurt", "_vm"]
    s = s.rolling(n, ["_r", "volume"], outs, _return_moments)
    full = lambda x: F.when(F.col(IDX) >= n + 1, x)
    s = s.mutate(**{k: full(F.col(k)) for k in outs[:4]}, volume_ratio=full(F.col("volume") / F.col("_vm")))
    return s._with(s.rows.drop("_vm"))


LR = f"lr AS (SELECT *, ln(close / pc) AS r FROM bar), ls AS (SELECT *, list(r) {over(60)} AS l FROM lr), mo AS (SELECT *, list_avg(l) AS m, list_stddev_pop(l) AS s FROM ls)"
windowed(
    "w76_return_moments", lambda s: moments(s.only("close", "volume")),
    {
        "ret_mean": full(61, "m"), "ret_std": full(61, "s"), "ret_skew": full(61, "list_avg(list_transform(l, lambda x: pow((x - m) / s, 3)))"), "ret_kurt": full(61, "list_avg(list_transform(l, lambda x: pow((x - m) / s, 4))) - 3"),
        "momentum_5": full(61, f"close / lag(close, 4) {SERIES} - 1"), "momentum_20": full(61, f"close / lag(close, 19) {SERIES} - 1"), "volume_ratio": full(61, f"volume / avg(volume) {over(60)}"),
    },
    ctes=LR, src="mo",
)


def ml_matrix(s: Series, horizon: int = 5) -> Series:
    """Model features of a bar and its labels (sign, size, three classes)."""
    c = F.col("close")
    s = s.bounded(1, {"_r": lambda w: c / w.lag("close") - 1, "_ch": lambda w: c - w.lag("close")}, {"_sm": lambda w: F.avg("close").over(w(5))})
    up, dn = F.when(F.col("_ch") > 0, F.col("_ch")).otherwise(0.0), F.when(F.col("_ch") < 0, -F.col("_ch")).otherwise(0.0)
    s = s.bounded(
        40,
        {
            **{f"ret_{k}": (lambda w, k=k: c / w.lag("close", k) - 1) for k in (1, 5, 10, 20)},
            **{f"vol_{k}": (lambda w, k=k: F.stddev_pop("_r").over(w(k))) for k in (5, 10, 20)},
            "volume_ratio": lambda w: F.col("volume") / (F.avg("volume").over(w.span(-39, -20)) + 1e-10),
            "position": lambda w: (c - F.col("low")) / (F.col("high") - F.col("low") + 1e-10),
            "rsi": lambda w: 100 - 100 / (1 + F.avg(up).over(w(14)) / (F.avg(dn).over(w(14)) + 1e-10)),
            "acceleration": lambda w: F.col("_sm") - 2 * w.lag("_sm") + w.lag("_sm", 2),
            "forward": lambda w: w.lead("close", horizon) / c - 1,
        },
        ahead=horizon,
    )
    f = F.col("forward")
    return s.mutate(label_sign=F.when(f > 0, 1).otherwise(0), label_class=F.when(f < -0.01, -1).when(f > 0.01, 1).otherwise(0))


MLC = ["ret_1", "ret_5", "ret_10", "ret_20", "vol_5", "vol_10", "vol_20", "volume_ratio", "position", "rsi", "acceleration", "forward"]
UP, DN = "CASE WHEN close > pc THEN close - pc ELSE 0 END", "CASE WHEN close < pc THEN pc - close ELSE 0 END"
ML = f"""{RT}, sm AS (SELECT *, avg(close) {over(5)} AS sm FROM rt), ml AS (SELECT symbol, t, i, """ + ", ".join(f"close / lag(close, {k}) {SERIES} - 1 AS ret_{k}" for k in (1, 5, 10, 20)) + ", " + ", ".join(f"stddev_pop(r) {over(k)} AS vol_{k}" for k in (5, 10, 20)) + f""",
 volume / (avg(volume) {span(-39, -20)} + 1e-10) AS volume_ratio, (close - low) / (high - low + 1e-10) AS position, 100 - 100 / (1 + avg({UP}) {over(14)} / (avg({DN}) {over(14)} + 1e-10)) AS rsi, sm - 2 * lag(sm) {SERIES} + lag(sm, 2) {SERIES} AS acceleration, lead(close, 5) {SERIES} / close - 1 AS forward FROM sm)"""


@query("w77_ml_matrix", f"WITH {BARS}, {ML} SELECT symbol, t, {', '.join(f'{R(k)} AS {k}' for k in MLC)}, CASE WHEN forward > 0 THEN 1 ELSE 0 END AS label_sign, CASE WHEN forward < -0.01 THEN -1 WHEN forward > 0.01 THEN 1 ELSE 0 END AS label_class FROM ml WHERE i > 40 AND forward IS NOT NULL")
def w77(spark, sf):
    s = ml_matrix(bar_series(spark, sf))
    return s.rows.where((F.col(IDX) > 40) & F.col("forward").isNotNull()).select("symbol", "t", *[r(k).alias(k) for k in MLC], "label_sign", "label_class")


GR = f"""{ASSET}, sc AS (SELECT CAST(floor(a.t / 26.0) AS BIGINT) AS snap, a.asset AS i, b.asset AS j, corr(a.ret, b.ret) AS c FROM ret a JOIN ret b ON a.t = b.t AND a.asset < b.asset GROUP BY 1, 2, 3),
sq AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY snap) AS k FROM sc WHERE c IS NOT NULL),
dc AS (SELECT a.i, a.j, a.snap, sum(CASE WHEN x.k = 1 THEN x.c * pow(0.8, a.k - 1) ELSE 0.2 * x.c * pow(0.8, a.k - x.k) END) AS w FROM sq a JOIN sq x ON a.i = x.i AND a.j = x.j AND x.k <= a.k GROUP BY 1, 2, 3)"""


@query("w78_correlation_graph", f"WITH {GR} SELECT snap, i, j, {R('w', 6)} AS weight FROM dc WHERE abs(w) >= 0.1")
def w78(spark, sf):
    """Pair correlations per half-year snapshot, smoothed over snapshots (0.8
    old); edges below 0.1 are dropped after smoothing."""
    p = panel(spark, sf).withColumn("snap", F.floor(F.col("t") / 26))
    pc = pair_sums(p, ["t"], "asset", "ret", market.table(spark, sf, "nation").count(), group="snap").where("i < j").select("snap", "i", "j", corr().alias("c")).where("c is not null")
    s = Series.of(pc, ["i", "j"], ["snap"]).scan(Affine("w", lambda v, i: ((i > 1) * 0.8, np_where(i == 1, v["c"], 0.2 * v["c"]))))
    return s.df.where(F.abs("w") >= 0.1).select("snap", "i", "j", r("w", 6).alias("weight"))


def np_where(m, a, b):
    import numpy as np

    return np.where(m, a, b)


@query(
    "x18_calendar_features",
    f"""SELECT event_id, {R('sin(2 * pi() * hour(ts) / 24)', 6)} AS hour_sin, {R('cos(2 * pi() * hour(ts) / 24)', 6)} AS hour_cos, {R('sin(2 * pi() * (isodow(ts) - 1) / 7)', 6)} AS dow_sin, isodow(ts) >= 6 AS weekend, ts::DATE > last_day(ts::DATE) - 3 AS month_end,
 hour(ts) < 8 AS asian, hour(ts) BETWEEN 7 AND 15 AS european, hour(ts) BETWEEN 13 AND 21 AS us, {R('(minute(ts) * 60 + second(ts)) / 3600.0', 6)} AS bar_progress FROM events""",
)
def x18(spark, sf):
    e = market.events(spark, sf)
    h, dow = F.hour("ts"), F.weekday("ts")
    turn = lambda x, n: 2 * math.pi * x / n
    return e.select(
        "event_id", r(F.sin(turn(h, 24)), 6).alias("hour_sin"), r(F.cos(turn(h, 24)), 6).alias("hour_cos"), r(F.sin(turn(dow, 7)), 6).alias("dow_sin"), (dow >= 5).alias("weekend"),
        (F.to_date("ts") > F.date_sub(F.last_day("ts"), 3)).alias("month_end"), (h < 8).alias("asian"), h.between(7, 15).alias("european"), h.between(13, 21).alias("us"),
        r((F.minute("ts") * 60 + F.second("ts")) / 3600.0, 6).alias("bar_progress"),
    )


SENT = """sd AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, avg(CASE WHEN event_type = 'view' THEN value / 100 - 0.5 END) AS news, avg(CASE WHEN event_type = 'click' THEN value / 100 - 0.5 END) AS soc,
 count(*) FILTER (event_type = 'purchase') AS pos, count(*) FILTER (event_type = 'error') AS neg, count(*) FILTER (event_type IN ('view', 'click', 'signup')) AS neu FROM events GROUP BY 1),
se AS (SELECT *, pos + neg + neu AS tot, 0.5 * news + 0.3 * soc AS comb, row_number() OVER (ORDER BY day) AS i FROM sd)"""


@query(
    "x19_sentiment_features",
    f"""WITH {SENT}, em AS (SELECT a.day, sum(0.1 * pow(0.9, a.i - x.i) * x.comb) AS e FROM se a JOIN se x ON x.i <= a.i GROUP BY 1)
SELECT day, {R('comb', 6)} AS combined, {R('abs(news - soc)', 6)} AS divergence, {R('ln(1 + tot)', 6)} AS mention_intensity, {R('pos * 1.0 / tot', 6)} AS bullish_ratio, {R('1 + (pos * 1.0 / tot * ln(pos * 1.0 / tot) + neg * 1.0 / tot * ln(neg * 1.0 / tot) + neu * 1.0 / tot * ln(neu * 1.0 / tot)) / ln(3)', 6)} AS volatility, {R('e', 6)} AS ema FROM se JOIN em USING (day)""",
)
def x19(spark, sf):
    e = market.events(spark, sf)
    t = F.col("event_type")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("day")
    part = lambda k: F.avg(F.when(t == k, F.col("value") / 100 - 0.5))
    d = e.groupBy(day).agg(part("view").alias("news"), part("click").alias("soc"), F.count_if(t == "purchase").alias("pos"), F.count_if(t == "error").alias("neg"), F.count_if(t.isin("view", "click", "signup")).alias("neu"))
    c = F.col
    d = d.withColumns({"tot": c("pos") + c("neg") + c("neu"), "comb": 0.5 * c("news") + 0.3 * c("soc"), "one": F.lit(1)})
    s = Series.of(d, ["one"], ["day"]).scan(Affine("ema", lambda v, i: ((i > 1) * 0.9, 0.1 * v["comb"])))
    pr = [c(k) / c("tot") for k in ("pos", "neg", "neu")]
    ent = sum((F.when(p > 0, p * F.log(p)).otherwise(0.0) for p in pr), F.lit(0.0))
    return s.df.select("day", r("comb", 6).alias("combined"), r(F.abs(c("news") - c("soc")), 6).alias("divergence"), r(F.log1p("tot"), 6).alias("mention_intensity"), r(pr[0], 6).alias("bullish_ratio"), r(1 + ent / math.log(3), 6).alias("volatility"), r("ema", 6).alias("ema"))


@query(
    "x20_on_chain_features",
    f"""WITH d AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, count(DISTINCT o_custkey) AS addr, count(*) AS tx, avg(o_totalprice) AS hr, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS inf, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS outf, count(*) FILTER (o_orderstatus = 'P') AS mp FROM orders GROUP BY 1),
z AS (SELECT day, (addr - avg(addr) OVER ()) / (stddev_pop(addr) OVER () + 1e-8) AS az, (tx - avg(tx) OVER ()) / (stddev_pop(tx) OVER () + 1e-8) AS tz, hr / lag(hr) OVER (ORDER BY day) - 1 AS hc, (outf - inf) / (inf + outf + 1e-8) AS nf, ln(1 + hr) AS nvt, least(2, mp / 3.0) AS mc FROM d)
SELECT day, {R('az', 6)} AS addresses_z, {R('tz', 6)} AS transactions_z, {R('hc', 4)} AS hash_rate_change, {R('nf', 6)} AS net_flow, {R('nvt', 6)} AS nvt, {R('mc', 6)} AS mempool, {R('0.3 * az + 0.2 * tz + 0.2 * coalesce(hc, 0) + 0.3 * nf')} AS momentum FROM z""",
)
def x20(spark, sf):
    """Network-activity features of a daily metrics table (orders per day)."""
    o = market.orders(spark, sf)
    c = F.col
    per = o.groupBy("day", "account").agg(F.count(F.lit(1)).alias("n"), F.sum("notional").alias("v"), *[F.sum(F.when(c("status") == k, c("notional")).otherwise(0.0)).alias(k) for k in "FO"], F.count_if(c("status") == "P").alias("P"))
    d = per.groupBy("day").agg(F.count(F.lit(1)).alias("addr"), F.sum("n").alias("tx"), (F.sum("v") / F.sum("n")).alias("hr"), F.sum("F").alias("inf"), F.sum("O").alias("outf"), F.sum("P").alias("mp")).withColumn("one", F.lit(1))
    st = d.agg(*[x for k in ("addr", "tx") for x in (F.avg(k).alias(f"m_{k}"), F.stddev_pop(k).alias(f"s_{k}"))])
    s = Series.of(d, ["one"], ["day"]).bounded(1, {"hc": lambda w: c("hr") / w.lag("hr") - 1})
    x = s.df.join(F.broadcast(st), F.lit(True))
    z = lambda k: (c(k) - c(f"m_{k}")) / (c(f"s_{k}") + 1e-8)
    nf = (c("outf") - c("inf")) / (c("inf") + c("outf") + 1e-8)
    return x.select(
        "day", r(z("addr"), 6).alias("addresses_z"), r(z("tx"), 6).alias("transactions_z"), r("hc").alias("hash_rate_change"), r(nf, 6).alias("net_flow"), r(F.log1p("hr"), 6).alias("nvt"), r(F.least(F.lit(2.0), c("mp") / 3.0), 6).alias("mempool"),
        r(0.3 * z("addr") + 0.2 * z("tx") + 0.2 * F.coalesce(c("hc"), F.lit(0.0)) + 0.3 * nf).alias("momentum"),
    )
