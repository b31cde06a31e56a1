"""Models on feature tables."""

import math

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.features import ML, MLC, ml_matrix
from tapeworks.catalog.sql import BARS, R, SERIES
from tapeworks.plans.quantiles import exact_percentiles
from tapeworks.plans.series import IDX, Series
from tapeworks.session import checkpointed

c = lambda n: F.col(n)
X4 = ["ret_5", "ret_20", "vol_20", "position"]


def matrix(spark, sf):
    s = ml_matrix(bar_series(spark, sf))
    return s.rows.where((c(IDX) > 40) & c("forward").isNotNull()).select("symbol", "t", c(IDX).alias("i"), *MLC, "label_class")


MX = f"{ML}, mx AS (SELECT *, CASE WHEN forward < -0.01 THEN -1 WHEN forward > 0.01 THEN 1 ELSE 0 END AS label_class FROM ml WHERE i > 40 AND forward IS NOT NULL)"
# three member predictions of the forward return
MEM = {"trend": "ret_20", "burst": "ret_5", "revert": "-ret_10"}


@query("l01_forest_importance")
def l01(spark, sf):
    """Three-class forest trained on the earlier 70 % of weeks, scored on the rest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    feats = [f for f in MLC if f != "forward"]
    # stored: the cut, the fit's passes and the score don't make the features again
    x = checkpointed(matrix(spark, sf).na.drop().select("t", *feats, (c("label_class") + 1.0).alias("label")))
    cut = exact_percentiles(x, [], "t", {"cut": 0.7}).first()["cut"]
    v = VectorAssembler(inputCols=feats, outputCol="features").transform(x)
    m = RandomForestClassifier(numTrees=20, maxDepth=5, seed=42).fit(v.where(c("t") <= cut))
    acc = m.transform(v.where(c("t") > cut)).agg(F.avg(F.when(c("prediction") == c("label"), 1.0).otherwise(0.0)).alias("accuracy"))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(round(float(w), 6)).alias("importance")) for f, w in zip(feats, m.featureImportances.toArray())])
    return acc.select(F.inline(rows), r("accuracy").alias("test_accuracy"))


def quartile_counts(lf):
    """Rows by feature, quartile bin and label; the quartiles, one row a feature,
    are sent to the rows."""
    q = exact_percentiles(lf, ["feature"], "value", {"a": 0.25, "b": 0.5, "d": 0.75}).drop("n")
    at = F.when(c("value") >= c("d"), 3).when(c("value") >= c("b"), 2).when(c("value") >= c("a"), 1).otherwise(0)
    return lf.join(F.broadcast(q), "feature").groupBy("feature", at.alias("bin"), c("label_class").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "l02_mutual_information",
    f"WITH {BARS}, {MX}, " + ", ".join(f"e_{f} AS (SELECT quantile_cont({f}, 0.25) AS a, quantile_cont({f}, 0.5) AS b, quantile_cont({f}, 0.75) AS c FROM mx)" for f in X4)
    + ", ct AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN {f} >= c THEN 3 WHEN {f} >= b THEN 2 WHEN {f} >= a THEN 1 ELSE 0 END AS bin, label_class AS y, count(*) AS n FROM mx, e_{f} GROUP BY 1, 2, 3" for f in X4)
    + f"), tt AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, y) AS yy FROM ct) SELECT feature, {R('sum(n / t * ln(n * t / (b * yy)))', 6)} AS mi FROM tt GROUP BY 1",
)
def l02(spark, sf):
    """MI from quartile-bin contingency counts."""
    from tapeworks.operators.drift import long_form

    lf = long_form(matrix(spark, sf), ["label_class"], {f: c(f) for f in X4})
    ct = quartile_counts(lf)
    t = ct.groupBy("feature").agg(F.sum("n").alias("t"))
    b = ct.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    y = ct.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    x = ct.join(t, "feature").join(b, ["feature", "bin"]).join(y, ["feature", "y"])
    return x.groupBy("feature").agg(r(F.sum(c("n") / c("t") * F.log(c("n") * c("t") / (c("nb") * c("ny")))), 6).alias("mi"))


VOTE = " + ".join(f"sign({e})" for e in MEM.values())


@query("l03_voting", f"WITH {BARS}, {MX} SELECT symbol, count(*) AS n, {R(f'avg(CASE WHEN sign({VOTE}) = sign(forward) THEN 1.0 ELSE 0 END)', 6)} AS vote_accuracy, {R(f'avg(CASE WHEN sign(({VOTE})) <> 0 THEN 1.0 ELSE 0 END)', 6)} AS decided FROM mx GROUP BY 1")
def l03(spark, sf):
    m = matrix(spark, sf)
    v = sum((F.signum(F.expr(e)) for e in MEM.values()), F.lit(0.0))
    x = m.withColumn("v", F.signum(v))
    one = lambda k: F.avg(F.when(k, 1.0).otherwise(0.0))
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(one(c("v") == F.signum("forward")), 6).alias("vote_accuracy"), r(one(c("v") != 0), 6).alias("decided"))


@query("l03_stacking")
def l03s(spark, sf):
    """Logistic meta model over the members' predictions."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    m = matrix(spark, sf).select("t", *[F.signum(F.expr(e)).alias(k) for k, e in MEM.items()], F.when(c("forward") > 0, 1.0).otherwise(0.0).alias("label"))
    v = VectorAssembler(inputCols=list(MEM), outputCol="features").transform(m)
    cut = exact_percentiles(m, [], "t", {"cut": 0.7}).first()["cut"]
    lr = LogisticRegression(maxIter=20).fit(v.where(c("t") <= cut))
    return lr.transform(v.where(c("t") > cut)).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.when(c("prediction") == c("label"), 1.0).otherwise(0.0))).alias("accuracy"))


LOSS = "ls AS (SELECT symbol, " + ", ".join(f"avg(CASE WHEN sign({e}) = sign(forward) THEN 0.0 ELSE 1 END) AS {k}" for k, e in MEM.items()) + " FROM mx GROUP BY 1)"


@query("l04_online_weights", f"WITH {BARS}, {MX}, {LOSS} SELECT symbol, " + ", ".join(f"{R(f'exp(-2 * {k}) / (' + ' + '.join(f'exp(-2 * {j})' for j in MEM) + ')', 6)} AS w_{k}" for k in MEM) + " FROM ls")
def l04(spark, sf):
    """Multiplicative weights: exp(-eta * summed loss), normalised."""
    m = matrix(spark, sf)
    g = m.groupBy("symbol").agg(*[F.avg(F.when(F.signum(F.expr(e)) == F.signum("forward"), 0.0).otherwise(1.0)).alias(k) for k, e in MEM.items()])
    tot = sum((F.exp(-2 * c(k)) for k in MEM), F.lit(0.0))
    return g.select("symbol", *[r(F.exp(-2 * c(k)) / tot, 6).alias(f"w_{k}") for k in MEM])


PAR = ["ret_1", "ret_5", "ret_10", "ret_20"]


@query(
    "l05_parameter_search",
    f"WITH {BARS}, {MX}, f AS (SELECT CAST(floor(i / 52) AS BIGINT) AS fold, unnest([{', '.join(repr(p) for p in PAR)}]) AS param, unnest([{', '.join(PAR)}]) AS s, forward FROM mx), g AS (SELECT fold, param, avg(CASE WHEN sign(s) = sign(forward) THEN 1.0 ELSE 0 END) AS score FROM f GROUP BY 1, 2) SELECT fold, arg_max(param, (score, param)) AS best, {R('max(score)', 6)} AS score FROM g GROUP BY 1",
)
def l05(spark, sf):
    """Parameter rows x chronological folds, best per fold."""
    m = matrix(spark, sf).withColumn("fold", F.floor(c("i") / 52))
    rows = F.array(*[F.struct(F.lit(p).alias("param"), c(p).alias("s")) for p in PAR])
    g = m.select("fold", "forward", F.inline(rows)).groupBy("fold", "param").agg(F.avg(F.when(F.signum("s") == F.signum("forward"), 1.0).otherwise(0.0)).alias("score"))
    return g.groupBy("fold").agg(F.max(F.struct("score", "param")).alias("b")).select("fold", c("b.param").alias("best"), r("b.score", 6).alias("score"))


W = {"ret_5": 0.4, "ret_20": 0.3, "vol_20": -0.2, "position": 0.1}
LIN = " + ".join(f"{w} * {f}" for f, w in W.items())


@query("l06_batch_scoring", f"WITH {BARS}, {MX} SELECT symbol, t, {R(f'1 / (1 + exp(-({LIN})))', 6)} AS score FROM mx")
def l06(spark, sf):
    """A registered Python function over Arrow batches."""
    import numpy as np

    names, ws = list(W), np.array(list(W.values()))

    def score(batches):
        for pdf in batches:
            x = pdf[names].to_numpy() @ ws
            yield pdf[["symbol", "t"]].assign(score=1 / (1 + np.exp(-x)))

    return matrix(spark, sf).select("symbol", "t", *names).mapInPandas(score, "symbol bigint, t bigint, score double").select("symbol", "t", r("score", 6).alias("score"))


@query(
    "l07_a66_attribution",
    f"WITH {BARS}, {MX}, mn AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in W) + " FROM mx), a AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in W) + "]) AS feature, unnest([" + ", ".join(f"{w} * ({f} - m_{f})" for f, w in W.items()) + f"]) AS v FROM mx, mn) SELECT feature, {R('avg(abs(v))', 6)} AS mean_abs, {R('max(abs(v))', 6)} AS max_abs FROM a GROUP BY 1",
)
def l07(spark, sf):
    """Exact Shapley values over all coalitions of four features, exploded as
    rows of a bounded list (16 per row) and grouped by feature."""
    m = matrix(spark, sf)
    mean = m.agg(*[F.avg(f).alias(f"m_{f}") for f in W])
    x = m.join(F.broadcast(mean), F.lit(True))
    fs, n = list(W), len(W)
    val = lambda mask: sum((W[f] * (c(f) if mask >> k & 1 else c(f"m_{f}")) for k, f in enumerate(fs)), F.lit(0.0))
    vals = {s: val(s) for s in range(1 << n)}
    phi = {}
    for k, f in enumerate(fs):
        terms = [math.factorial(bin(s).count("1")) * math.factorial(n - bin(s).count("1") - 1) / math.factorial(n) * (vals[s | 1 << k] - vals[s]) for s in range(1 << n) if not s >> k & 1]
        phi[f] = sum(terms, F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), v.alias("v")) for f, v in phi.items()])
    return x.select(F.inline(rows)).groupBy("feature").agg(r(F.avg(F.abs("v")), 6).alias("mean_abs"), r(F.max(F.abs("v")), 6).alias("max_abs"))


@query("l08_ensemble_uncertainty", f"WITH {BARS}, {MX} SELECT symbol, t, {R('list_avg([' + ', '.join(MEM.values()) + '])', 6)} AS mean, {R('list_stddev_pop([' + ', '.join(MEM.values()) + '])', 6)} AS spread FROM mx")
def l08(spark, sf):
    es = [F.expr(e) for e in MEM.values()]
    mean = sum(es, F.lit(0.0)) / len(es)
    sd = F.sqrt(sum((F.pow(e - mean, 2) for e in es), F.lit(0.0)) / len(es))
    return matrix(spark, sf).select("symbol", "t", r(mean, 6).alias("mean"), r(sd, 6).alias("spread"))


PRS = [("trend", "burst"), ("trend", "revert"), ("burst", "revert")]


@query("a54_l09_ensemble_diversity", f"WITH {BARS}, {MX} " + " UNION ALL ".join(f"SELECT '{a}' AS m1, '{b}' AS m2, {R(f'corr({MEM[a]}, {MEM[b]})', 6)} AS corr, {R(f'avg(CASE WHEN sign({MEM[a]}) <> sign({MEM[b]}) THEN 1.0 ELSE 0 END)', 6)} AS disagreement, {R(f'0.5 * greatest(0, corr({MEM[a]}, {MEM[b]}) - 0.3)', 6)} AS penalty FROM mx" for a, b in PRS))
def a54(spark, sf):
    """Member correlation, sign disagreement, and the penalty of close pairs."""
    m = matrix(spark, sf).select(*[F.expr(e).alias(k) for k, e in MEM.items()])
    one = m.agg(*[x for a, b in PRS for x in (F.corr(a, b).alias(f"c_{a}_{b}"), F.avg(F.when(F.signum(a) != F.signum(b), 1.0).otherwise(0.0)).alias(f"d_{a}_{b}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"), r(f"c_{a}_{b}", 6).alias("corr"), r(f"d_{a}_{b}", 6).alias("disagreement"), r(0.5 * F.greatest(F.lit(0.0), c(f"c_{a}_{b}") - 0.3), 6).alias("penalty")) for a, b in PRS])
    return one.select(F.inline(rows))
