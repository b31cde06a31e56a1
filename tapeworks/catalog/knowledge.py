"""J14-J17, A30, A43-A47, A59, A62-A64, K07, K08, U04-U06, X31, X35, X37, A56."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.base import bar_series, r
from tapeworks.catalog.scalars import EP, episodes
from tapeworks.catalog.sql import ASSET, R, TICK, TRADE
from tapeworks.functions import scalars as X
from tapeworks.operators import episodes as E
from tapeworks.operators import fronts as P
from tapeworks.operators import knowledge as N
from tapeworks.plans.series import IDX, Series
from tapeworks.sources import market

c = lambda n: F.col(n)

UPD = "up AS (SELECT l_suppkey AS source, p_size AS target, l_returnflag AS edge_type, l_discount * 10 AS confidence, l_quantity AS weight, l_shipdate AS ts, l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_extendedprice AS o4 FROM lineitem JOIN part ON l_partkey = p_partkey)"
EK, EO = ["source", "target", "edge_type"], ["ts", "o1", "o2", "o3", "o4"]


def updates(spark, sf):
    """Edge updates supplier -> part size, typed by return flag."""
    li = market.table(spark, sf, "lineitem")
    p = market.table(spark, sf, "part").select("p_partkey", "p_size")
    return li.join(p, c("l_partkey") == c("p_partkey")).select(
        c("l_suppkey").alias("source"), c("p_size").alias("target"), c("l_returnflag").alias("edge_type"), (c("l_discount") * 10).alias("confidence"), c("l_quantity").alias("weight"),
        c("l_shipdate").alias("ts"), c("l_orderkey").alias("o1"), c("l_linenumber").alias("o2"), c("l_partkey").alias("o3"), c("l_extendedprice").alias("o4"),
    )


def edges(spark, sf):
    return N.blend_edges(updates(spark, sf), EK, EO)


EDGE = f"""{UPD}, un AS (SELECT *, row_number() OVER (PARTITION BY source, target, edge_type ORDER BY ts, o1, o2, o3, o4) AS i, count(*) OVER (PARTITION BY source, target, edge_type) AS n FROM up),
ed AS (SELECT source, target, edge_type, sum(CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END * confidence) AS confidence, sum(CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END * weight) AS weight, count(*) AS updates FROM un GROUP BY 1, 2, 3)"""


@query("a30_edge_blend", f"WITH {EDGE} SELECT source, target, edge_type, updates, {R('confidence')} AS confidence, {R('weight')} AS weight FROM ed")
def a30(spark, sf):
    return edges(spark, sf).select(*EK, "updates", r("confidence").alias("confidence"), r("weight").alias("weight"))


@query(
    "j14_neighbours",
    f"WITH {EDGE}, nb AS (SELECT source AS node, 'out' AS direction, weight, confidence FROM ed JOIN (SELECT DISTINCT p_size FROM part) ON p_size = target WHERE edge_type = 'A' UNION ALL SELECT target, 'in', weight, confidence FROM ed JOIN supplier ON s_suppkey = source WHERE edge_type = 'A') SELECT node, direction, count(*) AS degree, {R('sum(weight)', 2)} AS weight, {R('max(confidence)')} AS best FROM nb GROUP BY 1, 2",
)
def j14(spark, sf):
    """In and out neighbours by edge type with node attributes joined."""
    a = market.table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), F.lit("in").alias("direction"))
    b = market.table(spark, sf, "part").select(c("p_size").cast("bigint").alias("id"), F.lit("out").alias("direction")).distinct()
    e = edges(spark, sf).where("edge_type = 'A'")
    both = e.select(c("source").alias("node"), c("target").cast("bigint").alias("id"), F.lit("out").alias("direction"), "weight", "confidence").unionByName(
        e.select(c("target").cast("bigint").alias("node"), c("source").alias("id"), F.lit("in").alias("direction"), "weight", "confidence")
    )
    x = both.join(a.unionByName(b), ["id", "direction"])
    return x.groupBy("node", "direction").agg(F.count(F.lit(1)).alias("degree"), r(F.sum("weight"), 2).alias("weight"), r(F.max("confidence")).alias("best"))


@query(
    "j15_recommendations",
    f"""WITH {EDGE}, f AS (SELECT s_nationkey AS regime, target AS mid, max(confidence) AS p1 FROM ed JOIN supplier ON source = s_suppkey WHERE edge_type = 'A' GROUP BY 1, 2), g AS (SELECT target AS mid, source AS strategy, max(confidence) AS p2 FROM ed WHERE edge_type = 'R' GROUP BY 1, 2),
d AS (SELECT s_nationkey AS regime, source AS strategy, max(confidence) AS p FROM ed JOIN supplier ON source = s_suppkey WHERE edge_type = 'N' GROUP BY 1, 2),
s AS (SELECT regime, strategy, max(score) AS score FROM (SELECT regime, strategy, p1 * p2 AS score FROM f JOIN g USING (mid) UNION ALL SELECT regime, strategy, p FROM d) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY round(score, 9) DESC, strategy) AS k FROM s) SELECT regime, strategy, k, {R('score', 6)} AS score FROM k WHERE k <= 3""",
)
def j15(spark, sf):
    """Regime -> strategy and regime -> indicator -> strategy, best (product of)
    confidences, top 3."""
    e = edges(spark, sf)
    sup = market.table(spark, sf, "supplier").select(c("s_suppkey").alias("source"), c("s_nationkey").alias("regime"))
    f = e.where("edge_type = 'A'").join(sup, "source").groupBy("regime", c("target").alias("mid")).agg(F.max("confidence").alias("p1"))
    g = e.where("edge_type = 'R'").groupBy(c("target").alias("mid"), c("source").alias("strategy")).agg(F.max("confidence").alias("p2"))
    d = e.where("edge_type = 'N'").join(sup, "source").select("regime", c("source").alias("strategy"), c("confidence").alias("score"))
    s = N.best_path(d, f, g, "regime", "mid", "strategy")
    w = Window.partitionBy("regime").orderBy(F.desc(F.round("score", 9)), "strategy")
    return s.withColumn("k", F.row_number().over(w)).where("k <= 3").select("regime", "strategy", "k", r("score", 6).alias("score"))


FLOW = "fl AS (SELECT l_suppkey AS source, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS target FROM lineitem), fe AS (SELECT source, target, count(*) AS n FROM fl WHERE target IS NOT NULL GROUP BY 1, 2 )"


def flow_edges(spark, sf):
    """supplier -> next supplier on the same order."""
    li = market.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice")
    s = Series.of(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"]).bounded(0, {"target": lambda w: w.lead("l_suppkey")}, ahead=1)
    return s.df.where("target is not null").groupBy(c("l_suppkey").alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))


@query("j16_triangles", f"WITH {FLOW} SELECT x.source AS a, x.target AS b, y.target AS c FROM fe x JOIN fe y ON y.source = x.target JOIN fe z ON z.source = y.target AND z.target = x.source WHERE x.source < x.target AND x.source < y.target AND x.target <> y.target")
def j16(spark, sf):
    return N.triangles(flow_edges(spark, sf))


@query(
    "j17_knowledge_transfer",
    f"""WITH {EDGE}, mp AS (SELECT s_suppkey AS source, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS heir FROM supplier), cp AS (SELECT heir AS source, target, edge_type, confidence * 0.7 AS confidence FROM ed JOIN mp USING (source) WHERE heir IS NOT NULL)
SELECT source, target, edge_type, {R('CASE WHEN ed.confidence IS NULL THEN cp.confidence WHEN cp.confidence IS NULL THEN ed.confidence ELSE 0.7 * ed.confidence + 0.3 * cp.confidence END')} AS confidence, ed.confidence IS NULL AS transferred FROM ed FULL JOIN cp USING (source, target, edge_type)""",
)
def j17(spark, sf):
    """Edges copied to a sibling asset at 0.7, blended where one exists."""
    e = edges(spark, sf).select(*EK, "confidence")
    m = market.table(spark, sf, "supplier").select(c("s_suppkey").alias("source"), F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("heir")).where("heir is not null")
    cp = e.join(m, "source").select(c("heir").alias("source"), "target", "edge_type", (c("confidence") * 0.7).alias("copied"))
    x = e.join(cp, EK, "full")
    conf = F.when(c("confidence").isNull(), c("copied")).when(c("copied").isNull(), c("confidence")).otherwise(0.7 * c("confidence") + 0.3 * c("copied"))
    return x.select(*EK, r(conf).alias("confidence"), c("confidence").isNull().alias("transferred"))


@query("a43_graph_statistics", f"WITH {EDGE} SELECT coalesce(edge_type, '*') AS edge_type, count(*) AS edges, {R('avg(confidence)')} AS avg_confidence, {R('sum(weight)', 2)} AS weight FROM ed GROUP BY ROLLUP (edge_type)")
def a43(spark, sf):
    g = edges(spark, sf).rollup("edge_type").agg(F.count(F.lit(1)).alias("edges"), r(F.avg("confidence")).alias("avg_confidence"), r(F.sum("weight"), 2).alias("weight"))
    return g.select(F.coalesce("edge_type", F.lit("*")).alias("edge_type"), "edges", "avg_confidence", "weight")


SEM = "sm AS (SELECT user_id % 10 AS regime, CASE WHEN value > 60 THEN 'win' ELSE 'loss' END AS outcome, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2)"


@query("a44_semantic_rules", f"WITH {SEM}, t AS (SELECT regime, sum(n) AS tot FROM sm GROUP BY 1) SELECT regime, outcome, n AS episodes, {R('m')} AS avg_value, {R('n * 1.0 / tot', 6)} AS confidence FROM sm JOIN t USING (regime) WHERE n >= 5")
def a44(spark, sf):
    g = market.events(spark, sf).groupBy((c("user_id") % 10).alias("regime"), F.when(c("value") > 60, "win").otherwise("loss").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    t = g.groupBy("regime").agg(F.sum("n").alias("tot"))
    return g.join(t, "regime").where("n >= 5").select("regime", "outcome", c("n").alias("episodes"), r("m").alias("avg_value"), r(c("n") / c("tot"), 6).alias("confidence"))


VEC = "vv AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
COS = lambda a, b: f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


# episodes: each vector, and two blends with the next one of its type (0.97 and 0.94 alike)
BLEND = (0.0, 0.25, 0.35)
EPI = f"""{VEC}, nx AS (SELECT label, vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM vv),
ep AS (SELECT label, vec_id * 3 + (vec_id + k) % 3 AS id, list_transform(range(1, len(v) + 1), lambda e: CAST(v[e] AS DOUBLE) + f * CAST(w[e] AS DOUBLE)) AS v FROM nx, (VALUES {', '.join(f'({k}, {f}::DOUBLE)' for k, f in enumerate(BLEND))}) b(k, f) WHERE w IS NOT NULL),
pr AS (SELECT b.label, b.id, list(a.id) AS near FROM ep a JOIN ep b ON a.label = b.label AND a.id < b.id WHERE {COS('a.v', 'b.v')} >= 0.95 GROUP BY 1, 2),
od AS (SELECT ep.label, ep.id, coalesce(near, []) AS near, row_number() OVER (PARTITION BY ep.label ORDER BY ep.id) AS i FROM ep LEFT JOIN pr USING (label, id)),
gr AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS heads FROM od UNION ALL SELECT od.label, od.i, CASE WHEN list_has_any(near, heads) THEN heads ELSE list_append(heads, id) END FROM gr JOIN od ON od.label = gr.label AND od.i = gr.i + 1),
hd AS (SELECT label, arg_max(heads, i) AS heads FROM gr GROUP BY 1),
ld AS (SELECT label, id, coalesce(list_min(list_intersect(near, heads)), id) AS leader FROM od JOIN hd USING (label))"""


def vector_episodes(spark, sf):
    v = market.table(spark, sf, "embeddings").select("label", "vec_id", c("embedding").cast("array<double>").alias("v"))
    nx = Series.of(v, ["label"], ["vec_id"]).bounded(0, {"w": lambda w: w.lead("v")}, ahead=1).df.where("w is not null")
    b = nx.select("label", "vec_id", "v", "w", F.posexplode(F.array(*[F.lit(f) for f in BLEND])).alias("k", "f"))
    i = c("vec_id") * 3 + (c("vec_id") + c("k")) % 3
    x = b.select("label", i.alias("id"), F.zip_with("v", "w", lambda p, q: p + c("f") * q).alias("v"))
    pnl, slip = F.create_map(F.lit("pnl"), (c("id") % 17 - 8) / 10.0), F.create_map(F.lit("slip"), (c("id") % 5) / 10.0)
    tags = F.array(F.concat(F.lit("t"), (c("id") % 4).cast("string")), F.concat(F.lit("k"), (c("id") % 3).cast("string")))
    return x.withColumns({"outcomes": F.when(c("id") % 3 == 0, F.map_concat(pnl, slip)).otherwise(pnl), "tags": tags, "replays": c("id") % 3})


@query(
    "a45_merge_similar",
    f"""WITH RECURSIVE {EPI}, tg AS (SELECT label, leader, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT label, leader, unnest(['t' || id % 4, 'k' || id % 3]) AS t FROM ld) GROUP BY 1, 2)
SELECT label, leader, count(*) AS members, CAST(sum(id % 3) AS BIGINT) AS replays, tags, {R('avg((id % 17 - 8) / 10.0)', 6)} AS pnl, CASE WHEN leader % 3 = 0 THEN {R('sum(CASE WHEN id % 3 = 0 THEN id % 5 / 10.0 ELSE 0 END) / count(*)', 6)} END AS slip FROM ld JOIN tg USING (label, leader) GROUP BY label, leader, tags""",
)
def a45(spark, sf):
    """Episodes join the first similar leader before them; outcomes are averaged."""
    e = vector_episodes(spark, sf)
    g = E.merged(e, E.leaders(e.select("label", "id", "v"), "label", "id", "v"), "label", "id", "outcomes", "tags", "replays")
    return g.select("label", "leader", "members", "replays", F.array_join("tags", ",").alias("tags"), r(F.try_element_at("outcomes", F.lit("pnl")), 6).alias("pnl"), r(F.try_element_at("outcomes", F.lit("slip")), 6).alias("slip"))


CEN = f"{VEC}, up AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS p FROM vv), mn AS (SELECT label, p, avg(x) AS m FROM up GROUP BY 1, 2), ce AS (SELECT label, list(m ORDER BY p) AS ce FROM mn GROUP BY 1), sm AS (SELECT vec_id, label, {COS('v', 'ce')} AS sim FROM vv JOIN ce USING (label))"


@query("k07_k08_vector_top_k", f"WITH {CEN}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS k FROM sm WHERE sim >= 0.05) SELECT label, k, vec_id, {R('sim', 6)} AS similarity FROM k WHERE k <= 10")
def k07(spark, sf):
    """Most typical items of each type: cosine to the type's mean vector."""
    v = market.table(spark, sf, "embeddings")
    x = N.top_similar(N.centroids(v, "label", "embedding"), v, "label", 10, 0.05)
    return x.select("label", "k", "vec_id", r("sim", 6).alias("similarity"))


STATE_DIM = 8
STATE = f"""{ASSET}, hw AS (SELECT *, max(px) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS top FROM ret), st AS (SELECT n_regionkey AS portfolio, asset, avg(ret) AS m, stddev_pop(ret) AS s, max(1 - px / top) AS dd FROM hw JOIN nation ON n_nationkey = asset GROUP BY 1, 2),
nn AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY asset) - 1 AS k, count(*) OVER (PARTITION BY portfolio) AS n FROM st), lg AS (SELECT portfolio, 4 * n AS len, k AS i, 1.0 / n AS x FROM nn UNION ALL SELECT portfolio, 4 * n, n + k, m FROM nn UNION ALL SELECT portfolio, 4 * n, 2 * n + k, s FROM nn UNION ALL SELECT portfolio, 4 * n, 3 * n + k, dd FROM nn),
zz AS (SELECT *, (x - avg(x) OVER (PARTITION BY portfolio)) / (stddev_pop(x) OVER (PARTITION BY portfolio) + 1e-8) AS z FROM lg)"""


@query("x37_state_embedding", f"WITH {STATE} SELECT portfolio, CAST(j AS INTEGER) AS j, {R('sum(z * cos((j + 1) * pi() / len * (i + 0.5)) / sqrt(len))', 6)} AS value FROM zz, range({STATE_DIM}) AS r(j) GROUP BY 1, 2")
def x37(spark, sf):
    """State of each regional portfolio (weights, mean returns, volatilities,
    drawdowns by asset) on a cosine basis."""
    p = market.nation_returns(spark, sf)
    s = Series.of(p, ["asset"], ["t"]).running(_top=("max", "px")).df
    st = s.groupBy("asset").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.max(1 - c("px") / c("_top")).alias("dd"))
    nation = market.table(spark, sf, "nation").select(c("n_nationkey").alias("asset"), c("n_regionkey").alias("portfolio"))
    return N.state_embedding(st.join(nation, "asset"), "portfolio", "asset", STATE_DIM).select("portfolio", "j", r("value", 6).alias("value"))


@query("k07_projection_spread", f"WITH {CEN} SELECT label, count(*) AS n, {R('avg(sim)', 6)} AS mean_projection, {R('stddev_pop(sim)', 6)} AS spread FROM sm GROUP BY 1")
def projection_spread(spark, sf):
    v = market.table(spark, sf, "embeddings")
    x = v.join(N.centroids(v, "label", "embedding"), "label").withColumn("sim", N.cosine(c("embedding"), c("centroid")))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg("sim"), 6).alias("mean_projection"), r(F.stddev_pop("sim"), 6).alias("spread"))


SNT = "sq AS (SELECT event_id, user_id, ts, (CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) * least(1, value / 100) AS score, CASE WHEN event_type IN ('view', 'click') THEN 0.8 ELSE 0.95 END AS w, event_type IN ('view', 'signup') AS news, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def sentiment(spark, sf):
    e = market.events(spark, sf)
    sign = F.when(c("event_type") == "purchase", 1).when(c("event_type") == "error", -1).otherwise(0)
    x = e.select("event_id", "user_id", "ts", (sign * F.least(F.lit(1.0), c("value") / 100)).alias("score"), F.when(c("event_type").isin("view", "click"), 0.8).otherwise(0.95).alias("w"), c("event_type").isin("view", "signup").alias("news"))
    return Series.of(x, ["user_id"], ["ts", "event_id"]).totals(_n=F.count(F.lit(1)))


@query("a46_sentiment_composite", f"WITH {SNT} SELECT user_id, {R('sum(score * w) / (sum(w) + 1e-8)', 6)} AS composite, {R('coalesce(avg(score * w) FILTER (news), 0)', 6)} AS news, {R('coalesce(avg(score * w) FILTER (NOT news), 0)', 6)} AS social, {R('avg(w)', 6)} AS confidence, count(*) AS sources FROM sq WHERE back <= 100 GROUP BY 1")
def a46(spark, sf):
    s = sentiment(spark, sf)
    x = s.rows.where(c("_n") - c(IDX) < 100)
    sw = c("score") * c("w")
    part = lambda k: F.coalesce(F.avg(F.when(k, sw)), F.lit(0.0))
    return x.groupBy("user_id").agg(r(F.sum(sw) / (F.sum("w") + 1e-8), 6).alias("composite"), r(part(c("news")), 6).alias("news"), r(part(~c("news")), 6).alias("social"), r(F.avg("w"), 6).alias("confidence"), F.count(F.lit(1)).alias("sources"))


@query("a47_sentiment_series", f"WITH {SNT} SELECT user_id, CAST(floor((i - 1) / 10) AS BIGINT) AS chunk, {R('sum(score * w) / (sum(w) + 1e-8)', 6)} AS sentiment FROM sq GROUP BY 1, 2")
def a47(spark, sf):
    s = sentiment(spark, sf)
    return s.rows.groupBy("user_id", F.floor((c(IDX) - 1) / 10).alias("chunk")).agg(r(F.sum(c("score") * c("w")) / (F.sum("w") + 1e-8), 6).alias("sentiment"))


@query(
    "a59_edge_ngrams",
    "WITH s AS (SELECT event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS (SELECT a || '>' || b AS pattern FROM s WHERE b IS NOT NULL UNION ALL SELECT a || '>' || b || '>' || c FROM s WHERE c IS NOT NULL) SELECT pattern, count(*) AS support FROM p GROUP BY 1 HAVING count(*) >= 3",
)
def a59(spark, sf):
    return N.edge_ngrams(market.events(spark, sf).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", 3)


KEEP = "greatest(0, least(1, st * exp(-0.05 * tt)))"


@query("a62_active_facts", f"WITH {EP} SELECT event_id, {R('st * exp(-0.1 * h / 24)', 6)} AS confidence FROM et WHERE st * exp(-0.1 * h / 24) >= 0.1")
def a62(spark, sf):
    conf = c("st") * F.exp(-0.1 * c("h") / 24)
    return episodes(spark, sf).where(conf >= 0.1).select("event_id", r(conf, 6).alias("confidence")).orderBy(F.desc("confidence"), "event_id")


@query("a63_consolidation", f"WITH {EP}, k AS (SELECT event_id, rh, {KEEP} > 0.05 OR st > 0.95 AS keep FROM et) SELECT rh AS regime, keep, count(*) AS episodes FROM k GROUP BY 1, 2 HAVING count(*) >= 5")
def a63(spark, sf):
    """Retained or important episodes stay; the dropped ones are summarised."""
    keep = (X.retention(c("st"), c("h"), c("rh"), "exponential") > 0.05) | (c("st") > 0.95)
    return episodes(spark, sf).groupBy(c("rh").alias("regime"), keep.alias("keep")).agg(F.count(F.lit(1)).alias("episodes")).where("episodes >= 5")


@query(
    "a64_rule_confidence",
    f"""WITH RECURSIVE e AS (SELECT user_id, value > 50 AS win, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), q AS MATERIALIZED (SELECT * FROM e),
k AS (SELECT user_id, i, CASE WHEN win THEN 0.5 * 0.9 + 0.1 ELSE 0.5 * 0.85 END::DOUBLE AS cf FROM q WHERE i = 1 UNION ALL SELECT q.user_id, q.i, CASE WHEN win THEN cf * 0.9 + 0.1 ELSE cf * 0.85 END FROM k JOIN q ON q.user_id = k.user_id AND q.i = k.i + 1)
SELECT user_id, max(i) AS updates, {R('arg_max(cf, i)', 6)} AS confidence FROM k GROUP BY 1""",
)
def a64(spark, sf):
    e = market.events(spark, sf).select("user_id", "ts", "event_id", F.when(c("value") > 50, 1.0).otherwise(0.0).alias("win"))
    s = N.rule_confidence(Series.of(e, ["user_id"], ["ts", "event_id"]), "win")
    return s.rows.groupBy("user_id").agg(F.max(IDX).alias("updates"), r(F.max_by("confidence", IDX), 6).alias("confidence"))


@query("u04_node_upsert", "SELECT p_brand AS name, p_type AS type, max(p_size) AS size, arg_max(p_name, p_partkey) AS label, max(p_partkey) AS version FROM part GROUP BY 1, 2")
def u04(spark, sf):
    """Nodes by (name, type): later properties win, maps are merged per key."""
    p = market.table(spark, sf, "part")
    g = p.groupBy(c("p_brand").alias("name"), c("p_type").alias("type")).agg(F.max("p_size").alias("size"), F.max_by("p_name", "p_partkey").alias("label"), F.max("p_partkey").alias("version"))
    m = g.select("name", "type", "version", F.map_concat(F.create_map(F.lit("size"), c("size").cast("string")), F.create_map(F.lit("label"), c("label"))).alias("props"))
    return m.select("name", "type", c("props")["size"].cast("int").alias("size"), c("props")["label"].alias("label"), "version")


@query(
    "u05_node_removal",
    f"""WITH {EDGE}, nd AS (SELECT 's' || s_suppkey AS id, s_acctbal < 0 AS gone FROM supplier UNION ALL SELECT 'p' || p_size, min(p_retailprice) < 901 OR p_size % 10 = 0 FROM part GROUP BY p_size),
lf AS (SELECT 's' || source AS a, 'p' || target AS b FROM ed WHERE 's' || source NOT IN (SELECT id FROM nd WHERE gone) AND 'p' || target NOT IN (SELECT id FROM nd WHERE gone)), u AS (SELECT a AS id FROM lf UNION ALL SELECT b FROM lf)
SELECT nd.id, count(u.id) AS edges FROM nd LEFT JOIN u ON u.id = nd.id WHERE NOT gone GROUP BY 1""",
)
def u05(spark, sf):
    """Nodes that stay, with what is left of their edges: an edge goes with the
    node at either end."""
    p = market.table(spark, sf, "part").groupBy("p_size").agg((F.min("p_retailprice") < 901).alias("cheap"))
    nodes = market.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), (c("s_acctbal") < 0).alias("gone")).unionByName(
        p.select(F.concat(F.lit("p"), "p_size").alias("id"), (c("cheap") | (c("p_size") % 10 == 0)).alias("gone"))
    )
    e = edges(spark, sf).select(F.concat(F.lit("s"), "source").alias("source"), F.concat(F.lit("p"), "target").alias("target"))
    kept, left = N.remove_nodes(nodes, e, nodes.where("gone").select("id"))
    ends = left.select(c("source").alias("id")).unionAll(left.select(c("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("edges"))
    return kept.join(ends, "id", "left").select("id", F.coalesce("edges", F.lit(0)).alias("edges"))


@query("u06_tag_union", "SELECT user_id, count(DISTINCT event_type) AS tags, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tag_list FROM events GROUP BY 1")
def u06(spark, sf):
    """Tags come from a fixed vocabulary, so a set per key stays small."""
    x = market.events(spark, sf).groupBy("user_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("event_type"))))).alias("t"))
    return x.select("user_id", F.size("t").cast("bigint").alias("tags"), F.array_join("t", ",").alias("tag_list"))


@query(
    "x31_bandit_arms",
    f"WITH {TRADE}, a AS (SELECT strategy_id, venue AS regime, 1 + sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS al, 1 + sum(CASE WHEN pnl <= 0 THEN 1 ELSE 0 END) AS be FROM trade GROUP BY 1, 2), p AS (SELECT *, al * 1.0 / (al + be) AS m, sqrt(al * be * 1.0 / (pow(al + be, 2) * (al + be + 1))) AS sd FROM a) SELECT regime, strategy_id, {R('m', 6)} AS mean, {R('sd', 6)} AS sd, rank() OVER (PARTITION BY regime ORDER BY m + sd DESC) AS rk FROM p",
)
def x31(spark, sf):
    """Beta posterior per (strategy, regime); ranked by mean plus deviation."""
    win = c("pnl") > 0
    a = market.trades(spark, sf).groupBy("strategy_id", c("venue").alias("regime")).agg((1 + F.count_if(win)).alias("al"), (1 + F.count_if(~win)).alias("be"))
    n = c("al") + c("be")
    p = a.withColumns({"m": c("al") / n, "sd": F.sqrt(c("al") * c("be") / (F.pow(n, 2) * (n + 1)))})
    return p.select("regime", "strategy_id", r("m", 6).alias("mean"), r("sd", 6).alias("sd"), F.rank().over(Window.partitionBy("regime").orderBy(F.desc(c("m") + c("sd")))).alias("rk"))


@query(
    "x35_feature_dependents",
    "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS child, CAST(p_size - 1 - p_size % 3 AS INTEGER) AS parent FROM part WHERE p_size > 1), k AS (SELECT child, parent FROM e UNION SELECT k.child, e.parent FROM k JOIN e ON e.child = k.parent) SELECT child, parent, EXISTS (SELECT 1 FROM k x WHERE x.child = x.parent AND x.child = k.child) AS cyclic FROM k",
)
def x35(spark, sf):
    e = market.table(spark, sf, "part").where("p_size > 1").select(c("p_size").alias("child"), (c("p_size") - 1 - c("p_size") % 3).cast("int").alias("parent")).distinct()
    return N.dependents(e)


@query(
    "x35_feature_order",
    "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS child, CAST(p_size - 1 - p_size % 3 AS INTEGER) AS parent FROM part WHERE p_size > 1 UNION SELECT DISTINCT p_size, CAST(p_size // 2 AS INTEGER) FROM part WHERE p_size > 1 UNION SELECT 100, 101 UNION SELECT 101, 100 UNION SELECT 102, 101), n AS (SELECT child AS node FROM e UNION SELECT parent FROM e), d AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT child FROM e) UNION SELECT e.child, layer + 1 FROM d JOIN e ON e.parent = d.node) SELECT node, max(layer) AS layer FROM n LEFT JOIN d USING (node) GROUP BY 1",
)
def x35o(spark, sf):
    """Order of computation: the layer of each feature; a cycle and what hangs
    on it have none."""
    size, p = c("p_size"), market.table(spark, sf, "part").where("p_size > 1")
    e = p.select(size.alias("child"), F.explode(F.array((size - 1 - size % 3).cast("int"), F.expr("CAST(p_size div 2 AS INT)"))).alias("parent"))
    loop = p.limit(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("child"), F.lit(b).alias("parent")) for a, b in ((100, 101), (101, 100), (102, 101))])))
    return N.dependency_layers(e.unionByName(loop))


GOALS = {"ret": 4, "risk": 4, "win": 6, "pace": 4, "size": 4}
OPT = f"""{TRADE}, s AS (SELECT symbol, venue, side, {R('avg(pnl)')} AS ret, {R('-stddev_pop(pnl)')} AS risk, {R('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END)', 6)} AS win, {R('-avg(hours)')} AS pace, {R('avg(qty)')} AS size FROM trade GROUP BY 1, 2, 3)"""
BEATS = " AND ".join(f"a.{g} >= b.{g}" for g in GOALS) + " AND (" + " OR ".join(f"a.{g} > b.{g}" for g in GOALS) + ")"


def options(spark, sf):
    """Five goals of each (symbol, venue, side), all to be large."""
    one = {"ret": F.avg("pnl"), "risk": -F.stddev_pop("pnl"), "win": F.avg(F.when(c("pnl") > 0, 1.0).otherwise(0.0)), "pace": -F.avg("hours"), "size": F.avg("qty")}
    return market.trades(spark, sf).groupBy("symbol", "venue", "side").agg(*[r(v, GOALS[g]).alias(g) for g, v in one.items()])


@query("a56_pareto_front", f"WITH {OPT} SELECT b.* FROM s b WHERE NOT EXISTS (SELECT 1 FROM s a WHERE {BEATS})")
def a56(spark, sf):
    """First front of five goals."""
    return P.undominated(options(spark, sf), list(GOALS))


@query(
    "a56_front_ranks",
    f"WITH RECURSIVE {OPT}, ids AS (SELECT *, row_number() OVER (ORDER BY symbol, venue, side) AS id FROM s), dm AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM ids a JOIN ids b ON {BEATS}), ch AS (SELECT id, 1 AS front FROM ids UNION SELECT dm.b, front + 1 FROM ch JOIN dm ON dm.a = ch.id) SELECT symbol, venue, side, CAST(max(front) AS BIGINT) AS front FROM ch JOIN ids USING (id) GROUP BY 1, 2, 3",
)
def a56r(spark, sf):
    """Front number of every option: the longest chain of options that beat it."""
    return P.fronts(options(spark, sf), list(GOALS)).select("symbol", "venue", "side", "front")


CROWD = ", ".join(f"CASE WHEN lag({g}) OVER w{k} IS NULL OR lead({g}) OVER w{k} IS NULL THEN NULL WHEN max({g}) OVER f > min({g}) OVER f THEN (lead({g}) OVER w{k} - lag({g}) OVER w{k}) / (max({g}) OVER f - min({g}) OVER f) ELSE 0 END AS d{k}" for k, g in enumerate(GOALS))


@query(
    "p10_front_choice",
    f"""WITH {OPT}, fr AS (SELECT * FROM s b WHERE NOT EXISTS (SELECT 1 FROM s a WHERE {BEATS})), cr AS (SELECT *, {CROWD} FROM fr WINDOW f AS (PARTITION BY 1), {', '.join(f'w{k} AS (PARTITION BY 1 ORDER BY {g}, symbol, venue, side)' for k, g in enumerate(GOALS))}),
sc AS (SELECT symbol, venue, side, {' + '.join(f'd{k}' for k in range(len(GOALS)))} AS crowding, {' + '.join(f'0.2 * ({g} - min({g}) OVER f) / greatest(max({g}) OVER f - min({g}) OVER f, 1e-12)' for g in GOALS)} AS score FROM cr WINDOW f AS (PARTITION BY 1))
SELECT symbol, venue, side, crowding IS NULL AS at_edge, {R('crowding', 6)} AS crowding, {R('score', 6)} AS score, row_number() OVER (ORDER BY round(score, 9) DESC, symbol, venue, side) AS place FROM sc""",
)
def p10(spark, sf):
    """The first front with crowding distances, ordered by equal weights of all
    goals on the front's own scale."""
    x = P.crowding(P.undominated(options(spark, sf), list(GOALS)).withColumn("front", F.lit(1).cast("bigint")), "front", list(GOALS), ["symbol", "venue", "side"])
    x = P.compromise(x, "front", {g: 0.2 for g in GOALS})
    s = Series.of(x.withColumn("_s", -F.round("score", 9)), ["front"], ["_s", "symbol", "venue", "side"])
    edge = c("crowding") == float("inf")
    return s.rows.select("symbol", "venue", "side", edge.alias("at_edge"), F.when(~edge, r("crowding", 6)).alias("crowding"), r("score", 6).alias("score"), c(IDX).alias("place"))
