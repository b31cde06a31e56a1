"""Graph, memory and vector tables as joins and grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapeworks.plans.recur import Affine
from tapeworks.plans.series import IDX, Series
from tapeworks.session import checkpointed

c = lambda n: F.col(n)


def blend_edges(updates: DataFrame, keys: list[str], order: list[str], rate: float = 0.3) -> DataFrame:
    """Edge upserts in arrival order: new value = (1-rate)*old + rate*update;
    one row per edge with its latest confidence and weight."""
    def blend(col):
        return lambda v, i: (np.where(i == 1, 0.0, 1 - rate), np.where(i == 1, v[col], rate * v[col]))

    s = Series.of(updates, keys, order).scan(Affine("_c", blend("confidence")), Affine("_w", blend("weight")))
    last = F.max_by(F.struct("_c", "_w"), IDX)
    g = s.rows.groupBy(*keys).agg(last.alias("_x"), F.count(F.lit(1)).alias("updates"))
    return g.select(*keys, c("_x._c").alias("confidence"), c("_x._w").alias("weight"), "updates")


def neighbours(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Both directions of every edge with the other node's attributes."""
    e = edges if edge_type is None else edges.where(c("edge_type") == edge_type)
    out = e.select(c("source").alias("node"), c("target").alias("other"), F.lit("out").alias("direction"), "confidence", "weight")
    into = e.select(c("target").alias("node"), c("source").alias("other"), F.lit("in").alias("direction"), "confidence", "weight")
    return out.unionByName(into).join(nodes.withColumnRenamed("id", "other"), "other")


CELL_EDGES = 1_000_000      # edges between two groups of nodes
LIST = 100_000              # neighbours in a list


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, neighbour) of rows with lists."""
    ends = t.column("_ns").combine_chunks()
    return np.repeat(t.column("_n").to_numpy(), ends.value_lengths().to_numpy()), ends.flatten().to_numpy(zero_copy_only=False)


def _closed(kind: pa.DataType, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cycles a -> b -> c -> a of one cell from its edges a -> b, c -> a and
    b -> c, ``most`` wedges at a time."""
    t = pa.Table.from_batches(list(batches))
    role = t.column("_role").to_numpy()
    (a1, b), (a2, cc), (b3, c3) = (_flat(t.filter(pa.array(role == k))) for k in range(3))
    if not (len(b) and len(cc) and len(b3)):
        return
    an, a2 = np.unique(a2, return_inverse=True)
    bn, b3 = np.unique(b3, return_inverse=True)
    cn, both = np.unique(np.concatenate((cc, c3)), return_inverse=True)
    order = np.argsort(a2, kind="stable")
    own = both[:len(cc)][order]                                  # c of each a, side by side
    first = np.searchsorted(a2[order], np.arange(len(an) + 1))
    want = np.sort(b3 * len(cn) + both[len(cc):])

    def place(x, names):
        i = np.minimum(np.searchsorted(names, x), len(names) - 1)
        return i, names[i] == x

    (ai, in_a), (bi, in_b) = place(a1, an), place(b, bn)
    ai, bi = ai[in_a & in_b], bi[in_a & in_b]
    n = first[ai + 1] - first[ai]
    done = np.concatenate(([0], np.cumsum(n)))
    lo = 0
    while lo < len(ai):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + most, "right")) - 1)
        at = np.repeat(np.arange(lo, hi), n[lo:hi])
        ci = own[first[ai[at]] + np.arange(len(at)) - (done[at] - done[lo])]
        wedge = bi[at] * len(cn) + ci
        hit = np.flatnonzero(want[np.minimum(np.searchsorted(want, wedge), len(want) - 1)] == wedge)
        at, ci = at[hit], ci[hit]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in (an[ai[at]], bn[bi[at]], cn[ci])], names=["a", "b", "c"])
        lo = hi


def triangles(edges: DataFrame, cell_edges: int = CELL_EDGES, wedges: int = 1 << 20) -> DataFrame:
    """Directed cycles of three edges, each once (its smallest node first).

    A cycle is built at its node of lowest degree (ties by id) and nowhere else,
    so a hub's edges only meet in cycles of hubs.  Nodes are dealt to groups by
    hash, so many that two groups share some ``cell_edges`` edges; a cell is three
    groups and gets the edges between them as lists of neighbours.  Wedges
    in -> node -> out are closed inside a cell and never shuffled.
    """
    e = edges.select("source", "target").where(c("source") != c("target")).distinct()
    node = e.select(c("source").alias("n")).unionAll(e.select(c("target").alias("n")))
    kind = node.schema["n"].dataType
    e = checkpointed(e.select(c("source").cast(kind).alias("source"), c("target").cast(kind).alias("target")))
    groups = max(1, math.ceil(math.sqrt(e.count() / cell_edges)))
    ends = e.select(c("source").alias("n")).unionAll(e.select(c("target").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("deg"))
    rank = lambda n: F.struct(c(f"{n}_deg"), c(n))
    ranked = e.join(ends.select(c("n").alias("source"), c("deg").alias("source_deg")), "source").join(ends.select(c("n").alias("target"), c("deg").alias("target_deg")), "target")
    group = lambda n: F.pmod(F.xxhash64(n), F.lit(groups))
    share = lambda n, deg: F.pmod(F.xxhash64(n, F.lit(1)), F.floor(deg / LIST) + 1)      # long lists come in parts

    def lists(x: DataFrame, role: int, n: str, other: str, cell) -> DataFrame:
        """Neighbours of n by group, sent to the cells of all third groups."""
        own = x.groupBy(c(n).alias("_n"), group(other).alias("_h"), share(other, c(f"{n}_deg")).alias("_s")).agg(F.collect_list(other).alias("_ns"))
        cells = own.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return cells.select(cell(group("_n"), c("_h"), c("_k")).alias("_cell"), F.lit(role).alias("_role"), "_n", "_ns")

    at = lambda i, j, k: (i * groups + j) * groups + k           # groups of a, b, c
    met = (
        lists(ranked.where(rank("source") < rank("target")), 0, "source", "target", lambda g, h, k: at(g, h, k))
        .unionByName(lists(ranked.where(rank("target") < rank("source")), 1, "target", "source", lambda g, h, k: at(g, k, h)))
        .unionByName(lists(ranked, 2, "source", "target", lambda g, h, k: at(k, g, h)))
    )
    arrow = to_arrow_type(kind)

    def close(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _closed(arrow, wedges, batches)

    found = met.groupBy("_cell").applyInArrow(close, ", ".join(f"{n} {kind.simpleString()}" for n in "abc"))
    low = F.least("a", "b", "c")
    turn = lambda x, y, z: F.when(low == c("a"), c(x)).when(low == c("b"), c(y)).otherwise(c(z))
    return found.select(low.alias("a"), turn("b", "c", "a").alias("b"), turn("c", "a", "b").alias("c"))


def best_path(direct: DataFrame, first: DataFrame, second: DataFrame, key: str, mid: str, out: str) -> DataFrame:
    """Best product of confidences over direct (key, out, score) and two-hop
    paths (first: p1 to ``mid``, second: p2 from it)."""
    two = first.join(second, mid).select(key, out, (c("p1") * c("p2")).alias("score"))
    return two.unionByName(direct.select(key, out, "score")).groupBy(key, out).agg(F.max("score").alias("score"))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that stay and the edges between them; ``gone`` has ids."""
    left = edges.join(gone.select(c("id").alias("source")), "source", "left_anti").join(gone.select(c("id").alias("target")), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def centroids(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key from partial sums per (key, position)."""
    x = vectors.select(key, F.posexplode(vec).alias("_p", "_x"))
    m = x.groupBy(key, "_p").agg(F.avg(c("_x").cast("double")).alias("_m"))
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_similar(queries: DataFrame, items: DataFrame, key: str, k: int, floor: float = -1.0) -> DataFrame:
    """Best ``k`` items per query by cosine; queries and items meet on their
    type (``key``), and the per-query limit is applied before the shuffle."""
    x = items.join(queries, key).withColumn("sim", cosine(c("embedding"), c("centroid"))).where(c("sim") >= floor)
    w = Window.partitionBy(key).orderBy(F.desc(F.round("sim", 9)), "vec_id")
    return x.withColumn("k", F.row_number().over(w)).where(c("k") <= k)


def state_embedding(assets: DataFrame, key: str, asset: str, dim: int) -> DataFrame:
    """(key, j, value): the vector of equal weights, then m, s and dd by asset,
    standardised and projected on the first ``dim`` cosine waves.  Rows of
    (place, value) are summed; no vector is built."""
    order = Window.partitionBy(key).orderBy(asset)          # the assets of one portfolio
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    k = assets.withColumn("_n", n).withColumn("_k", F.row_number().over(order) - 1)
    parts = F.array(*[F.struct((F.lit(b) * c("_n") + c("_k")).alias("i"), x.cast("double").alias("x")) for b, x in enumerate([1 / c("_n"), c("m"), c("s"), c("dd")])])
    lg = k.select(key, (4 * c("_n")).alias("len"), F.inline(parts))
    mom = lg.groupBy(key).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    z = lg.join(mom, key).select(key, "len", "i", ((c("x") - c("_m")) / (c("_s") + 1e-8)).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("j"))
    wave = F.cos((c("j") + 1) * math.pi / c("len") * (c("i") + 0.5)) / F.sqrt("len")
    return z.groupBy(key, "j").agg(F.sum(c("z") * wave).alias("value"))


def edge_ngrams(edges: DataFrame, keys: list[str], order: list[str], label: str, support: int) -> DataFrame:
    """Label sequences of length 2 and 3 over consecutive edges, by support."""
    s = Series.of(edges, keys, order).bounded(0, {"_a": lambda w: w.lead(label, 1), "_b": lambda w: w.lead(label, 2)}, ahead=2)
    two = s.df.where("_a is not null").select(F.concat_ws(">", label, "_a").alias("pattern"))
    three = s.df.where("_b is not null").select(F.concat_ws(">", label, "_a", "_b").alias("pattern"))
    return two.unionByName(three).groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(c("support") >= support)


def rule_confidence(s: Series, outcome: str, up: float = 0.1, down: float = 0.15, start: float = 0.5) -> Series:
    """Strengthen c += up*(1-c), weaken c -= down*c: both are affine."""
    def coef(v, i):
        win = v[outcome] > 0
        a = np.where(win, 1 - up, 1 - down)
        b = np.where(win, up, 0.0)
        return np.where(i == 1, 0.0, a), np.where(i == 1, a * start + b, b)

    return s.scan(Affine("confidence", coef))


def dependents(edges: DataFrame) -> DataFrame:
    """All (child, parent) pairs of the transitive closure and whether the child
    lies on a cycle.  Paths double in each round until no new pair comes, so a
    chain of n takes log2(n) rounds; cycles end the growth."""
    closure = checkpointed(edges.select("child", "parent").distinct())
    n = closure.count()
    while True:
        step = closure.select("child", c("parent").alias("_m")).join(closure.select(c("child").alias("_m"), "parent"), "_m").select("child", "parent")
        closure = checkpointed(closure.unionByName(step).distinct())
        grown = closure.count()
        if grown == n:
            break
        n = grown
    loops = closure.where("child = parent").select("child", F.lit(True).alias("cyclic"))
    return closure.join(loops, "child", "left").select("child", "parent", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def dependency_layers(edges: DataFrame) -> DataFrame:
    """node, layer: 0 for nodes without parents, else one above the highest
    parent; null for nodes on a cycle or behind one.  Layers are peeled until no
    node without open parents is left."""
    e = checkpointed(edges.select("child", "parent").distinct())
    left = checkpointed(e.select(c("child").alias("node")).unionByName(e.select(c("parent").alias("node"))).distinct())
    out, k = None, 0
    while True:
        free = checkpointed(left.join(e.select(c("child").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            break
        layer = free.withColumn("layer", F.lit(k))
        out = layer if out is None else out.unionByName(layer)
        left = checkpointed(left.join(free, "node", "left_anti"))
        e = checkpointed(e.join(free.withColumnRenamed("node", "parent"), "parent", "left_anti"))
        k += 1
    rest = left.withColumn("layer", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)
