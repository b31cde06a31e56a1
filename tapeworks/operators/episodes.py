"""Near-duplicate episodes merged into their leaders.

The rule is greedy in the order of the ids: an episode joins the first leader of
its group (regime) that is similar enough, and is a leader itself if there is
none.  It is run in parallel without changing its result:

1. Equal vectors are one class, led by the smallest id.
2. Candidates share a band of bits, the signs against hashed random hyperplanes.
   ``bands`` bands of ``bits`` bits find a pair at the threshold with a
   probability that ``recall`` gives.  A candidate goes on from the join itself
   only if not more of all its signs differ than ``reach`` allows (a pair at the
   threshold does with a chance below 1e-9); its cosine is then computed.
3. Blocks of ids, each twice as long as all before, are decided one after the
   other.  Only inside a block are pairs formed.  A row is a leader when no
   undecided earlier neighbour is left and none of them is a leader; rounds go on
   until all are decided.  Then the block's leaders take, from all later rows,
   those that they are similar to.  A crowd of near copies is gone after the
   block that holds its first ones, so it is never paired with itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.series import IDX, Series
from tapeworks.session import checkpointed

c = lambda n: F.col(n)

BLOCK = 2048


def recall(threshold: float, bits: int, bands: int) -> float:
    """Chance that a pair of this cosine shares a band."""
    same = 1 - math.acos(threshold) / math.pi
    return 1 - (1 - same**bits) ** bands


def reach(threshold: float, signs: int) -> int:
    """Signs that may differ: eight deviations above the mean at the threshold."""
    p = math.acos(threshold) / math.pi
    return math.ceil(signs * p + 8 * math.sqrt(signs * p * (1 - p)))


def signatures(rows: DataFrame, vec: str, bits: int, bands: int, seed: int = 11) -> DataFrame:
    """Adds ``_u`` (the unit vector), ``_b`` (one key a band) and ``_s`` (all
    signs, 32 in each word)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            units, keys, words = [], [], []
            for v in b.column(vec).to_pylist():
                x = np.array(v, float)
                x /= np.sqrt(x @ x)
                p = planes.get(len(x))
                if p is None:
                    p = planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((bits * bands, len(x)))
                flat = p @ x > 0
                sign = flat.reshape(bands, bits)
                units.append(x.tolist())
                keys.append(((sign << np.arange(bits)).sum(axis=1) * bands + np.arange(bands)).tolist())
                bits32 = np.pad(flat, (0, -len(flat) % 32)).reshape(-1, 32)
                words.append((bits32.astype(np.int64) << np.arange(32)).sum(axis=1).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64()))], names=[*b.schema.names, "_u", "_b", "_s"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, _u array<double>, _b array<bigint>, _s array<bigint>")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _similar(left: DataFrame, right: DataFrame, key: str, threshold: float, signs: int) -> DataFrame:
    """(key, a, b): similar pairs of a left and a later right row."""
    words = -(-signs // 32)
    sign = lambda n: [F.get("_s", F.lit(k)).alias(f"{n}{k}") for k in range(words)]
    x = left.select(key, c("id").alias("a"), *sign("_p"), F.explode("_b").alias("_k"))
    y = right.select(key, c("id").alias("b"), *sign("_q"), F.explode("_b").alias("_k"))
    differ = sum((F.bit_count(c(f"_p{k}").bitwiseXOR(c(f"_q{k}"))) for k in range(words)), F.lit(0))
    pairs = x.join(y, [key, "_k"]).where((c("a") < c("b")) & (differ <= reach(threshold, signs))).select(key, "a", "b").distinct()
    pairs = pairs.join(left.select(key, c("id").alias("a"), c("_u").alias("_x")), [key, "a"]).join(right.select(key, c("id").alias("b"), c("_u").alias("_y")), [key, "b"])
    return pairs.where(_dot("_x", "_y") >= threshold).select(key, "a", "b")


def _leaders(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, id) of the rows that the greedy rule makes leaders."""
    found = None
    while not nodes.isEmpty():
        new = checkpointed(nodes.join(edges.select(key, c("b").alias("id")), [key, "id"], "left_anti"))
        found = new if found is None else found.unionByName(new)
        taken = edges.join(new.withColumnRenamed("id", "a"), [key, "a"], "left_semi").select(key, c("b").alias("id"))
        nodes = checkpointed(nodes.join(new.unionByName(taken), [key, "id"], "left_anti"))
        for end in ("a", "b"):
            edges = edges.join(nodes.withColumnRenamed("id", end), [key, end], "left_semi")
        edges = checkpointed(edges)
    return found


def leaders(items: DataFrame, key: str, order: str, vec: str, threshold: float = 0.95, bits: int = 12, bands: int = 24, block: int = BLOCK) -> DataFrame:
    """``key``, ``order`` (unique ids) and leader (an id) for each row of
    ``items``.  Rows without a vector, or with a zero one, lead themselves."""
    x = items.select(key, c(order).alias("id"), c(vec).cast("array<double>").alias("v"))
    real = F.coalesce(F.exists("v", lambda e: e != 0), F.lit(False))
    classes = checkpointed(x.where(real).groupBy(key, "v").agg(F.min("id").alias("id")))
    ranked = Series.of(classes, [key], ["id"]).rows.select(key, "id", "v", c(IDX).alias("rank"))
    left = checkpointed(signatures(ranked, "v", bits, bands).drop("v"))
    lead, hi = None, block
    while not left.isEmpty():
        now = checkpointed(left.where(c("rank") <= hi))
        later = left.where(c("rank") > hi)
        inside = checkpointed(_similar(now, now, key, threshold, bits * bands))
        heads = checkpointed(_leaders(now.select(key, "id"), inside, key))
        chosen = now.join(heads, [key, "id"], "left_semi")
        taken = inside.unionByName(_similar(chosen, later, key, threshold, bits * bands)).join(heads.withColumnRenamed("id", "a"), [key, "a"], "left_semi")
        got = checkpointed(taken.groupBy(key, c("b").alias("id")).agg(F.min("a").alias("leader")).unionByName(heads.select(key, "id", c("id").alias("leader"))))
        lead = got if lead is None else lead.unionByName(got)
        left = checkpointed(later.join(got, [key, "id"], "left_anti"))
        hi = 3 * hi
    alone = x.where(~real).select(key, "id", c("id").alias("leader"))
    if lead is None:
        return alone.withColumnRenamed("id", order)
    of_class = classes.join(lead, [key, "id"]).select(key, "v", "leader")
    return x.where(real).join(of_class, [key, "v"]).select(key, "id", "leader").unionByName(alone).withColumnRenamed("id", order)


def merged(items: DataFrame, led: DataFrame, key: str, order: str, outcomes: str, tags: str, replays: str) -> DataFrame:
    """One row a leader: members, the mean of each outcome the leader has
    (members without it count 0), the union of tags, the sum of replays."""
    x = items.join(led, [key, order])
    g = x.groupBy(key, "leader").agg(F.count(F.lit(1)).alias("members"), F.sum(replays).alias(replays))
    t = x.select(key, "leader", F.explode(tags).alias("_t")).distinct().groupBy(key, "leader").agg(F.sort_array(F.collect_list("_t")).alias(tags))
    own = x.where(c(order) == c("leader")).select(key, "leader", F.explode(F.map_keys(outcomes)).alias("_k"))
    o = x.select(key, "leader", F.explode(outcomes).alias("_k", "_v")).groupBy(key, "leader", "_k").agg(F.sum("_v").alias("_s")).join(own, [key, "leader", "_k"])
    o = o.join(g.select(key, "leader", "members"), [key, "leader"]).groupBy(key, "leader").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", (c("_s") / c("members")).alias("_m"))))).alias(outcomes))
    empty = F.array().cast("array<string>")
    return g.join(t, [key, "leader"], "left").join(o, [key, "leader"], "left").withColumn(tags, F.coalesce(tags, empty))
