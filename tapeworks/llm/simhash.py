"""SimHash fingerprints, linked within a Hamming radius by BK-trees.

Fingerprints that differ in at most r bits agree on at least one of r + 1 bit
blocks, so each fingerprint goes to the shard of each of its blocks and no link
is lost.  A shard's members form a BK-tree (children keyed by their integer
Hamming distance to the parent); a query at distance d from a node follows only
edges d - r .. d + r.  Equal fingerprints are one node.  A shard above
``common.UNIT_ROWS`` is cut into bounded trees, and each tree is sent to every
chunk of that shard's queries, so a tree that travels has a proven size.
Links are reduced to a spanning forest inside the task: output stays linear
even where thousands of fingerprints lie within the radius of each other.

Defined cases: null or empty text, or one without words, has fingerprint zero
and links like any other; fewer words than a shingle make one shingle; repeated
rows share their fingerprint; null doc_id is ignored when the smallest id of a
component is taken (null if there is no other); an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import by_key_runs, components, stored, table, units
from tapeworks.llm.registry import query

RADIUS = 4
SHINGLE = 4
SEED = 42
PIECE = 1 << 16


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text's UTF-8 bytes; bytes.lower and bytes.split
    know A-Z and the six ASCII spaces only, as asked."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    if n > shingle:
        starts, ends = starts[: n - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    view = memoryview(flat)
    total, m = np.zeros(64, np.int64), len(starts)
    for at in range(0, m, PIECE):
        h = np.array([digest(view[s:e], SEED) for s, e in zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist())], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > m).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed bigint, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t, shingle) if t else 0 for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class Forest:
    """BK-trees over ``fp``; items of one tree are adjacent, ``first`` has the
    place of each item's root.  Built level by level, all trees at once."""

    def __init__(self, fp: np.ndarray, first: np.ndarray):
        self.fp = fp
        n = len(fp)
        at = first.copy()
        active = np.nonzero(first != np.arange(n))[0]
        keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while active.size:
            d = np.bitwise_count(fp[active] ^ fp[at[active]]).astype(np.int64)
            edge, where, back = np.unique(at[active] * 65 + d, return_index=True, return_inverse=True)
            child = active[where]
            keys.append(edge)
            nodes.append(child)
            at[active] = child[back]
            active = active[at[active] != active]
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys, kind="stable")
        self.edges, self.children = keys[order], nodes[order]

    def search(self, q: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius."""
        who, node = np.arange(len(q)), root
        while who.size:
            d = np.bitwise_count(q[who] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield who[hit], node[hit]
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0), side="left")
            n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            total = int(n.sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            who, node = np.repeat(who, n), self.children[np.repeat(lo, n) + step]


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i] in ``label`` (each names its class's
    smallest member), in place."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _link(radius: int):
    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = t.column("unit").to_numpy()
        fp = t.column("fp").to_numpy().view(np.uint64)
        tree = np.nonzero(t.column("in_tree").to_numpy())[0]
        asks = np.nonzero(t.column("in_query").to_numpy())[0]
        if not len(tree) or not len(asks):
            return
        tu = unit[tree]
        starts = np.nonzero(np.concatenate(([True], tu[1:] != tu[:-1])))[0]
        size = np.diff(np.concatenate((starts, [len(tu)])))
        forest = Forest(fp[tree], np.repeat(starts, size))
        slot = np.searchsorted(tu[starts], unit[asks])
        slot_ok = slot < len(starts)
        slot_ok[slot_ok] = tu[starts][slot[slot_ok]] == unit[asks][slot_ok]
        asks, slot = asks[slot_ok], slot[slot_ok]
        label = np.arange(len(fp))
        load = np.cumsum(size[slot])
        at = 0
        while at < len(asks):  # so many queries that the frontier stays bounded
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + (1 << 20))))
            for who, node in forest.search(fp[asks[at:to]], starts[slot[at:to]], radius):
                settle(label, asks[at:to][who], tree[node])
            at = to
        moved = np.nonzero(label != np.arange(len(fp)))[0]
        if moved.size:
            yield pa.record_batch([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_key_runs(batches, "unit", 100_000, work)

    return run


def block_keys(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that cover 64 bits."""
    n = radius + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning forest (a, b) of the graph of distinct fingerprints ``fp``
    that differ in at most ``radius`` bits."""
    keys = F.array(*[
        F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) * (radius + 1) + i for i, (s, w) in enumerate(block_keys(radius))
    ])
    rows = classes.select("fp", F.explode(keys).alias("key"))
    u = units(rows, "key", "fp").select("unit", "fp", "in_tree", "in_query")
    return u.repartition("unit").sortWithinPartitions("unit", "fp").mapInArrow(_link(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed bigint), component_id; one row per document."""
    fps = stored(fingerprints(docs, shingle), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = components(links(classes, radius), "a", "b")
    rooted = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    label = rooted.join(lows, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(label, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


@query("op8_simhash_bktree")
def op8_simhash_bktree(spark, sf):
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
