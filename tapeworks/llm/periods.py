"""Periodic runs: stretches of words that repeat at least three times in a row.

Internal pattern matching over all texts of a batch at once.  Suffixes are sorted
by prefix doubling, so the occurrences of each dyadic block (2**k words at a
multiple of 2**k) are one interval of the suffix array; a wavelet tree over the
array answers where the next occurrence in a neighbouring window is (range
successor).  A run of smallest period q has at least 3 q words, so for the k with
2**k <= q < 2**(k + 1) a block of its first 2**k places lies in it and occurs
again q words on, in the window of starts 2**k to 2**(k + 1) - 1.  The
occurrences in such a window are one arithmetic progression.  One or two give
their distances as candidates.  From three on the difference p is the block's own
period; a run whose period is longer than p can't be p-periodic throughout, so
the stretch of period p around the block ends inside it, and so does its copy:
the distances between the two left ends and the two right ends are the
candidates.  Periods below the shortest block are the distance to the block's
next occurrence.  Each candidate is extended both ways by comparing ranks of
dyadic blocks and kept if it's long enough; of equal stretches the smallest
period counts.

One pass over the documents, no shuffle; texts are taken in pieces of bounded
bytes, so memory follows the longest text.

Defined cases: null or empty texts, and such without words, have no runs and an
empty collapsed text; a null doc_id is never planted with a period; repeated rows
and ties are treated alike; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import table
from tapeworks.llm.registry import query
from tapeworks.llm.repeats import Suffixes, covered, pieces, word_ids

MIN_WORDS = 24  # shortest run
REPEATS = 3  # a run holds its period so often (the proof above needs three)
BATCH_BYTES = 2 << 20


class RangeSuccessor:
    """Wavelet tree (levels as bit ranks, high bit first) over a sequence: the
    smallest value from ``x`` on in a range of places, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        v = values.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            one = (v >> b & 1).astype(bool)
            zeros = np.zeros(len(v) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            v = np.concatenate((v[~one], v[one]))

    def below(self, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places i .. j - 1 are smaller than x."""
        size, found = j - i, np.zeros(len(i), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zi, zj = zeros[i], zeros[j]
            one = (x >> b & 1).astype(bool)
            found += np.where(one, zj - zi, 0)
            i, j = np.where(one, zeros[-1] + i - zi, zi), np.where(one, zeros[-1] + j - zj, zj)
        return np.where(x >> self.bits > 0, size, found)

    def smallest(self, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The value of rank r (from 0) in places i .. j - 1."""
        out = np.zeros(len(i), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zi, zj = zeros[i], zeros[j]
            one = r >= zj - zi
            r = np.where(one, r - (zj - zi), r)
            out |= one.astype(np.int64) << b
            i, j = np.where(one, zeros[-1] + i - zi, zi), np.where(one, zeros[-1] + j - zj, zj)
        return out

    def successor(self, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value >= x in places i .. j - 1, or -1."""
        r = self.below(i, j, x)
        there = r < j - i
        out = np.full(len(i), -1, np.int64)
        out[there] = self.smallest(i[there], j[there], r[there])
        return out


class Blocks:
    """Comparisons of stretches by the ranks of their dyadic blocks."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.n = len(words)
        self.suffixes = Suffixes(words, sizes)
        ends = np.cumsum(sizes)
        self.end, self.start = np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j (i < j, one text) on."""
        out = np.zeros(len(i), np.int64)
        end = self.end[i]
        for k in range(len(self.suffixes.levels) - 1, -1, -1):
            rank = self.suffixes.levels[k]
            fits = j + out + (1 << k) <= end
            a, b = np.where(fits, i + out, 0), np.where(fits, j + out, 0)
            out += (fits & (rank[a] == rank[b])).astype(np.int64) << k
        return out

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before i and j (i < j, one text)."""
        out = np.zeros(len(i), np.int64)
        start = self.start[i]
        for k in range(len(self.suffixes.levels) - 1, -1, -1):
            rank = self.suffixes.levels[k]
            fits = i - out - (1 << k) >= start
            a, b = np.where(fits, i - out - (1 << k), 0), np.where(fits, j - out - (1 << k), 0)
            out += (fits & (rank[a] == rank[b])).astype(np.int64) << k
        return out

    def stretch(self, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last word of the stretch around x whose words d
        apart are equal."""
        return x - self.back(x, x + d), x + d + self.ahead(x, x + d)


def candidates(blocks: Blocks, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs; every run holds one of its own."""
    levels, n = blocks.suffixes.levels, blocks.n
    base = max(0, (min_words // REPEATS).bit_length() - 1)
    tree: RangeSuccessor | None = None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(base, len(levels)):
        b = 1 << k
        x = np.arange(0, n, b)
        x = x[x + b <= blocks.end[x]]
        size = np.bincount(levels[k], minlength=n)
        x = x[size[levels[k][x]] > 1]
        if not len(x):
            continue
        tree = tree or RangeSuccessor(blocks.suffixes.order)
        i = levels[k][x]
        j = i + size[i]
        if k == base:  # periods below the shortest block
            y = tree.successor(i, j, x + 1)
            near = (y >= 0) & (y < x + b)
            found.append((x[near], (y - x)[near]))
        y1 = tree.successor(i, j, x + b)
        hit = (y1 >= 0) & (y1 < x + 2 * b)
        x, i, j, y1 = x[hit], i[hit], j[hit], y1[hit]
        found.append((x, y1 - x))
        y2 = tree.successor(i, j, y1 + 1)
        hit = (y2 >= 0) & (y2 < x + 2 * b)
        x, i, j, y1, y2 = x[hit], i[hit], j[hit], y1[hit], y2[hit]
        found.append((x, y2 - x))
        y3 = tree.successor(i, j, y2 + 1)
        hit = (y3 >= 0) & (y3 < x + 2 * b)
        x, y1, p = x[hit], y1[hit], (y2 - y1)[hit]
        if len(x):  # a progression of difference p
            (l0, r0), (l1, r1) = blocks.stretch(x, p), blocks.stretch(y1, p)
            for d in (l1 - l0, r1 - r0):
                ok = (d > 0) & (x + d < blocks.end[x])
                found.append((x[ok], d[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found])


def runs(words: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """All runs as rows (first word, length, smallest period), by first word and
    period; words are numbered through all texts."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    blocks = Blocks(words, sizes)
    x, d = candidates(blocks, min_words)
    lo, hi = blocks.stretch(x, d)
    long = hi - lo >= np.maximum(min_words, REPEATS * d)
    lo, hi, d = lo[long], hi[long], d[long]
    sort = np.lexsort((d, hi, lo))
    lo, hi, d = lo[sort], hi[sort], d[sort]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    out = np.stack((lo[new], (hi - lo)[new], d[new]), axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(n: int, key: object) -> np.ndarray | None:
    """Places of the words a document with this id has instead of 0 .. n - 1: a
    tenth of all ids get a periodic tail."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; then the first, then the shortest
    period."""
    best = None
    for r in found:
        if best is None or (r[1] * best[2], -r[0], -r[2]) > (best[1] * r[2], -best[0], -best[2]):
            best = r
    return best


def examine(ids: list, texts: list[bytes], plant: bool, min_words: int) -> tuple[np.ndarray, list, list, list[bytes]]:
    """For each text its number of words, runs, strongest run and the text left
    when each run keeps its first period."""
    words, n = word_ids(texts)
    edge = np.concatenate(([0], np.cumsum(n))).tolist()
    at = {}
    if plant:
        for t, key in enumerate(ids):
            p = planted(edge[t + 1] - edge[t], key)
            if p is not None:
                at[t] = p
                words[edge[t] : edge[t + 1]] = words[edge[t] : edge[t + 1]][p]
    got = runs(words, n, min_words)
    gone = covered(got[:, 0] + got[:, 2], got[:, 1] - got[:, 2], len(words))
    cut = np.searchsorted(got[:, 0], edge).tolist()
    all_runs, best, left = [], [], []
    for t, text in enumerate(texts):
        mine = [(s - edge[t], ln, d) for s, ln, d in got[cut[t] : cut[t + 1]].tolist()]
        all_runs.append(mine)
        best.append(strongest(mine))
        split = text.split()
        if mine or t in at:
            keep = np.nonzero(~gone[edge[t] : edge[t + 1]])[0]
            split = [split[k] for k in (at[t][keep] if t in at else keep).tolist()]
        left.append(b" ".join(split))
    return n, all_runs, best, left


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find(docs: DataFrame, plant: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), best (the strongest run, or
    null) and collapsed (kept words, joined by one space), one row per row.
    ``plant`` gives a tenth of all ids a periodic tail first."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_words", "runs", "best", "collapsed"]

    def structs(rows: list) -> list:
        return [r and dict(zip(("start", "length", "period"), r)) for r in rows]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in pieces(texts, BATCH_BYTES):
                ids = b.column(0).slice(i, j - i)
                n, found, best, left = examine(ids.to_pylist(), texts[i:j], plant, min_words)
                yield pa.record_batch(
                    [ids, pa.array(n), pa.array([structs(r) for r in found], pa.list_(kind)), pa.array(structs(best), kind), pa.array(left, pa.binary()).cast(pa.string())], names=names
                )

    schema = f"doc_id bigint, n_words bigint, runs array<{RUN}>, best {RUN}, collapsed string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    got = find(table(spark, sf, "documents"), plant=True)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return got.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
