"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text:
each gets all words (with a space on either side) whose share of texts sets its
label apart beyond chance, the strongest last, where references are shortest; its
size follows from that evidence, and the compressor's tables from its size.  A text is
cut into windows; the bytes that each dictionary saves on a window, against no
dictionary, measure how near the window is to either.  A window is padded by a
run of one byte, so that a block is never stored raw and savings of a few bytes
show.  A text's features (best, mean and top savings, their spread over windows)
become a score by logistic weights and a threshold calibrated on labelled rows
that took no part in training the dictionaries.

Only the fit works on a sample of rows: at most ``FIT_ROWS`` labels of each kind,
those with the lowest hash of doc_id, with whole texts.  Words and features of
these are made in tasks; the driver gets counts, the dictionaries' words and a few
numbers for each row.  Scoring takes every window of every whole text, in one pass
without a shuffle.

Defined cases: null or empty text scores as one empty window; labels that are
null and rows without a label or text don't take part in the fit; a doc_id with
several labels counts for each; when one label is missing from the fit every
score is 1 (only toxic) or 0 (no toxic or no labels at all); repeated rows
repeat; an empty table gives no rows; lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.llm.common import stored, table
from tapeworks.llm.registry import query

FIT_ROWS = 2500
WINDOW = 256  # bytes
OVERLAP = 16
PAD = b"\0" * 100
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@dataclass
class Model:
    """What scoring needs; picklable, two dictionaries and a few numbers."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    constant: float | None = None  # when the fit had one label only

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (features(texts, self.toxic, self.ordinary) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weight[1:] + self.weight[0], -30, 30)))


def compressor(content: bytes, reach: int = 0) -> zstd.ZstdCompressor:
    """``reach``: bytes of the larger dictionary; all of it can be referred to."""
    log = min(27, max(12, (reach + WINDOW + len(PAD)).bit_length()))
    p = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_GREEDY, min_match=5, window_log=log, hash_log=log, chain_log=log, search_log=2, target_length=1, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT) if content else None
    return zstd.ZstdCompressor(compression_params=p, dict_data=d)


def windows(text: bytes) -> list[bytes]:
    step = WINDOW - OVERLAP
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - OVERLAP), step)]


def features(texts: list[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    reach = max(len(toxic), len(ordinary))
    plain, tox, usual = (compressor(c, reach).compress for c in (b"", toxic, ordinary))
    out = np.zeros((len(texts), 8))
    for k, t in enumerate(texts):
        w = windows(t.lower())
        lengths = np.array([(len(plain(x)), len(tox(x)), len(usual(x))) for x in (y + PAD for y in w)], float)
        a, b = lengths[:, 0] - lengths[:, 1], lengths[:, 0] - lengths[:, 2]
        e = a - b
        top = np.sort(a)[-3:].mean()
        out[k] = a.max(), a.mean(), top, (a >= 4).mean(), e.max(), e.mean(), lengths[:, 0].mean() / (WINDOW + len(PAD)), np.log1p(len(w))
    return out


def bound(tested: int) -> float:
    """What the largest of so many standard normal draws is expected to stay below."""
    return np.sqrt(2 * np.log(max(2, tested)))


def dictionary(ours: Counter, n: int, theirs: Counter, m: int, tested: int | None = None) -> bytes:
    """The words whose document shares differ by more standard errors than the
    largest of as many words without a difference is expected to."""
    words = [w for w, c in ours.items() if c > 2 and len(w) > 1]
    a = np.array([ours[w] for w in words], float)
    b = np.array([theirs[w] for w in words], float)
    p = (a + b) / (n + m)
    z = (a / n - b / m) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n + 1 / m))
    least = bound(len(words) if tested is None else tested)
    return b"".join(b" " + words[i] + b" " for i in sorted(range(len(words)), key=lambda i: (z[i], words[i])) if z[i] > least)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def counted(learn: DataFrame) -> DataFrame:
    """(word, c0, c1): texts of either label that have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = {0: Counter(), 1: Counter()}
            for t, y in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist()):
                count[y].update(set(WORD.findall(t.as_py().lower())))
            words = list(count[0] | count[1])
            yield pa.record_batch([pa.array(words, pa.binary()), *(pa.array([count[y][w] for w in words], pa.int64()) for y in (0, 1))], names=["word", "c0", "c1"])

    each = learn.select("text", "toxic").mapInArrow(run, "word binary, c0 bigint, c1 bigint")
    return each.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def dictionaries(words: DataFrame, n: dict[int, int]) -> list[bytes]:
    """``dictionary`` of toxic and of ordinary text; only words within reach of
    the bound come to the driver."""
    out = []
    for y in (1, 0):
        ours, theirs = F.col(f"c{y}"), F.col(f"c{1 - y}")
        own = words.where((ours > 2) & (F.octet_length("word") > 1))
        tested = own.count()
        p = (ours + theirs) / F.lit(float(n[0] + n[1]))
        z = (ours / F.lit(float(n[y])) - theirs / F.lit(float(n[1 - y]))) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n[0] + 1 / n[1]))
        got = own.where(z > float(bound(tested)) - 1e-6).select("word", ours.alias("a"), theirs.alias("b")).collect()
        out.append(dictionary(Counter({bytes(r.word): r.a for r in got}), n[y], Counter({bytes(r.word): r.b for r in got}), n[1 - y], tested))
    return out


def measured(hold: DataFrame, toxic: bytes, ordinary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the calibration rows, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features([t.as_py() for t in b.column(2).cast(pa.binary())], toxic, ordinary)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["_id", "toxic", "x"])

    got = sorted((r._id, r.toxic, r.x) for r in hold.select("_id", "toxic", "text").mapInArrow(run, "_id bigint, toxic int, x array<double>").collect())
    return np.array([r[2] for r in got]), np.array([r[1] for r in got], float)


def fit(sample: DataFrame) -> Model:
    """From ``training_rows``: every third label calibrates."""
    none = np.zeros(0)
    rows = {(r.toxic, r.hold): r["count"] for r in sample.groupBy("toxic", "hold").count().collect()}
    labels = {y for y, _ in rows}
    if labels != {0, 1}:
        return Model(b"", b"", none, none, none, 1.0 if labels == {1} else 0.0)
    learn, hold = sample.where("not hold"), sample.where("hold")
    learn = learn if {(0, False), (1, False)} <= set(rows) else sample
    hold = hold if {(0, True), (1, True)} <= set(rows) else learn
    n = {r.toxic: r["count"] for r in learn.groupBy("toxic").count().collect()}
    toxic, ordinary = dictionaries(stored(counted(learn), "words"), n)
    x, y = measured(hold, toxic, ordinary)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = logistic((x - mean) / scale, y)
    # the threshold with the best F1 on the calibration rows becomes 0.5
    z = (x - mean) / scale @ w[1:] + w[0]
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    below = z[order][best + 1] if best + 1 < len(y) else z[order][best] - 1
    w[0] -= (z[order][best] + below) / 2
    return Model(toxic, ordinary, mean, scale, w)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """_id, toxic, text (whole) and hold of the sample: a bounded number of
    labels with crc32(doc_id) mod 5 other than 0."""
    l = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    ids = l.where(F.crc32(F.col("_id").cast("string")) % 5 != 0).withColumn("_h", F.xxhash64("_id"))
    picked = [ids.where(F.col("toxic") == y).orderBy("_h", "_id").limit(rows) for y in (1, 0)]
    chosen = picked[0].union(picked[1])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    got = stored(texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_h", "_id", "toxic", "text").distinct(), "sample")
    order = Window.partitionBy("toxic").orderBy("_h", "_id")
    kept = got.select("toxic", "_h", "_id").distinct().withColumn("hold", F.row_number().over(order) % 3 == 0)
    return got.join(F.broadcast(kept.select("toxic", "_id", "hold")), ["toxic", "_id"]).select("_id", "toxic", "text", "hold")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield pa.record_batch([b.column(0), pa.array(s)], names=["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return got.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_toxicity")
def op7_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return score(docs, fit(training_rows(docs, table(spark, sf, "labels"))))
