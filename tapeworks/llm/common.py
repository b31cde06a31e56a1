"""What several operators of this folder need: tables, the shared work folder,
Arrow passes over key-sorted rows, bounded work units, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import shared_folder, shuffles_dropped

#: Rows of one key that one task takes together; larger keys are cut into chunks.
UNIT_ROWS = 4096


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one all executors share (spark.checkpoint.dir)."""
    return shared_folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage is
    cut, a lost executor costs nothing that was stored, and the shuffle files that
    led to it are dropped."""
    path = work_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here; rows are stored, so no shuffle files of earlier rounds stay."""
    return stored(df, "cut")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  For pure ASCII strings that is what lower() does,
    which is much cheaper than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def by_key_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int, work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with tables of about ``rows`` rows that never cut a run of
    equal ``key`` values.  The input must be sorted by ``key`` within the task."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        last = int(np.searchsorted(k, k[-1], side="left"))
        if last:
            yield from work(t.slice(0, last))
            rest = t.slice(last)
            held, n = rest.to_batches(), rest.num_rows
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def units(rows: DataFrame, key: str, item: str, limit: int = UNIT_ROWS) -> DataFrame:
    """Bounded units of work that together meet every pair of rows with an equal
    ``key``: adds ``unit`` (bigint), ``in_tree`` and ``in_query`` (booleans).

    A key of at most ``limit`` rows is one unit.  A larger one is cut into C
    chunks by a hash of ``item``; unit (a, b) holds chunk a as tree and chunk b
    as queries, for all a <= b, so that no task ever holds the whole key.
    """
    hot = rows.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("_c"))
    j = rows.join(hot, key, "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    j = j.withColumn("_own", F.pmod(F.xxhash64(F.col(item), F.lit("unit")), F.col("_c")).cast("int"))
    j = j.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    return j.select(
        *rows.columns,
        F.when(F.col("_c") == 1, F.xxhash64(key)).otherwise(F.xxhash64(F.col(key), lo, hi)).alias("unit"),
        (F.col("_own") == lo).alias("in_tree"),
        (F.col("_own") == hi).alias("in_query"),
    )


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge names; root is the smallest node
    that can be reached.  Alternating large-star and small-star steps: stars are
    sent to minima that are combined before the shuffle, each round is
    stored, nothing reaches the driver but counts."""
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    )
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.union(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
