"""Bootstrap intervals of any statistic made of sums.

A statistic is a set of row contributions that add up, and a formula of their
totals.  A replicate doesn't regroup rows: the number of times a block of rows is
drawn is a Poisson number from a hash of (series, first row, replicate), its
contributions times that number are added, and the formula is applied to the
replicate's totals.  Rows are not multiplied: a task adds the sums of all
replicates of its rows as one matrix product and emits one row a series and
replicate.  Blocks of one row give the plain bootstrap, longer ones that of
dependent series.  Leaving one row out is the total without its contributions,
so the acceleration of corrected intervals needs no further pass over samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.draws import erf
from tapeworks.operators.stats import probit
from tapeworks.plans.series import IDX, Series
from tapeworks.session import checkpointed

c = lambda n: F.col(n)

PRIME = 2147483647
STEPS = (48271, 69621, 16807)
MOST = 12                   # a rate of at most 1 draws more with a chance below 1e-9


@dataclass(frozen=True)
class Statistic:
    """``parts`` name the row contributions; ``finish`` gets columns of their sums
    (all 0 where nothing was drawn: null then)."""

    parts: dict[str, Column]
    finish: Callable[[dict[str, Column]], Column]


def mean(col: str) -> Statistic:
    return Statistic({"n": F.lit(1.0), "x": c(col)}, lambda s: F.try_divide(s["x"], s["n"]))


def sharpe(col: str) -> Statistic:
    """Mean over population deviation."""
    def finish(s):
        m = F.try_divide(s["x"], s["n"])
        return m / F.sqrt(F.greatest(F.try_divide(s["xx"], s["n"]) - m * m, F.lit(1e-300)))

    return Statistic({"n": F.lit(1.0), "x": c(col), "xx": c(col) * c(col)}, finish)


def draws(start: np.ndarray, row: np.ndarray, replicates: int) -> np.ndarray:
    """(rows, replicates) numbers in (0, 1) from quadratic steps modulo a prime."""
    b = np.arange(replicates, dtype=np.int64)
    x = (start[:, None] + row[:, None] * 7919 + b * 104729) % PRIME
    for k in STEPS:
        x = (x * x + k * (x + b + 1)) % PRIME
    return (x + 0.5) / PRIME


def times(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Poisson numbers of uniform ones."""
    out = np.zeros(u.shape)
    p = np.exp(-rate)
    total = p.copy()
    for k in range(1, MOST + 1):
        out += u > total[:, None]
        p = p * rate / k
        total = total + p
    return out


def _sums(keys: list[str], parts: list[str], replicates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            code = t.select(keys).combine_chunks()
            label = np.zeros(b.num_rows, np.int64)
            for k in keys:
                ids = code.column(k).dictionary_encode().combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                _, label = np.unique(label * (len(ids.dictionary) + 1) + ids.indices.fill_null(len(ids.dictionary)).to_numpy(zero_copy_only=False), return_inverse=True)
            col = lambda n: b.column(n).to_numpy(zero_copy_only=False)
            w = times(draws(col("_start"), col(IDX), replicates), col("_rate"))
            _, first = np.unique(label, return_index=True)
            out = {p: np.zeros((len(first), replicates)) for p in parts}
            for p in parts:
                np.add.at(out[p], label, w * col(p)[:, None])
            at = pa.array(np.repeat(first, replicates))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], pa.array(np.tile(np.arange(replicates), len(first))), *[pa.array(out[p].ravel()) for p in parts]], names=[*keys, "b", *parts])

    return run


def replicated(s: Series, stat: Statistic, replicates: int, block: int = 1, seed: str = "0") -> DataFrame:
    """keys, b, value: the statistic in each replicate of blocks of ``block``
    rows (series with fewer than two blocks have none)."""
    rows = s.totals(_n=F.count(F.lit(1))).mutate(**{f"_p_{k}": v.cast("double") for k, v in stat.parts.items()})
    names = [f"_p_{k}" for k in stat.parts]
    if block > 1:
        rows = rows.bounded(0, {f"_s{n}": (lambda w, n=n: F.sum(n).over(w.span(0, block - 1))) for n in names}, ahead=block - 1)
        rows = rows.mutate(**{n: c(f"_s{n}") for n in names})
    open_ = c("_n") - block + 1                      # places where a block can start
    name = F.concat_ws(":", F.lit(seed), *[c(k).cast("string") for k in s.keys])
    rows = rows.mutate(_start=F.conv(F.substring(F.md5(name.cast("binary")), 1, 7), 16, 10).cast("bigint"), _rate=F.floor(c("_n") / block) / open_)
    x = rows.rows.where((c(IDX) <= open_) & (c("_n") >= 2 * block if block > 1 else F.lit(True))).select(*s.keys, IDX, "_start", "_rate", *names)
    ddl = ", ".join([f"{k} {x.schema[k].dataType.simpleString()}" for k in s.keys] + ["b bigint"] + [f"{n} double" for n in names])
    g = x.mapInArrow(_sums(s.keys, names, replicates), ddl).groupBy(*s.keys, "b").agg(*[F.sum(n).alias(n) for n in names])
    return g.select(*s.keys, "b", stat.finish({k: c(f"_p_{k}") for k in stat.parts}).alias("value"))


def at_share(values: Column, p: Column) -> Column:
    """Percentile of a sorted array by linear interpolation."""
    at = F.greatest(F.lit(0.0), F.least(p, F.lit(1.0))) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (at - low) * (b - a)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / 1.4142135623730951))


def intervals(s: Series, stat: Statistic, replicates: int = 200, alpha: float = 0.05, block: int = 10, seed: str = "0", least: int = 5) -> DataFrame:
    """keys, estimate, std_error, lower / upper (percentiles), bca_lower /
    bca_upper, z0, acceleration, block_lower / block_upper; null for series of
    fewer than ``least`` rows (blocks: of fewer than two)."""
    z = {"lower": F.lit(alpha / 2), "upper": F.lit(1 - alpha / 2)}
    parts = {f"_p_{k}": v.cast("double") for k, v in stat.parts.items()}
    whole = s.rows.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(k) for k, v in parts.items()])
    value = stat.finish({k: c(f"_p_{k}") for k in stat.parts})
    whole = whole.select(*s.keys, "_n", value.alias("estimate"), *[c(k).alias(f"_t{k}") for k in parts])
    left = s.rows.join(whole.drop("_n", "estimate"), s.keys).withColumns(parts)
    one = left.withColumn("_j", stat.finish({k: c(f"_t_p_{k}") - c(f"_p_{k}") for k in stat.parts}))
    m = one.groupBy(*s.keys).agg(F.avg("_j").alias("_m"))
    d = c("_m") - c("_j")
    acc = one.join(m, s.keys).groupBy(*s.keys).agg(F.sum(d * d * d).alias("_c"), F.sum(d * d).alias("_q"))
    acc = acc.select(*s.keys, F.when(c("_q") > 0, c("_c") / (6 * F.pow("_q", F.lit(1.5)))).otherwise(0.0).alias("acceleration"))
    sort = F.sort_array(F.collect_list("value"))          # one number a replicate
    plain = replicated(s, stat, replicates, 1, seed).groupBy(*s.keys).agg(sort.alias("_v"), F.stddev_pop("value").alias("std_error"))
    blocks = replicated(s, stat, replicates, block, seed + "b").groupBy(*s.keys).agg(sort.alias("_w"))
    x = whole.where(c("_n") >= least).join(acc, s.keys).join(plain, s.keys).join(blocks, s.keys, "left")
    share = F.size(F.filter("_v", lambda v: v < c("estimate"))) / F.size("_v")
    # step by step, so that no long formula is repeated inside another
    x = x.withColumn("z0", F.when((share > 0) & (share < 1), probit(share)).otherwise(0.0))
    out = {"estimate": c("estimate"), "std_error": c("std_error"), "z0": c("z0"), "acceleration": c("acceleration")}
    for name, p in z.items():
        t = c("z0") + probit(p)
        bend = 1 - c("acceleration") * t
        x = x.withColumn(f"_q_{name}", F.when(F.abs(bend) < 1e-10, probit(p)).otherwise(c("z0") + t / bend))
    x = checkpointed(x)                               # one row a series
    x = checkpointed(x.withColumns({f"_p_{name}": normal_cdf(c(f"_q_{name}")) for name in z}))
    for name, p in z.items():
        out[name], out[f"block_{name}"], out[f"bca_{name}"] = at_share(c("_v"), p), at_share(c("_w"), p), at_share(c("_v"), c(f"_p_{name}"))
    return whole.select(*s.keys).join(x.select(*s.keys, *[v.alias(k) for k, v in out.items()]), s.keys, "left")
