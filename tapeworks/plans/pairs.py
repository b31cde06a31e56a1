"""Pair statistics of a panel (t, asset, value) without emitting pairs per t.

The values of one t are packed into one array per asset tile, tile pairs meet
on t, and NumPy turns a batch of rows into partial sums for all pairs of the
two tiles.  Only those partial sums are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _dense(col: pa.ListArray):
    flat, lens = col.flatten(), np.diff(col.offsets.to_numpy())
    ids, where = np.unique(flat.field("a").to_numpy(zero_copy_only=False), return_inverse=True)
    x = np.full((len(lens), len(ids)), np.nan)
    x[np.repeat(np.arange(len(lens)), lens), where] = flat.field("v").to_numpy(zero_copy_only=False)
    return ids, x


def _sums(part: pa.RecordBatch, flag: bool):
    (ia, xa), (ib, xb) = _dense(part.column("_a")), _dense(part.column("_b"))
    ma, mb = (~np.isnan(xa)).astype(float), (~np.isnan(xb)).astype(float)
    za, zb = np.nan_to_num(xa), np.nan_to_num(xb)
    stats = [ma.T @ mb, za.T @ mb, ma.T @ zb, (za * za).T @ mb, ma.T @ (zb * zb), za.T @ zb]
    i, j = np.meshgrid(ia, ib, indexing="ij")
    keep = (stats[0] > 0) & ((i <= j) if flag else np.ones_like(i, bool))
    lo, hi = i[keep], j[keep]
    vals = [s[keep] for s in stats]
    if not flag:                       # order the pair, swap its one-sided sums
        sw = lo > hi
        lo, hi = np.where(sw, hi, lo), np.where(sw, lo, hi)
        vals[1], vals[2] = np.where(sw, vals[2], vals[1]), np.where(sw, vals[1], vals[2])
        vals[3], vals[4] = np.where(sw, vals[4], vals[3]), np.where(sw, vals[3], vals[4])
    return lo, hi, vals


def _gram(batches):
    """Partial sums of each (group, tile, tile) of a batch: matrices of at most
    a tile's assets on either side."""
    for b in batches:
        if b.num_rows == 0:
            continue
        cell = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in ("_g", "_tile", "_tile_b")])
        cells, which = np.unique(cell, axis=0, return_inverse=True)
        which = which.reshape(-1)
        for k, (g, ta, tb) in enumerate(cells.tolist()):
            lo, hi, vals = _sums(b.filter(pa.array(which == k)), ta == tb)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), g, "int64")), pa.array(lo.astype("int64")), pa.array(hi.astype("int64")), *[pa.array(v) for v in vals]], names=["_g", "i", "j", *SUMS])


def pair_sums(panel: DataFrame, t: list[str], asset: str, value: str, n_assets: int | None = None, group: str | None = None, centre: bool = True) -> DataFrame:
    """Sums n, x, y, xx, yy, xy per asset pair i <= j (integer asset ids), over
    the t where both have a value, within each value of the integer column
    ``group``.

    Assets are dealt to tiles of about ``TILE`` (``n_assets`` is counted when it
    isn't given), so neither a row nor a matrix grows with the universe.
    ``centre`` takes each asset's mean off first: covariances don't change and
    large levels don't cancel; raw sums need it off.
    """
    g = F.lit(0).cast("bigint") if group is None else F.col(group).cast("bigint")
    p = panel.where(F.col(value).isNotNull()).select(*t, g.alias("_g"), F.col(asset).cast("bigint").alias("a"), F.col(value).cast("double").alias("v"))
    if n_assets is None:
        n_assets = p.select("a").distinct().count()
    tiles = max(1, -(-n_assets // TILE))
    if centre:
        p = p.join(p.groupBy("_g", "a").agg(F.avg("v").alias("_m")), ["_g", "a"]).withColumn("v", F.col("v") - F.col("_m"))
    rows = p.groupBy(*t, "_g", F.pmod(F.xxhash64("a"), F.lit(tiles)).alias("_tile")).agg(F.collect_list(F.struct("a", "v")).alias("_a"))
    if tiles == 1:
        both = rows.select("_g", "_tile", F.col("_tile").alias("_tile_b"), "_a", F.col("_a").alias("_b"))
    else:
        other = rows.select(*t, "_g", F.col("_tile").alias("_tile_b"), F.col("_a").alias("_b"))
        both = rows.join(other, [*t, "_g"]).where("_tile <= _tile_b").select("_g", "_tile", "_tile_b", "_a", "_b")
    part = both.mapInArrow(_gram, "_g bigint, i bigint, j bigint, " + ", ".join(f"{s} double" for s in SUMS))
    out = part.groupBy("_g", "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    return out.drop("_g") if group is None else out.withColumnRenamed("_g", group)


def cov(ddof: int = 1) -> Column:
    return (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - ddof)


def corr() -> Column:
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return F.when((vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
