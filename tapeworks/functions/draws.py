"""Repeatable draws: numbers come from a hash of a row's key, so they do not
depend on partitioning or on retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str, seed: str = "0") -> Column:
    """Uniform number in (0, 1) from the first 32 bits of md5(seed:part:...)."""
    cols = [F.lit(seed)] + [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def md5_mod_100(text: Column) -> Column:
    """md5 as a 128-bit number modulo 100, from its two 64-bit halves
    (2**64 mod 100 = 16); each half is reduced 32 bits at a time."""
    h = F.md5(text)

    def half(at: int) -> Column:
        hi = F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
        lo = F.conv(F.substring(h, at + 8, 8), 16, 10).cast("bigint")
        return (hi % 100 * 96 + lo) % 100          # 2**32 mod 100 = 96

    return (half(1) * 16 + half(17)) % 100


def erf(x: Column) -> Column:
    """Error function in double precision from built-in columns: a power series
    for |x| < 3, a continued fraction for the tail beyond."""
    a = F.abs(x)
    z = a * a
    # sum of (2z)^n / (2n+1)!! has no alternating signs; nested form, innermost first
    acc = F.lit(1.0)
    for n in range(40, 0, -1):
        acc = 1.0 + acc * (2.0 * z / (2 * n + 1))
    near = 2 / 1.7724538509055159 * a * F.exp(-z) * acc
    frac = a
    for n in range(20, 0, -1):
        frac = a + (n / 2.0) / frac
    far = 1 - F.exp(-z) / (1.7724538509055159 * frac)
    return F.signum(x) * F.when(a < 3, near).otherwise(far)
