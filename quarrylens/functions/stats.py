"""Column functions of the detection statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def mean_or_zero(c) -> Column:
    """Mean, 0 over no rows."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def std_or_zero(c) -> Column:
    """Sample standard deviation, 0 over fewer than two rows."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def ratio_or_zero(a, b) -> Column:
    a, b = (x if isinstance(x, Column) else F.col(x) for x in (a, b))
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def relative_delta(new: Column, old: Column) -> Column:
    """(new - old) / old; 0 from nothing to nothing, infinity from nothing to something."""
    return F.when(old != 0, (new - old) / old).when(new == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def z_score(hits: Column, expected: Column, variance: Column) -> Column:
    """Where nothing varies: 0 if hits are as expected, else infinite with the sign of the difference."""
    d = hits - expected
    return F.when(variance > 0, d / F.sqrt(F.when(variance > 0, variance))).when(d == 0, F.lit(0.0)).when(d > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal; null for null. Neither Spark nor SQL has an error function."""
    root = math.sqrt(2)
    return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / root)).astype("float64")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share, rounded to 6 places, within 0 and 1; (0, 0) over no rows."""
    p = F.when(n > 0, k / F.when(n > 0, n)).otherwise(F.lit(0.0))
    m = F.when(n > 0, n).otherwise(F.lit(1))
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    low = F.when(n > 0, F.round(F.greatest(centre - half, F.lit(0.0)), 6)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.round(F.least(centre + half, F.lit(1.0)), 6)).otherwise(F.lit(0.0))
    return low, high


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k), k cut to n; 0 for no candidates."""
    kk = F.least(F.lit(k), n)
    miss = F.aggregate(F.sequence(F.lit(1), F.greatest(kk, F.lit(1))), F.lit(1.0), lambda acc, i: acc * (n - c - i + 1) / F.greatest(n - i + 1, F.lit(1)))
    return F.when(n == 0, F.lit(0.0)).when(n - c < kk, F.lit(1.0)).otherwise(1.0 - miss)


def fuse(zs: Column, zl: Column, n: Column, n_min: int, ws: float = 1.0, wl: float = 0.5) -> Column:
    """Semantic and lexical evidence in one score; the lexical one counts by how much of n_min was scored."""
    return ws * zs + wl * F.least(F.lit(1.0), n / F.lit(float(n_min))) * zl


def rationale(zs: Column, zl: Column) -> Column:
    """The two evidences in words, by the bands 4 and 2, and 4 and 1."""
    s = F.when(zs >= 4, "semantic strong").when(zs >= 2, "semantic borderline").otherwise("semantic weak")
    x = F.when(zl >= 4, "lexical strong").when(zl >= 1, "lexical supportive").otherwise("lexical weak")
    return F.concat_ws(", ", s, x)


def shannon_bits(share: Column) -> Column:
    """Aggregate: entropy of shares that add up to one."""
    return F.lit(0.0) - F.sum(F.when(share > 0, share * F.log2(share)).otherwise(F.lit(0.0)))
