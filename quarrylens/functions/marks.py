"""Column functions and key material of the mark: keyed hyperplanes, valid regions, gamma schedules."""

from __future__ import annotations

import hashlib
import hmac
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hex, from Spark's own SHA-2."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in k)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in k)), F.unhex(inner)), 256)


def planes(key: str, d: int, dim: int) -> list[list[float]]:
    """d unit normals, drawn from a generator that the key seeds; a row is one plane."""
    seed = int.from_bytes(hmac.new(key.encode(), b"lsh", hashlib.sha256).digest()[:8], "big")
    m = np.random.Generator(np.random.PCG64(seed)).standard_normal((d, dim))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).tolist()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n))


def signature(vec: Column, normals: list[list[float]]) -> Column:
    """The side of each plane as bits, the first plane highest: a region number. On a plane is 0."""
    out = F.lit(0)
    for p in normals:
        side = dot(vec, F.array(*[F.lit(x) for x in p])) > 0
        out = F.call_function("shiftleft", out, F.lit(1)).bitwiseOR(side.cast("int"))
    return out


def projections(vec: Column, normals: list[list[float]]) -> Column:
    """All dot products, as an array, so that they are computed once."""
    return F.transform(F.array(*[F.array(*[F.lit(x) for x in p]) for p in normals]), lambda p: dot(vec, p))


def signature_of(projected: Column) -> Column:
    return F.aggregate(projected, F.lit(0), lambda s, x: s * 2 + (x > 0).cast("int"))


def min_margin_of(projected: Column, vec: Column) -> Column:
    """The least absolute cosine to a plane; 0 for a zero vector."""
    n = norm(vec)
    return F.when(n > 0, F.array_min(F.transform(projected, lambda x: F.abs(x))) / F.when(n > 0, n)).otherwise(F.lit(0.0))


def valid_regions(key: str, parent: str, d: int, k: int | None = None, gamma: float | None = None) -> list[int]:
    """The k regions of 2**d that are valid below a parent type: the head of a keyed shuffle."""
    n = 2**d
    k = round(gamma * n) if k is None else k
    if not 1 <= k < n:
        raise ValueError("k must be at least 1 and below 2**d")
    order = list(range(n))
    random.Random(int.from_bytes(hmac.new(key.encode(), parent.encode(), hashlib.sha256).digest()[:8], "big")).shuffle(order)
    return order[:k]


def region_table(spark: SparkSession, key: str, parents: list[str], d: int, ks: list[int]) -> DataFrame:
    """``(parent_node_type, k, signature)`` for every k asked for: at most parents x ks x 2**d rows."""
    rows = [(p, k, s) for p in parents for k in ks for s in valid_regions(key, p, d, k)]
    return spark.createDataFrame(rows, "parent_node_type string, k int, signature int")


def schedule(units: Column, anchors: list[tuple[Column, float]]) -> Column:
    """Target gamma, piecewise linear between (units, gamma) anchors and flat beyond them; equal anchors give the upper one."""
    out = F.when(units <= anchors[0][0], F.lit(anchors[0][1]))
    for (u0, g0), (u1, g1) in zip(anchors, anchors[1:]):
        out = out.when(units <= u1, F.when(u1 == u0, F.lit(g1)).otherwise(F.lit(g0) + (units - u0) / F.when(u1 != u0, u1 - u0) * F.lit(g1 - g0)))
    return out.otherwise(F.lit(anchors[-1][1]))


def quantize(gamma: Column, d: Column) -> tuple[Column, Column, Column]:
    """(target to 12 places, k, effective gamma): k rounds half to even and lies within 1 and 2**d - 1."""
    g = F.least(F.greatest(gamma, F.lit(0.0)), F.lit(1.0))
    n = F.pow(F.lit(2.0), d)
    k = F.least(F.greatest(F.bround(g * n, 0), F.lit(1.0)), n - 1).cast("int")
    return F.round(g, 12), k, k / n


def dynamic_margin(entropy: Column, base: float, alpha: float) -> Column:
    return F.lit(base) + F.lit(alpha) * entropy


def hash_feature(text: Column, buckets: int) -> Column:
    """The first 8 bytes of SHA-256 as an unsigned number, modulo the buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(buckets).cast("decimal(20,0)")).cast("int")


def softmax_entropy(logits: Column) -> Column:
    """Entropy in nats of the softmax of an array, shares held above 1e-12; null for null or empty."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def entropy(e: Column) -> Column:
        shares = _let(add(e), lambda t: F.transform(e, lambda x: F.greatest(x / t, F.lit(1e-12))))
        return -add(F.transform(shares, lambda p: p * F.ln(p)))

    shifted = _let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return F.when(F.size(logits) > 0, _let(shifted, entropy))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once: an expression used inside a lambda is computed at each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def descending_order(logits: Column) -> Column:
    """Positions from the greatest value down, ties by position."""
    return F.transform(F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))), lambda s: s["i"])


def green_ids(order: list[int], prefix: tuple[int, ...], key: str) -> set[int]:
    """The green half: of each two neighbours in the order one, by a bit that key and prefix determine."""
    seed = hmac.new(key.encode(), ",".join(map(str, prefix)).encode(), hashlib.sha256).digest()
    green, digest = set(), b""
    for n in range((len(order) + 1) // 2):
        if n % 256 == 0:
            digest = hashlib.sha256(seed + (n // 256).to_bytes(8, "big")).digest()
        bit = digest[n % 256 // 8] >> (n % 8) & 1
        pair = order[2 * n : 2 * n + 2]
        if len(pair) == 2:
            green.add(pair[bit])
        elif not bit:
            green.add(pair[0])
    return green


def green_tokens(logits: Column, prefix: Column, key: str) -> Column:
    """The sorted green ids of each row; hash streams are Python's, in Arrow batches."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def run(order: pd.Series, pre: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else sorted(green_ids([int(x) for x in o], tuple(int(x) for x in (p if p is not None else ())), key)) for o, p in zip(order, pre)])

    return run(descending_order(logits), prefix)
