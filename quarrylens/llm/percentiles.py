"""Percentiles of large numeric columns from group-value counts, with a stated error and mergeable.

The state is a table ``(groups..., bin, n)``: how often each value occurs, values of more than ``bits``
binary digits rounded down to that many. States of several days or partitions are combined by adding their
counts. A percentile read from it is within ``error_bound`` of the exact one, at most 2**-bits of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.session import materialize

BITS = 8


def _shift(v: Column, bits: int) -> Column:
    return F.greatest(F.length(F.bin(F.abs(v))) - bits, F.lit(0)).cast("int")


def bin_of(v: Column, bits: int = BITS) -> Column:
    """The value's lower edge, away from zero for negative values; values of ``bits`` binary digits are exact."""
    s = _shift(v, bits)
    edge = F.call_function("shiftleft", F.call_function("shiftright", F.abs(v), s), s)
    return F.when(v < 0, -edge).otherwise(edge)


def _named(once: list[str] | None) -> list[Column]:
    """128 bits that stand for the naming columns; the hash skips nulls, so they are told apart by a mask."""
    if not once:
        return []
    mask = F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in once])
    return [F.xxhash64(mask, *once).alias("__a"), F.xxhash64(F.lit(1), mask, *once).alias("__b")]


def summarize(df: DataFrame, groups: list[str], value: str, once: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """``(groups..., bin, n)`` of the whole-number column ``value``; null values are left out, null groups are groups.

    Rows equal in ``once``, the groups and the value are repeats and count once.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("long").alias("__v"), *_named(once))
    if once:
        # the shuffle holds two hashes, 128 bits, in place of the naming columns
        rows = rows.distinct()
    return rows.groupBy(*groups, bin_of(F.col("__v"), bits).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(states: DataFrame, groups: list[str]) -> DataFrame:
    """The state of coarser groups, or of several states in one table."""
    return states.groupBy(*groups, "bin").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, groups: list[str], ps: list[float], bits: int = BITS) -> DataFrame:
    """``(groups..., n, p.., error_bound)``: for each p the value of nearest rank, ceil(p n) from below.

    A value is the middle of its bin; ``error_bound`` is half the widest bin among those reported. The counts
    are range-sorted by group and value; each partition's running sums within a group are set off by what
    the partitions before it hold of the group, so a group of any size spreads over partitions. Percentiles
    are named p50, p99, p99_9. An empty state gives an empty table.
    """
    clash = {"bin", "n", "error_bound"} & set(groups)
    if clash:
        raise ValueError(f"rename the group columns {sorted(clash)}")
    by = [F.col(g) for g in groups]
    # cut here: partition numbers are read twice and must be those of one sort
    sorted_counts = materialize(state.repartitionByRange(*by, F.col("bin")).withColumn("__part", F.spark_partition_id()))
    held = sorted_counts.groupBy(*groups, "__part").agg(F.sum("n").alias("__held"))
    whole = W.partitionBy(*groups)
    held = held.withColumn("__total", F.sum("__held").over(whole)).withColumn("__before", F.sum("__held").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*groups, "__part"]]
    run = W.partitionBy(*[F.col(f"c.{c}") for c in [*groups, "__part"]]).orderBy("c.bin")
    cum = sorted_counts.alias("c").join(held.alias("h"), same).select("c.*", "h.__total", (F.coalesce("h.__before", F.lit(0)) + F.sum("c.n").over(run)).alias("__cum"))
    names = {p: "p" + f"{p * 100:g}".replace(".", "_") for p in ps}
    rank = lambda p: F.expr(f"(__total * {round(p * 1_000_000)} + 999999) div 1000000")
    picks = [F.min(F.when(F.col("__cum") >= F.greatest(rank(p), F.lit(1)), F.col("bin"))).alias(names[p]) for p in ps]
    out = cum.groupBy(*groups).agg(F.max("__total").alias("n"), *picks)

    def half(c: Column) -> Column:
        return F.expr(f"shiftleft(1L, greatest(length(bin(abs({c}))) - {bits}, 0)) div 2")

    def middle(name: str) -> Column:
        h = half(name)
        return F.when(F.col(name) < 0, F.col(name) - h).otherwise(F.col(name) + h)

    return out.select(*groups, "n", *[middle(names[p]).alias(names[p]) for p in ps], F.greatest(*[half(names[p]) for p in ps], F.lit(0)).alias("error_bound"))
