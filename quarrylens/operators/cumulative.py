"""Running totals over a sorted order that no single task has to hold: the base of ranks, quantiles and ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.session import materialize


def cumulative(counts: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """``counts`` with ``before_x`` and ``total_x`` for each x of ``sums``: the sum over smaller ``order``, and over the group.

    Rows are range-sorted by group and order; running sums within a partition are set off by the totals of
    the partitions before it. Equal values of ``order`` in a group must have been added up beforehand, as
    after a groupBy. Null groups are groups of their own; an empty table stays empty.
    """
    # cut here: partition numbers are read twice and must be those of one sort
    part = materialize(counts.repartitionByRange(*[F.col(g) for g in groups], F.col(order)).withColumn("__part", F.spark_partition_id()))
    held = part.groupBy(*groups, "__part").agg(*[F.sum(s).alias(f"__h_{s}") for s in sums])
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    prior = whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("*", *[F.sum(f"__h_{s}").over(whole).alias(f"total_{s}") for s in sums], *[F.sum(f"__h_{s}").over(prior).alias(f"__b_{s}") for s in sums])
    keys = [*groups, "__part"]
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    run = W.partitionBy(*[F.col(f"c.{k}") for k in keys]).orderBy(F.col(f"c.{order}")).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = part.alias("c").join(held.alias("h"), same)
    return out.select(*[f"c.{c}" for c in counts.columns], *[(zero(F.col(f"h.__b_{s}")) + zero(F.sum(f"c.{s}").over(run))).alias(f"before_{s}") for s in sums], *[F.col(f"h.total_{s}").alias(f"total_{s}") for s in sums])


def _counted(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    got = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*groups, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(got, groups, "__v", ["n"])


def _at_rank(rank: Column) -> Column:
    """The value of the 0-based rank."""
    return F.min(F.when(F.col("before_n") + F.col("n") > rank, F.col("__v")))


def _name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def linear_percentiles(df: DataFrame, groups: list[str], value: str, ps: list[float]) -> DataFrame:
    """``(groups..., n, p..)``: exact percentiles, linear between ranks. Null and NaN values are left out.

    Without groups there is one row, of nulls over an empty table; so too for ``nearest_rank``.
    """
    cum = _counted(df, groups, value)
    picks = []
    for p in ps:
        h = F.lit(p) * (F.col("total_n") - 1)
        picks += [_at_rank(F.floor(h)).alias(f"__lo_{_name(p)}"), _at_rank(F.ceil(h)).alias(f"__hi_{_name(p)}")]
    got = cum.groupBy(*groups).agg(F.max("total_n").alias("n"), *picks)

    def between(p: float) -> Column:
        lo, hi, h = F.col(f"__lo_{_name(p)}"), F.col(f"__hi_{_name(p)}"), F.lit(p) * (F.col("n") - 1)
        return F.when(lo == hi, lo.cast("double")).otherwise(lo + (hi - lo) * (h - F.floor(h))).alias(_name(p))

    return got.select(*groups, "n", *[between(p) for p in ps])


def nearest_rank(df: DataFrame, groups: list[str], value: str, ps: list[float]) -> DataFrame:
    """``(groups..., n, p..)``: the value of rank max(1, ceil(p n)), exact."""
    cum = _counted(df, groups, value)
    rank = lambda p: F.greatest(F.expr(f"(total_n * {round(p * 1_000_000)} + 999999) div 1000000"), F.lit(1)) - 1
    return cum.groupBy(*groups).agg(F.max("total_n").alias("n"), *[_at_rank(rank(p)).alias(_name(p)) for p in ps])


def calibrate(corpus: DataFrame, score: str, fpr: float) -> DataFrame:
    """``(fpr, fpr_threshold, n_samples, n_scored)``: the score that the share ``fpr`` of the scored rows exceeds.

    Rows without a score (null, not a number, infinite) count as samples only; with none scored the threshold is 0. An empty
    corpus is an error at run time.
    """
    if not 0 < fpr < 1:
        raise ValueError("fpr must lie between 0 and 1")
    s = corpus.select(F.when(F.abs(score) < float("inf"), F.col(score).cast("double")).alias("s"))
    p = f"p{round((1 - fpr) * 100, 6):g}"
    top = linear_percentiles(s.filter("s IS NOT NULL"), [], "s", [1 - fpr])
    n = s.agg(F.count(F.lit(1)).alias("n_samples"), F.count("s").alias("n_scored"))
    n = n.withColumn("n_samples", F.when(F.col("n_samples") > 0, F.col("n_samples")).otherwise(F.raise_error(F.lit("empty corpus"))))
    # both sides have one row at most
    return n.join(F.broadcast(top), how="left").select(F.lit(fpr).alias("fpr"), F.coalesce(F.col(p), F.lit(0.0)).alias("fpr_threshold"), "n_samples", "n_scored")
