"""Joins whose many side may hold a large part of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, key: str, n: str, total: int, share: float = 0.005, least: int = 10_000) -> list:
    """Keys that hold more than ``share`` of ``total`` rows: at most 1 / share of them, so they may be collected."""
    return [r[key] for r in counts.filter(F.col(n) > max(least, total * share)).select(key).collect()]


def join_unique(many: DataFrame, unique: DataFrame, key: str, hot: list, row: list[str], salts: int = 32, how: str = "inner") -> DataFrame:
    """``many`` joined to ``unique`` (one row a key), the rows of hot keys spread over ``salts`` parts by a hash of ``row``.

    Only the few rows of ``unique`` under hot keys are repeated. ``how`` is inner, left or left_semi.
    """
    if not hot:
        return many.join(unique, key, how)
    is_hot: Column = F.col(key).isin(hot)
    part = F.when(is_hot, F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    parts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return many.withColumn("__part", part).join(unique.withColumn("__part", parts), [key, "__part"], how).drop("__part")
