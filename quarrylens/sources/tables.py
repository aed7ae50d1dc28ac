"""Parquet tables of one folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import share_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder: one Parquet file or a folder of them."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_source(dataset: Column, prompt: Column, code: Column) -> Column:
    """The whole source of a reference solution: after its prompt for humaneval, alone for others. Null or blank code is an error at run time."""
    there = F.length(F.trim(F.regexp_replace(code, r"\s", ""))) > 0
    whole = F.when(dataset == "humaneval", F.concat(F.coalesce(prompt, F.lit("")), code)).otherwise(code)
    return F.when(there, whole).otherwise(F.raise_error(F.lit("empty solution")).cast("string"))


def load_splits(spark: SparkSession, folder: str, fields: dict[str, str]) -> DataFrame:
    """All splits of a data set, a Parquet folder each below ``folder``, in one table with ``split``.

    ``fields`` names the wanted columns and where they come from; a split that lacks one gives nulls. Splits may have
    columns of their own, which are left out. A folder without splits is an error.
    """
    splits = sorted(r.split for r in spark.read.option("recursiveFileLookup", True).format("binaryFile").load(folder).filter("path LIKE '%.parquet'").select(F.element_at(F.split("path", "/"), -2).alias("split")).distinct().collect())
    if not splits:
        raise ValueError(f"{folder}: no splits")
    parts = []
    for name in splits:
        t = spark.read.parquet(f"{folder}/{name}")
        parts.append(t.select(F.lit(name).alias("split"), *[(F.col(c) if c in t.columns else F.lit(None)).alias(n) for n, c in fields.items()]))
    return reduce(DataFrame.unionByName, parts)
