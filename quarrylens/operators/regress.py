"""Run against run: compatibility, deltas per sample, parameter and count changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.relate import key_diff, last_by, map_delta

# The fields of an embedding comparison, and the diagnostic fields a record may carry.
EMBEDDING = ["total_blocks", "embedded_blocks", "failed_blocks", "fallback_blocks", "embed_rate"]
DIAGNOSTICS = ["diagnostics_version", "retry_summary", "cascade_summary", "failure_reason_counts", "rescued_blocks", "unrescued_blocks"]


def deltas(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key of both runs, by its last row: right minus left of the numbers, and what follows.

    ``z_delta`` is null where either z is null or the difference is not a number; ``flip`` is gained, lost or
    null; the flags are detection_lost, z_score_drop and block_growth_without_hit_gain. Keys that one run
    lacks have no row: see ``key_diff``.
    """
    a, b = (last_by(t.select(*keys, "is_watermarked", "z_score", "independent_blocks", "hits", order), keys, order).alias(n) for t, n in ((left, "a"), (right, "b")))
    j = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    num = lambda c: F.col(f"b.{c}").cast("double") - F.col(f"a.{c}").cast("double")
    was, now = F.col("a.is_watermarked"), F.col("b.is_watermarked")
    z, blocks, hits = num("z_score"), num("independent_blocks"), num("hits")
    z = F.when(~F.isnan(z), z)
    flip = F.when(was & ~now, "lost").when(~was & now, "gained")
    flags = F.array_compact(F.array(F.when(flip == "lost", F.lit("detection_lost")), F.when(z < 0, F.lit("z_score_drop")), F.when((blocks > 0) & (hits <= 0), F.lit("block_growth_without_hit_gain"))))
    return j.select(*[f"a.{k}" for k in keys], z.alias("z_delta"), blocks.cast("long").alias("blocks_delta"), hits.cast("long").alias("hits_delta"), flip.alias("flip"), flags.alias("flags"))


def uniform_value(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``(by..., n_values, n_missing, is_uniform)``: does one value hold in all rows; some missing is not uniform."""
    got = df.groupBy(*by).agg(F.count_distinct(value).alias("n_values"), F.count_if(value.isNull()).alias("n_missing"), F.count(F.lit(1)).alias("__n"))
    ok = ((F.col("n_values") == 1) & (F.col("n_missing") == 0)) | (F.col("n_missing") == F.col("__n"))
    return got.select(*by, "n_values", "n_missing", ok.alias("is_uniform"))


def count_delta(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``(keys..., delta)``: right minus left of a count, a missing one being 0."""
    a, b = left.groupBy(*keys).agg(F.sum(n).alias("__a")), right.groupBy(*keys).agg(F.sum(n).alias("__b"))
    return a.join(b, keys, "full").select(*keys, (F.coalesce("__b", F.lit(0)) - F.coalesce("__a", F.lit(0))).alias("delta"))


def embedding_deltas(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``(keys..., ..._delta)``: right minus left of the five embedding fields, of keys whose last rows have all of them."""
    a, b = (last_by(t.select(*keys, *EMBEDDING, order), keys, order).dropna(subset=EMBEDDING).alias(n) for t, n in ((left, "a"), (right, "b")))
    j = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    kind = {"embed_rate": "double"}
    return j.select(*[f"a.{k}" for k in keys], *[(F.col(f"b.{c}").cast(kind.get(c, "long")) - F.col(f"a.{c}").cast(kind.get(c, "long"))).alias(f"{c}_delta") for c in EMBEDDING])


def as_int(v: Column) -> Column:
    """A JSON value as a whole number: numbers cut to whole ones, booleans 0 or 1, texts of whole numbers; else null."""
    t = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(t == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double").cast("bigint"))
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when((t == "STRING") & text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
    )


def route_one(left: Column, right: Column) -> Column:
    """Changes of two records (variants): a struct of the deltas of counts by name and of two scalars.

    A value that is no whole number counts as missing, a missing count as 0. A scalar that neither record has, and a
    map that neither has, has no delta (null, empty).
    """
    out = []
    for f in ("rescued_blocks", "unrescued_blocks"):
        a, b = (as_int(F.try_variant_get(v, f"$.{f}", "variant")) for v in (left, right))
        out.append(F.when(a.isNotNull() | b.isNotNull(), F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0))).alias(f"{f}_delta"))
    for f, suffix in (("retry_summary", "_delta"), ("cascade_summary", "_delta"), ("failure_reason_counts", "")):
        counts = lambda v: F.map_filter(F.transform_values(F.coalesce(F.try_variant_get(v, f"$.{f}", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, x: as_int(x)), lambda k, n: n.isNotNull())  # noqa: B023, E731
        out.append(map_delta(counts(left), counts(right), suffix).alias(f))
    return F.struct(*out)


def report(left: DataFrame, right: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """One row for each group: do both have the same keys and complete rows, and what changed between them.

    ``missing_in_left`` and ``missing_in_right`` are sorted keys, comma between; ``comparable_details`` says that no
    last row lacks a field that is compared; the counts are of the flags of ``deltas``.
    """
    need = ["z_score", "p_value", "is_watermarked", "independent_blocks", "hits"]
    sides = key_diff(left, right, [*by, key])
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col(key)))), ",")
    none = lambda side: F.count_if(F.col("side") == side) == 0
    c = sides.groupBy(*by).agg((none("left_only") & none("right_only")).alias("same_id_set"), listed(F.col("side") == "right_only").alias("missing_in_left"), listed(F.col("side") == "left_only").alias("missing_in_right"))
    rows = [last_by(t.select(*by, key, *need, order), [*by, key], order).select(*by, F.greatest(*[F.col(f).isNull() for f in need]).alias("lacks")) for t in (left, right)]
    m = rows[0].unionByName(rows[1]).groupBy(*by).agg(F.count_if("lacks").alias("n_incomplete"))
    flag = lambda name: F.count_if(F.array_contains("flags", name))
    x = deltas(left, right, [*by, key], order)
    d = x.groupBy(*by).agg(F.count(F.lit(1)).alias("total_samples"), listed(F.col("flip") == "lost").alias("detection_loss_ids"), flag("detection_lost").alias("n_detection_lost"), flag("z_score_drop").alias("n_z_score_drop"), flag("block_growth_without_hit_gain").alias("n_block_growth"))
    out = c.join(m, by, "left").join(d, by, "left")
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("n_incomplete", "total_samples", "n_detection_lost", "n_z_score_drop", "n_block_growth")}
    out = out.withColumns(zero | {"detection_loss_ids": F.coalesce("detection_loss_ids", F.lit(""))})
    return out.withColumn("comparable_details", F.col("n_incomplete") == 0)


def preferred(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, origin): the first source with a value, and its name; null and ``missing`` where none has one."""
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in sources], F.lit("missing"))
    return F.coalesce(*[c for _, c in sources]), origin
