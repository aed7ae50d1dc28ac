"""Relational operators of the audit pipeline: resume, last-wins lookups, positional comparison, first sights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unprocessed(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``work`` whose key ``done`` does not have; null keys are never done. Repeated rows stay."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def last_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, by ``order`` (null first), as a lookup in which later rows overwrite earlier ones.

    Aggregated, so that a hot key shrinks before the shuffle; null keys are a key.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.struct(F.col(o).isNotNull(), F.col(o)) for o in order])).alias("__r")).select(*keys, "__r.*")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, default, order: str) -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row of its key, or the default."""
    r = last_by(right.select(*keys, value, order), keys, order).drop(order)
    return left.drop(value).join(r, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def must_match(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``left`` with ``value`` of the one ``right`` row of its key; a key that ``right`` lacks is an error at run time.

    Empty texts and nulls are no keys and so have no match.
    """
    r = right.select(*keys, value).withColumn("__there", F.lit(True))
    got = left.drop(value).join(r, keys, "left")
    said = F.concat(F.lit("no reference for "), F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    ok = F.when(F.col("__there").isNotNull() & (F.length(F.concat_ws("", *[F.col(k).cast("string") for k in keys])) > 0), F.col(value)).otherwise(F.raise_error(said).cast(right.schema[value].dataType))
    return got.withColumn(value, ok).drop("__there")


def key_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., side)``: left_only, right_only or both, each key once."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    j = a.join(b, keys, "full")
    return j.select(*keys, F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both").alias("side"))


STRUCTURE = ["ordinal", "block_id", "node_type", "parent_node_type", "block_text_hash", "start_line", "end_line"]
NUMERIC = ["entropy_units", "gamma_target", "k", "gamma_effective"]


_CONTRACTS = "array<struct<ordinal:int,block_id:string,node_type:string,parent_node_type:string,block_text_hash:string,start_line:int,end_line:int,entropy_units:int,gamma_target:double,k:int,gamma_effective:double>>"


def align(embedded: Column, rebuilt: Column, mode: Column) -> Column:
    """Comparison of two contract lists place by place, over the places both have.

    A struct: both counts, ``block_count_mismatch``, ``structure_mismatch`` (a count or a structural field differs),
    ``numeric_mismatch``, the lists of mismatches (ordinal, field, embedded, rebuilt) in the order of places and
    fields, ``contract_valid`` (for mode adaptive all must agree, for any other mode the structure),
    ``is_aligned`` and ``status``: aligned, structure_mismatch, numeric_mismatch or structure_and_numeric_mismatch.
    Null gamma_target, k and gamma_effective are 0; otherwise null equals null only. Null lists are empty.
    """
    e, r = (F.coalesce(c, F.array().cast(_CONTRACTS)) for c in (embedded, rebuilt))
    n = F.least(F.size(e), F.size(r))
    e2, r2 = F.slice(e, F.lit(1), n), F.slice(r, F.lit(1), n)

    def list_of(fields: list[str], kind: str, zero: tuple[str, ...]) -> Column:
        def one(x: Column, y: Column) -> Column:
            parts = []
            for f in fields:
                a, b = x[f].cast(kind), y[f].cast(kind)
                if f in zero:
                    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
                said = F.struct(F.coalesce(y["ordinal"], x["ordinal"]).alias("ordinal"), F.lit(f).alias("field"), a.alias("embedded"), b.alias("rebuilt"))
                parts.append(F.when(~a.eqNullSafe(b), said))
            return F.array_compact(F.array(*parts))

        return F.flatten(F.zip_with(e2, r2, one))

    s, m = list_of(STRUCTURE, "string", ()), list_of(NUMERIC, "double", ("gamma_target", "k", "gamma_effective"))
    count = F.size(e) != F.size(r)
    said = F.struct(F.lit(None).cast("int").alias("ordinal"), F.lit("block_count").alias("field"), F.size(e).cast("string").alias("embedded"), F.size(r).cast("string").alias("rebuilt"))
    s = F.when(count, F.concat(F.array(said), s)).otherwise(s)
    bad_s, bad_m = F.size(s) > 0, F.size(m) > 0
    status = F.when(bad_s & bad_m, "structure_and_numeric_mismatch").when(bad_s, "structure_mismatch").when(bad_m, "numeric_mismatch").otherwise("aligned")
    valid = F.when(mode.eqNullSafe("adaptive"), ~bad_s & ~bad_m).otherwise(~bad_s)
    return F.struct(
        F.size(e).alias("embedded_block_count"), F.size(r).alias("rebuilt_block_count"), count.alias("block_count_mismatch"), bad_s.alias("structure_mismatch"), bad_m.alias("numeric_mismatch"),
        s.alias("structure_mismatches"), m.alias("numeric_mismatches"), valid.alias("contract_valid"), (~bad_s & ~bad_m).alias("is_aligned"), status.alias("status"),
    )


def first_seen(df: DataFrame, by: list[str], order: list[str], eligible: Column | None = None) -> DataFrame:
    """The first row of each key in order, over eligible rows only: one that is not eligible does not count as seen."""
    rows = df if eligible is None else df.filter(eligible)
    rest = [c for c in df.columns if c not in by]
    # aggregated, so that a hot key shrinks before the shuffle; a null comes first, as it does in a sort
    place = F.struct(*[x for o in order for x in (F.col(o).isNotNull(), F.col(o))])
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), place).alias("__r")).select(*by, "__r.*").select(*df.columns)


def prefix_window(value: str, by: list[str], order: str, width: int) -> Column:
    """The up to ``width`` values before the row."""
    return F.collect_list(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-width, -1))


def left_pad(values: Column, width: int, fill) -> Column:
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(F.lit(width) - F.size(values), F.lit(0))), values)


def ordinal_report(df: DataFrame, keys: list[str], ordinal: str, expected: Column) -> DataFrame:
    """``(keys..., expected, n_missing, gaps, missing, out_of_range, repeated)``: how the ordinals of a key differ from 0 .. expected - 1.

    ``gaps`` holds what is missing as ranges (first, last), which take no more room than the ordinals there are;
    ``missing`` lists each, so leave it unselected where ``expected`` may be wrong and huge: it is made only if it is
    read. ``expected`` is an aggregate. Null ordinals are left out. Only distinct ordinals are held, one array a key.
    """
    per = df.groupBy(*keys, ordinal).agg(F.count(F.lit(1)).alias("__n"), expected.alias("__e"))
    got = per.groupBy(*keys).agg(F.max("__e").alias("expected"), F.sort_array(F.collect_set(ordinal)).alias("__s"), F.sort_array(F.collect_set(F.when((F.col("__n") > 1) & F.col(ordinal).isNotNull(), F.col(ordinal)))).alias("repeated"))
    inside = lambda x: (x >= 0) & (x < F.col("expected"))
    got = got.withColumn("__in", F.filter("__s", inside))
    top = F.greatest(F.coalesce("expected", F.lit(0)), F.lit(0))
    one = lambda x: F.array(x.cast("int"))
    gaps = F.zip_with(F.concat(one(F.lit(-1)), "__in"), F.concat("__in", one(top)), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    got = got.withColumn("gaps", F.filter(gaps, lambda g: g["first"] <= g["last"]))
    missing = F.flatten(F.transform("gaps", lambda g: F.sequence(g["first"], g["last"])))
    return got.select(*keys, "expected", (top - F.size("__in")).alias("n_missing"), "gaps", missing.alias("missing"), F.filter("__s", lambda x: ~inside(x)).alias("out_of_range"), "repeated")


def seeded_split(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """``df`` with ``split`` train or eval: the share of training rows to within hashing, the same on every run.

    By the rank of a hash only where the exact count matters; here each row decides by itself, without shuffle.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") / 2**32
    return df.withColumn("split", F.when(u < ratio, "train").otherwise("eval"))


def map_delta(left: Column, right: Column, suffix: str = "_delta") -> Column:
    """right - left over all keys, missing ones 0, key names with a suffix."""
    empty = F.create_map().cast("map<string,int>")
    d = F.map_zip_with(F.coalesce(left, empty), F.coalesce(right, empty), lambda k, a, b: F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0)))
    return F.transform_keys(d, lambda k, v: F.concat(k, F.lit(suffix)))


def differing_keys(left: Column, right: Column) -> Column:
    """Sorted keys of two maps of text whose values differ; a missing key is as a null."""
    empty = F.create_map().cast("map<string,string>")
    d = F.map_zip_with(F.coalesce(left, empty), F.coalesce(right, empty), lambda k, a, b: ~a.eqNullSafe(b))
    return F.array_sort(F.map_keys(F.map_filter(d, lambda k, v: v)))
