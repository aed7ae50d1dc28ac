"""JSON lines, whole JSON files and logs: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a line that is no object of the schema is an error."""
    lines = spark.read.text(path).filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    whole = F.when(F.get_json_object("value", "$").startswith("{"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 80))))
    return lines.select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    """``df``, failing at run time if an id repeats."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    once = n.filter(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(key))).cast("boolean")).otherwise(F.lit(True)))
    return df.join(once, key).drop("__n")


def id_state(line: Column, field: str = "id") -> Column:
    """blank, malformed, no_id or ok: what a tolerant scan makes of a line. Only text that is not empty is an id."""
    v = F.try_parse_json(line)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    text = F.try_variant_get(v, f"$.{field}", "string")
    return F.when(line.isNull() | (F.regexp_replace(line, r"\s", "") == ""), "blank").when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "malformed").when((kind == "STRING") & (F.trim(text) != ""), "ok").otherwise("no_id")


def tolerant_ids(lines: DataFrame, line: str, field: str = "id", most_malformed: float = 0.1) -> DataFrame:
    """Distinct ids of the good lines; fails at run time if more than the share of lines that are not blank is malformed."""
    s = lines.select(id_state(F.col(line), field).alias("s"), F.get_json_object(line, f"$.{field}").alias(field))
    n = s.agg(F.count_if(F.col("s") == "malformed").alias("bad"), F.count_if(F.col("s") != "blank").alias("all"))
    gate = n.select(F.when(F.col("bad") > most_malformed * F.col("all"), F.raise_error(F.lit("too many malformed lines"))).otherwise(F.lit(True))).scalar()
    return s.filter("s = 'ok'").select(field).distinct().filter(gate)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A whole-file JSON document."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_versioned(spark: SparkSession, path: str, row_schema: str, version: int) -> DataFrame:
    """The rows of a ``{schema_version, rows}`` document; another version or no list of rows is an error."""
    doc = spark.read.option("multiLine", True).schema(f"schema_version int, rows array<struct<{row_schema}>>").json(path)
    ok = (F.col("schema_version") == version) & F.col("rows").isNotNull()
    checked = doc.select(F.when(ok, F.col("rows")).otherwise(F.raise_error(F.lit(f"not a document of version {version}"))).alias("rows"))
    return checked.select(F.inline("rows"))


def log_values(lines: DataFrame, line: str, pattern: str) -> DataFrame:
    """``lines`` with ``value``: the first match of the pattern's group in each line that has one."""
    hit = F.regexp_extract(line, pattern, 1)
    return lines.withColumn("value", hit.try_cast("double")).filter(F.regexp_like(F.col(line), F.lit(pattern)))


def latest_file(spark: SparkSession, glob: str) -> DataFrame:
    """``(path, modified)`` of the file last modified under a glob; no row where none is there."""
    try:
        files = spark.read.format("binaryFile").load(glob).select("path", F.col("modificationTime").alias("modified"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string, modified timestamp")
        raise
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(1)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8, one file a partition; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the Parquet sink does not have: running it again adds nothing."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    fresh = df.dropDuplicates(keys)
    (fresh if have is None else fresh.join(have.select(*keys).distinct(), keys, "left_anti")).write.mode("append").parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """A small result (one row or few) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_pair(df: DataFrame, path: str, sidecar: DataFrame, sidecar_path: str) -> None:
    """Two outputs of one source, the second only once the first is whole."""
    df.write.mode("overwrite").parquet(path)
    sidecar.write.mode("overwrite").parquet(sidecar_path)


def typed(variant: Column, path: str, kind: str, low: float | None = None, high: float | None = None) -> Column:
    """The field's value if it has exactly the JSON type (integer, number, boolean or string) and range, else null.

    A boolean is no number, a number with a fraction no integer, and text that looks like a number is text.
    """
    v = F.try_variant_get(variant, path, "variant")
    t = F.schema_of_variant(v)
    ints, reals = t == "BIGINT", t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")
    ok = {"integer": ints, "number": ints | reals, "boolean": t == "BOOLEAN", "string": t == "STRING"}[kind]
    out = F.when(ok, F.try_variant_get(variant, path, {"integer": "bigint", "number": "double"}.get(kind, kind)))
    if low is not None:
        out = F.when(out >= low, out)
    return out if high is None else F.when(out <= high, out)


def allowed(line: Column, names: list[str]) -> Column:
    """The fields of a JSON object that are in the list, as a map of JSON values; empty where the line is no object."""
    have = F.coalesce(F.try_variant_get(F.try_parse_json(line), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.map_filter(have, lambda k, v: k.isin(names))
