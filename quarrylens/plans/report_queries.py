"""Queries of run reports, calibration, diagnostics, and of readers and writers, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import cumulative, regress, relate
from quarrylens.plans.relate_queries import _DELTA
from quarrylens.plans.stat_queries import r6
from quarrylens.session import shared_folder
from quarrylens.sources import jsonl
from quarrylens.sources.tables import load_splits, normal_source, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Runs against runs

_RUNS = "r AS (SELECT min(run_id) AS a, max(run_id) AS b FROM samples WHERE run_id LIKE 'humaneval%'), l AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY record_id DESC) = 1)"
_EMBED = ", ".join(f"CAST(y.{c} AS BIGINT) - CAST(x.{c} AS BIGINT) AS {c}_delta" for c in regress.EMBEDDING[:-1])
_THERE = " AND ".join(f"{t}.{c} IS NOT NULL" for t in "xy" for c in regress.EMBEDDING)


def _two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "samples")
    r = s.filter("run_id LIKE 'humaneval%'").agg(F.min("run_id").alias("a"), F.max("run_id").alias("b"))
    of = lambda c: s.join(F.broadcast(r.select(F.col(c).alias("run_id"))), "run_id")  # noqa: E731  # one row
    return of("a"), of("b")


@query(f"WITH {_RUNS} SELECT x.id, {_EMBED}, round(y.embed_rate - x.embed_rate, 6) + 0 AS embed_rate_delta FROM l x JOIN l y ON x.id = y.id JOIN r ON x.run_id = r.a AND y.run_id = r.b WHERE {_THERE}")
def compare_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The last run of one data set against its first, for tasks whose records have all five fields in both."""
    got = regress.embedding_deltas(*_two_runs(spark, d), ["id"], "record_id")
    return got.withColumn("embed_rate_delta", F.round("embed_rate_delta", 6) + F.lit(0.0))


_INT = """CASE json_type({x}) WHEN 'BIGINT' THEN CAST({x} AS BIGINT) WHEN 'UBIGINT' THEN CAST({x} AS BIGINT) WHEN 'DOUBLE' THEN CAST(trunc(CAST({x} AS DOUBLE)) AS BIGINT)
WHEN 'BOOLEAN' THEN CAST(CAST({x} AS BOOLEAN) AS BIGINT) WHEN 'VARCHAR' THEN try_cast(CASE WHEN regexp_full_match({x}->>'$', '\\s*[+-]?[0-9]+\\s*') THEN trim({x}->>'$') END AS BIGINT) END"""


def _field_int(side: str, field: str) -> str:
    return _INT.format(x=f"json_extract({side}, '$.{field}')")


_COUNTS = "(SELECT string_agg(k || '_delta=' || CAST(v AS VARCHAR), ',' ORDER BY k) FROM (SELECT k, coalesce(sum(n) FILTER (s = 1), 0) - coalesce(sum(n) FILTER (s = 0), 0) AS v FROM c WHERE c.stream IS NOT DISTINCT FROM j.stream AND c.id = j.id GROUP BY k))"


@query(f"""WITH t AS (SELECT stream, json_extract_string(raw_line, '$.id') AS id, raw_line, row_number() OVER (PARTITION BY stream, json_extract_string(raw_line, '$.id') ORDER BY file_stamp, line_no, line_id) AS n,
row_number() OVER (PARTITION BY stream, json_extract_string(raw_line, '$.id') ORDER BY file_stamp DESC, line_no DESC, line_id DESC) AS m FROM artifact_lines WHERE artifact = 'samples' AND json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' AND json_type(raw_line, '$.id') = 'VARCHAR'),
j AS (SELECT f.stream, f.id, CAST(f.raw_line AS JSON) AS x, CAST(l.raw_line AS JSON) AS y FROM t f JOIN t l ON f.stream = l.stream AND f.id = l.id AND f.n = 1 AND l.m = 1),
e AS (SELECT stream, id, 0 AS s, json_extract(x, '$.retry_summary') AS o FROM j UNION ALL SELECT stream, id, 1, json_extract(y, '$.retry_summary') FROM j),
k AS (SELECT stream, id, s, o, unnest(json_keys(o)) AS k FROM e WHERE json_type(o) = 'OBJECT'),
c AS (SELECT * FROM (SELECT stream, id, s, k, {_INT.format(x="json_extract(o, '$.' || k)")} AS n FROM k) WHERE n IS NOT NULL)
SELECT stream, id, CASE WHEN {_field_int('x', 'rescued_blocks')} IS NOT NULL OR {_field_int('y', 'rescued_blocks')} IS NOT NULL THEN coalesce({_field_int('y', 'rescued_blocks')}, 0) - coalesce({_field_int('x', 'rescued_blocks')}, 0) END AS rescued_blocks_delta,
coalesce({_COUNTS}, '') AS retry_summary FROM j""")
def compare_route_one(spark: SparkSession, d: str) -> DataFrame:
    """Retry counts of each record's last version against its first one, values that are no whole number left out."""
    t = table(spark, d, "artifact_lines").filter("artifact = 'samples'").withColumn("v", F.try_parse_json("raw_line"))
    t = t.filter(F.schema_of_variant("v").startswith("OBJECT")).withColumn("id", jsonl.typed(F.col("v"), "$.id", "string")).filter("id IS NOT NULL")
    at = F.struct("file_stamp", "line_no", "line_id")
    two = t.groupBy("stream", "id").agg(F.min_by("raw_line", at).alias("x"), F.max_by("raw_line", at).alias("y"))
    got = two.select("stream", "id", regress.route_one(F.try_parse_json("x"), F.try_parse_json("y")).alias("r"))
    said = F.array_join(F.array_sort(F.transform(F.map_entries("r.retry_summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return got.select("stream", "id", F.col("r.rescued_blocks_delta").alias("rescued_blocks_delta"), said.alias("retry_summary"))


_NEED = "z_score IS NULL OR p_value IS NULL OR is_watermarked IS NULL OR independent_blocks IS NULL OR hits IS NULL"
_SIDES = "sides AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.id, b.id) AS id, a.id IS NULL AS no_left, b.id IS NULL AS no_right FROM (SELECT DISTINCT run_id, id FROM details) a FULL JOIN (SELECT DISTINCT run_id, id FROM details_recheck) b ON a.run_id = b.run_id AND a.id = b.id)"


@query(_DELTA + f""", {_SIDES}, c AS (SELECT run_id, count(*) FILTER (no_left) = 0 AND count(*) FILTER (no_right) = 0 AS same_id_set, coalesce(string_agg(CASE WHEN no_left THEN id END, ',' ORDER BY id), '') AS missing_in_left, coalesce(string_agg(CASE WHEN no_right THEN id END, ',' ORDER BY id), '') AS missing_in_right FROM sides GROUP BY run_id),
m AS (SELECT run_id, sum(CASE WHEN {_NEED} THEN 1 ELSE 0 END) AS n_incomplete FROM (SELECT run_id, z_score, p_value, is_watermarked, independent_blocks, hits FROM a UNION ALL SELECT run_id, z_score, p_value, is_watermarked, independent_blocks, hits FROM b) GROUP BY run_id),
d AS (SELECT run_id, count(*) AS total_samples, coalesce(string_agg(CASE WHEN flip = 'lost' THEN id END, ',' ORDER BY id), '') AS detection_loss_ids, count(*) FILTER (flip = 'lost') AS n_detection_lost, count(*) FILTER (z < 0) AS n_z_score_drop, count(*) FILTER (n > 0 AND h <= 0) AS n_block_growth FROM j GROUP BY run_id),
s AS (SELECT run_id, id, arg_min(watermark_params, record_id) FILTER (watermark_params IS NOT NULL) AS x, arg_max(watermark_params, record_id) FILTER (watermark_params IS NOT NULL) AS y, arg_min(embed_rate, record_id) FILTER (embed_rate IS NOT NULL) AS u, arg_max(embed_rate, record_id) FILTER (embed_rate IS NOT NULL) AS v FROM samples GROUP BY ALL),
e AS (SELECT run_id, count(*) FILTER (x.lsh_d IS DISTINCT FROM y.lsh_d OR x.lsh_gamma IS DISTINCT FROM y.lsh_gamma OR x.margin_base IS DISTINCT FROM y.margin_base OR x.margin_alpha IS DISTINCT FROM y.margin_alpha) AS n_other_parameters, round(coalesce(avg(v - u), 0), 6) + 0 AS mean_embed_rate_delta FROM s GROUP BY run_id)
SELECT run_id, same_id_set, missing_in_left, missing_in_right, coalesce(n_incomplete, 0) = 0 AS comparable_details, CAST(coalesce(n_incomplete, 0) AS BIGINT) AS n_incomplete, coalesce(total_samples, 0) AS total_samples, coalesce(detection_loss_ids, '') AS detection_loss_ids, coalesce(n_detection_lost, 0) AS n_detection_lost, coalesce(n_z_score_drop, 0) AS n_z_score_drop, coalesce(n_block_growth, 0) AS n_block_growth,
coalesce(n_other_parameters, 0) AS n_other_parameters, coalesce(mean_embed_rate_delta, 0) AS mean_embed_rate_delta FROM c LEFT JOIN m USING (run_id) LEFT JOIN d USING (run_id) LEFT JOIN e USING (run_id)""")
def compare_run_report(spark: SparkSession, d: str) -> DataFrame:
    """A report a run: compatibility of the two results, what was lost, parameters and embedding between deliveries."""
    left, right, samples = (table(spark, d, n) for n in ("details", "details_recheck", "samples"))
    parts = samples.groupBy("run_id", "id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_id"))).alias(f"{c}_x") for c in ("watermark_params", "embed_rate")],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("record_id"))).alias(f"{c}_y") for c in ("watermark_params", "embed_rate")],
    )
    other = F.lit(False)
    for c in ("lsh_d", "lsh_gamma", "margin_base", "margin_alpha"):
        other = other | ~F.col(f"watermark_params_x.{c}").eqNullSafe(F.col(f"watermark_params_y.{c}"))
    e = parts.groupBy("run_id").agg(F.count_if(other).alias("n_other_parameters"), (F.round(F.coalesce(F.avg(F.col("embed_rate_y") - F.col("embed_rate_x")), F.lit(0.0)), 6) + F.lit(0.0)).alias("mean_embed_rate_delta"))
    return regress.report(left, right, ["run_id"], "id", "loaded_at").join(e, "run_id", "left").withColumns({"n_other_parameters": F.coalesce("n_other_parameters", F.lit(0)), "mean_embed_rate_delta": F.coalesce("mean_embed_rate_delta", F.lit(0.0))})


@query("""SELECT line_id, list_aggregate(list_sort(list_filter(json_keys(raw_line), lambda k: k IN ('diagnostics_version', 'retry_summary', 'cascade_summary', 'failure_reason_counts', 'rescued_blocks', 'unrescued_blocks'))), 'string_agg', ',') AS kept
FROM artifact_lines WHERE json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' AND artifact = 'samples' AND len(list_filter(json_keys(raw_line), lambda k: k IN ('diagnostics_version', 'retry_summary', 'cascade_summary', 'failure_reason_counts', 'rescued_blocks', 'unrescued_blocks'))) > 0""")
def project_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The diagnostic fields of each record, those of the allow-list alone."""
    t = table(spark, d, "artifact_lines").filter("artifact = 'samples'").filter(F.schema_of_variant(F.try_parse_json("raw_line")).startswith("OBJECT"))
    kept = jsonl.allowed(F.col("raw_line"), regress.DIAGNOSTICS)
    return t.select("line_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept")).filter("kept <> ''")


@query("""WITH c AS (SELECT s.record_id, max(d.z_score) FILTER (isfinite(d.z_score)) AS z FROM samples s LEFT JOIN details d ON d.run_id = s.run_id AND d.id = s.id GROUP BY s.record_id)
SELECT CAST(0.05 AS DOUBLE) AS fpr, round(coalesce(quantile_cont(z, 0.95), 0), 6) AS fpr_threshold, count(*) AS n_samples, count(z) AS n_scored FROM c""")
def agg_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The score that 5 % of the scored records exceed; the corpus counts as a whole, scored or not."""
    z = table(spark, d, "details").filter(F.abs("z_score") < float("inf")).groupBy("run_id", "id").agg(F.max("z_score").alias("z"))
    corpus = table(spark, d, "samples").select("record_id", "run_id", "id").join(z, ["run_id", "id"], "left")
    return cumulative.calibrate(corpus, "z", 0.05).select("fpr", r6(F.col("fpr_threshold"), "fpr_threshold"), "n_samples", "n_scored")


# Readers and writers: what is written to the shared folder is read back


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_FLAT = "record_id bigint, id string, total_blocks int, embed_rate double, blocks array<struct<ordinal:int,node_type:string>>"


@query("SELECT record_id, id, total_blocks, embed_rate, len(blocks) AS n_blocks FROM samples")
def sink_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written and read by the strict reader."""
    path = _place(spark, "jsonl")
    s = table(spark, d, "samples")
    jsonl.write_jsonl(s.select("record_id", "id", "total_blocks", "embed_rate", F.transform("blocks", lambda b: F.when(b.isNotNull(), F.struct(b["ordinal"].alias("ordinal"), b["node_type"].alias("node_type")))).alias("blocks")), path)
    got = jsonl.read_jsonl(spark, path, _FLAT)
    return got.select("record_id", "id", "total_blocks", "embed_rate", F.when(F.col("blocks").isNotNull(), F.size("blocks")).cast("long").alias("n_blocks"))


@query("SELECT record_id, id FROM negative_corpus")
def scan_unique(spark: SparkSession, d: str) -> DataFrame:
    """Records whose ids may not repeat, read from JSON lines."""
    path = _place(spark, "unique")
    jsonl.write_jsonl(table(spark, d, "negative_corpus").select("record_id", "id"), path)
    return jsonl.unique_ids(jsonl.read_jsonl(spark, path, "record_id bigint, id string"), "record_id")


@query("SELECT DISTINCT run_id, id FROM details")
def sink_append(spark: SparkSession, d: str) -> DataFrame:
    """The same keys appended twice, in two overlapping parts: the sink holds each once."""
    path = _place(spark, "append")
    k = table(spark, d, "details").select("run_id", "id")
    for part in (k.filter("id < 'M'"), k, k):
        jsonl.append_new(part, path, ["run_id", "id"])
    return spark.read.parquet(path)


@query("SELECT run_id, count(*) AS n, round(coalesce(avg(embed_rate), 0), 6) AS mean_rate FROM samples GROUP BY run_id")
def sink_document(spark: SparkSession, d: str) -> DataFrame:
    """A summary written as one JSON document and read as a whole file."""
    path = _place(spark, "document")
    s = table(spark, d, "samples").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("embed_rate"), F.lit(0.0)), 6).alias("mean_rate"))
    jsonl.write_document(s.agg(F.collect_list(F.struct("*")).alias("runs")), path)
    return jsonl.read_json(spark, path, "runs array<struct<run_id:string,n:bigint,mean_rate:double>>").select(F.inline("runs"))


@query("SELECT s.run_id, s.n AS n_samples, coalesce(l.n, 0) AS n_ledger FROM (SELECT run_id, count(*) AS n FROM samples GROUP BY run_id) s LEFT JOIN (SELECT run_id, count(*) AS n FROM ledger GROUP BY run_id) l USING (run_id)")
def sink_pair(spark: SparkSession, d: str) -> DataFrame:
    """An output and its sidecar, both read back."""
    a, b = _place(spark, "main"), _place(spark, "sidecar")
    jsonl.write_pair(table(spark, d, "samples").select("run_id", "record_id"), a, table(spark, d, "ledger").select("run_id", "ledger_id"), b)
    n = lambda p, name: spark.read.parquet(p).groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    return n(a, "n_samples").join(n(b, "n_ledger"), "run_id", "left").withColumn("n_ledger", F.coalesce("n_ledger", F.lit(0)))


@query("SELECT profile_id, language, sample_count FROM entropy_profile")
def scan_versioned(spark: SparkSession, d: str) -> DataFrame:
    """A document with a schema version and rows."""
    path = _place(spark, "versioned")
    rows = table(spark, d, "entropy_profile").select("profile_id", "language", "sample_count")
    jsonl.write_document(rows.agg(F.lit(3).alias("schema_version"), F.collect_list(F.struct("*")).alias("rows")), path)
    return jsonl.read_versioned(spark, path, "profile_id:string,language:string,sample_count:int", 3)


@query("SELECT count(*) AS n FROM details_recheck")
def scan_last_written(spark: SparkSession, d: str) -> DataFrame:
    """Of two files in a folder the one written last, found by its time and read."""
    folder = _place(spark, "runs")
    for n, name in enumerate(("details", "details_recheck")):
        t = table(spark, d, name).groupBy().agg(F.count(F.lit(1)).alias("n"))
        t.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{n}")
    newest = jsonl.latest_file(spark, f"{folder}/*/*.parquet").first()
    return spark.read.parquet(newest.path).select("n")


_GIVEN = "generated_code IS NOT NULL AND length(trim(regexp_replace(generated_code, '\\s', '', 'g'))) > 0"


@query(f"SELECT CASE WHEN record_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, id AS task_id, CASE WHEN dataset = 'humaneval' THEN coalesce(prompt, '') || generated_code ELSE generated_code END AS source FROM negative_corpus WHERE {_GIVEN}")
def scan_splits(spark: SparkSession, d: str) -> DataFrame:
    """A data set of two splits, read as one table of whole reference solutions."""
    folder = _place(spark, "splits")
    t = table(spark, d, "negative_corpus").filter("length(trim(regexp_replace(generated_code, '\\\\s', ''))) > 0")
    for name, part in (("test", t.filter("record_id % 5 = 0")), ("train", t.filter("record_id % 5 <> 0").withColumn("extra", F.lit(1)))):
        part.select("id", "dataset", "prompt", "generated_code", *[c for c in part.columns if c == "extra"]).write.parquet(f"{folder}/{name}")
    got = load_splits(spark, folder, {"task_id": "id", "dataset": "dataset", "prompt": "prompt", "solution": "generated_code"})
    return got.select("split", "task_id", normal_source(F.col("dataset"), F.col("prompt"), F.col("solution")).alias("source"))
