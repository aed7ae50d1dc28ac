"""Queries of scans, projections and aggregates over the audit tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import stats
from quarrylens.operators import cumulative, lifecycle, rank, relate
from quarrylens.sources import jsonl
from quarrylens.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Scans


@query("""SELECT line_id, json_extract_string(raw_line, '$.id') AS id, try_cast(json_extract(raw_line, '$.total_blocks') AS BIGINT) AS total_blocks
FROM artifact_lines WHERE json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' AND artifact = 'samples' AND coalesce(json_type(raw_line, '$.total_blocks'), 'NULL') IN ('NULL', 'UBIGINT', 'BIGINT')""")
def scan_records(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("raw_line")
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.total_blocks", "variant")), F.lit("VOID"))
    t = table(spark, d, "artifact_lines").filter("artifact = 'samples'").filter(F.schema_of_variant(v).startswith("OBJECT"))
    return t.filter(kind.isin("VOID", "BIGINT")).select("line_id", F.get_json_object("raw_line", "$.id").alias("id"), F.try_variant_get(v, "$.total_blocks", "bigint").alias("total_blocks"))


@query("""WITH s AS (SELECT CASE WHEN raw_line IS NULL OR trim(raw_line, E' \\t\\n\\r') = '' THEN 'blank' WHEN NOT json_valid(raw_line) THEN 'malformed' WHEN json_type(raw_line) <> 'OBJECT' THEN 'malformed'
WHEN json_type(raw_line, '$.id') = 'VARCHAR' AND trim(json_extract_string(raw_line, '$.id')) <> '' THEN 'ok' ELSE 'no_id' END AS state, file_name FROM artifact_lines)
SELECT file_name, state, count(*) AS n FROM s GROUP BY ALL""")
def scan_tolerant_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact_lines").groupBy("file_name", jsonl.id_state(F.col("raw_line")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT json_extract_string(raw_line, '$.id') AS id FROM artifact_lines WHERE json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' AND json_type(raw_line, '$.id') = 'VARCHAR' AND trim(json_extract_string(raw_line, '$.id')) <> ''")
def scan_tolerant_ids(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.tolerant_ids(table(spark, d, "artifact_lines"), "raw_line")


@query("""SELECT doc_id, i - 1 AS line_no, CAST(regexp_extract(l, 'z=(-?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS value
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, 'z=(-?\\d+(?:\\.\\d+)?)')""")
def scan_log_values(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    return jsonl.log_values(lines, "l", r"z=(-?\d+(?:\.\d+)?)").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value")


@query("SELECT artifact, stream, arg_max(file_name, (file_stamp, file_name)) AS file_name FROM artifact_lines GROUP BY ALL")
def scan_latest_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact_lines").groupBy("artifact", "stream").agg(F.max_by("file_name", F.struct("file_stamp", "file_name")).alias("file_name"))


@query("SELECT record_id, run_id, total_blocks FROM samples WHERE id = 'HumanEval/564'")
def scan_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").filter("id = 'HumanEval/564'").select("record_id", "run_id", "total_blocks")


@query("SELECT id, dataset, generated_code FROM samples UNION ALL SELECT id, dataset, generated_code FROM negative_corpus")
def scan_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("id", "dataset", "generated_code").unionByName(table(spark, d, "negative_corpus").select("id", "dataset", "generated_code"), allowMissingColumns=True)


# Projections and filters


@query("SELECT run_id, id, z_score FROM details WHERE contract_valid IS DISTINCT FROM FALSE")
def project_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "details").filter("contract_valid IS DISTINCT FROM false").select("run_id", "id", "z_score")


_SCORE = "CASE mode WHEN 'lexical' THEN lexical_z_score WHEN 'dual' THEN joint_score ELSE z_score END"


@query(f"SELECT run_id, id, mode, {_SCORE} AS score FROM details WHERE {_SCORE} IS NOT NULL")
def project_mode_score(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("mode") == "lexical", F.col("lexical_z_score")).when(F.col("mode") == "dual", F.col("joint_score")).otherwise(F.col("z_score"))
    return table(spark, d, "details").select("run_id", "id", "mode", s.alias("score")).filter("score IS NOT NULL")


@query("SELECT record_id, round(CASE WHEN total_blocks = 0 THEN 0.0 ELSE embedded_blocks / total_blocks END, 6) AS rate FROM samples")
def project_embed_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("record_id", r6(stats.ratio_or_zero("embedded_blocks", "total_blocks"), "rate"))


@query("SELECT record_id, 'prompt:' || substr(sha256(prompt), 1, 16) AS sample_id, sha256(generated_code) AS code_hash FROM samples")
def project_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("record_id", F.concat(F.lit("prompt:"), F.substring(F.sha2("prompt", 256), 1, 16)).alias("sample_id"), F.sha2("generated_code", 256).alias("code_hash"))


@query("SELECT record_id, CASE WHEN dataset = 'humaneval' THEN prompt || generated_code ELSE generated_code END AS source FROM negative_corpus")
def project_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "negative_corpus").select("record_id", F.when(F.col("dataset") == "humaneval", F.concat("prompt", "generated_code")).otherwise(F.col("generated_code")).alias("source"))


@query("""SELECT run_id, id, i - 1 AS place, m.field, m.embedded, m.rebuilt FROM (SELECT run_id, id, unnest(contract_alignment.structure_mismatches) AS m, generate_subscripts(contract_alignment.structure_mismatches, 1) AS i FROM details)
WHERE m IS NOT NULL ORDER BY run_id, id, i, m.field, m.embedded, m.rebuilt LIMIT 5""")
def project_first_mismatches(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "details").select("run_id", "id", F.posexplode("contract_alignment.structure_mismatches").alias("place", "m")).filter("m IS NOT NULL")
    out = m.select("run_id", "id", F.col("place").cast("long").alias("place"), "m.field", "m.embedded", "m.rebuilt")
    return out.orderBy("run_id", "id", "place", *[F.col(c).asc_nulls_last() for c in ("field", "embedded", "rebuilt")]).limit(5)


# Aggregates

_VALID = "contract_valid IS DISTINCT FROM FALSE"


@query(f"""SELECT run_id, count(*) AS n, round(coalesce(avg(CASE WHEN semantic_prediction THEN 1.0 ELSE 0.0 END), 0), 6) AS rate,
round(coalesce(avg(CASE WHEN isfinite(z_score) THEN z_score END), 0), 6) AS mean_z, round(coalesce(stddev_samp(CASE WHEN isfinite(z_score) THEN z_score END), 0), 6) AS std_z,
round(coalesce(avg(p_value), 0), 6) AS mean_p, round(coalesce(avg(independent_blocks), 0), 6) AS mean_blocks FROM details WHERE {_VALID} GROUP BY run_id""")
def agg_summary(spark: SparkSession, d: str) -> DataFrame:
    z = F.when(F.abs("z_score") < float("inf"), F.col("z_score"))
    t = table(spark, d, "details").filter("contract_valid IS DISTINCT FROM false")
    rate = F.coalesce(F.avg(F.when(F.col("semantic_prediction"), 1.0).otherwise(0.0)), F.lit(0.0))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), r6(rate, "rate"), r6(stats.mean_or_zero(z), "mean_z"), r6(stats.std_or_zero(z), "std_z"), r6(stats.mean_or_zero("p_value"), "mean_p"), r6(stats.mean_or_zero("independent_blocks"), "mean_blocks"))


@query("SELECT dataset, count(embed_rate) AS n, round(quantile_cont(embed_rate, 0.25), 6) AS p25, round(quantile_cont(embed_rate, 0.5), 6) AS p50, round(quantile_cont(embed_rate, 0.75), 6) AS p75 FROM samples WHERE embed_rate IS NOT NULL GROUP BY dataset")
def agg_embed_rate_distribution(spark: SparkSession, d: str) -> DataFrame:
    got = cumulative.linear_percentiles(table(spark, d, "samples"), ["dataset"], "embed_rate", [0.25, 0.5, 0.75])
    return got.select("dataset", "n", *[r6(F.col(p), p) for p in ("p25", "p50", "p75")])


@query("SELECT mode, count(z_score) AS n, round(quantile_cont(z_score, 0.99), 6) AS p99, round(quantile_cont(z_score, 0.95), 6) AS p95 FROM details WHERE isfinite(z_score) GROUP BY mode")
def agg_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The score that a share of 1 % and of 5 % of the rows exceeds: the threshold of a false-positive rate."""
    got = cumulative.linear_percentiles(table(spark, d, "details").filter(F.abs("z_score") < float("inf")), ["mode"], "z_score", [0.99, 0.95])
    return got.select("mode", "n", r6(F.col("p99"), "p99"), r6(F.col("p95"), "p95"))


@query("SELECT profile_id, count(*) AS n, quantile_disc(entropy_units, 0.1) AS p10, quantile_disc(entropy_units, 0.5) AS p50, quantile_disc(entropy_units, 0.75) AS p75, quantile_disc(entropy_units, 0.9) AS p90, quantile_disc(entropy_units, 0.95) AS p95 FROM blocks WHERE entropy_units >= 0 GROUP BY profile_id")
def agg_profile(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank quantiles of all block entropies, as an entropy profile holds them."""
    return cumulative.nearest_rank(table(spark, d, "blocks").filter("entropy_units >= 0"), ["profile_id"], "entropy_units", [0.1, 0.5, 0.75, 0.9, 0.95])


@query("""WITH c AS (SELECT run_id, count(*) AS n, count(*) FILTER (semantic_prediction) AS k FROM details GROUP BY run_id), p AS (SELECT *, k / n AS p FROM c)
SELECT run_id, k, n, round(greatest((p + 1.96*1.96/(2*n))/(1+1.96*1.96/n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))/(1+1.96*1.96/n), 0), 6) AS low,
round(least((p + 1.96*1.96/(2*n))/(1+1.96*1.96/n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))/(1+1.96*1.96/n), 1), 6) AS high FROM p""")
def agg_wilson(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "details").groupBy("run_id").agg(F.count_if("semantic_prediction").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("run_id", "k", "n", low.alias("low"), high.alias("high"))


@query("SELECT coalesce(mode, 'fixed') AS mode, count(*) AS n, count(*) FILTER (contract_alignment.structure_mismatch) AS structure, count(*) FILTER (contract_alignment.numeric_mismatch AND contract_alignment.structure_mismatch IS DISTINCT FROM TRUE) AS numeric FROM details GROUP BY 1")
def agg_reasons(spark: SparkSession, d: str) -> DataFrame:
    s, m = F.coalesce("contract_alignment.structure_mismatch", F.lit(False)), F.coalesce("contract_alignment.numeric_mismatch", F.lit(False))
    return table(spark, d, "details").groupBy(F.coalesce("mode", F.lit("fixed")).alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.count_if(s).alias("structure"), F.count_if(m & ~s).alias("numeric"))


@query("""WITH t AS (SELECT id, count(*) AS n, count(*) FILTER (is_watermarked) AS c FROM details GROUP BY id),
k AS (SELECT unnest([1, 2, 10]) AS k), v AS (SELECT k, CASE WHEN n - c < least(k, n) THEN 1.0 ELSE 1.0 - list_product(list_transform(range(1, CAST(least(k, n) AS BIGINT) + 1), lambda i: (n - c - i + 1) / (n - i + 1))) END AS v FROM t, k)
SELECT k, round(avg(v), 6) AS pass_at_k FROM v GROUP BY k""")
def agg_pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are the results of one task, correct those that carry the mark."""
    t = table(spark, d, "details").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_watermarked").alias("c"))
    one = t.agg(*[F.round(F.avg(stats.pass_at_k(F.col("n"), F.col("c"), k)), 6).alias(f"k{k}") for k in (1, 2, 10)])
    return one.select(F.expr("stack(3, 1, k1, 2, k2, 10, k10) AS (k, pass_at_k)"))


@query("""WITH s AS (SELECT z_score AS s, count(*) FILTER (is_watermarked) AS pos, count(*) FILTER (is_watermarked IS DISTINCT FROM TRUE) AS neg FROM details WHERE z_score IS NOT NULL GROUP BY 1),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(CAST(sum(pos * (b + neg / 2)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM w""")
def agg_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rank.roc_auc(table(spark, d, "details"), "z_score", "is_watermarked").select("n_pos", "n_neg", r6(F.col("auc"), "auc"))


@query("""WITH s AS (SELECT z_score AS s, count(*) FILTER (is_watermarked) AS pos, count(*) FILTER (is_watermarked IS DISTINCT FROM TRUE) AS neg FROM details WHERE z_score IS NOT NULL GROUP BY 1),
w AS (SELECT sum(pos) OVER (ORDER BY s DESC) / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY s DESC) / sum(neg) OVER () AS fpr FROM s)
SELECT round(coalesce(max(tpr) FILTER (fpr <= 0.05), 0), 6) AS tpr FROM w""")
def agg_tpr_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    return rank.tpr_at_fpr(table(spark, d, "details"), "z_score", "is_watermarked", 0.05).select(r6(F.col("tpr"), "tpr"))


@query("""WITH d AS (SELECT z_score AS s, coalesce(is_watermarked, FALSE) AS y FROM details WHERE z_score IS NOT NULL), t AS (SELECT i, 0.0 + i * (4.0 / 99) AS th FROM range(100) r(i)),
c AS (SELECT i, th, count(*) FILTER (y AND s >= th - 1e-10) AS tp, count(*) FILTER (NOT y AND s >= th - 1e-10) AS fp, (SELECT count(*) FROM d WHERE y) AS p FROM t, d GROUP BY i, th),
m AS (SELECT *, tp / (tp + fp + 1e-8) AS pr, tp / (p + 1e-8) AS re FROM c), f AS (SELECT *, 2 * pr * re / (pr + re + 1e-8) AS f1 FROM m)
SELECT round(th, 6) AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, i LIMIT 1""")
def agg_best_f1(spark: SparkSession, d: str) -> DataFrame:
    got = rank.best_f1(table(spark, d, "details"), "z_score", "is_watermarked", 0.0, 4.0)
    return got.select(*[r6(F.col(c), c) for c in got.columns])


@query("SELECT run_id, round(CASE WHEN coalesce(sum(total_blocks), 0) = 0 THEN 0 ELSE coalesce(sum(retry_summary.attempts_total), 0) / sum(total_blocks) END, 6) AS retry_rate FROM samples GROUP BY run_id")
def agg_retry_rate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "samples").groupBy("run_id").agg(F.coalesce(F.sum("retry_summary.attempts_total"), F.lit(0)).alias("a"), F.coalesce(F.sum("total_blocks"), F.lit(0)).alias("b"))
    return t.select("run_id", r6(stats.ratio_or_zero("a", "b"), "retry_rate"))


_REASON = "CASE WHEN {r} IN ('signature_miss', 'margin_miss', 'no_block_generated', 'unknown') THEN {r} WHEN {r} IS NOT NULL THEN 'unknown' END"


@query(f"""WITH r AS (SELECT run_id, initial_verify.failure_reason AS r FROM ledger UNION ALL SELECT run_id, final_outcome.failure_reason FROM ledger
UNION ALL SELECT run_id, e.failure_reason FROM (SELECT run_id, unnest(retry_attempts) AS e FROM ledger)) SELECT run_id, {_REASON.format(r="r")} AS reason, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY ALL""")
def agg_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.reason_histogram(table(spark, d, "ledger"), ["run_id"])


@query("""WITH l AS (SELECT run_id, sample_id, list_filter(coalesce(retry_attempts, []), lambda a: a IS NOT NULL) AS t, final_outcome AS f FROM ledger)
SELECT run_id, sample_id, count(*) AS blocks, count(*) FILTER (len(t) > 0) AS blocks_with_retry, CAST(sum(len(t)) AS BIGINT) AS attempts_total,
CAST(sum(len(list_filter(t, lambda a: NOT coalesce(a.produced_block, FALSE)))) AS BIGINT) AS attempts_no_block, count(*) FILTER (f.rescued_by_retry) AS retry_rescued, count(*) FILTER (f.exhausted_retries) AS retry_exhausted,
count(*) FILTER (f.rescued_by_cascade) AS cascade_rescued, count(*) FILTER (coalesce(f.rescued_by_retry, FALSE) OR coalesce(f.rescued_by_cascade, FALSE)) AS rescued FROM l GROUP BY ALL""")
def agg_retries(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.retries(table(spark, d, "ledger"), ["run_id", "sample_id"])


@query("""WITH e AS (SELECT run_id, sample_id, unnest(cascade_events) AS e FROM ledger), o AS (SELECT run_id, sample_id, coalesce(e.rollback_id, CAST(e AS VARCHAR)) AS i, bool_or(coalesce(e.triggered, FALSE)) AS t, bool_or(e.rollback_id IS NOT NULL) AS r FROM e WHERE e IS NOT NULL GROUP BY ALL)
SELECT run_id, sample_id, count(*) FILTER (t) AS triggers, count(*) FILTER (r) AS rollbacks FROM o GROUP BY ALL""")
def agg_cascades(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cascades(table(spark, d, "ledger"), ["run_id", "sample_id"])


_LATEST = "(SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY loaded_at DESC NULLS LAST, record_id DESC) = 1)"


@query(f"""WITH s AS {_LATEST}, w AS (SELECT run_id, id, coalesce(CASE WHEN alignment_summary.final_block_count > 0 THEN alignment_summary.final_block_count END, len(blocks), total_blocks) AS expected FROM s),
l AS (SELECT run_id, sample_id AS id, block_ordinal AS o, count(*) AS n FROM ledger GROUP BY ALL),
g AS (SELECT l.run_id, l.id, max(expected) AS expected, list(DISTINCT o) FILTER (o IS NOT NULL) AS got, list_sort(list(o) FILTER (n > 1 AND o IS NOT NULL)) AS repeated FROM l JOIN w USING (run_id, id) GROUP BY ALL)
SELECT run_id, id, CAST(expected AS INTEGER) AS expected, len(list_filter(range(CAST(expected AS BIGINT)), lambda x: NOT list_contains(coalesce(got, []), x))) AS n_missing, len(list_filter(coalesce(got, []), lambda x: x < 0 OR x >= expected)) AS n_outside, coalesce(len(repeated), 0) AS n_repeated FROM g WHERE expected IS NOT NULL""")
def agg_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """How far the ledger's ordinals cover each sample's expected blocks, by the last delivery of the sample."""
    expected = F.coalesce(F.when(F.col("alignment_summary.final_block_count") > 0, F.col("alignment_summary.final_block_count")), F.when(F.col("blocks").isNotNull(), F.size("blocks")), F.col("total_blocks"))
    s = relate.last_by(table(spark, d, "samples").select("run_id", "id", expected.alias("expected"), "loaded_at", "record_id"), ["run_id", "id"], "loaded_at", "record_id")
    rows = table(spark, d, "ledger").select("run_id", F.col("sample_id").alias("id"), "block_ordinal").join(s.select("run_id", "id", "expected").filter("expected IS NOT NULL"), ["run_id", "id"])
    got = relate.ordinal_report(rows, ["run_id", "id"], "block_ordinal", F.max("expected"))
    long = lambda c, n: F.size(c).cast("long").alias(n)
    return got.select("run_id", "id", "expected", F.col("n_missing").cast("long").alias("n_missing"), long("out_of_range", "n_outside"), long("repeated", "n_repeated"))


@query("""WITH b AS (SELECT run_id, id, unnest(blocks) AS b FROM samples), g AS (SELECT run_id, id, sum(b.gamma_effective) AS mu, sum(b.gamma_effective * (1 - b.gamma_effective)) AS v, count(*) AS m FROM b WHERE b IS NOT NULL AND b.gamma_effective IS NOT NULL GROUP BY ALL),
h AS (SELECT run_id, id, sum(embedded_blocks) AS hits FROM samples GROUP BY ALL) SELECT run_id, id, m, round(mu, 6) AS expected, round(CASE WHEN v > 1e-12 THEN (hits - mu) / sqrt(v) WHEN abs(hits - mu) < 1e-9 THEN 0 WHEN hits > mu THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END, 6) AS z FROM g JOIN h USING (run_id, id) WHERE hits IS NOT NULL""")
def agg_z_scores(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive z-score of each sample: hits against the sum of its blocks' gammas."""
    s = table(spark, d, "samples")
    b = s.select("run_id", "id", F.explode("blocks").alias("b")).select("run_id", "id", F.col("b.gamma_effective").alias("g")).filter("g IS NOT NULL")
    g = b.groupBy("run_id", "id").agg(F.sum("g").alias("mu"), F.sum(F.col("g") * (1 - F.col("g"))).alias("v"), F.count(F.lit(1)).alias("m"))
    h = s.groupBy("run_id", "id").agg(F.sum("embedded_blocks").alias("hits")).filter("hits IS NOT NULL")
    v = F.when(F.col("v") > 1e-12, F.col("v")).otherwise(F.lit(0.0))
    hits = F.when(F.abs(F.col("hits") - F.col("mu")) < 1e-9, F.col("mu")).otherwise(F.col("hits"))
    return g.join(h, ["run_id", "id"]).select("run_id", "id", "m", r6(F.col("mu"), "expected"), r6(stats.z_score(hits, F.col("mu"), v), "z"))


# The tail as a series, which converges within 120 terms up to |z| = 10; beyond it the tail is below 1e-23.
_TAIL = """CASE WHEN isnan(z_score) THEN NULL WHEN z_score > 10 THEN 0 WHEN z_score < -10 THEN 1 WHEN z_score = 0 THEN 0.5
ELSE 0.5 - sign(z_score) * list_sum(list_transform(range(120), lambda n: exp((2 * n + 1) * ln(abs(z_score)) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1) - z_score * z_score / 2))) / sqrt(2 * pi()) END"""


@query(f"SELECT run_id, id, z_score, p_value, round({_TAIL}, 6) + 0 AS tail FROM details")
def agg_p_values(spark: SparkSession, d: str) -> DataFrame:
    """The normal tail of each z-score beside the stored p-value."""
    return table(spark, d, "details").select("run_id", "id", "z_score", "p_value", r6(stats.normal_sf("z_score"), "tail"))


@query("""WITH c AS (SELECT id, node_type, count(*) AS c FROM blocks GROUP BY ALL), s AS (SELECT id, c / sum(c) OVER (PARTITION BY id) AS p FROM c) SELECT id, round(0 - sum(p * log2(p)), 6) AS bits FROM s GROUP BY id""")
def agg_entropy_bits(spark: SparkSession, d: str) -> DataFrame:
    """Shannon entropy of the node types of each task."""
    from pyspark.sql import Window as W

    c = table(spark, d, "blocks").groupBy("id", "node_type").agg(F.count(F.lit(1)).alias("c"))
    # one row a node type and task
    s = c.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy("id")))
    return s.groupBy("id").agg(r6(stats.shannon_bits(F.col("p")), "bits"))


@query("SELECT node_type, count(*) AS n, count(entropy_units) AS n_known, round(coalesce(avg(entropy_units), 0), 6) AS mean, round(coalesce(stddev_samp(entropy_units), 0), 4) AS std FROM blocks WHERE entropy_units IS DISTINCT FROM -1 GROUP BY node_type")
def agg_by_node_type(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "blocks").filter("entropy_units IS DISTINCT FROM -1")
    return t.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.count("entropy_units").alias("n_known"), r6(stats.mean_or_zero("entropy_units"), "mean"), F.round(stats.std_or_zero("entropy_units"), 4).alias("std"))


@query("SELECT run_id, sample_id, count(DISTINCT block_text_hash) AS texts, count(DISTINCT node_type) AS node_types FROM ledger GROUP BY ALL")
def agg_diversity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").groupBy("run_id", "sample_id").agg(F.count_distinct("block_text_hash").alias("texts"), F.count_distinct("node_type").alias("node_types"))


@query("""WITH m AS (SELECT is_watermarked AS label, coalesce(mode, 'fixed') AS mode, avg(CASE WHEN isfinite(z_score) THEN z_score END) AS z, avg(hits) AS h FROM details GROUP BY ALL)
SELECT a.label, a.mode, round(a.z, 6) AS mean_z, round(a.h, 6) AS mean_hits, round(a.z - b.z, 6) AS z_delta, round(a.h - b.h, 6) AS hits_delta FROM m a LEFT JOIN m b ON a.label IS NOT DISTINCT FROM b.label AND b.mode = 'fixed'""")
def agg_mode_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Means by label and mode, and their distance from the mode 'fixed'."""
    z = F.when(F.abs("z_score") < float("inf"), F.col("z_score"))
    m = table(spark, d, "details").groupBy(F.col("is_watermarked").alias("label"), F.coalesce("mode", F.lit("fixed")).alias("mode")).agg(F.avg(z).alias("z"), F.avg("hits").alias("h"))
    b = m.filter("mode = 'fixed'").select(F.col("label").alias("l"), F.col("z").alias("bz"), F.col("h").alias("bh"))
    return m.join(b, m.label.eqNullSafe(b.l), "left").select("label", "mode", r6(F.col("z"), "mean_z"), r6(F.col("h"), "mean_hits"), r6(F.col("z") - F.col("bz"), "z_delta"), r6(F.col("h") - F.col("bh"), "hits_delta"))


@query("""WITH s AS (SELECT run_id, avg(total_blocks) AS m FROM samples GROUP BY run_id), b AS (SELECT min(run_id) AS r FROM samples)
SELECT s.run_id, round(s.m, 6) AS mean_blocks, round(CASE WHEN x.m <> 0 THEN (s.m - x.m) / x.m WHEN s.m = 0 THEN 0 ELSE 'inf'::DOUBLE END, 6) AS delta FROM s, b JOIN s x ON x.run_id = b.r""")
def agg_relative_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each run's mean number of blocks against that of the first run."""
    s = table(spark, d, "samples").groupBy("run_id").agg(F.avg("total_blocks").alias("m"))
    base = s.agg(F.min_by("m", "run_id")).scalar()
    return s.select("run_id", "m", base.alias("x")).select("run_id", r6(F.col("m"), "mean_blocks"), r6(stats.relative_delta(F.col("m"), F.col("x")), "delta"))


@query("SELECT run_id, id, round(z_score + 0.5 * least(1.0, num_positions_scored / 16.0) * lexical_z_score, 6) AS joint FROM details WHERE lexical_z_score IS NOT NULL AND isfinite(z_score) AND num_positions_scored IS NOT NULL")
def agg_joint_score(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "details").filter((F.abs("z_score") < float("inf")) & F.col("lexical_z_score").isNotNull() & F.col("num_positions_scored").isNotNull())
    return t.select("run_id", "id", r6(stats.fuse(F.col("z_score"), F.col("lexical_z_score"), F.col("num_positions_scored"), 16), "joint"))


@query("SELECT run_id, id, round(CASE WHEN num_positions_scored > 0 THEN (num_green_hits - num_positions_scored / 2) / sqrt(num_positions_scored / 4) ELSE 0 END, 6) AS z FROM details WHERE num_positions_scored IS NOT NULL")
def agg_lexical_z(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("num_positions_scored")
    return table(spark, d, "details").filter(n.isNotNull()).select("run_id", "id", r6(F.when(n > 0, stats.z_score(F.col("num_green_hits"), n / 2, n / 4)).otherwise(F.lit(0.0)), "z"))
