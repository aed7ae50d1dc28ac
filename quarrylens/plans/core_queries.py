"""The pN_ queries of the general problems (3, 4 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import diff, drift, shred
from quarrylens.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.places(table(spark, d, "samples"), table(spark, d, "ledger"))


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred(table(spark, d, "samples"), "record_id", "blocks").drop("ordinals")


def p3_retry_attempts(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred(table(spark, d, "ledger"), "ledger_id", "retry_attempts").drop("ordinals")


def p3_cascade_events(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred(table(spark, d, "ledger"), "ledger_id", "cascade_events").drop("ordinals")


def p3_replaced_block_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred(table(spark, d, "ledger"), "ledger_id", "cascade_events[].replaced_block_ordinals").drop("ordinals")


def p3_samples(spark: SparkSession, d: str) -> DataFrame:
    """The parent table: one row a delivered sample, with its plain fields and those of its structs."""
    return shred.shred_all(table(spark, d, "samples"), "record_id", tables=[""]).table("")


def p3_failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """A map as a table of keys and values."""
    return shred.shred(table(spark, d, "samples"), "record_id", "failure_reason_counts{}").select("record_id", "key", "value")


def p3_anchors(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred(table(spark, d, "samples"), "record_id", "watermark_params.adaptive_gamma.anchors{}").select("record_id", "key", "value")


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each table of samples and ledger has, all of them made in one pass over each."""
    got = [shred.shred_all(table(spark, d, t), k, values=False).rows.select(F.lit(t).alias("source"), "child") for t, k in (("samples", "record_id"), ("ledger", "ledger_id"))]
    return got[0].unionByName(got[1]).groupBy("source", "child").agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "artifact_lines")).select("file_name", "change", "field_path", "old_path")


def p4_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return drift.catalogue(table(spark, d, "artifact_lines"))


def _one_table(artifact: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        lines = table(spark, d, "artifact_lines").filter(F.col("artifact") == artifact)
        foot = drift.footers(lines, ["artifact", "stream", "file_name", "file_stamp"], "raw_line", shapes=True)
        return drift.consistent(lines, drift.changes(lines), foot, ["line_id", "file_name"])

    return run


def _fields(artifact: str, names: dict[str, str]):
    """Some fields of the consistent table under fixed names, each from the column that took its path."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = _one_table(artifact)(spark, d)
        have = {p: f for f in t.schema.fields for p in f.metadata.get("paths", [])}
        return t.select("line_id", *[(F.col(f"`{have[p].name}`") if p in have else F.lit(None)).cast(k).alias(p.rpartition(".")[2]) for p, k in names.items()])

    return run


p4_sample_fields = _fields("samples", {"total_blocks": "double", "embedded_blocks": "double", "embed_rate": "double", "alignment_summary.final_block_count": "double"})
p4_detail_fields = _fields("details", {"z_score": "double", "p_value": "double", "hits": "double", "mode": "string", "is_watermarked": "boolean"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_differences(spark, d).select("run_id", "id", "field")


def p6_differences(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_tables(table(spark, d, "details"), table(spark, d, "details_recheck"), ["run_id", "id"], latest="loaded_at", missing=("missing_in_recheck", "missing_in_details"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return p6_differences(spark, d).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def p6_keys(spark: SparkSession, d: str) -> DataFrame:
    """How many differences each key has."""
    return p6_differences(spark, d).groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("n_fields"))


QUERIES = {
    "p3_found": p3_found,
    "p3_blocks": p3_blocks,
    "p3_retry_attempts": p3_retry_attempts,
    "p3_cascade_events": p3_cascade_events,
    "p3_replaced_block_ordinals": p3_replaced_block_ordinals,
    "p3_samples": p3_samples,
    "p3_failure_reasons": p3_failure_reasons,
    "p3_anchors": p3_anchors,
    "p3_tables": p3_tables,
    "p4_found": p4_found,
    "p4_lifespans": p4_lifespans,
    "p4_samples": _one_table("samples"),
    "p4_details": _one_table("details"),
    "p4_sample_fields": p4_sample_fields,
    "p4_detail_fields": p4_detail_fields,
    "p6_found": p6_found,
    "p6_differences": p6_differences,
    "p6_summary": p6_summary,
    "p6_keys": p6_keys,
}


def _element(t: str, key: str, arr: str, fields: str) -> str:
    return f"""
SELECT {key}, CAST(-1 AS INTEGER) AS parent_pos, CAST(i - 1 AS INTEGER) AS pos, {fields}
FROM (SELECT {key}, unnest({arr}) AS e, generate_subscripts({arr}, 1) AS i FROM {t}) WHERE e IS NOT NULL"""


_RBO = """
SELECT ledger_id, CAST(pi - 1 AS INTEGER) AS parent_pos, CAST(i - 1 AS INTEGER) AS pos, v AS "value"
FROM (SELECT ledger_id, pi, unnest(e.replaced_block_ordinals) AS v, generate_subscripts(e.replaced_block_ordinals, 1) AS i
      FROM (SELECT ledger_id, unnest(cascade_events) AS e, generate_subscripts(cascade_events, 1) AS pi FROM ledger))
WHERE v IS NOT NULL"""

_MAP = "FROM (SELECT record_id, unnest(map_entries({m})) AS e FROM samples)"
_SAMPLE = ", ".join(
    "record_id run_id id dataset repo file_path language code_form prompt generated_code adaptive_mode profile_id total_blocks embedded_blocks failed_blocks fallback_blocks embed_rate loaded_at".split()
    + [f"{s}.{f} AS {s.replace('.', '_')}_{f}" for s, fs in (("alignment_summary", "final_block_count generator_total_blocks block_count_matches_total_blocks"), ("retry_summary", "blocks_with_retry attempts_total attempts_no_block retry_rescued_blocks retry_exhausted_blocks"), ("watermark_params", "lsh_d lsh_gamma margin_base margin_alpha"), ("watermark_params.adaptive_gamma", "strategy profile_id")) for f in fs.split()]
)
_BLOCK = "ordinal block_id node_type parent_node_type block_text_hash start_line end_line entropy_units gamma_target k gamma_effective".split()
_EVENT = "triggered compound_node_type failed_simple_count_before_cascade restored_total_blocks restored_embedded_blocks restored_failed_blocks rollback_id".split()
_TRY = "attempt_index produced_block failure_reason".split()


def _es(names: list[str]) -> str:
    return ", ".join(f"e.{n} AS {n}" for n in names)


def _gathered(artifact: str, fields: dict[str, tuple[str, list[str]]]) -> str:
    """Each field from all the names that its renames link, out of [x], {value: x} and texts."""
    plain = lambda p: f"coalesce(json_extract_string(raw_line, '$.{p}.value'), json_extract_string(raw_line, '$.{p}[0]'), json_extract_string(raw_line, '$.{p}'))"
    cols = ", ".join(f"try_cast(coalesce({', '.join(map(plain, ps))}) AS {k}) AS {n}" for n, (k, ps) in fields.items())
    return f"SELECT line_id, {cols} FROM artifact_lines WHERE artifact = '{artifact}' AND json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'"


_LIFESPANS = """
WITH RECURSIVE w AS (
  SELECT line_id, '' AS path, CAST(raw_line AS JSON) AS v FROM artifact_lines WHERE json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'
  UNION ALL
  SELECT line_id, e.p, e.x FROM (SELECT line_id, unnest(CASE json_type(v)
    WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'p': CASE WHEN path = '' THEN k ELSE path || '.' || k END, 'x': json_extract(v, '$."' || k || '"')})
    WHEN 'ARRAY' THEN list_filter(list_transform(json_extract(v, '$[*]'), lambda x: {'p': path || '[]', 'x': x}), lambda y: json_type(y.x) = 'OBJECT') ELSE [] END) AS e FROM w)),
f AS (SELECT artifact, stream, file_name, row_number() OVER (PARTITION BY artifact, stream ORDER BY file_stamp NULLS FIRST, file_name) AS seq, count(*) OVER (PARTITION BY artifact, stream) AS n_files FROM (SELECT DISTINCT artifact, stream, file_name, file_stamp FROM artifact_lines)),
k AS (SELECT f.artifact, f.stream, path, seq, n_files, coalesce(string_agg(DISTINCT kind, '|' ORDER BY kind), '') AS kinds FROM (SELECT line_id, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM w WHERE path <> '' AND path NOT LIKE '%[]') x
  JOIN artifact_lines a USING (line_id) JOIN f ON f.artifact IS NOT DISTINCT FROM a.artifact AND f.stream IS NOT DISTINCT FROM a.stream AND f.file_name IS NOT DISTINCT FROM a.file_name GROUP BY f.artifact, f.stream, path, seq, n_files),
s AS (SELECT *, CASE WHEN lag(seq) OVER q = seq - 1 AND lag(kinds) OVER q = kinds THEN 0 ELSE 1 END AS starts FROM k WINDOW q AS (PARTITION BY artifact, stream, path ORDER BY seq)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY artifact, stream, path ORDER BY seq) AS island FROM s)
SELECT artifact, stream, path, kinds, CAST(min(seq) AS INTEGER) AS first_seq, CAST(max(seq) AS INTEGER) AS last_seq, max(n_files) AS n_files FROM i GROUP BY artifact, stream, path, kinds, island"""

_DETAIL = "mode is_watermarked z_score p_value independent_blocks hits semantic_prediction contract_valid alignment_ok num_positions_scored num_green_hits green_fraction lexical_z_score joint_score rationale".split()
_ALIGN = "embedded_block_count rebuilt_block_count block_count_mismatch structure_mismatch numeric_mismatch contract_valid is_aligned status".split()
_REAL = {"z_score", "p_value", "green_fraction", "lexical_z_score", "joint_score"}


def _differs(name: str, expr: str) -> str:
    x, y = f"a.{expr}", f"b.{expr}"
    if name in _REAL:
        return f"CASE WHEN ({x} IS NULL) <> ({y} IS NULL) OR ({x} IS NOT NULL AND {x} <> {y} AND NOT coalesce(abs({x} - {y}) <= 1e-9, FALSE)) THEN '{name}' END"
    return f"CASE WHEN {x} IS DISTINCT FROM {y} THEN '{name}' END"


_CA = "contract_alignment"
_CHECKS = ",\n  ".join(
    [_differs(n, n) for n in _DETAIL]
    + [_differs(f"{_CA}.{n}", f"{_CA}.{n}") for n in _ALIGN]
    + [
        f"CASE WHEN a.{_CA}.structure_mismatches IS DISTINCT FROM b.{_CA}.structure_mismatches THEN '{_CA}.structure_mismatches' END",
        # the same numbers, those within 1e-9 taken as one
        f"""CASE WHEN (a.{_CA}.numeric_mismatches IS NULL) <> (b.{_CA}.numeric_mismatches IS NULL)
    OR len(a.{_CA}.numeric_mismatches) <> len(b.{_CA}.numeric_mismatches)
    OR list_bool_or(list_transform(list_zip(a.{_CA}.numeric_mismatches, b.{_CA}.numeric_mismatches), lambda z:
        z[1].ordinal IS DISTINCT FROM z[2].ordinal OR z[1].field IS DISTINCT FROM z[2].field
        OR (z[1].embedded IS NULL) <> (z[2].embedded IS NULL) OR (z[1].rebuilt IS NULL) <> (z[2].rebuilt IS NULL)
        OR (z[1].embedded <> z[2].embedded AND NOT coalesce(abs(z[1].embedded - z[2].embedded) <= 1e-9, FALSE))
        OR (z[1].rebuilt <> z[2].rebuilt AND NOT coalesce(abs(z[1].rebuilt - z[2].rebuilt) <= 1e-9, FALSE)))) THEN '{_CA}.numeric_mismatches' END""",
    ]
)
def _shown(side: str, field: str) -> str:
    if field in _REAL:
        x = f"{side}.{field}"
        return f"CASE WHEN isnan({x}) THEN 'NaN' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE CAST({x} AS VARCHAR) END"
    return f"CAST(to_json({side}.{field}) AS VARCHAR)" if field.endswith("mismatches") else f"CAST({side}.{field} AS VARCHAR)"


_NAMES = _DETAIL + [f"{_CA}.{n}" for n in _ALIGN] + [f"{_CA}.structure_mismatches", f"{_CA}.numeric_mismatches"]
_P6 = f"""
WITH a AS (SELECT * FROM details QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY loaded_at DESC NULLS LAST) = 1),
b AS (SELECT * FROM details_recheck QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY loaded_at DESC NULLS LAST) = 1)
SELECT run_id, id, 'missing_in_recheck' AS field FROM a ANTI JOIN b USING (run_id, id)
UNION ALL SELECT run_id, id, 'missing_in_details' FROM b ANTI JOIN a USING (run_id, id)
UNION ALL SELECT run_id, id, field FROM (SELECT a.run_id, a.id, unnest([{_CHECKS}]) AS field FROM a JOIN b ON a.run_id = b.run_id AND a.id = b.id) WHERE field IS NOT NULL"""

_P6_VALUES = f"""
WITH d AS ({_P6}), a AS (SELECT * FROM details QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY loaded_at DESC NULLS LAST) = 1),
b AS (SELECT * FROM details_recheck QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY loaded_at DESC NULLS LAST) = 1)
SELECT d.run_id, d.id, d.field, CASE d.field {" ".join(f"WHEN '{n}' THEN {_shown('a', n)}" for n in _NAMES)} END AS left_value, CASE d.field {" ".join(f"WHEN '{n}' THEN {_shown('b', n)}" for n in _NAMES)} END AS right_value
FROM d LEFT JOIN a ON a.run_id = d.run_id AND a.id = d.id LEFT JOIN b ON b.run_id = d.run_id AND b.id = d.id"""

ORACLES = {
    "p6_differences": _P6_VALUES,
    "p3_found": f"""
SELECT 'blocks' AS child, record_id, parent_pos, pos FROM ({_element("samples", "record_id", "blocks", "1 AS x")})
UNION ALL SELECT 'retry_attempts', ledger_id, parent_pos, pos FROM ({_element("ledger", "ledger_id", "retry_attempts", "1 AS x")})
UNION ALL SELECT 'cascade_events', ledger_id, parent_pos, pos FROM ({_element("ledger", "ledger_id", "cascade_events", "1 AS x")})
UNION ALL SELECT 'replaced_block_ordinals', ledger_id, parent_pos, pos FROM ({_RBO})""",
    "p3_blocks": _element("samples", "record_id", "blocks", _es(_BLOCK)),
    "p3_retry_attempts": _element("ledger", "ledger_id", "retry_attempts", _es(_TRY)),
    "p3_cascade_events": _element("ledger", "ledger_id", "cascade_events", _es(_EVENT)),
    "p3_replaced_block_ordinals": _RBO,
    "p3_samples": f"SELECT {_SAMPLE} FROM samples",
    "p3_failure_reasons": f"SELECT record_id, e.key AS key, e.value AS value {_MAP.format(m='failure_reason_counts')}",
    "p3_anchors": f"SELECT record_id, e.key AS key, e.value AS value {_MAP.format(m='watermark_params.adaptive_gamma.anchors')}",
    "p3_tables": f"""
SELECT 'samples' AS source, '' AS child, count(*) AS n FROM samples
UNION ALL SELECT 'samples', 'blocks[]', count(*) FROM ({_element("samples", "record_id", "blocks", "1 AS x")}) HAVING count(*) > 0
UNION ALL SELECT 'samples', 'failure_reason_counts{{}}', count(*) {_MAP.format(m='failure_reason_counts')} HAVING count(*) > 0
UNION ALL SELECT 'samples', 'watermark_params.adaptive_gamma.anchors{{}}', count(*) {_MAP.format(m='watermark_params.adaptive_gamma.anchors')} HAVING count(*) > 0
UNION ALL SELECT 'ledger', '', count(*) FROM ledger
UNION ALL SELECT 'ledger', 'retry_attempts[]', count(*) FROM ({_element("ledger", "ledger_id", "retry_attempts", "1 AS x")}) HAVING count(*) > 0
UNION ALL SELECT 'ledger', 'cascade_events[]', count(*) FROM ({_element("ledger", "ledger_id", "cascade_events", "1 AS x")}) HAVING count(*) > 0
UNION ALL SELECT 'ledger', 'cascade_events[].replaced_block_ordinals[]', count(*) FROM ({_RBO}) HAVING count(*) > 0""",
    "p4_lifespans": _LIFESPANS,
    "p4_sample_fields": _gathered(
        "samples",
        {
            "total_blocks": ("DOUBLE", ["total_blocks", "totalBlocks", "n_blocks", "alignment_summary.total_blocks"]),
            "embedded_blocks": ("DOUBLE", ["embedded_blocks", "EMBEDDED_BLOCKS", "blocks_embedded"]),
            "embed_rate": ("DOUBLE", ["embed_rate", "embedRate", "rates.embed"]),
            "final_block_count": ("DOUBLE", ["alignment_summary.final_block_count", "align.final_block_count", "alignment_summary.final_count", "final_block_count"]),
        },
    ),
    "p4_detail_fields": _gathered(
        "details",
        {
            "z_score": ("DOUBLE", ["z_score", "Z_SCORE", "zScore", "z", "score.z"]),
            "p_value": ("DOUBLE", ["p_value", "pval", "score.p_value"]),
            "hits": ("DOUBLE", ["hits", "counts.hits"]),
            "mode": ("VARCHAR", ["mode", "detection_mode", "meta.mode"]),
            "is_watermarked": ("BOOLEAN", ["is_watermarked", "isWatermarked", "watermarked", "prediction.is_watermarked"]),
        },
    ),
    "p6_found": _P6,
    "p6_keys": f"SELECT run_id, id, count(*) AS n_fields FROM ({_P6}) GROUP BY run_id, id",
    "p6_summary": f"SELECT field, count(*) AS n FROM ({_P6}) GROUP BY field",
}
