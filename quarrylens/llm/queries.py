"""The pN_ queries of problems 1, 2, 5, 7, 8 and 9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import copies, leaks, mixing, mojibake, percentiles, syntax
from quarrylens.sources.tables import table

QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
DAY = ["origin", "node_type", "profile_id", "run_day"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.source_files(table(spark, d, "samples")).unionByName(syntax.source_files(table(spark, d, "negative_corpus")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(_files(spark, d)).filter("parses = false").select("record_id")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(_files(spark, d))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(syntax.check_files(_files(spark, d)))


def p1_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON files among them, each with its verdict: the grammar whose verdicts SQL can give as well."""
    return syntax.check_files(_files(spark, d).filter("grammar = 'json' AND source IS NOT NULL")).select("record_id", "parses")


def _values(spark: SparkSession, d: str) -> DataFrame:
    """entropy_units of blocks and samples.blocks; -1 stands for unknown and null for missing."""
    blocks = table(spark, d, "blocks").select(F.lit("blocks").alias("origin"), "node_type", "profile_id", "run_day", "entropy_units", "run_id", "id", "ordinal")
    day = F.try_to_date(F.regexp_extract("run_id", r"_(\d{8})_", 1), "yyyyMMdd")
    inner = table(spark, d, "samples").select("run_id", "id", "profile_id", day.alias("run_day"), F.posexplode("blocks").alias("place", "b"))
    # a delivered sample is named by its run and id; its blocks are repeats if they are equal in all of this
    samples = inner.filter("b is not null").select(F.lit("samples").alias("origin"), "b.node_type", "profile_id", "run_day", "b.entropy_units", "run_id", "id", F.coalesce("b.ordinal", F.col("place")).alias("ordinal"))
    return blocks.unionByName(samples).filter("entropy_units >= 0")


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable state: counts of binned values for each day."""
    return percentiles.summarize(_values(spark, d), DAY, "entropy_units", once=["run_id", "id", "ordinal"])


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(p2_summary(spark, d), DAY, QUANTILES)


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """All days of a node type, from the days' states alone."""
    return percentiles.percentiles(percentiles.merge(p2_summary(spark, d), ["node_type"]), ["node_type"], QUANTILES)


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("record_id", "generated_code").unionByName(table(spark, d, "negative_corpus").select("record_id", "generated_code"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_codes(spark, d))[1]


def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_codes(spark, d))[0]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    found = p7_found(spark, d)
    return table(spark, d, "eval_items").select("item_id", "suite").join(found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs")), "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Longer passages with up to three words changed, left out or put in."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=24, edits=3)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damage(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mojibake.restore(docs, mojibake.damage(docs))


QUERIES = {
    "p1_found": p1_found,
    "p1_files": p1_files,
    "p1_rates": p1_rates,
    "p1_json": p1_json,
    "p2_percentiles": p2_percentiles,
    "p2_summary": p2_summary,
    "p2_merged": p2_merged,
    "p5_found": p5_found,
    "p5_distinct": p5_distinct,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p7_near": p7_near,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_B = percentiles.BITS
_VALUES = f"""
v AS (
  SELECT DISTINCT 'blocks' AS origin, node_type, profile_id, CAST(run_day AS DATE) AS run_day, CAST(entropy_units AS BIGINT) AS v, run_id, id, ordinal FROM blocks WHERE entropy_units >= 0
  UNION ALL
  SELECT DISTINCT 'samples', b.node_type, profile_id, CAST(try_strptime(regexp_extract(run_id, '_(\\d{{8}})_', 1), '%Y%m%d') AS DATE), CAST(b.entropy_units AS BIGINT), run_id, id, coalesce(b.ordinal, i - 1)
  FROM (SELECT *, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS i FROM samples) WHERE b.entropy_units >= 0),
s AS (SELECT origin, node_type, profile_id, run_day, v, greatest(length(bin(v)) - {_B}, 0) AS h FROM v),
e AS (SELECT origin, node_type, profile_id, run_day, CAST((v // CAST(2 ** h AS BIGINT)) * CAST(2 ** h AS BIGINT) AS BIGINT) AS bin, CAST(2 ** h AS BIGINT) // 2 AS half FROM s)"""


def _quantiles_sql(groups: str) -> str:
    names = {p: "p" + f"{p * 100:g}" for p in QUANTILES}
    picks = ", ".join(f"arg_min(bin + half, bin) FILTER (cum >= (n * {round(p * 1_000_000)} + 999999) // 1000000) AS {x}, arg_min(half, bin) FILTER (cum >= (n * {round(p * 1_000_000)} + 999999) // 1000000) AS h{x}" for p, x in names.items())
    return f"""
WITH {_VALUES},
c AS (SELECT {groups}, bin, any_value(half) AS half, count(*) AS c FROM e GROUP BY {groups}, bin),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY {groups} ORDER BY bin) AS BIGINT) AS cum, CAST(sum(c) OVER (PARTITION BY {groups}) AS BIGINT) AS n FROM c),
q AS (SELECT {groups}, any_value(n) AS n, {picks} FROM r GROUP BY {groups})
SELECT {groups}, n, {", ".join(names.values())}, greatest({", ".join("h" + x for x in names.values())}, 0) AS error_bound FROM q"""


_SHARED = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items),
g AS (SELECT DISTINCT side, id, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 10)) AS i FROM t WHERE len(ws) >= 12)),
f AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g AND d.side = 'd' AND i.side = 'i')"""

_JSON = """
SELECT record_id, json_valid(CASE WHEN code_form = 'completion' THEN coalesce(prompt, '') ELSE '' END || generated_code) AS parses
FROM (SELECT record_id, file_path, code_form, prompt, generated_code FROM samples UNION ALL SELECT record_id, file_path, code_form, prompt, generated_code FROM negative_corpus)
WHERE generated_code IS NOT NULL AND regexp_matches(lower(file_path), '\\.json$')"""

# Records linked by letters and digits or by the sorted leaves of their JSON objects; links over several records in turn.
_FLAT = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_ROUNDS = 4
_COPIES = f"""
WITH RECURSIVE c AS (SELECT record_id, generated_code AS t, {_FLAT.format("generated_code")} AS f FROM (SELECT record_id, generated_code FROM samples UNION ALL SELECT record_id, generated_code FROM negative_corpus) WHERE generated_code IS NOT NULL),
w AS (SELECT record_id, '' AS path, CAST(t AS JSON) AS v FROM c WHERE json_valid(t) AND json_type(t) = 'OBJECT'
  UNION ALL SELECT record_id, e.p, e.x FROM (SELECT record_id, unnest(CASE json_type(v)
    WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {{'p': path || '/' || {_FLAT.format("k")}, 'x': json_extract(v, '$."' || k || '"')}})
    WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: {{'p': path || '#' || i, 'x': json_extract(v, '$[' || i || ']')}}) ELSE [] END) AS e FROM w)),
j AS (SELECT record_id, string_agg(x, '|' ORDER BY x) AS tree FROM (SELECT record_id, path || '=' || CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN json_type(v) ELSE {_FLAT.format("CAST(v AS VARCHAR)")} END AS x FROM w) GROUP BY record_id),
s0 AS (SELECT record_id, f, tree, record_id AS m FROM c LEFT JOIN j USING (record_id)),
{", ".join(f"a{n} AS (SELECT record_id, f, tree, min(m) OVER (PARTITION BY f) AS m FROM s{n - 1}), s{n} AS (SELECT record_id, f, tree, CASE WHEN tree IS NULL THEN m ELSE min(m) OVER (PARTITION BY tree) END AS m FROM a{n})" for n in range(1, _ROUNDS + 1))}"""

ORACLES = {
    "p5_found": _COPIES + f" SELECT m AS first_id, record_id AS copy_id FROM s{_ROUNDS} WHERE m <> record_id",
    "p5_distinct": _COPIES + f" SELECT m AS record_id, count(*) AS n_copies FROM s{_ROUNDS} GROUP BY m",
    "p1_json": _JSON,
    "p7_found": _SHARED + " SELECT doc_id, item_id FROM f",
    "p7_items": _SHARED + " SELECT e.item_id, e.suite, count(f.doc_id) AS n_docs FROM eval_items e LEFT JOIN f USING (item_id) GROUP BY ALL",
    "p2_summary": f"WITH {_VALUES} SELECT origin, node_type, profile_id, run_day, bin, count(*) AS n FROM e GROUP BY ALL",
    "p2_percentiles": _quantiles_sql("origin, node_type, profile_id, run_day"),
    "p2_merged": _quantiles_sql("node_type"),
}
