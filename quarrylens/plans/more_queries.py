"""Further queries: typed fields, splits, batches, nucleus cut, parameters and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions import marks, stats
from quarrylens.operators import cumulative, regress
from quarrylens.plans.relate_queries import _DELTA, KEY
from quarrylens.plans.stat_queries import r6
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


@query("""SELECT line_id, CASE WHEN json_type(raw_line, '$.hits') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(raw_line, '$.hits') AS BIGINT) >= 100 THEN CAST(json_extract(raw_line, '$.hits') AS BIGINT) END AS hits,
CASE WHEN json_type(raw_line, '$.is_watermarked') = 'BOOLEAN' THEN CAST(json_extract(raw_line, '$.is_watermarked') AS BOOLEAN) END AS is_watermarked,
round(CASE WHEN json_type(raw_line, '$.z_score') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(raw_line, '$.z_score') AS DOUBLE) END, 6) AS z_score,
CASE WHEN json_type(raw_line, '$.mode') = 'VARCHAR' THEN json_extract_string(raw_line, '$.mode') END AS mode FROM artifact_lines WHERE artifact = 'details' AND json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'""")
def project_typed(spark: SparkSession, d: str) -> DataFrame:
    """Fields of exactly the wanted JSON type, in range; anything else is null."""
    v = F.try_parse_json("raw_line")
    t = table(spark, d, "artifact_lines").filter("artifact = 'details'").filter(F.schema_of_variant(v).startswith("OBJECT"))
    return t.select("line_id", jsonl.typed(v, "$.hits", "integer", low=100).alias("hits"), jsonl.typed(v, "$.is_watermarked", "boolean").alias("is_watermarked"), r6(jsonl.typed(v, "$.z_score", "number"), "z_score"), jsonl.typed(v, "$.mode", "string").alias("mode"))


@query("SELECT record_id, id, dataset FROM negative_corpus ORDER BY record_id LIMIT 10")
def project_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first ten prompts, the reference's limit; the order is stated."""
    return table(spark, d, "negative_corpus").select("record_id", "id", "dataset").orderBy("record_id").limit(10)


@query("""WITH e AS (SELECT vec_id, i, v FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)), p AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM e),
c AS (SELECT vec_id, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY v DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT vec_id, count(*) FILTER (b < 0.9) AS n_kept FROM c GROUP BY vec_id""")
def window_top_p(spark: SparkSession, d: str) -> DataFrame:
    """How many logits the nucleus of 90 % holds, by a running softmax from the top."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    p = e.withColumn("p", F.exp("v") / F.sum(F.exp("v")).over(W.partitionBy("vec_id")))
    b = F.coalesce(F.sum("p").over(W.partitionBy("vec_id").orderBy(F.desc("v"), "i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return p.withColumn("b", b).groupBy("vec_id").agg(F.count_if(F.col("b") < 0.9).alias("n_kept"))


_HASH = "sha256('7:' || CAST(record_id AS VARCHAR))"


@query(f"WITH r AS (SELECT record_id, row_number() OVER (ORDER BY {_HASH}) - 1 AS n, count(*) OVER () AS all_n FROM samples) SELECT record_id, CASE WHEN n < least(all_n - 1, greatest(1, CAST(floor(all_n * 0.8) AS BIGINT))) THEN 'train' ELSE 'eval' END AS split FROM r")
def sort_exact_split(spark: SparkSession, d: str) -> DataFrame:
    """A seeded shuffle cut at an exact count, min(n - 1, max(1, floor(0.8 n))); ranks come from ranges, not one task."""
    t = table(spark, d, "samples").select("record_id", F.sha2(F.concat(F.lit("7:"), F.col("record_id").cast("string")), 256).alias("h"), F.lit(1).cast("long").alias("one"))
    c = cumulative.cumulative(t, [], "h", ["one"])
    cut = F.least(F.col("total_one") - 1, F.greatest(F.lit(1), F.floor(F.col("total_one") * 0.8)))
    return c.select("record_id", F.when(F.col("before_one") < cut, "train").otherwise("eval").alias("split"))


@query(f"SELECT record_id, CAST(floor((row_number() OVER (ORDER BY {_HASH}) - 1) / 32) AS BIGINT) AS batch FROM samples")
def sort_batches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "samples").select("record_id", F.sha2(F.concat(F.lit("7:"), F.col("record_id").cast("string")), 256).alias("h"), F.lit(1).cast("long").alias("one"))
    return cumulative.cumulative(t, [], "h", ["one"]).select("record_id", F.floor(F.col("before_one") / 32).cast("long").alias("batch"))


@query("WITH b AS (SELECT record_id, e.node_type AS t, i FROM (SELECT record_id, unnest(blocks) AS e, generate_subscripts(blocks, 1) AS i FROM samples) WHERE e.node_type IS NOT NULL), f AS (SELECT record_id, t, min(i) AS i FROM b GROUP BY ALL) SELECT record_id, string_agg(t, ',' ORDER BY i) AS node_types FROM f GROUP BY record_id")
def set_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The node types of a sample, each once, in the order of their first block."""
    kinds = F.array_compact(F.array_distinct(F.transform("blocks", lambda b: b["node_type"])))
    return table(spark, d, "samples").select("record_id", kinds.alias("k")).filter(F.size("k") > 0).select("record_id", F.array_join("k", ",").alias("node_types"))


@query("""WITH s AS (SELECT run_id, id, arg_max(watermark_params.lsh_d, record_id) AS d FROM samples GROUP BY ALL), m AS (SELECT run_id, max(watermark_params.lsh_d) AS d FROM samples GROUP BY run_id)
SELECT d.run_id, d.id, coalesce(s.d, m.d) AS lsh_d, CASE WHEN s.d IS NOT NULL THEN 'watermarked' WHEN m.d IS NOT NULL THEN 'summary' ELSE 'missing' END AS origin FROM (SELECT DISTINCT run_id, id FROM details) d LEFT JOIN s ON s.run_id = d.run_id AND s.id = d.id LEFT JOIN m ON m.run_id = d.run_id""")
def compare_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Where a result's plane count comes from: its sample's own, else its run's, here the greatest in the run, else nowhere."""
    t = table(spark, d, "samples").select("run_id", "id", "record_id", F.col("watermark_params.lsh_d").alias("d"))
    s = t.groupBy("run_id", "id").agg(F.max_by("d", F.when(F.col("d").isNotNull(), F.col("record_id"))).alias("d"))
    m = t.groupBy("run_id").agg(F.max("d").alias("d"))
    r = table(spark, d, "details").select("run_id", "id").distinct().join(s, ["run_id", "id"], "left").join(m.withColumnRenamed("d", "of_run"), "run_id", "left")
    value, origin = regress.preferred([("watermarked", F.col("d")), ("summary", F.col("of_run"))])
    return r.select("run_id", "id", value.alias("lsh_d"), origin.alias("origin"))


@query(_DELTA + """ SELECT run_id, count(*) AS n_shared, count(*) FILTER (flip = 'lost') AS n_lost, count(*) FILTER (flip = 'gained') AS n_gained, count(*) FILTER (z < 0) AS n_z_drop,
round(coalesce(avg(CASE WHEN isfinite(z) THEN z END), 0), 6) + 0 AS mean_z_delta FROM j GROUP BY run_id""")
def compare_report(spark: SparkSession, d: str) -> DataFrame:
    """Run against run in one row a run: shared keys, flips and the mean change of z."""
    x = regress.deltas(table(spark, d, "details"), table(spark, d, "details_recheck"), ["run_id", "id"], "loaded_at")
    z = F.when(F.abs("z_delta") < float("inf"), F.col("z_delta"))
    return x.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("flip") == "lost").alias("n_lost"), F.count_if(F.col("flip") == "gained").alias("n_gained"), F.count_if(F.col("z_delta") < 0).alias("n_z_drop"), (F.round(stats.mean_or_zero(z), 6) + F.lit(0.0)).alias("mean_z_delta"))


@query("""WITH b AS (SELECT DISTINCT * FROM blocks), v AS (SELECT run_id, id, parent_node_type, count(DISTINCT node_type) AS n FROM b GROUP BY ALL)
SELECT CAST((b.parent_node_type <> 'module' AND b.entropy_units >= 10000 AND v.n >= 2) AS INTEGER) AS target, count(*) AS n FROM b JOIN v ON b.run_id = v.run_id AND b.id = v.id AND b.parent_node_type IS NOT DISTINCT FROM v.parent_node_type GROUP BY 1""")
def agg_switch_targets(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in a body, of enough entropy and with more than one kind of sibling; null where a part is unknown."""
    b = table(spark, d, "blocks").distinct()
    # Counted before the join: the blocks of one task, however many, are a few rows for each kind of parent.
    by = ["run_id", "id", "parent_node_type"]
    c = b.groupBy(*by, (F.col("entropy_units") >= 10000).alias("much")).agg(F.count(F.lit(1)).alias("c"))
    v = b.groupBy(*by).agg(F.count_distinct("node_type").alias("n"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"v.{k}")) for k in by]
    target = ((F.col("c.parent_node_type") != "module") & F.col("c.much") & (F.col("v.n") >= 2)).cast("int")
    return c.alias("c").join(v.alias("v"), same).groupBy(target.alias("target")).agg(F.sum("c").alias("n"))


@query("SELECT run_id, round(avg(epoch(arrived_at) - epoch(CAST(run_day AS TIMESTAMP))), 3) AS mean_delay FROM blocks GROUP BY run_id")
def agg_mean_delay(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from the start of a run's day to the arrival of its rows."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return table(spark, d, "blocks").groupBy("run_id").agg(F.round(F.avg(seconds(F.col("arrived_at")) - seconds(F.col("run_day"))), 3).alias("mean_delay"))


@query("""WITH p AS (SELECT run_id, id, count(*) AS n, count(*) FILTER (initial_verify.passed) AS ok FROM (SELECT *, sample_id AS id FROM ledger) GROUP BY ALL)
SELECT run_id, count(*) AS prompts, round(avg(ok / n), 6) AS mean_rate, round(sum(ok) / sum(n), 6) AS rate FROM p GROUP BY run_id""")
def agg_prompt_summary(spark: SparkSession, d: str) -> DataFrame:
    """First-check pass rates: the mean over samples beside the share of all blocks."""
    p = table(spark, d, "ledger").groupBy("run_id", "sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("initial_verify.passed").alias("ok"))
    return p.groupBy("run_id").agg(F.count(F.lit(1)).alias("prompts"), r6(F.avg(F.col("ok") / F.col("n")), "mean_rate"), r6(F.sum("ok") / F.sum("n"), "rate"))


@query("SELECT DISTINCT b.run_id, b.id, b.o AS ordinal FROM (SELECT run_id, id, e.ordinal AS o FROM (SELECT run_id, id, unnest(blocks) AS e FROM samples) WHERE e.ordinal IS NOT NULL) b WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.run_id = b.run_id AND l.sample_id = b.id AND l.block_ordinal = b.o)")
def join_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of samples that no ledger row is about."""
    b = table(spark, d, "samples").select("run_id", "id", F.explode("blocks").alias("e")).select("run_id", "id", F.col("e.ordinal").alias("ordinal")).filter("ordinal IS NOT NULL").distinct()
    return b.join(table(spark, d, "ledger").select("run_id", F.col("sample_id").alias("id"), F.col("block_ordinal").alias("ordinal")), ["run_id", "id", "ordinal"], "left_anti")


def _signs() -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in p) + "]" for p in marks.planes(KEY + "/signs", 16, 64)) + "]"


@query(f"""WITH a AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS c FROM embeddings GROUP BY label), s AS (SELECT e.vec_id, list_transform({_signs()}, lambda p: CASE WHEN sign(list_dot_product(p, CAST(e.embedding AS DOUBLE[]))) = sign(list_dot_product(p, a.c)) THEN 1.0 ELSE 0.0 END) AS m FROM embeddings e JOIN a USING (label))
SELECT vec_id, round(list_avg(m), 6) AS consistency FROM s""")
def mark_sign_consistency(spark: SparkSession, d: str) -> DataFrame:
    """The share of fixed directions on whose sides a vector and the first of its label agree."""
    normals = marks.planes(KEY + "/signs", 16, 64)
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("s", F.transform(marks.projections(F.col("v"), normals), lambda x: F.signum(x)))
    a = e.groupBy("label").agg(F.min_by("s", "vec_id").alias("t"))
    same = F.aggregate(F.zip_with("s", "t", lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return e.join(a, "label").select("vec_id", r6(same / len(normals), "consistency"))
