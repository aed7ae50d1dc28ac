"""Queries of joins, windows, set operations and run comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions import marks
from quarrylens.operators import rank, regress, relate
from quarrylens.plans.stat_queries import r6
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


# Joins


@query("SELECT record_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM details d WHERE d.run_id = s.run_id AND d.id = s.id)")
def join_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return relate.unprocessed(table(spark, d, "samples"), table(spark, d, "details"), ["run_id", "id"]).select("record_id")


_LAST = "QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY {o} DESC NULLS LAST) = 1"


@query(f"SELECT d.run_id, d.id, d.z_score, coalesce(s.embed_rate, 0.0) AS embed_rate FROM details d LEFT JOIN (SELECT run_id, id, embed_rate FROM samples {_LAST.format(o='record_id')}) s ON d.run_id = s.run_id AND d.id = s.id")
def join_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select("run_id", "id", "embed_rate", "record_id")
    return relate.lookup(table(spark, d, "details").select("run_id", "id", "z_score"), s, ["run_id", "id"], "embed_rate", 0.0, "record_id")


@query("""WITH a AS (SELECT DISTINCT run_id, id FROM details), b AS (SELECT DISTINCT run_id, id FROM details_recheck)
SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right_only' WHEN b.id IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.run_id = b.run_id AND a.id = b.id""")
def join_key_diff(spark: SparkSession, d: str) -> DataFrame:
    return relate.key_diff(table(spark, d, "details"), table(spark, d, "details_recheck"), ["run_id", "id"])


_DELTA = f"""WITH a AS (SELECT * FROM details {_LAST.format(o='loaded_at')}), b AS (SELECT * FROM details_recheck {_LAST.format(o='loaded_at')}),
j AS (SELECT a.run_id, a.id, CASE WHEN NOT isnan(b.z_score - a.z_score) THEN b.z_score - a.z_score END AS z, b.independent_blocks - a.independent_blocks AS n, b.hits - a.hits AS h,
CASE WHEN a.is_watermarked AND NOT b.is_watermarked THEN 'lost' WHEN NOT a.is_watermarked AND b.is_watermarked THEN 'gained' END AS flip FROM a JOIN b ON a.run_id = b.run_id AND a.id = b.id)"""


@query(_DELTA + """ SELECT run_id, id, round(z, 6) + 0 AS z_delta, CAST(n AS BIGINT) AS blocks_delta, CAST(h AS BIGINT) AS hits_delta, flip,
concat_ws(',', CASE WHEN flip = 'lost' THEN 'detection_lost' END, CASE WHEN z < 0 THEN 'z_score_drop' END, CASE WHEN n > 0 AND h <= 0 THEN 'block_growth_without_hit_gain' END) AS flags FROM j""")
def compare_deltas(spark: SparkSession, d: str) -> DataFrame:
    got = regress.deltas(table(spark, d, "details"), table(spark, d, "details_recheck"), ["run_id", "id"], "loaded_at")
    return got.select("run_id", "id", (F.round("z_delta", 6) + F.lit(0.0)).alias("z_delta"), "blocks_delta", "hits_delta", "flip", F.concat_ws(",", "flags").alias("flags"))


_VERSIONS = """WITH v AS (SELECT run_id, id, arg_min(blocks, record_id) AS a, arg_max(blocks, record_id) AS b, arg_max(adaptive_mode, record_id) AS mode FROM (SELECT *, 1 AS one FROM samples WHERE blocks IS NOT NULL) GROUP BY ALL)"""
_SAID = "coalesce(CAST(coalesce(z[2].ordinal, z[1].ordinal) AS VARCHAR), '')"
_S = ", ".join(f"CASE WHEN z[1].{f} IS DISTINCT FROM z[2].{f} THEN {_SAID} || ':{f}:' || coalesce(CAST(z[1].{f} AS VARCHAR), '') || ':' || coalesce(CAST(z[2].{f} AS VARCHAR), '') END" for f in relate.STRUCTURE)
_N = ", ".join(f"CASE WHEN {x.format(1)} IS DISTINCT FROM {x.format(2)} THEN {_SAID} || ':{f}' END" for f in relate.NUMERIC for x in [("z[{}]." + f) if f == "entropy_units" else "coalesce(CAST(z[{}]." + f + " AS DOUBLE), 0)"])


@query(f"""{_VERSIONS}, z AS (SELECT *, len(a) AS na, len(b) AS nb, list_zip(a[1:least(len(a), len(b))], b[1:least(len(a), len(b))]) AS z FROM v),
c AS (SELECT run_id, id, mode, na, nb, flatten(list_transform(z, lambda z: list_filter([{_S}], lambda x: x IS NOT NULL))) AS s, flatten(list_transform(z, lambda z: list_filter([{_N}], lambda x: x IS NOT NULL))) AS m FROM z),
e AS (SELECT *, na <> nb OR len(s) > 0 AS bs, len(m) > 0 AS bm FROM c)
SELECT run_id, id, CAST(na AS INTEGER) AS embedded_block_count, CAST(nb AS INTEGER) AS rebuilt_block_count, na <> nb AS block_count_mismatch, bs AS structure_mismatch, bm AS numeric_mismatch,
array_to_string(list_concat(CASE WHEN na <> nb THEN [':block_count:' || na || ':' || nb] ELSE [] END, s), '|') AS structure, array_to_string(m, '|') AS numbers,
CASE WHEN mode = 'adaptive' THEN NOT bs AND NOT bm ELSE NOT bs END AS contract_valid, NOT bs AND NOT bm AS is_aligned,
CASE WHEN bs AND bm THEN 'structure_and_numeric_mismatch' WHEN bs THEN 'structure_mismatch' WHEN bm THEN 'numeric_mismatch' ELSE 'aligned' END AS status FROM e""")
def join_positional(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of a sample's first delivery against those of its last, place by place, with the lists of mismatches."""
    named = F.when(F.col("adaptive_mode").isNotNull(), F.col("record_id"))
    v = table(spark, d, "samples").filter("blocks IS NOT NULL").groupBy("run_id", "id").agg(F.min_by("blocks", "record_id").alias("a"), F.max_by("blocks", "record_id").alias("b"), F.max_by("adaptive_mode", named).alias("mode"))
    x = v.select("run_id", "id", relate.align(F.col("a"), F.col("b"), F.col("mode")).alias("x")).select("run_id", "id", "x.*")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    structure = F.transform("structure_mismatches", lambda s: F.concat_ws(":", text(s["ordinal"]), s["field"], text(s["embedded"]), text(s["rebuilt"])))
    numbers = F.transform("numeric_mismatches", lambda s: F.concat_ws(":", text(s["ordinal"]), s["field"]))
    return x.withColumn("structure", F.array_join(structure, "|")).withColumn("numbers", F.array_join(numbers, "|")).drop("structure_mismatches", "numeric_mismatches")


@query("""WITH b AS (SELECT run_id, id, ordinal, any_value(k) AS k, any_value(gamma_effective) AS g FROM blocks GROUP BY ALL)
SELECT l.ledger_id, CASE WHEN b.k > 0 THEN b.k END AS k, b.g AS gamma_effective FROM ledger l LEFT JOIN (SELECT s.run_id, s.id, e.ordinal, any_value(e.k) AS k, any_value(e.gamma_effective) AS g FROM (SELECT run_id, id, unnest(blocks) AS e FROM (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY record_id DESC) = 1)) s WHERE e.ordinal IS NOT NULL GROUP BY ALL HAVING count(*) = 1) b
ON l.run_id = b.run_id AND l.sample_id = b.id AND l.block_ordinal = b.ordinal""")
def join_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Each ledger row with the k and gamma of its block in the last delivery, where the ordinal names one block."""
    s = relate.last_by(table(spark, d, "samples").select("run_id", "id", "blocks", "record_id"), ["run_id", "id"], "record_id")
    b = s.select("run_id", F.col("id").alias("sample_id"), F.explode("blocks").alias("e")).select("run_id", "sample_id", F.col("e.ordinal").alias("block_ordinal"), F.col("e.k").alias("k"), F.col("e.gamma_effective").alias("gamma_effective"), F.lit(1).alias("one")).filter("block_ordinal IS NOT NULL")
    b = b.groupBy("run_id", "sample_id", "block_ordinal").agg(F.first("k").alias("k"), F.first("gamma_effective").alias("gamma_effective"), F.sum("one").alias("n")).filter("n = 1")
    return table(spark, d, "ledger").select("ledger_id", "run_id", "sample_id", "block_ordinal").join(b, ["run_id", "sample_id", "block_ordinal"], "left").select("ledger_id", F.when(F.col("k") > 0, F.col("k")).alias("k"), "gamma_effective")


@query("SELECT DISTINCT s.run_id, s.id FROM samples s WHERE s.failed_blocks > 0 AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.run_id = s.run_id AND l.sample_id = s.id AND NOT coalesce(l.final_outcome.embedded, FALSE))")
def join_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Samples that state failed blocks of which the ledger, their sidecar, holds none."""
    failed = table(spark, d, "ledger").filter(~F.coalesce("final_outcome.embedded", F.lit(False))).select("run_id", F.col("sample_id").alias("id"))
    return relate.unprocessed(table(spark, d, "samples").filter("failed_blocks > 0").select("run_id", "id").distinct(), failed, ["run_id", "id"])


# Windows and order


@query("SELECT run_id, id, node_type, min(ordinal) AS ordinal FROM blocks WHERE entropy_units > 0 GROUP BY ALL")
def window_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first block of each node type in each task, blocks without entropy not counting as seen."""
    return relate.first_seen(table(spark, d, "blocks").select("run_id", "id", "node_type", "ordinal", "entropy_units"), ["run_id", "id", "node_type"], ["ordinal"], F.col("entropy_units") > 0).select("run_id", "id", "node_type", "ordinal")


@query("""WITH b AS (SELECT record_id, e.ordinal AS o, coalesce(e.entropy_units, -1) AS u, i FROM (SELECT record_id, unnest(blocks) AS e, generate_subscripts(blocks, 1) AS i FROM samples) WHERE e IS NOT NULL)
SELECT record_id, i - 1 AS place, list_aggregate(list(u) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 'string_agg', ',') AS prefix FROM b""")
def window_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The four entropies before each block."""
    b = table(spark, d, "samples").select("record_id", F.posexplode("blocks").alias("place", "e")).filter("e IS NOT NULL").select("record_id", F.col("place").cast("long").alias("place"), F.coalesce("e.entropy_units", F.lit(-1)).alias("u"))
    p = relate.prefix_window("u", ["record_id"], "place", 4)
    got = b.withColumn("p", p)
    return got.select("record_id", "place", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x.cast("string")), ",")).alias("prefix"))


@query("SELECT run_id, id, record_id, row_number() OVER (PARTITION BY run_id, id ORDER BY loaded_at NULLS FIRST, record_id) - 1 AS delivery FROM samples")
def window_ordinal(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("run_id", "id").orderBy(F.col("loaded_at").asc_nulls_first(), "record_id")) - 1
    return table(spark, d, "samples").select("run_id", "id", "record_id", n.cast("long").alias("delivery"))


_EMB = "WITH q AS (SELECT vec_id, embedding AS e, CASE WHEN vec_id % 2 = 0 THEN vec_id + 1 ELSE vec_id - 1 END AS t FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id, embedding AS e FROM embeddings)"


@query(_EMB + """, s AS (SELECT q.vec_id, q.t, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS m, c.vec_id AS o FROM q, c), x AS (SELECT vec_id, t, m FROM s WHERE o = t)
SELECT x.vec_id, x.t AS truth, round(x.m, 6) AS similarity, count(*) FILTER (s.m > x.m + 1e-12) + 1 AS rank FROM x JOIN s USING (vec_id) GROUP BY ALL""")
def rank_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """For the stated queries, ids divisible by 100, the rank of the neighbouring id among all vectors."""
    e = table(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") % 100 == 0).select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id") - 1).alias("truth"))
    return rank.retrieval_ranks(q, e, "vec_id", "embedding", "truth").select("vec_id", "truth", r6(F.col("similarity"), "similarity"), "rank")


@query(_EMB + """, s AS (SELECT q.vec_id, q.t, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS m, c.vec_id AS o FROM q, c), x AS (SELECT vec_id, t, m FROM s WHERE o = t),
r AS (SELECT x.vec_id, count(*) FILTER (s.m > x.m + 1e-12) + 1 AS r FROM x JOIN s USING (vec_id) GROUP BY ALL) SELECT count(*) AS n, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(1 / r), 6) AS mrr FROM r""")
def rank_recall(spark: SparkSession, d: str) -> DataFrame:
    r = rank_retrieval(spark, d)
    return r.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(F.col("rank") <= 10, 1.0).otherwise(0.0)), "recall_at_10"), r6(F.avg(1 / F.col("rank")), "mrr"))


@query("SELECT run_id, list_sort(list(DISTINCT dataset) FILTER (dataset IS NOT NULL)) AS datasets, string_agg(DISTINCT profile_id, ',' ORDER BY profile_id) AS profiles FROM samples GROUP BY run_id")
def sort_lists(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.array_sort(F.collect_set(c))
    return table(spark, d, "samples").groupBy("run_id").agg(s("dataset").alias("datasets"), s("profile_id").alias("p")).select("run_id", "datasets", F.when(F.size("p") > 0, F.array_join("p", ",")).alias("profiles"))


@query("SELECT record_id, CASE WHEN CAST('0x' || substr(md5('0:' || CAST(record_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 THEN 'train' ELSE 'eval' END AS split FROM samples")
def sort_split(spark: SparkSession, d: str) -> DataFrame:
    return relate.seeded_split(table(spark, d, "samples").select("record_id"), "record_id", 0.8)


# Sets and run comparison


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_id) AS n FROM samples WHERE watermark_params IS NOT NULL), j AS (SELECT a.id, a.watermark_params AS x, b.watermark_params AS y FROM p a JOIN p b ON a.id = b.id AND a.n = 1 AND b.n = 2)
SELECT id, concat_ws(',', CASE WHEN x.lsh_d IS DISTINCT FROM y.lsh_d THEN 'lsh_d' END, CASE WHEN x.lsh_gamma IS DISTINCT FROM y.lsh_gamma THEN 'lsh_gamma' END, CASE WHEN x.margin_alpha IS DISTINCT FROM y.margin_alpha THEN 'margin_alpha' END, CASE WHEN x.margin_base IS DISTINCT FROM y.margin_base THEN 'margin_base' END) AS differing FROM j""")
def set_parameter_diff(spark: SparkSession, d: str) -> DataFrame:
    """Which parameters differ between the first two records of a task."""
    names = ["lsh_d", "lsh_gamma", "margin_base", "margin_alpha"]
    as_map = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"watermark_params.{n}").cast("string"))])
    two = table(spark, d, "samples").filter("watermark_params IS NOT NULL").select("id", F.struct("record_id", as_map.alias("m")).alias("p"))
    by = W.partitionBy("id").orderBy("p.record_id")
    two = two.withColumn("n", F.row_number().over(by)).filter("n <= 2").groupBy("id").agg(F.max(F.when(F.col("n") == 1, F.struct("p.record_id", F.to_json("p.m").alias("j")))).alias("a"), F.max(F.when(F.col("n") == 2, F.struct("p.record_id", F.to_json("p.m").alias("j")))).alias("b")).filter("b IS NOT NULL")
    m = lambda c: F.from_json(f"{c}.j", "map<string,string>")
    return two.select("id", F.array_join(relate.differing_keys(m("a"), m("b")), ",").alias("differing"))


@query("""WITH c AS (SELECT run_id, unnest(map_entries(failure_reason_counts)) AS e FROM samples), n AS (SELECT run_id, e.key AS reason, sum(e.value) AS n FROM c GROUP BY ALL), r AS (SELECT min(run_id) AS a, max(run_id) AS b FROM samples)
SELECT reason, CAST(coalesce(sum(n) FILTER (run_id = b), 0) - coalesce(sum(n) FILTER (run_id = a), 0) AS BIGINT) AS delta FROM n, r WHERE run_id IN (a, b) GROUP BY reason""")
def set_count_delta(spark: SparkSession, d: str) -> DataFrame:
    """Failure reasons of the last run against the first."""
    s = table(spark, d, "samples")
    n = s.select("run_id", F.explode("failure_reason_counts").alias("reason", "n"))
    run = lambda f: n.filter(F.col("run_id") == s.agg(f("run_id")).scalar())
    return regress.count_delta(run(F.min), run(F.max), ["reason"], "n")


@query("SELECT run_id, count(DISTINCT CAST(watermark_params.lsh_d AS VARCHAR)) AS n_values, count(*) FILTER (watermark_params.lsh_d IS NULL) AS n_missing, (count(DISTINCT watermark_params.lsh_d) = 1 AND count(*) FILTER (watermark_params.lsh_d IS NULL) = 0) OR count(*) FILTER (watermark_params.lsh_d IS NULL) = count(*) AS is_uniform FROM samples GROUP BY run_id")
def set_uniform(spark: SparkSession, d: str) -> DataFrame:
    return regress.uniform_value(table(spark, d, "samples"), ["run_id"], F.col("watermark_params.lsh_d"))


@query("SELECT record_id, map_entries(failure_reason_counts) IS NOT NULL AS has_counts, CAST(coalesce(list_sum(map_values(failure_reason_counts)), 0) AS BIGINT) AS n FROM samples")
def set_map_totals(spark: SparkSession, d: str) -> DataFrame:
    v = F.aggregate(F.map_values("failure_reason_counts"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return table(spark, d, "samples").select("record_id", F.col("failure_reason_counts").isNotNull().alias("has_counts"), F.coalesce(v, F.lit(0)).cast("long").alias("n"))


# Mark functions over vectors and blocks

KEY, DIM, PLANES = "audit-key", 64, 4


def _planes_sql() -> str:
    rows = marks.planes(KEY, PLANES, DIM)
    return "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in p) + "]" for p in rows) + "]"


_SIG = f"SELECT vec_id, label, list_transform({_planes_sql()}, lambda p: list_dot_product(p, CAST(embedding AS DOUBLE[]))) AS d, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings"
_BITS = " + ".join(f"CASE WHEN d[{i + 1}] > 0 THEN {2 ** (PLANES - 1 - i)} ELSE 0 END" for i in range(PLANES))


@query(f"WITH s AS ({_SIG}) SELECT vec_id, CAST({_BITS} AS INTEGER) AS signature, round(CASE WHEN n > 0 THEN list_min(list_transform(d, lambda x: abs(x))) / n ELSE 0 END, 6) AS margin FROM s")
def mark_signature(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("pr", marks.projections(F.col("embedding"), marks.planes(KEY, PLANES, DIM)))
    return e.select("vec_id", marks.signature_of(F.col("pr")).alias("signature"), r6(marks.min_margin_of(F.col("pr"), F.col("embedding")), "margin"))


PARENTS = [f"parent_{i}" for i in range(10)]
_REGIONS = ", ".join(f"('{p}', {s})" for p in PARENTS for s in marks.valid_regions(KEY, p, PLANES, 8))


@query(f"""WITH s AS ({_SIG}), g(parent, signature) AS (VALUES {_REGIONS}), h AS (SELECT s.label, CASE WHEN g.signature IS NOT NULL AND list_min(list_transform(d, lambda x: abs(x))) / n > 0.001 THEN 1 ELSE 0 END AS hit
FROM s LEFT JOIN g ON g.parent = 'parent_' || s.label AND g.signature = {_BITS}) SELECT label, count(*) AS m, CAST(sum(hit) AS BIGINT) AS hits, round((sum(hit) - count(*) * 0.5) / sqrt(count(*) * 0.25), 6) AS z, (sum(hit) - count(*) * 0.5) / sqrt(count(*) * 0.25) >= 2 AS decision FROM h GROUP BY label""")
def mark_detect(spark: SparkSession, d: str) -> DataFrame:
    """Detection end to end: signatures, valid regions of the parent type, margin, hits, z-score, decision."""
    from quarrylens.functions import stats

    e = table(spark, d, "embeddings").withColumn("pr", marks.projections(F.col("embedding"), marks.planes(KEY, PLANES, DIM)))
    e = e.select(F.col("label"), F.concat(F.lit("parent_"), F.col("label").cast("string")).alias("parent_node_type"), marks.signature_of(F.col("pr")).alias("signature"), marks.min_margin_of(F.col("pr"), F.col("embedding")).alias("margin"))
    valid = marks.region_table(spark, KEY, PARENTS, PLANES, [8]).withColumn("valid", F.lit(True)).drop("k")
    hit = (F.col("valid") & (F.col("margin") > 0.001)).cast("int")
    h = e.join(F.broadcast(valid), ["parent_node_type", "signature"], "left").groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum(F.coalesce(hit, F.lit(0))).alias("hits"))
    z = stats.z_score(F.col("hits"), F.col("m") * 0.5, F.col("m") * 0.25)
    return h.select("label", "m", "hits", r6(z, "z"), (z >= 2).alias("decision"))


_PADS = [bytes(b ^ x for b in KEY.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f"SELECT parent_node_type, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(parent_node_type)))) AS mac FROM (SELECT DISTINCT parent_node_type FROM blocks WHERE parent_node_type IS NOT NULL)")
def mark_hmac(spark: SparkSession, d: str) -> DataFrame:
    """Keyed seeds of the parent types, from SHA-2 alone; tested against Python's hmac."""
    return table(spark, d, "blocks").select("parent_node_type").distinct().filter("parent_node_type IS NOT NULL").select("parent_node_type", marks.hmac_sha256(KEY, F.col("parent_node_type")).alias("mac"))


_A = [("p10", 0.95), ("p50", 0.75), ("p75", 0.55), ("p90", 0.35), ("p95", 0.25)]
_Q = [f"quantiles_units['{q}']" for q, _ in _A]
_STEPS = " ".join(f"WHEN u <= {b} THEN CASE WHEN {a} = {b} THEN {gb} ELSE {ga} + (u - {a}) / ({b} - {a}) * ({gb} - {ga}) END" for (a, ga), (b, gb) in zip(zip(_Q, [g for _, g in _A]), list(zip(_Q, [g for _, g in _A]))[1:]))


@query(f"""WITH j AS (SELECT b.run_id, b.id, b.ordinal, CAST(b.entropy_units AS DOUBLE) AS u, p.quantiles_units FROM (SELECT DISTINCT * FROM blocks) b JOIN entropy_profile p USING (profile_id) WHERE b.entropy_units >= 0 AND p.quantiles_units IS NOT NULL),
g AS (SELECT *, CASE WHEN u <= {_Q[0]} THEN 0.95 {_STEPS} ELSE 0.25 END AS g FROM j), k AS (SELECT *, CAST(least(greatest(round_even(g * 16, 0), 1), 15) AS INTEGER) AS k FROM g) SELECT run_id, id, ordinal, round(g, 6) AS gamma_target, k, k / 16 AS gamma_effective FROM k""")
def mark_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Each block's gamma by its profile's quantiles, quantised for 4 planes."""
    p = table(spark, d, "entropy_profile").filter("quantiles_units IS NOT NULL").select("profile_id", "quantiles_units")
    b = table(spark, d, "blocks").filter("entropy_units >= 0").select("run_id", "id", "ordinal", "profile_id", F.col("entropy_units").cast("double").alias("u")).distinct()
    g = marks.schedule(F.col("u"), [(F.col("quantiles_units")[q].cast("double"), x) for q, x in _A])
    j = b.join(p, "profile_id").withColumn("g", g)
    _, k, eff = marks.quantize(F.col("g"), F.lit(4))
    return j.select("run_id", "id", "ordinal", r6(F.col("g"), "gamma_target"), k.alias("k"), eff.alias("gamma_effective"))


@query("SELECT DISTINCT run_id, id, ordinal, round(0.001 + 0.01 * entropy_units / 10000, 9) AS margin FROM blocks WHERE entropy_units >= 0")
def mark_margin(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").filter("entropy_units >= 0").select("run_id", "id", "ordinal", "entropy_units").distinct()
    return b.select("run_id", "id", "ordinal", F.round(marks.dynamic_margin(F.col("entropy_units") / 10000, 0.001, 0.01), 9).alias("margin"))


@query("SELECT node_type, CAST(CAST(('0x' || substr(sha256(node_type), 1, 16)) AS UBIGINT) % 2048 AS INTEGER) AS bucket FROM (SELECT DISTINCT node_type FROM blocks WHERE node_type IS NOT NULL)")
def mark_feature_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").filter("node_type IS NOT NULL").select("node_type").distinct().select("node_type", marks.hash_feature(F.col("node_type"), 2048).alias("bucket"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM e), p AS (SELECT vec_id, list_transform(e, lambda v: greatest(v / list_sum(e), 1e-12)) AS p FROM s)
SELECT vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) AS nats FROM p""")
def mark_softmax_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", r6(marks.softmax_entropy(F.transform("embedding", lambda x: x.cast("double"))), "nats"))


@query("""WITH a AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS c FROM embeddings GROUP BY label), s AS (SELECT e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), a.c) AS pos, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), b.c) AS neg FROM embeddings e JOIN a ON a.label = e.label JOIN a b ON b.label = (e.label + 1) % 10)
SELECT label, round(avg(pos), 6) AS mean_pos, round(avg(neg), 6) AS mean_neg, round(avg(pos) - avg(neg), 6) AS separation, round(avg(greatest(0, 0.3 - pos + neg)), 6) AS triplet_loss FROM s GROUP BY label""")
def mark_separation(spark: SparkSession, d: str) -> DataFrame:
    """Cosine to the first vector of the own label and of the next, and the triplet loss of the two."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    a = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    j = e.join(a, "label").withColumnRenamed("c", "p").withColumn("next", (F.col("label") + 1) % 10).join(a.select(F.col("label").alias("next"), F.col("c").alias("q")), "next")
    pos, neg = marks.cosine(F.col("v"), F.col("p")), marks.cosine(F.col("v"), F.col("q"))
    g = j.groupBy("label").agg(F.avg(pos).alias("p"), F.avg(neg).alias("n"), F.avg(F.greatest(F.lit(0.0), 0.3 - pos + neg)).alias("loss"))
    return g.select("label", r6(F.col("p"), "mean_pos"), r6(F.col("n"), "mean_neg"), r6(F.col("p") - F.col("n"), "separation"), r6(F.col("loss"), "triplet_loss"))


@query(f"""WITH o AS (SELECT vec_id, list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {{'v': -CAST(embedding[i] AS DOUBLE), 'i': i - 1}})), lambda s: s.i) AS o,
sha256(from_hex(sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(CAST(label AS VARCHAR)))))) || from_hex('0000000000000000')) AS h FROM embeddings),
b AS (SELECT vec_id, o, list_transform(range((len(o) + 1) // 2), lambda n: (CAST('0x' || substr(h, CAST(2 * (n // 8) + 1 AS BIGINT), 2) AS INTEGER) >> CAST(n % 8 AS INTEGER)) & 1) AS bits FROM o)
SELECT vec_id, list_sort(list_filter(list_transform(range(len(bits)), lambda n: CAST(o[2 * n + 1 + bits[n + 1]] AS INTEGER)), lambda x: x IS NOT NULL)) AS green FROM b""")
def mark_green(spark: SparkSession, d: str) -> DataFrame:
    """The keyed green half of each vector read as logits; held against fixed sets in the tests."""
    return table(spark, d, "embeddings").select("vec_id", marks.green_tokens(F.transform("embedding", lambda x: x.cast("double")), F.array(F.col("label").cast("int")), KEY).alias("green"))
