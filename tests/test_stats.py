"""Exact numbers of the statistics, ranks and mark functions."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import marks, stats
from quarrylens.operators import cumulative, lifecycle, rank, regress, relate


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_z_scores(spark):
    r = one(spark, *[stats.z_score(F.lit(h), F.lit(e), F.lit(v)).alias(n) for n, h, e, v in (("a", 20.0, 10.0, 5.0), ("b", 15.0, 10.0, 5.0), ("c", 20.0, 5.0, 3.75), ("d", 3.0, 1.9, 0.73), ("e", 1.0, 1.0, 0.0), ("f", 2.0, 1.0, 0.0), ("g", 0.0, 1.0, 0.0))])
    assert r.a == pytest.approx(10 / math.sqrt(5)) and r.b == pytest.approx(2.2360679) and r.c == pytest.approx(15 / math.sqrt(3.75)) and r.d == pytest.approx(1.1 / math.sqrt(0.73))
    assert (r.e, r.f, r.g) == (0.0, math.inf, -math.inf)


def test_tail_wilson_and_fusion(spark):
    z = stats.fuse(F.lit(3.0), F.lit(2.0), F.lit(8), 16)
    low, high = stats.wilson(F.lit(3), F.lit(10))
    r = one(spark, z.alias("z"), stats.normal_sf(z).alias("p"), stats.rationale(F.lit(3.0), F.lit(2.0)).alias("why"), low.alias("low"), high.alias("high"))
    assert r.z == 3.5 and r.p == pytest.approx(2.326e-4, rel=1e-3) and r.why == "semantic borderline, lexical supportive"
    assert (r.low, r.high) == (0.107789, 0.603227)


def test_pass_at_k(spark):
    df = spark.createDataFrame([(2, 1), (2, 0)], "n int, c int")
    got = df.agg(*[F.avg(stats.pass_at_k(F.col("n"), F.col("c"), k)).alias(f"k{k}") for k in (1, 2, 10)]).first()
    assert tuple(got) == (0.25, 0.5, 0.5)


def test_percentiles(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    got = cumulative.linear_percentiles(df, [], "v", [0.99, 0.95]).first()
    assert (got.p99, got.p95) == (pytest.approx(98.01), pytest.approx(94.05))
    e = spark.createDataFrame([(1200,), (2400,), (3600,), (4800,), (6000,), (None,)], "v int")
    assert tuple(cumulative.nearest_rank(e, [], "v", [0.1, 0.5, 0.75, 0.9, 0.95]).first())[1:] == (1200, 3600, 4800, 6000, 6000)
    assert tuple(cumulative.nearest_rank(e.limit(0), [], "v", [0.5]).first()) == (None, None)
    assert cumulative.nearest_rank(e.limit(0).withColumn("g", F.lit(1)), ["g"], "v", [0.5]).count() == 0


def test_roc(spark):
    df = spark.createDataFrame([(0.81, True), (0.77, True), (0.75, True), (0.21, False), (0.18, False), (0.10, False)], "s double, y boolean")
    assert rank.roc_auc(df, "s", "y").first().auc == 1.0 and rank.tpr_at_fpr(df, "s", "y", 0.01).first().tpr == 1.0
    ties = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, None)], "s double, y boolean")
    assert rank.roc_auc(ties, "s", "y").first().auc == 0.25
    assert rank.roc_auc(df.limit(0), "s", "y").first().auc == 0.0 and rank.tpr_at_fpr(df.filter("y"), "s", "y", 0.5).first().tpr == 0.0


def test_best_f1(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (float("inf"), True), (float("-inf"), False)], "s double, y boolean")
    got = rank.best_f1(df, "s", "y", 0.0, 1.0)
    assert got.first().f1 == pytest.approx(1.0, abs=1e-6) and got.first().threshold == pytest.approx(20 / 99)


def test_retrieval(spark):
    e = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(5)], i) for i in range(5)], "k bigint, v array<float>, t bigint")
    got = rank.retrieval_ranks(e, e, "k", "v", "t")
    assert sorted((r.k, r["rank"]) for r in got.collect()) == [(i, 1) for i in range(5)]
    parts = rank.retrieval_ranks(e, e, "k", "v", "t", part_rows=2)
    assert sorted((r.k, r["rank"]) for r in parts.collect()) == [(i, 1) for i in range(5)]


def test_gamma_schedule(spark):
    anchors = [(F.lit(float(u)), g) for u, g in ((100, 0.95), (500, 0.75), (800, 0.55), (900, 0.35), (1000, 0.25))]
    df = spark.createDataFrame([(800.0, 3), (50.0, 2), (2000.0, 2), (650.0, 4), (100.0, 1)], "u double, d int")
    t, k, e = marks.quantize(marks.schedule(F.col("u"), anchors), F.col("d"))
    assert [tuple(r) for r in df.select(t, k, e).collect()] == [(0.55, 4, 0.5), (0.95, 3, 0.75), (0.25, 1, 0.25), (0.65, 10, 0.625), (0.95, 1, 0.5)]


def test_keyed_functions(spark):
    r = one(spark, marks.hmac_sha256("k" * 70, F.lit("módulo")).alias("a"), marks.hmac_sha256("k", F.lit("")).alias("b"))
    assert r.a == hmac.new(b"k" * 70, "módulo".encode(), hashlib.sha256).hexdigest() and r.b == hmac.new(b"k", b"", hashlib.sha256).hexdigest()
    valid = marks.valid_regions("key", "module", 3, gamma=0.5)
    assert len(set(valid)) == 4 and valid == marks.valid_regions("key", "module", 3, 4)
    with pytest.raises(ValueError):
        marks.valid_regions("key", "module", 3, 8)
    planes = marks.planes("key", 3, 4)
    v = F.array(*[F.lit(x) for x in planes[0]])
    s = one(spark, marks.signature(v, planes).alias("s"), marks.signature_of(marks.projections(v, planes)).alias("t"), marks.min_margin_of(marks.projections(F.array(*[F.lit(0.0)] * 4), planes), F.array(*[F.lit(0.0)] * 4)).alias("m"))
    assert s.s == s.t and s.s & 4 and s.m == 0.0


@pytest.mark.parametrize("key, prefix, green", [("shared-key", (4, 5), {0, 3}), ("other-key", (4, 5), {1, 3}), ("shared-key", (4, 6), {0, 2})])
def test_green_halves(spark, key, prefix, green):
    assert marks.green_ids([0, 1, 2, 3], prefix, key) == green
    df = spark.createDataFrame([([0.9, 0.8, 0.2, 0.1], list(prefix))], "l array<double>, p array<int>")
    assert set(df.select(marks.green_tokens(F.col("l"), F.col("p"), key)).first()[0]) == green


def test_order(spark):
    assert one(spark, marks.descending_order(F.array(*[F.lit(x) for x in (0.2, 1.1, -0.5, 0.7, 0.1, 0.9)])).alias("o")).o == [1, 5, 3, 0, 4, 2]


L = "s string, o int, initial_verify struct<passed:boolean,failure_reason:string>, retry_attempts array<struct<attempt_index:int,produced_block:boolean,failure_reason:string>>, cascade_events array<struct<triggered:boolean,rollback_id:string>>, final_outcome struct<embedded:boolean,rescued_by_retry:boolean,rescued_by_cascade:boolean,exhausted_retries:boolean,failure_reason:string>"


def test_lifecycle(spark):
    event = [(True, "r1")]
    df = spark.createDataFrame([("a", 0, (False, "margin_miss"), [(0, None, "odd"), None, (1, True, None)], event, (True, True, False, False, None)), ("a", 1, None, None, event, (True, False, True, False, None)), ("b", 0, None, [], None, None)], L)
    r = {x.s: x for x in lifecycle.retries(df, ["s"]).collect()}
    assert (r["a"].retry_rescued, r["a"].cascade_rescued, r["a"].rescued, r["a"].attempts_total, r["a"].attempts_no_block) == (1, 1, 2, 2, 1)
    assert (r["b"].blocks, r["b"].attempts_total) == (1, 0)
    assert [tuple(x) for x in lifecycle.cascades(df, ["s"]).collect()] == [("a", 1, 1)]
    assert {(x.reason, x.n) for x in lifecycle.reason_histogram(df, ["s"]).collect()} == {("margin_miss", 1), ("unknown", 1)}


def test_relations(spark):
    df = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("a", 5), ("a", None)], "k string, o int")
    r = relate.ordinal_report(df, ["k"], "o", F.max(F.lit(4))).first()
    assert (r.missing, r.out_of_range, r.repeated) == ([1, 3], [5], [2])
    last = relate.last_by(spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 9, None)], "k string, v int, t int"), ["k"], "t").first()
    assert last.v == 2
    seen = relate.first_seen(spark.createDataFrame([(0, "x", False), (1, "x", True), (2, "x", True)], "p int, k string, ok boolean"), ["k"], ["p"], F.col("ok"))
    assert [r.p for r in seen.collect()] == [1]
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    got = one(spark, relate.differing_keys(m({"a": "1", "b": "2"}), m({"b": "3", "c": "4"})).alias("d"), relate.map_delta(m({"a": 1}), m({"a": 4, "b": 2})).alias("x"), relate.left_pad(F.array(F.lit(1)), 3, 0).alias("p"))
    assert got.d == ["a", "b", "c"] and got.x == {"a_delta": 3, "b_delta": 2} and got.p == [0, 0, 1]


def test_reasons(spark):
    rows = [(True, True), (False, True), (True, False), (False, False), (None, True)]
    got = spark.createDataFrame(rows, "v boolean, m boolean").select(lifecycle.reason_of(F.col("v"), F.col("m"))).collect()
    assert [r[0] for r in got] == ["unknown", "signature_miss", "margin_miss", "signature_miss", "unknown"]


def test_cumulative_over_groups(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS g", "id AS v", "1 AS n")
    rows = cumulative.cumulative(df, ["g"], "v", ["n"]).collect()
    for g in (None, 1, 2):
        mine = sorted((r.v, r.before_n, r.total_n) for r in rows if r.g == g)
        assert [b for _, b, _ in mine] == list(range(len(mine))) and {t for _, _, t in mine} == {len(mine)}


def test_a_wrong_expected_count_fills_nothing(spark):
    df = spark.createDataFrame([("a", 0, 10**9), ("a", 2, 10**9), ("b", None, 0), ("c", 5, None)], "k string, o int, e int")
    got = {r.k: (r.n_missing, [tuple(g) for g in r.gaps], r.out_of_range) for r in relate.ordinal_report(df, ["k"], "o", F.max("e")).drop("missing").collect()}
    assert got == {"a": (10**9 - 2, [(1, 1), (3, 10**9 - 1)], []), "b": (0, [], []), "c": (0, [], [])}


def test_first_seen_keeps_the_row(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 3, "u"), (None, 2, "v")], "k string, o int, v string")
    assert sorted(map(tuple, relate.first_seen(df, ["k"], ["o"]).collect()), key=repr) == sorted([("a", None, "z"), (None, 2, "v")], key=repr)
    assert sorted(map(tuple, relate.first_seen(df, ["k"], ["o"], F.col("v") > "v").collect()), key=repr) == [("a", None, "z")]


def test_calibration(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("inf"),), (float("nan"),)], "z double")
    assert tuple(cumulative.calibrate(df, "z", 0.5).first()) == (0.5, 2.0, 6, 3)
    assert tuple(cumulative.calibrate(df.filter("z IS NULL"), "z", 0.01).first()) == (0.01, 0.0, 1, 0)
    with pytest.raises(Exception, match="empty corpus"):
        cumulative.calibrate(df.limit(0), "z", 0.01).collect()


def test_alignment_by_mode(spark):
    block = "struct<ordinal:int,block_id:string,node_type:string,parent_node_type:string,block_text_hash:string,start_line:int,end_line:int,entropy_units:int,gamma_target:double,k:int,gamma_effective:double>"
    b = lambda o, t="x", k=None: (o, str(o), t, "module", "h", 1, 1, 5, None, k, 0.0)
    df = spark.createDataFrame([("same", [b(0)], [b(0, k=0)], "adaptive"), ("number", [b(0)], [b(0, k=3)], "adaptive"), ("fixed", [b(0)], [b(0, k=3)], "fixed"), ("type", [b(0)], [b(0, "y")], None), ("count", [b(0), b(1)], [b(0, "y", 2)], "adaptive"), ("none", None, [], None)], f"n string, a array<{block}>, b array<{block}>, mode string")
    got = {r.n: r.x for r in df.select("n", relate.align(F.col("a"), F.col("b"), F.col("mode")).alias("x")).collect()}
    assert {n: (x.status, x.contract_valid, x.is_aligned) for n, x in got.items()} == {
        "same": ("aligned", True, True), "number": ("numeric_mismatch", False, False), "fixed": ("numeric_mismatch", True, False),
        "type": ("structure_mismatch", False, False), "count": ("structure_and_numeric_mismatch", False, False), "none": ("aligned", True, True),
    }
    assert [tuple(m) for m in got["count"].structure_mismatches] == [(None, "block_count", "2", "1"), (0, "node_type", "x", "y")] and [tuple(m) for m in got["count"].numeric_mismatches] == [(0, "k", 0.0, 2.0)]


def test_whole_numbers_of_loose_values(spark):
    lines = [('{"rescued_blocks": 1, "retry_summary": {"a": "5", "b": 2.9, "c": "x", "d": null}}', '{"rescued_blocks": "7", "retry_summary": {"a": 6, "e": true}, "failure_reason_counts": {"r": " -3 "}}'), ('{"rescued_blocks": [1]}', '{"retry_summary": 3}')]
    df = spark.createDataFrame(lines, "x string, y string").select(regress.route_one(F.try_parse_json("x"), F.try_parse_json("y")).alias("r"))
    a, b = (r.r for r in df.collect())
    assert (a.rescued_blocks_delta, a.unrescued_blocks_delta, a.retry_summary, a.cascade_summary, a.failure_reason_counts) == (6, None, {"a_delta": 1, "b_delta": -2, "e_delta": 1}, {}, {"r": -3})
    assert (b.rescued_blocks_delta, b.retry_summary) == (None, {})


def test_a_reference_must_be_there(spark):
    refs = spark.createDataFrame([("a", 1), ("b", 2), ("", 3)], "id string, ref int")
    have = spark.createDataFrame([("a", 9), ("b", 9), ("a", 9)], "id string, ref int")
    assert sorted(r.ref for r in relate.must_match(have, refs, ["id"], "ref").collect()) == [1, 1, 2]
    for bad in ("c", "", None):
        with pytest.raises(Exception, match="no reference for"):
            relate.must_match(spark.createDataFrame([(bad, 0)], "id string, ref int"), refs, ["id"], "ref").collect()


def test_too_many_queries_are_an_error(spark):
    q = spark.createDataFrame([(i, [1.0, 0.0], i) for i in range(5)], "k int, v array<double>, t int")
    with pytest.raises(ValueError):
        rank.retrieval_ranks(q, q.select("k", "v"), "k", "v", "t", most_queries=4)
