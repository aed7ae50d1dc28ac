from datetime import datetime

from quarrylens.operators.diff import diff_tables

INF, NAN = float("inf"), float("nan")
T = [datetime(2024, 1, d) for d in range(1, 5)]
LEFT = "k string, v double, n int, s string, box struct<a:int,l:array<struct<x:double>>>, at timestamp"
RIGHT = "box struct<l:array<struct<x:double>>,a:bigint>, s string, n bigint, at timestamp, v double, k string"


def diff(spark, left, right, **kw):
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame([(r[4] and (r[4][1], r[4][0]), r[3], r[2], r[5], r[1], r[0]) for r in right], RIGHT)
    return sorted((r.k, r.field) for r in diff_tables(a, b, ["k"], latest="at", **kw).collect())


def row(k="a", v=1.0, n=1, s="x", box=(1, [(1.0,)]), at=T[0]):
    return (k, v, n, s, box, at)


def test_equal_but_for_noise_order_and_types(spark):
    assert diff(spark, [row()], [row(v=1.0 + 5e-10, box=(1, [(1.0 - 5e-10,)]), at=T[3])]) == []
    assert diff(spark, [row(v=INF)], [row(v=INF)]) == [] and diff(spark, [row(v=NAN)], [row(v=NAN)]) == []
    assert diff(spark, [row(box=None)], [row(box=None)]) == []


def test_each_kind_of_difference(spark):
    assert diff(spark, [row()], [row(v=1.1, n=2, s="X", box=(2, [(1.5,)]))]) == [("a", "box.a"), ("a", "box.l"), ("a", "n"), ("a", "s"), ("a", "v")]
    assert diff(spark, [row(v=INF)], [row(v=-INF)]) == [("a", "v")] and diff(spark, [row(v=None)], [row(v=NAN)]) == [("a", "v")]
    assert diff(spark, [row(box=None)], [row()]) == [("a", "box.a"), ("a", "box.l")]
    assert diff(spark, [row(box=(1, []))], [row(box=(1, None))]) == [("a", "box.l")]


def test_latest_repeats_and_missing(spark):
    left = [row(v=0.0), row(v=2.0, at=T[1]), row(v=2.0, at=T[1]), row("b"), row(None)]
    got = diff_tables(spark.createDataFrame(left, LEFT), spark.createDataFrame([row(v=2.0, at=T[2]), row("c")], LEFT), ["k"], latest="at")
    assert {(r.k, r.field) for r in got.collect()} == {("b", "missing_in_right"), ("c", "missing_in_left"), (None, "missing_in_right")}


def test_tie_of_other_content_is_settled_alike_in_both(spark):
    tie = [row(v=1.0), row(v=2.0)]
    assert diff(spark, tie, list(reversed(tie))) == []


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], LEFT)
    one = spark.createDataFrame([row()], LEFT)
    assert diff_tables(none, none, ["k"]).count() == 0
    assert [r.field for r in diff_tables(one, none, ["k"]).collect()] == ["missing_in_right"]
    extra = one.selectExpr("*", "1 AS field", "'z' AS left_value")
    assert {r.field for r in diff_tables(extra, one, ["k"]).collect()} == {"field", "left_value"}


def test_hot_key_over_many_batches(spark):
    hot = spark.range(60_000).selectExpr("'a' AS k", "CAST(id AS DOUBLE) AS v", "timestamp_seconds(id) AS at")
    other = spark.createDataFrame([("a", 59_999.0, T[0]), ("z", 1.0, T[0])], "k string, v double, at timestamp")
    assert [(r.k, r.field) for r in diff_tables(hot, other, ["k"], latest="at").collect()] == [("z", "missing_in_left")]


def test_ranges_share_their_split_points(spark):
    # keys of several types, null among them, cut into many ranges; the rows are read once
    from quarrylens.operators.diff import split_points

    base = spark.range(20_000).selectExpr("if(id % 977 = 0, null, concat('k', id % 7)) AS a", "timestamp_seconds(id * 3600) AS t", "id AS v", "id AS y")
    other = base.withColumn("v", base.v + (base.v % 1000 == 0).cast("int")).filter("v % 1500 <> 3")
    keys = ["a", "t"]
    assert len(split_points(base.select(*keys), keys, 500)) > 10 and split_points(base.limit(0).select(*keys), keys, 500) == []
    got = diff_tables(base, other, keys, rows_per_part=500)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    hour = lambda r: int(r.t.timestamp()) // 3600
    assert sorted((hour(r), r.field) for r in got.collect()) == sorted([(i, "v") for i in range(0, 20_000, 1000)] + [(i, "missing_in_right") for i in range(3, 20_000, 1500)])
